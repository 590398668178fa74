"""Suggestions of names, and near clones by winnowed shingles. Text search is in operators.textindex."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.cycles import components
from codeloom.operators.relational import winnowed
from codeloom.operators.shared import numbered, spread, written

BLOCK = 8 << 20  # hashes of the sets that a task compares with as many others
FEW = 50_000  # hashes of a block that is not worth cutting
MEETS = 4 << 20  # meetings of two sets by a hash, or cells for them, that are counted at once
COUNTED = 0.5  # the similarity below which shared hashes are counted


def suggestions(names: DataFrame, text: str, most: int = 5) -> DataFrame:
    """Names that start with the text's first identifier; if none does, those that contain the text."""
    n = names.select("name").distinct()
    start = n.where(F.startswith(F.lower("name"), F.lower(F.regexp_extract(F.lit(text), r"[A-Za-z_]\w*", 0)))).withColumn("tier", F.lit(0))
    inside = n.where(F.contains("name", F.lit(text))).withColumn("tier", F.lit(1))
    both = start.union(inside)
    best = both.agg(F.min("tier").alias("tier"))
    return both.join(F.broadcast(best), "tier").orderBy("name").limit(most).select("name")


# Near clones


def shingle_sets(docs: DataFrame, key: str, text: str, k: int = 5, window: int = 4) -> DataFrame:
    """(key, hash): distinct winnowed hashes of k tokens in a row."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.substring(F.md5(F.array_join(F.slice("w", i, k), " ").cast("binary")), 1, 15))
    rows = spread(docs.select(key, text)).select(F.col(key).alias("key"), words.alias("w")).where(F.size("w") >= k).select("key", grams.alias("g"))
    return rows.select("key", F.explode(F.array_distinct(winnowed(F.col("g"), window))).alias("hash"))


def least_shingles(min_tokens: int, k: int = 5, window: int = 4) -> int:
    return -(-(min_tokens + 2 - (k + window)) // window)


def _sized(sets: DataFrame, least: int) -> DataFrame:
    """(key, hashes, n): each set as an array, rarest hashes first, ties by hash. A hash counts in how many sets it is."""
    sets = written(sets, "clone-hashes")  # read twice
    counted = sets.join(sets.groupBy("hash").agg(F.count("*").alias("df")), "hash")
    whole = counted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("h"))  # one set's own hashes
    return whole.select("key", F.transform("h", lambda x: x["hash"]).alias("hashes"), F.size("h").alias("n")).where(F.col("n") >= least)


def _similar(whole: DataFrame, similarity: float) -> DataFrame:
    """(a, b, shared, similarity): similar pairs of sets (key, hashes, n).

    Two sets that are similar share at least ceil(similarity * n) hashes of either, so in an
    order that is the same for all sets they share one of the first n - ceil(similarity * n)
    + 1 of each. With the rarest first few sets meet there. Those that do are judged whole.
    """
    need = F.ceil(F.col("n") * similarity - 1e-9).cast("int")
    first = whole.select("key", "n", F.posexplode(F.slice("hashes", F.lit(1), F.col("n") - need + 1)).alias("at", "hash"))
    left, right = first.toDF("a", "na", "pa", "hash"), first.toDF("b", "nb", "pb", "hash")
    # Sets of too different sizes can't be similar.
    close = (F.col("na") >= similarity * F.col("nb") - 1e-9) & (F.col("nb") >= similarity * F.col("na") - 1e-9)
    # From the first hash that both have on, no more can be shared than what is left of either.
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = rest >= similarity * (F.col("na") + F.col("nb") - rest) - 1e-9
    met = left.join(right, "hash").where("a < b").where(close & enough).select("a", "b").distinct()
    one, two = whole.toDF("a", "ha", "na"), whole.toDF("b", "hb", "nb")
    both = met.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("ha", "hb")).cast("bigint"))
    both = both.withColumn("similarity", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return both.where(F.col("similarity") >= similarity).select("a", "b", "shared", "similarity")


def _counted(sets: DataFrame, similarity: float, least: int) -> DataFrame:
    """(a, b, shared, similarity): similar pairs of sets (key, hash) that need to share few of their hashes.

    There nearly every hash is rare enough to meet by, and nearly all that meet aren't similar,
    so no pair that only meets may leave its task. Sets are dealt to blocks of some BLOCK
    hashes, and a task counts what the sets of two blocks share. Memory is bounded by a block;
    every block is sent once for each, as whole numbers.
    """
    sets = written(sets, "clone-hashes")  # read several times
    rows = sets.join(sets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least), "key")
    several = sets.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1").select("hash")
    places = numbered(several, "hash", "place").select("hash", F.col("place").cast("int").alias("place"))
    whole = written(rows.join(places, "hash").groupBy("key", "n").agg(F.collect_list("place").alias("places")), "clone-sets")  # one set's own hashes
    size = whole.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK), min(8, -(-size // FEW)))
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = dealt.select("key", "n", "places", "block", other).withColumn("low", F.least("block", "other")).withColumn("task", F.col("low") * blocks + F.greatest("block", "other"))
    dealt = dealt.select("task", (F.col("block") == F.col("low")).alias("left"), "key", "n", "places")
    kind = whole.schema["key"].dataType.simpleString()

    def compared(task: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = divmod(task[0].as_py(), blocks)
        one = table.filter(table["left"])
        two = one if low == high else table.filter(pc.invert(table["left"]))
        i, j, shared = _shared_counts(*(_flat(x["places"]) for x in (one, two)), one["n"].to_numpy(), two["n"].to_numpy(), similarity, low == high)
        return pa.table({"x": one["key"].take(pa.array(i)), "y": two["key"].take(pa.array(j)), "nx": one["n"].take(pa.array(i)), "ny": two["n"].take(pa.array(j)), "shared": pa.array(shared)})

    both = dealt.groupBy("task").applyInArrow(compared, f"x {kind}, y {kind}, nx bigint, ny bigint, shared bigint")
    both = both.withColumn("similarity", F.col("shared") / (F.col("nx") + F.col("ny") - F.col("shared")))
    return both.where(F.col("similarity") >= similarity).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "similarity")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(what the lists hold, each one's length)"""
    return pc.list_flatten(lists).to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _shared_counts(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], n_one: np.ndarray, n_two: np.ndarray, similarity: float, same: bool) -> tuple[np.ndarray, ...]:
    """(i, j, shared) of similar sets of two blocks, each given by its numbers and lengths; of one block only i < j.

    The second block's sets are looked up by number. Some MEETS at once are counted: in a cell
    for each two sets where these are few for the meetings, else by sorting them.
    """
    (left, lengths), (right, sizes) = one, two
    width = len(sizes)
    order = np.argsort(right, kind="stable")
    holders, ranked = np.repeat(np.arange(width), sizes)[order], right[order]
    start = np.searchsorted(ranked, left, "left")
    meets = np.searchsorted(ranked, left, "right") - start
    ends = np.concatenate(([0], np.cumsum(lengths)))  # of the sets, in ``left``
    total = np.concatenate(([0], np.cumsum(meets)))  # of the meetings, before each number of ``left``
    dense = total[-1] * 8 >= len(lengths) * width
    found, first = [], 0
    while first < len(lengths):
        if dense:
            last = first + max(1, MEETS // max(1, width))
        else:
            last = max(first + 1, int(np.searchsorted(total[ends], total[ends[first]] + MEETS, "right")) - 1)
        last = min(last, len(lengths))
        cells = np.zeros((last - first) * width, np.int64) if dense or last == first + 1 else None
        rows = np.repeat(np.arange(last - first), lengths[first:last])
        at, stop, codes, shared = ends[first], ends[last], np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < stop:
            to = min(stop, max(at + 1, int(np.searchsorted(total, total[at] + MEETS, "right")) - 1))
            each = meets[at:to]
            places = np.arange(total[to] - total[at]) + np.repeat(start[at:to] - (total[at:to] - total[at]), each)
            codes = np.repeat(rows[at - ends[first] : to - ends[first]] * width, each) + holders[places]
            if cells is not None:
                cells += np.bincount(codes, minlength=len(cells))
            at = to
        if cells is not None:
            codes = np.flatnonzero(cells)
            shared = cells[codes]
        else:
            codes, shared = np.unique(codes, return_counts=True)
        i, j = codes // width + first, codes % width
        keep = shared / (n_one[i] + n_two[j] - shared) >= similarity
        if same:
            keep &= i < j
        found.append((i[keep], j[keep], shared[keep].astype(np.int64)))
        first = last
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))


def clone_pairs(sets: DataFrame, similarity: float = 0.85, least: int = 1) -> DataFrame:
    """(a, b, shared, similarity): all similar pairs of sets (key, hash), each with ``least`` hashes or more, exactly.

    Equal sets are compared with others once; their pairs are made of keys alone.
    """
    if similarity < COUNTED:
        return _counted(sets, similarity, least)
    of, heads = _classes(sets, least)
    member = of.select("key", "first", "n")
    equal = member.toDF("a", "first", "shared").join(member.select(F.col("key").alias("b"), "first"), "first").where("a < b")
    equal = equal.select("a", "b", F.col("shared").cast("bigint").alias("shared"), F.lit(1.0).alias("similarity"))
    links = written(_similar(heads, similarity), "clone-links")
    x, y = (member.select(F.col("first").alias(c), F.col("key").alias(k)) for c, k in (("a", "x"), ("b", "y")))
    apart = links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "similarity")
    return equal.union(apart)


def _classes(sets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(key, first, n): each set with the first that equals it, and (key, hashes, n) of the first ones."""
    whole = written(_sized(sets, least), "clone-sets")
    # Equal sets have the same order, since that is the same for all sets.
    of = written(whole.select("key", F.sha2(F.to_json("hashes"), 256).alias("d"), "n"), "clone-digests")
    first = of.groupBy("d").agg(F.min("key").alias("first"))
    heads = whole.join(first.select(F.col("first").alias("key")), "key", "left_semi").select("key", "hashes", "n")
    return written(of.join(first, "d").select("key", "first", "n"), "clone-classes"), heads


def clone_classes(sets: DataFrame, similarity: float = 0.85, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key, first) of sets that equal an earlier one, and (a, b) of similar sets that differ. Copies make no pairs."""
    of, heads = _classes(sets, least)
    return of.where("key <> first").select("key", "first"), _similar(heads, similarity).select("a", "b")


def clone_groups(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, clone_group): the least key linked; null for keys without a pair (a, b)."""
    linked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    groups = components(linked, pairs.select(F.col("a").alias("source"), F.col("b").alias("target")))
    return keys.select("key").join(groups.toDF("key", "clone_group"), "key", "left")


def near_clones(keys: DataFrame, sets: DataFrame, similarity: float = 0.85, least: int = 1) -> DataFrame:
    """clone_groups of all similar pairs, without making those between copies."""
    copies, pairs = clone_classes(sets, similarity, least)
    return clone_groups(keys, written(copies.toDF("b", "a").select("a", "b").union(pairs), "clone-links"))


def exact_duplicates(rows: DataFrame, fingerprint: str) -> Column:
    """Whether another row has the fingerprint; null without one."""
    return F.when(F.col(fingerprint).isNotNull(), F.count("*").over(Window.partitionBy(fingerprint)) >= 2)


def normalized_tokens(code: Column) -> Column:
    """Tokens of source text with I for names and L for numbers and strings; words of the language and signs stay."""
    # Words that many languages keep for themselves.
    words = ["if", "else", "for", "while", "return", "fn", "def", "class", "let", "const", "var", "import", "match", "in", "not", "and", "or"]
    bare = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"(//|#)[^\n]*", " ")
    tokens = F.regexp_extract_all(bare, F.lit(r"\"(?:[^\"\\\\]|\\\\.)*\"|'[^']*'|[A-Za-z_]\w*|\d[\w.]*|[^\s\w]"), F.lit(0))
    one = lambda t: F.when(t.rlike(r"^[\"'\d]"), "L").when(t.rlike(r"^[A-Za-z_]") & ~t.isin(*words), "I").otherwise(t)
    return F.transform(tokens, one)
