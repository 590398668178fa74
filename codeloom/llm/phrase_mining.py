"""Phrases of 2 to ``max_words`` words that occur together more often than by chance.

Words are counted exactly. For each phrase length in turn, windows whose shorter parts can
be frequent are hashed to cells of a sketch; a cell's sum over all texts is an upper bound
of the count of each window in it, so windows in cells below the least count are out, and
no frequent phrase is. Only one bit a cell goes to the next pass (at most
``MineConfig.max_cells`` bits; fewer cells than windows make more candidates, never fewer).

Then a task takes its texts in shards of bounded size. The shard's windows that all bounds
allow are its candidates; they are compiled into an Aho-Corasick automaton, and the shard's
text is scanned once for all overlapping matches. Both are written in short codes of words, whose
first letter delimits them (see ``word_codes``); of the text, what no candidate covers is one
break. Counts are summed over shards, and thresholds apply to sums only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice, product
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, release_heavy, small_batches

BREAKS = r"[.,;:!?\x0A-\x0D]"
UNKNOWN = "und"
# One translation for all that the definition asks of single bytes: A-Z, breaks, tabs.
PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCK = 1 << 16  # cells that are summed together
SHARD = 8 << 20  # characters of text that a task works on at once
SALTS = 64
HASHED = 32  # bytes of a word that are hashed side by side with those of others
DIGITS = 32  # of the codes of words


@dataclass(frozen=True)
class MineConfig:
    least: int = 10
    max_words: int = 3
    covered_percent: int = 50
    top: int = 2000
    cells_per_word: int = 2
    max_cells: int = 1 << 28


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, str]]:
    """The texts of each language, joined by breaks, some SHARD characters of all languages at a time."""
    held: dict[str, list[str]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= SHARD:
                yield {k: "\n".join(v) for k, v in held.items()}
                held, size = {}, 0
    if held:
        yield {k: "\n".join(v) for k, v in held.items()}


def numbered(text: str) -> tuple[np.ndarray, pa.Array]:
    """Lower-cased words in order as numbers, and the distinct ones; a line end stands where a piece ends."""
    data = text.encode("utf-8", "replace").translate(PLAIN).replace(b"\n", b" \n ")
    parts = pc.split_pattern(pa.array([data], pa.large_binary()).cast(pa.large_string()), " ").flatten()
    found = parts.filter(pc.not_equal(parts, "")).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def hashes(strings: pa.Array) -> np.ndarray:
    """A hash of each string; those of up to HASHED bytes go a byte of all of them at a time."""
    strings = strings.cast(pa.large_string())
    if not len(strings):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset :][: len(strings) + 1]
    data, starts, sizes = np.frombuffer(strings.buffers()[2] or b"\0", np.uint8), ends[:-1], np.diff(ends)
    h, left = sizes.astype(np.uint64), np.flatnonzero(sizes <= HASHED)
    for k in range(HASHED):
        left = left[sizes[left] > k]
        h[left] = h[left] * np.uint64(6364136223846793005) + data[starts[left] + k]
    for i in np.flatnonzero(sizes > HASHED):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i + 1]])
    return _mixed(h)


def word_hashes(words: pa.Array, langs: pa.Array) -> np.ndarray:
    """A hash of each word in its language, or in the only one."""
    return _mixed(hashes(words) + hashes(langs) * np.uint64(31))


class Words:
    """A shard of one language as numbers: each token's place among the distinct words (``broken``: a piece ends), and words' hashes."""

    def __init__(self, lang: str, text: str) -> None:
        self.at, self.names = numbered(text)
        self.broken = pc.index(self.names, pa.scalar("\n", self.names.type)).as_py()
        self.hashes = word_hashes(self.names, pa.array([lang], pa.string()))

    def windows(self, lengths: range, allowed: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length, starts and hashes of the windows of so many words without a break, all of whose shorter windows the bitmaps allow.

        allowed[k] has a bit for each cell of windows of k + 1 words.
        """
        h = self.hashes[self.at]
        good = self.at != self.broken
        for k in range(1, lengths.stop):
            if k > 1:
                h = _mixed(h[:-1] * np.uint64(31)) + self.hashes[self.at[k - 1 :]]
                good = good[:-1] & good[1:]
            if k <= len(allowed):
                bits = allowed[k - 1]
                cell = self.cells(h[good], len(bits) * 8)
                good[np.flatnonzero(good)[(bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0]] = False
            if k in lengths:
                starts = np.flatnonzero(good)
                yield starts, h[starts]

    @staticmethod
    def cells(hashes: np.ndarray, n_cells: int) -> np.ndarray:
        return (_mixed(hashes) % np.uint64(n_cells)).astype(np.int64)


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).where("text <> ''")


def count_words(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, n) over all texts, counted by shards first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        for shard in shards(batches):
            for k, t in shard.items():
                at, words = numbered(t)
                n = pa.array(np.bincount(at, minlength=len(words)), pa.int64())
                found = pa.RecordBatch.from_arrays([pa.array([k] * len(words), pa.string()), words.cast(pa.string()), n], ["lang", "word", "n"])
                yield found.filter(pc.not_equal(words, "\n"))

    parts = _texts(docs, lang, text).mapInArrow(run, "lang string, word string, n bigint")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bitmap(cells: DataFrame, n_cells: int) -> np.ndarray:
    """One bit for each cell, from the rows (block, bits). n_cells bits come to the driver, whatever the input."""
    bits = np.zeros((n_cells // BLOCK, BLOCK // 8), np.uint8)
    for r in cells.toLocalIterator(prefetchPartitions=True):
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def word_cells(words: DataFrame, n_cells: int) -> DataFrame:
    """The cells of words, by block."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = Words.cells(word_hashes(batch.column(1), batch.column(0)), n_cells)
            yield from _blocks(cell, np.full(len(cell), 255, np.uint8))

    return _frequent(words.select("lang", "word").mapInArrow(cells, "block int, offsets binary, counts binary"), 1)


def _blocks(cells: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cells and their counts (255: that or more) packed by block."""
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    block, first = np.unique(cells // BLOCK, return_index=True)
    if len(block):
        offsets = [x.astype(np.uint16).tobytes() for x in np.split(cells % BLOCK, first[1:])]
        packed = [x.tobytes() for x in np.split(counts, first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(offsets, pa.binary()), pa.array(packed, pa.binary())], ["block", "offsets", "counts"])


def _frequent(parts: DataFrame, least: int) -> DataFrame:
    """(block, bits): per block, the cells whose counts add up to ``least``. Rows of a block are added up one by one."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, now = np.zeros(BLOCK, np.int64), None

        def out() -> pa.RecordBatch:
            bits = np.packbits(sums >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, offsets, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != now:
                    if now is not None:
                        yield out()
                    sums[:], now = 0, block
                np.add.at(sums, np.frombuffer(offsets, np.uint16), np.frombuffer(counts, np.uint8))
        if now is not None:
            yield out()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(total, "block int, bits binary")


def window_cells(texts: DataFrame, n: int, allowed: list, n_cells: int, least: int) -> DataFrame:
    """The cells of windows of n words that reach ``least`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        bits = [b.value for b in allowed]
        for shard in shards(batches):
            cells = np.concatenate([Words.cells(h, n_cells) for k, t in shard.items() for _, h in Words(k, t).windows(range(n, n + 1), bits)])
            cell, counts = np.unique(cells, return_counts=True)
            yield from _blocks(cell, np.minimum(counts, 255).astype(np.uint8))

    return _frequent(texts.mapInArrow(run, "block int, offsets binary, counts binary"), least)


def distinct_rows(at: np.ndarray, base: int, starts: np.ndarray, n: int) -> np.ndarray:
    """The distinct windows of n numbers below ``base`` among those at ``starts``, sorted."""
    rows = at[starts[:, None] + np.arange(n)].astype(np.int64)
    if base**n >= 1 << 62:
        return np.unique(rows, axis=0)
    weights = base ** np.arange(n - 1, -1, -1, dtype=np.int64)
    return np.unique(rows @ weights)[:, None] // weights % base


def word_codes(n: int) -> list[str]:
    """n codes, short ones first. The first letter tells a code's length and is in no other place, so codes in a row are read in one way only."""
    tail = [chr(33 + i) for i in range(DIGITS)]
    heads = ([chr(33 + DIGITS * size + i) for i in range(DIGITS)] for size in count(1))
    return list(islice(chain.from_iterable(map("".join, product(head, *[tail] * more)) for more, head in enumerate(heads)), n))


def scan(words: Words, lengths: range, allowed: list[np.ndarray]) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(phrases, their length, counts): a shard's candidates, counted by one scan of its coded text."""
    windows = [(n, starts) for n, (starts, _) in zip(lengths, words.windows(lengths, allowed)) if len(starts)]
    if not windows:
        return
    covered = np.zeros(len(words.at) + 1, bool)
    for n, starts in windows:
        for i in range(n):
            covered[starts + i] = True
    covered, kept = covered[:-1], covered[:-1] | np.roll(covered, 1)[:-1]  # a break behind each covered stretch
    often = np.bincount(words.at[covered], minlength=len(words.names))
    order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    rank = np.full(len(often), len(order))
    rank[order] = np.arange(len(order))
    at = np.where(covered, rank[words.at], len(order))
    codes = word_codes(len(order))
    coded, names = pa.array(codes, pa.string()), words.names.take(pa.array(order)).cast(pa.string())
    found, automaton = [], ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, starts in windows:
        columns = [pa.array(c) for c in distinct_rows(at, len(order), starts, n).T]
        for phrase in pc.binary_join_element_wise(*map(coded.take, columns), "").to_numpy(zero_copy_only=False).tolist():
            automaton.add_word(phrase, len(automaton))
        found.append((n, pc.binary_join_element_wise(*map(names.take, columns), " ")))
    automaton.make_automaton()
    text = "".join(map([*codes, " "].__getitem__, at[kept].tolist()))
    counts = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(automaton))
    first = 0
    for n, phrases in found:
        yield phrases, n, counts[first : first + len(phrases)]
        first += len(phrases)


def count_candidates(texts: DataFrame, allowed: list, config: MineConfig) -> DataFrame:
    """(lang, phrase, size, a): exact counts of all phrases that the bounds allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        bits = [b.value for b in allowed]
        for shard in shards(batches):
            for lang, text in shard.items():
                for phrases, n, counts in scan(Words(lang, text), range(2, config.max_words + 1), bits):
                    size = len(phrases)
                    cols = [pa.array([lang] * size, pa.string()), phrases, pa.array(np.full(size, n, np.int32)), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "size", "a"])

    counted = texts.mapInArrow(run, "lang string, phrase string, size int, a bigint")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, words: DataFrame, config: MineConfig = MineConfig(), lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, size, a) of all phrases of 2 to max_words words that occur ``least`` times or more. ``words`` is count_words()."""
    spark = docs.sparkSession
    texts = _texts(docs, lang, text)
    n_words = words.agg(F.sum("n")).first()[0] or 0
    n_cells = max(BLOCK, min(config.max_cells, 1 << (config.cells_per_word * n_words).bit_length()))
    often = words.where(F.col("n") >= config.least)
    allowed = [spark.sparkContext.broadcast(bitmap(word_cells(often, n_cells), n_cells))]
    for n in range(2, config.max_words + 1):
        allowed.append(spark.sparkContext.broadcast(bitmap(window_cells(texts, n, allowed, n_cells, config.least), n_cells)))
    return count_candidates(texts, allowed, config).where(F.col("a") >= config.least)


def _joined(words: Column, first, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, config: MineConfig = MineConfig(), lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases by score, then count, then phrase.

    The score is that of the lowest-scoring cut (the first of equal ones), in exact
    decimals. A phrase inside a longer one that has covered_percent of its count is left
    out. A null language is ``und``; null and empty texts have no words; further columns
    don't matter, and rows that repeat a key are counted as often as they are there.
    """
    words = materialize(count_words(docs, lang, text), "phrase-words")
    found = materialize(frequent_phrases(docs, words, config, lang, text), "phrase-counts")
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("count")).unionByName(
        words.where(F.col("n") >= config.least).select("lang", F.col("word").alias("part"), F.col("n").alias("count"))
    )
    split = found.withColumn("w", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "left", "count": "l"}), ["lang", "left"]).join(parts.withColumnsRenamed({"part": "right", "count": "r"}), ["lang", "right"])
    score = F.expr("(1000000 * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = split.where("size > 2").select("lang", F.col("a").alias("longer"), "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    inner = inner.groupBy("lang", _joined(F.col("w"), F.col("i"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < config.covered_percent * F.col("a")))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(*order)  # no task ranks a whole language
    few = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= config.top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= config.top)
    return few.join(sums, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations_sql(config: MineConfig = MineConfig()) -> str:
    """The same in DuckDB's SQL, for phrases of 2 and 3 words."""
    return rf"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAKS}')) AS piece
      FROM documents),
    split AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    places AS (SELECT lang, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM split),
    follow AS (SELECT lang, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM places WINDOW s AS (PARTITION BY p ORDER BY i)),
    grams AS (
      SELECT lang, 1 AS size, x AS phrase FROM follow
      UNION ALL SELECT lang, 2, x || ' ' || y FROM follow WHERE y IS NOT NULL
      UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM follow WHERE z IS NOT NULL),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    cand AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= {config.least}),
    halves AS (
      SELECT lang, phrase, size, a, k, lang || chr(9) || array_to_string(w[1:k], ' ') AS lp, lang || chr(9) || array_to_string(w[k + 1:], ' ') AS rp
      FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
    parts AS (SELECT lang || chr(9) || phrase AS p, a FROM f WHERE a >= {config.least}),
    cuts AS (
      SELECT h.lang, h.phrase, h.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * h.a * h.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM halves h JOIN parts x ON x.p = h.lp JOIN parts y ON y.p = h.rp),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
      SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM cand WHERE size = 3
        UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM cand WHERE size = 3) GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < {config.covered_percent} * b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang)
    QUALIFY rank <= {config.top}"""
