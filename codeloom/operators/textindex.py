"""An inverted index that is kept in a folder and changed by deltas.

A batch of documents gives one folder: postings (token, key, places in the text) in buckets
by a hash of the token and sorted by it; its distinct tokens in order, for prefixes; the
lengths of its documents; and the keys that it replaces or deletes. Postings are made where
a text is read, a row for each of its tokens, and written by the task that reads it, so no
token and no word occurrence is sent anywhere; only where keys repeat, rows meet by token
and key. Nothing written is changed. An index is the list of its batches, so who holds an older one goes on reading
that, and an update writes the buckets of its own tokens and nothing else.

A query reads the buckets of its tokens. Numbers of documents and tokens for ranking are
kept with the list. Postings of an older batch count unless a later batch has their key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.shared import cut, fresh_path, spread

TOKEN = r"[\p{L}\p{N}_]+"
K1, B = 1.2, 0.75  # fixed values of the ranking
BUCKETS = 16  # by default; a large corpus is given more


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, places): a row for each distinct token of a text, with its places in order. Nothing is exchanged.

    Steps stand in selects of their own, so that each is computed once a text.
    """
    words = F.transform(tokens_of(F.col("text")), lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", F.sort_array(words).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("n", F.size("words"))
    word = lambda i: F.get("words", i)
    first = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (word(i)["token"] != word(i - 1)["token"]))
    rows = rows.withColumn("first", first)
    places = lambda a, b: F.transform(F.sequence(a, b - 1), lambda i: word(i)["pos"])
    after = lambda k: F.coalesce(F.get("first", k + 1), F.col("n"))
    each = F.transform("first", lambda a, k: F.struct(word(a)["token"].alias("token"), places(a, after(k)).alias("places")))
    return rows.select("key", F.inline(each)).select("token", "key", "places")


def digests(held: DataFrame, name: str) -> DataFrame:
    """(key, ``name``): the tokens of a document and their places in a few numbers, in whatever order they come.

    Two different documents agree by chance only, in 128 bits.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "token", "places")) for i in range(2)]
    return held.groupBy("key").agg(F.struct(F.count("*"), *marks).alias(name))


@dataclass(frozen=True)
class TextIndex:
    """Batches in order, the numbers of their live documents and tokens, and a key's type."""

    spark: SparkSession
    batches: tuple[str, ...]
    buckets: int
    docs: int
    tokens: int
    kind: str

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> TextIndex:
        """The index of documents. Rows that repeat a key are one document, rows with a null key are left out, and texts without tokens don't count as documents."""
        kind = docs.schema[key].dataType.simpleString()
        return cls(docs.sparkSession, (), buckets, 0, 0, kind).updated(docs, key, text)

    def updated(self, docs: DataFrame | None = None, key: str = "key", text: str = "text", deleted: DataFrame | None = None) -> TextIndex:
        """The index with ``docs`` in place of what it had under their keys, and without the keys (key) of ``deleted``."""
        if docs is None:
            docs = self.spark.createDataFrame([], f"{key} {self.kind}, {text} string")
        path = fresh_path(self.spark, "text-index")
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
        held = placed(rows, "key", "text")
        if not rows.groupBy("key").count().where("count > 1").isEmpty():
            held = held.groupBy("token", "key").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
        self._write_postings(held, path)
        rows.select("key", F.size(tokens_of(F.col("text"))).alias("n")).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").write.parquet(f"{path}/lengths")
        gone = rows.select("key") if deleted is None else rows.select("key").union(deleted.where("key is not null").select("key"))
        gone.distinct().write.parquet(f"{path}/gone")
        added = self._lengths_of(path).agg(F.count("*").alias("docs"), F.sum("n").alias("n")).first()
        lost = self.lengths().join(self._gone(path), "key", "left_semi").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).first() if self.batches else None
        docs_, tokens_ = (added["docs"], added["n"] or 0) if lost is None else (added["docs"] - lost["docs"], (added["n"] or 0) - (lost["n"] or 0))
        return replace(self, batches=(*self.batches, path), docs=self.docs + docs_, tokens=self.tokens + tokens_)

    def compacted(self) -> TextIndex:
        """The same documents in one batch, written from the postings."""
        path = fresh_path(self.spark, "text-index")
        rows = self._live("postings", f"token string, key {self.kind}, places array<int>, bucket int")
        self._write_postings(rows, path)
        self.lengths().write.parquet(f"{path}/lengths")
        self.lengths().select("key").write.parquet(f"{path}/gone")
        return replace(self, batches=(path,))

    def _write_postings(self, held: DataFrame, path: str) -> None:
        """Writes (token, key, places) in buckets, sorted by token, and the distinct tokens in order."""
        bucket = F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")
        rows = held.select("token", "key", "places", bucket.alias("bucket"))
        rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
        tokens = cut(self.spark.read.schema("token string, bucket int").parquet(f"{path}/postings").select("token").distinct())
        tokens.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/tokens")

    def _lengths_of(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"key {self.kind}, n bigint").parquet(f"{path}/lengths")

    def _gone(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"key {self.kind}").parquet(f"{path}/gone")

    def _live(self, part: str, schema: str, wanted: Column | None = None) -> DataFrame:
        """Rows of all batches whose key no later batch has."""
        found = []
        for i, path in enumerate(self.batches):
            rows = self.spark.read.schema(schema).parquet(f"{path}/{part}")
            rows = rows if wanted is None else rows.where(wanted)
            if later := self.batches[i + 1 :]:
                rows = rows.join(reduce(DataFrame.union, [self._gone(p) for p in later]), "key", "left_anti")
            found.append(rows)
        return reduce(DataFrame.unionByName, found)

    def lengths(self) -> DataFrame:
        """(key, n): the tokens of each document."""
        return self._live("lengths", f"key {self.kind}, n bigint")

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """(token, key, places) of some tokens, from their buckets only; of all if None."""
        wanted = None
        if tokens is not None:
            mask = self.spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int").alias("b"))
            wanted = F.col("bucket").isin(sorted({r["b"] for r in mask.collect()})) & F.col("token").isin(tokens)
        return self._live("postings", f"token string, key {self.kind}, places array<int>, bucket int", wanted).select("token", "key", "places")

    def phrase(self, tokens: list[str]) -> DataFrame:
        """(key, tf): how often the tokens follow each other."""
        held = self.postings(sorted(set(tokens)))
        at = lambda i: F.transform("places", lambda x: x - i)
        hits = held.where(F.col("token") == tokens[0]).select("key", F.col("places").alias("starts"))
        for i, t in enumerate(tokens[1:], 1):
            hits = hits.join(held.where(F.col("token") == t).select("key", at(i).alias("more")), "key").select("key", F.array_intersect("starts", "more").alias("starts"))
        return hits.where(F.size("starts") > 0).select("key", F.size("starts").cast("bigint").alias("tf"))

    def with_prefixes(self, prefixes: list[str], most: int = 16) -> DataFrame:
        """(key, tf) of documents with a token that starts with one of the first ``most`` prefixes.

        The tokens are found in the ordered lists, whose statistics leave out most of it; of
        the postings only their buckets are read, and of these the rows of the tokens.
        """
        starts = reduce(lambda a, b: a | b, [F.startswith("token", F.lit(p.lower())) for p in prefixes[:most]], F.lit(False))
        lists = [self.spark.read.schema("token string").parquet(f"{p}/tokens").where(starts) for p in self.batches]
        found = cut(reduce(DataFrame.union, lists).distinct().withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")))
        buckets = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # at most all there are
        rows = self._live("postings", f"token string, key {self.kind}, places array<int>, bucket int", F.col("bucket").isin(buckets) & starts)
        return rows.groupBy("key").agg(F.sum(F.size("places")).cast("bigint").alias("tf"))

    def ranked(self, hits: DataFrame) -> DataFrame:
        """(key, score): BM25 of hits (key, tf)."""
        found = hits.agg(F.count("*").alias("df"))
        idf = F.ln(1 + (F.lit(self.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        long = F.col("n") / F.lit(self.tokens / self.docs if self.docs else 1.0)
        both = hits.join(self.lengths(), "key").join(F.broadcast(found))  # one row
        return both.select("key", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * long))).alias("score"))

    def search(self, phrase: str, most: int = 20) -> DataFrame:
        """(key, score) of documents with the phrase, best first, ties by key."""
        tokens = [t for t in phrase.lower().split() if t]
        return self.ranked(self.phrase(tokens)).orderBy(F.desc(F.round("score", 9)), "key").limit(most)

    def counts(self) -> DataFrame:
        """(token, df, cf) of all tokens."""
        return self.postings().groupBy("token").agg(F.count("*").alias("df"), F.sum(F.size("places")).cast("bigint").alias("cf"))

    def faults(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(fault, n): places that the index has and the documents lack, and the other way round.

        Documents are compared by digests; only those that differ are compared place by place.
        """
        docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        a, b = digests(self.postings(), "mine"), digests(placed(docs, "key", "text"), "fresh")
        both = a.withColumnRenamed("key", "k").join(b, F.col("k").eqNullSafe(F.col("key")), "full")
        other = cut(both.where(~F.col("mine").eqNullSafe(F.col("fresh"))).select(F.coalesce("k", "key").alias("k")))
        of = lambda rows: rows.join(other, F.col("key").eqNullSafe(F.col("k")), "left_semi")
        each = lambda held: held.select("key", F.explode("places").alias("pos"), "token")
        mine, fresh = each(of(self.postings())), each(placed(of(docs), "key", "text"))
        count = lambda a, b, name: a.subtract(b).agg(F.lit(name).alias("fault"), F.count("*").alias("n"))
        return count(mine, fresh, "extra").union(count(fresh, mine, "missing"))
