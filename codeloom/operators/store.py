"""Next versions of stored tables. Tables never change in place: each function gives the table to write."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The table, with new rows in place of those of the same key; of several new ones the last by ``order``."""
    if order:
        new = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in table.columns if c not in key]), order).alias("_r")).select(*key, "_r.*").select(*table.columns)
    else:
        new = new.dropDuplicates(key).select(*table.columns)
    return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new)


def without_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without those of a file, and the edges into it from other files, to bind again later."""
    gone = nodes.where(F.col("file_path") == path).select("id", "symbol")
    left = nodes.join(gone.select("id"), "id", "left_anti").select(*nodes.columns)
    s, t = gone.select(F.col("id").alias("source")), gone.select(F.col("id").alias("target"), F.col("symbol").alias("target_symbol"))
    captured = edges.join(t, "target").join(s, "source", "left_anti").join(nodes.select(F.col("id").alias("source"), F.col("symbol").alias("source_symbol")), "source").select("source_symbol", "target_symbol", "kind")
    kept = edges.join(s, "source", "left_anti").join(t.select("target"), "target", "left_anti").select(*edges.columns)
    return left, kept, captured


def annotated(nodes: DataFrame, verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes with the verdicts' columns in place of their own; nodes without a verdict keep theirs."""
    v = verdicts.select("id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_has"))
    both = nodes.join(v, "id", "left")
    return both.select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def changed_only(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows that differ from the old ones, or that the old ones lack."""
    o = old.select(F.col(key), F.struct(*columns).alias("_old"))
    return new.join(o, key, "left").where(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old").select(*new.columns)


def derived_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with ``derived``: the old ones that are not, and the new ones that are; an edge that is both is derived."""
    both = edges.withColumn("derived", F.lit(False)).unionByName(new.withColumn("derived", F.lit(True)))
    return both.groupBy("source", "target", "kind").agg(F.bool_or("derived").alias("derived"))


def one_node_per_symbol(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the least id of each symbol, and edges led to these, each once."""
    keep = nodes.groupBy("symbol").agg(F.min("id").alias("keep"))
    of = nodes.select("id", "symbol").join(keep, "symbol").select("id", "keep")
    s, t = of.toDF("source", "s"), of.toDF("target", "t")
    led = edges.join(s, "source").join(t, "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "kind").distinct()
    return nodes.join(of.where("id = keep").select("id"), "id", "left_semi").select(*nodes.columns), led


def synced(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed, by path and content hash."""
    old, new = files.select("path", F.col("content_hash").alias("old")), found.select("path", F.col("content_hash").alias("new"))
    change: Column = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return old.join(new, "path", "full").select("path", change.alias("change")).where("change is not null")


def write_chunks(table: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append a table in files of bounded size."""
    table.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def copy_store(spark: SparkSession, source: str, target: str, tables: list[str]) -> None:
    """Copy tables of a store to another folder, which must not hold them yet."""
    for t in tables:
        spark.read.parquet(f"{source}/{t}").write.mode("error").parquet(f"{target}/{t}")


def recorded(stores: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(store, key, value) after keyed rows are put into each store; those of the same key are replaced."""
    out = None
    for name in sorted({*stores, *new}):
        old, more = stores.get(name), new.get(name)
        table = more if old is None else old if more is None else upsert(old, more, ["key"])
        table = table.select(F.lit(name).alias("store"), "key", "value")
        out = table if out is None else out.unionByName(table)
    return out


def persisted(commits: DataFrame, new_commits: DataFrame, changes: DataFrame, new_changes: DataFrame, cursor: str | None) -> DataFrame:
    """(name, value): how many commits and changes there are after a run is put in by key, and the cursor it leaves."""
    c, f = upsert(commits, new_commits, ["sha"]), upsert(changes, new_changes, ["commit_sha", "path"])
    rows = c.agg(F.lit("commits").alias("name"), F.count("*").cast("string").alias("value")).union(f.agg(F.lit("changes"), F.count("*").cast("string")))
    return rows.union(commits.sparkSession.createDataFrame([("cursor", cursor)], "name string, value string"))


def verified(live: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """One row: how many rows each has, and how many keys only one of them has, as after a fresh index."""
    l, f = live.select(key).distinct(), fresh.select(key).distinct()  # noqa: E741
    counts = live.agg(F.count("*").alias("live")).join(fresh.agg(F.count("*").alias("fresh")))
    return counts.join(l.subtract(f).agg(F.count("*").alias("leaked"))).join(f.subtract(l).agg(F.count("*").alias("missing")))


class ViewCache:
    """Built views by name and revision, at most ``most`` of them; the one used longest ago goes first."""

    def __init__(self, most: int = 16) -> None:
        self.most, self.held = most, OrderedDict()
        self.hits = self.misses = 0

    def get(self, name: str, revision: int, build: Callable[[], DataFrame]) -> DataFrame:
        key = (name, revision)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        for old in [k for k in self.held if k[0] == name]:  # an older revision is of no more use
            self.held.pop(old).unpersist()
        while len(self.held) >= self.most:
            self.held.popitem(last=False)[1].unpersist()
        self.held[key] = build().persist(StorageLevel.MEMORY_AND_DISK)  # what memory has no room for goes to disk
        return self.held[key]
