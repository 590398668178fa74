"""Scans, joins, aggregates, windows and set operations over fact tables.

Every ordered and limited result ends in a key, so it is the same on each run. Null means
unknown and is never turned into zero or false, unless a function says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.predicates import CALLABLE_KINDS


def with_file(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with their file's id and language; nodes without a file stay."""
    f = files.select(F.col("path").alias("file_path"), F.col("id").alias("file_id"), "language")
    return nodes.join(f, "file_path", "left")


def of_kind(nodes: DataFrame, kind: str | None) -> DataFrame:
    return nodes if kind is None else nodes.where(F.col("kind") == kind)


def function_metrics(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("kind").isin(*CALLABLE_KINDS))


def by_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """The node of a symbol: that with the least id."""
    return nodes.where(F.col("symbol") == symbol).orderBy("id").limit(1)


def resolve_symbol(nodes: DataFrame, text: str) -> DataFrame:
    """The node whose symbol is the text; else that of the name with the least id."""
    hits = nodes.where((F.col("symbol") == text) | (F.col("name") == text))
    return hits.orderBy((F.col("symbol") != text).cast("int"), "id").limit(1)


def neighbours(edges: DataFrame, nodes: DataFrame, node: Column | int, out: bool, kinds: list[str] | None = None) -> DataFrame:
    """Nodes one edge away, with the edge's kind."""
    near, far = ("source", "target") if out else ("target", "source")
    e = edges.where(F.col(near) == node)
    e = e if kinds is None else e.where(F.col("kind").isin(*kinds))
    e = e.select(F.col(far).alias("id"), F.col("kind").alias("edge_kind")).distinct()
    return e.join(nodes, "id")


def incident(edges: DataFrame, node: Column | int) -> DataFrame:
    """(id, edge_kind, side): what the edges at a node lead to and come from, each once, whether or not it is there."""
    ends = [edges.where(F.col(near) == node).select(F.col(far).alias("id"), F.col("kind").alias("edge_kind"), F.lit(side).alias("side")) for near, far, side in (("source", "target", "out"), ("target", "source", "in"))]
    return ends[0].union(ends[1]).distinct()


def cross_file_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends lie in different files, with both symbols."""
    s = nodes.select(F.col("id").alias("source"), F.col("symbol").alias("source_symbol"), F.col("file_path").alias("source_file"))
    t = nodes.select(F.col("id").alias("target"), F.col("symbol").alias("target_symbol"), F.col("file_path").alias("target_file"))
    return edges.join(s, "source").join(t, "target").where("source_file <> target_file")


def orphans(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")


def language_composition(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes and files by language; nodes without a file count nowhere."""
    return with_file(nodes, files).where("file_id is not null").groupBy("language").agg(F.count("id").alias("nodes"), F.countDistinct("file_id").alias("files"))


def pairs_within(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Ordered pairs of different items of one group."""
    return rows.select(group, F.col(item).alias("a")).join(rows.select(group, F.col(item).alias("b")), group).where("a <> b")


def rank_ascending(value: str, *within: str) -> Column:
    """1 and how many are smaller. Without ``within`` all rows are one partition; see ranks_over_values for large tables."""
    return F.rank().over(Window.partitionBy(*within).orderBy(value))


def ranks_over_values(rows: DataFrame, value: str, rank: str) -> DataFrame:
    """Rows with 1 and how many rows have a smaller value. Only distinct values meet in one task, not rows."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return rows.join(counts.select(value, (below + 1).alias(rank)), value)


def with_delta(rows: DataFrame, order: str, value: str, delta: str) -> DataFrame:
    """The change since the row before; null if either is."""
    return rows.withColumn(delta, F.col(value) - F.lag(value).over(Window.orderBy(order)))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in key]), order).alias("_r")).select(*key, "_r.*")


def survivors(rows: DataFrame, key: str, order: str = "id") -> DataFrame:
    """(each row's order, that of the row that stands for its key: the least)."""
    return rows.select(F.col(order), F.min(order).over(Window.partitionBy(key)).alias("survivor"))


def sibling_ordinals(rows: DataFrame, parent: list[str], order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*parent).orderBy(order)) - 1


def winnowed(hashes: Column, window: int = 4) -> Column:
    """Fingerprints of a sequence: the rightmost least hash of each window, each place once. Short sequences give one.

    A place is the rightmost least of some window if, for a split of the window's other places,
    none on its left is less and all on its right are greater.
    """

    def chosen(x: Column, at: Column) -> Column:
        some = F.lit(False)
        for left in range(window):
            every = F.lit(True)
            for i in range(1, left + 1):
                every = every & F.coalesce(F.get(hashes, at - i) >= x, F.lit(False))
            for i in range(1, window - left):
                every = every & F.coalesce(F.get(hashes, at + i) > x, F.lit(False))
            some = some | every
        return some

    short = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.slice(hashes, 1, 0))
    return F.when(F.size(hashes) < window, short).otherwise(F.filter(hashes, chosen))


def top_per(rows: DataFrame, within: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def symmetric_difference(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("leaked", "orphaned")) -> DataFrame:
    """Rows of either table that the other lacks, with ``side``."""
    return left.subtract(right).withColumn("side", F.lit(names[0])).unionByName(right.subtract(left).withColumn("side", F.lit(names[1])))


def insert_absent(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table and those new rows whose key it lacks, one for a key."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def nearest_rank(value: str, percent: int) -> Column:
    """The value at ceil(percent * n / 100) in ascending order; 0 for no values."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})"), F.lit(0))
