"""Reachability over adjacency that is kept in buckets.

Edges are written once, in buckets by a hash of their source and sorted by it within one.
A hop reads the buckets that its frontier's ids lie in and no others, so a search from a
few nodes reads a few buckets, whatever the size of the graph, and a search that reaches
everything reads everything once a hop. Adjacency that is asked for again and again is
made by adjacency() beforehand and passed in place of edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.shared import cut, fresh_path

FAR = 1 << 30
CUT_EVERY = 8  # rounds after which the union of what is settled is written anew
BUCKETS = 16  # by default; a graph of very many edges is given more
LONG = 64  # bits


def bucket_of(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Adjacency:
    """Edges (source, target, bucket) in a folder for each bucket."""

    rows: DataFrame
    buckets: int

    def touched(self, frontier: DataFrame) -> list[int]:
        """The buckets that the ids of a frontier lie in; at most all there are, as bits."""
        at = bucket_of(F.col("id"), self.buckets)
        words = range(-(-self.buckets // LONG))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at % LONG)
        found = frontier.agg(*[F.bit_or(F.when(at.between(k * LONG, k * LONG + LONG - 1), bit)).alias(f"w{k}") for k in words]).first()
        return [k * LONG + i for k in words for i in range(LONG) if found[k] is not None and found[k] >> i & 1]

    def of(self, frontier: DataFrame) -> DataFrame | None:
        """The edges that leave the frontier's ids; None where the frontier is empty."""
        buckets = self.touched(frontier)
        if not buckets:
            return None
        rows = self.rows.where(F.col("bucket").isin(buckets)) if len(buckets) < self.buckets else self.rows
        return rows.join(frontier.select(F.col("id").alias("source")), "source").select("source", "target")


def adjacency(edges: DataFrame, buckets: int = BUCKETS) -> Adjacency:
    """Distinct edges with both ends, written in buckets by source."""
    rows = edges.where("source is not null and target is not null")
    rows = rows.select("source", "target", bucket_of(F.col("source"), buckets).alias("bucket"))
    path = fresh_path(edges.sparkSession, "adjacency")
    # Equal edges meet in their bucket, so that distinct() needs no further exchange.
    rows.repartition("bucket").distinct().sortWithinPartitions("bucket", "source").write.partitionBy("bucket").parquet(path)
    return Adjacency(edges.sparkSession.read.schema(rows.schema).parquet(path), buckets)


def reach(edges: DataFrame | Adjacency, seeds: DataFrame, most: int = FAR) -> DataFrame:
    """(id, distance): what the seeds' ids reach along edges, and in how many steps at least. Seeds have 0.

    Settled nodes are never expanded again, so cycles end. ``most`` bounds the steps. Edges
    with a null end lead nowhere.
    """
    step = edges if isinstance(edges, Adjacency) else adjacency(edges)
    start = seeds.where("id is not null").select("id").distinct()
    frontier = settled = cut(start.withColumn("distance", F.lit(0)))
    distance = 0
    while distance < most and (near := step.of(frontier)) is not None:
        distance += 1
        new = near.select(F.col("target").alias("id")).distinct().join(settled, "id", "left_anti")
        frontier = cut(new.withColumn("distance", F.lit(distance)))
        settled = settled.union(frontier)
        if distance % CUT_EVERY == 0:
            settled = cut(settled)
    return settled


def reach_by(edges: DataFrame | Adjacency, seeds: DataFrame, by: str, most: int = FAR) -> DataFrame:
    """(by, id, distance): as reach(), for all values of ``by`` in one search. ``seeds`` has (by, id)."""
    step = edges if isinstance(edges, Adjacency) else adjacency(edges)
    start = seeds.where("id is not null").select(by, "id").distinct()
    frontier = settled = cut(start.withColumn("distance", F.lit(0)))
    distance = 0
    while distance < most and (near := step.of(frontier.select("id").distinct())) is not None:
        distance += 1
        new = near.join(frontier.select(by, F.col("id").alias("source")), "source").select(by, F.col("target").alias("id")).distinct()
        frontier = cut(new.join(settled, [by, "id"], "left_anti").withColumn("distance", F.lit(distance)))
        settled = settled.union(frontier)
        if distance % CUT_EVERY == 0:
            settled = cut(settled)
    return settled
