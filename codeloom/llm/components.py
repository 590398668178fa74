"""Connected components of a link table, by alternating star contractions.

Each round replaces links by links to smaller members (a large star: the greater
neighbours of a node are linked to its least neighbour; a small star: the smaller ones
are), which keeps the components and ends when every link leads to the least member. Only
minima are gathered, so a node with very many links is no more than an aggregate. Rounds
are written to the shared folder, so nothing is computed twice and lost executors cost
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least member of the component of every node that has a link to another.

    Links to itself and null ends count for nothing; repeated links for one.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(now.distinct(), "links")
    mark = _mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        # Written, so that both sides of the join come from exchanges and the links of a hot node can be split.
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "links-large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "links-least")  # every link leads to a smaller node
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "links-small")
        if (new := _mark(now)) == mark:
            break
        mark = new
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
