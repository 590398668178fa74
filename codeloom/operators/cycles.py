"""Components, strong components and depth by rounds over the whole edge table.

A round is a few joins on keys and is written to the shared folder, which cuts it from its
past. What would take a round a step is shortened: vertices with one edge in and one out
are contracted by pointer jumping, so a chain of n vertices takes log n rounds, and
components jump to their label's label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.shared import cut

TRIM_LAYERS = 2  # layers of a round
TRIM_AGAIN = 0.1  # the share of edges that trimming takes away at least, or else something else is tried
CHAIN_SHARE = 0.05  # chained vertices an edge for which depth contracts before it peels on


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the least id that undirected links (source, target) connect a node with.

    Ends of links that are no nodes connect nodes, too, but get no row. Labels go to the
    least of the neighbours' and then jump to their label's label, so the rounds grow with
    the logarithm of long chains.
    """
    links = links.where("source is not null and target is not null").select("source", "target")
    both = cut(links.union(links.select("target", "source")).distinct())
    labels = cut(both.select(F.col("source").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(new.join(jump, "component", "left").select("id", "old", F.least("component", "further").alias("component")))
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            break
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of vertices that no edge leads to or none leaves, some layers of them."""
    for _ in range(TRIM_LAYERS):
        kept = edges.select(F.col("source").alias("v")).intersect(edges.select(F.col("target").alias("v")))
        kept = [kept.select(F.col("v").alias(end)) for end in ("source", "target")]
        edges = edges.join(kept[0], "source", "left_semi").join(kept[1], "target", "left_semi").select(*edges.columns)
    return edges


def chained(edges: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """(v, prev, w_prev, next, w_next): vertices with one edge in and one out, but for the ids of ``but``. Edges have a weight w."""
    ins = edges.groupBy(F.col("target").alias("v")).agg(F.count("*").alias("n"), F.min(F.struct("source", "w")).alias("e")).where("n = 1")
    outs = edges.groupBy(F.col("source").alias("v")).agg(F.count("*").alias("n"), F.min(F.struct("target", "w")).alias("e")).where("n = 1")
    ins = ins.select("v", F.col("e.source").alias("prev"), F.col("e.w").alias("w_prev"))
    found = ins.join(outs.select("v", F.col("e.target").alias("next"), F.col("e.w").alias("w_next")), "v")
    return found if but is None else found.join(but.select(F.col("id").alias("v")), "v", "left_anti")


def jumped(chain: DataFrame) -> DataFrame:
    """Chained vertices with the vertices at both ends of their chain: (v, first, w_prev, prev, next, w_next, low, ring).

    Each round everyone takes over where its neighbours in the chain point to. On a ring
    pointers never leave the chain; there ``low`` is the least vertex and ``ring`` true.
    ``first`` is the vertex before v, and w_next the weight from v to ``next``.
    """
    now = chain.select("v", F.col("prev").alias("first"), "w_prev", "prev", "next", "w_next", F.col("v").alias("low"), F.lit(True).alias("ring"))
    inside = None
    while True:
        after = now.select(F.col("v").alias("next"), F.col("next").alias("n2"), F.col("w_next").alias("w2"), F.col("low").alias("low2"))
        before = now.select(F.col("v").alias("prev"), F.col("prev").alias("p2"))
        new = now.join(after, "next", "left").join(before, "prev", "left")
        lower = F.least("low", "low2")
        new = cut(
            new.select(
                "v", "first", "w_prev", F.coalesce("p2", "prev").alias("prev"), F.coalesce("n2", "next").alias("next"),
                (F.col("w_next") + F.coalesce("w2", F.lit(0))).alias("w_next"), lower.alias("low"), F.col("n2").isNotNull().alias("ring"), (lower < F.col("low")).alias("fell"),
            )
        )
        now = new.drop("fell")
        left = new.agg(F.count_if("ring").alias("inside"), F.count_if("fell").alias("fell")).first()
        if not left["inside"] or (left["inside"] == inside and not left["fell"]):
            return now
        inside = left["inside"]


def contracted(edges: DataFrame, chain: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges without chained vertices: an edge from one end of each chain to the other instead, with the chain's weight."""
    inner = chain.select("v")
    kept = edges.join(inner, edges["source"] == inner["v"], "left_anti").join(inner, edges["target"] == inner["v"], "left_anti")
    heads = ends.where("not ring and first = prev and prev <> next").select(F.col("prev").alias("source"), F.col("next").alias("target"), (F.col("w_prev") + F.col("w_next")).alias("w"))
    return kept.unionByName(heads).groupBy("source", "target").agg(F.max("w").alias("w"))


def spread_labels(edges: DataFrame) -> DataFrame:
    """(id, f, b): the least vertex, in the order of a hash, among those that reach a vertex and among those it reaches.

    Both ways go at once, and along edges only what has just changed is told on. Each vertex
    also has a shortcut to one that it reaches, twice as far each round, by which labels
    get along lonely ways in few rounds.
    """
    mark = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))
    near = edges.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("s"))
    labels = cut(ends_of(edges).join(near, "id", "left").select("id", mark.alias("f"), mark.alias("b"), F.lit(True).alias("cf"), F.lit(True).alias("cb"), "s"))
    none = F.lit(None).cast(labels.schema["f"].dataType)
    less = lambda a, b: F.coalesce(a < b, F.lit(False))
    while True:
        ahead = labels.where("cf").select(F.col("id").alias("source"), F.col("f").alias("nf"))
        back = labels.where("cb").select(F.col("id").alias("target"), F.col("b").alias("nb"))
        told = edges.join(ahead, "source").select(F.col("target").alias("id"), "nf", none.alias("nb"))
        told = told.union(edges.join(back, "target").select(F.col("source").alias("id"), none.alias("nf"), "nb"))
        told = told.union(labels.where("s is not null").select(F.col("s").alias("id"), F.col("f").alias("nf"), none.alias("nb")))
        told = told.groupBy("id").agg(F.min("nf").alias("nf"), F.min("nb").alias("nb"))
        there = labels.select(F.col("id").alias("s"), F.col("b").alias("sb"), F.col("s").alias("s2"))
        both = labels.select("id", "f", "b", "s").join(told, "id", "left").join(there, "s", "left")
        least_f, least_b = F.least("f", "nf"), F.least("b", "nb", "sb")
        labels = cut(both.select("id", least_f.alias("f"), least_b.alias("b"), less(least_f, F.col("f")).alias("cf"), less(least_b, F.col("b")).alias("cb"), F.coalesce("s2", "s").alias("s")))
        if labels.where("cf or cb").isEmpty():
            return labels.select("id", "f", "b")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, scc): the least id on a cycle with each vertex that has an edge; its own if there is no cycle.

    In turn: what lies before or behind all cycles is trimmed; chains are contracted; and
    labels spread forwards and backwards from all vertices at once. Where both labels of a
    vertex are one vertex, it lies on a cycle with that. Others lie in one component only
    if they agree in both labels, so edges between those that don't go, and it starts
    again. Chained vertices belong to their chain's ends if these are in one component.
    """
    ids = ends_of(edges.where("source is not null and target is not null"))
    left = cut(edges.where("source <> target").select("source", "target").distinct().withColumn("w", F.lit(1)))
    n, parts, runs = left.count(), [], []
    while n:
        while n:
            left = cut(trimmed(left))
            before, n = n, left.count()
            if n > (1 - TRIM_AGAIN) * before:
                break
        if not n:
            break
        chain = cut(chained(left))
        if not chain.isEmpty():
            ends = jumped(chain)
            left = cut(contracted(left, chain, ends))
            runs.append(ends.where("not ring").select("v", "prev", "next"))
            parts.append(ends.where("ring").select(F.col("v").alias("id"), F.col("low").alias("root")))
        labels = spread_labels(left)
        parts.append(labels.where("f = b").select("id", F.col("f.id").alias("root")))
        open_ = labels.where("f <> b").select("id", F.struct("f", "b").alias("label"))
        inner = left.join(open_.select(F.col("id").alias("source"), F.col("label").alias("ls")), "source")
        inner = inner.join(open_.select(F.col("id").alias("target"), F.col("label").alias("lt")), "target").where("ls = lt")
        left = cut(inner.select("source", "target", "w"))
        n = left.count()
    roots = ids.withColumn("root", F.col("id"))
    for part in parts:
        roots = _with(roots, part)
    for run in reversed(runs):
        a, b = roots.select(F.col("id").alias("prev"), F.col("root").alias("ra")), roots.select(F.col("id").alias("next"), F.col("root").alias("rb"))
        roots = cut(_with(roots, run.join(a, "prev").join(b, "next").where("ra = rb").select(F.col("v").alias("id"), F.col("ra").alias("root"))))
    least = roots.groupBy("root").agg(F.min("id").alias("scc"))
    return roots.join(least, "root").select("id", "scc")


def _with(roots: DataFrame, found: DataFrame) -> DataFrame:
    return roots.join(found.withColumnRenamed("root", "own"), "id", "left").select("id", F.coalesce("own", "root").alias("root"))


def longest_path(vertices: DataFrame, edges: DataFrame) -> int:
    """Vertices on the longest path of the graph whose cycles are merged; 0 without vertices.

    Vertices without an edge in are peeled, and hand the longest way to them on. Where many
    vertices are chained, chains are contracted first to edges with their length.
    """
    if vertices.isEmpty():
        return 0
    scc = strong_components(edges)
    s, t = scc.toDF("source", "a"), scc.toDF("target", "b")
    left = edges.join(s, "source").join(t, "target").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target"))
    left = cut(left.distinct().withColumn("w", F.lit(1).cast("bigint")))
    way = cut(left.select(F.col("source").alias("id"), F.lit(0).cast("bigint").alias("d")).limit(0))  # to vertices, over peeled edges
    longest, n = 0, left.count()
    while n:
        chain = cut(chained(left, way))
        if chain.count() >= max(2, CHAIN_SHARE * n):
            left = cut(contracted(left, chain, jumped(chain)))
        heads = left.select(F.col("source").alias("id")).distinct().join(left.select(F.col("target").alias("id")), "id", "left_anti")
        start = heads.join(way, "id", "left").select(F.col("id").alias("source"), F.coalesce("d", F.lit(0)).alias("d"))
        out = left.join(start, "source").select(F.col("target").alias("id"), (F.col("d") + F.col("w")).alias("d"))
        way = cut(way.join(heads, "id", "left_anti").union(out).groupBy("id").agg(F.max("d").alias("d")))
        left = cut(left.join(heads.withColumnRenamed("id", "source"), "source", "left_anti"))
        n, top = left.count(), way.agg(F.max("d")).first()[0]
        longest = max(longest, top or 0)
    return longest + 1
