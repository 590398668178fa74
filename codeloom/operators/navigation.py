"""Composite navigation: context bundles, explored files, filtered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.predicates import DOC_EDGES, DOC_KINDS, is_code
from codeloom.operators.graph import degrees, symbol_view, undirected
from codeloom.operators.relational import resolve_symbol, top_per


def seeds(hits: DataFrame, nodes: DataFrame, most: int = 8) -> DataFrame:
    """(id, is_code, match): the first code and the first other hits (id, rank), scored by place."""
    both = hits.join(nodes.select("id", is_code(F.col("kind")).alias("is_code")), "id")
    first = top_per(both, ["is_code"], [F.col("rank"), F.col("id")], most)
    place = F.row_number().over(Window.orderBy("rank", "id"))  # at most 2 * most rows
    return first.withColumn("match", 1.0 / place).select("id", "is_code", "match")


def context(hits: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 25) -> DataFrame:
    """(id, score, seed): seeds, what their documents refer to, and neighbours one step away.

    A candidate scores its match and its share of the highest degree among candidates;
    documents that refer to candidates score by how many they refer to. What comes by
    several ways scores the sum. Highest first, ties by id.
    """
    start = seeds(hits, nodes)
    doc_edges = edges.where(F.col("kind").isin(*DOC_EDGES))
    code = start.where("is_code").select("id", "match", F.lit(True).alias("seed"))
    named = doc_edges.join(start.where("not is_code").select(F.col("id").alias("source")), "source").select(F.col("target").alias("id"), F.lit(0.0).alias("match"), F.lit(False).alias("seed"))
    v, e = symbol_view(nodes, edges)
    first = code.union(named).join(v.select("id"), "id", "left_semi")
    near = undirected(e).join(first.select(F.col("id").alias("source")).distinct(), "source").select(F.col("target").alias("id"), F.lit(0.0).alias("match"), F.lit(False).alias("seed"))
    candidates = first.union(near.distinct()).groupBy("id").agg(F.sum("match").alias("match"), F.bool_or("seed").alias("seed"))
    degree = candidates.join(degrees(e), "id", "left").fillna(0, ["degree"])
    top = degree.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    scored = degree.join(F.broadcast(top)).select("id", (F.col("match") + F.col("degree") / F.col("top")).alias("score"), "seed")
    docs = doc_edges.join(candidates.select(F.col("id").alias("target")), "target").groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("n"))
    docs = docs.join(F.broadcast(top)).select("id", F.least(F.lit(1.0), F.col("n") / F.col("top")).alias("score"), F.lit(False).alias("seed"))
    merged = scored.union(docs).groupBy("id").agg(F.sum("score").alias("score"), F.bool_or("seed").alias("seed"))
    return merged.orderBy(F.desc(F.round("score", 9)), "id").limit(most)


def explored(nodes: DataFrame, edges: DataFrame, text: str, most_files: int = 10) -> DataFrame:
    """(file_path, symbols): the anchor's file first, then those of its neighbours by path; symbols by line and id."""
    anchor = resolve_symbol(nodes, text).select("id", F.col("file_path").alias("anchor_file"))
    near = undirected(edges).join(anchor.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).union(anchor.select("id")).distinct()
    files = near.join(nodes, "id").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "symbol"))).alias("s"))
    first = files.join(F.broadcast(anchor.select("anchor_file"))).withColumn("at", F.when(F.col("file_path") == F.col("anchor_file"), 0).otherwise(1))
    return first.orderBy("at", "file_path").limit(most_files).select("file_path", F.array_join(F.transform("s", lambda x: x["symbol"]), ",").alias("symbols"))


def first_of(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of parts, each key once, from the first part that has it, with ``part``."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    rest = [c for c in out.columns if c not in (key, "part")]
    return out.groupBy(key).agg(F.min_by(F.struct("part", *rest), "part").alias("_r")).select(key, "_r.*")


def visual_layer(kind: Column) -> Column:
    """code, doc or artifact."""
    return F.when(is_code(kind), "code").when(kind.isin(*DOC_KINDS), "doc").otherwise("artifact")
