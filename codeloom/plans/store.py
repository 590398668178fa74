"""Queries of table versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.operators import store as U
from codeloom.operators.shared import fresh_path
from codeloom.plans.registry import add

FN = "SELECT id, name, cc FROM functions"


def fn(m):
    return m.functions.select("id", "name", "cc")


add("U-01_upsert", lambda m: U.upsert(fn(m).where("id % 3 <> 0"), fn(m).where("id % 2 = 0").withColumn("cc", F.lit(None).cast("bigint")), ["id"]), f"SELECT id, name, CASE WHEN id % 2 = 0 THEN NULL ELSE cc END AS cc FROM ({FN}) WHERE id % 3 <> 0 OR id % 2 = 0")
add("U-03_edge_triples", lambda m: m.edges.union(m.edges).dropDuplicates(["source", "target", "kind"]).groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM (SELECT DISTINCT source, target, kind FROM edges) GROUP BY kind")
add("U-04_captured", lambda m: U.without_file(m.nodes, m.edges, "src/m3/f3.rs")[2], "SELECT s.symbol AS source_symbol, t.symbol AS target_symbol, e.kind FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE t.file_path = 'src/m3/f3.rs' AND s.file_path IS DISTINCT FROM 'src/m3/f3.rs'")
add("U-05_delete_file", lambda m: U.without_file(m.nodes, m.edges, "src/m3/f3.rs")[1].groupBy("kind").agg(F.count("*").alias("n")), "WITH g AS (SELECT id FROM nodes WHERE file_path = 'src/m3/f3.rs') SELECT kind, count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g) GROUP BY kind")
add("U-06_annotate", lambda m: U.annotated(m.functions.select("id", "is_dead", "clone_group"), m.functions.where("id % 4 = 0").select("id", F.lit(None).cast("boolean").alias("is_dead"), F.col("id").alias("clone_group")), ["is_dead", "clone_group"]), "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE is_dead END AS is_dead, CASE WHEN id % 4 = 0 THEN id ELSE clone_group END AS clone_group FROM functions")
add("U-06_changed_only", lambda m: U.changed_only(fn(m), fn(m).withColumn("cc", F.when(F.col("id") % 5 == 0, 1).otherwise(F.col("cc")).cast("bigint")), "id", ["name", "cc"]), f"SELECT id, name, 1::BIGINT AS cc FROM ({FN}) WHERE id % 5 = 0 AND cc IS DISTINCT FROM 1")
add("U-07_clear_derived", lambda m: m.nodes.where("not derived").groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM nodes WHERE NOT derived GROUP BY kind")
add("U-08_derived_edges", lambda m: U.derived_edges(m.only("edges", "kind = 'calls'"), m.only("edges", "kind = 'calls' and source % 2 = 0")).groupBy("derived").agg(F.count("*").alias("n")), "SELECT source % 2 = 0 AS derived, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1")
add("U-11_dedup_nodes", lambda m: U.one_node_per_symbol(m.functions.select("id", F.col("fingerprint").alias("symbol")), m.only("edges", "kind = 'calls'"))[1], "WITH k AS (SELECT id, min(id) OVER (PARTITION BY fingerprint) AS keep FROM functions) SELECT DISTINCT s.keep AS source, t.keep AS target, kind FROM edges JOIN k s ON source = s.id JOIN k t ON target = t.id WHERE kind = 'calls'")
add("T-04_sync_diff", lambda m: U.synced(m.files.where("id % 7 <> 0"), m.files.where("id % 5 <> 0").withColumn("content_hash", F.when(F.col("id") % 11 == 0, "x").otherwise(F.col("content_hash")))), "SELECT path, CASE WHEN id % 7 = 0 THEN 'added' WHEN id % 5 = 0 THEN 'removed' ELSE 'modified' END AS change FROM files WHERE NOT (id % 7 = 0 AND id % 5 = 0) AND (id % 7 = 0 OR id % 5 = 0 OR id % 11 = 0)")
add(
    "L-23_admission_drift",
    lambda m: m.files.where(~P.is_admitted(F.col("path"), F.length("path") * 70000, ["src/**", "docs/*.md"], ["src/m2/**"], ignore=["*7.rs", "!m7/*7.rs"])).select("path"),
    """SELECT path FROM files WHERE NOT ((path LIKE 'src/%' OR regexp_matches(path, '^docs/[^/]*\\.md$')) AND path NOT LIKE 'src/m2/%'
    AND NOT (path LIKE '%7.rs' AND NOT regexp_matches(path, '^m7/[^/]*7\\.rs$')) AND length(path) * 70000 <= 2097152)""",
)
add(
    "L-24_verify_counts",
    lambda m: U.verified(m.nodes.where("id % 3 <> 0").select("symbol"), m.nodes.where("id % 5 <> 0").select("symbol"), "symbol"),
    """SELECT count(*) FILTER (id % 3 <> 0) AS live, count(*) FILTER (id % 5 <> 0) AS fresh, count(*) FILTER (id % 3 <> 0 AND id % 5 = 0) AS leaked,
    count(*) FILTER (id % 5 <> 0 AND id % 3 = 0) AS missing FROM nodes""",
)
def chunked(m):
    path = fresh_path(m.spark, "chunks")
    U.write_chunks(m.nodes.where("id % 2 = 0"), path, 100)
    U.write_chunks(m.nodes.where("id % 2 = 1"), path, 100)
    return m.spark.read.parquet(path)


add("A-24_chunks", lambda m: chunked(m).groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def copied(m):
    one, two = fresh_path(m.spark, "store"), fresh_path(m.spark, "copy")
    m.nodes.write.parquet(f"{one}/nodes")
    m.edges.write.parquet(f"{one}/edges")
    U.copy_store(m.spark, one, two, ["nodes", "edges"])
    return m.spark.read.parquet(f"{two}/edges").join(m.spark.read.parquet(f"{two}/nodes").select(F.col("id").alias("source"), F.col("kind").alias("from_kind")), "source")


add(
    "A-25_store_copy",
    lambda m: copied(m).groupBy("from_kind", "kind").agg(F.count("*").alias("n")),
    "SELECT n.kind AS from_kind, e.kind, count(*) AS n FROM edges e JOIN nodes n ON e.source = n.id GROUP BY ALL",
)
def cached(m):
    """A view asked for at two revisions and again: built once a revision, the older one given up."""
    cache = U.ViewCache(2)
    for revision in (1, 1, 2, 2, 2):
        view = cache.get("surface", revision, lambda: m.providers.groupBy("member").agg(F.countDistinct("symbol").alias("symbols")))
        view.count()
    return view.withColumn("hits", F.lit(cache.hits)).withColumn("misses", F.lit(cache.misses))


add("Q-11_cached_views", cached, "SELECT member, count(DISTINCT symbol) AS symbols, 3 AS hits, 2 AS misses FROM providers GROUP BY member")
