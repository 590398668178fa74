"""Queries of pages, anchors and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import documents as R
from codeloom.plans.registry import add

STATES = "s AS (SELECT a.*, CASE WHEN f.path IS NULL THEN 'missing' WHEN f.content_hash = a.content_hash THEN 'fresh' ELSE 'stale' END AS state FROM anchors a LEFT JOIN files f ON a.entity_id = f.path), p AS (SELECT slug, count(*) AS anchors, count(*) FILTER (state = 'fresh') AS fresh, CASE WHEN bool_or(state = 'missing') THEN 'missing' WHEN bool_or(state = 'stale') THEN 'stale' ELSE 'fresh' END AS state FROM s GROUP BY slug)"


def states(m):
    return R.anchor_states(m.anchors, m.files.select(F.col("path").alias("entity_id"), "content_hash"))


def pages(m):
    return m.pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("slug"), F.col("url").alias("body"))


add("R-01_upsert", lambda m: R.upserted(pages(m), pages(m).where("slug like '%1'").withColumn("body", F.lit("new"))), "SELECT 'page' || page_id AS slug, CASE WHEN page_id % 10 = 1 THEN 'new' ELSE url END AS body FROM pages")
add("R-01_validation", lambda m: pages(m).select("slug", R.valid_page(F.col("slug"), F.col("body")).alias("ok")), "SELECT 'page' || page_id AS slug, length(trim(url)) > 0 AS ok FROM pages")
add("R-02_anchor_states", lambda m: states(m).select("slug", "ordinal", "entity_id", "state"), f"WITH {STATES} SELECT slug, ordinal, entity_id, state FROM s")
add("C-20_page_states", lambda m: R.page_states(states(m)), f"WITH {STATES} SELECT * FROM p")
add("R-04_status", lambda m: R.page_summary(R.page_states(states(m))), f"WITH {STATES} SELECT count(*) AS pages, count(*) FILTER (state = 'fresh') AS fresh_pages, CAST(round(count(*) FILTER (state = 'fresh') / count(*) * 10000) AS BIGINT) AS fresh_bp FROM p")
add("C-21_unanchored", lambda m: R.unanchored(m.files.select(F.lit("file").alias("kind"), F.col("path").alias("entity_id")), m.anchors), "SELECT 'file' AS kind, path AS entity_id FROM files WHERE path NOT IN (SELECT entity_id FROM anchors)")
add("R-05_pruned", lambda m: R.pruned(pages(m), pages(m).where("slug not like '%7'"))[1].select("slug"), "SELECT 'page' || page_id AS slug FROM pages WHERE page_id % 10 = 7")
# Every page links to the next one, to one that is not presented, to its own section, and out.
LINKED = """SELECT page_id, cast(floor(page_id / 7) AS bigint) AS g, 'docs/d' || cast(page_id % 5 AS varchar(3)) || '/page' || cast(page_id AS varchar(9)) || '.md' AS path,
    url || ' [next](../d' || cast((page_id + 1) % 5 AS varchar(3)) || '/page' || cast(page_id + 1 AS varchar(9)) || '.md#top), [gone](./x/../missing.md) [own](#here) [out](https://x.y/z) [up](../../../a.md)' AS body FROM pages"""
add(
    "R-06_materialized",
    lambda m: R.materialized(
        R.with_links(m.sql(LINKED), m.sql(LINKED).where("page_id % 3 <> 0").select("path", F.concat(F.lit("/wiki/page"), F.col("page_id").cast("string")).alias("href")), "page_id"), "g", "page_id", "body"
    ),
    f"""WITH l AS ({LINKED}), n AS (SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM pages p WHERE p.page_id = l.page_id + 1) AND (l.page_id + 1) % 3 <> 0
        THEN replace(body, '(../d' || (l.page_id + 1) % 5 || '/page' || l.page_id + 1 || '.md#top)', '(/wiki/page' || l.page_id + 1 || '#top)') ELSE body END AS b FROM l)
    SELECT g, string_agg(b, chr(10) || chr(10) ORDER BY page_id) AS document FROM n GROUP BY g""",
)
add("R-07_folder_counts", lambda m: R.folder_counts(m.files, m.nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))).withColumn("depth", F.col("depth").cast("bigint")),
    "WITH c AS (SELECT file_path, count(*) AS n FROM nodes GROUP BY file_path), x AS (SELECT string_split(path, '/') AS p, coalesce(n, 0) AS n FROM files LEFT JOIN c ON path = file_path), y AS (SELECT p, n, unnest(range(1, len(p) + 1)) AS depth FROM x) SELECT array_to_string(p[1:depth], '/') AS prefix, depth, count(*) AS files, CAST(sum(n) AS BIGINT) AS nodes FROM y GROUP BY 1, 2")
add("R-08_queue", lambda m: R.generation_queue(R.page_states(states(m)).where("state = 'missing'"), R.page_states(states(m)).where("state = 'stale'")), f"WITH {STATES} SELECT slug, CASE state WHEN 'missing' THEN 0 ELSE 1 END AS category FROM p WHERE state <> 'fresh'")
add("W-01_threads", lambda m: R.threads(m.conversations).select("conv_id", "title", "messages", "next_turn"), "SELECT c.conv_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title, messages, next_turn FROM (SELECT conv_id, count(*) AS messages, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id) c LEFT JOIN (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id) u ON c.conv_id = u.conv_id")
add("W-02_transcript", lambda m: R.transcript(m.conversations, 3), "SELECT turn, role, text FROM conversations WHERE conv_id = 3")
