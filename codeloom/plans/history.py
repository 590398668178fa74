"""Queries of change history, hotspots, coverage and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.predicates import DEFECT
from codeloom.operators import history as H
from codeloom.operators.relational import nearest_rank
from codeloom.plans.registry import add

WINDOW = "w AS (SELECT c.*, head_at FROM commits c, head WHERE committed_at >= CAST(epoch(to_timestamp(head_at)::TIMESTAMP - INTERVAL 12 MONTH) AS BIGINT)), r AS (SELECT * FROM file_changes JOIN w ON sha = commit_sha)"
MEASURES = f"""{WINDOW}, base AS (SELECT path, count(*) AS commits, CAST(sum(coalesce(added, 0)) AS BIGINT) AS added, CAST(sum(coalesce(deleted, 0)) AS BIGINT) AS deleted, CAST(floor(min(head_at - committed_at) / 86400) AS BIGINT) AS last_change_days,
    CAST(round(stddev_pop((head_at - committed_at) / 86400)) AS BIGINT) AS age_dispersion_days, count(*) FILTER (regexp_matches(subject, '{DEFECT}')) AS defects FROM r GROUP BY path),
    a AS (SELECT path, author_email, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT path, sum(n) AS t, max(n) AS top, count(*) AS k FROM a GROUP BY path),
    o AS (SELECT path, CAST(round((1 - top / t) * 10000) AS BIGINT) AS ownership_bp, CASE WHEN k < 2 THEN 0 ELSE CAST(round(h / log2(k) * 10000) AS BIGINT) END AS entropy_bp FROM (SELECT path, t, top, k, -sum(n / t * log2(n / t)) AS h FROM a JOIN t USING (path) GROUP BY ALL)),
    co AS (SELECT x.path, count(DISTINCT y.path) AS cochanged FROM r x JOIN r y ON x.sha = y.sha AND x.path <> y.path WHERE x.file_count <= 50 GROUP BY x.path),
    m AS (SELECT base.*, ownership_bp, entropy_bp, coalesce(cochanged, 0) AS cochanged FROM base JOIN o USING (path) LEFT JOIN co USING (path))"""
COMPLEXITY = "cx AS (SELECT file_path AS path, sum(cc) AS cc FROM functions WHERE cc IS NOT NULL GROUP BY file_path)"
HITS = "hits AS (SELECT file_id, line_no, sum(h) AS hits FROM (SELECT file_id, line_no, second_report, max(hits) AS h FROM coverage_lines GROUP BY ALL) GROUP BY ALL)"
COVERAGE = f"""{HITS}, c AS (SELECT file_id, count(*) AS instrumented, count(*) FILTER (hits > 0) AS covered FROM hits GROUP BY file_id),
    fc AS (SELECT v.path, CASE WHEN v.content_hash = f.content_hash THEN 'fresh' ELSE 'stale' END AS state, coalesce(instrumented, 0) AS instrumented, coalesce(covered, 0) AS covered,
    CASE WHEN v.content_hash = f.content_hash AND instrumented > 0 THEN CAST((covered * 20000 + instrumented) // (instrumented * 2) AS BIGINT) END AS coverage_bp FROM coverage_files v LEFT JOIN files f ON v.path = f.path LEFT JOIN c ON v.id = file_id)"""


def measures(m):
    return H.file_history(m.commits, m.file_changes)


def complexity(m):
    return m.functions.where("cc is not null").groupBy(F.col("file_path").alias("path")).agg(F.sum("cc").alias("cc"))


def coverage(m):
    return H.file_coverage(H.merged_hits(m.coverage_lines, "second_report"), m.coverage_files, m.files)


def head(m):
    return m.sql("SELECT max(happened_at) AS t FROM usage").first()["t"]


add("D-06_churn", lambda m: m.file_changes.groupBy("path").agg(F.count("*").alias("commits"), F.sum(F.coalesce("added", F.lit(0))).alias("added")), "SELECT path, count(*) AS commits, CAST(sum(coalesce(added, 0)) AS BIGINT) AS added FROM file_changes GROUP BY path")
add("D-07_to_10_measures", lambda m: measures(m).select("path", "last_change_days", "age_dispersion_days", "ownership_bp", "entropy_bp", "cochanged"), f"WITH {MEASURES} SELECT path, last_change_days, age_dispersion_days, ownership_bp, entropy_bp, cochanged FROM m")
add("M-02_window", lambda m: H.window_commits(m.commits).agg(F.count("*").alias("commits"), F.countDistinct("author_email").alias("authors")), f"WITH {WINDOW} SELECT count(*) AS commits, count(DISTINCT author_email) AS authors FROM w")
add("M-03_file_history", measures, f"WITH {MEASURES} SELECT * FROM m")
add("M-04_history_summary", lambda m: H.history_summary(measures(m)), f"WITH {MEASURES} SELECT count(*) AS files, CAST(sum(commits) AS BIGINT) AS changes, max(commits) AS max_churn, CAST(round(avg(ownership_bp)) AS BIGINT) AS ownership_bp, CAST(round(avg(entropy_bp)) AS BIGINT) AS entropy_bp FROM m")
RANKED = "SELECT path, commits AS churn, CAST(cc AS BIGINT) AS cc, rank() OVER (ORDER BY commits) AS churn_rank, rank() OVER (ORDER BY cc) AS cc_rank FROM m JOIN cx USING (path)"
add("M-05_hotspot_board", lambda m: H.hotspots(measures(m), complexity(m)), f"WITH {MEASURES}, {COMPLEXITY} SELECT *, churn_rank * cc_rank AS score, (SELECT count(*) FROM m JOIN cx USING (path)) AS ranked_files FROM ({RANKED}) ORDER BY score DESC, path LIMIT 20")
add("M-06_untested_hotspots", lambda m: H.hotspots(measures(m), complexity(m), m.sql("SELECT file_path AS path, CASE WHEN id % 3 = 0 THEN 'fresh' ELSE 'stale' END AS state, CASE WHEN id % 3 = 0 THEN id % 2 END AS coverage_bp FROM functions WHERE id % 2 = 0 OR id % 3 = 0"), m.functions.where("is_test").select(F.col("file_path").alias("path")), True),
    f"""WITH {MEASURES}, {COMPLEXITY}, k AS (SELECT r.*, r.churn_rank * r.cc_rank AS score, coalesce(state, 'n/a') AS state, coverage_bp FROM (SELECT path, commits AS churn, CAST(cc AS BIGINT) AS cc, rank() OVER (ORDER BY commits) AS churn_rank, rank() OVER (ORDER BY cc) AS cc_rank FROM m JOIN cx USING (path) WHERE path NOT IN (SELECT file_path FROM functions WHERE is_test)) r
    LEFT JOIN (SELECT file_path AS path, CASE WHEN id % 3 = 0 THEN 'fresh' ELSE 'stale' END AS state, CASE WHEN id % 3 = 0 THEN id % 2 END AS coverage_bp FROM functions WHERE id % 2 = 0 OR id % 3 = 0) USING (path)), u AS (SELECT * FROM k WHERE state <> 'fresh' OR coverage_bp = 0)
    SELECT *, (SELECT count(*) FROM u) AS ranked_files FROM u ORDER BY score DESC, path LIMIT 20""")
add("M-08_risk_join", lambda m: H.hotspots(measures(m), complexity(m), most=50).join(measures(m), "path").where("ownership_bp > 0 or entropy_bp > 0").select("path", "score", "ownership_bp", "defects"),
    f"WITH {MEASURES}, {COMPLEXITY} SELECT path, score, ownership_bp, defects FROM (SELECT path, churn_rank * cc_rank AS score FROM ({RANKED}) ORDER BY 2 DESC, 1 LIMIT 50) JOIN m USING (path) WHERE ownership_bp > 0 OR entropy_bp > 0")
add("I-08_defect_matcher", lambda m: m.commits.where(F.col("subject").rlike(DEFECT)).groupBy("subject").agg(F.count("*").alias("n")), f"SELECT subject, count(*) AS n FROM commits WHERE regexp_matches(subject, '{DEFECT}') GROUP BY subject")
add("D-23_merged_hits", lambda m: H.merged_hits(m.coverage_lines, "second_report").groupBy("file_id").agg(F.sum("hits").alias("hits")), f"WITH {HITS} SELECT file_id, CAST(sum(hits) AS BIGINT) AS hits FROM hits GROUP BY file_id")
add("N-03_freshness", lambda m: coverage(m).select("path", "state"), f"WITH {COVERAGE} SELECT path, state FROM fc")
add("N-04_file_coverage", coverage, f"WITH {COVERAGE} SELECT * FROM fc")
add("N-05_status", lambda m: H.overall_coverage(coverage(m)), f"WITH {COVERAGE} SELECT CASE WHEN c > 0 THEN CAST((c * 20000 + i) // (i * 2) AS BIGINT) END AS overall_bp, fresh_files, files FROM (SELECT sum(covered) FILTER (state = 'fresh') AS c, sum(instrumented) FILTER (state = 'fresh') AS i, count(*) FILTER (state = 'fresh') AS fresh_files, count(*) AS files FROM fc)")
add("C-19_path_mapping", lambda m: H.mapped_paths(m.files.select(F.when(F.col("id") % 8 == 0, F.concat(F.lit("./build/x/"), F.col("path"))).otherwise(F.regexp_replace("path", "^src/", "")).alias("reported")), m.files),
    "SELECT CASE WHEN id % 8 = 0 THEN './build/x/' || path ELSE regexp_replace(path, '^src/', '') END AS reported, path FROM files")
add("D-24_usage", lambda m: H.usage(m.usage, H.rolled_up(m.usage.where("1 = 0")), head(m) - 7 * H.DAY), "SELECT surface, tool, count(*) AS calls, count(*) FILTER (ok) AS ok_calls FROM usage WHERE happened_at >= (SELECT max(happened_at) FROM usage) - 604800 GROUP BY ALL")
add("D-25_activity", lambda m: m.usage.groupBy(F.to_date(F.timestamp_seconds("happened_at")).cast("string").alias("day")).agg(F.count("*").alias("calls")), "SELECT CAST(CAST(to_timestamp(happened_at)::TIMESTAMP AS DATE) AS VARCHAR) AS day, count(*) AS calls FROM usage GROUP BY 1")
add("D-25_origin", lambda m: m.usage.groupBy(F.coalesce("origin", F.lit("unknown")).alias("origin")).agg(F.count("*").alias("calls")), "SELECT coalesce(origin, 'unknown') AS origin, count(*) AS calls FROM usage GROUP BY 1")
add("D-26_percentiles", lambda m: m.usage.groupBy("tool").agg(nearest_rank("duration_ms", 50).alias("p50"), nearest_rank("duration_ms", 95).alias("p95")), "SELECT tool, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM usage GROUP BY tool")
ROLL = "SELECT CAST(CAST(to_timestamp(happened_at)::TIMESTAMP AS DATE) AS VARCHAR) AS day, surface, tool, count(*) AS calls, count(*) FILTER (ok) AS ok_calls, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, max(duration_ms) AS max_duration_ms FROM usage"
add("D-27_rollup", lambda m: H.rolled_up(m.usage), f"{ROLL} GROUP BY 1, 2, 3")
add("S-02_retention", lambda m: H.retained(m.usage, H.rolled_up(m.usage.where("1 = 0")), head(m), 10)[1], f"{ROLL} WHERE happened_at < (SELECT max(happened_at) FROM usage) - 864000 GROUP BY 1, 2, 3")
add("D-28_saved_estimate", lambda m: H.saved_reads(m.usage.groupBy("tool").agg(F.count("*").alias("calls")), {"view": 2, "click": 5}), "SELECT coalesce(CAST(sum(w) AS BIGINT), 0) AS reads, coalesce(CAST(sum(w) * 1500 AS BIGINT), 0) AS tokens FROM (SELECT CASE tool WHEN 'view' THEN 2 WHEN 'click' THEN 5 ELSE 0 END AS w FROM usage)")
add("S-01_stats", lambda m: m.usage.groupBy("surface").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok_calls"), nearest_rank("duration_ms", 95).alias("p95"), F.max("duration_ms").alias("longest")), "SELECT surface, count(*) AS calls, count(*) FILTER (ok) AS ok_calls, quantile_disc(duration_ms, 0.95) AS p95, max(duration_ms) AS longest FROM usage GROUP BY surface")
add("S-04_top_tools", lambda m: m.usage.groupBy("tool").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool").limit(8), "SELECT tool, count(*) AS calls FROM usage GROUP BY tool ORDER BY 2 DESC, 1 LIMIT 8")
