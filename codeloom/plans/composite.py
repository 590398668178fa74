"""Queries that combine operators: context, canvases, policy nodes, ingestion, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions.scalars import basis_points, module_key
from codeloom.operators import documents as D
from codeloom.operators import graph as G
from codeloom.operators import history as H
from codeloom.operators import navigation as N
from codeloom.operators import quality as K
from codeloom.operators import relational as R
from codeloom.operators import resolution as Q
from codeloom.operators import search as I
from codeloom.operators import store as U
from codeloom.operators.globs import paired
from codeloom.operators.traverse import reach
from codeloom.plans.history import COMPLEXITY, MEASURES, complexity, coverage, measures
from codeloom.plans.registry import add

CODE = "SELECT id FROM nodes WHERE kind <> 'doc_section'"
VIEW = f"SELECT source, target, kind FROM edges WHERE kind NOT IN ('contains', 'accesses', 'implements', 'doc_reference') AND source IN ({CODE}) AND target IN ({CODE})"
HITS = "SELECT id, id AS rank FROM nodes WHERE id IN (42, 77, 3000010, 3000020, 2000003)"

add("B-03_view_edges", lambda m: G.symbol_view(m.nodes, m.edges)[1].groupBy("kind").agg(F.count("*").alias("n")), f"SELECT kind, count(*) AS n FROM ({VIEW}) GROUP BY kind")
add("B-04_production_scope", lambda m: G.production_graph(m.nodes, m.edges)[1].groupBy("kind").agg(F.count("*").alias("n")), f"WITH v AS (SELECT id FROM nodes WHERE kind NOT IN ('doc_section', 'topic') AND NOT is_test) SELECT kind, count(*) AS n FROM ({VIEW}) WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v) GROUP BY kind")
add("B-12_untested", lambda m: coverage(m).where("state <> 'fresh' or coverage_bp = 0").select("path"), "SELECT v.path FROM coverage_files v LEFT JOIN files f ON v.path = f.path WHERE v.content_hash IS DISTINCT FROM f.content_hash OR v.id NOT IN (SELECT file_id FROM coverage_lines WHERE hits > 0)")
add("C-01_node_file_join", lambda m: R.with_file(m.nodes, m.files).groupBy("language").agg(F.count("*").alias("n")), "SELECT language, count(*) AS n FROM nodes LEFT JOIN files ON file_path = path GROUP BY language")
add("C-11_hotspot_join", lambda m: measures(m).select("path", "commits").join(complexity(m), "path"), f"WITH {MEASURES}, {COMPLEXITY} SELECT path, commits, CAST(cc AS BIGINT) AS cc FROM m JOIN cx USING (path)")
add("C-14_posting_join", lambda m: I.clone_pairs(m.only("edges", "kind = 'calls'").select(F.col("source").alias("key"), F.col("target").alias("hash")), 0.05).select("a", "b", "shared"),
    "WITH s AS (SELECT source AS key, target AS hash FROM edges WHERE kind = 'calls'), n AS (SELECT key, count(*) AS n FROM s GROUP BY key), c AS (SELECT x.key AS a, y.key AS b, count(*) AS shared FROM s x JOIN s y ON x.hash = y.hash AND x.key < y.key GROUP BY ALL) SELECT a, b, shared FROM c JOIN n p ON a = p.key JOIN n q ON b = q.key WHERE shared / (p.n + q.n - shared) >= 0.05")
add("C-16_glob_rules", lambda m: paired(R.cross_file_edges(m.only("edges", "kind = 'references'"), m.nodes).select(F.col("source_file").alias("source"), F.col("target_file").alias("target")).distinct(), [("src/m1*/**", "src/m2/**"), ("src/m?/s*.rs", "src/m2?/**")]),
    """WITH e AS (SELECT DISTINCT s.file_path AS source, t.file_path AS target FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE e.kind = 'references' AND s.file_path <> t.file_path)
    SELECT 'src/m1*/** -> src/m2/**' AS rule, * FROM e WHERE regexp_matches(source, '^src/m1[^/]*/') AND target LIKE 'src/m2/%' UNION ALL SELECT 'src/m?/s*.rs -> src/m2?/**', * FROM e WHERE regexp_matches(source, '^src/m[^/]/s[^/]*\\.rs$') AND regexp_matches(target, '^src/m2[^/]/')""")
add("D-11_window_totals", lambda m: m.commits.agg(F.count("*").alias("commits"), F.sum("file_count").alias("changes"), F.round(F.avg("file_count")).cast("bigint").alias("mean_files")), "SELECT count(*) AS commits, CAST(sum(file_count) AS BIGINT) AS changes, CAST(round(avg(file_count)) AS BIGINT) AS mean_files FROM commits")
add("D-13_jaccard", lambda m: I.clone_pairs(m.only("edges", "kind = 'references'").select(F.col("source").alias("key"), F.col("target").alias("hash")), 0.2).select("a", "b", basis_points(F.col("similarity")).alias("bp")),
    "WITH s AS (SELECT source AS key, target AS hash FROM edges WHERE kind = 'references'), n AS (SELECT key, count(*) AS n FROM s GROUP BY key), c AS (SELECT x.key AS a, y.key AS b, count(*) AS shared FROM s x JOIN s y ON x.hash = y.hash AND x.key < y.key GROUP BY ALL) SELECT a, b, CAST(round(shared / (p.n + q.n - shared) * 10000) AS BIGINT) AS bp FROM c JOIN n p ON a = p.key JOIN n q ON b = q.key WHERE shared / (p.n + q.n - shared) >= 0.2")
add(
    "D-15_directory_degree",
    lambda m: G.degrees(m.imports).join(m.file_modules, "id").groupBy("directory").agg(F.sum("degree").alias("degree")),
    """SELECT directory, count(*) AS degree FROM (SELECT source AS id FROM imports UNION ALL SELECT target FROM imports) JOIN file_modules USING (id) GROUP BY directory""",
)
add("D-16_gini", lambda m: K.gini(m.functions, "line_count").select(basis_points(F.col("gini")).alias("gini_bp")), "SELECT CAST(round((2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)) * 10000) AS BIGINT) AS gini_bp FROM (SELECT line_count::DOUBLE AS x, row_number() OVER (ORDER BY line_count) AS i FROM functions)")
add("D-18_geometric_mean", lambda m: K.aggregate_signal(m.nation.select(((F.col("n_nationkey") + 1) / 26).alias("normalized"))), "SELECT CAST(round(exp(avg(ln((n_nationkey + 1) / 26))) * 10000) AS BIGINT) AS signal FROM nation")
add("D-21_line_counts", lambda m: m.coverage_lines.groupBy("file_id").agg(F.count("*").alias("lines"), F.count_if(F.col("hits") > 0).alias("covered")), "SELECT file_id, count(*) AS lines, count(*) FILTER (hits > 0) AS covered FROM coverage_lines GROUP BY file_id")
add("D-22_overall_coverage", lambda m: H.overall_coverage(coverage(m)), "WITH h AS (SELECT file_id, line_no, max(hits) AS h FROM coverage_lines GROUP BY file_id, line_no), c AS (SELECT file_id, count(*) AS i, count(*) FILTER (h > 0) AS c FROM h GROUP BY file_id), x AS (SELECT v.*, coalesce(i, 0) AS i, coalesce(c, 0) AS c, v.content_hash = f.content_hash AS fresh FROM coverage_files v LEFT JOIN files f ON v.path = f.path LEFT JOIN c ON v.id = file_id) SELECT CASE WHEN sum(c) FILTER (fresh) > 0 THEN CAST((sum(c) FILTER (fresh) * 20000 + sum(i) FILTER (fresh)) // (2 * sum(i) FILTER (fresh)) AS BIGINT) END AS overall_bp, count(*) FILTER (fresh) AS fresh_files, count(*) AS files FROM x")
add("D-33_durations", lambda m: m.usage.groupBy("surface").agg(F.sum("duration_ms").alias("total_ms")), "SELECT surface, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM usage GROUP BY surface")
add("E-03_row_number", lambda m: m.functions.select("kind", "id", F.row_number().over(R.Window.partitionBy("kind").orderBy("id")).cast("bigint").alias("n")), "SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS n FROM functions")
add("E-08_winnowing", lambda m: m.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("s")).select("conv_id", F.array_join(F.transform(R.winnowed(F.transform("s", lambda x: x["n"])), lambda x: x.cast("string")), ",").alias("kept")),
    "WITH g AS (SELECT conv_id, list(length(text) ORDER BY turn) AS g FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, g, list_distinct(list_transform(range(0, greatest(len(g) - 4, 0) + 1), lambda i: i + len(g[i+1:i+4]) - list_position(list_reverse(g[i+1:i+4]), list_min(g[i+1:i+4])) + 1)) AS p FROM g) SELECT conv_id, array_to_string(list_transform(list_sort(p), lambda x: g[x]), ',') AS kept FROM p")
add("F-02_context", lambda m: N.context(m.sql(HITS), m.nodes, m.edges).select("id", F.round("score", 6).alias("score"), "seed"),
    f"""WITH h AS ({HITS}), s AS (SELECT id, kind <> 'doc_section' AS is_code, 1.0 / row_number() OVER (ORDER BY rank, id) AS match FROM h JOIN nodes USING (id)), v AS ({VIEW}),
    f AS (SELECT id, match, true AS seed FROM s WHERE is_code UNION ALL SELECT target, 0, false FROM edges WHERE kind = 'doc_reference' AND source IN (SELECT id FROM s WHERE NOT is_code) AND target IN ({CODE})),
    nr AS (SELECT target AS id FROM v WHERE source IN (SELECT id FROM f) UNION SELECT source FROM v WHERE target IN (SELECT id FROM f)),
    c AS (SELECT id, sum(match) AS match, bool_or(seed) AS seed FROM (SELECT * FROM f UNION ALL SELECT id, 0, false FROM nr) GROUP BY id),
    d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM v UNION ALL SELECT target FROM v) GROUP BY id), t AS (SELECT greatest(max(degree), 1) AS top FROM c JOIN d USING (id)),
    sc AS (SELECT c.id, match + coalesce(degree, 0) / top AS score, seed FROM c LEFT JOIN d ON c.id = d.id, t UNION ALL SELECT source, least(1, count(DISTINCT target) / max(top)), false FROM edges, t WHERE kind = 'doc_reference' AND target IN (SELECT id FROM c) GROUP BY source)
    SELECT id, round(sum(score), 6) AS score, bool_or(seed) AS seed FROM sc GROUP BY id ORDER BY round(sum(score), 9) DESC, id LIMIT 25""")
add("F-04_explored_files", lambda m: N.explored(m.nodes, m.edges, "fn42"),
    """WITH n AS (SELECT 42 AS id UNION SELECT target FROM edges WHERE source = 42 UNION SELECT source FROM edges WHERE target = 42) SELECT file_path, string_agg(symbol, ',' ORDER BY start_line, id) AS symbols FROM nodes WHERE id IN (SELECT id FROM n) GROUP BY file_path ORDER BY file_path IS DISTINCT FROM 'src/m17/f42.rs', file_path NULLS FIRST LIMIT 10""")
add(
    "F-05_seeded_canvas",
    lambda m: reach(m.adjacent("imports_around"), m.spark.createDataFrame([(42,)], "id bigint"), 30).join(G.degrees(m.imports), "id")
    .orderBy("distance", F.desc("degree"), "id").limit(60).select("id", F.col("distance").cast("bigint").alias("distance"), "degree"),
    """WITH RECURSIVE e AS (SELECT source, target FROM imports UNION SELECT target, source FROM imports),
    w AS (SELECT 42::BIGINT AS id, 0 AS d UNION SELECT e.target, d + 1 FROM w JOIN e ON id = e.source WHERE d < 30),
    g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM imports UNION ALL SELECT target FROM imports) GROUP BY id)
    SELECT w.id, min(d) AS distance, max(degree) AS degree FROM w JOIN g ON w.id = g.id GROUP BY w.id ORDER BY 2, 3 DESC, 1 LIMIT 60""",
)
# Five orders: the worst by each, ties by name.
ORDERS = {"complexity": "cc", "length": "line_count", "nesting": "nesting", "fan_in": "fan_in", "fan_out": "fan_out"}
MEASURED = """SELECT f.id, f.name, f.cc, f.line_count, f.nesting, i.n AS fan_in, o.n AS fan_out FROM functions f
    LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS n FROM edges WHERE kind = 'calls' GROUP BY target) i ON f.id = i.id
    LEFT JOIN (SELECT source AS id, count(DISTINCT target) AS n FROM edges WHERE kind = 'calls' GROUP BY source) o ON f.id = o.id"""
add(
    "F-06_offender_orders",
    lambda m: reduce(lambda a, b: a.unionByName(b), [K.offenders(m.sql(MEASURED).where(f"{c} is not null"), d, [F.desc(c), F.asc("name"), F.asc("id")], 10).select("dimension", "name", F.col("rank").cast("bigint").alias("rank")) for d, c in ORDERS.items()]),
    f"WITH o AS ({MEASURED}) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{d}' AS dimension, name, row_number() OVER (ORDER BY {c} DESC, name, id) AS rank FROM o WHERE {c} IS NOT NULL) WHERE rank <= 10" for d, c in ORDERS.items()),
)
add(
    "F-08_doc_gap_page",
    lambda m: K.gap_page(K.undocumented(m.inline("SELECT id, file_path, name FROM functions"), m.only("edges", "kind = 'doc_reference'"), m.only("nodes", "kind = 'doc_section'")), 50).select("file_path", "name", "truncated"),
    """WITH g AS (SELECT file_path, name FROM functions WHERE id NOT IN (SELECT target FROM edges WHERE kind = 'doc_reference'))
    SELECT file_path, name, (SELECT count(*) FROM g) > 50 AS truncated FROM g ORDER BY 1, 2 LIMIT 50""",
)
add("F-10_sample", lambda m: m.nodes.where("kind = 'field'").select("symbol").orderBy("symbol").limit(50), "SELECT symbol FROM nodes WHERE kind = 'field' ORDER BY 1 LIMIT 50")
add("F-12_overlay_cap", lambda m: m.only("edges", "kind = 'doc_reference'").groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(60), "SELECT target, count(*) AS n FROM edges WHERE kind = 'doc_reference' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
add("G-02_union_rollup", lambda m: H.merged_rollups(H.rolled_up(m.usage.where("duration_ms % 2 = 0")), H.rolled_up(m.usage.where("duration_ms % 2 = 1"))).groupBy("tool").agg(F.sum("calls").alias("calls")), "SELECT tool, count(*) AS calls FROM usage GROUP BY tool")
add("G-07_first_occurrence", lambda m: N.first_of([m.functions.where("id % 2 = 0").select("id"), m.functions.where("id % 3 = 0").select("id")], "id").withColumn("part", F.col("part").cast("bigint")), "SELECT id, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS part FROM functions WHERE id % 2 = 0 OR id % 3 = 0")
add("G-08_invalid_slugs", lambda m: m.anchors.select("slug").distinct().join(m.anchors.where("ordinal > 0").select("slug"), "slug", "left_anti"), "SELECT DISTINCT slug FROM anchors WHERE slug NOT IN (SELECT slug FROM anchors WHERE ordinal > 0)")
add("H-24_typed_owner", lambda m: G.nearest_ancestor(m.nodes.where("kind <> 'doc_section'"), m.edges, "class").where("ancestor is not null").select("id", "ancestor"), "SELECT n.id, CASE WHEN n.kind = 'class' THEN n.id ELSE p.id END AS ancestor FROM nodes n LEFT JOIN (SELECT target, min(source) AS source FROM edges WHERE kind = 'contains' GROUP BY target) e ON n.id = e.target LEFT JOIN nodes p ON e.source = p.id AND p.kind = 'class' WHERE n.kind = 'class' OR p.id IS NOT NULL")
add("I-09_grep", lambda m: m.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").rlike("(?i)license")).orderBy("doc_id", "line").limit(200).select("doc_id", F.col("line").cast("bigint").alias("line"), "t"), "SELECT doc_id, i - 1 AS line, l[i] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(l[i], '(?i)license') ORDER BY 1, 2 LIMIT 200")
add(
    "L-01_max_cycles",
    lambda m: K.cycles(m.file_modules, m.imports).select(F.lit("max_cycles").alias("rule"), F.col("cycles").alias("value"), (F.col("cycles") > 0).alias("violated")),
    """WITH RECURSIVE r AS (SELECT source AS a, target AS b FROM imports UNION SELECT a, target FROM r JOIN imports ON b = source),
    scc AS (SELECT p.a AS id, min(p.b) AS scc FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY p.a)
    SELECT 'max_cycles' AS rule, count(*) AS value, count(*) > 0 AS violated FROM (SELECT scc FROM scc JOIN file_modules USING (id) GROUP BY scc HAVING count(*) > 1 AND count(DISTINCT module) > 1)""",
)
add("L-11_god_containers", lambda m: K.over(m.edges.where("kind = 'contains' and source > 2000000").groupBy("source").agg(F.count("*").alias("methods")), "no_god_containers", "source", "methods", 22), "SELECT 'no_god_containers' AS rule, CAST(source AS VARCHAR) AS subject, count(*) AS value FROM edges WHERE kind = 'contains' AND source > 2000000 GROUP BY source HAVING count(*) > 22")
add("L-27_derived_policy", lambda m: U.derived_edges(m.only("edges", "kind = 'references'"), m.edges.where("kind = 'references' and source % 5 = 0").withColumn("kind", F.lit("forbidden_dependency"))).groupBy("kind", "derived").agg(F.count("*").alias("n")), "SELECT 'references' AS kind, false AS derived, count(*) AS n FROM edges WHERE kind = 'references' UNION ALL SELECT 'forbidden_dependency', true, count(*) FROM edges WHERE kind = 'references' AND source % 5 = 0")
add(
    "M-01_incremental_mine",
    lambda m: (
        H.mined(m.commits.where("seq % 4 <> 0").select("sha", "committed_at"), m.commits.select("sha", "committed_at", "seq"), "seq", H.last_sha(m.commits.where("seq % 3 <> 0"), "seq"))
        .withColumn("mode", F.lit("continued"))
        .unionByName(H.mined(m.commits.where("seq % 4 <> 0").select("sha", "committed_at"), m.commits.where("seq % 2 = 0").select("sha", "committed_at", "seq"), "seq", "gone").withColumn("mode", F.lit("again")))
    ),
    """WITH c AS (SELECT max(seq) AS pos FROM commits WHERE seq % 3 <> 0) SELECT sha, committed_at, 'continued' AS mode FROM commits, c WHERE seq % 4 <> 0 OR seq > pos
    UNION ALL SELECT sha, committed_at, 'again' FROM commits WHERE seq % 2 = 0""",
)
add("N-01_ingest", lambda m: H.merged_hits(m.coverage_lines.join(m.coverage_files.where("content_hash <> 'old'").select(F.col("id").alias("file_id")), "file_id", "left_semi"), "second_report").groupBy("file_id").agg(F.count_if(F.col("hits") > 0).alias("covered")), "SELECT file_id, count(*) AS covered FROM (SELECT DISTINCT file_id, line_no FROM coverage_lines WHERE hits > 0 AND file_id IN (SELECT id FROM coverage_files WHERE content_hash <> 'old')) GROUP BY file_id")
add(
    "N-02_idempotent_ingest",
    lambda m: H.ingestible(m.coverage_files.select(F.md5("path").alias("report"), "path", "content_hash"), m.coverage_files.where("id % 3 = 0").select(F.md5("path").alias("report")), m.files)
    .select("report", "path"),
    """SELECT md5(v.path) AS report, v.path FROM coverage_files v JOIN files f ON v.path = f.path AND v.content_hash = f.content_hash WHERE v.id % 3 <> 0""",
)
add("P-02_module_keys", lambda m: m.paths().select(module_key(F.col("path")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("key not like '%/%'"), "SELECT regexp_replace(regexp_replace(regexp_replace(path, '^(.*/)?src/', ''), '\\.[^./]+$', ''), '(^|/)(mod|lib|main)$', '') AS key, count(*) AS n FROM files GROUP BY 1 HAVING key NOT LIKE '%/%'")
add("Q-10_topics_by_member", lambda m: m.usage.groupBy("surface", "tool").agg(F.count_if("ok").alias("produced"), F.count_if(~F.col("ok")).alias("consumed")), "SELECT surface, tool, count(*) FILTER (ok) AS produced, count(*) FILTER (NOT ok) AS consumed FROM usage GROUP BY ALL")
add("R-03_listing", lambda m: D.page_states(D.anchor_states(m.anchors, m.files.select(F.col("path").alias("entity_id"), "content_hash"))).orderBy("slug").select("slug", "state").limit(50), "SELECT slug, CASE WHEN bool_or(f.path IS NULL) THEN 'missing' WHEN bool_or(f.content_hash <> a.content_hash) THEN 'stale' ELSE 'fresh' END AS state FROM anchors a LEFT JOIN files f ON entity_id = path GROUP BY slug ORDER BY slug LIMIT 50")
add("T-05_reconcile", lambda m: U.synced(m.files.where("id % 2 = 0"), m.files).groupBy("change").agg(F.count("*").alias("n")), "SELECT 'added' AS change, count(*) AS n FROM files WHERE id % 2 = 1")
add("U-09_replace_violations", lambda m: K.over(m.functions, "max_cc", "name", "cc", 48).unionByName(K.over(m.functions, "max_nesting", "name", "nesting", 4)).groupBy("rule").agg(F.count("*").alias("n")), "SELECT * FROM (SELECT 'max_cc' AS rule, count(*) AS n FROM functions WHERE cc > 48 UNION ALL SELECT 'max_nesting', count(*) FROM functions WHERE nesting > 4) WHERE n > 0")
add(
    "U-10_metadata",
    lambda m: U.recorded(
        {"snapshots": m.snapshots.select(F.col("id").cast("string").alias("key"), F.col("signal").cast("string").alias("value")), "metadata": m.nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))},
        {
            "snapshots": m.snapshots.agg((F.max("id") + 1).cast("string").alias("key"), F.lit("1").alias("value")),
            "baseline": m.snapshots.agg(F.lit("signal").alias("key"), F.max("signal").cast("string").alias("value")),
            "rules_cache": m.region.select(F.concat(F.lit("rule "), F.col("r_name")).alias("key"), F.sha2("r_name", 256).alias("value")),
            "metadata": m.region.select(F.col("r_name").alias("key"), F.lit("region").alias("value")),
        },
    ),
    """SELECT 'snapshots' AS store, CAST(id AS VARCHAR) AS key, CAST(signal AS VARCHAR) AS value FROM snapshots UNION ALL SELECT 'snapshots', CAST(max(id) + 1 AS VARCHAR), '1' FROM snapshots
    UNION ALL SELECT 'baseline', 'signal', CAST(max(signal) AS VARCHAR) FROM snapshots UNION ALL SELECT 'rules_cache', 'rule ' || r_name, sha256(r_name) FROM region
    UNION ALL SELECT 'metadata', n_name, CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_name NOT IN (SELECT r_name FROM region) UNION ALL SELECT 'metadata', r_name, 'region' FROM region""",
)
add(
    "U-12_mine_persist",
    lambda m: U.persisted(
        m.commits.where("seq % 2 = 0").select("sha", "committed_at"), m.commits.where("seq % 3 = 0").select("sha", "committed_at"),
        m.file_changes.join(m.commits.where("seq % 2 = 0"), F.expr("sha = commit_sha"), "left_semi"), m.file_changes.join(m.commits.where("seq % 3 = 0"), F.expr("sha = commit_sha"), "left_semi"),
        H.last_sha(m.commits, "seq"),
    ),
    """WITH k AS (SELECT * FROM commits WHERE seq % 2 = 0 OR seq % 3 = 0) SELECT 'commits' AS name, CAST(count(*) AS VARCHAR) AS value FROM k
    UNION ALL SELECT 'changes', CAST(count(*) AS VARCHAR) FROM file_changes WHERE commit_sha IN (SELECT sha FROM k) UNION ALL SELECT 'cursor', arg_max(sha, seq) FROM commits""",
)
add("J-11_visual_layer", lambda m: m.nodes.groupBy(N.visual_layer(F.col("kind")).alias("layer")).agg(F.count("*").alias("n")), "SELECT CASE WHEN kind = 'doc_section' THEN 'doc' ELSE 'code' END AS layer, count(*) AS n FROM nodes GROUP BY 1")
