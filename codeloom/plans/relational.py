"""Queries of scans, predicates, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions import scalars as S
from codeloom.operators import relational as R
from codeloom.operators.globs import first_globs
from codeloom.plans.registry import add

NODE = "id, symbol, kind, name, file_path"
LAYERS = [("core", ["src/m[0-5]/**"]), ("low", ["src/m1?/**", "src/m?/**"]), ("high", ["src/**"])]
CALLABLE = "kind IN ('function', 'method')"

# Scans
add("A-01_node_scan", lambda m: R.with_file(m.nodes, m.files).select("id", "symbol", "kind", "name", "file_path", "file_id").orderBy("id"),
    "SELECT n.id, symbol, kind, name, file_path, f.id AS file_id FROM nodes n LEFT JOIN files f ON n.file_path = f.path")
add("A-02_edge_scan", lambda m: m.edges.orderBy("source", "target", "kind"), "SELECT source, target, kind FROM edges")
add("A-03_file_scan", lambda m: m.files.orderBy("path"), "SELECT id, path, content_hash, language FROM files")
add("A-04_ref_scan", lambda m: m.refs.orderBy("id"), "SELECT id, source_symbol, target, kind, payload FROM refs")
add("A-05_annotation_scan", lambda m: R.with_file(m.nodes, m.files).select("id", "kind", "exported", "is_test", "is_dead", "fingerprint", "file_id"),
    "SELECT n.id, kind, exported, is_test, is_dead, fingerprint, f.id AS file_id FROM nodes n LEFT JOIN files f ON n.file_path = f.path")
add("A-07_function_metrics", lambda m: R.function_metrics(m.functions).select("id", "cc", "is_dead", "is_duplicate", "line_count", "nesting", "clone_group"),
    f"SELECT id, cc, is_dead, is_duplicate, line_count, nesting, clone_group FROM functions WHERE {CALLABLE}")
add("A-08_function_constraints", lambda m: R.function_metrics(m.functions).select("name", "file_path", "cc", "line_count"),
    f"SELECT name, file_path, cc, line_count FROM functions WHERE {CALLABLE}")
add("A-09_broker_subgraph", lambda m: m.nodes.where(F.col("kind").isin(*P.BROKER_KINDS)).select("id", "symbol", "kind"),
    "SELECT id, symbol, kind FROM nodes WHERE kind IN ('topic', 'producer', 'consumer')")
add("A-10_existence", lambda m: m.nodes.agg(F.coalesce(F.bool_or(F.col("kind") == "route"), F.lit(False)).alias("has_routes"), F.coalesce(F.bool_or(F.col("kind").isin(*P.BROKER_KINDS)), F.lit(False)).alias("has_broker")),
    "SELECT coalesce(bool_or(kind = 'route'), false) AS has_routes, coalesce(bool_or(kind IN ('topic', 'producer', 'consumer')), false) AS has_broker FROM nodes")
add("A-11_point_lookup", lambda m: R.by_symbol(m.nodes, "fn/fn42").select("id", "symbol", "name").union(m.nodes.where("name = 'fn43'").select("id", "symbol", "name")),
    "SELECT id, symbol, name FROM nodes WHERE symbol = 'fn/fn42' OR name = 'fn43'")
add("A-11_names_for_path", lambda m: m.nodes.where("file_path = 'src/m3/f3.rs'").select("name").orderBy("name"), "SELECT name FROM nodes WHERE file_path = 'src/m3/f3.rs'")

# Predicates
add("B-01_kind_filter", lambda m: R.of_kind(m.nodes, "class").select("id", "name"), "SELECT id, name FROM nodes WHERE kind = 'class'")
add("B-02_code_only", lambda m: m.nodes.where(P.is_code(F.col("kind"))).select("id", "kind"), "SELECT id, kind FROM nodes WHERE kind <> 'doc_section'")
add("B-05_test_path", lambda m: m.paths().select("path", P.is_test_path(F.replace("path", F.lit("/m1"), F.lit("/tests/m1"))).alias("is_test_path")),
    "SELECT path, path LIKE 'src/m1%' AS is_test_path FROM files")
add("B-06_test_marker", lambda m: m.nodes.select("id", P.is_test_marked(F.col("is_test"), F.col("file_path"), F.concat(F.col("kind"), F.lit("_"), F.col("name")), ("function",)).alias("marked")),
    "SELECT id, is_test OR kind = 'function' AS marked FROM nodes")
add("B-07_glob", lambda m: m.paths().where(P.matches_glob(F.col("path"), "src/m?/f*.rs")).select("path"), "SELECT path FROM files WHERE regexp_matches(path, '^src/m[^/]/f[^/]*\\.rs$')")
add("B-08_first_glob", lambda m: first_globs(m.files, [("one", ["src/m1/**"]), ("teens", ["src/m1?/**"]), ("source", ["src/**"])]),
    "SELECT path, CASE WHEN path LIKE 'src/m1/%' THEN 'one' WHEN regexp_matches(path, '^src/m1[^/]/') THEN 'teens' WHEN path LIKE 'src/%' THEN 'source' END AS layer FROM files")
add("B-09_substring", lambda m: m.nodes.where(F.contains("name", F.lit("n1_"))).select("id").union(m.nodes.where(F.contains("name", F.lit("fn19"))).select("id")),
    "SELECT id FROM nodes WHERE contains(name, 'n1_') UNION ALL SELECT id FROM nodes WHERE contains(name, 'fn19')")
add("B-10_pool_filter", lambda m: m.nodes.where(F.contains("name", F.lit("fn1"))).orderBy("id").limit(200).where(F.contains("file_path", F.lit("/m1"))).orderBy("id").limit(50).select("id", "name"),
    "SELECT id, name FROM (SELECT * FROM nodes WHERE contains(name, 'fn1') ORDER BY id LIMIT 200) WHERE contains(file_path, '/m1') ORDER BY id LIMIT 50")
add("B-11_endpoint_kind", lambda m: R.neighbours(m.edges, m.nodes, 71, False).where(F.col("kind").isin(*P.DOC_KINDS)).select("id", "edge_kind"),
    "SELECT DISTINCT n.id, e.kind AS edge_kind FROM edges e JOIN nodes n ON e.source = n.id WHERE e.target = 71 AND n.kind = 'doc_section'")
add("B-13_external_target", lambda m: m.pages.select("page_id", P.is_external(F.col("url")).alias("external")), "SELECT page_id, regexp_matches(url, '^(https?:|git@|//|\\$)|^google/protobuf/') AS external FROM pages")
add("B-14_reachability_extension", lambda m: m.paths().select("path", P.has_extension(F.col("path"), ("rs",)).alias("capable")), "SELECT path, path LIKE '%.rs' AS capable FROM files")
add("B-15_admission", lambda m: m.paths().where(P.is_admitted(F.col("path"), F.lit(100), ["src/**"], ["src/m2/**"])).select("path"), "SELECT path FROM files WHERE path LIKE 'src/%' AND path NOT LIKE 'src/m2/%'")
add("B-16_mega_commit_cap", lambda m: m.commits.where("file_count <= 5").select("sha", "file_count"), "SELECT sha, file_count FROM commits WHERE file_count <= 5")

# Joins
add("C-02_callers", lambda m: R.neighbours(m.edges, m.nodes, 42, False, ["calls"]).select("id", "symbol").orderBy("id"),
    "SELECT DISTINCT n.id, symbol FROM edges e JOIN nodes n ON e.source = n.id WHERE e.target = 42 AND e.kind = 'calls'")
add("C-03_callees", lambda m: R.neighbours(m.edges, m.nodes, 42, True, ["calls"]).select("id", "symbol").orderBy("id"),
    "SELECT DISTINCT n.id, symbol FROM edges e JOIN nodes n ON e.target = n.id WHERE e.source = 42 AND e.kind = 'calls'")
add("C-04_neighbours", lambda m: R.neighbours(m.edges, m.nodes, 42, True).select("id", "edge_kind", F.lit("out").alias("side")).union(R.neighbours(m.edges, m.nodes, 42, False).select("id", "edge_kind", F.lit("in"))),
    "SELECT target AS id, kind AS edge_kind, 'out' AS side FROM edges WHERE source = 42 AND target IN (SELECT id FROM nodes) UNION SELECT source, kind, 'in' FROM edges WHERE target = 42 AND source IN (SELECT id FROM nodes)")
add("C-05_cross_file_edges", lambda m: R.cross_file_edges(m.edges, m.nodes).groupBy("kind").agg(F.count("*").alias("n")),
    "SELECT e.kind, count(*) AS n FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE s.file_path <> t.file_path GROUP BY e.kind")
add("C-07_language_join", lambda m: R.language_composition(m.nodes, m.files), "SELECT language, count(n.id) AS nodes, count(DISTINCT f.id) AS files FROM nodes n JOIN files f ON n.file_path = f.path GROUP BY language")
add("C-08_baseline", lambda m: m.snapshots.where("id = 3").select(F.col("id").alias("baseline"), "signal", "nodes"), "SELECT id AS baseline, signal, nodes FROM snapshots WHERE id = 3")
add("C-09_orphan_edges", lambda m: R.orphans(m.edges, m.nodes.where("id % 50 <> 0"), "target"), "SELECT target, source, kind FROM edges WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id = target AND id % 50 <> 0)")
add("C-10_changes_in_window", lambda m: m.file_changes.join(m.commits.join(F.broadcast(m.head), how="cross").where("committed_at >= head_at - 31536000"), F.expr("sha = commit_sha")).groupBy("path").agg(F.count("*").alias("n")),
    "SELECT path, count(*) AS n FROM file_changes JOIN commits ON sha = commit_sha, head WHERE committed_at >= head_at - 31536000 GROUP BY path")
add("C-12_not_test_only", lambda m: m.functions.where("not is_test").select("file_path").distinct(), "SELECT DISTINCT file_path FROM functions WHERE NOT is_test")
add(
    "C-13_cochange_pairs",
    lambda m: R.pairs_within(m.file_changes.join(m.commits.where("file_count <= 50"), F.expr("sha = commit_sha"), "left_semi"), "commit_sha", "path")
    .groupBy("a", "b").agg(F.count("*").alias("support")),
    """SELECT x.path AS a, y.path AS b, count(*) AS support FROM file_changes x JOIN file_changes y ON x.commit_sha = y.commit_sha AND x.path <> y.path
    JOIN commits ON sha = x.commit_sha WHERE file_count <= 50 GROUP BY ALL""",
)
def layered(m):
    """Imports with the layers of both ends."""
    s = m.file_modules.select(F.col("id").alias("source"), F.col("layer").alias("from_layer"), F.col("module").alias("a"))
    t = m.file_modules.select(F.col("id").alias("target"), F.col("layer").alias("to_layer"), F.col("module").alias("b"))
    return m.imports.join(s, "source").join(t, "target")


LAYERED = "SELECT i.source, i.target, a.layer AS from_layer, b.layer AS to_layer, a.module AS a, b.module AS b FROM imports i JOIN file_modules a ON i.source = a.id JOIN file_modules b ON i.target = b.id"
add(
    "C-15_layer_boundaries",
    lambda m: layered(m).where("from_layer = 0 and to_layer = 1 or from_layer = 2 and to_layer = 3 or from_layer = 4 and to_layer = 0").select("source", "target", "from_layer", "to_layer"),
    f"SELECT source, target, from_layer, to_layer FROM ({LAYERED}) WHERE (from_layer, to_layer) IN ((0, 1), (2, 3), (4, 0))",
)

# Aggregates
add("D-01_store_counts", lambda m: m.nodes.agg(F.count("*").alias("nodes")).join(m.edges.agg(F.count("*").alias("edges"))).join(m.files.agg(F.count("*").alias("files"))).join(m.refs.agg(F.count("*").alias("refs"), F.count("payload").alias("with_payload"))),
    "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM refs) AS refs, (SELECT count(payload) FROM refs) AS with_payload")
add("D-02_language_composition", lambda m: R.language_composition(m.nodes.where("kind <> 'field'"), m.files), "SELECT language, count(n.id) AS nodes, count(DISTINCT f.id) AS files FROM nodes n JOIN files f ON n.file_path = f.path WHERE kind <> 'field' GROUP BY language")
add("D-03_symbol_integrity", lambda m: m.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("symbol").alias("symbols")), "SELECT count(*) AS nodes, count(DISTINCT symbol) AS symbols FROM nodes")
add("D-04_complexity_by_file", lambda m: m.functions.where("cc is not null").groupBy("file_path").agg(F.sum("cc").alias("cc")), "SELECT file_path, CAST(sum(cc) AS BIGINT) AS cc FROM functions WHERE cc IS NOT NULL GROUP BY file_path")
add("D-05_has_production", lambda m: m.nodes.where("file_path is not null").groupBy("file_path").agg(F.bool_or(~F.col("is_test")).alias("has_production")), "SELECT file_path, bool_or(NOT is_test) AS has_production FROM nodes WHERE file_path IS NOT NULL GROUP BY file_path")
add("D-12_duplicate_groups", lambda m: m.functions.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n >= 2"), "SELECT fingerprint, count(*) AS n FROM functions GROUP BY fingerprint HAVING count(*) >= 2")
add(
    "D-14_rollup_weight",
    lambda m: layered(m).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("weight")),
    f"SELECT a, b, count(*) AS weight FROM ({LAYERED}) WHERE a <> b GROUP BY a, b",
)
add("D-17_ratio", lambda m: m.functions.agg(S.basis_points(F.avg((F.col("nesting") >= 4).cast("double"))).alias("deep_bp")), "SELECT CAST(round(avg(CAST(nesting >= 4 AS DOUBLE)) * 10000) AS BIGINT) AS deep_bp FROM functions")
add("D-19_fan_in", lambda m: m.only("edges", "kind = 'calls'").groupBy("target").agg(F.countDistinct("source").alias("fan_in")), "SELECT target, count(DISTINCT source) AS fan_in FROM edges WHERE kind = 'calls' GROUP BY target")
add("D-20_symbols_per_file", lambda m: m.nodes.where(P.is_code(F.col("kind")) & F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count("*").alias("n")).where("n > 1"), "SELECT file_path, count(*) AS n FROM nodes WHERE kind <> 'doc_section' AND file_path IS NOT NULL GROUP BY file_path HAVING count(*) > 1")
add("D-34_distinct", lambda m: m.nodes.select("kind").distinct(), "SELECT DISTINCT kind FROM nodes")
add("D-35_next_turn", lambda m: m.conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn")), "SELECT conv_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id")

# Windows
add("E-01_rank", lambda m: R.ranks_over_values(m.functions.where("cc is not null").select("id", "cc"), "cc", "rank"), "SELECT id, cc, rank() OVER (ORDER BY cc) AS rank FROM functions WHERE cc IS NOT NULL")
add("E-02_lag", lambda m: R.with_delta(m.snapshots, "id", "signal", "delta").select("id", "signal", "delta"), "SELECT id, signal, signal - lag(signal) OVER (ORDER BY id) AS delta FROM snapshots")
add("E-04_survivor", lambda m: R.survivors(m.functions, "fingerprint"), "SELECT id, min(id) OVER (PARTITION BY fingerprint) AS survivor FROM functions")
add("E-05_latest", lambda m: R.latest(m.usage.select("tool", "happened_at", "duration_ms").groupBy("tool", "happened_at").agg(F.max("duration_ms").alias("duration_ms")), ["tool"], "happened_at"), "SELECT tool, happened_at, duration_ms FROM (SELECT tool, happened_at, max(duration_ms) AS duration_ms, row_number() OVER (PARTITION BY tool ORDER BY happened_at DESC) AS r FROM usage GROUP BY tool, happened_at) WHERE r = 1")
add("E-06_sibling_ordinal", lambda m: m.functions.select("id", R.sibling_ordinals(m.functions, ["fingerprint"], "id").cast("bigint").alias("ordinal")), "SELECT id, row_number() OVER (PARTITION BY fingerprint ORDER BY id) - 1 AS ordinal FROM functions")
add(
    "E-07_kgrams",
    lambda m: m.documents.select("doc_id", F.split(F.lower("text"), " ").alias("w")).where("size(w) >= 5")
    .select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))))
    .select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("gram")),
    """SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i
    FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents) WHERE len(w) >= 5)""",
)
add("E-09_position_score", lambda m: m.nodes.where("kind = 'class'").orderBy("id").limit(20).select("id", (1 / (1.0 + F.row_number().over(R.Window.orderBy("id")) - 1)).alias("score")), "SELECT id, 1.0::DOUBLE / row_number() OVER (ORDER BY id) AS score FROM (SELECT id FROM nodes WHERE kind = 'class' ORDER BY id LIMIT 20)")
add("E-10_bucketed_top", lambda m: R.top_per(m.nodes, ["kind"], [F.col("id")], 8).select("kind", "id"), "SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS r FROM nodes) WHERE r <= 8")

# Sorts and limits
add("F-03_adjacency_page", lambda m: R.neighbours(m.edges, m.nodes, 2000001, True).orderBy("id", "edge_kind").limit(50).select("id", "edge_kind"), "SELECT DISTINCT target AS id, kind AS edge_kind FROM edges WHERE source = 2000001 AND target IN (SELECT id FROM nodes) ORDER BY 1, 2 LIMIT 50")
add("F-07_top_churn", lambda m: m.file_changes.groupBy("path").agg(F.count("*").alias("churn")).orderBy(F.desc("churn"), "path").limit(20), "SELECT path, count(*) AS churn FROM file_changes GROUP BY path ORDER BY 2 DESC, 1 LIMIT 20")
add("F-09_last_n", lambda m: m.snapshots.orderBy(F.desc("id")).limit(30).orderBy("id").select("id", "signal"), "SELECT id, signal FROM snapshots ORDER BY id DESC LIMIT 30")
add("F-13_first_five", lambda m: m.files.where("language = 'markdown'").agg(F.array_sort(F.collect_list("path")).alias("p")).select(F.concat(F.array_join(F.slice("p", 1, 5), ", "), F.lit(" … "), (F.size("p") - 5).cast("string"), F.lit(" more")).alias("line")),
    "SELECT array_to_string(p[1:5], ', ') || ' … ' || (len(p) - 5) || ' more' AS line FROM (SELECT list_sort(list(path)) AS p FROM files WHERE language = 'markdown')")
add("F-14_recent_threads", lambda m: m.conversations.groupBy("conv_id").agg(F.max("turn").alias("last")).orderBy(F.desc("last"), F.desc("conv_id")).limit(20), "SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id ORDER BY 2 DESC, 1 DESC LIMIT 20")

# Sets
add("G-01_symmetric_difference", lambda m: R.symmetric_difference(m.functions.where("id % 3 <> 0").select("name"), m.functions.where("id % 5 <> 0").select("name")),
    "SELECT name, 'leaked' AS side FROM functions WHERE id % 3 <> 0 AND id % 5 = 0 UNION ALL SELECT name, 'orphaned' FROM functions WHERE id % 5 <> 0 AND id % 3 = 0")
add("G-03_marker_reconcile", lambda m: R.symmetric_difference(m.functions.where("exported").select("id"), m.functions.where("is_test").select("id"), ("add", "remove")),
    "SELECT id, CASE WHEN exported THEN 'add' ELSE 'remove' END AS side FROM functions WHERE exported <> is_test")
add("G-04_promotion_reconcile", lambda m: m.functions.where("exported").select("id").intersect(m.functions.where("is_duplicate").select("id")), "SELECT id FROM functions WHERE exported AND is_duplicate")
add("G-05_purge", lambda m: m.files.select("path").join(m.files.where(~P.matches_glob(F.col("path"), "docs/**")).select("path"), "path", "left_anti"), "SELECT path FROM files WHERE path LIKE 'docs/%'")
add("G-06_union_distinct", lambda m: m.only("edges", "kind = 'calls'").select("source", "target").union(m.only("edges", "kind = 'references'").select("source", "target")).distinct(), "SELECT source, target FROM edges WHERE kind = 'calls' UNION SELECT source, target FROM edges WHERE kind = 'references'")
add("G-09_insert_absent", lambda m: R.insert_absent(m.functions.where("id % 2 = 0").select("id", "name"), m.functions.select("id", "name"), ["id"]), "SELECT id, name FROM functions")

# Scalars
add("J-01_directory", lambda m: m.nodes.select("id", S.directory(F.col("file_path")).alias("directory")), "SELECT id, CASE WHEN file_path IS NULL THEN '<unbound>' ELSE regexp_replace(file_path, '/[^/]*$', '') END AS directory FROM nodes")
add("J-02_percent_points", lambda m: m.functions.select("id", S.percent_points(F.col("nesting"), F.col("line_count") - 60).alias("bp")), "SELECT id, CASE WHEN line_count > 60 THEN (nesting * 20000 + (line_count - 60)) // ((line_count - 60) * 2) END AS bp FROM functions")
add(
    "J-03_slug",
    lambda m: m.pages.select("page_id", S.slug(F.col("url")).alias("slug")),
    "SELECT page_id, replace(regexp_replace(lower(trim(url)), '[^a-z0-9 _-]', '', 'g'), ' ', '-') AS slug FROM pages",
)
add("J-04_identifier_tokens", lambda m: m.pages.select("page_id", F.array_join(S.identifier_tokens(F.col("url")), "|").alias("tokens")), "SELECT page_id, array_to_string(regexp_extract_all(url, '[A-Za-z0-9_]+'), '|') AS tokens FROM pages")
add("J-05_route_key", lambda m: m.part.select("p_partkey", S.route_key(F.concat(F.lit("get /p/{id"), (F.col("p_partkey") % 3).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "}/*").otherwise("}/x/")))
    .alias("key")), "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'GET /p/{}/x' END AS key FROM part")
add("J-06_grpc_key", lambda m: m.part.select("p_partkey", S.grpc_key(F.lit("shop.v1"), F.regexp_replace("p_brand", "#", ""), F.when(F.col("p_size") % 2 == 0, "Get").otherwise("1bad")).alias("key")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND regexp_matches(replace(p_brand, '#', ''), '^[A-Za-z_]\\w*$') THEN 'shop.v1.' || replace(p_brand, '#', '') || '/Get' END AS key FROM part")
add("J-07_escaped_name", lambda m: m.part.select("p_partkey", S.escaped_name(F.col("p_name")).alias("name")), "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[A-Za-z0-9_+$-]+$') THEN p_name ELSE '`' || replace(p_name, '`', '``') || '`' END AS name FROM part")
add("J-08_short_title", lambda m: m.conversations.where("turn = 0").select("conv_id", S.short_title(F.col("text")).alias("title")), "SELECT conv_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title FROM (SELECT conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE turn = 0)")
add("J-09_module_key", lambda m: m.paths().select("path", S.module_key(F.col("path")).alias("key")), "SELECT path, regexp_replace(regexp_replace(regexp_replace(path, '^(.*/)?src/', ''), '\\.[^./]+$', ''), '(^|/)(mod|lib|main)$', '') AS key FROM files")
add("J-10_folded_path", lambda m: m.part.select("p_partkey", S.folded_path(F.concat(F.lit("a/./b/../"), F.when(F.col("p_size") % 2 == 0, "c").otherwise("../../d"))).alias("path")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a/c' END AS path FROM part")
add(
    "B-07_brace_globs",
    lambda m: m.paths().select("path", P.matches_glob(F.col("path"), "src/m[0-4]/{f,s}*[!13579].rs").alias("hit")),
    "SELECT path, regexp_matches(path, '^src/m[0-4]/[fs][^/]*[^13579]\\.rs$') AS hit FROM files",
)
IGNORE = ["# comment", "m1/", "*2.rs", "!/src/m3/f*2.rs", "/docs", "src/m4/**/f9.rs"]
add(
    "B-15_ignore_file",
    lambda m: m.paths().where(~P.ignored(F.col("path"), IGNORE)),
    """SELECT path FROM files WHERE NOT (regexp_matches(path, '(^|/)m1/') OR (regexp_matches(path, '2\\.rs$') AND NOT regexp_matches(path, '^src/m3/f[^/]*2\\.rs$'))
    OR path LIKE 'docs/%' OR regexp_matches(path, '^src/m4/(.*/)?f9\\.rs$'))""",
)
