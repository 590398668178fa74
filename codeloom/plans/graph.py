"""Queries of graph views, reachability, components, cycles and depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.predicates import DOC_KINDS
from codeloom.operators import cycles as C
from codeloom.operators import graph as G
from codeloom.operators import quality as K
from codeloom.operators import relational as R
from codeloom.operators import resolution as Q
from codeloom.operators.traverse import reach
from codeloom.plans.registry import add

CALLS = "SELECT DISTINCT source, target FROM edges WHERE kind = 'calls'"
CODE = "SELECT id FROM nodes WHERE kind <> 'doc_section'"
VIEW = f"SELECT source, target, kind FROM edges WHERE kind NOT IN ('contains', 'accesses', 'implements', 'doc_reference') AND source IN ({CODE}) AND target IN ({CODE})"
IMPORTS = "SELECT source, target FROM imports"


def seed(m, *ids):
    return m.spark.createDataFrame([(i,) for i in ids], "id bigint")


def calls(m):
    return m.only("edges", "kind = 'calls'")


add("H-01_symbol_view", lambda m: G.symbol_view(m.nodes, m.edges)[1], VIEW)
add("H-02_full_symbol_view", lambda m: G.symbol_view(m.nodes, m.edges, True)[1].groupBy("kind").agg(F.count("*").alias("n")),
    f"SELECT kind, count(*) AS n FROM edges WHERE kind <> 'doc_reference' AND source IN ({CODE}) AND target IN ({CODE}) GROUP BY kind")
add("H-03_file_rollup", lambda m: G.rollup(G.symbol_view(m.nodes, m.edges)[1], m.nodes, G.file_label()),
    f"SELECT coalesce(a.file_path, '<unbound>') AS source, coalesce(b.file_path, '<unbound>') AS target, count(*) AS weight FROM ({VIEW}) e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE coalesce(a.file_path, '<unbound>') <> coalesce(b.file_path, '<unbound>') GROUP BY 1, 2")
add("H-04_nearest_module", lambda m: G.ancestors(m.nodes, m.only("edges", "kind = 'contains'"), "module", 10).select("id", "ancestor", F.col("depth").cast("bigint").alias("depth")),
    """WITH RECURSIVE parent AS (SELECT target AS child, min(source) AS parent FROM edges WHERE kind = 'contains' GROUP BY target),
    walk AS (SELECT id, id AS node, 0 AS depth FROM nodes UNION ALL SELECT w.id, p.parent, depth + 1 FROM walk w JOIN parent p ON w.node = p.child WHERE depth < 10),
    hit AS (SELECT w.id, node AS ancestor, depth FROM walk w JOIN nodes n ON w.node = n.id WHERE n.kind = 'module')
    SELECT n.id, h.ancestor, CAST(h.depth AS BIGINT) AS depth FROM nodes n LEFT JOIN hit h ON n.id = h.id""")
add("H-04_module_rollup", lambda m: G.rollup(G.symbol_view(m.nodes, m.edges)[1], G.owner_labels(m.nodes, m.edges, "module"), F.coalesce(F.col("ancestor").cast("string"), F.concat(F.lit("file:"), F.col("file_path")), F.lit("<unbound>"))),
    f"""WITH parent AS (SELECT target AS child, min(source) AS parent FROM edges WHERE kind = 'contains' GROUP BY target),
    lab AS (SELECT n.id, coalesce(CASE WHEN n.kind = 'module' THEN n.id WHEN p.kind = 'module' THEN p.id WHEN q.kind = 'module' THEN q.id END::VARCHAR, 'file:' || n.file_path, '<unbound>') AS label FROM nodes n
        LEFT JOIN parent a ON n.id = a.child LEFT JOIN nodes p ON a.parent = p.id LEFT JOIN parent b ON p.id = b.child LEFT JOIN nodes q ON b.parent = q.id)
    SELECT x.label AS source, y.label AS target, count(*) AS weight FROM ({VIEW}) e JOIN lab x ON e.source = x.id JOIN lab y ON e.target = y.id WHERE x.label <> y.label GROUP BY 1, 2""")
add("H-05_visual_view", lambda m: G.visual_view(m.nodes, m.edges)[1].groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY kind")
add("H-06_callers_page", lambda m: R.neighbours(m.edges, m.nodes, 77, False, ["calls"]).orderBy("id").limit(50).select("id", "symbol"), "SELECT DISTINCT n.id, symbol FROM edges e JOIN nodes n ON e.source = n.id WHERE e.target = 77 AND e.kind = 'calls' ORDER BY 1 LIMIT 50")
BFS = """SELECT id, CAST(min(d) AS BIGINT) AS distance FROM walk GROUP BY id"""
add("H-07_impact", lambda m: G.impact(m.adjacent("calls"), m.adjacent("called"), seed(m, 42), 2).select("id", F.col("distance").cast("bigint").alias("distance"), "side"),
    f"""WITH RECURSIVE step AS ({CALLS}), down AS (SELECT 42::BIGINT AS id, 0 AS d UNION SELECT target, d + 1 FROM down JOIN step ON id = source WHERE d < 2),
    up AS (SELECT 42::BIGINT AS id, 0 AS d UNION SELECT source, d + 1 FROM up JOIN step ON id = target WHERE d < 2)
    SELECT id, CAST(min(d) AS BIGINT) AS distance, 'downstream' AS side FROM down GROUP BY id HAVING min(d) > 0 UNION ALL SELECT id, CAST(min(d) AS BIGINT), 'upstream' FROM up GROUP BY id HAVING min(d) > 0""")
add("H-08_affected_files", lambda m: G.affected_files(G.rollup(m.only("edges", "kind = 'references'"), m.nodes, G.file_label()), m.spark.createDataFrame([("src/m3/s1.rs",)], "id string").union(m.nodes.where("id = 2000005").select("file_path"))),
    """WITH RECURSIVE fe AS (SELECT DISTINCT a.file_path AS source, b.file_path AS target FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE e.kind = 'references' AND a.file_path <> b.file_path),
    seeds AS (SELECT 'src/m3/s1.rs' AS id UNION SELECT file_path FROM nodes WHERE id = 2000005), walk AS (SELECT id FROM seeds UNION SELECT source FROM walk JOIN fe ON id = target) SELECT id FROM walk WHERE id NOT IN (SELECT id FROM seeds)""")
add(
    "H-09_undirected_reach",
    lambda m: reach(m.adjacent("imports_around"), seed(m, 3), 30).select("id", F.col("distance").cast("bigint").alias("distance")),
    f"WITH RECURSIVE e AS (SELECT source, target FROM imports UNION SELECT target, source FROM imports), walk AS (SELECT 3::BIGINT AS id, 0 AS d UNION SELECT e.target, d + 1 FROM walk JOIN e ON id = e.source WHERE d < 30) {BFS}",
)
add("H-11_explore", lambda m: reach(m.adjacent("around"), seed(m, 42), 1).join(m.nodes, "id").groupBy("file_path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("ids")),
    "SELECT file_path, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS ids FROM nodes WHERE id = 42 OR id IN (SELECT target FROM edges WHERE source = 42 UNION SELECT source FROM edges WHERE target = 42) GROUP BY file_path")
add("H-12_node_detail", lambda m: R.incident(m.edges, 2000003),
    "SELECT target AS id, kind AS edge_kind, 'out' AS side FROM edges WHERE source = 2000003 UNION SELECT source, kind, 'in' FROM edges WHERE target = 2000003")
add("H-13_canvas", lambda m: G.canvas(m.nodes, m.edges, 60)[0].select("id", "degree"),
    "SELECT n.id, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) d ON n.id = d.id ORDER BY 2 DESC, symbol LIMIT 60")
add("H-13_canvas_edges", lambda m: G.canvas(m.nodes, m.edges, 60)[1],
    "WITH top AS (SELECT n.id FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) d ON n.id = d.id ORDER BY coalesce(degree, 0) DESC, symbol LIMIT 60) SELECT source, target, kind FROM edges WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top)")
add("H-14_intent_overlay", lambda m: m.only("edges", "kind = 'doc_reference'").join(m.nodes.where(F.col("kind").isin(*DOC_KINDS)), F.expr("source = id"), "left_semi").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("anchors")).orderBy(F.desc("anchors"), "id").limit(60),
    "SELECT source AS id, count(*) AS anchors FROM edges WHERE kind = 'doc_reference' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
add("H-15_degree", lambda m: G.degrees(m.edges), "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
SCC = f"""WITH RECURSIVE e AS ({IMPORTS}), r AS (SELECT source AS a, target AS b FROM e UNION SELECT a, target FROM r JOIN e ON b = source), v AS (SELECT source AS id FROM imports UNION SELECT target FROM imports)
    , scc AS (SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS scc FROM v LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON v.id = x.a GROUP BY v.id)"""
add("H-16_strong_components", lambda m: C.strong_components(m.imports), f"{SCC} SELECT id, scc FROM scc")
add("H-16_call_cycles", lambda m: C.strong_components(m.only("edges", "kind = 'references'")).groupBy("scc").agg(F.count("*").alias("size")),
    """WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'references' AND source <> target), r AS (SELECT source AS a, target AS b FROM e UNION SELECT a, target FROM r JOIN e ON b = source),
    v AS (SELECT source AS id FROM edges WHERE kind = 'references' UNION SELECT target FROM edges WHERE kind = 'references'),
    scc AS (SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS scc FROM v LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON v.id = x.a GROUP BY v.id) SELECT scc, count(*) AS size FROM scc GROUP BY scc""")
add(
    "H-17_acyclicity",
    lambda m: C.strong_components(m.imports).join(m.file_modules, "id").groupBy("scc").agg(F.count("*").alias("n"), F.countDistinct("module").alias("d"))
    .where("n > 1 and d > 1").agg(F.count("*").alias("cycles"), F.round(1 / (1 + F.count("*")), 6).alias("normalized")),
    f"""{SCC}, big AS (SELECT scc FROM scc JOIN file_modules USING (id) GROUP BY scc HAVING count(*) > 1 AND count(DISTINCT module) > 1)
    SELECT count(*) AS cycles, round(1 / (1 + count(*)), 6) AS normalized FROM big""",
)
add(
    "H-18_depth",
    lambda m: m.spark.createDataFrame([(C.longest_path(m.functions, m.imports),)], "depth bigint"),
    f"""{SCC}, d AS (SELECT DISTINCT a.scc AS s, b.scc AS t FROM imports JOIN scc a ON source = a.id JOIN scc b ON target = b.id WHERE a.scc <> b.scc),
    p AS (SELECT t, 2 AS n FROM d UNION SELECT d.t, n + 1 FROM p JOIN d ON p.t = d.s) SELECT CAST(coalesce(max(n), 1) AS BIGINT) AS depth FROM p""",
)
add(
    "H-19_modularity",
    lambda m: K.modularity(m.file_modules, calls(m).select("source", "target")).select(F.round("q", 6).alias("q")),
    """WITH e AS (SELECT a.module AS s, b.module AS t FROM edges JOIN file_modules a ON source = a.id JOIN file_modules b ON target = b.id WHERE kind = 'calls'),
    m AS (SELECT count(*)::DOUBLE AS m FROM e), d AS (SELECT DISTINCT module AS d FROM file_modules)
    SELECT round(sum((SELECT count(*) FROM e WHERE s = d AND t = d) / m - (((SELECT count(*) FROM e WHERE s = d) + (SELECT count(*) FROM e WHERE t = d)) / (2 * m)) ** 2), 6) AS q FROM d, m""",
)
add(
    "H-20_dead_code",
    lambda m: G.dead(m.nodes, m.edges, G.is_root(("fn7", "main")), F.col("kind").isin("function", "method")),
    """WITH RECURSIVE live AS (SELECT id FROM nodes WHERE exported OR is_test OR kind = 'route' OR name IN ('fn7', 'main')
    UNION SELECT target FROM live JOIN edges ON id = source WHERE kind = 'calls')
    SELECT id, CASE WHEN kind IN ('function', 'method') THEN id NOT IN (SELECT id FROM live) END AS is_dead FROM nodes""",
)
add("H-21_test_reach", lambda m: reach(m.adjacent("calls"), m.nodes.where("is_test and kind in ('function', 'method')")).select("id"),
    "WITH RECURSIVE t AS (SELECT id FROM nodes WHERE is_test AND kind IN ('function', 'method') UNION SELECT target FROM t JOIN edges ON id = source WHERE kind = 'calls') SELECT id FROM t")
add(
    "H-22_components",
    lambda m: C.components(m.nodes.where("kind in ('function', 'method', 'field')"), m.only("edges", "kind = 'accesses'")),
    """WITH l AS (SELECT source, target FROM edges WHERE kind = 'accesses'), f AS (SELECT target, least(target, min(source)) AS c FROM l GROUP BY target)
    SELECT n.id, coalesce(f.c, g.c, n.id) AS component FROM nodes n LEFT JOIN f ON n.id = f.target LEFT JOIN l ON n.id = l.source LEFT JOIN f g ON l.target = g.target
    WHERE n.kind IN ('function', 'method', 'field')""",
)
add(
    "H-26_dsm",
    lambda m: G.matrix(G.rollup(m.imports, m.file_modules, F.concat(F.lit("m"), F.col("module").cast("string"))), [f"m{i}" for i in range(25)]),
    "SELECT 'm' || a.module AS source, " + ", ".join(f"count(*) FILTER (b.module = {i} AND a.module <> {i}) AS m{i}" for i in range(25))
    + " FROM imports JOIN file_modules a ON source = a.id JOIN file_modules b ON target = b.id GROUP BY a.module HAVING count(*) FILTER (a.module <> b.module) > 0",
)
add(
    "H-27_back_edges",
    lambda m: G.rollup(m.imports, m.file_modules, F.col("module")).where("source < target"),
    "SELECT a.module AS source, b.module AS target, count(*) AS weight FROM imports JOIN file_modules a ON source = a.id JOIN file_modules b ON target = b.id WHERE a.module < b.module GROUP BY ALL",
)
add(
    "H-28_service_map",
    lambda m: Q.service_map(m.providers.select("member"), Q.bridge_exact(m.providers, m.consumers), m.usage.select(F.col("tool").alias("topic"), F.col("surface").alias("member"))),
    """WITH sole AS (SELECT key, min(member) AS pm FROM providers GROUP BY key HAVING count(*) = 1), b AS (SELECT member, pm FROM consumers JOIN sole USING (key) WHERE member <> pm),
    n AS (SELECT DISTINCT member AS node, 'member' AS kind FROM providers UNION SELECT DISTINCT tool, 'topic' FROM usage UNION SELECT DISTINCT surface, 'member' FROM usage),
    l AS (SELECT member AS source, pm AS target, count(*) AS weight FROM b GROUP BY ALL UNION ALL SELECT surface, tool, count(*) FROM usage GROUP BY ALL)
    SELECT node, kind, coalesce(o.n, 0) AS links_out, coalesce(i.n, 0) AS links_in FROM n LEFT JOIN (SELECT source, count(*) AS n FROM l GROUP BY source) o ON node = o.source
    LEFT JOIN (SELECT target, count(*) AS n FROM l GROUP BY target) i ON node = i.target""",
)
add(
    "H-20_dead_code_sparse",  # over imports, where much is not reached
    lambda m: G.dead(m.functions, m.imports.withColumn("kind", F.lit("calls")), F.col("is_test"), F.lit(True)),
    """WITH RECURSIVE live AS (SELECT id FROM functions WHERE is_test UNION SELECT target FROM live JOIN imports ON id = source)
    SELECT id, id NOT IN (SELECT id FROM live) AS is_dead FROM functions""",
)
