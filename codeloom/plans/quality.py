"""Queries of metrics and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.scalars import basis_points
from codeloom.operators import quality as K
from codeloom.operators import relational as R
from codeloom.operators import rules as L
from codeloom.operators.globs import paired
from codeloom.plans.registry import add

PROD = "SELECT * FROM functions WHERE NOT is_test"
FILES = "SELECT DISTINCT a.file_path AS source, b.file_path AS target, a.layer AS so, b.layer AS t_o FROM imports JOIN file_modules a ON source = a.id JOIN file_modules b ON target = b.id"


def prod(m):
    return m.functions.where("not is_test")


def six(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def files(m):
    """Imports between files, and the layer of each file."""
    of = m.file_modules.select("id", F.col("file_path").alias("file"), F.col("layer").alias("order"))
    s, t = of.select(F.col("id").alias("source"), F.col("file").alias("a")), of.select(F.col("id").alias("target"), F.col("file").alias("b"))
    return m.imports.join(s, "source").join(t, "target").select(F.col("a").alias("source"), F.col("b").alias("target")), of


def undocumented(m, functions):
    return K.undocumented(functions, m.only("edges", "kind = 'doc_reference'"), m.only("nodes", "kind = 'doc_section'"))


def classes(m):
    return K.lcom4(m.nodes.where("kind = 'class'"), m.edges, m.functions.where("not is_test"))


LCOM = """WITH RECURSIVE own AS (SELECT source AS class, target AS id FROM edges JOIN nodes n ON source = n.id AND n.kind = 'class' JOIN functions f ON target = f.id AND NOT f.is_test WHERE edges.kind = 'contains'),
    u AS (SELECT own.class, own.id, target AS field FROM edges JOIN own ON source = own.id WHERE kind = 'accesses'),
    l AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.class = b.class AND a.field = b.field UNION SELECT x.id, y.id FROM edges e JOIN own x ON e.source = x.id JOIN own y ON e.target = y.id AND x.class = y.class WHERE e.kind = 'calls'
        UNION SELECT y.id, x.id FROM edges e JOIN own x ON e.source = x.id JOIN own y ON e.target = y.id AND x.class = y.class WHERE e.kind = 'calls'),
    r AS (SELECT id, id AS c FROM own UNION SELECT l.b, c FROM r JOIN l ON r.id = l.a), g AS (SELECT id, min(c) AS c FROM r GROUP BY id),
    lc AS (SELECT class, count(*) AS methods, count(DISTINCT c) AS lcom4 FROM own JOIN g USING (id) GROUP BY class)"""

add(
    "K-01_modularity",
    lambda m: six(K.modularity(m.file_modules, m.imports), "q", "normalized"),
    """WITH e AS (SELECT a.module AS s, b.module AS t FROM imports JOIN file_modules a ON source = a.id JOIN file_modules b ON target = b.id), m AS (SELECT count(*)::DOUBLE AS m FROM e),
    d AS (SELECT DISTINCT module AS d FROM file_modules),
    q AS (SELECT sum((SELECT count(*) FROM e WHERE s = d AND t = d) / m - (((SELECT count(*) FROM e WHERE s = d) + (SELECT count(*) FROM e WHERE t = d)) / (2 * m)) ** 2) AS q FROM d, m)
    SELECT round(q, 6) AS q, round(greatest(0, least(1, (q + 0.5) / 1.5)), 6) AS normalized FROM q""",
)
CYCLES = """WITH RECURSIVE e AS (SELECT source, target FROM imports), r AS (SELECT source AS a, target AS b FROM e UNION SELECT a, target FROM r JOIN e ON b = source),
    scc AS (SELECT p.a AS id, min(p.b) AS scc FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY p.a),
    big AS (SELECT scc FROM scc JOIN file_modules USING (id) GROUP BY scc HAVING count(*) > 1 AND count(DISTINCT module) > 1)"""
add(
    "K-02_acyclicity",
    lambda m: six(K.cycles(m.file_modules, m.imports), "normalized"),
    f"{CYCLES} SELECT count(*) AS cycles, round(1 / (1 + count(*)), 6) AS normalized FROM big",
)
add(
    "K-03_depth",
    lambda m: m.spark.createDataFrame([(K.depth(m.file_modules, m.imports),)], "depth bigint"),
    """WITH RECURSIVE v AS (SELECT DISTINCT directory AS id FROM file_modules),
    e AS (SELECT DISTINCT a.directory AS s, b.directory AS t FROM imports JOIN file_modules a ON source = a.id JOIN file_modules b ON target = b.id WHERE a.directory <> b.directory),
    r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
    scc AS (SELECT id, least(id, coalesce((SELECT min(p.t) FROM r p JOIN r q ON p.s = q.t AND p.t = q.s WHERE p.s = v.id), id)) AS scc FROM v),
    d AS (SELECT DISTINCT a.scc AS s, b.scc AS t FROM e JOIN scc a ON e.s = a.id JOIN scc b ON e.t = b.id WHERE a.scc <> b.scc),
    p AS (SELECT t, 2 AS n FROM d UNION SELECT d.t, n + 1 FROM p JOIN d ON p.t = d.s) SELECT CAST(coalesce(max(n), 1) AS BIGINT) AS depth FROM p""",
)
add("K-04_equality", lambda m: K.gini(prod(m), "cc").select(basis_points(1 - F.col("gini")).alias("equality_bp")),
    f"SELECT CAST(round((1 - greatest(0, least(1, 2 * sum(i * cc) / (count(*) * sum(cc)) - (count(*) + 1) / count(*)))) * 10000) AS BIGINT) AS equality_bp FROM (SELECT cc::DOUBLE AS cc, row_number() OVER (ORDER BY cc) AS i FROM ({PROD}) WHERE cc IS NOT NULL)")
add("K-05_to_10_functions", lambda m: K.function_quality(m.only("functions", "not is_test")).select(*[basis_points(F.col(c)).alias(c) for c in ("redundancy", "nesting", "conciseness", "uniqueness")]),
    f"""SELECT CAST(round((1 - avg(CAST(coalesce(is_dead, false) OR is_duplicate AS INT))) * 10000) AS BIGINT) AS redundancy, CAST(round(greatest(1 - avg(CAST(nesting >= 4 AS INT)), 0.01) * 10000) AS BIGINT) AS nesting,
    CAST(round(greatest(1 - avg(CAST(coalesce(cc >= 15 AND line_count >= 100 AND nesting >= 3, false) AS INT)), 0.01) * 10000) AS BIGINT) AS conciseness, CAST(round(greatest(1 - avg(CAST(clone_group IS NOT NULL AS INT)), 0.01) * 10000) AS BIGINT) AS uniqueness FROM ({PROD})""")
add("K-08_lcom4", classes, f"{LCOM} SELECT class, methods, lcom4 FROM lc")
add("K-08_cohesion", lambda m: K.cohesion(classes(m)).select(basis_points(F.col("cohesion")).alias("cohesion_bp")), f"{LCOM} SELECT CAST(round(avg(1.0::DOUBLE / lcom4) * 10000) AS BIGINT) AS cohesion_bp FROM lc")
CONTAINERS = "SELECT o.supplier AS id, count(*) AS methods, CAST(sum(line_count) AS BIGINT) AS span FROM owners o JOIN functions f ON o.part = f.id GROUP BY o.supplier"
add("K-09_focus", lambda m: m.sql(CONTAINERS).agg(basis_points(1 - F.avg(((F.col("methods") >= 20) | (F.col("span") >= 2500)).cast("double"))).alias("focus_bp")), f"SELECT CAST(round((1 - avg(CAST(methods >= 20 OR span >= 2500 AS INT))) * 10000) AS BIGINT) AS focus_bp FROM ({CONTAINERS})")
def normalized(m):
    """One row a metric, over production functions and containers; the last has no subject."""
    one = K.function_quality(prod(m)).join(K.gini(prod(m), "cc").select((1 - F.col("gini")).alias("equality")))
    one = one.join(m.sql(CONTAINERS).agg((1 - F.avg(((F.col("methods") >= 20) | (F.col("span") >= 2500)).cast("double"))).alias("focus")))
    one = one.withColumn("cohesion", F.lit(None).cast("double"))
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*one.columns))).alias("metric", "normalized"))


NORMALIZED = f"""p AS ({PROD}), g AS (SELECT 1 - greatest(0, least(1, 2 * sum(i * cc) / (count(*) * sum(cc)) - (count(*) + 1) / count(*))) AS equality
    FROM (SELECT cc::DOUBLE AS cc, row_number() OVER (ORDER BY cc) AS i FROM p WHERE cc IS NOT NULL)),
    f AS (SELECT 1 - avg(CAST(coalesce(is_dead, false) OR is_duplicate AS INT)) AS redundancy, greatest(1 - avg(CAST(nesting >= 4 AS INT)), 0.01) AS nesting,
    greatest(1 - avg(CAST(coalesce(cc >= 15 AND line_count >= 100 AND nesting >= 3, false) AS INT)), 0.01) AS conciseness,
    greatest(1 - avg(CAST(clone_group IS NOT NULL AS INT)), 0.01) AS uniqueness FROM p),
    o AS (SELECT 1 - avg(CAST(methods >= 20 OR span >= 2500 AS INT)) AS focus FROM ({CONTAINERS})),
    n AS (SELECT unnest([equality, redundancy, nesting, conciseness, uniqueness, focus, NULL]) AS x FROM g, f, o)"""
add(
    "K-11_signal",
    lambda m: K.aggregate_signal(normalized(m)),
    f"WITH {NORMALIZED} SELECT CASE WHEN min(x) <= 0 THEN 0 ELSE CAST(round(exp(avg(ln(greatest(x, 1e-12)))) * 10000) AS BIGINT) END AS signal FROM n WHERE x IS NOT NULL",
)
add(
    "K-12_thresholds",
    lambda m: m.sql(CONTAINERS).select("methods").distinct().select("methods", K.thresholds_digest(god_methods=F.col("methods")).alias("digest")),
    f"""SELECT DISTINCT methods, sha256('brain_cc=15;brain_lines=100;brain_nesting=3;god_methods=' || methods || ';god_span=500;nesting=4') AS digest FROM ({CONTAINERS})""",
)
add("K-13_god_containers", lambda m: K.god_containers(m.sql(CONTAINERS), K.Thresholds(god_methods=22, god_span=2600)), f"SELECT id, methods, span FROM ({CONTAINERS}) WHERE methods >= 22 OR span >= 2600")
add("K-14_worst_offenders", lambda m: K.offenders(prod(m).where("cc is not null"), "complexity", [F.desc("cc"), F.asc("id")]).select("dimension", "id", "cc", F.col("rank").cast("bigint").alias("rank")).unionByName(K.offenders(prod(m), "nesting", [F.desc("nesting"), F.asc("id")]).select("dimension", "id", F.col("nesting").alias("cc"), F.col("rank").cast("bigint").alias("rank"))),
    f"SELECT 'complexity' AS dimension, id, cc, r AS rank FROM (SELECT id, cc, row_number() OVER (ORDER BY cc DESC, id) AS r FROM ({PROD}) WHERE cc IS NOT NULL) WHERE r <= 10 UNION ALL SELECT 'nesting', id, nesting, r FROM (SELECT id, nesting, row_number() OVER (ORDER BY nesting DESC, id) AS r FROM ({PROD})) WHERE r <= 10")

add("L-02_max_cc", lambda m: K.over(m.functions, "max_cc", "name", "cc", 45), "SELECT 'max_cc' AS rule, name AS subject, cc AS value FROM functions WHERE cc > 45")
add("L-03_max_fn_lines", lambda m: K.over(m.functions, "max_fn_lines", "name", "line_count", 140), "SELECT 'max_fn_lines' AS rule, name AS subject, line_count AS value FROM functions WHERE line_count > 140")
add("L-04_no_god_files", lambda m: K.over(m.only("edges", "kind = 'contains'").groupBy("source").agg(F.count("*").alias("n")), "no_god_files", "source", "n", 20), "SELECT 'no_god_files' AS rule, CAST(source AS VARCHAR) AS subject, count(*) AS value FROM edges WHERE kind = 'contains' GROUP BY source HAVING count(*) > 20")
# Between directories of production code.
MODULE_EDGES = """SELECT DISTINCT a.module AS source, b.module AS target FROM imports JOIN file_modules a ON source = a.id JOIN file_modules b ON target = b.id
    JOIN functions f ON f.id = a.id AND NOT f.is_test JOIN functions g ON g.id = b.id AND NOT g.is_test WHERE a.module <> b.module"""
add(
    "L-05_coupling",
    lambda m: K.over(K.coupling(m.sql(MODULE_EDGES), True), "max_fan_in", "module", "n", 15).union(K.over(K.coupling(m.sql(MODULE_EDGES), False), "max_fan_out", "module", "n", 15)),
    f"""SELECT 'max_fan_in' AS rule, CAST(target AS VARCHAR) AS subject, count(*) AS value FROM ({MODULE_EDGES}) GROUP BY target HAVING count(*) > 15
    UNION ALL SELECT 'max_fan_out', CAST(source AS VARCHAR), count(*) FROM ({MODULE_EDGES}) GROUP BY source HAVING count(*) > 15""",
)
add(
    "L-06_max_dead",
    lambda m: prod(m).agg(F.lit("max_dead").alias("rule"), F.count_if(F.col("is_dead")).alias("value")).select(
        "*", (F.col("value") > L.Budget(most=20).limit(10)).alias("over_most"), (F.col("value") > L.Budget(delta=3).limit(10)).alias("over_baseline"), F.lit(L.Budget(delta=3).limit(None) is None).alias("no_baseline")
    ),
    "SELECT 'max_dead' AS rule, count(*) FILTER (is_dead) AS value, count(*) FILTER (is_dead) > 20 AS over_most, count(*) FILTER (is_dead) > 13 AS over_baseline, true AS no_baseline FROM functions WHERE NOT is_test",
)
add("L-07_max_duplicates", lambda m: m.functions.agg(F.lit("max_duplicates").alias("rule"), F.count_if(F.col("is_duplicate")).alias("value")), "SELECT 'max_duplicates' AS rule, count(*) FILTER (is_duplicate) AS value FROM functions")
add("L-08_max_nesting", lambda m: K.over(prod(m), "max_nesting_depth", "name", "nesting", 4), f"SELECT 'max_nesting_depth' AS rule, name AS subject, nesting AS value FROM ({PROD}) WHERE nesting > 4")
add("L-09_brain_methods", lambda m: prod(m).where(K.is_brain(K.Thresholds())).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM ({PROD}) WHERE cc >= 15 AND line_count >= 100 AND nesting >= 3")
add("L-10_clone_ratio", lambda m: prod(m).agg(basis_points(F.avg(F.col("clone_group").isNotNull().cast("double"))).alias("clone_bp")), f"SELECT CAST(round(avg(CAST(clone_group IS NOT NULL AS INT)) * 10000) AS BIGINT) AS clone_bp FROM ({PROD})")
add("L-12_layer_order", lambda m: K.layer_violations(files(m)[0], files(m)[1].select("file", "order")), f"SELECT DISTINCT source, target FROM ({FILES}) WHERE t_o > so AND source <> target")
add(
    "L-13_boundaries",
    lambda m: K.boundary_violations(files(m)[0], files(m)[1].select("file", F.col("order").cast("string")), [("0", "1"), ("2", "3"), ("4", "0")]),
    f"SELECT DISTINCT so || '->' || t_o AS rule, source, target FROM ({FILES}) WHERE (so, t_o) IN ((0, 1), (2, 3), (4, 0))",
)
add(
    "L-14_forbidden_imports",
    lambda m: paired(files(m)[0].distinct(), [("src/m0/*", "src/m2*/**"), ("src/m*/f1*", "src/{m3,m4}/*")]),
    f"""SELECT DISTINCT 'src/m0/* -> src/m2*/**' AS rule, source, target FROM ({FILES}) WHERE source LIKE 'src/m0/%' AND target LIKE 'src/m2%'
    UNION ALL SELECT DISTINCT 'src/m*/f1* -> src/{{m3,m4}}/*', source, target FROM ({FILES}) WHERE source LIKE 'src/m%/f1%' AND (target LIKE 'src/m3/%' OR target LIKE 'src/m4/%')""",
)
add("L-15_untested", lambda m: K.untested(m.functions, m.edges).select("id"),
    "WITH RECURSIVE t AS (SELECT id FROM functions WHERE is_test UNION SELECT target FROM t JOIN edges ON id = source WHERE kind = 'calls') SELECT id FROM functions WHERE exported AND NOT is_test AND id NOT IN (SELECT id FROM t)")
add("L-16_undocumented", lambda m: undocumented(m, m.functions.where("exported")).select("id"), "SELECT id FROM functions WHERE exported AND id NOT IN (SELECT target FROM edges WHERE kind = 'doc_reference')")
POLICY = L.Policy(
    limits={
        "max_cycles": 0, "max_cc": 45, "max_fn_lines": 140, "no_god_files": 0, "max_fan_in": 15, "max_fan_out": 15, "max_dead": L.Budget(delta=3), "max_duplicates": L.Budget(most=5),
        "max_nesting_depth": 4, "max_brain_methods": 0, "max_clone_ratio": 100, "no_god_containers": 0,
    },
    layers=[("low", ["src/m0/**", "src/m1/**"]), ("mid", ["src/m1?/**"]), ("high", ["src/**/f*.rs"])],
    boundaries=[("high", "low"), ("mid", "low")],
    forbidden=[("src/m2?/*", "src/m3/**"), ("src/**", "src/m4/f1*.rs")],
    tested=["src/m1/**", "src/m2*/*"],
    documented=["src/m3/*"],
)
BASELINE = {"max_dead": 10}
CLASS_SPANS = "SELECT source AS id, count(*) AS methods, count(*) * 10 AS span FROM edges WHERE kind = 'contains' AND source > 2000000 GROUP BY source"


def violations(m):
    return L.evaluate(L.Facts(m.functions, m.imports, m.file_modules, m.sql(CLASS_SPANS), m.nodes, m.edges), POLICY, BASELINE)


VIOLATIONS = f"""{CYCLES}, me AS ({MODULE_EDGES}),
    fe AS (SELECT DISTINCT f.file_path AS source, g.file_path AS target FROM imports i JOIN functions f ON f.id = i.source AND NOT f.is_test JOIN functions g ON g.id = i.target AND NOT g.is_test WHERE f.file_path <> g.file_path),
    ly AS (SELECT DISTINCT file_path AS path, CASE WHEN file_path LIKE 'src/m0/%' OR file_path LIKE 'src/m1/%' THEN 0 WHEN regexp_matches(file_path, '^src/m1[^/]/') THEN 1 ELSE 2 END AS layer FROM functions),
    fl AS (SELECT source || ' -> ' || target AS subject, a.layer AS sl, b.layer AS tl FROM fe JOIN ly a ON a.path = source JOIN ly b ON b.path = target),
    tested AS (SELECT id FROM functions WHERE is_test UNION SELECT target FROM tested JOIN edges ON id = source WHERE kind = 'calls'),
    untested AS (SELECT * FROM functions WHERE exported AND NOT is_test AND id NOT IN (SELECT id FROM tested)),
    counted AS (SELECT count(*) FILTER (is_dead) AS dead, count(*) FILTER (is_duplicate) AS dup, count(*) FILTER (cc >= 15 AND line_count >= 100 AND nesting >= 3) AS brain,
        CAST(round(avg(CASE WHEN clone_group IS NOT NULL THEN 10000 ELSE 0 END)) AS BIGINT) AS clones FROM functions WHERE NOT is_test),
    found AS (
    SELECT 'constraints' AS section, 'max_cycles' AS rule, '' AS subject, count(*) AS value FROM big HAVING count(*) > 0
    UNION ALL SELECT 'constraints', 'max_cc', name || '#' || id, cc FROM functions WHERE cc > 45
    UNION ALL SELECT 'constraints', 'max_fn_lines', name || '#' || id, line_count FROM functions WHERE line_count > 140
    UNION ALL SELECT 'constraints', 'no_god_files', file_path, count(*) FROM functions GROUP BY file_path
    UNION ALL SELECT 'coupling', 'max_fan_in', CAST(target AS VARCHAR), count(*) FROM me GROUP BY target HAVING count(*) > 15
    UNION ALL SELECT 'coupling', 'max_fan_out', CAST(source AS VARCHAR), count(*) FROM me GROUP BY source HAVING count(*) > 15
    UNION ALL SELECT 'redundancy', 'max_dead', '', dead FROM counted WHERE dead > 13
    UNION ALL SELECT 'redundancy', 'max_duplicates', '', dup FROM counted WHERE dup > 5
    UNION ALL SELECT 'structural', 'max_nesting_depth', name || '#' || id, nesting FROM functions WHERE NOT is_test AND nesting > 4
    UNION ALL SELECT 'structural', 'max_brain_methods', '', brain FROM counted WHERE brain > 0
    UNION ALL SELECT 'structural', 'max_clone_ratio', '', clones FROM counted WHERE clones > 100
    UNION ALL SELECT 'structural', 'no_god_containers', '', count(*) FROM ({CLASS_SPANS}) WHERE methods >= 20 OR span >= 500 HAVING count(*) > 0
    UNION ALL SELECT 'layering', 'layer_order', subject, 1 FROM fl WHERE tl > sl
    UNION ALL SELECT 'layering', CASE sl WHEN 2 THEN 'boundary high->low' ELSE 'boundary mid->low' END, subject, 1 FROM fl WHERE sl > 0 AND tl = 0
    UNION ALL SELECT 'forbidden_imports', 'src/m2?/* -> src/m3/**', source || ' -> ' || target, 1 FROM fe WHERE regexp_matches(source, '^src/m2[^/]/[^/]*$') AND target LIKE 'src/m3/%'
    UNION ALL SELECT 'forbidden_imports', 'src/** -> src/m4/f1*.rs', source || ' -> ' || target, 1 FROM fe WHERE source LIKE 'src/%' AND regexp_matches(target, '^src/m4/f1[^/]*\\.rs$')
    UNION ALL SELECT 'require_tested', 'src/m1/**', name || '#' || id, 1 FROM untested WHERE file_path LIKE 'src/m1/%'
    UNION ALL SELECT 'require_tested', 'src/m2*/*', name || '#' || id, 1 FROM untested WHERE regexp_matches(file_path, '^src/m2[^/]*/[^/]*$')
    UNION ALL SELECT 'require_documented', 'src/m3/*', name || '#' || id, 1 FROM functions WHERE exported AND NOT is_test AND file_path LIKE 'src/m3/%' AND id NOT IN (SELECT target FROM edges WHERE kind = 'doc_reference'))"""
add("L-17_all_violations", violations, f"{VIOLATIONS} SELECT * FROM found")
add(
    "L-26_scan",
    lambda m: violations(m).agg(F.lit(POLICY.checked()).cast("bigint").alias("checked"), F.count("*").alias("violations"), F.countDistinct("section").alias("sections"), F.countDistinct("rule").alias("rules"))
    .join(K.function_quality(prod(m)).select(F.round(F.col("nesting") * 10000).cast("bigint").alias("nesting_bp"))),
    f"""{VIOLATIONS} SELECT 20 AS checked, count(*) AS violations, count(DISTINCT section) AS sections, count(DISTINCT rule) AS rules,
    (SELECT CAST(round(greatest(1 - avg(CAST(nesting >= 4 AS INT)), 0.01) * 10000) AS BIGINT) FROM functions WHERE NOT is_test) AS nesting_bp FROM found""",
)
add(
    "L-18_gate",
    lambda m: R.with_delta(m.snapshots, "id", "signal", "delta").select(
        "id", K.gated(F.col("signal"), F.col("signal") - F.col("delta"), F.col("id") % 5 != 0, F.col("id") % 7 != 0, F.when(F.col("id") % 3 == 0, 6000), F.col("id") % 2).alias("g")
    ).select("id", "g.passed", "g.reason"),
    """WITH s AS (SELECT *, CASE WHEN signal IS NOT NULL THEN lag(signal) OVER (ORDER BY id) END AS base FROM snapshots),
    g AS (SELECT id, CASE WHEN base IS NULL THEN 'no baseline' WHEN id % 5 = 0 THEN 'new metric version: baseline renewed' WHEN id % 7 = 0 THEN 'new thresholds: baseline renewed'
    WHEN signal < base - 1 THEN 'signal below baseline' WHEN id % 3 = 0 AND signal < 6000 THEN 'signal below floor' WHEN id % 2 = 1 THEN 'structural faults' ELSE 'ok' END AS reason FROM s)
    SELECT id, reason NOT IN ('signal below baseline', 'signal below floor', 'structural faults') AS passed, reason FROM g""",
)
add("L-19_regressions", lambda m: K.regressions(m.nation.select(F.col("n_name").alias("metric"), (F.col("n_nationkey") / 25).alias("normalized")), m.nation.select(F.col("n_name").alias("metric"), (F.col("n_regionkey") / 5).alias("normalized"))).select("metric", basis_points(F.col("drop")).alias("drop_bp")),
    "SELECT n_name AS metric, CAST(round((n_nationkey / 25 - n_regionkey / 5) * 10000) AS BIGINT) AS drop_bp FROM nation WHERE n_nationkey / 25 - n_regionkey / 5 > 1e-9")
add(
    "L-20_evolution",
    lambda m: K.evolution(m.snapshots, ["signal", "nodes"]),
    """SELECT id, signal, nodes, signal - before AS signal_delta, nodes - nodes_before AS nodes_delta FROM (SELECT *, lag(signal) OVER (ORDER BY id) AS before,
    lag(nodes) OVER (ORDER BY id) AS nodes_before FROM snapshots) ORDER BY id DESC LIMIT 30""",
)
add("L-21_doc_gaps", lambda m: undocumented(m, m.functions).orderBy("file_path", "name").limit(50).select("file_path", "name"), "SELECT file_path, name FROM functions WHERE id NOT IN (SELECT target FROM edges WHERE kind = 'doc_reference') ORDER BY 1, 2 LIMIT 50")
add("L-21_documented_ratio", lambda m: m.functions.agg(F.count("*").alias("n")).join(undocumented(m, m.functions).agg(F.count("*").alias("gaps"))).select("n", "gaps", F.when(F.col("n") > 0, basis_points(1 - F.col("gaps") / F.col("n"))).alias("documented_bp")),
    "SELECT n, gaps, CAST(round((1 - gaps / n) * 10000) AS BIGINT) AS documented_bp FROM (SELECT count(*) AS n, count(*) FILTER (id NOT IN (SELECT target FROM edges WHERE kind = 'doc_reference')) AS gaps FROM functions)")
add("L-22_structural_integrity", lambda m: K.structural_report(m.nodes, m.edges, m.files.where("id % 10 <> 0")),
    """SELECT 'duplicate_symbols' AS fault, count(*) - count(DISTINCT symbol) AS n FROM nodes UNION ALL SELECT 'edges_without_source', count(*) FROM edges WHERE source NOT IN (SELECT id FROM nodes)
    UNION ALL SELECT 'edges_without_target', count(*) FROM edges WHERE target NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'repeated_edges', count(*) FROM (SELECT 1 FROM edges GROUP BY source, target, kind HAVING count(*) > 1)
    UNION ALL SELECT 'nodes_without_file', count(*) FROM nodes WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT path FROM files WHERE id % 10 <> 0)""")
add(
    "L-25_health",
    lambda m: K.health(m.nodes, m.edges, m.files.where("id % 10 <> 0")),
    """SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM files WHERE id % 10 <> 0) AS files,
    (SELECT count(*) FROM nodes WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT path FROM files WHERE id % 10 <> 0)) AS nodes_without_file,
    (SELECT count(*) FROM edges WHERE target NOT IN (SELECT id FROM nodes)) + (SELECT count(*) FROM edges WHERE source NOT IN (SELECT id FROM nodes)) AS dangling_edges,
    (SELECT count(*) FROM nodes WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT path FROM files WHERE id % 10 <> 0)) = 0 AS healthy""",
)
add(
    "L-28_default_budgets",
    lambda m: K.against_budgets(m.functions, m.sql(CONTAINERS), m.imports, m.file_modules),
    f"""{CYCLES}, c AS ({CONTAINERS}), b AS (SELECT 'max_cycles' AS budget, 0 AS most, (SELECT count(*) FROM big) AS value
    UNION ALL SELECT 'max_cc', 15, max(cc) FROM functions UNION ALL SELECT 'max_fn_lines', 80, max(line_count) FROM functions
    UNION ALL SELECT 'no_god_files', 40, max(n) FROM (SELECT count(*) AS n FROM functions GROUP BY file_path)
    UNION ALL SELECT 'max_fan_in', 30, max(n) FROM (SELECT count(DISTINCT source) AS n FROM imports GROUP BY target)
    UNION ALL SELECT 'max_fan_out', 30, max(n) FROM (SELECT count(DISTINCT target) AS n FROM imports GROUP BY source)
    UNION ALL SELECT 'max_dead', 0, count(*) FILTER (is_dead) FROM functions UNION ALL SELECT 'max_duplicates', 0, count(*) FILTER (is_duplicate) FROM functions
    UNION ALL SELECT 'max_nesting_depth', 4, max(nesting) FROM functions
    UNION ALL SELECT 'max_brain_methods', 0, count(*) FILTER (cc >= 15 AND line_count >= 100 AND nesting >= 3) FROM functions
    UNION ALL SELECT 'max_clone_ratio', 0, CAST(round(avg(CAST(clone_group IS NOT NULL AS INT)) * 10000) AS BIGINT) FROM functions
    UNION ALL SELECT 'no_god_containers', 0, count(*) FILTER (methods >= 20 OR span >= 500) FROM c) SELECT budget, most, value, value > most AS exceeded FROM b""",
)
