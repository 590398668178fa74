"""Queries of contract keys, implementors, links, routes and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import history as H
from codeloom.operators import navigation as N
from codeloom.operators import quality as K
from codeloom.operators import resolution as Q
from codeloom.operators import search as I
from codeloom.operators import store as U
from codeloom.operators.federation import versions
from codeloom.plans.model import PROJECTIONS
from codeloom.plans.registry import add
from codeloom.plans.stream import drained
from codeloom.sources import readers as S
from codeloom.streaming import changes as T

ROLES = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'route' WHEN 1 THEN 'client_call' WHEN 2 THEN 'rpc' WHEN 3 THEN 'producer' ELSE 'function' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'get /a/{id}' WHEN 1 THEN 'POST /b/:x/' WHEN 2 THEN 'pkg.Shop/Get' ELSE 'Topic.A' END AS name FROM part"
LINKS = "SELECT page_id AS id, 'docs/src1.md' AS file_path, CASE page_id % 4 WHEN 0 THEN 'https://x' WHEN 1 THEN '../docs/src' || cast(page_id % 30 AS varchar(4)) || '.md' WHEN 2 THEN '#part-one' ELSE './src2.md#none' END AS target FROM pages"


def links(m):
    return Q.doc_links(m.sql(LINKS), m.files, m.files.where("language = 'markdown'").select("path", F.lit("part-one").alias("anchor")))


add("Q-03_portable_keys", lambda m: m.sql(ROLES).select("id", Q.portable_key(F.col("kind"), F.col("name")).alias("k")).select("id", "k.protocol", "k.key", "k.role"),
    "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'http' WHEN 2 THEN 'grpc' WHEN 3 THEN 'broker' END AS protocol, CASE p_partkey % 5 WHEN 0 THEN 'GET /a/{}' WHEN 1 THEN 'POST /b/{}' WHEN 2 THEN 'pkg.Shop/Get' WHEN 3 THEN 'topic.a' END AS key, CASE p_partkey % 5 WHEN 0 THEN 'provider' WHEN 1 THEN 'consumer' WHEN 2 THEN 'provider' WHEN 3 THEN 'consumer' END AS role FROM part")
add("P-09_implementors", lambda m: Q.implementors(m.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("crate::t::"), F.col("p_brand")).alias("target")), m.supplier.select(F.col("s_suppkey").alias("id"), F.lit("trait").alias("kind"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 97).cast("string")).alias("name"))),
    "SELECT p_partkey AS ref, t.id AS node FROM part JOIN (SELECT 'Brand#' || (s_suppkey % 97) AS k, min(s_suppkey) AS id FROM supplier GROUP BY 1 HAVING count(*) = 1) t ON p_brand = k")
add(
    "P-09_dynamic_targets",
    lambda m: Q.dynamic_targets(
        m.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("trait"), F.lit("run").alias("method")),
        m.supplier.select((F.col("s_suppkey") % 50).alias("trait"), F.col("s_nationkey").alias("type")),
        m.nation.select(F.col("n_nationkey").alias("type"), F.lit("run").alias("method"), F.col("n_nationkey").alias("id")),
    ),
    "SELECT DISTINCT p_partkey AS ref, n_nationkey AS node FROM part JOIN supplier ON s_suppkey % 50 = p_size JOIN nation ON n_nationkey = s_nationkey",
)
add("P-11_doc_links", links,
    f"""SELECT id AS ref, CASE id % 4 WHEN 0 THEN 'docs/https:/x' WHEN 1 THEN 'docs/src' || (id % 30) || '.md' WHEN 2 THEN 'docs/src1.md' ELSE 'docs/src2.md' END AS path, CASE id % 4 WHEN 2 THEN 'part-one' WHEN 3 THEN 'none' END AS anchor,
    CASE WHEN id % 4 = 0 THEN 'external' WHEN CASE id % 4 WHEN 1 THEN 'docs/src' || (id % 30) || '.md' WHEN 2 THEN 'docs/src1.md' ELSE 'docs/src2.md' END NOT IN (SELECT path FROM files) THEN 'no_file' WHEN id % 4 = 3 THEN 'no_anchor' ELSE 'bound' END AS outcome FROM (SELECT page_id AS id FROM pages)""")
add(
    "P-14_promoted_routes",
    lambda m: Q.promoted_routes(
        m.functions.select("file_path", F.lit("get").alias("method"), F.concat(F.lit("/f/"), F.col("id").cast("string")).alias("template"), F.when(F.col("id") % 100 == 0, F.col("name")).otherwise("fn7").alias("handler")), m.nodes
    ).select("file_path", "name", "handler"),
    "SELECT file_path, 'GET /f/' || id AS name, CASE WHEN id % 100 = 0 THEN id ELSE 7 END AS handler FROM functions",
)
add(
    "O-01_normalized_tokens",
    lambda m: m.part.select(
        "p_partkey",
        F.array_join(I.normalized_tokens(F.concat(
            F.when(F.col("p_size") % 2 == 0, "while").otherwise("if"), F.lit(" x"), F.col("p_partkey").cast("string"), F.lit(" { return f("),
            F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"'))), F.lit("); } // "), F.col("p_brand"),
        )), " ").alias("t"),
    ),
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'while' ELSE 'if' END || ' I { return I ( L ) ; }' AS t FROM part",
)
NAMES = "p AS (SELECT id AS key, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT id, regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+') AS w FROM nodes)), len AS (SELECT key, count(*) AS n FROM p GROUP BY key), stat AS (SELECT count(*) AS docs, avg(n) AS mean FROM len)"
RANK = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))"


ARTIFACTS = """SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'a.yaml' WHEN 1 THEN 'Dockerfile' WHEN 2 THEN 'Makefile' WHEN 3 THEN 'a.sql' WHEN 4 THEN 'a.tf' ELSE 'a.toml' END AS name FROM part"""


def artifacts(m):
    """A file for each part; what it holds goes with the part's key and size."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    texts = {
        "a.yaml": ("base%: &b#\n  size: 1\nuse%:\n  <<: *b#\n  deep:\n    not: this\n"),
        "Dockerfile": ("FROM img#:1 AS build%\nRUN x\nFROM scratch\nCOPY --from=build% /a /b\n"),
        "Makefile": ("VAR := x\nall%: dep#.o lib\n\techo\ndep#.o: dep#.c\n.PHONY: all%\n"),
        "a.sql": ("-- create table no (x int);\nCREATE TABLE t% (id int, w# text, FOREIGN KEY (w#) REFERENCES other#(id));\ncreate view v% as select * from t%;\n"),
        "a.tf": ('resource "aws_x" "r%" {\n  a = var.v#\n}\nmodule "m%" {\n  source = "./mods/m#"\n}\nvariable "v#" {}\n'),
        "a.toml": ("[s%]\nk# = 1\n"),
    }
    body = F.lit("")
    for name, t in texts.items():
        body = F.when(F.col("name") == name, F.replace(F.replace(F.lit(t), F.lit("%"), k), F.lit("#"), n)).otherwise(body)
    return m.sql(ARTIFACTS).select(F.concat(F.lit("p"), k, F.lit("/"), F.col("name")).alias("path"), body.alias("content"))


FACT_ROWS = {
    "a.yaml": [("config_section", "base%", ""), ("anchor", "b#", "base%"), ("config_section", "size", "base%"), ("config_section", "use%", ""), ("config_section", "<<", "use%"), ("reference", "b#", "use%"), ("config_section", "deep", "use%")],
    "Dockerfile": [("stage", "build%", ""), ("reference", "img#:1", "build%"), ("stage", "1", ""), ("reference", "scratch", "1"), ("reference", "build%", "1")],
    "Makefile": [("target", "all%", ""), ("reference", "dep#.o", "all%"), ("reference", "lib", "all%"), ("target", "dep#.o", ""), ("reference", "dep#.c", "dep#.o")],
    "a.sql": [("table", "t%", ""), ("column", "id", "t%"), ("column", "w#", "t%"), ("reference", "other#", "t%"), ("table", "v%", ""), ("reference", "t%", "v%")],
    "a.tf": [("resource", "aws_x.r%", ""), ("reference", "var.v#", "aws_x.r%"), ("module", "module.m%", ""), ("reference", "./mods/m#", "module.m%"), ("variable", "var.v#", "")],
    "a.toml": [("config_section", "s%", ""), ("config_section", "k#", "s%")],
}
FACT_VALUES = ", ".join(f"('{f}', '{k}', '{n}', '{p}')" for f, rows in FACT_ROWS.items() for k, n, p in rows)
add(
    "A-16_config_facts",
    lambda m: S.extract_facts(artifacts(m)).select("path", "kind", "name", "parent"),
    f"""SELECT 'p' || p_partkey || '/' || a.name AS path, k AS kind, replace(replace(n, '%', CAST(p_partkey AS VARCHAR)), '#', CAST(p_size AS VARCHAR)) AS name,
    replace(replace(p, '%', CAST(p_partkey AS VARCHAR)), '#', CAST(p_size AS VARCHAR)) AS parent FROM ({ARTIFACTS}) a JOIN (VALUES {FACT_VALUES}) t(f, k, n, p) ON a.name = f""",
)
add("C-06_search_nodes", lambda m: m.texts("nodes").search("section").join(m.nodes, F.col("key") == F.col("id")).select("id", "symbol"),
    f"WITH {NAMES}, h AS (SELECT key, count(*) AS tf FROM p WHERE token = 'section' GROUP BY key), f AS (SELECT count(*) AS df FROM h) SELECT id, symbol FROM nodes WHERE id IN (SELECT key FROM h JOIN len USING (key), stat, f ORDER BY round({RANK}, 9) DESC, key LIMIT 20)")
add("F-01_search_order", lambda m: m.texts("nodes").search("section 10").select("key", F.round("score", 6).alias("score")),
    f"WITH {NAMES}, h AS (SELECT a.key, count(*) AS tf FROM p a JOIN p b ON a.key = b.key AND b.pos = a.pos + 1 WHERE a.token = 'section' AND b.token = '10' GROUP BY a.key), f AS (SELECT count(*) AS df FROM h) SELECT key, round({RANK}, 6) AS score FROM h JOIN len USING (key), stat, f ORDER BY round({RANK}, 9) DESC, key LIMIT 20")
add("F-11_suggestion_cap", lambda m: I.suggestions(m.nodes.where("kind = 'module'"), "n", 5), "WITH s AS (SELECT DISTINCT name, CASE WHEN starts_with(lower(name), 'n') THEN 0 ELSE 1 END AS tier FROM nodes WHERE kind = 'module' AND (starts_with(lower(name), 'n') OR contains(name, 'n'))) SELECT name FROM s WHERE tier = (SELECT min(tier) FROM s) ORDER BY 1 LIMIT 5")
add("H-10_context_seeds", lambda m: N.seeds(m.nodes.where("id % 100 = 3").select("id", F.col("id").alias("rank")), m.nodes).select("id", "is_code", F.round("match", 6).alias("match")),
    "WITH h AS (SELECT id, kind <> 'doc_section' AS is_code, row_number() OVER (PARTITION BY kind <> 'doc_section' ORDER BY id) AS r FROM nodes WHERE id % 100 = 3) SELECT id, is_code, round(1.0::DOUBLE / row_number() OVER (ORDER BY id), 6) AS match FROM h WHERE r <= 8")
add(
    "M-07_degraded_modes",
    lambda m: m.nation.select("n_name", H.history_notice(F.element_at(F.array(*[F.lit(x) for x in ("ok", "not_git", "no_git", "shallow")]), F.col("n_nationkey") % 4 + 1)).alias("notice")),
    """SELECT n_name, CASE n_nationkey % 4 WHEN 1 THEN 'no history: not a repository' WHEN 2 THEN 'no history: git is not installed' WHEN 3 THEN 'no history: the clone is shallow' END AS notice FROM nation""",
)
add("P-01_name_index", lambda m: m.nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"), "SELECT name, count(*) AS n, min(id) AS first FROM nodes GROUP BY name HAVING count(*) > 1")
# Configuration files in folders by their number, some twice; targets that share names; routes. References of six kinds, some to what is not there.
CONFIG_NODES = """SELECT 20000000 + s_suppkey AS id, 'config_file' AS kind, 'main' || cast(s_suppkey AS varchar(9)) AS name,
    'deploy/d' || cast(s_suppkey % 20 AS varchar(9)) || '/main' || cast(s_suppkey AS varchar(9)) || CASE WHEN s_suppkey % 3 = 0 THEN '.tf' ELSE '.yaml' END AS file_path FROM supplier
    UNION ALL SELECT 30000000 + s_suppkey, 'config_file', 'copy', 'deploy/d' || cast(s_suppkey % 20 AS varchar(9)) || '/main' || cast(s_suppkey AS varchar(9)) || CASE WHEN s_suppkey % 3 = 0 THEN '.tf' ELSE '.yaml' END
        FROM supplier WHERE s_suppkey % 10 = 0
    UNION ALL SELECT 40000000 + s_suppkey, 'target', 't' || cast(s_suppkey % 60 AS varchar(9)), 'Makefile' FROM supplier WHERE s_suppkey % 60 > 9
    UNION ALL SELECT 50000000 + s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'struct' ELSE 'function' END, 'Type' || cast(s_suppkey AS varchar(9)), 'src/t.rs' FROM supplier
    UNION ALL SELECT 60000000 + s_suppkey, 'route', 'GET /r' || cast(s_suppkey AS varchar(9)) || '/{id}', 'src/r.rs' FROM supplier"""
CONFIG_REFS = """SELECT p AS ref, p % 6 AS what, k, CASE WHEN p % 6 < 4 THEN 'artifact_ref' ELSE 'artifact_binding' END AS kind, CASE WHEN p % 6 IN (3, 4) THEN 'method' ELSE 'path' END AS form,
    CASE p % 6 WHEN 0 THEN 'deploy/d' || cast(k % 20 AS varchar(9)) || '/x.yaml' WHEN 1 THEN 'ci/build.yaml' ELSE 'deploy/root.tf' END AS file,
    CASE p % 6 WHEN 0 THEN './main' || cast(k AS varchar(9)) || CASE WHEN k % 3 = 0 THEN '.tf' ELSE '.yaml' END
        WHEN 1 THEN 'deploy/x/../d' || cast(k % 20 AS varchar(9)) || '/main' || cast(k AS varchar(9)) || CASE WHEN k % 3 = 0 THEN '.tf' ELSE '.yaml' END
        WHEN 2 THEN './d' || cast(k % 25 AS varchar(9)) WHEN 3 THEN 't' || cast(k % 60 AS varchar(9)) WHEN 4 THEN 'Type' || cast(k AS varchar(9)) ELSE 'get /r' || cast(k AS varchar(9)) || '/:key/' END AS target,
    CASE WHEN p % 6 = 2 THEN 'tf_module_call' END AS relation, CASE WHEN p % 6 = 3 AND p % 4 = 1 THEN 'target' END AS want_kind
    FROM (SELECT p_partkey AS p, 1 + p_partkey * 7 % (suppliers + cast(floor(suppliers / 4) AS bigint)) AS k FROM part, (SELECT count(*) AS suppliers FROM supplier) n) x"""
add(
    "P-10_artifact_refs",
    lambda m: Q.artifact_outcomes(m.sql(CONFIG_REFS), m.sql(CONFIG_NODES)),
    f"""WITH n AS ({CONFIG_NODES}), r AS ({CONFIG_REFS}), hit AS (
        SELECT ref, what, n.id AS node FROM r JOIN n ON what IN (0, 1) AND n.kind = 'config_file' AND n.file_path = 'deploy/d' || k % 20 || '/main' || k || CASE WHEN k % 3 = 0 THEN '.tf' ELSE '.yaml' END
        UNION ALL SELECT ref, what, n.id FROM r JOIN n ON what = 2 AND n.kind = 'config_file' AND n.file_path LIKE '%.tf' AND regexp_extract(n.file_path, '^(.*)/', 1) = 'deploy/d' || k % 25
        UNION ALL SELECT ref, what, n.id FROM r JOIN n ON what = 3 AND n.kind = 'target' AND n.name = r.target
        UNION ALL SELECT ref, what, n.id FROM r JOIN n ON what = 4 AND n.kind = 'struct' AND n.name = r.target
        UNION ALL SELECT ref, what, n.id FROM r JOIN n ON what = 5 AND n.kind = 'route' AND n.name = 'GET /r' || k || '/{{id}}'),
    c AS (SELECT ref, count(*) AS c FROM hit GROUP BY ref)
    SELECT ref, node, 'bound' AS outcome FROM hit JOIN c USING (ref) WHERE what = 2 OR c = 1
    UNION ALL SELECT ref, NULL, 'ambiguous' FROM (SELECT DISTINCT ref FROM hit JOIN c USING (ref) WHERE what <> 2 AND c > 1)
    UNION ALL SELECT ref, NULL, 'not_found' FROM r WHERE ref NOT IN (SELECT ref FROM hit)""",
)
add(
    "P-17_rebind",
    lambda m: Q.rebound(
        Q.resolved(m.refs, [Q.keyed(m.refs, m.functions.where("id % 2 = 0"), F.col("target"), F.col("fingerprint"))]), m.functions.where("id % 2 = 1"), F.col("target"), F.col("fingerprint")
    ).groupBy("outcome").agg(F.count("*").alias("n")),
    """WITH e AS (SELECT fingerprint, count(*) AS n FROM functions WHERE id % 2 = 0 GROUP BY 1), o AS (SELECT fingerprint, count(*) AS n FROM functions WHERE id % 2 = 1 GROUP BY 1),
    c AS (SELECT coalesce(e.n, o.n, 0) AS n FROM refs r LEFT JOIN e ON r.target = e.fingerprint LEFT JOIN o ON r.target = o.fingerprint)
    SELECT CASE n WHEN 0 THEN 'not_found' WHEN 1 THEN 'bound' ELSE 'ambiguous' END AS outcome, count(*) AS n FROM c GROUP BY 1""",
)
# Providers with repeated rows, which a version leaves out as it is hashed.
PROVIDED = PROJECTIONS["providers"].replace("SELECT DISTINCT", "SELECT", 1)
add("Q-11_member_versions", lambda m: versions(m.inline(PROVIDED)), "SELECT member, sha256(string_agg(symbol, ',' ORDER BY symbol)) AS stamp FROM (SELECT DISTINCT member, symbol FROM providers) GROUP BY member")
add(
    "T-03_coalesced_paths",
    lambda m: drained(m, lambda e: T.coalesced(e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path")), "400 days").select("path")),
    "SELECT DISTINCT event_type AS path FROM events",
)
add("U-02_upsert_nodes", lambda m: U.upsert(m.nodes.select("symbol", "kind", "name"), m.nodes.where("id % 9 = 0").select("symbol", F.lit("moved").alias("kind"), "name"), ["symbol"]), "SELECT symbol, CASE WHEN id % 9 = 0 THEN 'moved' ELSE kind END AS kind, name FROM nodes")
