"""Queries of reference resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from codeloom.operators import resolution as P
from codeloom.operators.shared import cut
from codeloom.plans.registry import add

# Tier 0: the whole fingerprint; tier 1: brand and type; as wide as that, most stay ambiguous.
LADDER = """c AS (SELECT r.id, 0 AS tier, f.id AS node FROM refs r JOIN functions f ON r.target = f.fingerprint
    UNION ALL SELECT r.id, 1, f.id FROM refs r JOIN functions f ON regexp_replace(r.target, '[|][0-9]+$', '') = regexp_replace(f.fingerprint, '[|][0-9]+$', '')),
    n AS (SELECT id, tier, count(*) AS n, min(node) AS node FROM c GROUP BY ALL), d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier) = 1),
    o AS (SELECT r.*, CASE WHEN d.n = 1 THEN d.node END AS node, CASE WHEN d.n = 1 THEN 'bound' WHEN d.n > 1 THEN 'ambiguous' ELSE 'not_found' END AS outcome, d.tier FROM refs r LEFT JOIN d ON r.id = d.id)"""

DOC_FILES = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'docs/requirements/FR-' || cast(doc_id AS varchar(9)) || '.md' WHEN 1 THEN 'requirements/NFR-X.markdown'
    WHEN 2 THEN 'docs/any/ADR-' || cast(doc_id AS varchar(9)) || '-x.md' WHEN 3 THEN 'docs/adr/ADR-x.md' WHEN 4 THEN 'FR-1.md' ELSE 'docs/requirements/old/FR-1.md' END AS path,
    CASE WHEN doc_id % 7 < 3 THEN CASE doc_id % 5 WHEN 0 THEN 'S-39: ' || source WHEN 1 THEN 'S-39x' WHEN 2 THEN '  S-4' WHEN 3 THEN 'S-' ELSE source END END AS heading FROM documents"""


def outcomes(m):
    wide = lambda c: F.regexp_replace(c, r"\|[0-9]+$", "")
    return P.resolved(m.refs, [P.keyed(m.refs, m.functions, F.col("target"), F.col("fingerprint")), P.keyed(m.refs, m.functions, wide("target"), wide("fingerprint"))])


add("P-03_exactly_one", lambda m: P.ladder([P.keyed(m.refs, m.functions, F.col("target"), F.col("fingerprint"))]).select("ref", "node", "outcome"),
    "SELECT r.id AS ref, CASE WHEN count(*) = 1 THEN min(f.id) END AS node, CASE WHEN count(*) = 1 THEN 'bound' ELSE 'ambiguous' END AS outcome FROM refs r JOIN functions f ON r.target = f.fingerprint GROUP BY r.id")
add("P-04_ladder", lambda m: outcomes(m).select("id", "node", "outcome", "tier"), f"WITH {LADDER} SELECT id, node, outcome, tier FROM o")
add("P-05_suffix_tier", lambda m: P.ladder([P.by_suffix(m.functions.select("id", F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".rs")).alias("t")), m.nodes.where("kind = 'function'"), "t", "file_path")]).select("ref", "node"),
    "SELECT f.id AS ref, n.id AS node FROM functions f JOIN nodes n ON n.kind = 'function' AND n.file_path LIKE '%/f' || f.id || '.rs'")
add("P-07_symbol_exact", lambda m: P.by_key(m.refs, m.nodes, F.col("source_symbol"), F.col("symbol")), "SELECT r.id AS ref, n.id AS node FROM refs r JOIN nodes n ON r.source_symbol = n.symbol")
add("P-12_affected", lambda m: P.affected(m.refs, "source_symbol", m.functions.where("id % 10 = 0").select("name")).select("id"), "SELECT r.id FROM refs r JOIN functions f ON r.source_symbol = 'fn/' || f.name WHERE f.id % 10 = 0")
# A sync that touched file 7, some of the functions, and what three aliases in a row of file 4 lead to.
SYNC_REFS = "SELECT id AS ref, file, target, CASE WHEN id % 50 = 0 THEN 'artifact_ref' ELSE 'calls' END AS kind, block FROM path_refs"
SYNC_NAMES = "SELECT DISTINCT 'f' || cast(block AS varchar(9)) AS name FROM path_refs WHERE block % 5 = 2 UNION ALL SELECT 'q4'"
SYNC_ALIASES = """SELECT DISTINCT file, alias, CASE alias WHEN 'al' THEN 'be::x' WHEN 'be' THEN 'ce::y' ELSE 'm9::q' || cast(file AS varchar(3)) END AS target FROM path_refs,
    (SELECT 'al' AS alias UNION ALL SELECT 'be' UNION ALL SELECT 'ce') a"""
add(
    "P-12_delta_selection",
    lambda m: P.delta_affected(m.sql(SYNC_REFS), m.sql(SYNC_NAMES), m.sql("SELECT DISTINCT file FROM path_refs WHERE file = 7"), m.sql(SYNC_ALIASES)),
    f"""SELECT * FROM (SELECT ref, CASE WHEN file = 7 THEN 'file' WHEN kind = 'artifact_ref' THEN 'artifact' WHEN ref % 8 <> 7 AND block % 5 = 2 THEN 'name'
    WHEN target LIKE 'al::%' AND file = 4 THEN 'alias' END AS reason FROM ({SYNC_REFS})) WHERE reason IS NOT NULL""",
)
add("P-13_ledger", lambda m: outcomes(m).select("id", (F.col("outcome") == "bound").alias("resolved")), f"WITH {LADDER} SELECT id, outcome = 'bound' AS resolved FROM o")
add("P-15_topic_promotion", lambda m: P.promoted(m.usage.select(F.col("tool").alias("name"), F.col("surface").alias("member")), "topic"), "SELECT 'topic/' || tool AS symbol, 'topic' AS kind, tool AS name, count(DISTINCT surface) AS members FROM usage GROUP BY tool")
add("P-16_dispatch_markers", lambda m: m.functions.where("exported and not is_test").select("id").subtract(m.functions.where("is_duplicate").select("id")), "SELECT id FROM functions WHERE exported AND NOT is_test AND NOT is_duplicate")
add("P-18_referencing_docs", lambda m: m.only("edges", "kind = 'doc_reference'").join(m.nodes.select(F.col("id").alias("target"), "symbol"), "target").groupBy("symbol").agg(F.count("*").alias("docs")), "SELECT symbol, count(*) AS docs FROM edges e JOIN nodes n ON e.target = n.id WHERE e.kind = 'doc_reference' GROUP BY symbol")
add(
    "P-19_doc_kinds",
    lambda m: m.sql(DOC_FILES).select("doc_id", P.doc_kind(F.col("path"), F.col("heading")).alias("kind")),
    f"""SELECT doc_id, CASE WHEN heading IS NOT NULL THEN CASE doc_id % 5 WHEN 0 THEN 'story' WHEN 1 THEN 'doc_section' WHEN 2 THEN 'story' ELSE 'doc_section' END
    ELSE CASE doc_id % 6 WHEN 0 THEN 'requirement' WHEN 1 THEN 'requirement' WHEN 2 THEN 'decision' ELSE 'doc_file' END END AS kind FROM ({DOC_FILES})""",
)
add("D-29_relation_coverage", lambda m: P.relation_coverage(outcomes(m)), f"WITH {LADDER} SELECT payload, count(*) FILTER (outcome = 'bound') AS bound, count(*) FILTER (outcome <> 'bound') AS unresolved FROM o WHERE payload IS NOT NULL GROUP BY payload")
add("D-30_resolution_ratio", lambda m: P.resolution_ratio(outcomes(m)).select(F.round(F.col("ratio") * 10000).cast("bigint").alias("ratio_bp")), f"WITH {LADDER} SELECT CAST(round(avg(CAST(outcome = 'bound' AS INT)) * 10000) AS BIGINT) AS ratio_bp FROM o")
add(
    "P-01_index",
    lambda m: reduce(
        lambda a, b: a.unionByName(b),
        [t.groupBy("key").agg(F.countDistinct("node").alias("n")).agg(F.lit(k).alias("index"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("ambiguous")) for k, t in P.binding_index(m.nodes, m.edges).items()],
    ),
    """WITH t AS (SELECT 'symbol' AS index, symbol AS key, id AS node FROM nodes UNION ALL SELECT 'name', name, id FROM nodes UNION ALL SELECT 'file', file_path, id FROM nodes
    UNION ALL SELECT 'module', lower(name), id FROM nodes WHERE kind = 'module' UNION ALL SELECT 'scope', CAST(source AS VARCHAR), target FROM edges WHERE kind = 'contains'),
    k AS (SELECT index, key, count(DISTINCT node) AS n FROM t WHERE key IS NOT NULL GROUP BY ALL)
    SELECT i AS index, count(key) AS keys, count(*) FILTER (n > 1) AS ambiguous FROM (SELECT unnest(['symbol', 'name', 'file', 'route', 'module', 'scope', 'implements']) AS i) LEFT JOIN k ON i = index GROUP BY i""",
)
def index(m):
    aliases = m.spark.range(10).select(F.col("id").alias("file"), F.explode(F.array(F.struct(F.lit("al").alias("alias"), F.lit("deep_al::m3").alias("target")), F.struct(F.lit("deep_al").alias("alias"), F.lit("c1").alias("target"))))).select("file", "col.*")
    globs = m.spark.range(10).select(F.col("id").alias("file"), F.lit("c0::m1").alias("target"))
    return P.Index(m.item_modules, m.items, aliases, globs)


def path_found(m, policy):
    refs = m.path_refs.select(F.col("id").alias("ref"), "file", "crate", "path", "target", F.lit("callable").alias("want"))
    return refs.select("ref"), P.path_candidates(refs, index(m), policy)


def outcome(refs, candidates):
    return refs.join(P.decided(candidates), "ref", "left").select("ref", "node", F.coalesce("outcome", F.lit("not_found")).alias("outcome"))


def path_outcomes(m, policy):
    return outcome(*path_found(m, policy))


# Of the twelve items of a block, that with crate a and module b is the one with the remainder (4a + 9b) % 12.
BOUND = """r AS (SELECT id, block, id % 8 AS form, id % (SELECT count(*) FROM supplier) AS s FROM path_refs),
    x AS (SELECT id, form, CASE form WHEN 0 THEN 12 * block + (4 * (id % 3) + 18) % 12 WHEN 1 THEN 12 * block + (4 * (id % 3) + 9 * (id % 4)) % 12
    WHEN 2 THEN 12 * block + (4 * (id % 3) + 9) % 12 WHEN 4 THEN 12 * block + (4 + 27) % 12 WHEN 5 THEN 12 * block + 8 % 12 WHEN 6 THEN 12 * block + (4 * (id % 3) + 27) % 12
    WHEN 7 THEN CASE WHEN s % 3 = 1 THEN 2000000 + s END END AS node FROM r)"""
add(
    "P-04_path_ladder",
    lambda m: path_outcomes(m, "balanced"),
    f"WITH {BOUND} SELECT id AS ref, node, CASE WHEN node IS NULL THEN 'not_found' ELSE 'bound' END AS outcome FROM x",
)
def name_found(m, policy):
    """Names of a class's first member, of any function, of an alias, and of what a whole import brings, by turns."""
    own = m.owners.groupBy("supplier").agg(F.min("part").alias("first"))
    refs = m.path_refs.join(m.owners.join(own, "supplier").select(F.col("part").alias("id"), "first"), "id").select(
        F.col("id").alias("ref"), F.col("id").alias("source"), "file", "crate", "path", F.lit("callable").alias("want"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("fn"), F.col("first").cast("string")))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("s"), (1 + F.col("id") % 9).cast("string")))
        .when(F.col("id") % 4 == 2, F.lit("short"))
        .otherwise(F.concat(F.lit("f"), F.col("block").cast("string"))).alias("target"),
    )
    ix = index(m)
    ix = P.Index(ix.modules, ix.members, ix.aliases.unionByName(m.spark.range(10).select(F.col("id").alias("file"), F.lit("short").alias("alias"), F.lit("c2::m1::f3").alias("target"))), ix.globs)
    return refs.select("ref"), P.name_candidates(refs, ix, m.nodes, m.only("edges", "kind = 'contains'"), policy)


def name_outcomes(m, policy):
    return outcome(*name_found(m, policy))


def by_policy(m):
    """References by form, policy and outcome; what a form may lead to is looked up once."""
    out = []
    for form, found, policies in (("path", path_found, P.POLICIES), ("name", name_found, P.POLICIES[1:])):
        refs, candidates = found(m, P.POLICIES[-1])
        candidates = cut(candidates)
        out += [outcome(refs, P.allowed(candidates, p)).groupBy(F.lit(form).alias("form"), F.lit(p).alias("policy"), "outcome").agg(F.count("*").alias("n")) for p in policies]
    return reduce(lambda a, b: a.unionByName(b), out)


NAMED = """o AS (SELECT part, min(part) OVER (PARTITION BY supplier) AS first FROM owners),
    y AS (SELECT id, CASE id % 4 WHEN 0 THEN first WHEN 1 THEN CASE WHEN {aggressive} THEN 2000001 + id % 9 END WHEN 2 THEN 36 + (8 + 9) % 12 ELSE 12 * block + 9 END AS node FROM path_refs JOIN o ON id = part)"""
add(
    "P-05_name_ladder",
    lambda m: name_outcomes(m, "balanced"),
    f"WITH {NAMED.format(aggressive='false')} SELECT id AS ref, node, CASE WHEN node IS NULL THEN 'not_found' ELSE 'bound' END AS outcome FROM y",
)
add(
    "P-06_policies",
    by_policy,
    f"""WITH {BOUND}, {NAMED.format(aggressive="policy = 'aggressive'").replace('FROM path_refs JOIN o ON id = part', ', policy FROM path_refs JOIN o ON id = part, q').replace('o AS (', "q AS (SELECT unnest(['strict', 'balanced', 'aggressive']) AS policy), o AS (")}
    SELECT 'path' AS form, policy, CASE WHEN node IS NULL OR (policy = 'strict' AND form = 7) THEN 'not_found' ELSE 'bound' END AS outcome, count(*) AS n FROM x, q GROUP BY ALL
    UNION ALL SELECT 'name', policy, CASE WHEN node IS NULL THEN 'not_found' ELSE 'bound' END, count(*) FROM y WHERE policy <> 'strict' GROUP BY ALL""",
)
add(
    "P-08_member_access",
    lambda m: P.member_access(m.functions.select(F.col("id").alias("ref"), F.col("id").alias("source"), F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("field")), m.nodes, m.edges),
    """WITH f AS (SELECT f.id, o.supplier, 'f' || (f.id % 5) AS field FROM functions f LEFT JOIN owners o ON f.id = o.part)
    SELECT f.id AS ref, n.id AS node, CASE WHEN n.id IS NULL THEN 'not_found' ELSE 'bound' END AS outcome FROM f LEFT JOIN nodes n ON n.symbol = 'field/' || f.supplier || '.' || (f.id % 5)""",
)
