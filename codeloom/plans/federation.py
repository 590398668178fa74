"""Queries between repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import federation as S
from codeloom.operators import resolution as Q
from codeloom.operators.globs import paired
from codeloom.operators.shared import fresh_path, written
from codeloom.plans.registry import add

SOLE = "sole AS (SELECT key, min(member) AS pm, min(symbol) AS ps FROM providers GROUP BY key HAVING count(*) = 1)"
BRIDGE = f"{SOLE}, b AS (SELECT key, member, symbol, pm AS to_member, ps AS to_symbol FROM consumers JOIN sole USING (key) WHERE member <> pm)"
OUT = "n AS (SELECT key, count(*) AS n, min(member) AS pm FROM providers GROUP BY key), o AS (SELECT c.*, CASE WHEN n IS NULL THEN 'no-provider' WHEN n > 1 THEN 'ambiguous' WHEN pm <> c.member THEN 'bound' END AS outcome FROM consumers c LEFT JOIN n USING (key))"
TOPICS = "SELECT tool AS topic, CASE WHEN ok THEN 'producer' ELSE 'consumer' END AS role, surface AS symbol FROM usage"


def bridges(m):
    return Q.bridge_exact(m.providers, m.consumers)


add("C-17_exactly_one_bridge", bridges, f"WITH {BRIDGE} SELECT * FROM b")
FAN = "SELECT split_part(key, '|', 1) AS key, member, symbol"
add("C-18_fan_out", lambda m: Q.bridge_fan_out(m.providers.withColumn("key", F.split("key", r"\|")[0]).select("key", "member", F.col("member").alias("symbol")), m.consumers.withColumn("key", F.split("key", r"\|")[0]).select("key", "member", F.col("member").alias("symbol"))).groupBy("key", "member", "to_member").agg(F.count("*").alias("n")),
    "SELECT DISTINCT split_part(c.key, '|', 1) AS key, c.member, p.member AS to_member, 1::BIGINT AS n FROM consumers c JOIN (SELECT DISTINCT split_part(key, '|', 1) AS key, member FROM providers) p ON split_part(c.key, '|', 1) = p.key WHERE c.member <> p.member")
# Five members that hold the functions; calls across members are bridges, some to symbols that are not there.
MEMBER_NODES = "SELECT 'repo' || cast(id % 5 AS varchar(3)) AS member, id, 'fn/' || name AS symbol, is_dead FROM functions"
MEMBER_EDGES = "SELECT 'repo' || cast(source % 5 AS varchar(3)) AS member, source, target, kind FROM edges WHERE kind = 'calls' AND source % 5 = target % 5"
MEMBER_BRIDGES = """SELECT DISTINCT 'repo' || cast(source % 5 AS varchar(3)) AS from_member, 'repo' || cast(target % 5 AS varchar(3)) AS to_member,
    CASE WHEN source % 7 = 0 THEN 'fn/gone' ELSE 'fn/fn' END || cast(target AS varchar(12)) AS symbol FROM edges WHERE kind = 'calls' AND source % 5 <> target % 5 AND source % 11 = 5"""
MEMBER_REACH = f"""WITH RECURSIVE mn AS ({MEMBER_NODES}), me AS ({MEMBER_EDGES}),
    seeds AS (SELECT s.member, s.symbol, n.id FROM (SELECT DISTINCT to_member AS member, symbol FROM ({MEMBER_BRIDGES})) s LEFT JOIN mn n ON s.member = n.member AND s.symbol = n.symbol),
    r AS (SELECT id FROM seeds WHERE id IS NOT NULL UNION SELECT target FROM r JOIN me ON id = source),
    v AS (SELECT member, id, id IN (SELECT id FROM r) AS promoted FROM mn WHERE is_dead)"""


def member_reach(m):
    return Q.member_reach(m.sql(MEMBER_NODES), m.sql(MEMBER_EDGES), m.sql(MEMBER_BRIDGES))


add("C-22_dead_reached", lambda m: member_reach(m)[0], f"{MEMBER_REACH} SELECT member, id, promoted FROM v")
add("Q-08_scoped_reach", lambda m: member_reach(m)[0].where("promoted and member = 'repo2'").select("id"), f"{MEMBER_REACH} SELECT id FROM v WHERE promoted AND member = 'repo2'")
add(
    "H-25_cross_service_reach",
    lambda m: member_reach(m)[1],
    f"""{MEMBER_REACH} SELECT member, count(*) AS nodes, (SELECT count(id) FROM seeds s WHERE s.member = mn.member) AS seeds,
    (SELECT count(*) FROM seeds s WHERE s.member = mn.member AND id IS NULL) AS unresolved,
    (SELECT count(*) FROM v WHERE v.member = mn.member AND promoted) AS promoted, (SELECT count(*) FROM v WHERE v.member = mn.member AND NOT promoted) AS dead FROM mn GROUP BY member""",
)
add("D-31_cross_coverage", lambda m: Q.cross_coverage(Q.consumer_outcomes(m.providers, m.consumers)), f"WITH {OUT} SELECT count(*) FILTER (outcome = 'bound') AS bound, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'no-provider') AS no_provider, CAST(round(count(*) FILTER (outcome = 'bound') / count(*) FILTER (outcome IN ('bound', 'ambiguous')) * 10000) AS BIGINT) AS bound_bp FROM o")
add("D-32_topic_inventory", lambda m: Q.topic_inventory(m.sql(f"SELECT DISTINCT tool AS topic FROM usage UNION ALL SELECT 'unused'"), m.sql(TOPICS)),
    f"SELECT t.topic, count(DISTINCT CASE WHEN role = 'producer' THEN symbol END) AS producers, count(DISTINCT CASE WHEN role = 'consumer' THEN symbol END) AS consumers FROM (SELECT DISTINCT tool AS topic FROM usage UNION ALL SELECT 'unused') t LEFT JOIN ({TOPICS}) l ON t.topic = l.topic GROUP BY t.topic")
def member_tables(m):
    """A folder for each member's providers; of one there is none."""
    folder = written(m.providers, "member-providers")
    paths = {f"repo{i}": folder.where(F.col("member") == f"repo{i}") for i in range(5)}
    return {**{name: (lambda rows=rows: rows.select("key", "symbol")) for name, rows in paths.items()}, "repo9": lambda: m.spark.read.parquet(fresh_path(m.spark, "no-such-member"))}


def fanned(m):
    rows, errors = S.fan_out(m.spark, member_tables(m), "key string, symbol string")
    counted = rows.groupBy("member").agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("error"))
    return counted.unionByName(errors.select("member", F.lit(0).cast("bigint").alias("n"), "error"))


add("Q-01_fan_out_members", fanned, "SELECT member, count(*) AS n, NULL AS error FROM providers GROUP BY member UNION ALL SELECT 'repo9', 0, 'PATH_NOT_FOUND'")
add("Q-02_contract_surface", lambda m: m.providers.groupBy("member").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("endpoints")), "SELECT member, count(DISTINCT key) AS keys, count(*) AS endpoints FROM providers GROUP BY member")
add("Q-04_bridge_counts", lambda m: bridges(m).groupBy("member", "to_member").agg(F.count("*").alias("n")), f"WITH {BRIDGE} SELECT member, to_member, count(*) AS n FROM b GROUP BY ALL")
add("Q-05_endpoint_dedup", lambda m: m.consumers.withColumn("key", F.split("key", r"\|")[0]).dropDuplicates(["key", "member"]).select("key", "member"), "SELECT DISTINCT split_part(key, '|', 1) AS key, member FROM consumers")
add("Q-06_outcomes", lambda m: Q.consumer_outcomes(m.providers, m.consumers), f"WITH {OUT} SELECT key, member, symbol, outcome FROM o")
add("Q-07_cross_callers", lambda m: bridges(m).where("to_member = 'repo2'").select("symbol", "to_symbol").orderBy("symbol", "to_symbol").limit(50), f"WITH {BRIDGE} SELECT symbol, to_symbol FROM b WHERE to_member = 'repo2' ORDER BY 1, 2 LIMIT 50")
add("Q-07_route_providers", lambda m: bridges(m).groupBy("to_member", "to_symbol").agg(F.countDistinct("member").alias("members")), f"WITH {BRIDGE} SELECT to_member, to_symbol, count(DISTINCT member) AS members FROM b GROUP BY ALL")
add(
    "Q-09_service_boundaries",
    lambda m: paired(bridges(m), [("repo1", "repo[!2]"), ("repo*", "repo{4,9}")], "member", "to_member").groupBy("rule", "member").agg(F.count("*").alias("n")),
    f"""WITH {BRIDGE} SELECT 'repo* -> repo{{4,9}}' AS rule, member, count(*) AS n FROM b WHERE to_member = 'repo4' GROUP BY member
    UNION ALL SELECT 'repo1 -> repo[!2]', member, count(*) FROM b WHERE member = 'repo1' AND to_member <> 'repo2' GROUP BY member""",
)
