"""Queries of text search and near clones."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import search as I
from codeloom.operators.relational import resolve_symbol
from codeloom.plans.registry import add

DOCS = "SELECT doc_id, text AS body FROM documents"
POST = f"d AS ({DOCS}), p AS (SELECT doc_id AS key, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+') AS w FROM d))"
LEN = "len AS (SELECT key, count(*) AS n FROM p GROUP BY key), stat AS (SELECT count(*) AS docs, avg(n) AS mean FROM len)"
RANK = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))"
SETS = """w AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT key, list_transform(range(1, len(w) - 3), lambda i: substr(md5(array_to_string(w[i:i+4], ' ')), 1, 15)) AS g FROM w WHERE len(w) >= 5),
    s AS (SELECT DISTINCT key, g[p] AS hash FROM (SELECT key, g, unnest(list_transform(range(0, greatest(len(g) - 4, 0) + 1), lambda i: i + len(g[i+1:i+4]) - list_position(list_reverse(g[i+1:i+4]), list_min(g[i+1:i+4])) + 1)) AS p FROM g))"""


def sets(m):
    return I.shingle_sets(m.documents, "doc_id", "text")


def numbers(m):
    """The same sets; 15 hexadecimal digits are a whole number, of half the bytes."""
    return sets(m).select("key", F.conv("hash", 16, 10).cast("bigint").alias("hash"))


add("I-01_postings", lambda m: m.texts("documents").counts(), f"WITH {POST} SELECT token, count(DISTINCT key) AS df, count(*) AS cf FROM p GROUP BY token")
add("I-02_phrase_search", lambda m: m.texts("documents").search("of the").select("key", F.round("score", 6).alias("score")),
    f"WITH {POST}, {LEN}, h AS (SELECT a.key, count(*) AS tf FROM p a JOIN p b ON a.key = b.key AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY a.key), f AS (SELECT count(*) AS df FROM h) SELECT key, round({RANK}, 6) AS score FROM h JOIN len USING (key), stat, f ORDER BY round({RANK}, 9) DESC, key LIMIT 20")
add("I-03_prefix_search", lambda m: m.texts("documents").with_prefixes(["thr", "ouer", "zz"]), f"WITH {POST} SELECT key, count(*) AS tf FROM p WHERE starts_with(token, 'thr') OR starts_with(token, 'ouer') OR starts_with(token, 'zz') GROUP BY key")
add("I-04_suggestions", lambda m: I.suggestions(m.nodes, "fn19"), "SELECT DISTINCT name FROM nodes WHERE starts_with(lower(name), 'fn19') ORDER BY 1 LIMIT 5")
add("I-05_resolve_symbol", lambda m: resolve_symbol(m.nodes, "f3").select("id", "symbol"), "SELECT id, symbol FROM nodes WHERE symbol = 'f3' OR name = 'f3' ORDER BY symbol <> 'f3', id LIMIT 1")
add("I-06_page_search", lambda m: m.texts("pages").search("the").select("key", F.round("score", 6).alias("score")),
    f"""WITH p AS (SELECT page_id AS key, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT page_id, regexp_extract_all(lower(html), '[\\p{{L}}\\p{{N}}_]+') AS w FROM pages)), {LEN}, h AS (SELECT key, count(*) AS tf FROM p WHERE token = 'the' GROUP BY key), f AS (SELECT count(*) AS df FROM h)
    SELECT key, round({RANK}, 6) AS score FROM h JOIN len USING (key), stat, f ORDER BY round({RANK}, 9) DESC, key LIMIT 20""")
# Documents that the index has lost, and others that it was never told are gone.
add(
    "I-07_index_check",
    lambda m: m.texts("documents").updated(deleted=m.documents.where("doc_id % 97 = 5").select(F.col("doc_id").alias("key"))).faults(m.documents.where("doc_id % 89 <> 3"), "doc_id", "text"),
    f"WITH {POST} SELECT 'extra' AS fault, count(*) AS n FROM p WHERE key % 89 = 3 AND key % 97 <> 5 UNION ALL SELECT 'missing', count(*) FROM p WHERE key % 97 = 5 AND key % 89 <> 3",
)
add("O-02_shingles", lambda m: sets(m).groupBy("key").agg(F.count("*").alias("n"), F.min("hash").alias("least")), f"WITH {SETS} SELECT key, count(*) AS n, min(hash) AS least FROM s GROUP BY key")
add("A-06_shingle_scan", lambda m: sets(m).orderBy("key", "hash"), f"WITH {SETS} SELECT key, hash FROM s")
add("O-03_eligible", lambda m: sets(m).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= I.least_shingles(50)), f"WITH {SETS} SELECT key, count(*) AS n FROM s GROUP BY key HAVING count(*) >= 11")
PAIRS = "n AS (SELECT key, count(*) AS n FROM s GROUP BY key HAVING count(*) >= 11), c AS (SELECT x.key AS a, y.key AS b, count(*) AS shared FROM s x JOIN s y ON x.hash = y.hash AND x.key < y.key GROUP BY ALL), pr AS (SELECT a, b, shared FROM c JOIN n na ON a = na.key JOIN n nb ON b = nb.key WHERE shared / (na.n + nb.n - shared) >= 0.85)"
add("O-04_clone_pairs", lambda m: I.clone_pairs(numbers(m), 0.85, 11).select("a", "b", "shared"), f"WITH {SETS}, {PAIRS} SELECT a, b, shared FROM pr")
add(
    "O-05_clone_groups",
    lambda m: I.near_clones(m.documents.select(F.col("doc_id").alias("key")), numbers(m), 0.85, 11),
    f"""WITH RECURSIVE {SETS}, {PAIRS}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, c FROM r JOIN e ON r.id = e.a),
    gr AS (SELECT id, min(c) AS c FROM r GROUP BY id) SELECT doc_id AS key, c AS clone_group FROM documents LEFT JOIN gr ON doc_id = id""",
)
add("O-06_exact_duplicates", lambda m: m.nodes.select("id", I.exact_duplicates(m.nodes, "fingerprint").alias("is_duplicate")), "SELECT id, CASE WHEN fingerprint IS NOT NULL THEN count(*) OVER (PARTITION BY fingerprint) >= 2 END AS is_duplicate FROM nodes")
add(
    "H-23_clone_components",
    lambda m: I.near_clones(m.documents.select(F.col("doc_id").alias("key")), numbers(m), 0.85, 11)
    .where("clone_group is not null").groupBy(F.col("clone_group").alias("component")).agg(F.count("*").alias("n")),
    f"""WITH RECURSIVE {SETS}, {PAIRS}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, c FROM r JOIN e ON r.id = e.a),
    gr AS (SELECT id, min(c) AS c FROM r GROUP BY id) SELECT c AS component, count(*) AS n FROM gr GROUP BY c""",
)
