"""The engine's fact tables, projected from the relational test tables.

Each projection is one SQL text that Spark and DuckDB both take; ``EPOCH(x)`` stands for
seconds since 1970. Users with real fact tables pass those to the operators instead.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.shared import numbered, written
from codeloom.operators.textindex import TextIndex
from codeloom.operators.traverse import Adjacency, adjacency

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
PATH = "'src/m' || cast({p} % 25 AS varchar(9)) || '/f' || cast({p} AS varchar(9)) || '.rs'"

PROJECTIONS = {
    "head": "SELECT max(EPOCH(o_orderdate)) AS head_at FROM orders",
    "commits": """SELECT 'c' || cast(o_orderkey AS varchar(12)) AS sha, o_orderkey AS seq, EPOCH(o_orderdate) AS committed_at,
        'author' || cast(o_custkey AS varchar(12)) AS author_name, 'a' || cast(o_custkey AS varchar(12)) || '@x' AS author_email,
        CASE o_orderkey % 8 WHEN 0 THEN 'Fixes ' WHEN 1 THEN 'HOTFIX: ' WHEN 2 THEN 'a bug in ' WHEN 3 THEN 'prefix of ' WHEN 4 THEN 'fixe '
            WHEN 5 THEN 'debug ' WHEN 6 THEN 'fix' ELSE '' END || o_orderpriority AS subject, coalesce(n, 0) AS file_count
        FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "file_changes": f"""SELECT 'c' || cast(l_orderkey AS varchar(12)) AS commit_sha, {PATH.format(p='l_partkey')} AS path,
        nullif(cast(sum(l_quantity) AS bigint), 17) AS added, nullif(cast(sum(l_linenumber) AS bigint), 9) AS deleted
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "shipped": "SELECT DISTINCT l_partkey FROM lineitem, head WHERE EPOCH(l_shipdate) >= head_at - 31536000",
    "functions": f"""SELECT p.p_partkey AS id, 'fn' || cast(p.p_partkey AS varchar(9)) AS name,
        CASE WHEN p.p_partkey % 7 = 0 THEN 'method' ELSE 'function' END AS kind, {PATH.format(p='p.p_partkey')} AS file_path,
        nullif(cast(p.p_size AS bigint), 13) AS cc, cast(floor(p.p_retailprice) AS bigint) - 850 AS line_count, cast(p.p_size % 6 AS bigint) AS nesting,
        p.p_brand || '|' || p.p_type || '|' || cast(p.p_size AS varchar(4)) AS fingerprint,
        CASE WHEN p.p_size = 29 THEN NULL ELSE s.l_partkey IS NULL END AS is_dead,
        count(*) OVER (PARTITION BY p.p_brand, p.p_type, p.p_size) >= 2 AS is_duplicate, p.p_partkey % 11 = 0 AS is_test,
        CASE WHEN count(*) OVER (PARTITION BY p.p_brand, p.p_type, p.p_size) >= 2 AND p.p_size % 2 = 0
            THEN min(p.p_partkey) OVER (PARTITION BY p.p_brand, p.p_type, p.p_size) END AS clone_group,
        p.p_partkey % 3 = 0 AS exported
        FROM part p LEFT JOIN shipped s ON p.p_partkey = s.l_partkey""",
    "owners": "SELECT l_partkey AS part, min(l_suppkey) AS supplier FROM lineitem GROUP BY l_partkey",
    "nodes": f"""SELECT id, 'fn/' || name AS symbol, kind, name, file_path, cast(id % 90 AS bigint) AS start_line, exported, is_test, is_dead, fingerprint, false AS derived FROM functions
        UNION ALL SELECT 1000000 + n_nationkey, 'mod/' || n_name, 'module', n_name, 'src/m' || cast(n_nationkey AS varchar(9)) || '/mod.rs', cast(1 AS bigint), true, false, NULL, NULL, false FROM nation
        UNION ALL SELECT 2000000 + s_suppkey, 'cls/' || s_name, CASE WHEN s_suppkey % 4 = 0 THEN 'struct' ELSE 'class' END, s_name,
            'src/m' || cast(s_nationkey AS varchar(9)) || '/s' || cast(s_suppkey AS varchar(9)) || '.rs', cast(5 AS bigint), true, s_suppkey % 17 = 0, NULL, NULL, false FROM supplier
        UNION ALL SELECT 3000000 + doc_id, 'doc/' || cast(doc_id AS varchar(9)), 'doc_section', 'section ' || cast(doc_id AS varchar(9)),
            CASE WHEN doc_id % 20 = 0 THEN NULL ELSE 'docs/' || source || '.md' END, cast(doc_id % 50 AS bigint), false, false, NULL, NULL, false FROM documents
        UNION ALL SELECT DISTINCT 5000000 + supplier * 10 + p_size % 5, 'field/' || cast(supplier AS varchar(9)) || '.' || cast(p_size % 5 AS varchar(3)), 'field',
            'f' || cast(p_size % 5 AS varchar(3)), 'src/m0/fields.rs', cast(1 AS bigint), false, false, cast(NULL AS boolean), cast(NULL AS varchar(9)), false FROM owners JOIN part ON part = p_partkey
        UNION ALL SELECT DISTINCT 6000000 + length(event_type), 'topic/' || event_type, 'topic', event_type, cast(NULL AS varchar(9)), cast(NULL AS bigint), false, false, cast(NULL AS boolean), cast(NULL AS varchar(9)), true FROM events""",
    "edges": """SELECT source, target, kind FROM (
        SELECT 1000000 + s_nationkey AS source, 2000000 + s_suppkey AS target, 'contains' AS kind FROM supplier
        UNION ALL SELECT 2000000 + supplier, part, 'contains' FROM owners
        UNION ALL SELECT DISTINCT 2000000 + supplier, 5000000 + supplier * 10 + p_size % 5, 'contains' FROM owners JOIN part ON part = p_partkey
        UNION ALL SELECT DISTINCT a.l_partkey, b.l_partkey, 'calls' FROM lineitem a JOIN lineitem b
            ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        UNION ALL SELECT DISTINCT 2000000 + a.l_suppkey, 2000000 + b.l_suppkey, 'references' FROM lineitem a JOIN lineitem b
            ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        UNION ALL SELECT part, 5000000 + supplier * 10 + p_size % 5, 'accesses' FROM owners JOIN part ON part = p_partkey
        UNION ALL SELECT 3000000 + doc_id, 1 + doc_id * 7 % parts, 'doc_reference' FROM documents, (SELECT count(*) AS parts FROM part) c)""",
    "files": """SELECT cast(row_number() OVER (ORDER BY path) AS bigint) AS id, path, md5(path) AS content_hash,
        CASE WHEN path LIKE '%.md' THEN 'markdown' ELSE 'rust' END AS language FROM (SELECT DISTINCT file_path AS path FROM nodes WHERE file_path IS NOT NULL)""",
    # A file imports what follows it in the last order that goes on after it: one import a file, with cycles and long chains.
    "imports": """SELECT DISTINCT f.source, f.target FROM (SELECT a.l_partkey AS source, b.l_partkey AS target, a.l_orderkey * 10 + a.l_linenumber AS at FROM lineitem a
        JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey) f
        JOIN (SELECT a.l_partkey AS source, max(a.l_orderkey * 10 + a.l_linenumber) AS at FROM lineitem a
        JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY a.l_partkey) g
        ON f.source = g.source AND f.at = g.at""",
    "file_modules": "SELECT id, id % 25 AS module, 'src/m' || cast(id % 25 AS varchar(9)) AS directory, file_path, id % 5 AS layer FROM functions",
    # Items by crate and module: of twelve parts in a row, which share a name, each has a crate and module of its own.
    "items": """SELECT p_partkey AS node, 'c' || cast(p_partkey % 3 AS varchar(3)) AS crate, 'm' || cast(p_partkey % 4 AS varchar(3)) AS path,
        'f' || cast(cast(floor(p_partkey / 12) AS bigint) AS varchar(9)) AS name, true AS callable, false AS type_like FROM part
        UNION ALL SELECT 2000000 + s_suppkey, 'c0', 'deep::x' || cast(s_suppkey % 3 AS varchar(3)), 's' || cast(s_suppkey AS varchar(9)), true, true FROM supplier""",
    "item_modules": """SELECT DISTINCT crate, path, 7000000 + cast(length(path) AS bigint) * 100 + cast(substr(crate, 2, 1) AS bigint) * 10 + cast(substr(path, length(path), 1) AS bigint) AS node FROM items
        UNION ALL SELECT DISTINCT crate, '', 7900000 + cast(substr(crate, 2, 1) AS bigint) FROM items""",
    "path_refs": """SELECT p_partkey AS id, 'c' || cast(p_partkey % 3 AS varchar(3)) AS crate, 'm' || cast(p_partkey % 4 AS varchar(3)) AS path, p_partkey % 10 AS file, block,
        CASE p_partkey % 8 WHEN 0 THEN 'crate::m2::f' || cast(block AS varchar(9)) WHEN 1 THEN 'self::f' || cast(block AS varchar(9)) WHEN 2 THEN 'super::m1::f' || cast(block AS varchar(9))
        WHEN 3 THEN 'super::super::f' || cast(block AS varchar(9)) WHEN 4 THEN 'al::f' || cast(block AS varchar(9)) WHEN 5 THEN 'c2::m0::f' || cast(block AS varchar(9))
        WHEN 6 THEN 'm3::f' || cast(block AS varchar(9)) ELSE 'x1::s' || cast(p_partkey % suppliers AS varchar(9)) END AS target
        FROM (SELECT p_partkey, 1 + (p_partkey * 7) % (cast(floor(parts / 12) AS bigint) - 1) AS block, suppliers FROM part,
        (SELECT count(*) AS parts FROM part) n, (SELECT count(*) AS suppliers FROM supplier) k) b""",
    "usage": """SELECT EPOCH(ts) AS happened_at, 's' || cast(user_id % 4 AS varchar(3)) AS surface, event_type AS tool, cast(floor(value) AS bigint) AS duration_ms,
        event_type <> 'error' AS ok, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'agent' ELSE 'human' END AS origin FROM events""",
    "refs": """SELECT p_partkey AS id, 'fn/fn' || cast(p_partkey AS varchar(9)) AS source_symbol,
        p_brand || '|' || p_type || '|' || cast(CASE WHEN p_partkey % 10 = 0 THEN p_size + 50 ELSE p_size END AS varchar(4)) AS target,
        CASE WHEN p_partkey % 2 = 0 THEN 'calls' ELSE 'imports' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'http' WHEN p_partkey % 4 = 1 THEN 'grpc' END AS payload FROM part""",
    "coverage_lines": """SELECT l_suppkey AS file_id, l_orderkey * 10 + l_linenumber AS line_no, l_shipdate > TIMESTAMP '1995-01-01 00:00:00' AS second_report,
        cast(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 3 END AS bigint) AS hits FROM lineitem""",
    "coverage_files": """SELECT s_suppkey AS id, 'src/m' || cast(s_nationkey AS varchar(9)) || '/s' || cast(s_suppkey AS varchar(9)) || '.rs' AS path,
        CASE WHEN s_suppkey % 5 = 0 THEN 'old' ELSE md5('src/m' || cast(s_nationkey AS varchar(9)) || '/s' || cast(s_suppkey AS varchar(9)) || '.rs') END AS content_hash FROM supplier""",
    "snapshots": """SELECT cast(row_number() OVER (ORDER BY day) AS bigint) AS id, day, signal, nodes FROM (SELECT cast(floor(EPOCH(o_orderdate) / 2592000) AS bigint) AS day,
        CASE WHEN count(*) % 9 = 0 THEN NULL ELSE cast(5000 + sum(o_orderkey) % 5000 AS bigint) END AS signal, count(*) AS nodes FROM orders GROUP BY 1)""",
    "providers": """SELECT DISTINCT p_brand || '|' || p_type || '|' || cast(p_size AS varchar(4)) AS key, 'repo' || cast(n_regionkey AS varchar(3)) AS member, 'fn/' || cast(p_partkey AS varchar(9)) AS symbol
        FROM part JOIN owners ON p_partkey = part JOIN supplier ON supplier = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "consumers": """SELECT DISTINCT p_brand || '|' || p_type || '|' || cast(CASE WHEN l_linenumber = 7 THEN p_size + 50 ELSE p_size END AS varchar(4)) AS key,
        'repo' || cast(n_regionkey AS varchar(3)) AS member, 'use/' || cast(c_custkey AS varchar(9)) AS symbol
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    "anchors": """SELECT 'page' || cast(page_id AS varchar(9)) AS slug, cast(page_id % 3 AS bigint) AS ordinal, 'file' AS kind, 'docs/src' || cast(page_id % 22 AS varchar(4)) || '.md' AS entity_id,
        CASE WHEN page_id % 4 = 0 THEN 'old' ELSE md5('docs/src' || cast(page_id % 22 AS varchar(4)) || '.md') END AS content_hash FROM pages""",
}


# The files of the projection, before they are numbered.
FILES = """SELECT path, md5(path) AS content_hash, CASE WHEN path LIKE '%.md' THEN 'markdown' ELSE 'rust' END AS language
    FROM (SELECT DISTINCT file_path AS path FROM nodes WHERE file_path IS NOT NULL)"""


def _for(engine: str, text: str) -> str:
    if engine == "spark":
        text = re.sub(r"EPOCH\(([^)]*)\)", r"unix_timestamp(\1)", text)
        return text.replace("varchar(9)", "string").replace("varchar(12)", "string").replace("varchar(4)", "string").replace("varchar(3)", "string")
    return re.sub(r"EPOCH\(([^)]*)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)


# Written once for a folder, as an index would be, when first asked for; the other projections are plain views.
STORED = ("commits", "file_changes", "functions", "owners", "nodes", "edges", "imports", "files")
# Adjacency that searches start from, kept in buckets; each is made when it is first asked for.
ADJACENT = {
    "calls": "SELECT source, target FROM edges WHERE kind = 'calls'",
    "called": "SELECT target AS source, source AS target FROM edges WHERE kind = 'calls'",
    "around": "SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges",
    "imports_around": "SELECT source, target FROM imports UNION ALL SELECT target, source FROM imports",
}
# Text indexes: table, key and text. Nodes are found by their names.
TEXTS = {"documents": ("documents", "doc_id", "text"), "pages": ("pages", "page_id", "html"), "nodes": ("nodes", "id", "name")}
_texts: dict[tuple[str, str, str], TextIndex] = {}
_adjacent: dict[tuple[str, str, str], Adjacency] = {}
_viewed: dict[str, tuple[str, set[str]]] = {}  # by application, the folder that its views show, and the projections that it has


def imported(lines: DataFrame) -> DataFrame:
    """(source, target): the rows of the projection ``imports``, with one exchange of the order lines where its SQL joins them four times.

    Parts of the lines that follow are read within an order; of a source only what is last in a task is sent on, ties included.
    """
    rows = lines.where("l_orderkey is not null and l_linenumber is not null")
    rows = rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").alias("source"))
    after = Window.partitionBy("l_orderkey").orderBy("line").rangeBetween(1, 1)
    pairs = rows.withColumn("after", F.collect_list("source").over(after)).select("source", F.explode("after").alias("target"), (F.col("l_orderkey") * 10 + F.col("line")).alias("at"))
    last = F.rank().over(Window.partitionBy("source").orderBy(F.desc("at")))
    return pairs.where("source <> target").withColumn("_last", last).where("_last = 1").select("source", "target").distinct()


def named(text: str) -> list[str]:
    """The projections that a SQL text names."""
    return [name for name in PROJECTIONS if re.search(rf"\b{name}\b", text)]


class Model:
    """The base tables and projections of a folder, as DataFrames by attribute.

    They are temporary views of the session. A projection is made when a query first asks for
    it, with those that it is made from, so a query pays for nothing that it doesn't read.
    Another folder starts anew; a DataFrame that was made from a view stays with the
    folder it had then.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        app = spark.sparkContext.applicationId
        if app not in _viewed or _viewed[app][0] != sf_dir or not spark.catalog.tableExists(BASE[-1]):
            for t in BASE:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            _viewed[app] = (sf_dir, set())
        self._made = _viewed[app][1]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        self._make(name)
        return self.spark.table(name)

    def _make(self, name: str) -> None:
        if name not in PROJECTIONS or name in self._made:
            return
        if name == "files":  # numbered in the order of paths, as the SQL says, but not in one task
            table = numbered(self.sql(FILES), "path", "id")
        elif name == "imports":
            table = imported(self.lineitem)
        else:
            table = self.sql(PROJECTIONS[name])
        (written(table, f"model-{name}") if name in STORED else table).createOrReplaceTempView(name)
        self._made.add(name)

    def only(self, name: str, condition: str) -> DataFrame:
        """The rows of a projection under a condition on its kind: if it isn't there yet, what makes these rows and no others."""
        if name in self._made:
            return self.spark.table(name).where(condition)
        return self.inline(f"SELECT * FROM ({PROJECTIONS[name]}) WHERE {condition}")

    def inline(self, text: str) -> DataFrame:
        """The rows of a SQL text: projections that aren't there yet are part of the query and not stored, so that only the columns that it reads are made."""
        seen, parts = text, []
        while inner := [n for n in named(seen) if n not in self._made and n not in parts]:
            parts += inner
            seen = " ".join(PROJECTIONS[n] for n in inner)
        ordered = [n for n in PROJECTIONS if n in parts]  # a projection stands behind those that it is made from
        ctes = ", ".join(f"{n} AS ({_for('spark', PROJECTIONS[n])})" for n in ordered)
        return self.spark.sql(f"{f'WITH {ctes} ' if ctes else ''}{_for('spark', text)}")

    def paths(self) -> DataFrame:
        """(path): the paths of ``files``. Without their numbers there is nothing to sort or to store."""
        return (self.files if "files" in self._made else self.inline(FILES)).select("path")

    def adjacent(self, name: str) -> Adjacency:
        at = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if at not in _adjacent:
            _adjacent[at] = adjacency(self.sql(ADJACENT[name]))
        return _adjacent[at]

    def texts(self, name: str) -> TextIndex:
        at = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if at not in _texts:
            table, key, text = TEXTS[name]
            _texts[at] = TextIndex.build(getattr(self, table), key, text)
        return _texts[at]

    def sql(self, text: str) -> DataFrame:
        for name in named(text):
            self._make(name)
        return self.spark.sql(_for("spark", text))


def oracle(text: str) -> str:
    """DuckDB SQL with the projections that ``text`` needs in front of it."""
    need: list[str] = []

    def add(part: str) -> None:
        for name in PROJECTIONS:
            if re.search(rf"\b{name}\b", part) and name not in need:
                need.append(name)
                add(PROJECTIONS[name])

    add(text)
    ctes = [f"{n} AS ({_for('duckdb', PROJECTIONS[n])})" for n in PROJECTIONS if n in need]
    body = _for("duckdb", text).strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[len('with recursive'):]}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {', '.join(ctes)}, {body[4:]}"
    return f"WITH {', '.join(ctes)} {body}"
