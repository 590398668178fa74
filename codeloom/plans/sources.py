"""Queries of readers, on texts made from the test tables: a file, report or record for every row."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from codeloom.operators import resolution as R
from codeloom.operators.shared import fresh_path, spread
from codeloom.plans.registry import add
from codeloom.sources import readers as S

# History logs


def log(m):
    """The log that the commits and changes of all orders would give."""
    some = m.commits.join(m.file_changes, F.expr("sha = commit_sha"), "left")
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.when(F.col("path").isNotNull(), F.concat_ws("\t", count("added"), count("deleted"), "path"))
    fields = F.concat_ws(S.UNIT, "sha", F.col("committed_at").cast("string"), "author_name", "author_email", "subject")
    rows = some.groupBy("sha", "committed_at", "author_name", "author_email", "subject").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return rows.select(F.concat(F.lit(S.RECORD), fields, F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("value"))


add(
    "A-18_commits",
    lambda m: S.parse_log(log(m))[0],
    "SELECT sha, committed_at, author_name, author_email, subject, CAST(file_count AS BIGINT) AS file_count FROM commits",
)
add(
    "A-18_changes",
    lambda m: S.parse_log(log(m))[1],
    "SELECT commit_sha, path, added, deleted, NULL::VARCHAR AS old_path FROM file_changes JOIN commits ON sha = commit_sha",
)

# Coverage reports: one for each file and run, so a report is as long as its file


def lcov(m):
    line = F.concat(F.lit("DA:"), F.col("line_no").cast("string"), F.lit(","), F.col("hits").cast("string"))
    lines = m.coverage_lines.groupBy("file_id", "second_report").agg(F.array_join(F.collect_list(line), "\n").alias("da"))
    name = F.col("file_id").cast("string")
    text = F.concat(F.lit("TN:\nSF:src/f"), name, F.lit(".rs\n"), F.col("da"), F.lit("\nend_of_record\n"))
    return lines.select(F.concat(name, F.when(F.col("second_report"), "-b").otherwise("-a")).alias("report"), text.alias("text"))


def cobertura(m):
    """One in two reports is broken off."""
    line = F.concat(F.lit('<line number="'), F.col("line_no").cast("string"), F.lit('" hits="'), F.col("hits").cast("string"), F.lit('"/>'))
    lines = m.coverage_lines.groupBy("file_id").agg(F.array_join(F.collect_list(line), "").alias("l"))
    name = F.col("file_id").cast("string")
    end = F.when(F.col("file_id") % 2 == 0, "</lines></class></coverage>").otherwise("</lines></coverage>")
    text = F.concat(F.lit('<?xml version="1.0"?><coverage><class filename="src/f'), name, F.lit('.rs"><lines>'), F.col("l"), end)
    return lines.select(F.concat(F.lit("r"), name).alias("report"), text.alias("text"))


add(
    "A-19_lcov",
    lambda m: S.parse_lcov(lcov(m), "report", "text"),
    """SELECT file_id || CASE WHEN second_report THEN '-b' ELSE '-a' END AS report, 'src/f' || file_id || '.rs' AS path, line_no, max(hits) AS hits
    FROM coverage_lines GROUP BY 1, 2, 3""",
)
add(
    "A-20_cobertura",
    lambda m: S.parse_cobertura(cobertura(m), "report", "text"),
    "SELECT 'r' || file_id AS report, 'src/f' || file_id || '.rs' AS path, line_no, max(hits) AS hits FROM coverage_lines WHERE file_id % 2 = 0 GROUP BY 1, 2, 3",
)
add(
    "A-21_sniff",
    lambda m: lcov(m).union(cobertura(m)).union(m.pages.select(F.col("url"), "html")).select("report", S.sniff_coverage(F.col("text")).alias("format")),
    """SELECT DISTINCT file_id || CASE WHEN second_report THEN '-b' ELSE '-a' END AS report, 'lcov' AS format FROM coverage_lines
    UNION ALL SELECT DISTINCT 'r' || file_id, 'cobertura' FROM coverage_lines UNION ALL SELECT url, NULL FROM pages""",
)
PLACES = """SELECT CASE o_orderkey % 9 WHEN 0 THEN 'lcov.info' WHEN 1 THEN 'x/lcov.info' WHEN 2 THEN 'coverage/cobertura-coverage.xml' WHEN 3 THEN 'coverage/cobertura.xml'
    WHEN 4 THEN 'target/llvm-cov/cobertura.xml' WHEN 5 THEN 'target/coverage/lcov.info' WHEN 6 THEN 'out/cov/a.xml' WHEN 7 THEN 'out/b.xml' ELSE 'coverage.xml' END AS path,
    o_custkey % 7 AS member, EPOCH(o_orderdate) + o_orderkey AS stamp FROM orders"""


def newest(m, configured):
    out = None
    for i in range(7):
        one = S.newest_report(m.sql(PLACES).where(f"member = {i}").select("path", F.col("stamp").alias("modificationTime")), configured).withColumn("member", F.lit(i))
        out = one if out is None else out.union(one)
    return out


add(
    "A-22_newest_report",
    lambda m: newest(m, ("out/*.xml",)),
    f"""SELECT path, stamp AS "modificationTime", CAST(member AS INTEGER) AS member FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY stamp DESC, path) AS r FROM ({PLACES})
    WHERE path IN ('lcov.info', 'coverage.xml', 'coverage/cobertura-coverage.xml', 'coverage/lcov.info', 'target/llvm-cov/cobertura.xml', 'target/llvm-cov/lcov.info') OR path LIKE 'out/%.xml') WHERE r = 1""",
)

# Source trees


def tree(m):
    """A folder for each module of functions, with one file of their names."""
    path = fresh_path(m.spark, "tree")
    rows = m.functions.select(F.concat(F.lit("m"), (F.col("id") % 25).cast("string")).alias("dir"), F.concat("name", F.lit(" é")).alias("value"))
    rows.repartition("dir").sortWithinPartitions("dir", "value").write.partitionBy("dir").text(path)
    return path


TREE = """SELECT 'm' || (id % 25) AS dir, string_agg(name || ' é', chr(10) ORDER BY name || ' é') || chr(10) AS content FROM functions GROUP BY 1"""


def folder():
    return F.regexp_extract("path", r"^dir=(\w+)/", 1).alias("dir")


add(
    "A-12_tree_scan",
    lambda m: S.read_tree(m.spark, tree(m), ["dir=m1*/**", "dir=m{2,3}/*.txt"], ["dir=m11/**"], ignore=["dir=m12/", "dir=m13/*", "!dir=m13/*.txt"]).select(folder()),
    f"SELECT dir FROM ({TREE}) WHERE (dir LIKE 'm1%' AND dir NOT IN ('m11', 'm12')) OR dir IN ('m2', 'm3')",
)
add(
    "A-13_file_load",
    lambda m: S.read_tree(m.spark, tree(m), most_bytes=1 << 16).select(folder(), "content_hash", F.length("content").alias("characters")),
    f"SELECT dir, sha256(content) AS content_hash, length(content) AS characters FROM ({TREE}) WHERE octet_length(encode(content)) <= 65536",
)


def parts(m):
    """Parts as files are made from them, dealt to all cores: one task reads their file, and the texts that come of it are parsed."""
    return spread(m.part.select("p_partkey", "p_size"))


def from_parts(m, text):
    """The rows of a SQL text over parts, dealt likewise."""
    spread(m.part.select("p_partkey", "p_size", "p_brand")).createOrReplaceTempView("dealt_parts")
    return m.sql(re.sub(r"\bFROM part$", "FROM dealt_parts", text))


def python_files(m):
    k = F.col("p_partkey").cast("string")
    branches = F.repeat(F.lit("        if os.x:\n            pass\n"), (F.col("p_size") % 4).cast("int"))
    text = F.concat(F.lit("import os\n\nclass C"), k, F.lit(":\n    def m(self):\n"), branches, F.lit("        return g"), k, F.lit("()\n"))
    return parts(m).select(F.concat(F.lit("p"), k, F.lit(".py")).alias("path"), text.alias("content"))


add(
    "A-14_python_facts",
    lambda m: S.extract_facts(python_files(m)).select("path", "kind", "name", "parent", "line", "cc", "nesting"),
    """WITH p AS (SELECT p_partkey AS k, p_size % 4 AS b FROM part), f AS (SELECT k, 'module' AS kind, 'p' || k AS name, '' AS parent, 1 AS line, NULL::BIGINT AS cc, NULL::BIGINT AS nesting FROM p
    UNION ALL SELECT k, 'import', 'os', '', 1, NULL, NULL FROM p UNION ALL SELECT k, 'class', 'C' || k, '', 3, NULL, NULL FROM p
    UNION ALL SELECT k, 'method', 'm', 'C' || k, 4, 1 + b, CASE WHEN b > 0 THEN 1 ELSE 0 END FROM p UNION ALL SELECT k, 'call', 'g' || k, 'C' || k || '.m', 5 + 2 * b, NULL, NULL FROM p)
    SELECT 'p' || k || '.py' AS path, kind, name, parent, line, cc, nesting FROM f""",
)
# Extension, text and what it declares; % stands for the part's key.
LANGUAGES = {
    "rs": ("pub fn go%() {}\nstruct S%;\n", [("function", "go%", 1), ("struct", "S%", 2)]),
    "go": ("func Go%() {}\ntype T% struct {}\n", [("function", "Go%", 1), ("type", "T%", 2)]),
    "ts": ("export class K% {}\nfunction f%() {}\n", [("class", "K%", 1), ("function", "f%", 2)]),
    "java": ("public final class J% {}\n", [("class", "J%", 1)]),
    "rb": ("module M%\n  def go%?\n  end\nend\n", [("module", "M%", 1), ("method", "go%?", 2)]),
    "proto": ("service P% {\n  rpc Get% (A) returns (B);\n}\n", [("service", "P%", 1), ("rpc", "Get%", 2)]),
    "php": ("final class H% {\n  public function go%() {}\n}\n", [("class", "H%", 1), ("method", "go%", 2)]),
    "graphql": ("type G% {\n  id: ID\n}\n", [("type", "G%", 1)]),
}


def code_files(m):
    k, names = F.col("p_partkey").cast("string"), list(LANGUAGES)
    at = (F.col("p_partkey") % len(names) + 1).cast("int")
    text = F.replace(F.element_at(F.array(*[F.lit(LANGUAGES[n][0]) for n in names]), at), F.lit("%"), k)
    return parts(m).select(F.concat(F.lit("p"), k, F.lit("."), F.element_at(F.array(*[F.lit(n) for n in names]), at)).alias("path"), text.alias("content"))


DECLARED = ", ".join(f"({i}, '{e}', '{k}', '{n}', {line})" for i, (e, (_, rows)) in enumerate(LANGUAGES.items()) for k, n, line in rows)
add(
    "A-14_pattern_facts",
    lambda m: S.extract_facts(code_files(m)).select("path", "kind", "name", "line"),
    f"""SELECT 'p' || p_partkey || '.' || e AS path, k AS kind, replace(n, '%', CAST(p_partkey AS VARCHAR)) AS name, l AS line
    FROM part JOIN (VALUES {DECLARED}) t(i, e, k, n, l) ON p_partkey % {len(LANGUAGES)} = i""",
)

# Extension, text before and after as many branches as the part's size says, and rows: kind, name, parent, line (+ for those
# after the branches), target, decisions a branch adds (null for what is no function). % stands for the part's key.
CODE = {
    "rs": ("use a::{b%, c as d};\nimpl Show for S% {\n    fn go(&self) {\n", "        if x { y; }\n", "        self.g%();\n    }\n}\n", [
        ("import", "b%", "", "1", "a::b%", None), ("import", "d", "", "1", "a::c", None), ("implements", "S%", "", "2", "Show", None),
        ("dispatch", "go", "S%", "3", "S%", None), ("method", "go", "S%", "3", None, 1), ("call", "g%", "S%.go", "4+", "self.g%", None)]),
    "go": ("import q \"m/n%\"\nfunc (s *S%) Go(a interface{}) error {\n", "\tif x { y = 1 }\n", "\tq.G%(a)\n}\n", [
        ("import", "q", "", "1", "m/n%", None), ("method", "Go", "S%", "2", None, 1), ("call", "G%", "S%.Go", "3+", "q.G%", None)]),
    "ts": ("import { A as B } from \"m%\";\nexport class K extends B implements I% {\n  go(a: string): void {\n", "    if (x) { y; }\n", "    this.g%(a);\n  }\n}\n", [
        ("import", "B", "", "1", "m%::A", None), ("class", "K", "", "2", None, None), ("implements", "K", "", "2", "B", None),
        ("implements", "K", "", "2", "I%", None), ("method", "go", "K", "3", None, 1), ("call", "g%", "K.go", "4+", "this.g%", None)]),
    "java": ("import a.b%.C;\npublic class K extends B<C> {\n  @Test public void go() throws E {\n", "    if (x) { y = 1; }\n", "    new Z().g%();\n  }\n}\n", [
        ("import", "C", "", "1", "a.b%.C", None), ("class", "K", "", "2", None, None), ("implements", "K", "", "2", "B", None),
        ("method", "go", "K", "3", None, 1), ("call", "Z", "K.go", "4+", "Z", None), ("call", "g%", "K.go", "4+", "g%", None)]),
    "cs": ("using N = A.B%;\nnamespace P.Q {\n class K : I% {\n  void Go() {\n", "    if (x) { y = 1; }\n", "    N.g%();\n  }\n }\n}\n", [
        ("import", "N", "", "1", "A.B%", None), ("module", "P.Q", "", "2", None, None), ("class", "K", "P.Q", "3", None, None),
        ("implements", "K", "P.Q", "3", "I%", None), ("method", "Go", "P.Q.K", "4", None, 1), ("call", "g%", "P.Q.K.Go", "5+", "N.g%", None)]),
    "kt": ("import a.b% as D\nclass K(val x: Int) : B(x) {\n  fun go(a: Int) {\n", "    if (x) { y = 1 }\n", "    D.g%(a)\n  }\n}\n", [
        ("import", "D", "", "1", "a.b%", None), ("class", "K", "", "2", None, None), ("implements", "K", "", "2", "B", None),
        ("method", "go", "K", "3", None, 1), ("call", "g%", "K.go", "4+", "D.g%", None)]),
    "cpp": ("#include \"x/y%.h\"\nnamespace n {\nvoid A%::go(int a) const {\n", "    if (x) { y = 1; }\n", "    std::g%(a);\n  }\n}\n", [
        ("import", "y%.h", "", "1", "x/y%.h", None), ("module", "n", "", "2", None, None), ("method", "go", "A%", "3", None, 1), ("call", "g%", "A%.go", "4+", "std::g%", None)]),
    "scala": ("import a.{B%, C => D}\nclass K extends T with U% {\n  def go(a: Int): Unit = {\n", "    if (x) { y = 1 }\n", "    D.g%(a)\n  }\n}\n", [
        ("import", "B%", "", "1", "a.B%", None), ("import", "D", "", "1", "a.C", None), ("class", "K", "", "2", None, None), ("implements", "K", "", "2", "T", None),
        ("implements", "K", "", "2", "U%", None), ("method", "go", "K", "3", None, 1), ("call", "g%", "K.go", "4+", "D.g%", None)]),
}


def branched_files(m):
    k, names = F.col("p_partkey").cast("string"), list(CODE)
    at = (F.col("p_partkey") % len(names) + 1).cast("int")
    pick = lambda j: F.element_at(F.array(*[F.lit(CODE[n][j]) for n in names]), at)
    text = F.replace(F.concat(pick(0), F.repeat(pick(1), (F.col("p_size") % 4).cast("int")), pick(2)), F.lit("%"), k)
    return parts(m).select(F.concat(F.lit("p"), k, F.lit("."), F.element_at(F.array(*[F.lit(n) for n in names]), at)).alias("path"), text.alias("content"))


def _value(x):
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


CODE_ROWS = ", ".join(
    f"({i}, '{e}', {_value(kind)}, {_value(name)}, {_value(parent)}, {line.rstrip('+')}, {int(line.endswith('+'))}, {_value(target)}, {_value(more)})"
    for i, (e, c) in enumerate(CODE.items()) for kind, name, parent, line, target, more in c[3]
)
add(
    "A-14_code_facts",
    lambda m: S.extract_facts(branched_files(m)).select("path", "kind", "name", "parent", "line", "target", "cc", "nesting"),
    f"""WITH t(i, e, kind, name, parent, line, moved, target, more) AS (VALUES {CODE_ROWS}), p AS (SELECT *, p_size % 4 AS b, CAST(p_partkey AS VARCHAR) AS k FROM part)
    SELECT 'p' || k || '.' || e AS path, kind, replace(name, '%', k) AS name, replace(parent, '%', k) AS parent, line + moved * b AS line, replace(target, '%', k) AS target,
    1 + more * b AS cc, more * least(b, 1) AS nesting FROM p JOIN t ON p_partkey % {len(CODE)} = i""",
)

# Routes, client calls and dispatched functions in source files: extension, text, route names, handlers
ROUTED = {
    "ts": ('import express from "express";\nfunction h% () {}\napp.get("/a/%", h%);\napp.set("x", 1);\n', "GET /a/%", "h%"),
    "java": ('import org.springframework.web.Bind;\nclass C { @PostMapping("/b/%") public int h%() { return 1; } }\n', "POST /b/%", "h%"),
    "go": ('import "net/http"\nfunc h%() {}\nfunc m() { http.HandleFunc("/c/%", h%) }\n', "ANY /c/%", "h%"),
    "rs": ('use axum::Router;\nfn h%() {}\nfn m() { Router::new().route("/d/{id}/%", delete(h%)); }\n', "DELETE /d/{id}/%", "h%"),
    "py": ('from fastapi import FastAPI\n@app.put("/e/%")\ndef h%():\n    pass\n', "PUT /e/%", "h%"),
    "cs": ('using Microsoft.AspNetCore.Mvc;\nclass C { [HttpGet("/f/%")] public int h%() { return 1; } }\n', "GET /f/%", "h%"),
    "rb": ("Rails.application.routes.draw do\n  get '/h/%', to: 'c#h%'\nend\ndef h%\nend\n", "GET /h/%", "h%"),
    "js": ('const h% = () => { cache.get("/g/%"); };\n', None, None),  # no framework is imported
}


def routed_files(m):
    k, names = F.col("p_partkey").cast("string"), list(ROUTED)
    at = (F.col("p_partkey") % len(names) + 1).cast("int")
    text = F.replace(F.element_at(F.array(*[F.lit(ROUTED[n][0]) for n in names]), at), F.lit("%"), k)
    return parts(m).select(F.concat(F.lit("p"), k, F.lit("."), F.element_at(F.array(*[F.lit(n) for n in names]), at)).alias("path"), text.alias("content"))


ROUTE_ROWS = ", ".join(f"({i}, '{e}', '{n}')" for i, (e, (_, n, _h)) in enumerate(ROUTED.items()) if n)
add(
    "P-14_source_routes",
    lambda m: R.source_routes(S.extract_facts(routed_files(m))).select("symbol", "file_path", "name", F.col("handler").isNotNull().alias("bound")),
    f"""SELECT 'route/' || f || '#' || n AS symbol, f AS file_path, n AS name, TRUE AS bound
    FROM (SELECT 'p' || p_partkey || '.' || e AS f, replace(r, '%', CAST(p_partkey AS VARCHAR)) AS n FROM part JOIN (VALUES {ROUTE_ROWS}) t(i, e, r) ON p_partkey % {len(ROUTED)} = i)""",
)
SITE = """CASE p_size % 5 WHEN 0 THEN '"/u/' || p_partkey || '/{id}"' WHEN 1 THEN '"u/' || p_partkey || '"' WHEN 2 THEN 'url' WHEN 3 THEN '"/u/*"' ELSE '"https://h/u"' END"""
CLIENT_FILES = f"""SELECT 'p' || p_partkey || '.rs' AS path, CASE WHEN p_partkey % 7 = 0 THEN 'use std::fs;' ELSE 'use reqwest::Client;' END || chr(10) || 'fn m() {{ client.post(' || {SITE} || '); }}' AS content FROM part"""
add(
    "J-11_client_calls",
    lambda m: R.source_client_calls(S.extract_facts(from_parts(m, CLIENT_FILES.replace("p_partkey ||", "cast(p_partkey as string) ||")))),
    """SELECT 'p' || p_partkey || '.rs' AS file_path, 'm' AS scope, 2 AS line, CASE p_size % 5 WHEN 0 THEN 'POST /u/' || p_partkey || '/{id}' END AS target,
    CASE p_size % 5 WHEN 0 THEN NULL WHEN 3 THEN 'path-not-composed' ELSE 'base-url-runtime' END AS refusal FROM part WHERE p_partkey % 7 <> 0""",
)
add(
    "P-16_source_dispatch",
    lambda m: R.dispatch_roots(S.extract_facts(branched_files(m))),
    f"SELECT 'p' || p_partkey || '.rs' AS file_path, 'S' || p_partkey AS owner, 'go' AS name FROM part WHERE p_partkey % {len(CODE)} = 0",
)

BROKERS = """SELECT 'p' || p_partkey || '.java' AS path, 'class C {' || chr(10) || '  @KafkaListener(' || CASE p_size % 3 WHEN 0 THEN 'topics = "' WHEN 1 THEN '"' ELSE 'id = "' END || 't' || (p_partkey % 50) || '") void on() {' || chr(10)
    || '    k.send("t' || (p_size % 7) || '", 1);' || chr(10) || '    k.send("t' || (p_size % 7) || '", 2); k.send(topic); }' || chr(10) || '}' AS content FROM part"""
add(
    "P-15_source_topics",
    lambda m: R.topic_nodes(S.extract_facts(from_parts(m, re.sub(r"\|\| (p_partkey|\([^)]*\))", r"|| cast(\1 as string)", BROKERS)))),
    """WITH s AS (SELECT 'p' || p_partkey || '.java' AS file_path, 'producer' AS kind, 't' || (p_size % 7) AS name, 3 AS line FROM part
    UNION ALL SELECT 'p' || p_partkey || '.java', 'consumer', 't' || (p_partkey % 50), 2 FROM part WHERE p_size % 3 < 2)
    SELECT file_path || '/C.on/' || kind || '/' || name AS symbol, kind, name, file_path, line, 'topic/' || name AS topic FROM s
    UNION ALL SELECT DISTINCT 'topic/' || name, 'topic', name, NULL, NULL, NULL FROM s""",
)
add(
    "P-16_marked_live",
    lambda m: R.marked_live(S.extract_facts(branched_files(m))),
    f"""SELECT 'p' || p_partkey || '.rs/S' || p_partkey || '/go' AS source, 'p' || p_partkey || '.rs/S' || p_partkey || '/go' AS target, 'routes_to' AS kind
    FROM part WHERE p_partkey % {len(CODE)} = 0""",
)

# Documents: whole texts between headings of their own

BODY = """SELECT doc_id, '# Title ' || source || chr(10) || coalesce(text, '') || chr(10) || '## Part One' || chr(10) || 'see `fn42()` and [a](b.md#x)' || chr(10) || '## Part One' AS body FROM documents"""
LINES = f"l AS (SELECT doc_id, i, s[i] AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(body, chr(10)) AS s FROM ({BODY}))))"


def bodies(m):
    return m.sql(BODY)


add(
    "A-15_sections",
    lambda m: S.sections(bodies(m), "doc_id", "body").withColumn("ordinal", F.col("ordinal").cast("bigint")),
    rf"""WITH {LINES}, h AS (SELECT doc_id AS key, i, regexp_extract(t, '^#{{1,6}}\s+(.*?)\s*#*$', 1) AS heading FROM l WHERE regexp_matches(t, '^#{{1,6}}\s')),
    g AS (SELECT *, replace(regexp_replace(lower(trim(heading)), '[^a-z0-9 _-]', '', 'g'), ' ', '-') AS slug FROM h),
    n AS (SELECT key, heading, slug, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS ordinal, row_number() OVER (PARTITION BY key, slug ORDER BY i) - 1 AS again FROM g)
    SELECT key, ordinal, heading, CASE WHEN again > 0 THEN slug || '-' || again ELSE slug END AS anchor FROM n""",
)
add(
    "A-15_markdown_facts",
    lambda m: S.extract_facts(bodies(m).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("body").alias("content")))
    .groupBy("path", "kind").agg(F.count("*").alias("n")),
    rf"""WITH {LINES}, k AS (SELECT DISTINCT doc_id, 'doc_file' AS kind, 1 AS n FROM l
    UNION ALL SELECT doc_id, 'doc_section', count(*) FROM l WHERE regexp_matches(t, '^#{{1,6}}\s+') GROUP BY 1
    UNION ALL SELECT doc_id, 'link', CAST(sum(len(regexp_extract_all(t, '\[([^\]]*)\]\(([^)\s]+)\)'))) AS BIGINT) FROM l GROUP BY 1
    UNION ALL SELECT doc_id, 'code_name', CAST(sum(len(regexp_extract_all(t, '`([A-Za-z_][\w:.]*)(?:\(\))?`'))) AS BIGINT) FROM l GROUP BY 1)
    SELECT 'd' || doc_id || '.md' AS path, kind, n FROM k WHERE n > 0""",
)
add(
    "A-17_openapi",
    lambda m: S.extract_facts(
        parts(m).select(
            F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"),
            F.concat(F.lit('{"openapi":"3","paths":{"/p/'), F.col("p_partkey").cast("string"), F.lit('/{id}":{"get":{},'), F.when(F.col("p_size") % 2 == 0, '"post":{}').otherwise('"x-note":{}'), F.lit("}}}")).alias("content"),
        )
    ).where("kind like 'api%'").select("path", "kind", "name"),
    """SELECT 'p' || p_partkey || '.json' AS path, k AS kind, v || '/p/' || p_partkey || '/{id}' AS name
    FROM part JOIN (VALUES ('api_path', '', 2), ('api_operation', 'GET ', 2), ('api_operation', 'POST ', 0)) t(k, v, r) ON r = 2 OR p_size % 2 = r""",
)
CONFIGS = """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'floor = ' || cast(p_size AS varchar(4)) WHEN 1 THEN 'name = "' || p_brand || '"' WHEN 2 THEN 'roof = 1' WHEN 3 THEN 'floor = "x"' ELSE 'floor =' END AS text FROM part"""
add(
    "A-23_toml",
    lambda m: S.read_configs(from_parts(m, CONFIGS), "p_partkey", "text", {"floor": int, "name": str}),
    """SELECT p_partkey AS key, CASE p_size % 5 WHEN 0 THEN 'floor' WHEN 1 THEN 'name' END AS name, CASE p_size % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_brand END AS value,
    CASE p_size % 5 WHEN 2 THEN 'unknown key roof' WHEN 3 THEN 'floor is not of type int' WHEN 4 THEN 'not TOML' END AS error FROM part""",
)
add("A-26_json", lambda m: S.as_json(m.nation.select("n_nationkey", "n_name")), """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
