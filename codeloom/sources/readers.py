"""Readers: history logs, coverage reports, source trees, documents, configuration.

Text reports are parsed by the engine (line by line, with windows within a file) where
their format allows; formats that need a parser of their own run in mapInPandas, one file
a row. Nothing outside the given path is read.
"""

from __future__ import annotations

import ast
import bisect
import io
import json
import re
import tokenize
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.predicates import is_admitted, matches_glob
from codeloom.functions.scalars import slug
from codeloom.sources.code import LANGUAGES, code_facts
from codeloom.sources.facts import FACTS
from codeloom.sources.facts import row as _row
from codeloom.sources.ruby import ruby_facts

RECORD, UNIT = "\x1e", "\x1f"  # separators of the log format below
LOG_FORMAT = "%x1e%H%x1f%ct%x1f%an%x1f%ae%x1f%s"
# Where coverage reports usually lie.
COVERAGE_PATHS = (
    "lcov.info",
    "coverage.xml",
    "coverage/cobertura-coverage.xml",
    "coverage/lcov.info",
    "target/llvm-cov/cobertura.xml",
    "target/llvm-cov/lcov.info",
)


# History logs: git log --numstat -M --format=<LOG_FORMAT>


def parse_log(logs: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Commits and file changes from log texts. Lines of binary files are null; a rename keeps its old path."""
    records = logs.select(F.explode(F.split(F.col(text), RECORD)).alias("r")).where(F.length(F.trim("r")) > 0)
    lines = F.filter(F.split("r", "\n"), lambda x: x != "")
    head = F.split(lines[0], UNIT)
    rows = records.select(head[0].alias("sha"), head[1].cast("bigint").alias("committed_at"), head[2].alias("author_name"), head[3].alias("author_email"), head[4].alias("subject"), F.slice(lines, 2, 1 << 30).alias("changes"))
    commits = rows.select("sha", "committed_at", "author_name", "author_email", "subject", F.size("changes").cast("bigint").alias("file_count"))
    c = F.split("change", "\t")
    path = c[2]
    braces = r"^(.*)\{(.*) => (.*)\}(.*)$"
    new = F.when(path.rlike(braces), F.replace(F.regexp_replace(path, braces, "$1$3$4"), F.lit("//"), F.lit("/"))).when(F.contains(path, F.lit(" => ")), F.split(path, " => ")[1]).otherwise(path)
    old = F.when(path.rlike(braces), F.replace(F.regexp_replace(path, braces, "$1$2$4"), F.lit("//"), F.lit("/"))).when(F.contains(path, F.lit(" => ")), F.split(path, " => ")[0])
    changes = rows.select("sha", F.explode("changes").alias("change")).select(
        F.col("sha").alias("commit_sha"), new.alias("path"), F.when(c[0] != "-", c[0]).cast("bigint").alias("added"), F.when(c[1] != "-", c[1]).cast("bigint").alias("deleted"), old.alias("old_path")
    )
    return commits, changes


# Coverage


def sniff_coverage(text: Column) -> Column:
    """cobertura, lcov or null."""
    start = F.ltrim(F.substring(text, 1, 4096))
    return F.when(F.contains(start, F.lit("<coverage")), "cobertura").when(start.rlike(r"^(TN:|SF:)|\n(TN:|SF:)"), "lcov")


def parse_lcov(reports: DataFrame, report: str, text: str) -> DataFrame:
    """(report, path, line_no, hits): the highest hits of a line within a report. Lines outside a file's record are dropped."""
    records = reports.select(F.col(report).alias("report"), F.explode(F.split(F.col(text), "end_of_record")).alias("r"))
    path = F.regexp_extract("r", r"(?m)^SF:(.+?)\s*$", 1)
    hits = F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1))
    rows = records.select("report", path.alias("path"), F.explode(hits).alias("da")).where("path <> ''")
    return rows.groupBy("report", "path", F.split("da", ",")[0].cast("bigint").alias("line_no")).agg(F.max(F.split("da", ",")[1].cast("bigint")).alias("hits"))


def parse_cobertura(reports: DataFrame, report: str, text: str) -> DataFrame:
    """(report, path, line_no, hits). A report that is no well-formed XML gives nothing."""
    from xml.etree import ElementTree

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[tuple, int] = {}
            for name, body in zip(pdf[report], pdf[text]):
                try:
                    root = ElementTree.fromstring(body)
                except ElementTree.ParseError:
                    continue
                for c in root.iter("class"):
                    for line in c.iter("line"):
                        k = (str(name), c.get("filename"), int(line.get("number", 0)))
                        out[k] = max(out.get(k, 0), int(line.get("hits", 0)))
            yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["report", "path", "line_no", "hits"])

    return reports.select(report, text).mapInPandas(run, "report string, path string, line_no bigint, hits bigint")


def newest_report(files: DataFrame, configured: tuple[str, ...] = ()) -> DataFrame:
    """The latest of the files at the usual places, from the root, or where a configured glob says; ``files`` has path and modificationTime."""
    known = F.col("path").isin(*COVERAGE_PATHS)
    for g in configured:
        known = known | matches_glob(F.col("path"), g, separators=False)
    return files.where(known).orderBy(F.desc("modificationTime"), "path").limit(1)


# Source trees


def read_tree(spark: SparkSession, root: str, include: list[str] = [], exclude: list[str] = [], most_bytes: int = 2 << 20, ignore: list[str] = []) -> DataFrame:  # noqa: B006
    """(path, content, content_hash) of admitted files under root; paths are relative to it. Content that is no UTF-8 is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    rows = files.withColumn("path", F.substring(at, len(base) + 1, 1 << 20))
    rows = rows.where(is_admitted(F.col("path"), F.col("length"), include, exclude, most_bytes, ignore))
    return rows.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"))


# Words that add a path through a function; statements that nest; words of route registrations.
PYTHON_DECISIONS = ("if", "elif", "else", "for", "while", "except", "and", "or", "assert")
PYTHON_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match)
PYTHON_METHODS = {
    "get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "head": "HEAD", "options": "OPTIONS", "trace": "TRACE",
    "websocket": "ANY", "path": "ANY", "re_path": "ANY",
}
PYTHON_FRAMEWORKS = ("fastapi", "django")


def _python_route(call: ast.AST) -> tuple[str, str] | None:
    """(method, template) of a call whose first argument is a string and whose name registers routes."""
    f = call.func if isinstance(call, ast.Call) else None
    name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) and f.id in ("path", "re_path") else None
    if name in PYTHON_METHODS and call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str):
        return PYTHON_METHODS[name], call.args[0].value


def python_facts(path: str, content: str) -> list[tuple]:
    """Modules, classes, functions, supertypes, imports, calls and routes of a Python file. What can't be parsed gives its module only."""
    out = [_row(path, "module", path.rsplit("/", 1)[-1].removesuffix(".py"), "", 1)]
    try:
        tree = ast.parse(content)
        words = [(t.start, t.string) for t in tokenize.generate_tokens(io.StringIO(content).readline) if t.type == tokenize.NAME and t.string in PYTHON_DECISIONS]
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        return out
    lines, routes = content.split("\n"), {}

    def depth(node: ast.AST) -> int:
        further = getattr(node, "orelse", []) if isinstance(node, ast.If) else []
        other = further[0] if len(further) == 1 and isinstance(further[0], ast.If) and lines[further[0].lineno - 1].lstrip().startswith("elif") else None
        return max([0, *((isinstance(c, PYTHON_BLOCKS) and c is not other) + depth(c) for c in ast.iter_child_nodes(node))])

    def decisions(node: ast.AST) -> int:
        places = bisect.bisect_left(words, ((node.lineno, 0),)), bisect.bisect_left(words, ((node.end_lineno + 1, 0),))
        return 1 + places[1] - places[0] + sum(isinstance(x, ast.match_case) for x in ast.walk(node))

    def visit(node: ast.AST, scope: str, in_class: bool) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.ClassDef):
                out.append(_row(path, "class", c.name, scope, c.lineno, last=c.end_lineno, exported=not c.name.startswith("_")))
                out.extend(_row(path, "implements", c.name, scope, c.lineno, ast.unparse(b)) for b in c.bases)
                visit(c, f"{scope}.{c.name}".strip("."), True)
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if in_class else "function"
                out.append(_row(path, kind, c.name, scope, c.lineno, None, decisions(c), depth(c), c.end_lineno, not c.name.startswith("_"), c.name.startswith("test_")))
                for d in c.decorator_list:
                    if found := _python_route(d):
                        routes.setdefault(found, (c.name, c.lineno))
                visit(c, f"{scope}.{c.name}".strip("."), False)
            else:
                if isinstance(c, ast.Import):
                    out.extend(_row(path, "import", a.asname or a.name, scope, c.lineno, a.name) for a in c.names)
                elif isinstance(c, ast.ImportFrom):
                    out.extend(_row(path, "import", a.asname or a.name, scope, c.lineno, f"{'.' * c.level}{c.module or ''}.{a.name}") for a in c.names)
                elif isinstance(c, ast.Call):
                    f = c.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        out.append(_row(path, "call", name, scope, c.lineno, ast.unparse(f)))
                    if name in ("path", "re_path") and (found := _python_route(c)) and len(c.args) > 1:
                        view = c.args[1]
                        routes.setdefault(found, (view.id if isinstance(view, ast.Name) else getattr(view, "attr", None), c.lineno))
                visit(c, scope, in_class)

    try:
        visit(tree, "", False)
    except RecursionError:
        return out[:1]
    if any(r[1] == "import" and r[5].split(".")[0] in PYTHON_FRAMEWORKS for r in out):
        out += [_row(path, "route", f"{m} {t}", "", n, h) for (m, t), (h, n) in routes.items()]
    return out


# Languages without a parser at hand: declarations by pattern. Fixed values.
DECLARATIONS = {
    "sql": r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?P<k>table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.\"]+)",
    "proto": r"^\s*(?P<k>message|service|rpc|enum)\s+(?P<n>\w+)",
    "graphql": r"^\s*(?P<k>type|interface|enum|input|scalar|union)\s+(?P<n>\w+)",
    "tf": r"^\s*(?P<k>resource|module|variable|output|data)\s+\"(?P<n>[^\"]+(?:\"\s+\"[^\"]+)?)\"",
    "sh": r"^\s*(?:function\s+)?(?P<n>\w+)\s*\(\)\s*(?P<k>\{)",
    "mk": r"^(?P<n>[\w.-]+)\s*(?P<k>:)(?!=)",
}
NAMES = {"fn": "function", "func": "function", "def": "function", "mod": "module", "{": "function", ":": "target", "rpc": "rpc"}


def pattern_facts(path: str, content: str) -> list[tuple]:
    ext = "mk" if path.rsplit("/", 1)[-1] == "Makefile" else path.rsplit(".", 1)[-1]
    pattern = DECLARATIONS.get({"bash": "sh"}.get(ext, ext))
    if not pattern:
        return []
    found = re.compile(pattern)
    hits = ((n, found.match(line)) for n, line in enumerate(content.splitlines(), 1))
    return [_row(path, NAMES.get(m["k"].lower(), m["k"].lower()), m["n"].strip('"'), "", n) for n, m in hits if m]


def markdown_facts(path: str, content: str) -> list[tuple]:
    """Sections by heading (their slug as target), links and code spans; fenced code is passed over."""
    out, fenced, scope = [_row(path, "doc_file", path, "", 1)], False, ""
    for n, line in enumerate(content.splitlines(), 1):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            continue
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            scope = m[2]
            out.append(_row(path, "doc_section", m[2], "", n, re.sub(r"[^a-z0-9 _-]", "", m[2].lower()).replace(" ", "-")))
        out += [_row(path, "link", m[1], scope, n, m[2]) for m in re.finditer(r"\[([^\]]*)\]\(([^)\s]+)\)", line)]
        out += [_row(path, "code_name", m[1], scope, n) for m in re.finditer(r"`([A-Za-z_][\w:.]*)(?:\(\))?`", line)]
    return out


def _config_tree(path: str, data: object) -> list[tuple]:
    """Keys of a configuration, two levels deep; routes of an OpenAPI document."""
    if not isinstance(data, dict):
        return []
    out = []
    if {"openapi", "swagger"} & set(data) and isinstance(data.get("paths"), dict):
        for route, ops in data["paths"].items():
            out.append(_row(path, "api_path", route))
            verbs = [v for v in (ops if isinstance(ops, dict) else {}) if v in ("get", "put", "post", "delete", "patch", "head", "options")]
            out += [_row(path, "api_operation", f"{v.upper()} {route}", route) for v in verbs]
    for k, v in data.items():
        out.append(_row(path, "config_section", k))
        if isinstance(v, dict):
            out += [_row(path, "config_section", x, k) for x in v]
    return out


def config_facts(path: str, content: str) -> list[tuple]:
    """Keys of JSON and TOML. What can't be parsed gives nothing."""
    try:
        return _config_tree(path, json.loads(content) if path.endswith(".json") else tomllib.loads(content))
    except ValueError:
        return []


def yaml_facts(path: str, content: str) -> list[tuple]:
    """Keys of block mappings, two levels deep, by their indentation; anchors (&name), and aliases (*name) as references."""
    out, top, inner, root = [], "", None, {}
    for n, line in enumerate(content.splitlines(), 1):
        body = re.sub(r"(^|\s)#.*$", "", line)
        if not body.strip() or body.strip() in ("---", "..."):
            continue
        if m := re.match(r"""( *)(?:"([^"]+)"|'([^']+)'|([^\s'"#\[{-][^:#]*?))\s*:(?:\s|$)""", body):
            indent, key = len(m[1]), m[2] or m[3] or m[4]
            if indent == 0:
                top, inner = key, None
                root[key] = {}
                out.append(_row(path, "config_section", key, "", n))
            elif top and (inner is None or indent == inner):
                inner = indent
                root[top][key] = None
                out.append(_row(path, "config_section", key, top, n))
        out += [_row(path, "anchor", x[1], top, n) for x in re.finditer(r"(?:^|\s)&([\w-]+)", body)]
        out += [_row(path, "reference", x[1], top, n, x[1]) for x in re.finditer(r"(?:^|\s)\*([\w-]+)", body)]
    if {"openapi", "swagger"} & set(root):
        out += [_row(path, "api_path", k) for k in root.get("paths", {}) if k.startswith("/")]
    return out


def dockerfile_facts(path: str, content: str) -> list[tuple]:
    """Stages by name or number; what they are built from, and stages that files are copied from, as references."""
    out, stages = [], []
    for n, line in enumerate(content.splitlines(), 1):
        if m := re.match(r"(?i)\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", line):
            name = (m[2] or str(len(stages))).lower()
            stages.append(name)
            out += [_row(path, "stage", name, "", n), _row(path, "reference", m[1], name, n, m[1])]
        elif m := re.match(r"(?i)\s*COPY\s+.*?--from=(\S+)", line):
            out.append(_row(path, "reference", m[1].lower(), stages[-1] if stages else "", n, m[1].lower()))
    return out


def makefile_facts(path: str, content: str) -> list[tuple]:
    """Targets, and what each needs as references."""
    out = []
    for n, line in enumerate(content.replace("\\\n", "  ").splitlines(), 1):
        if m := re.match(r"([\w./-]+(?:\s+[\w./-]+)*)\s*:(?![=:])([^=#]*)", line):
            for t in m[1].split():
                if not t.startswith("."):
                    out.append(_row(path, "target", t, "", n))
                    out += [_row(path, "reference", d, t, n, d) for d in m[2].split() if "$" not in d]
    return out


def shell_facts(path: str, content: str) -> list[tuple]:
    """Functions, and scripts that are sourced or run as references."""
    out = []
    for n, line in enumerate(content.splitlines(), 1):
        if m := re.match(r"\s*(?:function\s+(\w+)\s*(?:\(\))?|(\w+)\s*\(\))\s*\{", line):
            out.append(_row(path, "function", m[1] or m[2], "", n))
        elif m := re.match(r"\s*(?:source|\.|bash|sh)\s+([\w./-]+)", line):
            out.append(_row(path, "reference", m[1], "", n, m[1]))
        elif m := re.match(r"\s*(\.{1,2}/[\w./-]+)", line):
            out.append(_row(path, "reference", m[1], "", n, m[1]))
    return out


def sql_facts(path: str, content: str) -> list[tuple]:
    """Tables and views with their columns; tables that foreign keys and selects name as references."""
    out = []
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), content, flags=re.S)
    create = r'(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temporary\s+|temp\s+)?(table|view)\s+(?:if\s+not\s+exists\s+)?([\w."]+)'
    found = list(re.finditer(create, bare))
    for m, end in zip(found, [*[x.start() for x in found[1:]], len(bare)]):
        name, body = m[2].replace('"', ""), bare[m.end() : end]
        line = bare.count("\n", 0, m.start()) + 1
        out.append(_row(path, "table", name, "", line))
        if m[1].lower() == "table" and (inner := re.match(r"\s*\((.*)\)", body, re.S)):
            for part in re.split(r",(?![^()]*\))", inner[1]):
                if (c := re.match(r'\s*"?(\w+)"?\s+\w', part)) and c[1].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key", "index"):
                    out.append(_row(path, "column", c[1], name, line))
        pattern = r'(?i)\breferences\s+([\w."]+)' if m[1].lower() == "table" else r'(?i)\b(?:from|join)\s+([\w."]+)'
        out += [_row(path, "reference", r.replace('"', ""), name, line, r.replace('"', "")) for r in re.findall(pattern, body)]
    return out


def terraform_facts(path: str, content: str) -> list[tuple]:
    """Resources, data, modules, variables and outputs; module folders and addresses in expressions as references."""
    out, block = [], ""
    for n, line in enumerate(content.splitlines(), 1):
        bare = re.sub(r"(#|//).*$", "", line)
        if m := re.match(r'(resource|data|module|variable|output)\s+"([^"]+)"(?:\s+"([^"]+)")?', bare):
            name = f"{m[2]}.{m[3]}" if m[3] else m[2]
            block = {"module": "module.", "variable": "var.", "data": "data."}.get(m[1], "") + name
            out.append(_row(path, "resource" if m[1] in ("resource", "data") else m[1], block, "", n))
            continue
        if m := re.match(r'\s*source\s*=\s*"(\.{1,2}/[^"]+)"', bare):
            out.append(_row(path, "reference", m[1], block, n, m[1]))
        elif "=" in bare:
            text = re.sub(r'"(?:[^"$]|\$(?!\{))*"', "", bare.split("=", 1)[1])
            for r in re.findall(r"\b((?:var|module|data\.[a-z]\w*)\.\w+|[a-z]+_\w+\.\w+)", text):
                out.append(_row(path, "reference", r, block, n, r))
    return out


EXTRACTORS: dict[str, Callable[[str, str], list[tuple]]] = {
    **dict.fromkeys(LANGUAGES, code_facts), "py": python_facts, "pyi": python_facts, "rb": ruby_facts, "md": markdown_facts, "json": config_facts, "toml": config_facts, "yaml": yaml_facts, "yml": yaml_facts,
    "sql": sql_facts, "tf": terraform_facts, "sh": shell_facts, "bash": shell_facts, "mk": makefile_facts,
    "Makefile": makefile_facts, "Dockerfile": dockerfile_facts,
}


def extension(path: str) -> str:
    """What names a file's extractor: its extension, or its name where that says it all."""
    name = path.rsplit("/", 1)[-1]
    return name if name in ("Makefile", "Dockerfile") else name.rsplit(".", 1)[-1]


def extract_facts(files: DataFrame, extractors: dict[str, Callable[[str, str], list[tuple]]] | None = None) -> DataFrame:
    """Facts of files (path, content) by their extension; by pattern where no extractor is registered."""
    known = {**EXTRACTORS, **(extractors or {})}
    names = [f.split()[0] for f in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in known.get(extension(p), pattern_facts)(p, c or "")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"line": "Int64", "cc": "Int64", "nesting": "Int64", "last": "Int64", "exported": "boolean", "is_test": "boolean"})

    return files.select("path", "content").mapInPandas(run, FACTS)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, heading, anchor): headings of documents, by the engine alone; a repeated anchor gets a number."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "t"))
    heads = lines.where(F.col("t").rlike(r"^#{1,6}\s")).select("key", "line", F.regexp_extract("t", r"^#{1,6}\s+(.*?)\s*#*$", 1).alias("heading"))
    heads = heads.withColumn("_slug", slug(F.col("heading")))
    again = F.row_number().over(Window.partitionBy("key", "_slug").orderBy("line")) - 1
    ordinal = F.row_number().over(Window.partitionBy("key").orderBy("line")) - 1
    return heads.withColumn("_n", again).withColumn("ordinal", ordinal).select("key", "ordinal", "heading", F.when(F.col("_n") > 0, F.concat_ws("-", "_slug", F.col("_n").cast("string"))).otherwise(F.col("_slug")).alias("anchor"))


def read_toml(text: str, allowed: dict[str, type]) -> dict:
    """A configuration on the driver; unknown keys and wrong types are errors."""
    data = tomllib.loads(text)
    for k, v in data.items():
        if k not in allowed:
            raise ValueError(f"unknown key {k}")
        if not isinstance(v, allowed[k]) or (isinstance(v, bool) and allowed[k] is int):
            raise ValueError(f"{k} is not of type {allowed[k].__name__}")
    return data


def read_configs(configs: DataFrame, key: str, text: str, allowed: dict[str, type]) -> DataFrame:
    """(key, name, value, error): the settings of each configuration, or why it is refused."""
    kind = configs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                try:
                    out += [(k, n, str(v), None) for n, v in read_toml(t or "", allowed).items()]
                except ValueError as e:
                    out.append((k, None, None, str(e) if str(e).startswith(("unknown", *allowed)) else "not TOML"))
            yield pd.DataFrame(out, columns=["key", "name", "value", "error"])

    return configs.select(key, text).mapInPandas(run, f"key {kind}, name string, value string, error string")


def as_json(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(column))
