"""Boolean columns: kinds, paths, globs, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of nodes and edges by family.
DOC_KINDS = ("doc_file", "doc_section", "requirement", "decision", "story")
NON_CODE_KINDS = (*DOC_KINDS, "config_file", "config_section", "table", "column", "resource", "message", "service", "rpc", "target", "stage", "api_path", "api_operation")
CONFIG_KINDS = tuple(k for k in NON_CODE_KINDS if k not in DOC_KINDS)
TYPE_KINDS = ("struct", "enum", "trait", "class", "interface", "type_alias")
BROKER_KINDS = ("topic", "producer", "consumer")
POLICY_KINDS = ("layer", "boundary")
CALLABLE_KINDS = ("function", "method")
DOC_EDGES = ("doc_reference", "traces_to")
CONFIG_EDGES = ("config_reference", "config_defines")
STRUCTURAL_EDGES = ("contains", "accesses", "implements")
TEST_FOLDERS = ("tests", "test", "__tests__", "spec")
EXTERNAL = r"^(https?:|git@|//|\$)|^google/protobuf/"
# Patterns that mark a defect fix in a commit's subject.
DEFECT_PATTERNS = (r"(?i)\bfix(es|ed)?\b", r"(?i)\bbug\b", r"(?i)\bhotfix\b")
DEFECT = "|".join(DEFECT_PATTERNS)


def is_code(kind: Column) -> Column:
    return ~kind.isin(*NON_CODE_KINDS)


def glob_pattern(glob: str, separators: bool = True) -> str:
    """A regular expression for a glob.

    * and ? stop at separators (if they count), ** does not; [abc], [a-z] and [!a] stand for
    one character, {a,b} for either; a backslash takes the next character as it is.
    """
    out, i, braces = "", 0, 0
    any_one = "[^/]" if separators else "."
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + any_one + "*", i + 1
        elif c == "?":
            out, i = out + any_one, i + 1
        elif close > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", close + 1
        elif c == "{" and "}" in glob[i:]:
            out, i, braces = out + "(?:", i + 1, braces + 1
        elif c == "," and braces:
            out, i = out + "|", i + 1
        elif c == "}" and braces:
            out, i, braces = out + ")", i + 1, braces - 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether patterns of an ignore file leave a path out; the last one that matches decides.

    A pattern with a separator that is not its last character counts from the root, others
    anywhere. One that ends in a separator is for folders. ``!`` takes back. What lies in a
    folder that is left out is left out as well.
    """
    out = F.lit(False)
    for line in patterns:
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        back = p.startswith("!")
        p = p.removeprefix("!")
        folder, rooted = p.endswith("/"), "/" in p.rstrip("/")
        body = glob_pattern(p.strip("/"))[1:-1]
        whole = ("^" if rooted else "^(?:.*/)?") + body + ("/.+$" if folder else "(?:/.+)?$")
        out = F.when(path.rlike(whole), F.lit(not back)).otherwise(out)
    return out


def matches_glob(path: Column, glob: str, separators: bool = True) -> Column:
    return path.rlike(glob_pattern(glob, separators))


def is_test_path(path: Column) -> Column:
    """A folder for tests on the way, or a file named as a test."""
    folder = path.rlike(r"(^|/)(" + "|".join(TEST_FOLDERS) + r")/")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return folder | stem.rlike(r"^test_|_test$|^tests?$|\.(test|spec)$")


def is_test_marked(evidence: Column, path: Column, name: Column, markers: tuple[str, ...] = ("test",)) -> Column:
    """Evidence in the code, a test path, or a name that is a marker or starts or ends with one."""
    named = F.lit(False)
    for m in markers:
        named = named | (name == m) | name.startswith(f"{m}_") | name.endswith(f"_{m}")
    return evidence | F.coalesce(is_test_path(path), F.lit(False)) | named


def is_external(target: Column) -> Column:
    return target.rlike(EXTERNAL)


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)


def is_admitted(path: Column, size: Column, include: list[str], exclude: list[str], most_bytes: int = 2 << 20, ignore: list[str] = []) -> Column:  # noqa: B006
    """One rule for walks and for changes: included, not excluded or left out by an ignore file, not too large."""
    some = F.lit(not include)
    for g in include:
        some = some | matches_glob(path, g)
    for g in exclude:
        some = some & ~matches_glob(path, g)
    return some & ~ignored(path, ignore) & (size <= most_bytes)
