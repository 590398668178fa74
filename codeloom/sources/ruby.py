"""Facts of Ruby files, line by line: what a line opens is closed by an ``end`` at the start or the end of a line."""

from __future__ import annotations

import re

from codeloom.sources.facts import row as _row

# Decisions, frameworks by their constants, words of route registrations.
DECISIONS = re.compile(r"\b(?:if|elsif|unless|while|until|for|when|rescue|and|or)\b(?![?!:])|&&|\|\||\s\?\s")
FRAMEWORKS = re.compile(r"\b(?:Rails|ActionController|ActiveRecord|ApplicationController|ApplicationRecord|ActionMailer|ActiveJob)\b")
METHODS = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "head": "HEAD", "options": "OPTIONS"}
NO_CALLS = frozenset("if elsif unless while until for when and or not return yield puts print raise def class module case in require require_relative include extend super defined".split())

_STRING = re.compile(r"""(["'])((?:[^\\]|\\.)*?)\1|(?<![\w$@?\\])#.*$""")
_DECLARED = re.compile(r"\s*(?:(?:private|protected|public|module_function)\s+)?(class|module|def)\s+(?:self\.)?([\w:]+[?!=]?)\s*(?:<\s*([\w:]+))?")
_OPENS = re.compile(r"(?:^\s*|=\s*)(if|unless|while|until|for|case|begin)\b|\b(do)\s*(?:\|[^|]*\|)?\s*$")
_ENDS = re.compile(r"^\s*end\b|(?:;|\s)end\s*$")
_CALL = re.compile(r"(?<![\w@])(?<!\w\.)(?<!\w::)(?<!\w&\.)((?:[A-Za-z_@]\w*(?:\.|::|&\.))*)([a-z_]\w*[?!]?)\(")
_ROUTE = re.compile(r"""^\s*(get|post|put|patch|delete|head|options)\s*\(?\s*(["'])([^"'#]+)\2(?:.*?(?:to:|=>)\s*["'][^"']*#(\w+)["'])?""")


def ruby_facts(path: str, content: str) -> list[tuple]:
    """Modules, classes, methods, supertypes, imports, calls and routes of a Ruby file. Heredocs are read as code."""
    rows: list[dict] = []
    open_: list[tuple[str, int | None]] = []  # name of a declaration or '' for a block, and its row
    routes: dict[tuple[str, str], tuple[str | None, int]] = {}
    scope = lambda: ".".join(n for n, r in open_ if r is not None)

    def add(kind: str, name: str, line: int, **more) -> int:
        rows.append({"path": path, "kind": kind, "name": name, "parent": more.pop("parent", scope()), "line": line, **more})
        return len(rows) - 1

    for n, raw in enumerate(content.splitlines(), 1):
        line = _STRING.sub(lambda m: m[1] * 2 if m[1] else "", raw)
        if m := re.match(r"""\s*require(?:_relative)?\s*\(?\s*["']([^"']+)""", raw):
            add("import", m[1].rsplit("/", 1)[-1], n, target=m[1])
            continue
        if (m := _ROUTE.match(raw)) and (METHODS[m[1]], m[3]) not in routes:
            routes[METHODS[m[1]], m[3]] = (m[4], n)
        if m := re.match(r"\s*(?:include|extend|prepend)\s+([A-Z][\w:]*)", line):
            owner = next((x for x, r in reversed(open_) if r is not None and rows[r]["kind"] != "method"), None)
            if owner:
                add("implements", owner, n, target=m[1])
        declared = _DECLARED.match(line)
        body = line
        if declared:
            kind = {"def": "method" if any(r is not None and rows[r]["kind"] in ("class", "module") for _, r in open_) else "function"}.get(declared[1], declared[1])
            more = {"cc": 1, "nesting": 0, "is_test": declared[2].startswith("test_")} if declared[1] == "def" else {}
            at = add(kind, declared[2], n, last=n, exported=True, **more)
            if declared[1] == "class" and declared[3]:
                add("implements", declared[2], n, target=declared[3])
            body = line[declared.end() :]
            if not (declared[1] == "def" and re.match(r"(?:\([^)]*\))?\s*=\s*\S", body)):  # def f(x) = y has no end
                open_.append((declared[2], at))
        functions = [(i, r) for i, (_, r) in enumerate(open_) if r is not None and "cc" in rows[r]]
        for _, r in functions:
            rows[r]["cc"] += len(DECISIONS.findall(body))
        for m in _CALL.finditer(body if declared is None or declared[1] != "def" else re.sub(r"^\s*\([^)]*\)", "", body)):
            if m[2] not in NO_CALLS or m[1]:
                add("call", m[2], n, target=m[1] + m[2])
        if not declared and _OPENS.search(line):
            open_.append(("", None))
            for i, r in functions:
                rows[r]["nesting"] = max(rows[r]["nesting"], sum(x is None for _, x in open_[i + 1 :]))
        if _ENDS.search(line) and open_:
            _, r = open_.pop()
            if r is not None:
                rows[r]["last"] = n
    if routes and FRAMEWORKS.search(content):
        rows += [{"path": path, "kind": "route", "name": f"{m} {t}", "line": n, "target": h} for (m, t), (h, n) in routes.items()]
    return [_row(**r) for r in rows]
