"""Facts of source code in languages with braces, from tokens and matched brackets.

A file is read once from left to right. Declarations know their scope, last line, whether
they are exported, and (functions) decisions and nesting; imports, calls, supertypes, route
registrations and sites of HTTP clients are rows of their own. There is no grammar behind
it: macros, regular expressions as literals and calls inside interpolated strings are not
seen. Nothing depends on another file, so files can be dealt anyhow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codeloom.sources.facts import row as _row

# Fixed values, up to CLIENTS.
JS_METHODS = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "head": "HEAD", "options": "OPTIONS", "all": "ANY", "use": "ANY"}
SPRING_METHODS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "ANY"}
GO_METHODS = {"GET": "GET", "POST": "POST", "PUT": "PUT", "DELETE": "DELETE", "PATCH": "PATCH", "HEAD": "HEAD", "OPTIONS": "OPTIONS", "Any": "ANY", "HandleFunc": "ANY", "Handle": "ANY"}
CS_METHODS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "HttpHead": "HEAD", "Route": "ANY"}
PHP_METHODS = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "options": "OPTIONS", "any": "ANY", "match": "ANY"}
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
JUNIT = r"^(Test|ParameterizedTest|RepeatedTest|TestFactory|TestTemplate)$"
LISTENERS = ("KafkaListener", "RabbitListener", "JmsListener")
LISTENER_KEYS = ("topics", "queues", "destination", "value")
SENDERS = ("send", "convertAndSend", "publish")
CLIENTS = ("reqwest", "hyper", "isahc", "ureq", "awc", "surf")


@dataclass(frozen=True)
class Language:
    """What a language's tokens mean. The values of decisions, blocks, exported, frameworks and methods are fixed."""

    decisions: str  # tokens that each add a path through a function
    blocks: str  # words that open a nested statement
    exported: str  # how a declaration shows that others see it
    functions: str = ""  # words before a function's name
    types: str = ""  # words before a type's name
    bare: bool = False  # functions without a word before their name, within types (of C, anywhere outside functions)
    imports: str = ""  # words that an import begins with
    by_line: bool = False  # statements end with the line
    frameworks: tuple[str, ...] = ()  # imports that make route registrations of calls or annotations
    methods: dict[str, str] = field(default_factory=dict)
    tests: str = "^$"  # annotations of tests


C_WORDS = "if else for while do case && || ?"
JAVA_WORDS = "if else for while do case catch && || ?"
JAVA_BLOCKS = "if for while do switch try"
TS = Language(JAVA_WORDS, JAVA_BLOCKS, "export", "function", "class interface enum", True, "import", False, ("express", "next", "react"), JS_METHODS)
CPP = Language("if else for while do case catch goto && || ?", "if for while do switch try catch", "nonstatic", "", "class struct enum union namespace", True)
KOTLIN = Language("if else for while do when catch && || ?:", "if for while do when try", "all", "fun", "class interface object", False, "import", True, ("org::springframework",), SPRING_METHODS, JUNIT)
PHP = Language(
    "if else elseif for foreach while do case catch && || and or xor ?", "if for foreach while do switch try match", "unrestricted",
    "function", "class interface trait enum", False, "use", False, ("Illuminate",), PHP_METHODS,
)
LANGUAGES = {
    "rs": Language("if else match while for loop && || ?", "if match while loop for", "pub", "fn", "struct enum trait mod union", False, "use", False, ("axum", "actix_web"), {}, r"^test$"),
    "go": Language("if else for case && ||", "if for switch select", "capital", "func", "type", False, "import", True, ("net::http", "github::com::gin-gonic::gin"), GO_METHODS),
    "java": Language(JAVA_WORDS, JAVA_BLOCKS, "public", "", "class interface enum record", True, "import", False, ("org::springframework",), SPRING_METHODS, JUNIT),
    "cs": Language(
        "if else for foreach while do case catch && || ? ??", "if for foreach while do switch try using lock", "public",
        "", "class interface enum record struct namespace", True, "using", False, ("Microsoft::AspNetCore",), CS_METHODS, r"^(Fact|Theory|Test|TestMethod)$",
    ),
    "c": Language(C_WORDS, "if for while do switch", "nonstatic", "", "struct enum union", True),
    "scala": Language("if else for while do case catch && ||", "if for while do match try", "unrestricted", "def", "class trait object", False, "import", True),
    **dict.fromkeys(("cpp", "cc", "cxx", "hpp", "hh", "hxx", "h"), CPP),
    **dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs"), TS),
    **dict.fromkeys(("kt", "kts"), KOTLIN),
    "php": PHP,
}

# Words that name nothing.
_TS_WORDS = "await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null return super switch this throw true try typeof var void while with yield"
_CPP_WORDS = (
    "alignas alignof asm auto bool break case catch char class const constexpr continue decltype default delete do double else enum explicit export extern false float for friend goto if inline int long "
    "mutable namespace new noexcept nullptr operator private protected public register return short signed sizeof static struct switch template this throw true try typedef typeid typename union unsigned "
    "using virtual void volatile while"
)
_KOTLIN_WORDS = "as break class continue do else false for fun if in interface is null object package return super this throw true try typeof val var when while"
KEYWORDS = {
    "rs": "as async await break const continue dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type unsafe use where while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new "
    "package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while",
    "cs": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in "
    "int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch "
    "this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while",
    "scala": "abstract case catch class def do else extends false final finally for if implicit import lazy match new null object override package private protected return sealed super this throw trait try true type val var while with yield",
    "php": "abstract and array as break case catch class clone const continue declare default do echo else elseif empty enum extends final finally fn for foreach function global goto if implements include "
    "instanceof interface isset list match namespace new or print private protected public require return static switch throw trait try unset use var while xor yield",
    **{k: _TS_WORDS for k, v in LANGUAGES.items() if v is TS},
    **{k: _CPP_WORDS for k, v in LANGUAGES.items() if v is CPP},
    **{k: _KOTLIN_WORDS for k, v in LANGUAGES.items() if v is KOTLIN},
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
# Words of a type, or before one, that a function's name may follow.
BEFORE_NAMES = frozenset("void public private protected static bool boolean byte char decimal double float int long short string object unsigned signed auto sbyte uint ulong ushort final abstract const override virtual async".split())
TYPES = {"class", "struct", "enum", "trait", "interface", "record", "object", "union", "type", "impl"}
KINDS = {"mod": "module", "namespace": "module"}

_NAME = r"[^\W\d][\w$]*|\$\w+"
_OPERATOR = r"&&|\|\||\?\?=|\?\?|\?:|\?\.|=>|->|::|[^\w\s]"
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE = r'"(?:[^"\\]|\\.)*+"'
_SINGLE = r"'(?:[^'\\\n]|\\.)*+'"


def _scanner(extra: str, strings: str) -> re.Pattern:
    return re.compile(rf"(?P<skip>{_COMMENT}{extra})|(?P<string>{strings})|(?P<word>{_NAME}|\d[\w.]*)|(?P<op>{_OPERATOR})", re.S)


SCANNERS = {
    "rs": _scanner("", rf"""b?r(?P<h>#*)".*?"(?P=h)|b?{_DOUBLE}|'(?:\\[^']+|[^'\\\n])'"""),
    "go": _scanner("", rf"`[^`]*`|{_DOUBLE}|{_SINGLE}"),
    "ts": _scanner("", rf"`(?:[^`\\]|\\.)*+`|{_DOUBLE}|{_SINGLE}"),
    "php": _scanner(r"|\#(?!\[)[^\n]*", rf"{_DOUBLE}|'(?:[^'\\]|\\.)*+'"),
    "": _scanner("", rf'""".*?"""|@"(?:[^"]|"")*"|{_DOUBLE}|{_SINGLE}'),
}


@dataclass
class Scope:
    """A declaration while its body is read."""

    end: int
    path: str
    kind: str
    row: int | None
    base: int  # blocks that were open before it
    dynamic: bool = False  # its functions are called through a trait
    test: bool = False


class Source:
    """The tokens of a file, with the bracket that closes each bracket."""

    def __init__(self, ext: str, content: str):
        family = ext if ext in ("rs", "go", "php") else "ts" if LANGUAGES.get(ext) is TS else ""
        self.text, self.kind, self.line, self.column, self.indent = [], [], [], [], []
        at, line, start = 0, 1, 0
        for m in SCANNERS[family].finditer(content):
            n = content.count("\n", at, m.start())
            if n:
                line += n
                start = content.rfind("\n", 0, m.start()) + 1
            at = m.start()
            if m.lastgroup != "skip" and m["skip"] is None:
                self.text.append(m[0])
                self.kind.append("string" if m["string"] is not None else "word" if m["word"] is not None else "op")
                self.indent.append(self.indent[-1] if self.line and self.line[-1] == line else at - start)
                self.line.append(line)
                self.column.append(at - start)
        self.close, open_ = {}, []
        pairs = {")": "(", "]": "[", "}": "{"}
        for i, (t, k) in enumerate(zip(self.text, self.kind)):
            if k == "op" and t in "([{":
                open_.append(i)
            elif k == "op" and t in pairs and open_ and self.text[open_[-1]] == pairs[t]:
                self.close[open_.pop()] = i
        for i in open_:
            self.close[i] = len(self.text)

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "word" and not self.text[i][0].isdigit()

    def literal(self, i: int) -> str | None:
        """The text of a string without anything put into it."""
        if not (0 <= i < len(self.text) and self.kind[i] == "string"):
            return None
        body = re.sub(r"""^(?:b?r#*|b|@)?["'`]+|["'`]+#*$""", "", self.text[i])
        return None if self.text[i][0] == "`" and "${" in body else body

    def chain(self, i: int) -> int:
        """Where the dotted path begins that ends with the name at i."""
        while self.at(i - 1) in (".", "::", "->", "?.", "\\") and self.name(i - 2):
            i -= 2
        return i

    def chain_end(self, i: int) -> int:
        while self.at(i + 1) in (".", "::", "->", "?.", "\\") and self.name(i + 2):
            i += 2
        return i

    def join(self, i: int, j: int) -> str:
        return "".join(self.text[i : j + 1])


def _use_tree(text: str, sep: str) -> list[tuple[str, str]]:
    """(local name, target) of an import with groups in braces and other names."""
    out, todo = [], [("", text.strip())]
    while todo:
        prefix, t = todo.pop()
        head, brace, rest = t.partition("{")
        if brace:
            depth, part, inner = 0, "", rest[: rest.rfind("}")] if "}" in rest else rest
            for ch in inner + ",":
                depth += (ch == "{") - (ch == "}")
                if ch == "," and depth == 0:
                    if part.strip():
                        todo.append((prefix + head.strip(), part.strip()))
                    part = ""
                else:
                    part += ch
            continue
        path, _, alias = re.sub(r"\s+(?:as)\s+|\s*=>\s*", "\x00", t).partition("\x00")
        path = prefix + path.strip()
        if path.endswith(f"{sep}self"):
            path = path.removesuffix(f"{sep}self")
        last = path.split(sep)[-1]
        out.append((alias.strip() or ("*" if last == "_" else last), path))
    return out[::-1]


def _imports(s: Source, i: int, ext: str, lang: Language) -> tuple[list[tuple[str, str, int]], int]:
    """(name, target, line) of the import that begins at i, and its last token."""
    j = i + 1
    if ext == "go":
        last = s.close[j] if s.at(j) == "(" else j + (not s.literal(j))
        found = [x for x in range(j, min(last + 1, len(s))) if s.kind[x] == "string"]
        alias = lambda x: s.at(x - 1) if s.name(x - 1) and s.line[x - 1] == s.line[x] and x - 1 > i else None
        return [(alias(x) or s.literal(x).rsplit("/", 1)[-1], s.literal(x), s.line[x]) for x in found], last
    if lang is TS:
        end, parts = j, []
        while end < len(s) and s.kind[end] != "string" and s.at(end) not in (";", "="):
            parts.append(s.text[end])
            end += 1
        module = s.literal(end)
        if module is None or s.at(j) in ("(", "."):
            return [], i
        text = " ".join(p for p in parts if p not in ("from", "type"))
        named = re.search(r"\{(.*)\}", text)
        out = [(m[2] or m[1], f"{module}::{m[1]}", s.line[i]) for m in re.finditer(r"([\w$]+)(?:\s+as\s+([\w$]+))?", named[1] if named else "")]
        rest = re.sub(r"\{.*\}", "", text)
        if m := re.search(r"\*\s*as\s+([\w$]+)", rest):
            out.insert(0, (m[1], module, s.line[i]))
        elif m := re.match(r"\s*([\w$]+)", rest):
            out.insert(0, (m[1], module, s.line[i]))
        return out or [(module, module, s.line[i])], end
    end = i
    while end + 1 < len(s) and s.at(end + 1) != ";" and not (lang.by_line and s.line[end + 1] != s.line[end] and s.at(end) not in (",", "{", ".")):
        end += 1
    words = s.text[j : end + 1]
    if ext == "cs" and (s.at(j) == "(" or s.at(j) == "var" or (len(words) > 1 and s.name(j) and s.name(j + 1) and s.at(j) != "static")):
        return [], i
    if words[:1] in (["static"], ["function"], ["const"]):
        words = words[1:]
    if ext == "cs" and "=" in words:
        return [(words[0], "".join(words[2:]), s.line[i])], end
    sep = {"rs": "::", "php": "\\"}.get(ext, ".")
    text = "".join(f" {w} " if w == "as" else w for w in words)
    return [(n, t, s.line[i]) for n, t in _use_tree(text, sep) if t], end


def _block_ends(s: Source, lang: Language, ext: str) -> dict[int, int]:
    """Last token of each nested statement by its first; ``else`` and ``catch`` go with what they follow."""
    words, ends = set(lang.blocks.split()), {}

    # From each token: where its statement ends, and where a body begins (or what shows that there is none).
    stop, brace = [len(s)] * (len(s) + 2), [len(s)] * (len(s) + 2)
    no_body = ("=>", "}", ";") if ext == "rs" else ("=>", "}")
    for j in range(len(s) - 1, -1, -1):
        t = s.text[j]
        after = s.close[j] + 1 if s.kind[j] == "op" and t in "([{" else j + 1
        line_ends = lang.by_line and s.line[min(j + 1, len(s) - 1)] != s.line[j]
        stop[j] = j if t in (";", "}") or line_ends else stop[after]
        brace[j] = j if t == "{" or t in no_body else brace[after]

    def header(i: int) -> int | None:
        """The first token of the body."""
        if ext in ("rs", "go"):
            return brace[i + 1] if s.at(brace[i + 1]) == "{" else None
        return s.close[i + 1] + 1 if s.at(i + 1) == "(" else i + 1

    def statement(j: int) -> int:
        if s.at(j) == "{":
            return s.close[j]
        return ends.get(j, stop[min(j, len(s))])

    for i in range(len(s) - 1, -1, -1):
        if s.kind[i] != "word" or s.text[i] not in words or s.at(i - 1) in (".", "::", "->", "?."):
            continue
        if s.text[i] == "while" and s.at(i - 1) == "}" and "do" in words and s.at(s.close.get(i + 1, -2) + 1) == ";":
            continue  # the end of a do
        j = header(i)
        if j is None or (ext == "cs" and s.text[i] == "using" and s.at(i + 1) != "("):
            continue
        end = statement(j)
        if ext == "scala" and s.text[i] == "match":
            end = s.close[i + 1] if s.at(i + 1) == "{" else end
        if s.text[i] == "do" and s.at(end + 1) == "while":
            end = s.close.get(end + 2, end + 1)
        while s.at(end + 1) in ("else", "elseif", "catch", "finally") and end + 1 < len(s):
            k = end + 2
            if s.at(end + 1) in ("catch", "elseif") and s.at(k) == "(":
                k = s.close[k] + 1
            end = max(statement(k), end + 1)
        ends[i] = end
    return ends


def _body(s: Source, j: int, ext: str, by_line: bool, words: set[str]) -> tuple[int, bool]:
    """The last token of the declaration whose header goes on at j, and whether it has a body; ``words`` begin the next declaration."""
    j = min(j, len(s))
    left = s.indent[j - 1]
    while j < len(s):
        t = s.at(j)
        if t == "{":
            if s.at(j - 1) in (":", "|") and ext in ("ts", "tsx") or (ext == "go" and s.at(j - 1) in ("interface", "struct") and s.at(s.close[j] + 1) == "{"):
                j = s.close[j] + 1
                continue
            return s.close[j], True
        if t in (";", "}", ")"):
            return (j if t == ";" else j - 1), False
        if t in words and s.name(j + 1):
            return j - 1, False
        script = LANGUAGES[ext] is TS and t == "=>" and s.at(j + 1) != "{"
        if script or (t in ("=", "=>") and ext in ("kt", "kts", "scala", "cs")):
            while j + 1 < len(s) and s.at(j + 1) not in (";", "}", ")") and not (s.at(j + 1) in words and s.name(j + 2)) and not (s.line[j + 1] != s.line[j] and s.column[j + 1] <= left):
                j = min(s.close.get(j + 1, j + 1), len(s) - 1)
            return j, True
        if by_line and s.line[j] != s.line[j - 1] and t not in (":", "=", "->", "where", "extends", "with") and s.at(j - 1) not in (":", ",", "=", "->", "extends", "with"):
            return j - 1, False
        j = s.close[j] + 1 if t in ("(", "[") else j + 1
    return len(s) - 1, False


def _named_function(s: Source, i: int, ext: str, scope: Scope | None) -> bool:
    """Whether the name at i, before a parenthesis, begins a function without a word of its own."""
    inside = scope.kind if scope else "file"
    if s.text[i] in KEYWORDS[ext] or inside in ("function", "method") or s.at(i - 1) in (".", "->", "?.", "=", "new", "return", "@", "("):
        return False
    if ext in ("ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "cs") and inside not in TYPES:
        return False
    j = s.close[i + 1] + 1
    before = s.name(i - 1) or s.at(i - 1) in (">", "*", "&", "]", "?")
    if s.at(j) == "{":
        return True
    if s.at(j) == ";":
        return inside in TYPES and before and s.at(i - 1) not in KEYWORDS[ext] - BEFORE_NAMES
    if ext == "cs" and s.at(j) in ("=>", "where"):
        return before
    if ext == "java" and s.at(j) == "throws":
        return True
    if ext in ("ts", "tsx") and s.at(j) == ":":
        return True
    if ext in ("c", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "h"):
        while s.at(j) in ("const", "noexcept", "override", "final", "&") or (s.at(j) == "->" and s.name(j + 1)):
            j += 2 if s.at(j) == "->" else 1
        if s.at(j) == "{":
            return True
        return s.at(j) == ":" and s.name(j + 1) and s.at(j + 2) in ("(", "{") and ext != "c"
    return False


def _supertypes(s: Source, i: int, j: int, ext: str) -> list[str]:
    """Names after extends, implements, with or a colon in a type's header."""
    out, on, k = [], False, i
    while k < j and s.at(k) != "{":
        if s.at(k) in ("(", "["):
            k = min(s.close[k], j)
        elif s.at(k) == "<":
            depth = 1
            while depth and k + 1 < j:
                k += 1
                depth += (s.at(k) == "<") - (s.at(k) == ">")
        elif s.at(k) in ("extends", "implements", "with") or (s.at(k) == ":" and ext in ("cs", "kt", "kts", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "h")):
            on = True
        elif s.at(k) == "where":
            on = False
        elif on and s.name(k) and s.at(k) not in ("public", "private", "protected", "virtual"):
            e = s.chain_end(k)
            out.append(s.join(k, e))
            k = e
        k += 1
    return out


def _exported(s: Source, i: int, name: str, how: str, first: int) -> bool:
    before = set(s.text[first:i])
    if how == "pub":
        return "pub" in before
    if how == "export":
        return "export" in before
    if how == "capital":
        return name[:1].isupper()
    if how == "public":
        return "public" in before
    if how == "nonstatic":
        return "static" not in before
    return how != "unrestricted" or not before & {"private", "protected"}


def canonical(target: str) -> str:
    return "::".join(p for p in re.split(r"::|->|\?\.|[./\\]", target) if p)


def code_facts(path: str, content: str) -> list[tuple]:
    """Rows of FACTS (readers) of one file; a file without tokens has none."""
    ext = path.rsplit(".", 1)[-1]
    lang = LANGUAGES[ext]
    s = Source(ext, content)
    functions, types, imports = set(lang.functions.split()), set(lang.types.split()), set(lang.imports.split())
    decisions, blocks = set(lang.decisions.split()), _block_ends(s, lang, ext)
    keywords = KEYWORDS[ext]
    rows: list[dict] = []
    scopes: list[Scope] = []
    open_blocks: list[int] = []
    routes: list[tuple] = []
    sites: list[tuple] = []
    notes: list[tuple[str, str | None]] = []  # annotations before a declaration
    first = 0  # token that the statement begins with
    topics: list[str] = []  # what the function after the annotations listens to
    fields: set[int] = set()  # names that a constructor gives values to before its body

    def add(kind: str, name: str, line: int, **more) -> int:
        rows.append({"path": path, "kind": kind, "name": name, "parent": more.pop("parent", scopes[-1].path if scopes else ""), "line": line, **more})
        return len(rows) - 1

    def enter(i: int, kind: str, name: str, after: int, parent: str | None = None) -> None:
        nonlocal notes, topics
        end, body = _body(s, after, ext, lang.by_line, types | functions)
        up = scopes[-1].path if scopes else ""
        if parent is None:
            parent = up
        if kind == "function" and (parent != up or (scopes and scopes[-1].kind in TYPES)):
            kind = "method"
        more = {"last": s.line[min(max(end, i), len(s) - 1)], "exported": _exported(s, i, name, lang.exported, first)}
        if kind in ("function", "method"):
            test = any(re.search(lang.tests, n) for n, _ in notes) or any(x.test for x in scopes)
            if ext == "go":
                test = path.endswith("_test.go") and bool(re.match(r"Test|Benchmark|Fuzz", name))
            more |= {"cc": 1 if body else None, "nesting": 0 if body else None, "is_test": test}
            routes.extend((lang.methods[n], p, name, s.line[i]) for n, p in notes if n in lang.methods and p is not None)
            if ext == "rs":
                routes.extend((n.upper(), p, name, s.line[i]) for n, p in notes if n in VERBS and p is not None)
                if scopes and body and scopes[-1].dynamic:
                    add("dispatch", name, s.line[i], target=scopes[-1].path)
        row = add(KINDS.get(kind, kind), name, s.line[i], parent=parent, **more)
        if kind == "method":
            for t in topics:
                add("subscribe", t, s.line[i], parent=f"{parent}.{name}".strip("."))
        notes, topics = [], []
        if kind in TYPES:
            for t in _supertypes(s, after, end, ext):
                add("implements", name, s.line[i], target=t)
        scopes.append(Scope(end, f"{parent}.{name}".strip("."), KINDS.get(kind, kind), row, len(open_blocks)))

    if ext in ("c", *(k for k, v in LANGUAGES.items() if v is CPP)):
        for m in re.finditer(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)', content):
            add("import", m[1].rsplit("/", 1)[-1], content.count("\n", 0, m.start()) + 1, target=m[1])
    i = 0
    while i < len(s):
        while scopes and i > scopes[-1].end:
            scopes.pop()
            notes = []
        while open_blocks and i > open_blocks[-1]:
            open_blocks.pop()
        t, scope = s.text[i], scopes[-1] if scopes else None
        if s.at(i - 1) in ("{", "}", ";") or (lang.by_line and i and s.line[i] != s.line[i - 1]):
            first = i
        inner = [x for x in scopes if x.row is not None and x.kind in ("function", "method")]
        if t in decisions and s.kind[i] != "string":
            for x in inner:
                rows[x.row]["cc"] = (rows[x.row]["cc"] or 1) + 1
        if i in blocks:
            open_blocks.append(min(blocks[i], open_blocks[-1]) if open_blocks else blocks[i])
            for x in inner:
                rows[x.row]["nesting"] = max(rows[x.row]["nesting"] or 0, len(open_blocks) - x.base)
        # Annotations
        attribute = (t == "#" and s.at(i + 1) == "[" and ext in ("rs", "php")) or (t == "[" and ext == "cs" and not inner and s.at(i - 1) in ("{", "}", ";", "]", ""))
        if attribute:
            b = i + (t == "#")
            k = b + 1
            while k < s.close[b] and s.name(k):
                e = s.chain_end(k)
                call = s.at(e + 1) == "("
                if s.text[e] == "cfg" and "test" in s.text[e : s.close[b]]:
                    notes.append(("cfg_test", None))
                else:
                    notes.append((s.text[e], s.literal(e + 2) if call else None))
                k = (s.close[e + 1] if call else e) + 2
            i = s.close[b] + 1
            continue
        if t == "@" and s.name(i + 1) and s.at(i + 1) != "interface" and s.kind[i] == "op" and ext in ("java", "kt", "kts", "scala", "ts", "tsx", "js", "jsx"):
            e = s.chain_end(i + 1)
            call = s.at(e + 1) == "("
            notes.append((s.text[e], s.literal(e + 2) if call else None))
            if ext == "java" and call and s.text[e] in LISTENERS:
                named = (s.literal(k + 2) for k in range(e + 2, min(s.close[e + 1], len(s))) if s.text[k] in LISTENER_KEYS and s.at(k + 1) == "=")
                topics.extend(x.strip() for x in (s.literal(e + 2), *named) if x and x.strip())
            i = s.close[e + 1] + 1 if call else e + 1
            continue
        if s.kind[i] != "word":
            i += 1
            continue
        fresh = s.at(i - 1) not in (".", "::", "->", "?.")
        # Imports
        if t in imports and fresh and (not inner or ext == "rs") and (ext != "php" or not (scope and scope.kind in TYPES)):
            found, end = _imports(s, i, ext, lang)
            for name, target, line in found:
                add("import", name, line, target=target)
            if end > i:
                i = end + 1
                continue
        # Declarations
        if t == "impl" and ext == "rs" and fresh and not inner:
            j = i + 1
            if s.at(j) == "<":
                depth = 1
                while depth and j + 1 < len(s):
                    j += 1
                    depth += (s.at(j) == "<") - (s.at(j) == ">" and s.at(j - 1) != "-")
                j += 1
            e = s.chain_end(j) if s.name(j) else j
            trait, k = None, e + 1
            while k < len(s) and s.at(k) not in ("for", "{", ";"):
                k += 1
            if s.at(k) == "for":
                trait, j = s.join(j, e), k + 1
                while s.at(j) in ("&", "'", "mut", "dyn") and j < len(s):
                    j += 1
                e = s.chain_end(j) if s.name(j) else j
            name = s.at(e)
            if trait:
                add("implements", name, s.line[i], target=trait)
            end, _ = _body(s, e + 1, ext, False, types | functions)
            scopes.append(Scope(end, ".".join(x for x in (scope.path if scope else "", name) if x), "impl", None, len(open_blocks), trait is not None))
            i = e + 1
            continue
        if t in types and fresh and s.name(i + 1) and s.at(i + 1) not in keywords and (ext != "cs" or s.at(i - 1) != "where"):
            e = s.chain_end(i + 1) if t == "namespace" else i + 1
            flat = ext in ("c", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "h") and s.at(e + 1) not in ("{", ":", "final")
            if not flat and s.at(e + 1) not in ("(", ".") or (s.at(e + 1) == "(" and t in ("record", "class", "struct")):
                module = t == "mod" and ("cfg_test", None) in notes
                enter(i + 1, t, s.join(i + 1, e), e + 1)
                scopes[-1].test, scopes[-1].dynamic = module, t == "trait" and ext == "rs"
                i = e + 1
                continue
        if t in functions and fresh:
            j, parent = i + 1, None
            if ext == "go" and s.at(j) == "(":
                held = [x for x in range(j, s.close[j]) if s.name(x)]
                generic = next((x for x in range(j, s.close[j]) if s.at(x) == "["), s.close[j])
                held = [x for x in held if x < generic]
                j, parent = s.close[j] + 1, s.text[held[-1]] if held else None
            if s.at(j) in ("&", "*"):
                j += 1
            if s.at(j) == "<":
                while j < len(s) and s.at(j) != ">":
                    j += 1
                j += 1
            if ext in ("kt", "kts") and s.name(j):
                e = s.chain_end(j)
                if e > j:
                    j, parent = e, s.text[e - 2]
            if s.name(j):
                enter(j, "function", s.text[j], j + 1, parent)
                i = j + 1
                continue
        if lang is TS and t in ("const", "let", "var") and s.name(i + 1) and s.at(i + 2) in ("=", ":") and not inner:
            k = i + 2
            while k < len(s) and s.at(k) not in ("=", ";"):
                k = s.close[k] + 1 if s.at(k) in ("(", "[", "{") else k + 1
            k += 1 + (s.at(k + 1) == "async")
            after = s.close[k] + 1 if s.at(k) == "(" else k + 1
            if s.at(k) == "function" or (s.at(k) == "(" and s.at(after) in ("=>", ":")) or (s.name(k) and s.at(k + 1) == "=>"):
                enter(i + 1, "function", s.text[i + 1], after)
                i = k
                continue
        if lang.bare and s.at(i + 1) == "(" and s.name(i) and (fresh or s.at(i - 1) == "::") and _named_function(s, i, ext, scope):
            parent = s.text[i - 2] if s.at(i - 1) == "::" and s.name(i - 2) else None
            after = s.close[i + 1] + 1
            if s.at(after) == ":" and ext not in ("ts", "tsx"):  # what a constructor begins with
                while s.at(after) in (":", ",") and s.name(after + 1) and s.at(after + 2) in ("(", "{"):
                    fields.add(after + 1)
                    after = s.close[after + 2] + 1
            enter(i, "function", t, after, parent)
            i += 1
            continue
        # Calls
        p = i + 1
        if s.at(p) == "::" and s.at(p + 1) == "<":
            p, depth = p + 1, 1
            while depth and p + 1 < len(s):
                p += 1
                depth += (s.at(p) == "<") - (s.at(p) == ">")
            p += 1
        if s.at(p) == "(" and s.name(i) and i not in fields and (t not in keywords or not fresh) and (inner or not scope or scope.kind not in TYPES or s.at(s.chain(i) - 1) in ("=", ",", "(", "new")):
            start = s.chain(i)
            add("call", t, s.line[i], target=s.join(start, i))
            text, dotted = s.literal(p + 1), s.at(i - 1) in (".", "::", "->")
            if text and text.strip() and ((ext == "java" and t in SENDERS) or (ext == "rs" and dotted and t in ("publish", "send"))):
                add("publish", text.strip(), s.line[i])
            if ext == "rs" and dotted and t == "subscribe":
                several = range(p + 3, min(s.close[p + 2], len(s))) if s.at(p + 1) == "&" and s.at(p + 2) == "[" else (p + 1,)
                for x in several:
                    if s.literal(x) and s.literal(x).strip():
                        add("subscribe", s.literal(x).strip(), s.line[i])
            handler, h = None, p + 3
            if s.at(p + 2) == "," and s.name(h) and s.at(s.chain_end(h) + 1) in (",", ")"):
                handler = s.text[s.chain_end(h)]
            if ext != "java" and lang is not KOTLIN and t in lang.methods and dotted and text is not None and s.at(p + 2) in (",", ")"):
                routes.append((lang.methods[t], text, handler, s.line[i]))
            if ext == "rs" and t == "route" and text is not None and s.at(p + 2) == ",":
                for k in range(h, s.close[p]):
                    if s.text[k] in VERBS and s.at(k + 1) == "(":
                        empty = s.close[k + 1] == k + 2
                        a = k + 6 if empty and s.at(k + 4) == "to" else k + 2
                        e = s.chain_end(a)
                        routes.append((s.text[k].upper(), text, s.text[e] if s.name(a) and s.at(e + 1) in (")", ",") else None, s.line[i]))
            if ext == "rs" and t in VERBS and dotted and s.close[p] > p + 1:
                sites.append((t, text if s.at(p + 2) in (")", ",") else None, s.line[i], scope.path if scope else ""))
        i += 1
    known = {canonical(r["target"]) for r in rows if r["kind"] in ("import", "call") and r.get("target")}
    uses = lambda names: any(k == n or k.startswith(f"{n}::") for n in names for k in known)
    if routes and uses(lang.frameworks):
        kept: dict[tuple, tuple] = {}
        for method, template, handler, line in routes:
            if (method, template) not in kept or (kept[method, template][0] is None and handler):
                kept[method, template] = (handler, line)
        rows += [{"path": path, "kind": "route", "name": f"{m} {p}", "line": n, "target": h} for (m, p), (h, n) in kept.items()]
    if ext == "rs" and sites and uses(CLIENTS):
        rows += [{"path": path, "kind": "client_site", "name": m, "parent": o, "line": n, "target": p} for m, p, n, o in sites]
    return [_row(**r) for r in rows]
