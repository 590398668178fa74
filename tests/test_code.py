"""Facts of source code, by hand-made files of each language and by noise."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions.scalars import client_call
from codeloom.operators.resolution import dispatch_roots, marked_live, source_client_calls, source_routes, topic_nodes
from codeloom.sources.code import LANGUAGES, code_facts
from codeloom.sources.readers import EXTRACTORS, extract_facts, python_facts
from codeloom.sources.ruby import ruby_facts

RUST = """use std::io::{self, Read as R, fmt::*};
use axum::Router;
// fn none() { if x {} }
#[cfg(test)]
mod tests { #[test] fn works() { go::<T>("fn no() {") } }
impl<'a> Show for P<'a> {
    pub fn show(&self) -> String { if a && b { match x { 1 if c => 2, _ => 3 } } else { self.x.call()? } }
}
async fn main() { Router::new().route("/users/{id}", get(show_user).post(h::make)).route(path, get(x)); }
trait T { fn a(&self); fn b(&self) {} }
"""


def facts(path, content, *kinds):
    return [r for r in code_facts(path, content) if r[1] in kinds]


def test_rust():
    assert [(r[2], r[5]) for r in facts("a.rs", RUST, "import")] == [("io", "std::io"), ("R", "std::io::Read"), ("*", "std::io::fmt::*"), ("Router", "axum::Router")]
    # name, parent, decisions (if, &&, match, guard, else, ?), nesting, exported, test
    got = {(r[2], r[3]): (r[6], r[7], r[9], r[10]) for r in facts("a.rs", RUST, "function", "method")}
    assert got == {
        ("works", "tests"): (1, 0, False, True),
        ("show", "P"): (7, 2, True, False),
        ("main", ""): (1, 0, False, False),
        ("a", "T"): (None, None, False, False),
        ("b", "T"): (1, 0, False, False),
    }
    assert [(r[2], r[5]) for r in facts("a.rs", RUST, "route")] == [("GET /users/{id}", "show_user"), ("POST /users/{id}", "make")]
    assert [(r[2], r[5]) for r in facts("a.rs", RUST, "dispatch")] == [("show", "P"), ("b", "T")]
    assert [(r[2], r[5]) for r in facts("a.rs", RUST, "implements")] == [("P", "Show")]
    assert ("call", "P.show", "self.x.call") in [(r[2], r[3], r[5]) for r in facts("a.rs", RUST, "call")]


def test_words_of_one_language_are_names_in_others():
    assert [r[2] for r in facts("a.java", "class K { void go() { x.match(select()); } }", "method", "call")] == ["go", "match", "select"]
    assert [r[5] for r in facts("a.rs", "fn f() { S::new(catch()) }", "call")] == ["S::new", "catch"]


@pytest.mark.parametrize(
    ("path", "content", "expected"),
    [
        ("a.go", "package m\nfunc (s *S[T]) Do(x interface{}) (int, error) {\n  for _, y := range z { g(y) }\n}\n", [("method", "Do", "S", 2, 1, True, 4)]),
        ("a.ts", "export const f = async (a) => a ? g(a) : 1;\nfunction h() {}\n", [("function", "f", "", 2, 0, True, 1), ("function", "h", "", 1, 0, False, 2)]),
        ("a.cs", "class C {\n public int F(int x) => x > 0 ? g(x) : 1;\n int G() { lock (a) { foreach (var b in c) d(b); } }\n}", [("method", "F", "C", 2, 0, True, 2), ("method", "G", "C", 2, 2, False, 3)]),
        ("a.kt", "fun S.go(a: Int) =\n    when (a) { 1 -> f(a) else -> b ?: c }\nfun h() {}\n", [("method", "go", "S", 4, 1, True, 2), ("function", "h", "", 1, 0, True, 3)]),
        ("a.cpp", "A::A(int x) : a(x), b{1} { init(); }\nstatic int z(int q) { do { q--; } while (q > 1); }\n", [("method", "A", "A", 1, 0, True, 1), ("function", "z", "", 3, 1, False, 2)]),
        ("a.php", "<?php\n# it's\nclass H { private function a() { if ($x) {} elseif ($y) { d(); } } }\n", [("method", "a", "H", 3, 1, False, 3)]),
        ("a.scala", "class S {\n  private def h(x: Int) = x match { case 1 => g(x) case _ => 2 }\n}\n", [("method", "h", "S", 3, 1, False, 2)]),
        ("a.java", "class J {\n  abstract int n(String s);\n  @Test public void t() { try { a(); } catch (E e) { while (b) c(); } }\n}", [("method", "n", "J", None, None, False, 2), ("method", "t", "J", 3, 2, True, 3)]),
        ("a.c", "int f(int a);\nstatic int g(int *a) { return f(*a); }\n", [("function", "g", "", 1, 0, False, 2)]),
    ],
)
def test_functions(path, content, expected):
    got = [(r[1], r[2], r[3], r[6], r[7], r[9], r[8]) for r in facts(path, content, "function", "method")]
    assert got == expected


def test_python_decisions_and_routes():
    text = "import fastapi\nclass A(B):\n    @app.get('/k')\n    def _m(self):\n        if a:\n            pass\n        elif b and c:\n            for x in y: f(x)\n        else: pass\n"
    rows = python_facts("k.py", text)
    assert [(r[2], r[6], r[7], r[8], r[9]) for r in rows if r[1] == "method"] == [("_m", 6, 2, 9, False)]
    assert [(r[2], r[5]) for r in rows if r[1] in ("route", "implements")] == [("A", "B"), ("GET /k", "_m")]
    assert not [r for r in python_facts("k.py", text.replace("fastapi", "flask")) if r[1] == "route"]


@pytest.mark.parametrize("ext", [*sorted(LANGUAGES), "rb"])
def test_noise(ext):
    """Any text gives rows with whole columns, and time grows with the length only."""
    some = random.Random(ext)
    words = [*"(){}[]<>;:,.=@#'\"`?&|*\n", "::", "=>", "if", "else", "for", "class", "fn", "function", "def", "impl", "use", "import", "from", "a", "b", "match", "do", "while", "é", "1", "//", "/*"]
    for _ in range(300):
        for r in EXTRACTORS[ext](f"x.{ext}", " ".join(some.choices(words, k=some.randint(0, 50)))):
            assert len(r) == 11 and r[1] and r[2] is not None
    for text in ("'\" ` " * 20000, "f(" * 20000, "if " * 20000, "class A : " * 5000, "a." * 30000 + "b()", "for x " * 10000, "fn f() { " + "a.b(c); " * 20000 + "}"):
        began = time.time()
        EXTRACTORS[ext](f"x.{ext}", text)
        assert time.time() - began < 10


def test_ruby():
    text = """require 'a/b'
module M
  class K < Base
    include Shown
    def go?(a) # if only
      if a && b
        list.each do |x|
          x.save!(1) unless "if x"
        end
      elsif c then d(2) end
    end
    def one; end
    def two(x) = x ? f(x) : 1
  end
end
Rails.application.routes.draw do
  post '/a/:id', to: 'things#make'
end
"""
    rows = ruby_facts("a.rb", text)
    assert [(r[1], r[2], r[3], r[4], r[8]) for r in rows if r[1] in ("module", "class", "method", "function")] == [
        ("module", "M", "", 2, 15), ("class", "K", "M", 3, 14), ("method", "go?", "M.K", 5, 11), ("method", "one", "M.K", 12, 12), ("method", "two", "M.K", 13, 13),
    ]
    assert [(r[2], r[6], r[7]) for r in rows if r[1] == "method"][:2] == [("go?", 5, 2), ("one", 1, 0)]
    assert [(r[2], r[5]) for r in rows if r[1] in ("import", "implements", "route")] == [("b", "a/b"), ("K", "Base"), ("K", "Shown"), ("POST /a/:id", "make")]
    assert [(r[2], r[5], r[3]) for r in rows if r[1] == "call"] == [("save!", "x.save!", "M.K.go?"), ("d", "d", "M.K.go?"), ("f", "f", "M.K")]


def test_empty_and_null_files(spark):
    files = spark.createDataFrame([("a.rs", None), ("b.go", ""), ("c.py", None), (None, "x")], "path string, content string")
    got = extract_facts(files.where("path is not null"))
    assert [(r["path"], r["kind"]) for r in got.collect()] == [("c.py", "module")]


def test_client_call(spark):
    rows = [
        ({"method": "get", "path": "/a/{id}"}, "GET /a/{id}", None),
        ({"method": " post ", "path": " /a "}, "POST /a", None),
        ({"path": "/a"}, None, "base-url-runtime"),
        ({"method": "", "path": "/a"}, None, "base-url-runtime"),
        ({"method": "get"}, None, "base-url-runtime"),
        ({"method": "get", "path": "a/b"}, None, "base-url-runtime"),
        ({"method": "get", "path": "http://h/a"}, None, "base-url-runtime"),
        ({"method": "get", "path": "/a", "path_dynamic": "1"}, None, "base-url-runtime"),
        ({"method": "get", "path": "/a/*"}, None, "path-not-composed"),
        (None, None, "base-url-runtime"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, slots map<string,string>, target string, refusal string")
    got = df.withColumn("c", client_call(F.col("slots"))).where("not (c.target <=> target and c.refusal <=> refusal)")
    assert got.collect() == []


def test_routes_sites_and_roots(spark):
    client = 'use reqwest::Client;\nfn m() { c.get("/a/{id}").send(); c.get(url); }\n'
    files = spark.createDataFrame([("a.rs", RUST), ("b.rs", client), ("c.rs", client.replace("reqwest", "other")), ("d.rs", "fn show_user() {}")], "path string, content string")
    all_ = extract_facts(files).cache()
    routes = {r["name"]: r["handler"] is not None for r in source_routes(all_).collect()}
    assert routes == {"GET /users/{id}": True, "POST /users/{id}": False}
    calls = sorted((r["file_path"], r["scope"], r["target"] or "", r["refusal"] or "") for r in source_client_calls(all_).collect())
    assert calls == [("b.rs", "m", "", "base-url-runtime"), ("b.rs", "m", "GET /a/{id}", "")]
    assert {(r["owner"], r["name"]) for r in dispatch_roots(all_).collect()} == {("P", "show"), ("T", "b")}
    all_.unpersist()


def test_rust_topics():
    text = 'fn f() { c.subscribe(&["a", "b"]); c.subscribe("c"); c.subscribe(x); p.send("d", 1); publish("e"); }'
    assert [(r[1], r[2]) for r in facts("a.rs", text, "publish", "subscribe")] == [("subscribe", "a"), ("subscribe", "b"), ("subscribe", "c"), ("publish", "d")]


def test_topics(spark):
    text = """class C {
  @RabbitListener(queues = "a") void on(String m) { k.convertAndSend("b", m); }
  @JmsListener("a") void at() { k.send("b"); k.send("b"); k.send(name); k.send(" "); }
  @Other("c") void no() { }
}"""
    files = spark.createDataFrame([("A.java", text), ("B.java", text), ("a.rs", RUST)], "path string, content string")
    all_ = extract_facts(files).cache()
    got = {(r["symbol"], r["line"], r["topic"]) for r in topic_nodes(all_).collect()}
    sites = {(f"{f}/C.{m}/{k}/{t}", n, f"topic/{t}") for f in ("A.java", "B.java") for m, n in (("on", 2), ("at", 3)) for k, t in (("consumer", "a"), ("producer", "b"))}
    assert got == sites | {("topic/a", None, None), ("topic/b", None, None)}
    assert {r["source"] for r in marked_live(all_).collect()} == {"a.rs/P/show", "a.rs/T/b"}
    all_.unpersist()
