"""Globs as joins against globs as columns, the whole evaluation, and members that fail."""

import random
import time

from pyspark.sql import functions as F

from codeloom.functions.predicates import matches_glob
from codeloom.operators import federation as S
from codeloom.operators import globs as B
from codeloom.operators import rules as L

GLOBS = ["**", "*.md", "src/**", "src/*/a.rs", "src/m?/**/*.rs", "src/{a,b}/*.rs", "src/[ab]*/x", "a.rs", "src/m1/a.rs", "**/*.test.ts", "src/m1/*", "*", "src/*.r?", "docs/**/x*", "src/m1/**/a.rs"]
PATHS = ["a.rs", "b.md", "src/a.rs", "src/m1/a.rs", "src/m1/deep/a.rs", "src/m12/a.rs", "src/a/z.rs", "src/b/z.rs", "src/ab/x", "docs/x1", "docs/q/r/x.md", "src/m1/x.test.ts", "x.test.ts", "src/a.rb", "no", "", None]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_globs_by_joins_are_globs_by_columns(spark):
    paths = spark.createDataFrame([(p,) for p in [*PATHS, *PATHS[:5]]], "path string")
    got = rows(B.glob_hits(paths, [*GLOBS, "**"]))
    one = spark.createDataFrame([(p,) for p in PATHS if p is not None], "path string")
    want = [(r.path, g) for g in GLOBS for r in one.where(matches_glob(F.col("path"), g)).collect()]
    assert got == sorted(want)


def test_the_first_layer_counts(spark):
    paths = spark.createDataFrame([("src/m1/a.rs",), ("src/m2/b.rs",), ("x",)], "path string")
    assert {r.path: r.layer for r in B.first_globs(paths, [("one", ["src/m1/**", "q"]), ("any", ["src/**", "**/*.rs"])]).collect()} == {"src/m1/a.rs": "one", "src/m2/b.rs": "any", "x": None}


def test_very_many_rules_are_planned_at_once(spark):
    rng = random.Random(1)
    rules = [(f"src/p{rng.randrange(3000)}/**", f"src/p{rng.randrange(3000)}/*.rs") for _ in range(10_000)]
    edges = spark.range(3000).select(F.format_string("src/p%d/a.rs", F.col("id")).alias("source"), F.format_string("src/p%d/b.rs", F.col("id") * 7 % 3000).alias("target"))
    start = time.time()
    found = B.paired(edges, rules)
    found._jdf.queryExecution().executedPlan()
    assert time.time() - start < 20  # seconds beside other work; some two alone
    want = sum(1 for a, b in set(rules) if int(a[5:-3]) * 7 % 3000 == int(b[5:-5]))
    assert found.count() == want


FUNCTIONS = "id bigint, name string, kind string, file_path string, cc bigint, line_count bigint, nesting bigint, is_dead boolean, is_duplicate boolean, clone_group bigint, is_test boolean, exported boolean"


def facts(spark):
    functions = spark.createDataFrame(
        [
            (1, "a", "function", "src/low/a.rs", 20, 10, 1, True, False, None, False, True),
            (2, "b", "function", "src/high/b.rs", 1, 200, 9, True, True, 7, False, True),
            (3, "t", "function", "src/high/t.rs", 99, 1, 9, True, True, 7, True, True),
            (4, "c", "method", "src/high/b.rs", None, None, None, None, None, 7, False, False),
        ],
        FUNCTIONS,
    )
    nodes = spark.createDataFrame([(9, "doc_section")], "id bigint, kind string")
    edges = spark.createDataFrame([(3, 2, "calls"), (9, 1, "doc_reference")], "source bigint, target bigint, kind string")
    imports = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "source bigint, target bigint")
    modules = spark.createDataFrame([(1, "low", "src/low"), (2, "high", "src/high"), (3, "high", "src/high"), (4, "high", "src/high")], "id bigint, module string, directory string")
    containers = spark.createDataFrame([(5, 30, 10)], "id bigint, methods bigint, span bigint")
    return L.Facts(functions, imports, modules, containers, nodes, edges)


def test_eight_sections(spark):
    policy = L.Policy(
        limits={"max_cycles": 0, "max_cc": 15, "max_fn_lines": 80, "no_god_files": 1, "max_fan_in": 0, "max_fan_out": 1, "max_dead": L.Budget(delta=0), "max_duplicates": 0, "max_nesting_depth": 4, "max_clone_ratio": 6000, "no_god_containers": 0},
        layers=[("low", ["src/low/**"]), ("high", ["src/**"])], boundaries=[("high", "low")], forbidden=[("**/a.rs", "src/high/*")], tested=["src/**"], documented=["**/*.rs"],
    )
    assert policy.checked() == 11 + 1 + 1 + 1 + 1 + 1
    got = rows(L.evaluate(facts(spark), policy, {"max_dead": 1}))
    assert got == sorted([
        ("constraints", "max_cc", "a#1", 20), ("constraints", "max_cc", "t#3", 99), ("constraints", "max_cycles", "", 1), ("constraints", "max_fn_lines", "b#2", 200), ("constraints", "no_god_files", "src/high/b.rs", 2),
        ("coupling", "max_fan_in", "high", 1), ("coupling", "max_fan_in", "low", 1), ("redundancy", "max_dead", "", 2), ("redundancy", "max_duplicates", "", 1),
        ("structural", "max_clone_ratio", "", 6667), ("structural", "max_nesting_depth", "b#2", 9), ("structural", "no_god_containers", "", 1),
        ("layering", "layer_order", "src/low/a.rs -> src/high/b.rs", 1), ("layering", "boundary high->low", "src/high/b.rs -> src/low/a.rs", 1),
        ("forbidden_imports", "**/a.rs -> src/high/*", "src/low/a.rs -> src/high/b.rs", 1), ("require_tested", "src/**", "a#1", 1), ("require_documented", "**/*.rs", "b#2", 1),
    ])
    none = L.evaluate(facts(spark), L.Policy(limits={"max_dead": L.Budget(delta=0), "max_cc": 99}))
    assert rows(none) == []  # no baseline, and nothing over


def test_functions_are_scanned_once_for_all_their_rules(spark, tmp_path):
    f = facts(spark)
    f.functions.write.parquet(f"file://{tmp_path}/functions")
    stored = spark.read.parquet(f"file://{tmp_path}/functions")
    rows_ = L.function_rows(stored, {"max_cc": 1, "max_fn_lines": 1, "max_nesting_depth": 1, "no_god_files": 1, "max_dead": 1, "max_duplicates": 1, "max_brain_methods": 1, "max_clone_ratio": 1}, L.Thresholds())
    assert rows_.groupBy("rule", "subject").count()._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2  # initial and final plan of one scan


def test_a_member_that_fails_leaves_the_others(spark):
    broken = lambda: spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    rows_, errors = S.fan_out(spark, {"a": lambda: spark.range(2), "b": broken, "c": lambda: spark.read.parquet("file:///no/such/place"), "d": lambda: spark.range(1)}, "id bigint")
    assert rows(rows_) == [("a", 0), ("a", 1), ("d", 0)]
    found = {r.member: r.error for r in errors.collect()}
    assert set(found) == {"b", "c"} and found["c"] == "PATH_NOT_FOUND" and found["b"]
    assert S.fan_out(spark, {}, "id bigint")[0].collect() == []


def test_links_are_rewritten_in_place(spark):
    from codeloom.operators.documents import with_links

    docs = {
        1: ("a/b/x.md", "[n](../c/y.md#q) and [n](../c/y.md) [r](/a/c/y.md), [m](z.md) [o](http://a/c/y.md) [f](#s) [u](../../../y.md) (a/c/y.md) end"),
        2: ("x.md", "[n](a/c/y.md)[n](a/./c/y.md)"),
        3: ("x.md", "no links"),
        4: ("x.md", None),
        5: ("", ""),
    }
    df = spark.createDataFrame([(k, p, b, 7) for k, (p, b) in docs.items()], "id bigint, path string, body string, links int")
    targets = spark.createDataFrame([("a/c/y.md", "/w/y"), ("a/c/y.md", "/w/z")], "path string, href string")
    got = {r.id: r.body for r in with_links(df.drop("links"), targets).collect()}
    assert got == {
        1: "[n](/w/y#q) and [n](/w/y) [r](/w/y), [m](z.md) [o](http://a/c/y.md) [f](#s) [u](../../../y.md) (a/c/y.md) end",
        2: "[n](/w/y)[n](/w/y)", 3: "no links", 4: None, 5: "",
    }
