"""Names, artifact references, syncs and reach by member, on small graphs."""

import random

from codeloom.operators import resolution as Q


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def index(spark, members=(), aliases=(), globs=()):
    return Q.Index(
        spark.createDataFrame([("c", "", 900)], "crate string, path string, node bigint"),
        spark.createDataFrame(list(members), "crate string, path string, name string, node bigint, callable boolean, type_like boolean"),
        spark.createDataFrame(list(aliases), "file bigint, alias string, target string"),
        spark.createDataFrame(list(globs), "file bigint, target string"),
    )


REF = "ref bigint, source bigint, file bigint, crate string, path string, target string, want string, bare boolean"


def test_free_functions_come_first_and_scopes_go_to_the_root(spark):
    deep = [(i, i + 1) for i in range(100, 140)]  # 40 scopes, one in the other
    contains = [(100, 1), (100, 2), (100, 3), *deep, (100, 50), (100, 51), (200, 201), (201, 200)]
    nodes = [(1, "new", "function"), (2, "new", "method"), (3, "get", "method"), (50, "two", "function"), (51, "two", "function")]
    edges = spark.createDataFrame([(a, b, "contains") for a, b in contains], "source bigint, target bigint, kind string")
    named = spark.createDataFrame(nodes + [(i, f"s{i}", "module") for i in (*range(100, 141), 200, 201)], "id bigint, name string, kind string")
    refs = spark.createDataFrame(
        [
            (1, 140, 1, "c", "", "new", "callable", True),  # the free function of two
            (2, 140, 1, "c", "", "new", "callable", False),  # a method of an unknown receiver: both
            (3, 140, 1, "c", "", "get", "callable", True),  # no free one: the method
            (4, 140, 1, "c", "", "two", "callable", True),  # two free ones
            (5, 201, 1, "c", "", "new", "callable", True),  # scopes in a ring
        ],
        REF,
    )
    found = Q.decided(Q.name_candidates(refs, index(spark), named, edges))
    assert {r["ref"]: (r["node"], r["outcome"]) for r in found.collect()} == {1: (1, "bound"), 2: (None, "ambiguous"), 3: (3, "bound"), 4: (None, "ambiguous")}


def test_names_that_many_have_are_one_row(spark):
    members = [("c", f"m{i}", "new", i, True, False) for i in range(200)] + [("d", "only::here", "new", 500, True, False), ("d", "x", "thing", 600, False, True)]
    ix = index(spark, members)
    refs = [(1, 0, 1, "c", "", "new", "callable", True), (2, 0, 1, "d", "", "new", "callable", True), (3, 0, 1, "q", "", "thing", "any", True), (4, 0, 1, "q", "", "thing", "callable", True)]
    refs = spark.createDataFrame(refs, REF)
    edges = spark.createDataFrame([], "source bigint, target bigint, kind string")
    nodes = spark.createDataFrame([], "id bigint, name string, kind string")
    found = Q.name_candidates(refs, ix, nodes, edges, "aggressive")
    assert found.count() <= 8
    assert {r["ref"]: (r["node"], r["outcome"]) for r in Q.decided(found).collect()} == {1: (None, "ambiguous"), 2: (500, "bound"), 3: (600, "bound")}
    paths = spark.createDataFrame([(1, 1, "z", "", "here::new", "callable"), (2, 1, "z", "", "m7::new", "any"), (3, 1, "z", "", "ere::new", "any")], "ref bigint, file bigint, crate string, path string, target string, want string")
    got = Q.decided(Q.path_candidates(paths, ix))
    assert {r["ref"]: r["node"] for r in got.collect()} == {1: 500, 2: 7}


def test_artifacts(spark):
    nodes = spark.createDataFrame(
        [
            (1, "config_file", "a", "deploy/a.yaml"), (2, "config_file", "b", "x/b.yaml"), (3, "config_file", "b2", "x/b.yaml"), (4, "config_file", "m", "mod/m.tf"), (5, "config_file", "n", "mod/n.tf"),
            (6, "config_file", "deep", "mod/sub/n.tf"), (7, "target", "all", "Makefile"), (8, "stage", "all", "Dockerfile"), (9, "struct", "User", "u.rs"), (10, "function", "User", "u.rs"), (11, "route", "GET /u/{id}", "r.rs"),
        ],
        "id bigint, kind string, name string, file_path string",
    )
    refs = [
        (1, "deploy/x.yaml", "./a.yaml", "artifact_ref", "path", None, None), (2, "ci/x.yaml", "deploy/a.yaml", "artifact_ref", "path", None, None), (3, "x/q", "b.yaml", "artifact_ref", "path", None, None),
        (4, "main.tf", "./mod", "artifact_ref", "path", "tf_module_call", None), (5, "main.tf", "./none", "artifact_ref", "path", "tf_module_call", None), (6, "m", "all", "artifact_ref", "method", None, "target"),
        (7, "m", "all", "artifact_ref", "method", None, None), (8, "m", "User", "artifact_binding", "method", None, None), (9, "m", "get /u/:x/", "artifact_binding", "path", None, None),
        (10, None, "a.yaml", "artifact_ref", "path", None, None), (11, "a", "../../a.yaml", "artifact_ref", "path", None, None), (12, "m", "User", "calls", "symbol", None, None),
    ]
    refs = spark.createDataFrame(refs, "ref bigint, file string, target string, kind string, form string, relation string, want_kind string")
    got = rows(Q.artifact_outcomes(refs, nodes))
    want = [(1, 1, "bound"), (2, 1, "bound"), (3, None, "ambiguous"), (4, 4, "bound"), (4, 5, "bound"), (5, None, "not_found"), (6, 7, "bound"), (7, None, "ambiguous"), (8, 9, "bound"), (9, 11, "bound")]
    assert got == sorted([*want, (10, None, "not_found"), (11, None, "not_found"), (12, None, "not_found")], key=str)


def test_what_a_sync_leaves_out_would_not_change(spark):
    """References are resolved in full before and after some items go and come; all that differ are selected."""
    rng = random.Random(4)
    names = [f"f{i}" for i in range(30)]
    before = [("c", f"m{i % 4}", n, i, True, False) for i, n in enumerate(names)]
    gone = set(rng.sample(names, 5))
    after = [m for m in before if m[2] not in gone] + [("c", "m9", "f3", 77, True, False), ("c", "m1", "fresh", 78, True, False)]
    aliases = [(f, "a1", "a2::x") for f in range(4)] + [(f, "a2", "a3") for f in range(4)] + [(0, "a3", "crate::m1"), (1, "a3", "crate::m9"), (2, "a3", f"crate::{sorted(gone)[0]}"), (3, "q", "crate::m1::fresh")]
    heads = ["crate::m0", "crate::m1", "a1", "a3", "q", "m2", "crate::m9"]
    refs = [(i, rng.randrange(4), "c", "", f"{rng.choice(heads)}::{rng.choice([*names, 'fresh'])}", "any") for i in range(200)] + [(500, 3, "c", "", "q::z", "any")]
    schema = "ref bigint, file bigint, crate string, path string, target string, want string"
    table = spark.createDataFrame(refs, schema)

    def outcomes(members):
        return {r["ref"]: (r["node"], r["outcome"]) for r in Q.decided(Q.path_candidates(table, index(spark, members, aliases))).collect()}

    old, new = outcomes(before), outcomes(after)
    dirty = spark.createDataFrame([(n,) for n in {*gone, "f3", "fresh", "m9"}], "name string")
    selected = Q.delta_affected(table.selectExpr("*", "'calls' AS kind"), dirty, spark.createDataFrame([], "file bigint"), index(spark, after, aliases).aliases)
    chosen = {r["ref"]: r["reason"] for r in selected.collect()}
    differ = {k for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert differ and differ <= set(chosen) and len(chosen) < len(refs)
    assert chosen[500] == "alias"


def test_members_reach_their_own(spark):
    nodes = spark.createDataFrame([("a", 1, "x", True), ("a", 2, "y", True), ("b", 1, "x", True), ("b", 3, "z", True), ("c", 1, "x", False)], "member string, id bigint, symbol string, is_dead boolean")
    edges = spark.createDataFrame([("a", 1, 2, "calls"), ("b", 3, 1, "contains")], "member string, source bigint, target bigint, kind string")
    bridges = spark.createDataFrame([("b", "a", "x"), ("a", "a", "y"), ("a", "b", "z"), ("a", "b", "gone"), ("c", "b", "gone")], "from_member string, to_member string, symbol string")
    verdicts, tally = Q.member_reach(nodes, edges, bridges)
    assert rows(verdicts) == [("a", 1, True), ("a", 2, True), ("b", 1, False), ("b", 3, True)]
    assert rows(tally) == [("a", 2, 1, 0, 2, 0), ("b", 2, 1, 1, 1, 1), ("c", 1, 0, 0, 0, 0)]
