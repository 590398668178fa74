"""Steps that several queries share, on tables where a key or a set is very common."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import resolution as P
from codeloom.operators import search as I


@pytest.mark.parametrize("hashes, size", [(40, 14), (3000, 60)])
def test_low_similarity_counts_shared_hashes(spark, hashes, size):
    """Dense sets, which are compared as bits, and sparse ones, some of each size; no set is sent to another."""
    draw = random.Random(size)
    sets = {k: {draw.randrange(hashes) for _ in range(1 + draw.randrange(size))} for k in range(120)}
    sets |= {1000 + k: sets[k] for k in range(10)}
    rows = spark.createDataFrame([(k, h * 7919) for k, s in sets.items() for h in s], "key bigint, hash bigint")
    pairs = I.clone_pairs(rows, 0.2, 2)
    assert "array<" not in pairs._jdf.queryExecution().analyzed().toString() and "hashes" not in pairs._jdf.queryExecution().analyzed().toString()
    want = set()
    for a, b in combinations(sorted(sets), 2):
        shared, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if min(len(sets[a]), len(sets[b])) >= 2 and shared / whole >= 0.2:
            want.add((a, b, shared))
    assert {(r.a, r.b, r.shared) for r in pairs.collect()} == want and want


def test_pairs_that_only_meet_leave_no_task(spark, monkeypatch):
    """Nearly every two of these sets share a hash, and few are similar: they are counted in blocks, not joined."""
    draw = random.Random(5)
    sets = {k: set(draw.sample(range(200), 20)) for k in range(150)}
    sets |= {500 + k: set(list(sets[k])[:15]) for k in range(5)} | {900: {1}, 901: {10_000}}
    rows = spark.createDataFrame([(k, f"h{h}") for k, s in sets.items() for h in s], "key bigint, hash string")
    monkeypatch.setattr(I, "BLOCK", 700)
    pairs = I.clone_pairs(rows, 0.3, 1)
    assert "Join" not in pairs._jdf.queryExecution().analyzed().toString()
    want = {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    assert {(r.a, r.b, r.shared) for r in pairs.collect()} == want and len(want) >= 5


@pytest.mark.parametrize("meets", [1, 7, 300, 1 << 22])
@pytest.mark.parametrize("numbers", [30, 4000])
def test_shared_numbers_of_two_blocks(monkeypatch, numbers, meets):
    monkeypatch.setattr(I, "MEETS", meets)
    draw = random.Random(numbers)
    one, two = ([draw.sample(range(numbers), draw.randrange(12)) for _ in range(n)] for n in (40, 25))
    flat = lambda x: (np.array(sum(x, []), np.int32), np.array([len(s) for s in x], np.int64))
    size = lambda x: np.array([max(1, len(s)) for s in x], np.int64)
    for x, y, same in ((one, two, False), (one, one, True), (one, [], False), ([], two, False)):
        found = I._shared_counts(flat(x), flat(y), size(x), size(y), 1e-9, same)
        want = [(i, j, len(set(a) & set(b))) for i, a in enumerate(x) for j, b in enumerate(y) if set(a) & set(b) and (i < j or not same)]
        assert sorted(zip(*(f.tolist() for f in found), strict=True)) == want


def test_copies_are_compared_once(spark, monkeypatch):
    """Forty copies of two similar sets are 3160 pairs, of which one is compared."""
    sets = {k: set(range(k % 2, 40)) for k in range(80)} | {100 + k: set(range(1000 * k, 1000 * k + 5)) for k in range(9)} | {200: set(range(30)) | {7000}}
    rows = spark.createDataFrame([(k, h) for k, s in sets.items() for h in s], "key bigint, hash bigint")
    compared, plain = [], I._similar
    monkeypatch.setattr(I, "_similar", lambda whole, similarity: compared.append(whole.count()) or plain(whole, similarity))
    found = {(r.a, r.b, r.shared, r.similarity) for r in I.clone_pairs(rows, 0.85, 2).collect()}
    pairs = [(a, b, len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in combinations(sorted(sets), 2)]
    assert found == {p for p in pairs if p[3] >= 0.85} and len(found) == 3160 and compared == [12]


def test_similar_sets_are_all_found(spark):
    draw = random.Random(3)
    base = [draw.sample(range(400), 30) for _ in range(12)]
    sets = {k: set(base[k % 12][draw.randrange(4) :]) | set(draw.sample(range(400), draw.randrange(4))) for k in range(96)}
    rows = spark.createDataFrame([(k, h) for k, s in sets.items() for h in s], "key bigint, hash bigint")
    for least in (0.6, 0.85):
        want = {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b, r.shared) for r in I.clone_pairs(rows, least).collect()} == want != set()


def test_a_common_key_is_one_row(spark):
    """A thousand references and nodes under one key are no million candidates."""
    refs = spark.range(1000).select("id", F.lit("k").alias("target"))
    nodes = spark.range(1000).select("id", F.lit("k").alias("key")).union(spark.createDataFrame([(5000, "one")], "id bigint, key string"))
    refs = refs.union(spark.createDataFrame([(2000, "one"), (2001, "none"), (2002, None)], "id bigint, target string"))
    found = P.keyed(refs, nodes, F.col("target"), F.col("key"))
    assert found.count() == 2001
    out = {r.id: (r.node, r.outcome) for r in P.resolved(refs, [found]).collect()}
    assert out[0] == (None, "ambiguous") and out[2000] == (5000, "bound") and out[2001] == (None, "not_found") and out[2002] == (None, "not_found")


def test_names_that_no_scope_has_are_not_walked(spark, monkeypatch):
    """A reference walks outwards only for a name that something inside a scope has, and until it is found."""
    chain = 40
    nodes = spark.createDataFrame([(i, f"n{i}", "function") for i in range(chain + 2)], "id bigint, name string, kind string")
    edges = spark.createDataFrame([(i + 1, i, "contains") for i in range(chain)], "source bigint, target bigint, kind string")
    refs = spark.createDataFrame([(1, 0, 0, "c", "m", "nowhere", "callable"), (2, 0, 0, "c", "m", "n1", "callable")], "ref bigint, source bigint, file bigint, crate string, path string, target string, want string")
    ix = P.Index(
        spark.createDataFrame([], "crate string, path string, node bigint"),
        spark.createDataFrame([], "crate string, path string, name string, node bigint, callable boolean, type_like boolean"),
        spark.createDataFrame([], "file bigint, alias string, target string"),
        spark.createDataFrame([], "file bigint, target string"),
    )
    rounds, plain = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: rounds.append(1) or plain(df))
    found = P.decided(P.name_candidates(refs, ix, nodes, edges)).collect()
    assert [(r.ref, r.node, r.outcome) for r in found] == [(2, 1, "bound")]
    assert len(rounds) < chain


def test_artifacts_of_a_common_name(spark):
    """A thousand targets of one name are two candidates of a reference; a folder still has a row a file."""
    nodes = spark.range(1000).selectExpr("id", "'target' AS kind", "'all' AS name", "'Makefile' AS file_path")
    nodes = nodes.union(spark.range(5000, 5003).selectExpr("id", "'config_file'", "concat('f', id)", "concat('m/f', id, '.tf')"))
    refs = spark.range(300).selectExpr("id AS ref", "'artifact_ref' AS kind", "'method' AS form", "'Makefile' AS file", "'all' AS target", "cast(null AS string) AS relation", "'target' AS want_kind")
    refs = refs.union(spark.range(900, 902).selectExpr("id", "'artifact_ref'", "'path'", "'root.tf'", "'./m'", "'tf_module_call'", "cast(null AS string)"))
    out = P.artifact_outcomes(refs, nodes).collect()
    assert len(out) == 306 and {(r.node, r.outcome) for r in out if r.ref < 300} == {(None, "ambiguous")}
    assert sorted((r.ref, r.node) for r in out if r.ref >= 900) == [(a, b) for a in (900, 901) for b in (5000, 5001, 5002)]


def test_components_make_no_pairs_of_copies(spark, monkeypatch):
    from codeloom.plans import catalog

    def never(*_):
        raise AssertionError("all pairs are made")

    monkeypatch.setattr(I, "clone_pairs", never)
    assert catalog.queries()["H-23_clone_components"](spark, "/root/testdata/sf0.001").count() > 0
