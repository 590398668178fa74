"""Known values of the operators, on small literal tables."""

import math
import random
import re
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions import scalars as S
from codeloom.operators import cycles as C
from codeloom.operators import graph as G
from codeloom.operators import history as H
from codeloom.operators import quality as K
from codeloom.operators import relational as R
from codeloom.operators import resolution as Q
from codeloom.operators import search as I
from codeloom.operators import traverse as V
from codeloom.operators.shared import spread
from codeloom.sources import readers
from codeloom.streaming import changes as T


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source bigint, target bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_signal_of_known_metrics(spark):
    values = [0.5 / 1.5, 1.0, 8 / 9, 1.0, 0.4, 1.0, 1.0, 1.0, None, None]
    df = spark.createDataFrame([(v,) for v in values], "normalized double")
    assert K.aggregate_signal(df).first()[0] == 7660
    assert K.aggregate_signal(df.where("normalized is null")).first()[0] is None
    assert K.aggregate_signal(df.union(spark.createDataFrame([(0.0,)], "normalized double"))).first()[0] == 0


def test_modularity_of_two_clusters(spark):
    v = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id bigint, directory string")
    inside = K.modularity(v, edges(spark, (1, 2), (2, 1), (3, 4), (4, 3))).first()
    across = K.modularity(v, edges(spark, (1, 3), (3, 1), (2, 4), (4, 2))).first()
    none = K.modularity(v, spark.createDataFrame([], "source bigint, target bigint")).first()
    assert inside["q"] > 0.4 and across["q"] < 0
    assert none["q"] == 0 and math.isclose(none["normalized"], 1 / 3)


def test_two_author_file(spark):
    day = 86_400
    commits = spark.createDataFrame(
        [("a", 10 * day, "x", "x@", "add", 1), ("b", 9 * day, "y", "y@", "fix bug", 1), ("c", 8 * day, "x", "x@", "more", 1)],
        "sha string, committed_at bigint, author_name string, author_email string, subject string, file_count bigint",
    )
    changes = spark.createDataFrame([(s, "f", 1, None) for s in "abc"], "commit_sha string, path string, added bigint, deleted bigint")
    r = H.file_history(commits, changes).first()
    assert (r["commits"], r["ownership_bp"], r["entropy_bp"], r["defects"], r["deleted"]) == (3, 3333, 9183, 1, 0)


def test_mega_commit_counts_for_churn_only(spark):
    commits = spark.createDataFrame([("a", 1, "x", "x", "", 9), ("b", 2, "x", "x", "", 2)], "sha string, committed_at bigint, author_name string, author_email string, subject string, file_count bigint")
    changes = spark.createDataFrame([("a", "f", 1, 1), ("a", "g", 1, 1), ("a", "h", 1, 1), ("b", "f", 1, 1), ("b", "g", 1, 1)], "commit_sha string, path string, added bigint, deleted bigint")
    r = {x["path"]: x for x in H.file_history(commits, changes, None, 3).collect()}
    assert (r["f"]["commits"], r["f"]["cochanged"], r["h"]["cochanged"]) == (2, 1, 0)


def test_hotspot_ranks(spark):
    m = spark.createDataFrame([("hot", 9), ("churny", 5), ("plain", 1)], "path string, commits bigint")
    c = spark.createDataFrame([("hot", 9), ("churny", 1), ("plain", 5)], "path string, cc bigint")
    top = H.hotspots(m, c).collect()
    assert (top[0]["path"], top[0]["churn_rank"], top[0]["cc_rank"], top[0]["score"]) == ("hot", 3, 3, 9)


@pytest.mark.parametrize("covered, lines, bp", [(3, 4, 7500), (2, 3, 6667), (0, 1, 0), (0, 0, None)])
def test_coverage_rounding(spark, covered, lines, bp):
    assert spark.range(1).select(S.percent_points(F.lit(covered), F.lit(lines))).first()[0] == bp


def test_strong_components_and_depth(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 7), (8, 1))
    assert dict(rows(C.strong_components(e))) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert C.longest_path(e.select(F.col("source").alias("id")), e) == 4
    assert C.longest_path(spark.createDataFrame([], "id bigint"), e.limit(0)) == 0


def test_reach_of_a_cycle_ends(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4))
    seeds = spark.createDataFrame([(1,)], "id bigint")
    assert rows(V.reach(e, seeds)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(V.reach(e, seeds, 1)) == [(1, 0), (2, 1)]
    assert rows(V.reach(e, seeds.limit(0))) == []


def test_components_of_a_long_chain(spark):
    ids = spark.range(1, 41).select(F.col("id"))
    e = spark.range(1, 40).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert {c for _, c in rows(C.components(ids, e))} == {1}


def test_winnowing_takes_the_rightmost_least(spark):
    df = spark.createDataFrame([([5, 1, 1, 7, 9, 9, 9, 9],), ([4, 2],), ([],)], "h array<int>")
    # Windows 5117, 1179, 1799, 7999, 9999: the last 1 (twice), 1 again, 7, and the last 9.
    assert [r[0] for r in df.select(R.winnowed(F.col("h"))).collect()] == [[1, 7, 9], [2], []]


@pytest.mark.parametrize("window", [1, 2, 4, 5])
def test_winnowing_by_brute_force(spark, window):
    rng = random.Random(window)
    sequences = [[rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(500)]

    def places(h):
        for i in range(max(len(h) - window, 0) + 1 if h else 0):
            part = h[i : i + window]
            yield i + max(j for j, x in enumerate(part) if x == min(part))

    df = spark.createDataFrame(list(enumerate(sequences)), "k int, h array<int>")
    got = {r["k"]: r["w"] for r in df.select("k", R.winnowed(F.col("h"), window).alias("w")).collect()}
    assert got == {k: [h[p] for p in sorted(set(places(h)))] for k, h in enumerate(sequences)}


def test_rows_of_few_files_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(3 * spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert sorted(r[0] for r in spread(one).collect()) == list(range(100))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many) is many


def test_ambiguous_tier_stops_the_ladder(spark):
    refs = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    one = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "ref bigint, node bigint")
    two = spark.createDataFrame([(1, 99), (2, 22), (3, 30)], "ref bigint, node bigint")
    got = {r["id"]: (r["node"], r["outcome"]) for r in Q.resolved(refs, [one, two]).collect()}
    assert got == {1: (10, "bound"), 2: (None, "ambiguous"), 3: (30, "bound")}


def test_gate_order(spark):
    def gate(*values):
        df = spark.createDataFrame([values], "current bigint, baseline bigint, version boolean, thresholds boolean, floor bigint, faults bigint")
        return tuple(df.select(K.gated(*map(F.col, df.columns)).alias("g")).select("g.*").first())

    assert gate(6998, 7000, True, True, None, 0) == (False, "signal below baseline")
    assert gate(6999, 7000, True, True, None, 0) == (True, "ok")
    assert gate(1, 7000, False, True, 9000, 3)[0] and gate(1, None, True, True, 9, 9) == (True, "no baseline")
    assert gate(10, 10, True, True, 11, 0) == (False, "signal below floor") and gate(10, 10, True, True, None, 2) == (False, "structural faults")


def small_graphs():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9, 14):
        for _ in range(6):
            e = {(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(0, 2 * n)), 2))}
            yield n, sorted(e)


def closure(n, e):
    reach = {(i, i) for i in range(n)} | set(e)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in e if b == c}
        if more == reach:
            return reach
        reach = more


def test_graphs_are_those_of_the_definition(spark):
    """Many small graphs side by side as one, with rings and chains among them."""
    pairs, sizes, start = [], [], 0
    rings = [(5, [(i, (i + 1) % 5) for i in range(5)]), (9, [(i, i + 1) for i in range(8)]), (7, [(i, i + 1) for i in range(6)] + [(6, 0), (3, 0)])]
    for n, e in [*small_graphs(), *rings]:
        pairs += [(a + start, b + start) for a, b in e]
        sizes.append((start, n, e))
        start += n
    df = edges(spark, *pairs)
    scc = dict(rows(C.strong_components(df)))
    linked = dict(rows(C.components(spark.range(start), df)))
    reached = {i for i, _ in rows(V.reach(df, spark.createDataFrame([(at,) for at, _, _ in sizes], "id bigint")))}
    deepest = 0
    for at, n, e in sizes:
        reach, both = closure(n, e), closure(n, e + [(b, a) for a, b in e])
        own = [min(j for j in range(n) if (i, j) in reach and (j, i) in reach) for i in range(n)]
        assert [scc.get(i + at, i + at) - at for i in range(n)] == own
        assert [linked[i + at] - at for i in range(n)] == [min(j for j in range(n) if (i, j) in both) for i in range(n)]
        assert {i for i in range(n) if i + at in reached} == {i for i in range(n) if (0, i) in reach}
        merged = {(own[a], own[b]) for a, b in e if own[a] != own[b]}

        def depth(v, merged=merged):
            return 1 + max((depth(b) for a, b in merged if a == v), default=0)

        deepest = max(deepest, *map(depth, own))
    assert C.longest_path(spark.range(start), df) == deepest


@pytest.fixture
def rounds(monkeypatch):
    """How many times a table is written in the rounds of cycles."""
    seen = []
    cut = C.cut
    monkeypatch.setattr(C, "cut", lambda df: (seen.append(1), cut(df))[1])
    return seen


def test_long_chains_and_rings_take_few_rounds(spark, rounds):
    n = 100_000
    ids = spark.range(n)
    scrambled = lambda c: (c * 7919 % n).alias  # noqa: E731  neighbours have distant ids
    chain = ids.where(f"id < {n - 1}").select(scrambled(F.col("id"))("source"), scrambled(F.col("id") + 1)("target"))
    ring = ids.select((F.col("id") + n).alias("source"), ((F.col("id") + 1) % n + n).alias("target"))
    found = C.strong_components(chain.union(ring)).groupBy("scc").agg(F.count("*").alias("n"))
    assert found.where("n > 1").collect() == [(n, n)] and found.count() == n + 1
    assert len(rounds) < 40
    rounds.clear()
    assert C.longest_path(ids, chain) == n
    assert len(rounds) < 80  # strong components first, then depth


def test_a_random_graph_takes_few_rounds(spark, rounds):
    rng = np.random.default_rng(2)
    n = 3000
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (2 * n, 2))})
    found = dict(rows(C.strong_components(edges(spark, *pairs))))
    after, before = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in pairs:
        after[a].append(b)
        before[b].append(a)

    def reached(v, step):
        seen, todo = {v}, [v]
        while todo:
            todo = [y for x in todo for y in step[x] if y not in seen and not seen.add(y)]
        return seen

    left, want = set(found), {}
    while left:
        v = min(left)
        both = reached(v, after) & reached(v, before)
        want |= dict.fromkeys(both, v)
        left -= both
    assert found == want
    assert len(rounds) < 40


def test_a_search_reads_the_buckets_of_its_frontier(spark):
    e = spark.range(20_000).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    kept = V.adjacency(e, 64)
    assert kept.rows.count() == 20_000
    frontier = spark.createDataFrame([(5,), (6,)], "id bigint")
    step = kept.of(frontier)
    assert len(kept.touched(frontier)) <= 2 and rows(step) == [(5, 6), (6, 7)]
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan)
    seeds = spark.createDataFrame([(7,), (None,)], "id bigint")
    assert rows(V.reach(kept, seeds, 3)) == rows(V.reach(e.where("source < 50"), seeds, 3)) == [(7, 0), (8, 1), (9, 2), (10, 3)]


def test_searches_by_owner_stay_apart(spark):
    e = edges(spark, (1, 2), (2, 3), (5, 2), (3, 1))
    seeds = spark.createDataFrame([("a", 1), ("b", 5), ("c", None)], "member string, id bigint")
    assert rows(V.reach_by(e, seeds, "member")) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 1, 3), ("b", 2, 1), ("b", 3, 2), ("b", 5, 0)]


def test_ancestors_at_any_depth_and_on_cycles(spark):
    chain = [(i, i + 1) for i in range(1, 66)]
    e = edges(spark, *chain, (200, 201), (201, 202), (202, 200), (300, 300)).withColumn("kind", F.lit("contains"))
    nodes = spark.createDataFrame([(i, "module" if i == 1 else "f") for i in [*range(1, 67), 200, 201, 202, 300]], "id bigint, kind string")
    got = {r["id"]: (r["ancestor"], r["depth"]) for r in G.nearest_ancestor(nodes, e, "module").collect()}
    assert got[66] == (1, 65) and got[1] == (1, 0) and got[201] == got[300] == (None, None)


def test_similar_sets_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    sets = {i: set(rng.choice(30, rng.integers(1, 9), replace=False).tolist()) for i in range(60)}
    sets |= {60 + i: set(sets[i]) for i in range(10)}
    df = spark.createDataFrame([(k, h) for k, s in sets.items() for h in s], "key bigint, hash bigint")
    for similarity in (0.3, 0.5, 0.85):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a]) >= 2 <= len(sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}
        assert {(r["a"], r["b"], r["shared"]) for r in I.clone_pairs(df, similarity, 2).collect()} == want
        keys = df.select("key").distinct()
        assert sorted(map(tuple, I.near_clones(keys, df, similarity, 2).fillna(-1).collect())) == sorted(map(tuple, I.clone_groups(keys, I.clone_pairs(df, similarity, 2)).fillna(-1).collect()))


def brute_flushes(events, c, step=0.5):
    """A watcher that looks at its clock every ``step`` seconds."""
    events, out, now = sorted(events), [], 0.0
    waiting, window, held, first, last, flushed, n = [], None, set(), None, 0.0, -1e9, 0
    while events or waiting or first is not None:
        if window is not None and now >= window + c.debounce:
            first = now if first is None else first
            last, n = now, n + len(waiting)
            held |= set(waiting)
            waiting, window = [], None
        if first is not None and now >= max(min(last + c.settle, first + c.staleness), flushed + c.interval):
            out.append((now, n, ",".join(sorted(held))))
            held, first, flushed, n = set(), None, now, 0
        while events and events[0][0] <= now:
            at, path = events.pop(0)
            window = at if window is None else window
            waiting.append(path)
        now += step
    return out


def test_a_watcher_starts_when_things_settle(spark):
    rng = np.random.default_rng(10)
    c = T.Cadence(1.0, 3.0, 8.0, 12.0)
    events = {r: [(float(t), f"p{rng.integers(0, 5)}") for t in np.cumsum(rng.choice([0.5, 1.0, 2.5, 6.0, 20.0], 60, p=[0.4, 0.3, 0.15, 0.1, 0.05]))] for r in ("a", "b")}
    rows_ = [(r, datetime.fromtimestamp(1_000_000 + t, timezone.utc), p) for r, e in events.items() for t, p in e]
    found = T.flushes(spark.createDataFrame(rows_, "root string, ts timestamp, path string"), c).collect()
    for r, e in events.items():
        got = sorted((x["started_at"] - 1_000_000, x["events"], x["paths"]) for x in found if x["root"] == r)
        assert got == brute_flushes(e, c)


def test_fixed_patterns_and_doc_kinds(spark):
    subjects = {"Fixes it": True, "fixed": True, "fixe it": False, "a bug": True, "debug": False, "HOTFIX: x": True, "defect": False, "prefix": False}
    df = spark.createDataFrame(list(subjects), "string")
    assert {r["value"]: r["hit"] for r in df.select("value", F.col("value").rlike(P.DEFECT).alias("hit")).collect()} == subjects
    kinds = {("a/requirements/FR-1.md", None): "requirement", ("requirements/old/FR-1.md", None): "doc_file", ("FR-1.md", None): "doc_file", ("x/ADR-7-y.markdown", None): "decision", ("x/ADR-y.md", None): "doc_file", ("x.md", "S-39: a"): "story", ("x.md", "S-39x"): "doc_section"}
    df = spark.createDataFrame([(*k, v) for k, v in kinds.items()], "path string, heading string, want string")
    assert df.where(Q.doc_kind(F.col("path"), F.col("heading")) != F.col("want")).count() == 0


@pytest.mark.parametrize("path, is_test", [("a/tests/b.rs", True), ("src/contest.rs", False), ("x/test_a.py", True), ("a/b_test.go", True), ("a.spec.ts", True), ("spec.md", False)])
def test_test_paths(spark, path, is_test):
    assert spark.range(1).select(P.is_test_path(F.lit(path))).first()[0] == is_test


@pytest.mark.parametrize("glob, path, hit", [("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/a/b.rs", False), ("**/b.rs", "b.rs", True), ("src/**", "src/a/b", True), ("a?c", "a/c", False), ("a.b", "axb", False), ("{a,b}/[!x]?.rs", "b/yz.rs", True), ("{a,b}/[!x]?.rs", "b/xz.rs", False), ("[a-c].md", "b.md", True), ("a\\*b", "a*b", True)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(P.matches_glob(F.lit(path), glob)).first()[0] == hit


def test_lcov_and_sniffing(spark):
    text = "TN:\nSF:a.rs\nDA:1,2\nDA:1,5\nDA:2,0\nend_of_record\nDA:9,9\n"
    df = spark.createDataFrame([("r", text)], "report string, text string")
    assert rows(readers.parse_lcov(df, "report", "text")) == [("r", "a.rs", 1, 5), ("r", "a.rs", 2, 0)]
    assert df.select(readers.sniff_coverage(F.col("text"))).first()[0] == "lcov"


def test_log_with_rename_and_binary(spark):
    u = readers.UNIT
    text = f"{readers.RECORD}abc{u}5{u}n{u}e{u}s\n\n1\t2\tsrc/{{a => b}}/f.rs\n-\t-\tx.png\n3\t0\told.rs => new.rs\n"
    commits, changes = readers.parse_log(spark.createDataFrame([(text,)], "value string"))
    assert commits.first()["file_count"] == 3
    assert {r["path"]: (r["old_path"], r["added"]) for r in changes.collect()} == {"src/b/f.rs": ("src/a/f.rs", 1), "x.png": (None, None), "new.rs": ("old.rs", 3)}


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f(x):\n    if x:\n        return g(x)\n")
    (tmp_path / "src" / "skip.py").write_text("x = 1\n")
    (tmp_path / "bin.py").write_bytes(b"\xff\xfe")
    files = readers.read_tree(spark, str(tmp_path), ["**/*.py"], ["src/skip*"])
    assert [r["path"] for r in files.collect()] == ["src/a.py"]
    facts = {(r["kind"], r["name"]): r for r in readers.extract_facts(files).collect()}
    assert facts["function", "f"]["cc"] == 2 and facts["function", "f"]["nesting"] == 1 and ("call", "g") in facts


def test_lcom4(spark):
    e = spark.createDataFrame([(100, 1, "contains"), (100, 2, "contains"), (100, 3, "contains"), (1, 50, "accesses"), (2, 50, "accesses")], "source bigint, target bigint, kind string")
    got = K.lcom4(spark.createDataFrame([(100,)], "id bigint"), e, spark.createDataFrame([(1,), (2,), (3,)], "id bigint")).first()
    assert (got["methods"], got["lcom4"]) == (3, 2)


def test_clone_groups(spark):
    sets = spark.createDataFrame([(k, h) for k in (1, 2) for h in range(20)] + [(3, h) for h in range(15, 40)], "key bigint, hash bigint")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "key bigint")
    assert dict(rows(I.clone_groups(keys, I.clone_pairs(sets)).fillna(-1))) == {1: 1, 2: 1, 3: -1}


def test_stream_rollup(spark, tmp_path):
    from codeloom.streaming.changes import usage_rollup

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(5, "cli", "scan", 10, True), (6, "cli", "scan", 30, False)], "happened_at bigint, surface string, tool string, duration_ms bigint, ok boolean").write.parquet(src)
    usage_rollup(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    r = spark.read.parquet(out).first()
    assert (r["calls"], r["ok_calls"], r["max_duration_ms"]) == (2, 1, 30)


def test_view_cache_drops_the_oldest(spark):
    from codeloom.operators.store import ViewCache

    cache, made = ViewCache(2), []

    def build(n):
        made.append(n)
        return spark.range(n)

    for name, revision in (("a", 1), ("a", 1), ("b", 1), ("c", 1), ("a", 1), ("a", 2)):
        cache.get(name, revision, lambda: build(revision))
    assert (cache.hits, cache.misses, list(cache.held)) == (1, 5, [("c", 1), ("a", 2)])


def test_store_copy_and_chunks(spark, tmp_path):
    from codeloom.operators.store import copy_store, write_chunks

    write_chunks(spark.range(10).coalesce(1), f"{tmp_path}/a/t", 3)
    assert len(list((tmp_path / "a" / "t").glob("*.parquet"))) == 4
    copy_store(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["t"])
    assert spark.read.parquet(f"{tmp_path}/b/t").count() == 10


def test_window_without_history(spark):
    none = spark.createDataFrame([], "sha string, committed_at bigint, author_name string, author_email string, subject string, file_count bigint")
    changes = spark.createDataFrame([], "commit_sha string, path string, added bigint, deleted bigint")
    assert H.file_history(none, changes).count() == 0
    assert H.hotspots(H.file_history(none, changes), spark.createDataFrame([], "path string, cc bigint")).count() == 0
