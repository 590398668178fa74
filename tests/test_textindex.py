"""The kept index against brute force through updates, and what a query reads of it."""

import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators.textindex import TextIndex

WORDS = ["the", "of", "thread", "three", "Über", "x1", "naïve", *[f"w{i}" for i in range(300)]]


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc bigint, body string, token int")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    made = {i: " ".join(WORDS[j % len(WORDS)] for j in rng.zipf(1.3, int(n))) for i, n in enumerate(rng.integers(0, 60, 120))}
    return made | {200: None, 201: "", 202: "of the, of THE\nof the"}


@pytest.fixture(scope="module")
def built(spark, texts):
    return TextIndex.build(frame(spark, texts), "doc", "body", buckets=8)


def brute(texts, phrase):
    p = phrase.split()
    return {k: n for k, t in texts.items() if (n := sum(words(t)[i : i + len(p)] == p for i in range(len(words(t)) - len(p) + 1)))}


def same(index, texts):
    for phrase in ("the", "of the", "of the of the", "w1 w1", "nothing"):
        assert {r.key: r.tf for r in index.phrase(phrase.split()).collect()} == brute(texts, phrase)
    want = {k: n for k, t in texts.items() if (n := sum(w.startswith(("thr", "w2")) for w in words(t)))}
    assert {r.key: r.tf for r in index.with_prefixes(["thr", "W2"]).collect()} == want
    cf, df = Counter(w for t in texts.values() for w in words(t)), Counter(w for t in texts.values() for w in set(words(t)))
    assert {r.token: (r.df, r.cf) for r in index.counts().collect()} == {w: (df[w], cf[w]) for w in cf}
    assert (index.docs, index.tokens) == (sum(1 for t in texts.values() if words(t)), sum(cf.values()))


def test_an_index_is_its_documents(built, texts):
    same(built, texts)
    top = built.search("of", 3).collect()
    assert len(top) == 3 and {r.key for r in top} <= set(brute(texts, "of")) and [r.score for r in top] == sorted((r.score for r in top), reverse=True)


def test_updates_replace_and_delete(spark, built, texts):
    new = {3: "the new of the text", 500: "three threads", 4: None}
    later = built.updated(frame(spark, new), "doc", "body", deleted=spark.createDataFrame([(5,), (202,), (9999,)], "key bigint"))
    now = {k: t for k, t in (texts | new).items() if k not in (5, 202)}
    same(later, now)
    same(built, texts)  # who holds the older one goes on with it
    last = later.updated(frame(spark, {3: "of the", 202: "back"}), "doc", "body")
    now |= {3: "of the", 202: "back"}
    same(last, now)
    same(last.compacted(), now)
    assert {r.fault: r.n for r in last.faults(frame(spark, now), "doc", "body").collect()} == {"extra": 0, "missing": 0}


def files(df):
    return {r[0].removeprefix("file://") for r in df.select(F.input_file_name()).distinct().collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder.removeprefix("file://")) for f in fs if f.endswith(".parquet"))


def test_a_query_reads_its_buckets_and_an_update_writes_its_own(spark):
    rng = np.random.default_rng(1)
    big = {i: " ".join(f"t{j}" for j in rng.integers(0, 20_000, 400)) for i in range(400)}
    index = TextIndex.build(frame(spark, big), "doc", "body", buckets=64)
    plan = index.postings(["t17"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and "PushedFilters" in plan
    folders = {os.path.dirname(f) for f in files(index.postings(["t17"]))}
    assert len(folders) == 1
    assert sum(size(f) for f in folders) < 0.05 * size(index.batches[0])
    one = index.updated(frame(spark, {7: "t17"}), "doc", "body")
    assert len([d for d in os.listdir(one.batches[1].removeprefix("file://") + "/postings") if d.startswith("bucket=")]) == 1
    none = one.updated(deleted=spark.createDataFrame([(8,)], "key bigint"))
    assert not [d for d in os.listdir(none.batches[2].removeprefix("file://") + "/postings") if d.startswith("bucket=")]


def test_an_index_of_nothing(spark):
    empty = TextIndex.build(frame(spark, {1: None}).limit(0), "doc", "body")
    assert empty.search("of the").collect() == [] and empty.with_prefixes(["a"]).collect() == []


def exchanged(spark, make):
    """What make() gives, and the shuffled records of all stages that it runs."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)

    def total():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    made = make()
    return made, sum(n for at, n in total().items() if at not in before)


def test_no_word_occurrence_is_exchanged(spark):
    texts = frame(spark, {i: " ".join(f"w{j % 50}" for j in range(2000)) for i in range(64)})
    index, n = exchanged(spark, lambda: TextIndex.build(texts, "doc", "body", buckets=8))
    assert index.tokens == 64 * 2000 and n < 64 * 50  # neither an occurrence nor a posting
    lost = frame(spark, {i: " ".join(f"w{j % 50}" for j in range(2000)) for i in range(63)})
    found, n = exchanged(spark, lambda: {r.fault: r.n for r in index.faults(lost, "doc", "body").collect()})
    assert found == {"extra": 2000, "missing": 0} and n < 64 * 2000 / 4


def test_repeated_keys_are_one_document(spark):
    rows = spark.createDataFrame([(1, "a b a"), (1, "b a"), (2, "a"), (None, "a z")], "doc bigint, body string")
    index = TextIndex.build(rows, "doc", "body", buckets=4)
    got = {(r.token, r.key): r.places for r in index.postings().collect()}
    assert got == {("a", 1): [0, 1, 2], ("b", 1): [0, 1], ("a", 2): [0]} and (index.docs, index.tokens) == (2, 6)
    assert {r.fault: r.n for r in index.faults(rows, "doc", "body").collect()} == {"extra": 0, "missing": 2}
