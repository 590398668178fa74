"""Queries over texts against brute force on the whole of them, over the smallest tables."""

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from codeloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="module")
def tokens(texts):
    return {k: re.findall(r"\w+", (t or "").lower()) for k, t in texts.items()}


def test_postings_of_whole_texts(spark, tokens):
    cf = Counter(w for ws in tokens.values() for w in ws)
    df = Counter(w for ws in tokens.values() for w in set(ws))
    got = {r["token"]: (r["df"], r["cf"]) for r in QUERIES["I-01_postings"](spark, SF).collect()}
    assert got == {w: (df[w], cf[w]) for w in cf}


def test_phrases_of_whole_texts(spark, tokens):
    tf = {k: n for k, ws in tokens.items() if (n := sum(p == ("of", "the") for p in zip(ws, ws[1:])))}
    length = {k: len(ws) for k, ws in tokens.items() if ws}
    mean = sum(length.values()) / len(length)
    idf = math.log(1 + (len(length) - len(tf) + 0.5) / (len(tf) + 0.5))
    score = {k: idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[k] / mean)) for k, n in tf.items()}
    best = sorted(score, key=lambda k: (-round(score[k], 9), k))[:20]
    got = [(r["key"], r["score"]) for r in QUERIES["I-02_phrase_search"](spark, SF).collect()]
    assert [k for k, _ in got] == best and [s for _, s in got] == pytest.approx([score[k] for k in best], abs=1e-6)


def test_prefixes_of_whole_texts(spark, tokens):
    want = {k: n for k, ws in tokens.items() if (n := sum(w.startswith(("thr", "ouer", "zz")) for w in ws))}
    assert {r["key"]: r["tf"] for r in QUERIES["I-03_prefix_search"](spark, SF).collect()} == want


def test_index_check_of_whole_texts(spark, tokens):
    extra = sum(len(ws) for k, ws in tokens.items() if k % 89 == 3 and k % 97 != 5)
    missing = sum(len(ws) for k, ws in tokens.items() if k % 97 == 5 and k % 89 != 3)
    assert {r["fault"]: r["n"] for r in QUERIES["I-07_index_check"](spark, SF).collect()} == {"extra": extra, "missing": missing}


def test_kgrams_of_whole_texts(spark, texts):
    split = {k: t.lower().split(" ") for k, t in texts.items() if t is not None}
    want = Counter((k, i, " ".join(w[i : i + 5])) for k, w in split.items() for i in range(len(w) - 4))
    got = Counter((r["doc_id"], r["pos"], r["gram"]) for r in QUERIES["E-07_kgrams"](spark, SF).collect())
    assert got == want
