"""Documents that share much and are not similar: they meet by what is rare among them."""

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import jaccard_join as J

C = J.JoinConfig()


def pages(spark, n, common, own, seed=0):
    rng = np.random.default_rng(seed)
    head = " ".join(f"c{i}" for i in rng.integers(0, 10**6, common))
    rows = [(i, head + " " + " ".join(f"o{j}" for j in rng.integers(0, 10**9, own))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), dict(rows)


def open_rows(docs):
    sets = J.set_table(docs.select(F.col("doc_id").alias("key"), F.col("text")), C)
    size = F.lit(0).cast("bigint")
    nodes = sets.withColumnRenamed("key", "node").withColumns({"component": F.col("node"), "size": size})
    exact = {r.doc_id: len(J.shingles(J.words_of(r.text), C)) for r in docs.collect()}
    sizes = docs.sparkSession.createDataFrame(list(exact.items()), "node bigint, size bigint")
    return J.rarest_shared(nodes.drop("size").join(sizes, "node"), C)


def test_pages_with_more_than_a_quarter_of_their_own_never_meet(spark):
    docs, _ = pages(spark, 300, 140, 62)
    assert open_rows(docs).count() == 0
    assert [r for r in J.similar_groups(docs).collect() if r.doc_id != r.component_id] == []


def test_similar_ones_share_a_rare_shingle(spark):
    docs, texts = pages(spark, 40, 60, 12, 1)
    docs2, more = pages(spark, 40, 60, 25, 1)
    both = {**texts, **{k + 100: t for k, t in more.items()}, 300: texts[3], 301: more[5] + " tail"}
    df = spark.createDataFrame(list(both.items()), "doc_id bigint, text string")
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in both.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert 20 < len(linked) < 2000
    by = {}
    for r in open_rows(df).collect():
        by.setdefault(r.code, set()).add(r.node)
    met = {(a, b) for nodes in by.values() for a in nodes for b in nodes if a < b}
    assert linked <= met
    least = {k: k for k in sets}
    while True:
        new = {k: min([least[k]] + [least[b] for a, b in linked if a == k] + [least[a] for a, b in linked if b == k]) for k in least}
        if new == least:
            break
        least = new
    assert {r.doc_id: r.component_id for r in J.similar_groups(df).collect()} == least
