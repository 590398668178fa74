"""Rows that repeat a key with another text, and weights of 0."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import common, jaccard_join, line_align, mixing, suffix_tree

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i}" for i in range(400)]


def sentence(seed, n):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC).repartition(3)


def test_ids_keep_the_order_of_keys(spark):
    df = frame(spark, [(5, "b"), (5, "a"), (2, "x"), (2, "x"), (None, "q"), (None, "r"), (9, None), (9, "")])
    ids = {(r.key, r.digest): r.id for r in common.own_ids(df, "doc_id", "text").collect()}
    order = [k for k, _ in sorted(ids, key=ids.get)]
    assert order == [2, 5, 5, 9]
    assert common.own_ids(df.where("doc_id <> 5"), "doc_id", "text") is None


def test_substrings_of_repeated_keys(spark):
    p = sentence(1, 60)
    rows = [(1, p), (2, "head " + p), (2, sentence(2, 30)), (2, sentence(2, 30)), (None, p)]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in suffix_tree.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 60, 0), (2, 61, 60), (2, 30, 0), (2, 30, 0), (None, 60, 0)], key=str)


def test_lines_of_repeated_keys_are_kept(spark):
    same, other = "\n".join(sentence(i, 12) for i in range(4)), "\n".join(sentence(i, 12) for i in range(9, 13))
    got = line_align.dedup_lines(frame(spark, [(1, same), (2, same), (2, other)])).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in got) == sorted([(1, 0, same), (2, 4, ""), (2, 0, other)])


def test_components_of_repeated_keys(spark):
    a, b = sentence(3, 80), sentence(4, 80)
    near = a.replace(a.split()[40], "changed")
    got = jaccard_join.similar_groups(frame(spark, [(4, a), (7, b), (7, near), (9, b)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (7, 4), (7, 7), (9, 7)]


def test_a_weight_of_nothing_leaves_a_value_out(spark):
    rows = [(i, "one two three", ["en", "de", "fr"][i % 3], f"src{i % 4}", 0) for i in range(240)]
    df = spark.createDataFrame(rows, DOC)
    c = mixing.MixConfig(weights={"lang": {"de": 0, "en": 3}, "source": {"src2": 0}}, percent=50, max_epochs=1)
    got = mixing.mix_sources(df.withColumn("domain", mixing.domain_of(F.col("source"))), c=c).collect()
    assert got and {r.lang for r in got} == {"en", "fr"} and "src2" not in {r.source for r in got}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(mixing.mix_sources_sql(c)).fetchall()
    assert sorted(map(tuple, (r[:] for r in got))) == sorted(want)


def test_all_weights_nothing(spark):
    df = spark.createDataFrame([(1, "a b", "en", "src1", 0)], DOC).withColumn("domain", F.lit("d"))
    assert mixing.mix_sources(df, c=mixing.MixConfig(weights={"lang": {"en": 0}})).collect() == []
