"""A deviation of exactly a half goes up, whatever order the rows come in."""

from itertools import permutations

from pyspark.sql import functions as F

from codeloom.functions.scalars import rounded_deviation
from codeloom.operators import history as H

DAY = 86_400


def test_halves_do_not_depend_on_order(spark):
    ages = [342, 85, 265, 246]  # 93.5
    orders = list(permutations(ages))
    rows = [(f"c{i}-{j}", f"p{i}", (1000 - a) * DAY) for i, o in enumerate(orders) for j, a in enumerate(o)]
    commits = spark.createDataFrame([(s, t, "a", "x", 1) for s, _, t in rows] + [("head", 1000 * DAY, "a", "x", 1)], "sha string, committed_at bigint, author_email string, subject string, file_count int")
    changes = spark.createDataFrame([(s, p, 1, 1) for s, p, _ in rows], "commit_sha string, path string, added int, deleted int").coalesce(1)
    assert {r[0] for r in H.file_history(commits, changes).select("age_dispersion_days").collect()} == {94}


def test_deviation_of_few_and_large(spark):
    rows = spark.createDataFrame([("one", 7), ("even", 0), ("even", 2), ("below", 0), ("below", 3), ("large", 0), ("large", 10**9), ("large", 10**9), ("large", 0)], "k string, x bigint")
    got = {r.k: r.d for r in rows.groupBy("k").agg(rounded_deviation(F.col("x"), 1).alias("d")).collect()}
    assert got == {"one": 0, "even": 1, "below": 2, "large": 500_000_000}
