"""A member's version is hashed as its symbols come out of a sort."""

import hashlib
import random
from pathlib import Path

import pytest

from codeloom.operators.federation import versions
from codeloom.operators.shared import shared_dir
from codeloom.plans import catalog

SF = Path("/root/testdata/sf0.001")


def test_versions(spark):
    random.seed(3)
    rows = [(f"m{i % 5}", f"s{random.randrange(30000)}") for i in range(60000)]  # more than a batch of rows a member, repeated symbols
    rows += [("m1", None), ("none", None), (None, "x"), (None, "é"), ("m2", ""), ("m2", "a,b"), ("m2", "ß"), ("m2", "\U0001f600"), ("m2", "￮"), ("empty", ""), ("empty", "")]
    random.shuffle(rows)
    want = {}
    for member, symbol in rows:
        want.setdefault(member, set()).update([symbol] if symbol is not None else [])
    want = {m: hashlib.sha256(b",".join(sorted(s.encode() for s in found))).hexdigest() for m, found in want.items()}
    found = versions(spark.createDataFrame(rows, "member string, symbol string"))
    assert {r.member: r.stamp for r in found.collect()} == want and found.count() == len(want)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_no_member_is_collected(spark, tmp_path):
    (tmp_path / "tables").symlink_to(SF)
    before = len(list(Path(shared_dir(spark).removeprefix("file://")).iterdir()))
    found = catalog.queries()["Q-11_member_versions"](spark, f"{tmp_path}/tables")
    assert found.count() > 0
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert len(list(Path(shared_dir(spark).removeprefix("file://")).iterdir())) == before
