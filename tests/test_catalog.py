"""Every query with SQL against DuckDB over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from codeloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert mine == theirs


def test_every_query_has_sql():
    """But for those that SQL can't express; these have tests of their own."""
    assert set(QUERIES) - set(ORACLE) == {"T-01_flushes"}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
