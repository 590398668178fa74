"""Queries on nodes whose ids repeat: keys of parts that are those of modules and suppliers, as in large tables."""

from pathlib import Path

import duckdb
import pytest

from codeloom.plans import catalog

SF = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
NAMES = ("H-04_nearest_module", "H-04_module_rollup", "H-12_node_detail")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    out = tmp_path_factory.mktemp("repeated")
    key = "CAST(CASE WHEN {k} % 4 = 0 THEN 1000000 + {k} // 4 WHEN {k} % 4 = 1 THEN 2000000 + {k} // 4 ELSE {k} END AS BIGINT) AS {k}"
    for table, k in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        duckdb.execute(f"COPY (SELECT * REPLACE ({key.format(k=k)}) FROM '{SF}/{table}.parquet') TO '{out}/{table}.parquet'")
    for p in SF.glob("*.parquet"):
        if not (out / p.name).exists():
            (out / p.name).symlink_to(p)
    return out


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, tables, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in tables.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, str(tables))
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    mine = sorted(tuple(str(r[c]) for c in names) for r in got.collect())
    assert mine == sorted(tuple(map(str, r)) for r in cur.fetchall()) and mine
