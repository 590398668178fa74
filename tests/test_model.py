"""Projections are made when a query asks for them, and no others."""

from pathlib import Path

import pytest

from codeloom.operators.shared import shared_dir
from codeloom.plans import catalog
from codeloom.plans.model import PROJECTIONS, Model, imported

SF = Path("/root/testdata/sf0.001")
QUERIES = catalog.queries()


def stored(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    return sorted(p.name.split("-")[1] for p in folder.iterdir() if p.name.startswith("model-"))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_a_query_makes_what_it_reads(spark, tmp_path):
    (tmp_path / "tables").symlink_to(SF)
    before = stored(spark)
    for name in ("A-14_code_facts", "F-12_overlay_cap", "C-14_posting_join"):
        QUERIES[name](spark, f"{tmp_path}/tables").count()
    assert stored(spark) == before
    QUERIES["H-27_back_edges"](spark, f"{tmp_path}/tables").count()
    assert set(stored(spark)) - set(before) <= {"imports", "functions"} and len(stored(spark)) == len(before) + 2


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_only_has_the_same_rows(spark, tmp_path):
    (tmp_path / "tables").symlink_to(SF)
    m = Model(spark, f"{tmp_path}/tables")
    few = {kind: m.only("edges", f"kind = '{kind}'") for kind in ("contains", "calls", "references", "accesses", "doc_reference")}
    assert "edges" not in m._made
    for kind, rows in few.items():
        assert sorted(rows.collect()) == sorted(m.edges.where(f"kind = '{kind}'").collect())
    sections = m.only("nodes", "kind = 'doc_section'")
    assert sorted(sections.select("id").collect()) == sorted(m.nodes.where("kind = 'doc_section'").select("id").collect())


def test_imports_read_the_lines_once(spark, tmp_path):
    rows = [(o, 1 + i, (o * 7 + i * i) % 13) for o in range(40) for i in range(o % 7)]
    rows += [(5, 2, 3), (5, 2, 4), (5, 1, 9), (None, 1, 1), (None, 2, 2), (6, None, 1), (6, 1, None), (7, 10, 2), (8, 11, 5), (7, 11, 8), (90, 1, 2), (90, 2, 3), (90, 2, 4), (89, 11, 2), (89, 12, 5)]
    path = f"{tmp_path}/lines"
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(path)
    lines = spark.read.parquet(path)
    want = spark.sql(PROJECTIONS["imports"].replace("JOIN lineitem", "JOIN {t}").replace("FROM lineitem", "FROM {t}"), t=lines)
    assert sorted(imported(lines).collect()) == sorted(want.collect()) != []
    plan = imported(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_paths_are_not_stored(spark, tmp_path):
    (tmp_path / "tables").symlink_to(SF)
    before = stored(spark)
    found = QUERIES["B-15_ignore_file"](spark, f"{tmp_path}/tables")
    assert found.count() > 0 and stored(spark) == before
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {Path(f).stem for f in found.inputFiles()} == {"part", "nation", "supplier", "documents", "lineitem"}
    m = Model(spark, f"{tmp_path}/tables")
    paths = sorted(m.paths().collect())
    assert "files" not in m._made and paths == sorted(m.files.select("path").collect()) == sorted(m.paths().collect())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_doc_gaps_read_no_order_lines(spark, tmp_path):
    (tmp_path / "tables").symlink_to(SF)
    before = stored(spark)
    found = QUERIES["F-08_doc_gap_page"](spark, f"{tmp_path}/tables")
    assert found.count() > 0 and stored(spark) == before
    assert {Path(f).stem for f in found.inputFiles()} == {"part", "documents"}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_function_metrics_store_nothing(spark, tmp_path):
    (tmp_path / "tables").symlink_to(SF)
    before = stored(spark)
    once = QUERIES["K-05_to_10_functions"](spark, f"{tmp_path}/tables").collect()
    assert stored(spark) == before
    assert Model(spark, f"{tmp_path}/tables").functions.count() > 0
    assert QUERIES["K-05_to_10_functions"](spark, f"{tmp_path}/tables").collect() == once  # the same rows from what is stored


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_the_overlay_reads_documents_and_parts_alone(spark, tmp_path):
    """What it sends is a row for each task and target, so it grows with documents only."""
    (tmp_path / "tables").symlink_to(SF)
    before = stored(spark)
    found = QUERIES["F-12_overlay_cap"](spark, f"{tmp_path}/tables")
    assert {Path(f).stem for f in found.inputFiles()} == {"documents", "part"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert found.count() == 60 and stored(spark) == before


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_ingest_reads_its_own_folder_alone(spark, tmp_path):
    """No projection has to be there from a query before, and none of another folder is read."""
    (tmp_path / "tables").symlink_to(SF)
    spark.catalog.dropTempView("coverage_files")
    first = QUERIES["N-01_ingest"](spark, f"{tmp_path}/tables").collect()
    spark.createDataFrame([], "id bigint, path string, content_hash string").createOrReplaceTempView("coverage_files")
    (tmp_path / "again").symlink_to(SF)
    assert sorted(QUERIES["N-01_ingest"](spark, f"{tmp_path}/again").collect()) == sorted(first) != []
