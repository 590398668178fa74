"""Files made from one table are parsed by all cores."""

import re
from pathlib import Path

import pytest

from codeloom.plans import catalog, sources
from codeloom.plans.model import Model

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_files_are_dealt_to_all_cores(spark):
    m, cores = Model(spark, str(SF)), spark.sparkContext.defaultParallelism
    assert cores > 1
    for files in (sources.python_files, sources.code_files, sources.branched_files, sources.routed_files):
        assert files(m).rdd.getNumPartitions() == cores
    assert sources.from_parts(m, sources.CONFIGS).rdd.getNumPartitions() == cores
    for name in ("P-16_source_dispatch", "P-16_marked_live", "P-15_source_topics", "J-11_client_calls", "A-17_openapi", "A-23_toml"):
        plan = catalog.queries()[name](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
        python = len(re.findall("MapInPandas", plan))
        assert python and len(re.findall(rf"Repartition {cores}, true", plan)) == python, name
