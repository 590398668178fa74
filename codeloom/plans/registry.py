"""Where the modules of queries put them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.model import Model, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, make: Callable[[Model], DataFrame], sql: str | None = None) -> None:
    """A query over the model's tables, and SQL over the same with the same columns."""
    if name in QUERIES:
        raise ValueError(f"{name} is there already")
    QUERIES[name] = lambda spark, sf_dir: make(Model(spark, sf_dir))
    if sql:
        ORACLE[name] = oracle(sql)
