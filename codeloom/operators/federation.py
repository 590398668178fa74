"""Reading the same from several members, each of which may fail by itself."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.shared import written

AT_ONCE = 4  # members read side by side


def fan_out(spark: SparkSession, members: dict[str, Callable[[], DataFrame]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(member, the columns of schema) of all members that could be read, and (member, error) of the others.

    A member's rows are written before they count, so one that fails halfway gives an error
    and no rows, and the others keep theirs. ``error`` is the condition that Spark names.
    """
    empty = spark.createDataFrame([], schema)

    def read(name: str) -> tuple[str, DataFrame | None, str | None]:
        try:
            return name, written(members[name]().select(*empty.columns), f"member-{name}"), None
        except PySparkException as e:
            return name, None, e.getCondition() or type(e).__name__

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(read, sorted(members)))
    tagged = [rows.select(F.lit(name).alias("member"), *empty.columns) for name, rows, error in done if error is None]
    rows = reduce(DataFrame.unionByName, tagged, empty.select(F.lit("").alias("member"), *empty.columns))
    return rows, spark.createDataFrame([(name, error) for name, _, error in done if error is not None], "member string, error string")


def versions(rows: DataFrame) -> DataFrame:
    """(member, stamp): SHA-256 of a member's distinct symbols in their order, joined by commas.

    A member's symbols are sorted by the engine, which spills, and hashed as they come, so no
    member is ever held whole. Null is no symbol.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = last = digest = None
        out = lambda: pa.RecordBatch.from_pydict({"member": pa.array([member], pa.string()), "stamp": [digest.hexdigest()]})
        for batch in batches:
            for of, symbol in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or of != member:
                    if digest is not None:
                        yield out()
                    member, last, digest = of, None, hashlib.sha256()
                if symbol is not None and symbol != last:
                    digest.update((symbol if last is None else f",{symbol}").encode())
                    last = symbol
        if digest is not None:
            yield out()

    return rows.select("member", "symbol").repartition("member").sortWithinPartitions("member", "symbol").mapInArrow(run, "member string, stamp string")
