"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_GROUP = 128 << 20  # bytes, what Parquet writers usually make
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a folder on this machine, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it comes from fewer files than there are cores, none much over a row group.

    A row group is read by one task, however long what follows takes. Larger files have several
    and are read by as many tasks, so at most ROW_GROUP bytes a core are ever dealt.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 0 < files < cores and size <= files * ROW_GROUP else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with whole numbers ``name`` from 1 on in the order of a column, without all rows in one task.

    Rows are dealt by ranges and numbered in each; a row a range says how many come before it.
    """
    within = (1 << 33) - 1  # the numbers of monotonically_increasing_id() are ranges above rows
    rows = written(df.orderBy(order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(within)})
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sizes.select("_range", before.alias("_before"))
    return rows.join(starts, "_range").select((F.col("_before") + F.col("_at") + 1).alias(name), *df.columns)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage; it survives lost executors."""
    return written(df, "cut")
