"""Helpers shared by the corpus operators.

Conventions that hold for every operator here, unless its docstring says otherwise:

* An operator reads only the columns it is told to read. Further columns, whatever
  their names, neither matter nor appear in the result. Where a caller's rows have to
  come along, they travel in one struct (see ``boxed``), so no name of theirs can meet a
  name of the operator's own.
* A null text is an empty text. A row with a null key gets a row of its own in the result.
* Words are maximal runs of bytes other than ASCII white space (9 to 13, and 32).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.shared import shared_dir, spread

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20  # of texts that are sent to a Python worker at once


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame) -> Column:
    """All columns of df as one struct."""
    return F.struct(*[quoted(c) for c in df.columns])


def unboxed(df: DataFrame, box: str) -> list[Column]:
    """The fields of the struct column ``box`` of df under their own names."""
    return [F.col(box).getField(f.name).alias(f.name) for f in df.schema[box].dataType]


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes, where the session has Spark's own, larger, bound.

    A number of rows is no bound: ten thousand long texts would be held at once on both sides.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b"):
        spark.conf.set(name, str(BATCH_BYTES))


def groups_for(docs: DataFrame, text: str, entry_bytes: int, group_bytes: int, per_partition: int) -> int:
    """So many groups that an entry of ``entry_bytes`` for every word fits ``group_bytes`` a group, from a count of all bytes.

    A word has two bytes at least. There are ``per_partition`` groups for each of
    spark.sql.shuffle.partitions, or more.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * per_partition
    return max(least, -(-n_bytes // 2 * entry_bytes // group_bytes))


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, whatever is pickled again."""
    return sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache")).__dict__


def once(name: tuple, make: Callable[[], object]) -> object:
    """make(), or what it gave for this name before in this worker. (A wrapped lru_cache would be shipped by name.)"""
    cache = worker_cache()
    if name not in cache:
        cache[name] = make()
    return cache[name]


def heavy(name: tuple, make: Callable[[], object]) -> object:
    """As once(), for what takes much memory: a worker holds one such object, the last asked for."""
    cache = worker_cache()
    if cache.get("heavy_name") != name:
        release_heavy()
        cache["heavy_name"], cache["heavy"] = name, make()
    return cache["heavy"]


def release_heavy() -> None:
    """Give up what heavy() holds, for operators that need the memory for their own work."""
    cache = worker_cache()
    if cache.get("heavy_name") is not None:
        cache["heavy_name"] = cache["heavy"] = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can give memory back
            ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    df: DataFrame, key: str, text: str, schema: str, fn: Callable[[str | None], tuple], slice_rows: int = 500
) -> DataFrame:
    """A row (key, *fn(text)) for each row. ``schema`` names what fn returns."""
    names = [f.split()[0] for f in schema.split(", ")]
    key_type = df.schema[key].dataType.simpleString()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                rows = [fn(t) for t in part.column(1).to_pylist()]
                cols = [pa.array(c) for c in zip(*rows)] if rows else []
                if cols:
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["k", *names])

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.rename_columns([key, *names])

    return df.select(F.col(key), F.col(text)).mapInArrow(cast, f"`{key}` {key_type}, {schema}")


def text_digest(text: Column) -> Column:
    """A digest of a text; of nothing for a null one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def own_ids(docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """(key, digest, id) of each text, where a key has several texts; None where none has.

    Rows that repeat a key with another text are documents of their own. Their ids are in
    the order of keys, and of digests within a key, so whatever goes by the smaller key can
    go by the smaller id. Null keys have none.
    """
    rows = docs.select(quoted(key).cast("bigint").alias("key"), quoted(text).alias("text")).where("key is not null")
    brief = F.xxhash64(F.coalesce("text", F.lit("")))
    if rows.groupBy("key").agg(F.min(brief).alias("a"), F.max(brief).alias("b")).where("a <> b").isEmpty():
        return None
    each = rows.select("key", text_digest(F.col("text")).alias("digest")).distinct()
    return materialize(each.orderBy("key", "digest").withColumn("id", F.monotonically_increasing_id()), "own-ids")


def with_ids(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """(key, text) of docs with ids of own_ids() for keys; a null key stays null."""
    rows = docs.select(quoted(key).cast("bigint").alias("key"), text_digest(quoted(text)).alias("digest"), quoted(text).alias("text"))
    return rows.join(ids, ["key", "digest"], "left").select(F.col("id").alias(key), F.col("text").alias(text))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
