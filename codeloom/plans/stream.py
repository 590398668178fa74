"""Queries of streams, run over what a folder holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import history as H
from codeloom.operators.shared import fresh_path
from codeloom.plans.registry import add
from codeloom.streaming import changes as T


def stream(m):
    """events.parquet as a stream."""
    schema = m.spark.read.parquet(f"{m.sf_dir}/events.parquet").schema
    return m.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(m.sf_dir)


def drained(m, build):
    """What a streaming query over events.parquet appends, run until all input is read."""
    target, checkpoint = fresh_path(m.spark, "stream"), fresh_path(m.spark, "stream-state")
    out = build(stream(m))
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return m.spark.read.schema(out.schema).parquet(target)


add("T-01_settled_bursts", lambda m: T.settled(m.events.select("ts", F.col("event_type").alias("path")), "300 seconds").select(F.unix_timestamp("start").alias("start_at"), "events", F.array_join("paths", ",").alias("paths")),
    """WITH e AS (SELECT ts, event_type, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) >= INTERVAL 300 SECOND THEN 1 ELSE 0 END AS gap FROM events), g AS (SELECT *, sum(gap) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start_at, count(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM g GROUP BY s""")
add(
    "T-02_event_kind",
    lambda m: m.files.select("path", T.event_kind(F.when(F.col("id") % 9 == 0, "coverage/lcov.info").when(F.col("id") % 9 == 1, "x/lcov.info").otherwise(F.col("path")), F.endswith("path", F.lit(".rs"))).alias("kind")),
    "SELECT path, CASE WHEN id % 9 = 0 THEN 'coverage' WHEN path LIKE '%.rs' THEN 'source' ELSE 'ignored' END AS kind FROM files",
)
add("T-06_revision", lambda m: T.revision(m.snapshots.select(F.col("id").alias("revision"))), "SELECT max(id) + 1 AS revision FROM snapshots")


def rolled(m):
    """Usage events of a stream as daily rollups, written batch by batch and merged."""
    target, checkpoint = fresh_path(m.spark, "rollup"), fresh_path(m.spark, "rollup-state")
    usage = stream(m).select(
        F.unix_timestamp("ts").alias("happened_at"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("surface"),
        F.col("event_type").alias("tool"),
        F.floor("value").cast("bigint").alias("duration_ms"),
        (F.col("event_type") != "error").alias("ok"),
    )
    T.usage_rollup(usage, target, checkpoint).awaitTermination()
    batches = m.spark.read.parquet(target).drop("batch")
    return H.merged_rollups(batches, batches.where("1 = 0"))


add(
    "S-03_stream_rollup",
    rolled,
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 's' || (user_id % 4) AS surface, event_type AS tool, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS ok_calls,
    CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_duration_ms, max(CAST(floor(value) AS BIGINT)) AS max_duration_ms FROM events GROUP BY 1, 2, 3""",
)
# When a watcher starts can't be put in SQL; a test holds it against a run tick by tick.
add(
    "T-01_flushes",
    lambda m: T.flushes(m.events.select((F.col("user_id") % 50).cast("string").alias("root"), "ts", F.col("event_type").alias("path")), T.Cadence(30.0, 1800.0, 7200.0, 14400.0)),
)
