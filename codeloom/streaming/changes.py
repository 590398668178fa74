"""Streams of file events and usage events.

Late or lost events are made good by a periodic batch reconcile (see operators.store.synced),
not by waiting: watermarks only bound state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.history import rolled_up
from codeloom.sources.readers import COVERAGE_PATHS


def event_kind(path: Column, source: Column) -> Column:
    """coverage, source or ignored."""
    return F.when(path.isin(*COVERAGE_PATHS), "coverage").when(source, "source").otherwise("ignored")


@dataclass(frozen=True)
class Cadence:
    """Seconds. Fixed default values.

    Events within ``debounce`` of the first come together, at its end. A batch starts when
    nothing came for ``settle``, or ``staleness`` after its first events at the latest, but
    not before ``interval`` has passed since the batch before.
    """

    debounce: float = 0.3
    settle: float = 1.5
    interval: float = 3.0
    staleness: float = 10.0


@dataclass
class Pending:
    """What one root waits with."""

    c: Cadence
    window: float | None = None  # start of the open debounce window
    fresh: list[str] = field(default_factory=list)
    first: float | None = None
    last: float = 0.0
    paths: set[str] = field(default_factory=set)
    events: int = 0
    flushed: float = float("-inf")

    def _due(self) -> float:
        return max(min(self.last + self.c.settle, self.first + self.c.staleness), self.flushed + self.c.interval)

    def upto(self, now: float) -> Iterator[tuple[float, int, list[str]]]:
        """The batches that start until ``now``; all for infinity."""
        while True:
            arrives = self.window + self.c.debounce if self.window is not None else float("inf")
            due = self._due() if self.first is not None else float("inf")
            if due < arrives and due <= now:
                yield due, self.events, sorted(self.paths)
                self.first, self.events, self.paths, self.flushed = None, 0, set(), due
            elif arrives <= now and self.window is not None:
                self.first = arrives if self.first is None else self.first
                self.last, self.events = arrives, self.events + len(self.fresh)
                self.paths.update(self.fresh)
                self.window, self.fresh = None, []
            else:
                return

    def add(self, at: float, path: str) -> None:
        self.window = at if self.window is None else self.window
        self.fresh.append(path)


def flushes(events: DataFrame, c: Cadence = Cadence()) -> DataFrame:
    """(root, started_at, events, paths): the batches that events (root, ts, path) give, each path once in a batch.

    Events are read in order, root by root, and only what waits is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, state = None, Pending(c)
        for pdf in batches:
            out = []
            for r, at, path in zip(pdf["root"], pdf["at"], pdf["path"]):
                if r != root:
                    out += [(root, *b) for b in state.upto(float("inf"))]
                    root, state = r, Pending(c)
                out += [(root, *b) for b in state.upto(at)]
                state.add(at, path)
            yield pd.DataFrame(out, columns=["root", "started_at", "events", "paths"])
        yield pd.DataFrame([(root, *b) for b in state.upto(float("inf"))], columns=["root", "started_at", "events", "paths"])

    rows = events.where("root is not null and ts is not null").select("root", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "path")
    ordered = rows.repartition("root").sortWithinPartitions("root", "at", "path")
    found = ordered.mapInPandas(run, "root string, started_at double, events bigint, paths array<string>")
    return found.withColumn("paths", F.array_join("paths", ","))


def settled(events: DataFrame, settle: str = "1.5 seconds", late: str = "10 seconds") -> DataFrame:
    """(start, end, events, paths): bursts of events with no gap longer than ``settle``, each path once."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    burst = marked.groupBy(F.session_window("ts", settle).alias("w"))
    return burst.agg(F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths")).select("w.start", "w.end", "events", "paths")


def coalesced(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Each path once as long as the watermark remembers it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"])


def usage_rollup(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write usage events in batches as daily rollups, a folder for each batch; a batch that is tried again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        rolled_up(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revision(counter: DataFrame) -> DataFrame:
    """The next revision after the highest so far; 1 at first."""
    return counter.agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))
