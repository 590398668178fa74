"""Line dedup by pairwise alignment of overlapping documents.

Two documents overlap if they share a run: consecutive lines that together are just long
enough for a block, taken forward from each line and backward from each, so that the runs
of a block cover all of it. A run names the first document (smallest key) that has it as
the partner of every later one, however many those are, so a group of n copies gives n - 1
pairs, and a block that two documents share has a partner for each of its lines. Both
documents of a pair are aligned by patience diff: lines that are unique in both, in the
longest order common to both, are matched, and matches grow over equal neighbours; the
gaps between are aligned likewise. Blocks of matched lines are deleted from the later
document, and so are runs that its partner has but the alignment leaves, being out of
order or repeated: another earlier holder, not aligned with, would often match them.

Only hashes of lines are compared and moved; texts are read again where lines go.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import as_bytes, boxed, materialize, own_ids, release_heavy, small_batches, text_digest, unboxed, with_ids

SPACES = b" \t\r\x0b\x0c"


@dataclass(frozen=True)
class AlignConfig:
    least_block_bytes: int = 40  # shorter blocks stay


def block_runs(hashes: list[int], sizes: list[int], least: int) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the runs of a text: the fewest lines from each line on, and up to each line, that have ``least`` bytes."""
    spans = set()
    i = total = 0
    for j, size in enumerate(sizes):
        total += size
        while i < j and total - sizes[i] >= least:
            total -= sizes[i]
            i += 1
        if total >= least and size:
            spans.add((i, j + 1))  # up to line j
    j = len(sizes)
    total = 0
    for i in range(len(sizes) - 1, -1, -1):
        total += sizes[i]
        while j - 1 > i and total - sizes[j - 1] >= least:
            j -= 1
            total -= sizes[j]
        if total >= least and sizes[i]:
            spans.add((i, j))  # from line i on
    return [
        (hashes[i] if j == i + 1 else xxhash.xxh3_64_intdigest(np.array(hashes[i:j], np.uint64).tobytes()), i, j)
        for i, j in spans
        if any(hashes[i:j])
    ]


def unsigned(hashes: list[int]) -> list[int]:
    return np.array(hashes, np.int64).view(np.uint64).tolist()


def line_hashes(docs: DataFrame, key: str, text: str, c: AlignConfig) -> DataFrame:
    """(key, hashes, sizes, runs): a hash and the bytes of each line, 0 for a line without a word; the hashes of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ends, hashes, sizes, runs, run_ends = [0], [], [], [], [0]
                for t in part.column(1).to_pylist():
                    for line in as_bytes(t).split(b"\n"):
                        hashes.append((xxhash.xxh3_64_intdigest(line) | 1) if line.strip(SPACES) else 0)
                        sizes.append(len(line))
                    runs += {r[0] for r in block_runs(hashes[ends[-1] :], sizes[ends[-1] :], c.least_block_bytes)}
                    ends.append(len(hashes))
                    run_ends.append(len(runs))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(offsets, pa.array(np.array(hashes, np.uint64).view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(sizes, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(run_ends, pa.int32()), pa.array(np.array(runs, np.uint64).view(np.int64))),
                    ],
                    ["key", "hashes", "sizes", "runs"],
                )

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(text))
    return rows.mapInArrow(run, "key bigint, hashes array<bigint>, sizes array<int>, runs array<bigint>")


def overlapping(lines: DataFrame) -> DataFrame:
    """(key, first): pairs that share a run; ``first`` is the smaller key. ``lines`` is read twice."""
    each = lines.select("key", F.explode("runs").alias("hash"))
    # Written, so that both sides of the join come from exchanges and a hot run can be split.
    owners = materialize(
        each.groupBy("hash").agg(F.min("key").alias("first"), F.count("*").alias("df")).where("df > 1").select("hash", "first"), "run-owners"
    )
    return each.join(owners, "hash").where("key > first").select("key", "first").distinct()


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of a and b. Zeros match only as neighbours of matches."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i >= j or k >= m:
            continue
        na, nb = Counter(a[i:j]), Counter(b[k:m])
        place = {x: y for y, x in enumerate(b[k:m], k) if nb[x] == 1}
        both = [(x, place[v]) for x, v in enumerate(a[i:j], i) if v and na[v] == 1 and v in place]
        if not both:
            continue
        tops: list[int] = []  # piles of the longest rising sequence
        tail: list[int] = []
        back = [-1] * len(both)
        for n, (_, y) in enumerate(both):
            p = bisect_left(tops, y)
            back[n] = tail[p - 1] if p else -1
            if p == len(tops):
                tops.append(y)
                tail.append(n)
            else:
                tops[p], tail[p] = y, n
        chain, n = [], tail[-1]
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        edge = (i, k)
        for x, y in [*reversed(chain), (j, m)]:
            todo.append((edge[0], x, edge[1], y))
            edge = (x, y)
            # the match itself is found as the next gap's first line
    return sorted(found)


def common_lines(later: list[int], sizes: list[int], first: list[int], first_runs: list[int], c: AlignConfig) -> list[int]:
    """Lines of ``later`` in aligned blocks that are long enough, or in runs that ``first`` has elsewhere."""
    known = set(first_runs)
    gone = [n for run, i, j in block_runs(later, sizes, c.least_block_bytes) if run in known for n in range(i, j)]
    block: list[int] = []
    last = (-2, -2)
    for x, y in [*patience(later, first), (-9, -9)]:
        if (x, y) != (last[0] + 1, last[1] + 1):
            if sum(sizes[n] for n in block) >= c.least_block_bytes:
                gone += block
            block = []
        block.append(x)
        last = (x, y)
    return sorted(set(gone))


def aligned(pairs: DataFrame, lines: DataFrame, c: AlignConfig) -> DataFrame:
    """(key, gone): the lines that each later document loses, over all its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone = [], []
            for k, h, s, f, r in zip(*(x.to_pylist() for x in batch.columns)):
                if lost := common_lines(unsigned(h), s, unsigned(f), unsigned(r), c):
                    keys.append(k)
                    gone.append(lost)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    later = pairs.join(lines, "key").select("key", "hashes", "sizes", "first")
    both = later.join(lines.select(F.col("key").alias("first"), F.col("hashes").alias("first_hashes"), F.col("runs").alias("first_runs")), "first")
    lost = both.select("key", "hashes", "sizes", "first_hashes", "first_runs").mapInArrow(run, "key bigint, gone array<int>")
    return lost.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))  # a document's own lines


def without(text: Column, gone: Column) -> Column:
    """The text without the lines of ``gone``; as it is where that is null. Only texts that lose lines go to Python."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        release_heavy()
        for texts, places in batches:
            kept = []
            for t, p in zip(texts, places):
                if not t.is_valid or not p.is_valid:
                    kept.append(None)
                    continue
                lines, out = t.as_py().split("\n"), set(p.as_py())
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in out]))
            yield pa.array(kept, pa.string())

    # Not to be repeated by the optimizer, as a filter on the result would.
    shorter = F.arrow_udf(run, "string").asNondeterministic()(F.when(gone.isNotNull(), text), gone)
    return F.when(gone.isNull(), text).otherwise(shorter)


def lines_gone(docs: DataFrame, key: str = "doc_id", text: str = "text", c: AlignConfig = AlignConfig()) -> DataFrame:
    """(key, gone): for each key that loses lines which they are, from 0. Keys have one text each."""
    small_batches(docs.sparkSession)
    lines = materialize(line_hashes(docs, key, text, c).dropDuplicates(["key"]), "line-hashes")
    pairs = materialize(overlapping(lines), "line-pairs")
    return materialize(aligned(pairs, lines, c), "lines-gone")


def boxed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", c: AlignConfig = AlignConfig()) -> DataFrame:
    """(box, kept_text, n_lines, n_removed) for each row; ``box`` has all columns of the row. See dedup_lines."""
    rows = docs.select(boxed(docs).alias("box"))
    found = F.col("box").getField(key).cast("bigint") == F.col("key")
    if (ids := own_ids(docs, key, text)) is None:
        gone = lines_gone(docs, key, text, c)
    else:
        gone = lines_gone(with_ids(docs, key, text, ids), key, text, c).withColumnRenamed("key", "id").join(ids, "id").select("key", "digest", "gone")
        found = found & (text_digest(F.col("box").getField(text)) == F.col("digest"))
    # By hash, so texts are dealt out but never sorted; the lists of lines are small beside them.
    both = rows.join(gone.hint("shuffle_hash"), found, "left")
    t = F.col("box").getField(text)
    return both.select(
        "box",
        without(t, F.col("gone")).alias("kept_text"),
        F.when(t.isNull(), 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", c: AlignConfig = AlignConfig()) -> DataFrame:
    """All columns of ``docs``, with ``kept_text`` (before: those of the same name go), n_lines and n_removed.

    The key is a whole number that names a document. Rows that repeat a key and a text are
    one document, and each loses the same lines; rows that repeat a key with another text
    are documents of their own, in the order of their texts' digests. A row with a null key
    is kept as it is, and so is a null or empty text. A text whose lines all go becomes empty. Documents of equal text
    but different keys are copies: all but the first lose what is long enough to count.
    """
    found = boxed_lines(docs, key, text, c)
    fields = unboxed(found, "box")
    names = [f.name for f in found.schema["box"].dataType]
    new = ("kept_text", "n_lines", "n_removed")
    return found.select(*[f for f, n in zip(fields, names) if n not in new], *new)
