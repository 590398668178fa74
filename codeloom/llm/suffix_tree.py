"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A word is removed if a window of ``window`` words covers it whose word sequence also
starts earlier (in a smaller key, or before it in the same document). In the suffix tree
of the corpus such sequences are the inner nodes at least ``window`` words deep, and a
node's first leaf is the one that stays. The tree is never built as a whole:

1. Suffixes are split by a prefix of ``prefix`` words. It is enough to look at suffixes
   that start at anchors: in each window the anchor is the place whose prefix has the
   smallest fingerprint, so equal windows have equal anchors at equal offsets. A prefix
   that occurs once is a leaf, and nothing below it can repeat.
2. Prefixes that occur again are lengthened to the whole window, one branch for each
   window with that anchor. Suffixes with the same prefix meet in the same group. Where
   the branches of a group turn out to be more than fit ``group_bytes``, as below a prefix
   that goes on in very many ways, they are dealt anew by the longer prefix, the words of
   the whole window, and meet in a second round.
3. A group is a subtree: the nodes below which its suffixes lie, each with its first leaf.
   Nodes with two leaves or more are the repeats. Consecutive repeats (each the suffix
   link of the one before) run together into maximal ones (see ``maximal_repeats``).

There are as many groups as keep the distinct suffixes of one below ``group_bytes``, from a
count of all texts' bytes. A leaf is passed on as soon as an earlier leaf of its node is
known, so a group holds a node once, however many leaves that has, and a passage that a
third of all documents share takes no more memory than any other.

Edges are 64-bit fingerprints of word sequences, not words: at either depth a document
position costs 8 bytes and little more, where the words would take some 20 times that.

A block of documents (``block_words`` words or ``block_rows`` rows, whichever is less) is
worked on at once, and sends each fingerprint once however often it has it, since all but
its first place are settled there already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import as_bytes, groups_for, own_ids, release_heavy, small_batches, with_ids

ENTRY = "bucket int, prints binary, keys binary, places binary"
ENTRY_BYTES = 20  # a leaf in memory: fingerprint, key and place


@dataclass(frozen=True)
class RepeatConfig:
    window: int = 20
    prefix: int = 12
    block_words: int = 500_000
    block_rows: int = 2000
    group_bytes: int = 32 << 20  # of the distinct suffixes of a group
    groups_per_partition: int = 4  # groups for each of spark.sql.shuffle.partitions, at least
    settle_at: int = 500_000  # leaves that a group takes in before it passes on all it can


@dataclass
class Block:
    """Word fingerprints of some documents, one after the other, in the order of their keys."""

    keys: np.ndarray
    starts: np.ndarray  # of documents; one more for the end
    words: np.ndarray

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def blocks(keys: list[int], texts: list[str | None], c: RepeatConfig) -> Iterator[tuple[Block, list[int]]]:
    """Blocks of whole documents, and the rows each is made of. Texts too short for a window are left out."""
    rows, parts, n = [], [], 0
    for i, t in enumerate(texts):
        w = as_bytes(t).split()
        if keys[i] is not None and len(w) >= c.window:
            rows.append(i)
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)))
            n += len(w)
        if rows and (n >= c.block_words or i == len(texts) - 1):
            yield _block(keys, rows, parts), rows
            rows, parts, n = [], [], 0
    if rows:
        yield _block(keys, rows, parts), rows


def _block(keys: list[int], rows: list[int], parts: list[np.ndarray]) -> Block:
    k = np.array([keys[i] for i in rows], np.int64)
    order = np.argsort(k, kind="stable")
    ordered = [parts[i] for i in order]
    return Block(k[order], np.concatenate(([0], np.cumsum([len(p) for p in ordered]))), np.concatenate(ordered))


def fingerprints(words: np.ndarray, k: int) -> np.ndarray:
    """A fingerprint of the k words from each place on; shorter than words by k - 1."""
    with np.errstate(over="ignore"):
        n, factor, f = len(words) - k + 1, np.uint64(1), np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            f += words[j : j + n] * factor
            factor = factor * np.uint64(0x9E3779B97F4A7C15)
        f ^= f >> np.uint64(32)  # fixed odd factors; the steps can be undone, so nothing collides here
        f *= np.uint64(0xD6E8FEB86659FD93)
        f ^= f >> np.uint64(29)
    return f


def _least(v: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``width`` values in a row, by doubling."""
    out, have = v, 1
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchored(b: Block, c: RepeatConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix fingerprints, the smallest of each window, and which windows lie in one document."""
    v = fingerprints(b.words, c.prefix)
    least = _least(v, c.window - c.prefix + 1, np.minimum)
    fits = np.ones(len(b.words), bool)
    for k in range(1, c.window):
        fits[b.starts[1:] - k] = False  # every document here has a window at least
    return v, least, fits[: len(least)]


def anchors(v: np.ndarray, least: np.ndarray, fits: np.ndarray, c: RepeatConfig) -> np.ndarray:
    """Places whose prefix is the smallest of a window that holds it."""
    reach = c.window - c.prefix
    padded = np.zeros(len(v) + reach, np.uint64)
    padded[reach : reach + len(least)] = np.where(fits, least, 0)
    return np.flatnonzero((_least(padded, reach + 1, np.maximum) == v) & (v != 0))


def pack(a: np.ndarray) -> bytes:
    """Numbers that mostly rise slowly, as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(a, prepend=a.dtype.type(0)).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind), dtype=kind)


def _entries(group: np.ndarray, prints: np.ndarray, keys: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
    """One entry for each group, its members in the order given."""
    order = np.argsort(group, kind="stable")
    g, edges = np.unique(group[order], return_index=True)
    for k, rows in zip(g, np.split(order, edges[1:])):
        yield int(k), prints[rows].tobytes(), pack(keys[rows]), pack(places[rows])


def _table(entries: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*entries), kinds)], ["bucket", "prints", "keys", "places"])


def _by_key(keys: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row (key, places) for each key."""
    if not len(keys):
        return
    order = np.lexsort((places, keys))
    k, at = np.unique(keys[order], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(keys)), pa.int32()), pa.array(places[order], pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array(k), lists], ["key", "places"])


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the first of each value's run, for every element; and the run's length."""
    new = np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return first[run], np.diff(np.append(first, len(sorted_values)))[run]


def _settled(block: int, n_groups: int) -> int:
    """Below 0: entries that need no other. They are dealt out evenly."""
    return -1 - block % n_groups


def send_prefixes(n_groups: int, c: RepeatConfig) -> Callable:
    """(key, text) to entries: each anchor's prefix, once a block; and all places of those that the block repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        for batch in sliced(batches, c.block_rows):
            for b, _ in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), c):
                v, least, fits = anchored(b, c)
                at = anchors(v, least, fits, c)
                if not len(at):
                    continue
                doc = b.doc_of(at)
                place = (at - b.starts[doc]).astype(np.int32)
                order = np.argsort(v[at], kind="stable")
                first, size = _runs(v[at][order])
                head = np.flatnonzero(first == np.arange(len(order)))
                again = order[size > 1]
                here = np.sort(order[head])
                known = np.zeros(len(at), bool)
                known[again] = True
                # A prefix that the block repeats is sent with a place below 0: it makes those of other blocks repeats.
                sent = np.where(known[here], np.int32(-1), place[here])
                prints = v[at][here]
                yield _table(list(_entries((prints >> np.uint64(32)).astype(np.int64) % n_groups, prints, b.keys[doc[here]], sent)))
                if len(again):
                    again = np.sort(again)
                    tag = _settled(int(prints[0] & np.uint64(0xFFFFFF)), n_groups)
                    yield _table([(tag, b"", pack(b.keys[doc[again]]), pack(place[again]))])

    return run


def send_windows(n_groups: int, c: RepeatConfig) -> Callable:
    """(key, text, places of repeated anchors) to entries: each window with such an anchor, once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, c.block_rows):
            places = batch.column(2)
            keys = [k if p.is_valid else None for k, p in zip(batch.column(0).to_pylist(), places)]
            for b, rows in blocks(keys, batch.column(1).to_pylist(), c):
                v, least, fits = anchored(b, c)
                order = np.argsort(batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False), kind="stable")
                marks = [b.starts[i] + places[rows[r]].values.to_numpy() for i, r in enumerate(order)]
                repeated = np.unique(v[np.concatenate(marks)])
                slot = np.minimum(np.searchsorted(repeated, least), len(repeated) - 1)
                at = np.flatnonzero(fits & (repeated[slot] == least))
                if not len(at):
                    continue
                doc = b.doc_of(at)
                key, place = b.keys[doc], (at - b.starts[doc]).astype(np.int32)
                prints = fingerprints(b.words, c.window)[at]
                order = np.argsort(prints, kind="stable")
                first, _ = _runs(prints[order])
                lead = order[first]  # the first place of each one's window in this block
                later = order[(key[order] != key[lead]) | (place[order] != place[lead])]
                here = np.sort(order[np.flatnonzero(first == np.arange(len(order)))])
                group = (least[at[here]] >> np.uint64(32)).astype(np.int64) % n_groups
                yield _table(list(_entries(group, prints[here], key[here], place[here])))
                if len(later):
                    later = np.sort(later)
                    yield _table([(_settled(int(prints[0] & np.uint64(0xFFFFFF)), n_groups), b"", pack(key[later]), pack(place[later]))])

    return run


Leaves = tuple[np.ndarray, np.ndarray, np.ndarray]  # fingerprints, keys, places


def repeated_prefixes(leaves: Leaves) -> tuple[np.ndarray, Leaves]:
    """Which leaves lie below a node that has others; and a leaf for each node, with a place below 0 if it has others."""
    prints, keys, places = leaves
    order = np.argsort(prints, kind="stable")
    first, size = _runs(prints[order])
    again = order[size > 1]
    head = first == np.arange(len(order))
    kept = order[head]
    return again[places[again] >= 0], (prints[kept], keys[kept], np.where(size[head] > 1, np.int32(-1), places[kept]))


def later_leaves(leaves: Leaves) -> tuple[np.ndarray, Leaves]:
    """Which leaves are not the first of their node (a leaf that is there twice counts once); and the first of each node."""
    prints, keys, places = leaves
    order = np.lexsort((places, keys, prints))
    first, _ = _runs(prints[order])
    lead = order[first]
    kept = order[np.flatnonzero(first == np.arange(len(order)))]
    return order[(keys[order] != keys[lead]) | (places[order] != places[lead])], (prints[kept], keys[kept], places[kept])


def split_subtrees(n_groups: int, n_parts: int, c: RepeatConfig) -> Callable:
    """Entries of windows, sorted by group, to entries again: later leaves by parts of the keys (groups below 0), the rest by window.

    One group is held at a time, as its nodes with their first leaves. Nodes that don't fit
    are passed on by the window's own fingerprint, and so is what the group has after them.
    """
    most = c.group_bytes // ENTRY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Leaves] = []
        later: list[tuple[np.ndarray, np.ndarray]] = []
        current, n_new, n_later, split = None, 0, 0, False

        def settle(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n_later, split
            if not held:
                return
            leaves = tuple(np.concatenate(x) for x in zip(*held))
            rows, kept = later_leaves(leaves)
            later.append((leaves[1][rows], leaves[2][rows]))
            n_later += len(rows)
            held[:] = [kept]
            split = split or len(kept[0]) > most
            if split and (end or len(kept[0]) > most):
                prints, keys, places = kept
                yield _table(list(_entries((prints & np.uint64(0xFFFFFFFF)).astype(np.int64) % n_groups, prints, keys, places)))
                held.clear()

        def deal() -> Iterator[pa.RecordBatch]:
            nonlocal n_later
            if n_later:
                keys, places = (np.concatenate(x) for x in zip(*later))
                parts = _entries(keys % n_parts, np.zeros(len(keys), np.uint8), keys, places)
                yield _table([(-1 - part, b"", k, p) for part, _, k, p in parts])
            later.clear()
            n_later = 0

        for batch in batches:
            for group, prints, keys, places in zip(*(x.to_pylist() for x in batch.columns)):
                k, p = unpack(keys, np.int64), unpack(places, np.int32)
                if group < 0:
                    later.append((k, p))
                    n_later += len(k)
                else:
                    if group != current or n_new > c.settle_at:
                        yield from settle(group != current)
                        n_new = 0
                    if group != current:
                        held.clear()
                        current, split = group, False
                    held.append((np.frombuffer(prints, np.uint64), k, p))
                    n_new += len(k)
                if n_later > 4 * c.settle_at:
                    yield from deal()
        yield from settle(True)
        yield from deal()

    return run


def subtrees(pick: Callable[[Leaves], tuple[np.ndarray, Leaves]], c: RepeatConfig) -> Callable:
    """Entries, sorted by group, to (key, places) of the leaves that ``pick`` passes on. One group is held at a time.

    Groups below 0 are leaves that are settled, by parts of the keys; those of a part become one row a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Leaves] = []
        settled: list[tuple[np.ndarray, np.ndarray]] = []
        current, n_new = None, 0

        def settle() -> Iterator[pa.RecordBatch]:
            if settled:
                yield from _by_key(*(np.concatenate(x) for x in zip(*settled)))
                settled.clear()
            if held:
                leaves = tuple(np.concatenate(x) for x in zip(*held))
                rows, kept = pick(leaves)
                held[:] = [kept]
                yield from _by_key(leaves[1][rows], leaves[2][rows])

        for batch in batches:
            for group, prints, keys, places in zip(*(x.to_pylist() for x in batch.columns)):
                k, p = unpack(keys, np.int64), unpack(places, np.int32)
                if group != current or n_new > c.settle_at:
                    yield from settle()
                    n_new = 0
                if group != current:
                    held.clear()
                    current = group
                if group < 0:
                    settled.append((k, p))
                else:
                    held.append((np.frombuffer(prints, np.uint64), k, p))
                n_new += len(k)
        yield from settle()

    return run


def repeated_windows(docs: DataFrame, key: str, text: str, c: RepeatConfig = RepeatConfig()) -> tuple[DataFrame, DataFrame]:
    """(key, text) dealt by key, and (key, places): where windows start that also start earlier."""
    small_batches(docs.sparkSession)
    n_groups = groups_for(docs, text, ENTRY_BYTES, c.group_bytes, c.groups_per_partition)
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    dealt = lambda entries: entries.repartition("bucket").sortWithinPartitions("bucket")
    met = lambda entries, pick: (
        dealt(entries)
        .mapInArrow(subtrees(pick, c), "key bigint, places array<int>")
        .groupBy("key")
        .agg(F.flatten(F.collect_list("places")).alias("places"))  # of one document
    )
    prefixes = met(texts.mapInArrow(send_prefixes(n_groups, c), ENTRY), repeated_prefixes)
    # A left join, as the caller's: both then read one exchange of the texts. What has no such prefix is passed over.
    windows = texts.join(prefixes, "key", "left").select("key", "text", "places").mapInArrow(send_windows(n_groups, c), ENTRY)
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts, met(dealt(windows).mapInArrow(split_subtrees(n_groups, n_parts, c), ENTRY), later_leaves)


def maximal(places: np.ndarray, c: RepeatConfig) -> tuple[np.ndarray, np.ndarray]:
    """Starts and words of the runs of consecutive repeated windows."""
    p = np.unique(places)
    first = np.flatnonzero(np.concatenate(([True], np.diff(p) > 1))) if len(p) else np.empty(0, np.int64)
    return p[first], np.diff(np.append(first, len(p))) + c.window - 1


def maximal_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", c: RepeatConfig = RepeatConfig()) -> DataFrame:
    """(key, start, n_words) of every longest run of words whose windows all start earlier, too; words count from 0. Keys have one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, places in zip(batch.column(0).to_pylist(), batch.column(1)):
                start, n = maximal(places.values.to_numpy(), c)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int64()), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "start", "n_words"])

    _, marks = repeated_windows(docs, key, text, c)
    return marks.mapInArrow(run, "key bigint, start bigint, n_words bigint").withColumnRenamed("key", key)


RESULT = "key bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_repeats bigint, longest_repeat bigint, kept_text string"


def kept_words(c: RepeatConfig, texts: bool) -> Callable:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for t, places in zip(part.column(1).to_pylist(), part.column(2)):
                    w, n, runs = as_bytes(t).split(), 0, np.empty(0, np.int64)
                    n_words = len(w)
                    if places.is_valid:
                        starts, runs = maximal(places.values.to_numpy(), c)
                        edge = np.zeros(n_words + 1, np.int64)
                        edge[starts] += 1
                        np.add.at(edge, starts + runs, -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        n = int(gone.sum())
                        w = [w[i] for i in np.flatnonzero(~gone)]
                    kept = b" ".join(w)
                    digest = hashlib.sha256(kept).hexdigest()
                    out.append((n_words, n, digest, len(runs), int(runs.max(initial=0)), kept.decode("utf-8") if texts else None))
                cols = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", c: RepeatConfig = RepeatConfig(), texts: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, n_repeats, longest_repeat, kept_text) for each row; kept words are joined by one space.

    n_repeats counts the maximal repeats (see maximal_repeats), longest_repeat is the words
    of the longest, 0 without any. The key is a whole number; a row with a null key neither
    removes nor loses words. Rows that repeat a key and a text are one document, and get
    equal results; rows that repeat a key with another text are documents of their own, in
    the order of their texts' digests. ``texts`` False leaves kept_text null. Empty and null
    texts have no words.
    """
    if (ids := own_ids(docs, key, text)) is not None:
        own = remove_repeats(with_ids(docs, key, text, ids), key, text, c, texts)
        names = ids.select(F.col("id").alias("_id"), F.col("key").alias("_key"))
        return own.join(names, own[key] == F.col("_id"), "left").select(F.col("_key").alias(key), *own.columns[1:])
    all_texts, marks = repeated_windows(docs, key, text, c)
    return all_texts.join(marks, "key", "left").mapInArrow(kept_words(c, texts), RESULT).withColumnRenamed("key", key)
