"""Exact n-gram Jaccard join by universe partition and pigeonhole.

A document is the set of its word shingles. Sets fall in bands by size. For each band the
universe of shingles is cut by hash into segments, and a set has, in each segment that is
not empty, a subset. Two sets with a Jaccard similarity of t or more, sizes r and s,
differ in at most H = (1 - t) / (1 + t) * (r + s) shingles, so all but H of the segments
hold equal subsets. Hence, in any order of subsets that is the same for all documents,
two such sets share one of the first H + 1 non-empty subsets of either.

* The order is by how many documents have the subset, from a count over all documents; so
  what many documents share comes last, and subsets that only one document has come
  first. A document with more than H of the latter has no partner and is done.
* Where H is 1 at most (the smallest sets) one segment is enough, if documents give the
  whole set and each set with one shingle less: two sets that differ in one shingle agree
  in one of those.
* How many segments a band has, and whether it takes deletions, is settled by cost: the
  fewest subsets that leave no set short of H + 1 (see ``allocate``).

Subsets that documents share give candidate pairs: each document with the smallest key
among those that share the subset. Pairs are verified on the words of whole texts. Where a
pair fails, documents with that subset that are in different components yet are compared
by sketches, in blocks (see ``across``), and verified where these leave it open. So no
link between different texts is lost as far as components go, and a group of n copies
costs about n comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import as_bytes, groups_for, materialize, once, own_ids, release_heavy, small_batches, with_ids
from codeloom.llm.components import connected
from codeloom.llm.suffix_tree import pack, unpack

ROLE = 1  # lowest bit of a subset's code: which of two neighbouring bands it belongs to
CLASS_SHIFT = 57  # highest bits: the class of its count
ENTRY_BYTES = 12  # an entry in memory: code and key; a word gives one at most, on the whole


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    percent: int = 75
    block_words: int = 1_000_000
    block_rows: int = 2000
    group_bytes: int = 32 << 20  # of the entries of a group
    groups_per_partition: int = 4  # groups for each of spark.sql.shuffle.partitions, at least
    extra_segments: int = 1  # raised where a set had too few subsets
    open_block: int = 4096  # documents of an open subset that are compared with each other at once
    held_shingles: int = 200_000  # of documents verified lately

    def most_differing(self, r: int, s: int) -> int:
        return (100 - self.percent) * (r + s) // (100 + self.percent)

    def largest_partner(self, s: int) -> int:
        return s * 100 // self.percent


@dataclass(frozen=True)
class Band:
    index: int
    low: int
    high: int
    segments: int
    deletions: bool


def allocate(index: int, low: int, high: int, smallest: int, c: JoinConfig) -> Band:
    """The cheapest segmentation of a band whose sets (and partners from below) have smallest to high shingles.

    One segment serves if no two sets can differ at all, or in one shingle if deletions are
    given too. Else subsets alone are cheaper than their deletions (one for each unit of H,
    against k + 1 for two): the fewest segments for which the chance that H or fewer are
    hit, by the union bound C(m, H) (H / m)^s, is below 10^-12 for every size.
    """
    worst = c.most_differing(high, high)
    if worst <= 1:
        return Band(index, low, high, 1, worst == 1)
    m = max(2, math.ceil(high * 0.4))
    sizes = sorted({*range(smallest, min(high, smallest + 40) + 1), *np.linspace(smallest, high, 40).astype(int).tolist()})

    def short(m: int) -> float:
        out = -math.inf
        for s in sizes:
            h = c.most_differing(s, min(high, c.largest_partner(s)))
            if h:
                out = max(out, math.log(math.comb(m, h)) + s * math.log(h / m) if h < m else 0.0)
        return out

    while short(m) > math.log(1e-12):
        m = math.ceil(m * 1.1)
    return Band(index, low, high, m * c.extra_segments, False)


def band(index: int, c: JoinConfig) -> Band:
    return once(("jaccard-band", index, c.words, c.percent, c.extra_segments), lambda: make_band(index, c))


def make_band(index: int, c: JoinConfig) -> Band:
    """Bands of sizes 1, 2-6, and from 7 on by factors of 4 (for a similarity of 0.75)."""
    if index < 0:
        return Band(index, 0, 0, 0, False)
    edges = [1]
    while len(edges) < 2 and c.most_differing(edges[0], edges[0]) == 0:
        edges.append(next(s for s in range(2, 10_000) if c.largest_partner(s - 1) < s or c.most_differing(s, s - 1) > 0))
    while len(edges) < 3:  # as long as two sets of the band differ in one shingle at most
        edges.append(next(s for s in range(edges[-1] + 1, 10_000) if c.most_differing(s, s) > 1))
    while len(edges) < index + 2:
        edges.append(edges[-1] * 4)
    low, high = edges[index], edges[index + 1] - 1
    below = -(-low * c.percent // 100)
    return allocate(index, low, high, min(low, below), c)


def band_of(size: int, c: JoinConfig) -> Band:
    i = 0
    while band(i, c).high < size:
        i += 1
    return band(i, c)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return as_bytes(text).lower().split()


def exact_shingles(words: list[bytes], c: JoinConfig) -> set[bytes]:
    """The distinct shingles themselves. No word has a blank, so joined words are told apart."""
    k = min(c.words, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def shingles(words: list[bytes], c: JoinConfig) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(c.words, len(w))
    n, f = len(w) - k + 1, np.full(len(w) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            f = f * np.uint64(0xD6E8FEB86659FD93) + w[j : j + n]
    return np.unique(mixed(f, 0))


def subsets(s: np.ndarray, b: Band) -> np.ndarray:
    """Codes of a set's non-empty subsets in the segments of a band; with deletions where the band takes them."""
    segment = ((s >> np.uint64(32)) * np.uint64(b.segments)) >> np.uint64(32)  # rises with s
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    with np.errstate(over="ignore"):
        content = np.add.reduceat(mixed(s, 1), first)
        if b.deletions:
            content = np.concatenate((content, content[0] - mixed(s, 1)))
            segment = np.zeros(len(content), np.uint64)
        else:
            segment = segment[first]
        return mixed(content + segment * np.uint64(0xA24BAED4963EE407), 2 + b.index)


def roles(size: int, c: JoinConfig) -> list[tuple[Band, int]]:
    """Bands whose subsets a set gives, with its H: its own, and the next if a partner may lie there."""
    own = band_of(size, c)
    out = [(own, c.most_differing(size, min(own.high, c.largest_partner(size))))]
    if c.largest_partner(size) > own.high:
        out.append((band(own.index + 1, c), c.most_differing(size, c.largest_partner(size))))
    return out


def send_subsets(n_groups: int, c: JoinConfig):
    """(key, text) to entries of codes and keys by group, and a row (key, size, n_own, n_next, first) for each key.

    Documents of one block with equal sets (of words, not of fingerprints only) give their
    subsets once; the others name the ``first`` of them. n_own and n_next say how many
    subsets there are.
    """

    def same(known: list[tuple[int, bytes]], words: list[bytes], joined: bytes) -> int | None:
        for k, other in known:
            if other == joined or exact_shingles(other.split(), c) == exact_shingles(words, c):
                return k
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        for batch in (b.slice(at, c.block_rows) for b in batches for at in range(0, b.num_rows, c.block_rows)):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
            at = 0
            while at < len(order):
                known: dict[bytes, list[tuple[int, bytes]]] = {}
                rows, codes, owner, n_words = [], [], [], 0
                while at < len(order) and n_words < c.block_words:
                    k, words = keys[order[at]], words_of(texts[order[at]])
                    s = shingles(words, c)
                    at += 1
                    n_words += len(s) + 10
                    first, counts = k, [0, 0]
                    if len(s) and k is not None:
                        alike, joined = known.setdefault(xxhash.xxh3_128_digest(s.tobytes()), []), b" ".join(words)
                        if (found := same(alike, words, joined)) is None:
                            alike.append((k, joined))
                        else:
                            first = found
                    if len(s) and k is not None and first == k:
                        for i, (b, h) in enumerate(roles(len(s), c)):
                            found = subsets(s, b)
                            counts[i] = len(found) if b.deletions or len(found) > h else -1
                            codes.append((found & ~np.uint64(ROLE)) | np.uint64(b.index & 1))
                            owner.append(np.full(len(found), k, np.int64))
                    rows.append((k, len(s), *counts, first))
                cols = list(zip(*rows))
                none = [None] * len(rows)
                yield _batch(none, none, none, *cols)
                if codes:
                    code, who = np.concatenate(codes), np.concatenate(owner)
                    group = ((code >> np.uint64(33)) % np.uint64(n_groups)).astype(np.int64)
                    by = np.argsort(group, kind="stable")
                    g, edges = np.unique(group[by], return_index=True)
                    parts = np.split(by, edges[1:])
                    low = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    n = len(parts)
                    yield _batch(g.tolist(), [low[p].tobytes() for p in parts], [pack(who[p]) for p in parts], *[[None] * n] * 5)

    return run


SENT = (("bucket", pa.int32()), ("codes", pa.binary()), ("keys", pa.binary()), ("key", pa.int64()), ("size", pa.int64()), ("n_own", pa.int64()), ("n_next", pa.int64()), ("first", pa.int64()))


def _batch(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(cols, SENT)], [n for n, _ in SENT])


def count_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries, sorted by group, to (key, codes): subsets that two or more have, led by the class of their count."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current = None

    def done() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        low, keys = (np.concatenate(x) for x in zip(*held))
        held.clear()
        _, slot, n = np.unique(low, return_inverse=True, return_counts=True)
        df = n[slot]
        many = np.flatnonzero(df > 1)
        if not len(many):
            return
        order = np.ceil(np.log2(df[many])).astype(np.int64)
        codes = (order << CLASS_SHIFT) | (np.int64(current) << 32) | low[many].astype(np.int64)
        by = np.argsort(keys[many], kind="stable")
        k, at = np.unique(keys[many][by], return_index=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k), pa.ListArray.from_arrays(pa.array(np.append(at, len(by)), pa.int32()), pa.array(codes[by]))], ["key", "codes"]
        )

    for batch in batches:
        for group, codes, keys in zip(*(x.to_pylist() for x in batch.columns)):
            if group != current:
                yield from done()
                current = group
            held.append((np.frombuffer(codes, np.uint32), unpack(keys, np.int64)))
    yield from done()


def first_subsets(c: JoinConfig):
    """(key, size, n_own, n_next, codes) to (code, key, size): those of the first H + 1 in order that others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_codes, out_keys, out_sizes = [], [], []
            for i, (k, size, *counts) in enumerate(zip(*(x.to_pylist() for x in batch.columns[:4]))):
                codes = np.sort(batch.column(4)[i].values.to_numpy())
                for (b, h), n in zip(roles(size, c), counts):
                    own = codes[(codes & ROLE) == (b.index & 1)]
                    if not b.deletions:
                        own = own[: max(0, h + 1 - (n - len(own)))]
                    out_codes.append(own)
                    out_keys += [k] * len(own)
                    out_sizes += [size] * len(own)
            codes = np.concatenate(out_codes) if out_codes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(out_keys, pa.int64()), pa.array(out_sizes, pa.int64())], ["code", "key", "size"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, c: JoinConfig) -> DataFrame:
    """(a, b, linked) of each pair (a, b), from the shingles of both texts, word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        known: dict[int, set[bytes]] = {}
        held = 0

        def of(key: int, words: bytes) -> set[bytes]:
            nonlocal held
            if key not in known:
                if held > c.held_shingles:
                    known.clear()
                    held = 0
                known[key] = exact_shingles(words.split(), c)
                held += len(known[key])
            return known[key]

        for batch in batches:
            linked = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = of(a, x.as_py()), of(b, y.as_py())
                both = len(x & y) if 100 * min(len(x), len(y)) >= c.percent * max(len(x), len(y)) else 0
                linked.append(100 * both >= c.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("words").alias("x")), "a")
    two = one.join(sets.select(F.col("key").alias("b"), F.col("words").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, linked boolean")


SKETCH_WORDS = 16


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the parities of how many shingles fall in each of 1024 cells, as 16 whole numbers.

    Two sets have as many different parities as the size of their difference, at most.
    """
    out = np.empty((len(sets), SKETCH_WORDS), np.int64)
    for i, s in enumerate(sets):
        odd = np.bincount((s & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return out


def set_table(docs: DataFrame, c: JoinConfig) -> DataFrame:
    """(key, words, sketch): the words in lower case, joined by a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [words_of(t) for t in part.column(1).to_pylist()]
                marks = pa.FixedSizeListArray.from_arrays(pa.array(sketches([shingles(w, c) for w in words]).ravel()), SKETCH_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([b" ".join(w) for w in words], pa.binary()), marks.cast(pa.list_(pa.int64()))], ["key", "words", "sketch"]
                )

    return docs.mapInArrow(run, "key bigint, words binary, sketch array<bigint>")


@dataclass
class Members:
    """Documents of one subset, or some of them; ``apart`` are those outside the largest component."""

    node: np.ndarray
    size: np.ndarray
    component: np.ndarray
    apart: np.ndarray
    marks: np.ndarray

    def where(self, rows: np.ndarray) -> Members:
        return Members(self.node[rows], self.size[rows], self.component[rows], self.apart[rows], self.marks[rows])


def could_link(x: Members, y: Members, c: JoinConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (of x, of y) of pairs from different components whose sizes and sketches allow a link.

    Two sets have as many different parities as the size of their difference, at most, so
    no pair that is a link is left out.
    """
    step = max(1, (1 << 17) // max(1, len(y.node)))
    for at in range(0, len(x.node), step):
        part = x.where(np.s_[at : at + step])
        node, size = part.node[:, None], part.size[:, None]
        differ = np.bitwise_count(part.marks[:, None, :] ^ y.marks[None, :, :]).sum(axis=2, dtype=np.int64)
        good = (part.component[:, None] != y.component) & (differ * (100 + c.percent) <= (size + y.size) * (100 - c.percent))
        good &= 100 * np.minimum(size, y.size) >= c.percent * np.maximum(size, y.size)
        good &= ~y.apart | (node < y.node)  # of two that are both asked, once
        i, j = np.nonzero(good)
        yield part.node[i], y.node[j]


def compare_blocks(c: JoinConfig):
    """Rows (code, i, j, asked, node, size, component, apart, sketch), sorted by the first three, to pairs (a, b).

    One block of a subset is held at a time. asked is null in a subset that is one block.
    """

    def compared(parts: list[tuple[np.ndarray, Members]]) -> pa.RecordBatch | None:
        role = np.concatenate([r for r, _ in parts])
        m = Members(*(np.concatenate([getattr(p, f) for _, p in parts]) for f in ("node", "size", "component", "apart", "marks")))
        asked, others = m.where((role != 0) & m.apart), m.where(role != 1)
        found = list(could_link(asked, others, c)) if len(asked.node) and len(others.node) else []
        one, two = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        if len(one):
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        held: list[tuple[np.ndarray, Members]] = []
        current = None
        for b in batches:
            if not b.num_rows:
                continue
            code, i, j = (b.column(k).to_numpy() for k in range(3))
            role = pyarrow.compute.fill_null(b.column(3).cast(pa.int8()), 2).to_numpy()
            node, size, component = (b.column(k).to_numpy() for k in (4, 5, 6))
            marks = b.column(8).flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
            m = Members(node, size, component, b.column(7).to_numpy(zero_copy_only=False), marks)
            new = np.flatnonzero((np.diff(code) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for first, end in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                name = (code[first], i[first], j[first])
                if name != current:
                    if held and (out := compared(held)):
                        yield out
                    held.clear()
                    current = name
                held.append((role[first:end], m.where(np.s_[first:end])))
        if held and (out := compared(held)):
            yield out

    return run


def rarest_shared(nodes: DataFrame, c: JoinConfig) -> DataFrame:
    """(code, node, size, component, sketch): the shingles by which documents (node, size, component, words, sketch) can be similar.

    Of two similar sets each has all but a quarter of its shingles from the other, so in one
    order for all they share one of the first quarter and one more. The order is by how many
    of these documents have a shingle, and those that only one has lead nowhere: pages of
    one template with more than a quarter of their own never meet, however many they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        for batch in batches:
            sets = [shingles(w.split(), c).view(np.int64) for w in batch.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "codes"])

    nodes = materialize(nodes, "jaccard-open-nodes")
    each = nodes.select("node", "words").mapInArrow(run, "node bigint, codes array<bigint>").select("node", F.explode("codes").alias("code"))
    each = materialize(each, "jaccard-open-shingles")
    often = materialize(each.groupBy("code").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-open-counts")
    held = each.join(often, "code").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "code"))).alias("codes"))  # of one document
    first = F.col("size") - F.ceil(F.col("size") * c.percent / 100) + 1
    own = F.col("size") - F.size("codes")  # that no other has come first
    few = nodes.join(held, "node").withColumn("codes", F.slice("codes", 1, F.greatest(first - own, F.lit(0)).cast("int")))
    return few.select(F.explode("codes.code").alias("code"), "node", "size", "component", "sketch")


def across(members: DataFrame, c: JoinConfig) -> DataFrame:
    """(a, b): pairs that may be links, of documents with a subset in common and in different components.

    ``members`` has (code, node, size, component, sketch). Documents of a subset's largest
    component are only compared with those of the others. Both sides are cut into blocks
    by hash, and a task compares one block with another, so however many share a subset,
    it holds some thousand of them, and only pairs that may be links are ever rows.
    """
    by = members.groupBy("code", "component").agg(F.count("*").alias("n"))
    stat = by.groupBy("code").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("components"))
    stat = stat.where("components > 1").select(
        "code",
        F.col("top.component").alias("largest"),
        F.ceil(F.col("n") / c.open_block).cast("int").alias("n_b"),
        F.ceil((F.col("n") - F.col("top.n")) / c.open_block).cast("int").alias("n_a"),
    )
    # Written, so that both sides of the join come from exchanges and a hot subset can be split.
    rows = members.join(materialize(stat, "jaccard-open-stat"), "code").withColumn("apart", F.col("component") != F.col("largest"))
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    copy = lambda i, j, asked: F.struct(i.alias("i"), j.alias("j"), F.lit(asked).cast("boolean").alias("asked"))
    asked = F.transform(all_of("n_b"), lambda j: copy(at("n_a"), j, True))
    other = F.transform(all_of("n_a"), lambda i: copy(i, at("n_b"), False))
    sent = F.when(F.col("n_b") == 1, F.array(copy(F.lit(0), F.lit(0), None))).when(F.col("apart"), F.concat(asked, other)).otherwise(other)
    each = rows.select("code", F.explode(sent).alias("to"), "node", "size", "component", "apart", "sketch")
    each = each.select("code", "to.i", "to.j", "to.asked", "node", "size", "component", "apart", "sketch")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since little data can be much work
    return each.repartition(n, "code", "i", "j").sortWithinPartitions("code", "i", "j").mapInArrow(compare_blocks(c), "a bigint, b bigint")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", c: JoinConfig = JoinConfig()) -> DataFrame:
    """(key, n_shingles, component_id) for each row: the smallest key among those linked with it, directly or not.

    The key is a whole number that names a document; rows that repeat it and the text get
    equal results, and rows that repeat it with another text are documents of their own,
    whose components go by the key's. Null keys are linked with nothing and have a null
    component. Documents without words have no shingles and are linked with nothing. n_shingles counts distinct
    64-bit fingerprints; links are found by them and judged by words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if (ids := own_ids(docs, key, text)) is not None:
        own = similar_groups(with_ids(docs, key, text, ids), key, text, c).select(F.col(key).alias("_id"), "n_shingles", F.col("component_id").alias("_first"))
        names, firsts = ids.select(F.col("id").alias("_id"), F.col("key").alias(key)), ids.select(F.col("id").alias("_first"), F.col("key").alias("component_id"))
        return own.join(names, "_id", "left").join(firsts, "_first", "left").select(key, "n_shingles", "component_id")
    n_groups = groups_for(docs, text, ENTRY_BYTES, c.group_bytes, c.groups_per_partition)
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    while True:
        sent = materialize(
            texts.mapInArrow(send_subsets(n_groups, c), ", ".join(f"{n} {'int' if t == pa.int32() else 'binary' if t == pa.binary() else 'bigint'}" for n, t in SENT)),
            "jaccard-subsets",
        )
        sizes = sent.where("bucket is null").select("key", "size", "n_own", "n_next", "first")
        if sizes.where("n_own < 0 or n_next < 0").isEmpty():
            break
        c = replace(c, extra_segments=c.extra_segments * 2)
    counted = (
        sent.where("bucket is not null")
        .select("bucket", "codes", "keys")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(count_subsets, "key bigint, codes array<bigint>")
        .groupBy("key")
        .agg(F.flatten(F.collect_list("codes")).alias("codes"))  # of one document
    )
    firsts = sizes.where("key = first").dropDuplicates(["key"])
    posted = firsts.join(counted, "key").select("key", "size", "n_own", "n_next", "codes")
    posted = materialize(posted.mapInArrow(first_subsets(c), "code bigint, key bigint, size bigint"), "jaccard-posted")
    # Each with the first of those that share a subset. Written, so a hot subset can be split.
    leads = materialize(posted.groupBy("code").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").select("code", "a"), "jaccard-leads")
    shared = materialize(posted.join(leads, "code").select("code", "a", F.col("key").alias("b"), "size"), "jaccard-shared")
    involved = shared.select(F.col("b").alias("key")).distinct()
    # Each key once before it is written, so that joins read it from an exchange and a hot lead can be split.
    sets = materialize(set_table(texts.join(involved, "key"), c).dropDuplicates(["key"]), "jaccard-sets")
    pairs = materialize(shared.where("a <> b").select("a", "b").distinct(), "jaccard-pairs")
    judged = materialize(verified(pairs, sets, c), "jaccard-judged")
    links = judged.where("linked").select("a", "b").union(sizes.where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")))
    groups = connected(links)
    failed = judged.where("not linked").select("a", "b")
    if not failed.isEmpty():
        groups = materialize(groups, "jaccard-groups")
        # All that have a subset of a failed pair, with the component they are in so far, by their rarest shingles.
        open_codes = shared.join(failed, ["a", "b"], "left_semi").select("code").distinct()
        nodes = shared.join(open_codes, "code").select(F.col("b").alias("node"), "size").distinct()
        nodes = nodes.join(groups, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"))
        members = materialize(rarest_shared(nodes.join(sets.withColumnRenamed("key", "node"), "node"), c), "jaccard-open")
        more = materialize(across(members, c).distinct().join(failed, ["a", "b"], "left_anti"), "jaccard-pairs-2")
        again = materialize(verified(more, sets, c).where("linked").select("a", "b"), "jaccard-judged-2")
        groups = connected(again.union(groups.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    return (
        sizes.join(groups.dropDuplicates(["node"]).withColumnRenamed("node", "key"), "key", "left")
        .select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
    )
