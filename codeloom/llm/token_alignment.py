"""Alignment of the tokens of two tokenizers by a dictionary of token groups.

Both tokenizers encode the same bytes. Offsets where tokens of both end cut a text into
groups, each some A ids over some B ids; every A token of a group is linked to every B
token of it. Most groups are seen again and again, so they are interned twice: by number
within a block (texts of bounded size that one task reads in a row), and corpus-wide, where
each distinct group gets one row. Links are expanded once per distinct group there and
multiplied by the number of documents; where a document holds a pair in several groups,
its further ones are subtracted. What a group is worth then goes back to the blocks by the
group's key, and from there to the documents by the numbers they were written with. So a
group that is in every document is one row a block, and no key is hot.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.byte_bpe import ByteBpe, tokenizer_of
from codeloom.llm.common import materialize, once, release_heavy, small_batches
from codeloom.llm.piece_tokenizer import MARK, UNIT, PieceModel, load_model
from codeloom.llm.piece_tokenizer import Encoder as PieceEncoder

# Texts are cut where no word or piece goes on: before each space if none is beside another, else before spaces
# and line ends that follow something else.
SPACED = regex.compile(r" (?=\s|$)")
CHUNK = regex.compile(r"\s*+\S++(?:[^\S \n]\s*+\S*+)*+|\s++")
BLOCK_GROUPS = 100_000  # distinct groups of a block
BLOCK_CHARS = 16 << 20  # and characters of its texts
KNOWN_UNITS = 60_000
NUMBERS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def chunks_of(text: str) -> list[str]:
    """The chunks of a space and the text."""
    if SPACED.search(text) or text[0].isspace():
        return CHUNK.findall(" " + text)
    return [" " + c for c in text.split(" ")]


class Pieces:
    """Ids of chunks by the library of piece models."""

    def __init__(self, m: PieceModel, data: bytes) -> None:
        self.m = m
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.own = PieceEncoder(m)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """The library puts a space before a text itself; chunks that don't begin with one are encoded unit by unit."""
        whole = [i for i, c in enumerate(chunks) if c[0] == " "]
        out: list[list[int]] = [[]] * len(chunks)
        for i, ids in zip(whole, self.library.encode([chunks[i][1:] for i in whole], num_threads=1)):
            out[i] = ids or self._units(chunks[i])  # a space alone
        for i, c in enumerate(chunks):
            if c[0] != " ":
                out[i] = self._units(c)
        return out

    def _units(self, chunk: str) -> list[int]:
        units = UNIT.findall(chunk.replace(" ", MARK))
        if len(self.own.known) > KNOWN_UNITS:
            self.own.known.clear()
        self.own.encode_units(sorted(set(units).difference(self.own.known)))
        return np.frombuffer(b"".join([self.own.known[u] for u in units]), np.int32).tolist()


class Block:
    """Groups and pairs of a block's texts by number, with what is known of its chunks."""

    def __init__(self, a: ByteBpe, b: Pieces) -> None:
        self.a, self.b = a, b
        self.chunks: dict[str, tuple[list[int], str] | None] = {}
        self.groups: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        self.names: list[str] = []
        self.pairs: dict[tuple[int, int], int] = {}
        self.pairs_of: list[list[int]] = []  # of each group, without repetition
        self.docs: np.ndarray = np.zeros(0, np.int64)  # that hold a group
        self.again: Counter[int] = Counter()  # further groups of a document that hold a pair
        self.chars = 0

    @property
    def full(self) -> bool:
        return len(self.groups) >= BLOCK_GROUPS or self.chars >= BLOCK_CHARS

    def learn(self, chunks: list[str]) -> None:
        """Align new chunks: all lie side by side, and groups end where tokens of both do. A chunk that B doesn't give back is None."""
        if not chunks:
            return
        pieces = self.b.encode(chunks)
        b_bytes = self.b.m.bytes_of
        data = [c.encode("utf-8", "replace") for c in chunks]
        good = [b"".join([b_bytes[i] for i in ids]) == d for ids, d in zip(pieces, data)]
        self.chunks.update({c: None for c, ok in zip(chunks, good) if not ok})
        chunks, pieces, data = ([x for x, ok in zip(xs, good) if ok] for xs in (chunks, pieces, data))
        if not chunks:
            return
        words, _ = self.a.words(chunks)
        distinct = list(set(words))
        ids = dict(zip(distinct, self.a.merge_many([w.encode("utf-8", "replace") for w in distinct])))
        a = np.frombuffer(b"".join(map(ids.__getitem__, words)), "<i4")
        b = np.fromiter(chain.from_iterable(pieces), np.int64)
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cut, a_cut, b_cut = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)  # no token is empty
        a, b, a_to, b_to = a.tolist(), b.tolist(), (a_cut + 1).tolist(), (b_cut + 1).tolist()
        numbers = [self.number((tuple(a[i:j]), tuple(b[k:m]))) for i, j, k, m in zip([0, *a_to], a_to, [0, *b_to], b_to)]
        ends = np.searchsorted(cut, np.cumsum([len(d) for d in data]), "right").tolist()
        names = self.names
        for chunk, i, j in zip(chunks, [0, *ends], ends):
            own = numbers[i:j]
            self.chunks[chunk] = own, names[own[0]] if j == i + 1 else ";".join([names[g] for g in own])

    @cached_property
    def a_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.a.vocab], np.int64)

    @cached_property
    def b_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.b.m.bytes_of], np.int64)

    def number(self, group: tuple[tuple[int, ...], tuple[int, ...]]) -> int:
        n = self.groups.get(group)
        if n is None:
            n = self.groups[group] = len(self.groups)
            self.names.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
            pairs = self.pairs
            self.pairs_of.append([pairs.setdefault(p, len(pairs)) for p in sorted({(x, y) for x in group[0] for y in group[1]})])
        return n

    def add(self, texts: list[str | None]) -> list[tuple]:
        """For each text: its four numbers, digest, distinct groups and how often it has each (4 bytes each)."""
        cut = [chunks_of(t) if t else [] for t in texts]
        self.chars += sum(len(t) for t in texts if t)
        self.learn(list(set().union(*cut).difference(self.chunks)))
        found = [[self.chunks[c] for c in chunks] for chunks in cut]
        found = [[] if None in x else x for x in found]
        digests = [hashlib.sha256(";".join([s for _, s in x]).encode()).hexdigest() if x else "" for x in found]
        places = [np.array([g for gs, _ in x for g in gs], np.int64) for x in found]
        n_groups = np.array([len(x) for x in places], np.int64)
        doc = np.repeat(np.arange(len(texts)), n_groups)
        size, pairs = max(1, len(self.groups)), max(1, len(self.pairs))
        each, times = np.unique(doc * size + (np.concatenate(places) if places else doc), return_counts=True)
        doc, group = each // size, each % size
        n_a = np.fromiter((len(a) for a, _ in self.groups), np.int64, len(self.groups))
        n_b = np.fromiter((len(b) for _, b in self.groups), np.int64, len(self.groups))
        sums = [np.bincount(doc, x, len(texts)).astype(np.int64) for x in (n_a[group] * times, n_b[group] * times, n_a[group] * n_b[group] * times)] if len(group) else [n_groups] * 3
        self.docs = np.concatenate((self.docs, np.zeros(len(self.groups) - len(self.docs), np.int64))) + np.bincount(group, minlength=len(self.groups))
        width = np.fromiter(map(len, self.pairs_of), np.int64, len(self.pairs_of))
        flat = np.fromiter((p for x in self.pairs_of for p in x), np.int64, int(width.sum()))
        start = np.cumsum(width) - width
        held = width[group]
        at = np.repeat(start[group] - np.cumsum(held) + held, held) + np.arange(held.sum())
        both, n = np.unique(np.repeat(doc, held) * pairs + flat[at], return_counts=True)
        for p, more in zip((both[n > 1] % pairs).tolist(), (n[n > 1] - 1).tolist()):
            self.again[p] += more
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [
            (int(sums[0][i]), int(sums[1][i]), int(n_groups[i]), int(sums[2][i]), digests[i], group[x:y].astype(np.int32).tobytes(), times[x:y].astype(np.int32).tobytes())
            for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))
        ]


def _rows(docs: DataFrame, a: ByteBpe, b: tuple[PieceModel, bytes], key: str, text: str) -> DataFrame:
    """Three kinds of rows: documents with their block's numbers of groups, the block's groups, and pairs held again."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    a_packed, b_packed = context.broadcast(a), context.broadcast(b)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"kind int, block bigint, key {kind}, {NUMBERS}, digest string, groups binary, times binary, number int, a array<int>, b array<int>, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        ints = pa.list_(pa.int32())
        types = {"kind": pa.int32(), "block": pa.int64(), "key": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "digest": pa.string(), "groups": pa.binary(), "times": pa.binary(), "number": pa.int32(), "a": ints, "b": ints, "n": pa.int64()}

        def table(size: int, **columns) -> pa.RecordBatch:
            arrays = [columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns.get(k) or [None] * size, t) for k, t in types.items()]
            return pa.RecordBatch.from_arrays(arrays, list(types))

        encoder = once(("alignment", b_packed.value[0].name), lambda: Pieces(*b_packed.value))
        first = TaskContext.get().partitionId() << 32
        block, made = Block(tokenizer_of(a_packed), encoder), 0

        def ended() -> Iterator[pa.RecordBatch]:
            groups = list(block.groups)
            for at in range(0, len(groups), 20_000):
                part = groups[at : at + 20_000]
                yield table(len(part), kind=[1] * len(part), block=[first + made] * len(part), number=list(range(at, at + len(part))), a=[list(x) for x, _ in part], b=[list(x) for _, x in part], n=block.docs[at : at + len(part)].tolist())
            pairs = list(block.pairs)
            again = [(pairs[p], n) for p, n in block.again.items()]
            if again:
                yield table(len(again), kind=[2] * len(again), block=[first + made] * len(again), a=[[x] for (x, _), _ in again], b=[[y] for (_, y), _ in again], n=[n for _, n in again])

        for batch in batches:
            types["key"] = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols = list(zip(*block.add(part.column(1).to_pylist())))
                named = dict(zip(("n_a", "n_b", "n_groups", "n_links", "digest", "groups", "times"), map(list, cols)))
                yield table(part.num_rows, kind=[0] * part.num_rows, block=[first + made] * part.num_rows, key=part.column(0), **named)
                if block.full:
                    yield from ended()
                    block, made = Block(tokenizer_of(a_packed), encoder), made + 1
        if block.chars:
            yield from ended()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _links(groups: DataFrame) -> DataFrame:
    """(gid, a, b, times, docs) of each group: its links, equal ones as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                rows = batch.slice(at, 5000).to_pylist()
                out = [
                    (r["gid"], x, y, n * m, r["docs"])
                    for r in rows
                    for b in [Counter(r["b"]).items()]
                    for x, n in Counter(r["a"]).items()
                    for y, m in b
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["gid", "a", "b", "times", "docs"])

    return groups.select("gid", "a", "b", "docs").mapInArrow(run, "gid bigint, a int, b int, times bigint, docs bigint")


def pair_counts(links: DataFrame, again: DataFrame) -> DataFrame:
    """(a, b, n): in how many documents an A id and a B id are linked."""
    parts = links.select("a", "b", F.col("docs").alias("n")).unionByName(again.select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b"), (-F.col("n")).alias("n")))
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def load_pieces(path: str) -> tuple[PieceModel, bytes]:
    """A piece model as this package and as the library reads it."""
    with open(path, "rb") as f:
        return load_model(path), f.read()


def align_tokens(docs: DataFrame, a: ByteBpe, b: tuple[PieceModel, bytes], key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' rows, and the table (a, b, n) of linked ids with their numbers of documents.

    A document's row: key, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A
    id's commonest, ties included), count_sum (the pairs' numbers of documents over all
    links) and groups_sha256. Null and empty texts and those that a tokenizer doesn't give
    back have no tokens: zeros and an empty digest. Rows that repeat a key are documents of
    their own, and further columns don't matter.
    """
    rows = materialize(_rows(docs, a, b, key, text), "alignment-rows")
    inside = rows.where("kind = 1 and n > 0").select("block", "number", "a", "b", "n")
    distinct = inside.groupBy("a", "b").agg(F.sum("n").alias("docs")).withColumn("gid", F.monotonically_increasing_id())
    distinct = materialize(distinct, "alignment-groups")
    links = materialize(_links(distinct), "alignment-links")
    counts = materialize(pair_counts(links, rows.where("kind = 2").select("a", "b", "n")), "alignment-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = links.select("gid", "a", "b", "times").join(counts, ["a", "b"]).join(F.broadcast(most), "a")  # a row for each A id, no more
    worth = judged.groupBy("gid").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    worth = distinct.select("gid", "a", "b").join(worth, "gid").select("a", "b", "best", "total")
    back = inside.select("block", "number", "a", "b").join(worth, ["a", "b"]).select(F.col("block").alias("of"), "number", "best", "total")
    kind = docs.schema[key].dataType.simpleString()
    held = rows.where("kind = 0").select("block", "key", "n_a", "n_b", "n_groups", "n_links", "digest", "groups", "times")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        best, summed = np.zeros((2, number.max(initial=-1) + 1), np.int64)
        best[number], summed[number] = right.column("best").to_numpy(), right.column("total").to_numpy()
        out = []
        for groups, times in zip(left.column("groups").to_pylist(), left.column("times").to_pylist()):
            at, n = np.frombuffer(groups, np.int32), np.frombuffer(times, np.int32)
            out.append((int(best[at] @ n), int(summed[at] @ n)))
        found = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 2
        columns = {"key": left.column("key")} | {k: left.column(k) for k in ("n_a", "n_b", "n_groups", "n_links")}
        return pa.table(columns | {"n_best": found[0], "count_sum": found[1], "groups_sha256": left.column("digest")})

    done = held.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(total, f"key {kind}, {NUMBERS}, n_best bigint, count_sum bigint, groups_sha256 string")
    return done.withColumnRenamed("key", key), counts
