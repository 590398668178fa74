"""SentencePiece encoding and decoding by a forward pass over a trie of marked words.

A text is marked as the model does it (a leading space, spaces as U+2581) and cut into
units where no piece can cross: before each run of marks that follows another character,
and around line ends. The distinct units of a batch are sorted, so that a unit follows
those it shares a prefix with, and walked depth first: the forward states of a common
prefix are computed once and kept on a stack, and a unit only adds its own last letters.

* For a unigram model the state of a prefix is its best score and the piece that ends it
  (Viterbi).
* For a byte-pair model a path is good if merging leaves every two neighbours on it as
  they are; exactly one piece can end a prefix then, so scores are 0 or minus infinity and
  the state is that piece. The result is that of the model's own merging.

Characters that are no piece become bytes, as the model's byte fallback has it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import heavy, small_batches

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the file format
UNIGRAM, BPE = 1, 2
CACHED_UNITS = 250_000  # some 100 MB; where other work shares the worker, give less
KNOWN_PAIRS = 200_000  # of neighbours; some 30 MB


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model file: pieces, scores and types by id."""

    kind: int
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    name: str

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        unknown = self.types.index(UNKNOWN)
        return [at.get(f"<0x{b:02X}>", unknown) for b in range(256)]

    @cached_property
    def bytes_of(self) -> list[bytes]:
        """The bytes an id stands for. Control pieces stand for none."""
        special = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        return [special.get(t, lambda p: p.replace(MARK, " ").encode())(p) for p, t in zip(self.pieces, self.types)]


def load_model(path: str) -> PieceModel:
    """Read a model file, on the driver. Only models without a normalizing table are taken."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        data = f.read()
    m = sentencepiece_model_pb2.ModelProto.FromString(data)
    spec = m.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("a model whose normalizer changes texts is not supported")
    if m.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models are supported")
    if any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in m.pieces if p.type == NORMAL):
        raise ValueError("a piece crosses the units")
    p = m.pieces
    return PieceModel(
        m.trainer_spec.model_type, tuple(x.piece for x in p), tuple(x.score for x in p), tuple(x.type for x in p), hashlib.sha1(data).hexdigest()
    )


class Encoder:
    def __init__(self, m: PieceModel, cached_units: int = CACHED_UNITS) -> None:
        self.m, self.cached_units = m, cached_units
        # Units to their ids, 4 bytes each: those seen lately, and those seen before these.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pair: dict[tuple[str, str], bool] = {}
        self.packed_piece = {p: np.int32(i).tobytes() for p, i in m.ids.items()}

    # byte-pair models

    def merged(self, text: str) -> list[str]:
        """Pieces of a text by merging: the best-scored piece first, from the left. n log n steps for n letters."""
        ids, scores = self.m.ids, self.m.scores
        s: list[str] = list(text)
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := ids.get(s[i] + s[j])) is not None:
                heapq.heappush(todo, (-scores[k], i, s[i] + s[j]))

        for i in range(n - 1):
            offer(i)
        while todo:
            _, i, piece = heapq.heappop(todo)
            if not s[i] or after[i] >= n or s[i] + s[after[i]] != piece:
                continue  # one of the two has been merged since
            j = after[i]
            s[i], s[j], after[i] = piece, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in s if x]

    def stays(self, a: str, b: str) -> bool:
        """Whether merging leaves two neighbours as they are."""
        got = self.pair.get((a, b))
        if got is None:
            if len(self.pair) > KNOWN_PAIRS:
                self.pair.clear()
            got = self.pair[a, b] = self.merged(a + b) == [a, b]
        return got

    @cached_property
    def whole(self) -> set[str]:
        """Pieces that merging gives for their own text."""
        return {p for p in self.m.ids if self.merged(p) == [p]}

    def step_bpe(self, word: str, end: int, states: list, starts: list[int]) -> tuple | None:
        """(start, piece) of the piece that ends word[:end]: longer ones first. None where merging has to say."""
        whole, pair = self.whole, self.pair
        for start in starts:
            piece = word[start:end]
            if piece in whole or (start == end - 1 and piece not in self.m.ids):
                if not start:
                    return 0, piece
                before = states[start]
                if before is not None:
                    good = pair.get((before[1], piece))
                    if self.stays(before[1], piece) if good is None else good:
                        return start, piece
        return None

    # unigram models

    def step_unigram(self, word: str, end: int, states: list, starts: list[int]) -> tuple:
        """(start, piece, score) of the best path to word[:end]; the longer piece on a tie."""
        ids, scores = self.m.ids, self.m.scores
        best = None
        for start in starts:
            piece = word[start:end]
            k = ids.get(piece)
            own = scores[k] if k is not None else self.unknown_score if start == end - 1 else None
            if own is not None:
                total = own + (states[start][2] if start else 0.0)
                if best is None or total > best[2]:
                    best = (start, piece, total)
        return best

    @cached_property
    def beginnings(self) -> set[str]:
        """All that a piece begins with."""
        return {p[:k] for p in self.m.ids for k in range(1, len(p) + 1)}

    @cached_property
    def unknown_score(self) -> float:
        return min((s for s, t in zip(self.m.scores, self.m.types) if t == NORMAL), default=0.0) - 10.0

    # both

    def encode_units(self, units: list[str]) -> None:
        """Walk sorted units as a trie; states[i] is the forward state of the current word's first i letters.

        open_[i] has the places from where these letters go on as a piece, or could yet.
        """
        step = self.step_bpe if self.m.kind == BPE else self.step_unigram
        beginnings = self.beginnings
        states: list = [(0, "", 0.0)]
        open_: list[list[int]] = [[]]
        last = ""
        for word in units:
            same = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], open_[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                starts = [i for i in open_[-1] if word[i:end] in beginnings]
                starts.append(end - 1)
                open_.append(starts)
                states.append(step(word, end, states, starts))
            pieces, end = [], len(word)
            while end and states[end] is not None:
                pieces.append(states[end][1])
                end = states[end][0]
            self.known[word] = self.packed(self.merged(word) if end else pieces[::-1])
            last = word

    def packed(self, pieces: list[str]) -> bytes:
        ids = self.packed_piece
        try:
            return b"".join([ids[p] for p in pieces])
        except KeyError:  # bytes for what is no piece
            return b"".join([ids[p] if p in ids else np.array([self.m.byte_ids[x] for x in p.encode("utf-8", "replace")], np.int32).tobytes() for p in pieces])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, 4 bytes each."""
        cut = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > self.cached_units:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = []
        for u in set().union(*cut).difference(known):
            if u in before:
                known[u] = before[u]
            else:
                new.append(u)
        self.encode_units(sorted(new))
        return [b"".join(map(known.__getitem__, units)) for units in cut]


def decode_ids(ids: np.ndarray, m: PieceModel) -> str:
    """The text of ids; the leading space that encoding puts there is taken off. Broken UTF-8 is replaced."""
    data = b"".join(map(m.bytes_of.__getitem__, ids.tolist()))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def round_trips(docs: DataFrame, m: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_ids, ids_sha256, round_trip): every text encoded, and decoded again from the packed ids.

    ids_sha256 is that of the ids as 4 bytes each, the lowest first. For where the ids
    themselves aren't wanted; encode_pieces() and decode_pieces() give columns. A text with
    the mark character itself doesn't come back as it was, as the mark stands for a space.
    """
    small_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(packed)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = part.column(1).to_pylist()
                rows = [
                    (len(x) // 4, hashlib.sha256(x).hexdigest(), decode_ids(np.frombuffer(x, np.int32), encoder.m) == (t or ""))
                    for t, x in zip(texts, encoder.encode(texts))
                ]
                cols = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, "n_ids", "ids_sha256", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_ids bigint, ids_sha256 string, round_trip boolean")


def _encoder(packed, cached_units: int = CACHED_UNITS) -> Encoder:
    return heavy(("pieces", packed.value.name, cached_units), lambda: Encoder(packed.value, cached_units))


def encode_pieces(docs: DataFrame, m: PieceModel, text: str = "text", ids: str = "ids", cached_units: int = CACHED_UNITS) -> DataFrame:
    """All columns of ``docs`` and ``ids``, an array of whole numbers; empty for null and empty texts."""
    small_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(m)  # as large as the model file
    docs = docs.drop(ids)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(packed, cached_units)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = encoder.encode(part.column(at).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found])))
                values = pa.array(np.frombuffer(b"".join(found), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{ids}` array<int>"])
    return docs.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, m: PieceModel, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text of the ids; null for null ids."""
    packed = rows.sparkSession.sparkContext.broadcast(m)
    rows = rows.drop(decoded)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(packed).m
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = [decode_ids(x.values.to_numpy(zero_copy_only=False), model) if x.is_valid else None for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, decoded])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{decoded}` string"])
    return rows.mapInArrow(run, schema)
