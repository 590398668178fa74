"""Language by prediction by partial matching (PPM).

For each language a tree of byte contexts of 0 to 3 bytes is learned, with the count of
every byte that followed each context. The statistics are then frozen. The code length of
a byte under a language is that of escape method C: in the longest context that was seen,
a byte with count c costs -log2(c / (n + d)), where n is the sum and d the number of the
counts; an escape costs -log2(d / (n + d)) and leaves the next shorter context to code
the byte. Below the empty context all 256 bytes are equally likely. A text gets the
language that codes it in the fewest bits.

With frozen statistics a byte's code length depends on four bytes only. So the driver
compiles the trees, once, to costs by the codes of four bytes that were seen in any
language, with shorter tables for all others; that is some tens of bytes for each distinct
code, and holds for every byte value alike. Scoring looks codes up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import as_bytes, boxed, heavy, release_heavy, small_batches, unboxed

LETTER = r"\p{L}"
START = b"\0\0\0"  # stands before every text
PIECE = 400_000  # bytes that are looked at at once, whatever the lengths of texts
SCORES = "struct<lang_pred:string,score:double,bits_per_byte:double>"


@dataclass(frozen=True)
class PpmConfig:
    """What bounds the model: so many labelled documents of each language, at most, are learned from.

    They are those first by a seeded hash, and are learned whole. Every text is scored whole.
    """

    sample_docs: int = 1500
    seed: int = 17


@dataclass(frozen=True)
class Ppm:
    """Frozen counts: for each language the distinct codes of 4 bytes and how often each occurred."""

    langs: tuple[str, ...]
    codes: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]


def codes_of(data: np.ndarray) -> np.ndarray:
    """The code of each byte from the fourth on, with the three before it."""
    b = data.astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


class Tally:
    """Counts of codes, in memory that goes with the number of distinct ones."""

    def __init__(self) -> None:
        self.codes, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, text: bytes) -> None:
        data = START + text
        for at in range(3, len(data), PIECE):
            self.waiting.append(codes_of(np.frombuffer(data, np.uint8)[at - 3 : at + PIECE]))
            self.n_waiting += len(self.waiting[-1])
            if self.n_waiting > 4 * PIECE:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        new, n = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        both, slot = np.unique(np.concatenate([self.codes, new]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, slot, np.concatenate([self.counts, n]))
        self.codes, self.counts = both, total


def learn(docs: DataFrame, key: str, text: str, lang: str, c: PpmConfig = PpmConfig()) -> Ppm:
    """Counts of a bounded sample of rows with text and language.

    A row is in the sample if the seeded hash of its key, as a fraction, is below
    sample_docs over the number of the language's rows; nothing is shuffled to find it.
    Executors count; the driver gets a table of distinct codes, whose size is bounded by
    the sample. Rows with a null language or text teach nothing.
    """
    small_batches(docs.sparkSession)
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().collect()  # a row a language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], c.sample_docs / r["count"]).otherwise(share)
    at = F.pmod(F.xxhash64(F.col("key"), F.lit(c.seed)), F.lit(1 << 30)) / (1 << 30)
    sample = known.where(at < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        total: dict[str, Tally] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1)):
                total.setdefault(name, Tally()).add(as_bytes(t.as_py()))
        for name, tally in total.items():
            tally.settle()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(tally.codes)), pa.array(tally.codes.astype(np.int64)), pa.array(tally.counts)], ["lang", "code", "n"]
            )

    found = sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    found = found.sort_values(["lang", "code"])
    langs = tuple(sorted(found.lang.unique()))
    of = [found[found.lang == x] for x in langs]
    return Ppm(langs, tuple(f.code.to_numpy(np.uint32) for f in of), tuple(f.n.to_numpy(np.int64) for f in of))


def _sums(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, the sum of n for each and how many there are."""
    distinct, slot = np.unique(code, return_inverse=True)
    return distinct, np.bincount(slot, n, len(distinct)), np.bincount(slot, minlength=len(distinct)).astype(float)


def _slot(table: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    at = np.minimum(np.searchsorted(table, code), len(table) - 1)
    return at, table[at] == code


class Tree:
    """Costs in bits under one language, by the code of a byte with its context."""

    def __init__(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.code4 = codes
        self.context3, total, distinct = _sums(codes >> np.uint32(8), n)
        self.escape3 = np.log2(total + distinct) - np.log2(distinct)
        of = np.searchsorted(self.context3, codes >> np.uint32(8))
        self.seen3 = np.log2(total + distinct)[of] - np.log2(n)
        self.code3, n3, _ = _sums(codes & np.uint32(0xFFFFFF), n)
        self.seen2, self.escape2 = self._dense(self.code3, n3, 65536)
        code2, n2, _ = _sums(codes & np.uint32(0xFFFF), n)
        seen1, escape1 = self._dense(code2, n2, 256)
        code1, n1, _ = _sums(codes & np.uint32(0xFF), n)
        seen0, escape0 = self._dense(code1, n1, 1)
        cost0 = np.full(256, escape0[0] + 8)
        cost0[code1] = seen0
        self.cost1 = np.repeat(escape1, 256) + np.tile(cost0, 256)
        self.cost1[code2] = seen1

    @staticmethod
    def _dense(code: np.ndarray, n: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each code in its context, and of the escape from every context; none from one that was not seen."""
        context = (code >> np.uint32(8)).astype(np.int64)
        total, distinct = np.bincount(context, n, contexts), np.bincount(context, minlength=contexts).astype(float)
        whole = np.log2(np.maximum(total + distinct, 1))
        return whole[context] - np.log2(n), np.where(distinct > 0, whole - np.log2(np.maximum(distinct, 1)), 0.0)

    def cost2(self, code: np.ndarray) -> np.ndarray:
        """The cost of the last of three bytes, after the two before it."""
        at, seen = _slot(self.code3, code)
        out = self.escape2[code >> np.uint32(8)] + self.cost1[code & np.uint32(0xFFFF)]
        out[seen] = self.seen2[at[seen]]
        return out

    def escapes3(self, context: np.ndarray) -> np.ndarray:
        at, seen = _slot(self.context3, context)
        return np.where(seen, self.escape3[at], 0.0) if len(self.context3) else np.zeros(len(context))

    def cost3(self, code: np.ndarray) -> np.ndarray:
        at, seen = _slot(self.code4, code)
        out = self.escapes3(code >> np.uint32(8)) + self.cost2(code & np.uint32(0xFFFFFF))
        out[seen] = self.seen3[at[seen]]
        return out


@dataclass(frozen=True)
class Tables:
    """A model compiled for look-ups: a column for each language in every table of costs."""

    langs: tuple[str, ...]
    code4: np.ndarray
    cost4: np.ndarray
    code3: np.ndarray
    cost3: np.ndarray  # of the last byte after the two before it
    escape3: np.ndarray  # from the code as a context
    escape2: np.ndarray
    cost1: np.ndarray
    name: str = field(default="")

    @staticmethod
    def of(m: Ppm) -> Tables:
        trees = [Tree(c, n) for c, n in zip(m.codes, m.counts)]
        code4 = np.unique(np.concatenate(m.codes)) if trees else np.empty(0, np.uint32)
        code3 = np.unique(np.concatenate([code4 >> np.uint32(8), code4 & np.uint32(0xFFFFFF)]))
        stack = lambda cols, n: np.stack(cols, axis=1).astype(np.float32) if cols else np.empty((n, 0), np.float32)
        t = (
            code4, stack([x.cost3(code4) for x in trees], len(code4)),
            code3, stack([x.cost2(code3) for x in trees], len(code3)), stack([x.escapes3(code3) for x in trees], len(code3)),
            stack([x.escape2 for x in trees], 65536), stack([x.cost1 for x in trees], 65536),
        )
        digest = hashlib.sha1(repr(m.langs).encode())
        for a in t:
            digest.update(a.tobytes())
        return Tables(m.langs, *t, digest.hexdigest())

    @cached_property
    def hashed(self) -> tuple[np.ndarray, np.uint32, np.uint32]:
        """An open hash table of the places of code4 (-1 where free), half full at most."""
        bits = max(4, int(len(self.code4) * 2).bit_length())
        slots, shift, mask = np.full(1 << bits, -1, np.int32), np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        left = np.arange(len(self.code4), dtype=np.int32)
        at = self._home(self.code4, shift)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]  # of several the last one stays
            out = slots[at] != left
            left, at = left[out], (at[out] + np.uint32(1)) & mask
        return slots, shift, mask

    @staticmethod
    def _home(code: np.ndarray, shift: np.uint32) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (code * np.uint32(0x9E3779B1)) >> shift

    def places(self, code: np.ndarray) -> np.ndarray:
        """The place in code4 of each code, -1 where it is not there."""
        slots, shift, mask = self.hashed
        at = self._home(code, shift)
        out = slots[at]
        left = np.flatnonzero((out >= 0) & (self.code4[out] != code)) if len(self.code4) else np.empty(0, np.int64)
        at = at[left]
        while len(left):
            at = (at + np.uint32(1)) & mask
            found = slots[at]
            out[left] = found
            other = (found >= 0) & (self.code4[found] != code[left])
            left, at = left[other], at[other]
        return out

    def costs(self, code: np.ndarray) -> np.ndarray:
        at = self.places(code)
        out = self.cost4[at] if len(self.code4) else np.empty((len(code), len(self.langs)), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            c3 = code[new] & np.uint32(0xFFFFFF)
            cost = self.escape2[c3 >> np.uint32(8)] + self.cost1[c3 & np.uint32(0xFFFF)]
            i, seen = _slot(self.code3, c3)
            cost[seen] = self.cost3[i[seen]]
            i, seen = _slot(self.code3, code[new] >> np.uint32(8))
            cost[seen] += self.escape3[i[seen]]
            out[new] = cost
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        part: list[np.ndarray] = []
        owner: list[int] = []
        room = PIECE

        def done() -> None:
            sizes = np.array([len(p) - 3 for p in part])
            codes = codes_of(np.concatenate(part))
            starts = np.concatenate(([0], np.cumsum(sizes + 3)[:-1]))
            # Between two parts lie the three bytes that stand before the second; their codes count for nothing.
            edges = np.stack([starts, starts + sizes], axis=1).ravel()[: 2 * len(part) - 1]
            cost = np.add.reduceat(self.costs(codes), edges, axis=0, dtype=np.float64)[::2]
            np.add.at(out, owner, cost)
            part.clear(), owner.clear()

        for i, t in enumerate(texts):
            data = np.frombuffer(START + t, np.uint8)
            for at in range(3, len(data), PIECE):
                piece = data[at - 3 : at + PIECE]
                if part and room < len(piece):
                    done()
                    room = PIECE
                part.append(piece)
                owner.append(i)
                room -= len(piece)
        if part:
            done()
        return out


def predicted(tables: Tables, texts: list[bytes], letters: list[bool]) -> pa.StructArray:
    """(lang_pred, score, bits_per_byte) of each text."""
    lang, score, rate = [], [], []
    judged = [t if has and tables.langs else b"" for t, has in zip(texts, letters)]
    for t, row in zip(judged, tables.bits(judged)):
        if not t:
            lang.append("und"), score.append(0.0), rate.append(None)
            continue
        k = int(row.argmin())
        lang.append(tables.langs[k])
        score.append(1 / math.fsum(2.0 ** max(-1000.0, row[k] - x) for x in row))
        rate.append(float(row[k]) / len(t))
    return pa.StructArray.from_arrays(
        [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["lang_pred", "score", "bits_per_byte"]
    )


def language_of(spark: SparkSession, text: Column, model: Ppm) -> Column:
    """struct(lang_pred, score, bits_per_byte) of a text, as a column to add to any table.

    A text that is null or has no letter is ``und`` with score 0, and so is every text
    where nothing was learned. score is the predicted language's share of the likelihood
    of the text, languages being equally likely beforehand. Ties go to the first language
    in order. Only the text goes to Python; other columns stay where they are.
    """
    small_batches(spark)
    packed = spark.sparkContext.broadcast(Tables.of(model))  # bounded by the sample

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = heavy(("ppm", packed.value.name), lambda: packed.value)
        for t, has in batches:
            out = []
            for at in range(0, len(t), 500):
                out.append(predicted(tables, [as_bytes(x) for x in t.slice(at, 500).to_pylist()], has.slice(at, 500).to_pylist()))
            yield pa.concat_arrays(out) if out else predicted(tables, [], [])

    has_letter = F.coalesce(text.rlike(LETTER), F.lit(False))
    # Not to be moved or repeated by the optimizer: a filter on the prediction would score each text twice.
    return F.arrow_udf(run, SCORES).asNondeterministic()(text, has_letter)


def language_scores(docs: DataFrame, keep: list[str], text: str, model: Ppm) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and bits_per_byte of the predicted language (see language_of).

    Repeated rows give repeated results, an empty table an empty one. ``keep`` can't have
    the names of the results; rows with such columns can carry them in a struct.
    """
    if clash := {"lang_pred", "score", "bits_per_byte"}.intersection(keep):
        raise ValueError(f"these names are the results': {sorted(clash)}")
    rows = docs.select(boxed(docs.select(*keep)).alias("box"), language_of(docs.sparkSession, F.col(text), model).alias("found"))
    return rows.select(*unboxed(rows, "box"), "found.*")
