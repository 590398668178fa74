"""Byte-pair encoding and decoding through a minimal acyclic transducer of frequent words.

Texts are cut at special tokens and then into words by the tokenizer's pattern. Words are
counted over the whole corpus, and the most frequent (``LexiconConfig.words``, a bound and
no cut: all others are merged) are compiled on the driver into an acyclic automaton whose
equal suffixes are one state. Each arc has a number; the numbers along a word's path add up
to the word's place in the lexicon, where its ids lie. The automaton is a few flat arrays
in one file in the shared folder; Spark hands the file to every executor, new ones
included, and all Python workers of a machine map the same pages.

Texts are first cut before single spaces, where words always begin, so that the pattern is
run over each distinct chunk of a batch once. The distinct words walk the automaton side by
side, a byte a step. Words that are not in it are merged exactly, lowest rank first, from
the left, all words of a length at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import once, release_heavy, small_batches
from codeloom.operators.shared import shared_dir

# The pattern of byte-level tokenizers, over texts whose characters beyond ASCII are folded to one of their class.
PATTERN = rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9\xff]+|\s+(?![^\s\xff])|\s+|\xff"
END = 0xFF  # between texts that are cut in one go
FOLDS = {r"\p{L}": b"a", r"\p{N}": b"1", r"\s": b"\n"}
OTHER = b"!"
PLANES = 0x40000  # from here on there are no letters, digits or spaces
KNOWN_CHUNKS = 200_000  # that a worker remembers; some 30 MB
COUNTED_CHUNKS = 200_000  # distinct chunks after which a task hands its counts on
SHORT = 40  # bytes of a word that is merged beside others of its length
SPACED = re.compile(r" (?=\s|$)")  # spaces where no cut may be
CHUNK = re.compile(r"(?= \S)")


@dataclass(frozen=True)
class LexiconConfig:
    """``words`` bounds the lexicon (some 10 bytes a word); ``longest`` the bytes of a word in it."""

    words: int = 65_536
    longest: int = 64


@dataclass(frozen=True)
class ByteBpe:
    """What encoding needs of a tokenizer's file."""

    vocab: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...]
    specials: tuple[tuple[str, int], ...]
    folds: bytes  # what stands for each character of the first planes in the pattern
    name: str

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        return {(a, b): rank for rank, (a, b, _) in enumerate(self.merges)}

    @cached_property
    def made(self) -> list[int]:
        """What the merge of a rank makes."""
        return [c for _, _, c in self.merges]

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {v: i for i, v in enumerate(self.vocab) if len(v) == 1}
        return [at[bytes([b])] for b in range(256)]

    @cached_property
    def cutter(self) -> tuple[re.Pattern, np.ndarray]:
        return re.compile(PATTERN), np.frombuffer(self.folds, np.uint8)

    @cached_property
    def special_ids(self) -> dict[str, int]:
        return dict(self.specials)

    @cached_property
    def cut(self) -> re.Pattern | None:
        """Special tokens, longer ones first where two begin at one place."""
        names = sorted(self.special_ids, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def words(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The words of texts without special tokens in one list, and where each text's words end in it."""
        pattern, folds = self.cutter
        joined = "\n".join([*texts, ""])
        folded = folds[np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), PLANES)]
        folded[np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1] = END
        size = np.fromiter(map(len, pattern.findall(folded.tobytes())), np.int64)  # words lie side by side
        end = np.cumsum(size)
        last = folded[end - 1] == END
        kept = ~last
        words = [joined[i:j] for i, j in zip((end - size)[kept].tolist(), end[kept].tolist())]
        return words, np.cumsum(kept)[last].tolist()

    def parts(self, text: str) -> list[str]:
        """Chunks, and special tokens between them."""
        if self.cut is None or not any(s in text for s in self.special_ids):
            return chunks_of(text)
        return [w for i, x in enumerate(self.cut.split(text)) for w in ([x] if i % 2 else chunks_of(x))]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank first, from the left. n log n steps for n bytes."""
        s = [self.byte_ids[b] for b in word]
        pairs, made = self.pairs, self.made
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := pairs.get((s[i], s[j]))) is not None:
                heapq.heappush(todo, (rank, i, s[i], s[j]))

        for i in range(n - 1):
            offer(i)
        while todo:
            rank, i, a, b = heapq.heappop(todo)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue  # one of the two has been merged since
            s[i], s[j], after[i] = made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in s if x >= 0]

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs as sorted numbers, their ranks, what each rank makes, and the ids of bytes."""
        m = np.array(self.merges, np.int64).reshape(-1, 3)
        keys = m[:, 0] << 32 | m[:, 1]
        order = np.argsort(keys)
        return keys[order], order.astype(np.int32), m[:, 2].astype(np.int32), np.array(self.byte_ids, np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; that of none is the number of merges."""
        keys, ranks, made, _ = self.tables
        if not len(keys):
            return np.zeros(a.shape, np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], len(made)).astype(np.int32)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """merge() of each word, as packed ids. Words of a length are merged side by side, a pair a step."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= SHORT:
                by_length.setdefault(len(w), []).append(i)
            else:
                out[i] = np.array(self.merge(w), "<u4").tobytes()
        for length, rows in by_length.items():
            if length:
                letters = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(-1, length)
                for i, x in zip(rows, self._merged(self.tables[3][letters])):
                    out[i] = x
        return out

    def _merged(self, s: np.ndarray) -> list[bytes]:
        """Merge rows of ids of one length. A merged pair moves what follows one to the left; -1 fills up."""
        made = self.tables[2]
        none, width = len(made), s.shape[1]
        left = np.full(len(s), width)
        ranks = self.ranks(s[:, :-1], s[:, 1:])
        alive = np.arange(len(s))
        while width > 1 and len(alive):
            now = ranks[alive]
            at = now.argmin(1)
            rank = now[np.arange(len(alive)), at]
            good = rank < none
            alive, at, rank = alive[good], at[good], rank[good]
            if not len(alive):
                break
            left[alive] -= 1
            row = np.arange(len(alive))
            place = np.arange(width)
            moved = np.minimum(place + (place > at[:, None]), width - 1)
            rows = np.take_along_axis(s[alive], moved, 1)
            rows[:, -1] = -1
            rows[row, at] = made[rank]
            s[alive] = rows
            near = np.take_along_axis(ranks[alive], np.minimum(moved[:, :-1], width - 2), 1)
            near[:, -1] = none
            for d in (0, -1):  # the new id with what follows, and with what is before it
                i = at + d
                ok = (i >= 0) & (i + 1 < left[alive])
                r, i = row[ok], i[ok]
                near[r, i] = self.ranks(rows[r, i], rows[r, i + 1])
            ended = at + 1 >= left[alive]
            near[row[ended & (at < width - 1)], at[ended & (at < width - 1)]] = none
            ranks[alive] = near
        flat, ends = s[s >= 0].astype("<u4").tobytes(), np.cumsum(left).tolist()
        return [flat[4 * x : 4 * y] for x, y in zip([0, *ends], ends)]


def chunks_of(text: str) -> list[str]:
    """The text cut before spaces that begin a word: every space, as a rule."""
    if SPACED.search(text):
        return [c for c in CHUNK.split(text) if c]
    first, *rest = text.split(" ")
    rest = [" " + c for c in rest]
    return [first, *rest] if first else rest


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@cache
def _folds() -> bytes:
    """What stands for each character: itself in ASCII, else one of its class as the library has it, whatever Unicode version that is of."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(128, PLANES) if not 0xD800 <= c < 0xE000)
    folds = bytearray(range(128)) + OTHER * (PLANES + 1 - 128)
    for kind, stands in FOLDS.items():
        for run, _ in pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(every):
            for c in run:
                folds[ord(c)] = stands[0]
    return bytes(folds)


def load_byte_bpe(path: str) -> ByteBpe:
    """Read a tokenizer's file, on the driver. Only plain byte-level tokenizers are taken."""
    with open(path, "rb") as f:
        data = f.read()
    d = json.loads(data)
    m, cutter = d["model"], d["pre_tokenizer"] or {}
    if m["type"] != "BPE" or d["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError("only byte-level tokenizers without a normalizer are supported")
    if any(m.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError("a model with dropout, affixes or whole words is not supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in d["added_tokens"]):
        raise ValueError("added tokens must be special and plain")
    letters, ids = _byte_letters(), m["vocab"]
    special = {t["content"]: t["id"] for t in d["added_tokens"]}
    vocab = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in ids.items():
        vocab[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        vocab[i] = token.encode()
    pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in m["merges"]]
    merges = tuple((ids[a], ids[b], ids[a + b]) for a, b in pairs)
    return ByteBpe(tuple(vocab), merges, tuple(special.items()), _folds(), hashlib.sha1(data).hexdigest())


def tokenizer_of(packed) -> ByteBpe:
    """A broadcast tokenizer, with its tables made once a worker."""
    return once(("byte-bpe", packed.value.name), lambda: packed.value)


class Automaton:
    """Flat arrays: arcs sorted by (state, byte), what each leads to and adds, which states end a word, and the ids of each word."""

    PARTS = (("arcs", np.int64), ("targets", np.int32), ("adds", np.int32), ("final", np.uint8), ("starts", np.int64), ("ids", np.uint32))

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.__dict__.update(parts)

    @classmethod
    def compiled(cls, words: dict[bytes, list[int]]) -> Automaton:
        """The minimal automaton of the words, which are added in order: what lies below the last word's own end is settled."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        settled: list[tuple[bool, dict[int, int], int]] = []  # whether it ends a word, its arcs, how many words lie in it
        open_: list[list] = [[False, {}]]  # the states of the last word's path
        last = b""

        def settle(depth: int) -> None:
            while len(open_) > depth + 1:
                ends, arcs = open_.pop()
                key = (ends, tuple(arcs.items()))
                if key not in register:
                    register[key] = len(settled)
                    settled.append((ends, arcs, ends + sum(settled[t][2] for t in arcs.values())))
                open_[-1][1][last[len(open_) - 1]] = register[key]

        for word in order:
            same = next((i for i, (x, y) in enumerate(zip(word, last)) if x != y), min(len(word), len(last)))
            settle(same)
            open_ += [[False, {}] for _ in word[same:]]
            open_[-1][0], last = True, word
        settle(0)
        ends, arcs = open_[0]
        settled.append((ends, arcs, 0))
        n = len(settled)
        number = {s: n - 1 - s for s in range(n)}  # the first state is 0
        keys, targets, adds, final = [], [], [], np.zeros(n, np.uint8)
        for s in range(n - 1, -1, -1):
            ends, arcs, _ = settled[s]
            final[number[s]] = ends
            before = int(ends)
            for byte, t in arcs.items():
                keys.append(number[s] << 8 | byte)
                targets.append(number[t])
                adds.append(before)
                before += settled[t][2]
        found = [words[w] for w in order]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        values = [keys, targets, adds, final, starts, [i for x in found for i in x]]
        return cls({k: np.asarray(v, kind) for (k, kind), v in zip(cls.PARTS, values)})

    def written(self) -> bytes:
        sizes = np.array([len(getattr(self, k)) for k, _ in self.PARTS], np.int64)
        return sizes.tobytes() + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in (getattr(self, k) for k, _ in self.PARTS))

    @classmethod
    def mapped(cls, path: str) -> Automaton:
        sizes = np.memmap(path, np.int64, "r", shape=(len(cls.PARTS),))
        parts, at = {}, sizes.nbytes
        for (name, kind), size in zip(cls.PARTS, sizes.tolist()):
            parts[name] = np.memmap(path, kind, "r", at, (size,)).view(np.ndarray) if size else np.zeros(0, kind)
            at += -(-parts[name].nbytes // 8) * 8
        return cls(parts)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, or -1. All words go one byte on at a time."""
        place = np.full(len(words), -1, np.int64)
        if not words or not len(self.arcs):
            return place
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        letters = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        alive, state, total = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            ended = length[alive] == step
            done = ended & (self.final[state] > 0)
            place[alive[done]] = total[done]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
            key = state << 8 | letters[start[alive] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            good = self.arcs[arc] == key
            alive, state, total = alive[good], self.targets[arc[good]].astype(np.int64), total[good] + self.adds[arc[good]]
            step += 1
        return place


@dataclass(frozen=True)
class Lexicon:
    """A compiled lexicon: the name under which Spark hands its file to executors."""

    file: str
    tokenizer: ByteBpe


def word_counts(docs: DataFrame, tokenizer: ByteBpe, text: str = "text") -> DataFrame:
    """(word, n) over all texts, but for special tokens. Chunks are counted first, and a distinct one is cut into words once."""
    small_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        t, counts = tokenizer_of(packed), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(t.parts(text))
            if len(counts) > COUNTED_CHUNKS:
                yield out(counts)
                counts.clear()
        yield out(counts)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, counts = tokenizer_of(packed), Counter()
        for batch in batches:
            some = [x for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x[0] not in t.special_ids]
            found, ends = t.words([c for c, _ in some])
            for (_, n), i, j in zip(some, [0, *ends], ends):
                for w in found[i:j]:
                    counts[w] += n
            if len(counts) > COUNTED_CHUNKS:
                yield out(counts)
                counts.clear()
        yield out(counts)

    texts = docs.select(F.col(text).alias("text")).where("text <> ''")
    found = texts.mapInArrow(chunks, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.mapInArrow(words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write bytes to the shared folder and have Spark hand the file to every executor; the name to ask SparkFiles for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def learn_lexicon(docs: DataFrame, tokenizer: ByteBpe, text: str = "text", config: LexiconConfig = LexiconConfig()) -> Lexicon:
    """Compile the most frequent words of all texts. At most ``config.words`` come to the driver."""
    counts = word_counts(docs, tokenizer, text).where(F.octet_length("word") <= config.longest)
    top = [r.word.encode() for r in counts.orderBy(F.desc("n"), "word").limit(config.words).collect()]
    data = Automaton.compiled({w: tokenizer.merge(w) for w in top}).written()
    return Lexicon(put_file(docs.sparkSession, f"lexicon-{hashlib.sha1(data).hexdigest()}.bin", data), tokenizer)


class Encoder:
    def __init__(self, tokenizer: ByteBpe, lexicon: Automaton) -> None:
        self.t, self.lexicon = tokenizer, lexicon
        self.special = {w: np.array([i], "<u4").tobytes() for w, i in tokenizer.specials}
        # Chunks to their ids, 4 bytes each: those seen lately, and those seen before these.
        self.known: dict[str, bytes] = dict(self.special)
        self.before: dict[str, bytes] = {}
        self.sizes = np.array([len(v) for v in tokenizer.vocab], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(tokenizer.vocab), np.uint8)

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks: words from the lexicon, others by merging."""
        cut, ends = self.t.words(chunks)
        words = list(set(cut))
        data = [w.encode("utf-8", "replace") for w in words]
        places = self.lexicon.places(data)
        packed, starts = self.lexicon.ids, self.lexicon.starts
        found = {words[i]: packed[starts[p] : starts[p + 1]].tobytes() for i, p in enumerate(places.tolist()) if p >= 0}
        unseen = np.flatnonzero(places < 0).tolist()
        found |= zip([words[i] for i in unseen], self.t.merge_many([data[i] for i in unseen]))
        ids = list(map(found.__getitem__, cut))
        self.known.update({c: ids[i] if j == i + 1 else b"".join(ids[i:j]) for c, i, j in zip(chunks, [0, *ends], ends)})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, 4 bytes each, the lowest first."""
        cut = [self.t.parts(t) if t else [] for t in texts]
        if len(self.known) > KNOWN_CHUNKS:
            self.known, self.before = dict(self.special), self.known
        known, before = self.known, self.before
        new = set().union(*cut).difference(known)
        again = new.intersection(before)
        known.update({c: before[c] for c in again})
        self.learn(list(new - again))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: the letters of each, side by side. Broken UTF-8 is replaced."""
        ids = np.frombuffer(ids, "<u4")
        size = self.sizes[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.starts[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.letters[at].tobytes().decode("utf-8", "replace")


def _encoder(packed, file: str) -> Encoder:
    return once(("byte-bpe-encoder", file), lambda: Encoder(tokenizer_of(packed), Automaton.mapped(SparkFiles.get(file))))


def encode_words(docs: DataFrame, lexicon: Lexicon, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``, an array of whole numbers; empty for null and empty texts."""
    small_batches(docs.sparkSession)
    packed, file = docs.sparkSession.sparkContext.broadcast(lexicon.tokenizer), lexicon.file
    docs = docs.drop(ids)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        encoder = _encoder(packed, file)
        for batch in batches:
            found = encoder.encode(batch.column(at).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{ids}` array<int>"])
    return docs.mapInArrow(run, schema)


def decode_words(rows: DataFrame, tokenizer: ByteBpe, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text of the ids; null for null ids."""
    packed = rows.sparkSession.sparkContext.broadcast(tokenizer)
    rows = rows.drop(decoded)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = tokenizer_of(packed).vocab
        for batch in batches:
            texts = [None if x is None else b"".join(vocab[i] for i in x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, decoded])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{decoded}` string"])
    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded, and decoded again from its packed ids.

    ids_sha256 is that of the ids as 4 bytes each, the lowest first. A null text is an
    empty one; rows that repeat a key have a row each, and further columns don't matter.
    """
    small_batches(docs.sparkSession)
    packed, file = docs.sparkSession.sparkContext.broadcast(lexicon.tokenizer), lexicon.file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        encoder = _encoder(packed, file)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                rows = [
                    (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(encoder.decode(x).encode()).hexdigest())
                    for x in encoder.encode(part.column(1).to_pylist())
                ]
                cols = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
