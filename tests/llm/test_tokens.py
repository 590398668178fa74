"""Byte-pair encoding, phrases and token alignment against the libraries, SQL and brute force."""

import hashlib
from collections import Counter, defaultdict

import ahocorasick
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import byte_bpe, phrase_mining, token_alignment
from codeloom.llm.queries import BYTE_BPE, PIECES

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [
    "", None, " ", "  ", "\n\n \t", "a  b\t c \n\n d  ", "  lead", "x <|endoftext|>y<|endoftext|>", "<|endoftext|>", " a　b", "　x  y 1²½ⅷ",
    "don't  we'll 'S 'st a'sb", "日本語テキスト" * 50, "\x1c \x1d a\x85b", "\U0001f600 emoji ͸ ֋₏", "a" * 5000 + " " * 30 + "\n" * 5 + "z", "é" * 3000,
    "\x00\x01 \x7f", "mark ▁ inside", "<s> </s> <unk> <0x41>", "xy" * 4000 + "\n", "tail \n", "a  b", "one\n two\n\n  three",
]
CLASHES = ["key", "ids", "block", "number", "a", "b", "n", "digest", "groups", "times", "word", "phrase", "rank", "l", "r", "score", "size", "gid", "n_tokens"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Haus", "père", "naïve,", "don't", "3.14", "x;y", "END."]
    made = [" ".join(words[i] for i in rng.zipf(1.4, int(n)) % len(words)) for n in rng.integers(1, 200, 80)]
    texts = [*AWKWARD, *made, *made[:10]]
    return spark.createDataFrame([(i, t, ["en", "de", None, "und"][i % 4], "s", 0) for i, t in enumerate(texts)], DOC).repartition(4)


@pytest.fixture(scope="module")
def odd(docs):
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load_byte_bpe(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


# 11


@pytest.mark.parametrize("words", [0, 40, 65_536])
def test_ids_are_the_library_s(odd, bpe, library, words):
    """With no lexicon, one of a few words, and one of all."""
    lexicon = byte_bpe.learn_lexicon(odd, bpe, config=byte_bpe.LexiconConfig(words=words))
    got = {r.doc_id: r for r in byte_bpe.digests(odd, lexicon).collect()}
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_columns_of_ids(odd, bpe, library):
    lexicon = byte_bpe.learn_lexicon(odd, bpe)
    rows = byte_bpe.decode_words(byte_bpe.encode_words(odd, lexicon, ids="found"), bpe, "found").collect()
    assert len(rows) == odd.count() and rows[0]["ids"] == 7
    for r in rows:
        assert list(r["found"]) == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")


def test_empty_tables_encode(docs, bpe):
    none = docs.limit(0)
    assert byte_bpe.digests(none, byte_bpe.learn_lexicon(none, bpe)).collect() == []


def test_every_character_is_classed_as_in_the_library(bpe, library):
    """Words of texts around each character of the first plane, by the library's own cut."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for at in range(0, 0x10000, 97):
        if not 0xD800 <= at < 0xE000:
            text = f"a{chr(at)}1 {chr(at)}{chr(at)}! {chr(at)}"
            assert bpe.words([text])[0] == [text[i:j] for _, (i, j) in cut.pre_tokenize_str(text)], hex(at)


def test_the_automaton_is_minimal_and_numbers_words():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "", "é", "ê"])}
    a = byte_bpe.Automaton.compiled(words)
    order = sorted(words)
    asked = [*order, b"t", b"tapss", b"x", b"\xff"]
    assert a.places(asked).tolist() == [*range(len(order)), -1, -1, -1, -1]
    assert [a.ids[a.starts[p] : a.starts[p + 1]].tolist() for p in a.places(order)] == [words[w] for w in order]

    def right(prefix):
        return frozenset(w[len(prefix) :] for w in words if w.startswith(prefix))

    assert len(a.final) == len({right(w[:k]) for w in words for k in range(len(w) + 1)})  # one state for each set of endings


def test_words_are_merged_alike_one_by_one_and_together(bpe):
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 101, int(n)).astype(np.uint8)) for n in rng.integers(0, 45, 500)] + [bytes(range(256)), b" the", b""]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_many(words)] == [bpe.merge(w) for w in words]


# 12


def brute_phrases(rows, c):
    import re

    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, c.max_words + 1) for i in range(len(w) - n + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= c.least}
    found = defaultdict(list)
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q))) and 100 * b >= c.covered_percent * a for q, b in cand.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[: c.top], 1))


@pytest.mark.parametrize("c", [phrase_mining.MineConfig(), phrase_mining.MineConfig(least=4, max_words=4, top=25), phrase_mining.MineConfig(least=6, max_cells=1 << 16, cells_per_word=1)])
def test_phrases_are_those_of_brute_force(odd, c):
    got = sorted(tuple(r) for r in phrase_mining.collocations(odd, c).collect())
    assert got and got == brute_phrases([(r.text, r.lang) for r in odd.select("text", "lang").collect()], c)


def test_phrases_in_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    c = phrase_mining.MineConfig(least=5, top=40)
    assert sorted(con.execute(phrase_mining.collocations_sql(c)).fetchall()) == sorted(tuple(r) for r in phrase_mining.collocations(docs, c).collect())


def test_a_crowded_sketch_makes_no_difference(spark, monkeypatch, docs):
    """All windows in a few cells: everything is a candidate, and sums decide."""
    c = phrase_mining.MineConfig(least=5)
    want = sorted(tuple(r) for r in phrase_mining.collocations(docs, c).collect())
    monkeypatch.setattr(phrase_mining.Words, "cells", staticmethod(lambda h, n: (h % np.uint64(3)).astype(np.int64)))
    monkeypatch.setattr(phrase_mining, "SHARD", 500)
    assert sorted(tuple(r) for r in phrase_mining.collocations(docs, c).collect()) == want


def test_no_phrases_in_empty_tables(docs):
    assert phrase_mining.collocations(docs.limit(0)).collect() == []
    assert phrase_mining.collocations(docs.withColumn("text", F.lit(None).cast("string"))).collect() == []


def test_a_scan_reads_a_few_letters_a_word(monkeypatch):
    """Counts of overlapping phrases are exact, whatever the words' lengths; the automaton sees codes, and of what no candidate covers a break."""
    rng = np.random.default_rng(12)
    names = [("wörter" * (1 + i % 12)) + str(i) for i in range(3000)] + ["a", "aa", "é"]
    tokens = [names[i] if rng.random() > 0.03 else "." for i in rng.zipf(1.2, 20_000) % len(names)]
    pieces = [p.split() for p in " ".join(tokens).split(".")]
    true = {n: Counter(" ".join(p[i : i + n]) for p in pieces for i in range(len(p) - n + 1)) for n in (1, 2, 3)}
    text, made = " ".join(tokens), ahocorasick.Automaton
    for least in (1, 3):
        allowed = []
        for n in (1, 2, 3):
            words = phrase_mining.Words("en", text)
            cells, found = np.unique(words.cells(next(words.windows(range(n, n + 1), allowed))[1], 1 << 20), return_counts=True)
            bits = np.zeros(1 << 20, bool)
            bits[cells[found >= least]] = True
            allowed.append(np.packbits(bits, bitorder="little"))
        letters = Counter()

        class Recorded:
            def __init__(self, *args):
                self.inner = made(*args)

            def __len__(self):
                return len(self.inner)

            def __getattr__(self, name):
                if name in ("add_word", "iter"):
                    return lambda text, *more: letters.update({name: len(text)}) or getattr(self.inner, name)(text, *more)
                return getattr(self.inner, name)

        monkeypatch.setattr(phrase_mining.ahocorasick, "Automaton", Recorded)
        got = {n: dict(zip(map(str, phrases), counts.tolist())) for phrases, n, counts in phrase_mining.scan(words, range(2, 4), allowed)}
        for n in (2, 3):
            assert all(true[n][p] == a for p, a in got[n].items())
            assert {p for p, a in true[n].items() if a >= least} <= got[n].keys()
        assert letters["iter"] < 3 * len(tokens) and letters["add_word"] < 3 * sum(n * len(got[n]) for n in (2, 3))


def test_codes_of_words_delimit_themselves():
    codes = phrase_mining.word_codes(40_000)
    size = {c[0]: len(c) for c in codes}
    assert len(set(codes)) == 40_000 and len(codes[-1]) == 4 and list(map(len, codes)) == sorted(map(len, codes))
    assert all(len(c) == size[c[0]] and not size.keys() & set(c[1:]) and " " not in c for c in codes)


def test_hashes_go_by_the_string_alone():
    words = ["", "a", "b", "ab", "ba", "é" * 16, "é" * 17, "x" * 32, "x" * 33, "x" * 500, "y" + "x" * 499, "\x00", "\x00\x00"]
    one = [phrase_mining.hashes(pa.array([w], pa.string()))[0] for w in words]
    assert len(set(one)) == len(words)
    assert phrase_mining.hashes(pa.array(["zz", *words], pa.large_string())[1:]).tolist() == phrase_mining.hashes(pa.array(words, pa.string())).tolist() == one
    assert len(phrase_mining.hashes(pa.array([], pa.string()))) == 0 and len(set(phrase_mining.hashes(pa.array(["", ""])))) == 1


# 13


def brute_alignment(rows, library):
    import sentencepiece

    from codeloom.llm.piece_tokenizer import load_model

    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_bytes, b_bytes = byte_bpe.load_byte_bpe(BYTE_BPE).vocab, load_model(PIECES).bytes_of
    groups_of, count = {}, Counter()
    for key, text in rows:
        groups = []
        if text:
            a, b, data = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text), (" " + text).encode()
            if b"".join(a_bytes[i] for i in a) == data == b"".join(b_bytes[i] for i in b):
                a_ends, b_ends = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes[i]) for i in b]).tolist()
                last = 0
                for end in sorted(set(a_ends) & set(b_ends)):
                    groups.append(([i for i, e in zip(a, a_ends) if last < e <= end], [i for i, e in zip(b, b_ends) if last < e <= end]) if len(a) < 3000 else None)
                    last = end
                if None in groups:
                    groups, i, k = [], 0, 0
                    for end in sorted(set(a_ends) & set(b_ends)):
                        j, m = a_ends.index(end, i) + 1, b_ends.index(end, k) + 1
                        groups.append((a[i:j], b[k:m]))
                        i, k = j, m
        groups_of[key] = groups
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    library.encode_special_tokens = False
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = {}
    for key, groups in groups_of.items():
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[key] = (
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
            sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )
    return out, dict(count)


@pytest.mark.parametrize("groups", [100_000, 40])
def test_alignment_is_that_of_brute_force(odd, bpe, library, monkeypatch, groups):
    """In whole blocks, and in blocks so small that most groups are in several."""
    monkeypatch.setattr(token_alignment, "BLOCK_GROUPS", groups)
    rows, counts = token_alignment.align_tokens(odd, bpe, token_alignment.load_pieces(PIECES))
    want, count = brute_alignment([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], library)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r[0]: tuple(r[1:]) for r in rows.collect()} == want
    assert {(r.a, r.b): r.n for r in counts.collect()} == count


def test_alignment_of_empty_tables(docs, bpe):
    pieces = token_alignment.load_pieces(PIECES)
    assert token_alignment.align_tokens(docs.limit(0), bpe, pieces)[0].collect() == []
    rows = token_alignment.align_tokens(docs.limit(3).withColumn("text", F.lit(None).cast("string")), bpe, pieces)[0].collect()
    assert [tuple(r[1:]) for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 3
