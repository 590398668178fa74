"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks.

A text that compresses far better than prose of its length repeats itself; one that
hardly compresses is noise, encoded data or a list of random tokens. What is usual
depends on the length, so each length band has its own limits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from codeloom.llm.common import as_bytes, map_texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, worst_chunk double, n_chunks bigint, chunks_out bigint"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio (bytes before over after) for texts of up to ``up_to`` bytes.

    Measured at level 3: what random text reaches at most, and prose at least and at most.

        bytes    base64  CJK    a-z    hex    prose
        512      1.25    1.19   1.54   1.77   1.35 to 1.85
        768      1.30    1.26   1.60   1.83   1.44 to 2.08
        1,024    1.32    1.29   1.63   1.87   1.58 to 2.16
        1,536    1.35    1.32   1.67   1.90   1.69 to 2.27
        2,048    1.37    1.34   1.68   1.91   1.84 to 2.41
        3,072    1.38    1.36   1.70   1.91   1.92 to 2.51
        4,096    1.39    1.37   1.70   1.92   1.98 to 2.61
        8,192    1.40    1.38   1.70   1.93   2.09 to 2.65
        longer   1.40    1.39   1.74   1.99   2.21 to 2.90

    From 4 kB on all of these lie below prose. In shorter texts letters and digits at random
    compress as prose does, or better, and no ratio tells them apart; random digits alone
    (2.0 to 2.2) look like prose at every length.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        # up_to, least, most
        (512, 1.28, 3.2),
        (768, 1.34, 3.4),
        (1024, 1.42, 3.6),
        (1536, 1.60, 3.8),
        (2048, 1.72, 3.8),
        (3072, 1.80, 4.2),
        (4096, 1.93, 4.5),
        (8192, 1.98, 4.5),
        (float("inf"), 2.02, 5.0),
    )
    chunk_bytes: int = 4096
    chunk_limits: tuple[float, float] = (1.95, 4.5)
    most_chunks_out: float = 0.25
    level: int = 3
    least_words: int = 50
    most_repeated_percent: int = 50

    def of(self, n_bytes: int) -> tuple[float, float]:
        return next((lo, hi) for up_to, lo, hi in self.limits if n_bytes <= up_to)


def repeat_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside a window of three words that the text has at least twice."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * n_distinct + ids[1:]
    if n_distinct > 2_000_000:  # three factors would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * n_distinct + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


def measure(bands: Bands) -> Callable[[str | None], tuple]:
    packers: list[zstandard.ZstdCompressor] = []

    def ratio(data: bytes) -> float:
        if not packers:  # made on the executor; it can't be pickled
            packers.append(zstandard.ZstdCompressor(level=bands.level, write_content_size=False))
        return len(data) / len(packers[0].compress(data))

    def one(text: str | None) -> tuple:
        data = as_bytes(text)
        words = data.split()
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        repeated = repeat_words(ids, max(1, len(known)))
        lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
        failed = len(words) < bands.least_words or 100 * repeated > bands.most_repeated_percent * len(words)
        whole, chunks = (ratio(data), chunk_ratios(data)) if data else (0.0, [])
        lo, hi = bands.of(len(data))
        out = sum(not bands.chunk_limits[0] <= x <= bands.chunk_limits[1] for x in chunks)
        verdict = lo <= whole <= hi and out <= bands.most_chunks_out * len(chunks)
        return (
            len(words),
            len(text or "") - sum(data.count(SPACES[k : k + 1]) for k in range(len(SPACES))),
            sum(data.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS))),
            len(lines) - len(set(lines)),
            repeated,
            failed,
            verdict and not failed,
            whole,
            max(chunks, key=lambda x: abs(np.log(x / 2.5)), default=whole),
            len(chunks),
            out,
        )

    def chunk_ratios(data: bytes) -> list[float]:
        """Full chunks, the last one over the end of the data; a text of up to one chunk is judged as a whole."""
        size = bands.chunk_bytes
        if len(data) <= size:
            return []
        starts = [*range(0, len(data) - size, size), len(data) - size]
        return [ratio(data[at : at + size]) for at in starts]

    return one


def compression_bands(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row for each row of ``docs``: counts, ratios and the verdict ``kept``.

    Null and empty texts have no words: base_failed, not kept, ratio 0. Rows are judged
    one by one, so repeated rows give repeated results and an empty table an empty one.
    """
    return map_texts(docs, key, text, SCHEMA, measure(bands))
