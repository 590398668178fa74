"""Quality classifier by a sparse ensemble of rules.

Statistics of a text are its features. Small trees are boosted on a bounded sample of
labelled rows; every path from a root to a node is a rule, a conjunction of bounds on
statistics. A logistic regression over all rules with an L1 penalty (lasso) leaves few of
them with a weight. Those are compiled to a Spark column expression, so scoring needs
nothing but the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import as_bytes, map_texts
from codeloom.llm.compression_bands import repeat_words

PUNCTUATION = b".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>"
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "distinct_share", "symbol_share", "bang_share", "pipe_share", "upper_share",
    "digit_share", "punctuation_share", "high_byte_share", "dup_line_share", "line_words", "repeat_share", "top_word_share",
)
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
HIGH = bytes(range(128, 256))


@dataclass(frozen=True)
class RuleConfig:
    """sample_rows bounds the labelled rows that are learned from; all else is small."""

    sample_rows: int = 8000
    trees: int = 40
    depth: int = 3
    bins: int = 24
    rate: float = 0.3
    tree_share: float = 0.5
    least_support: float = 0.005
    penalty: float = 0.001
    steps: int = 400
    seed: int = 11


Bound = tuple[int, bool, float]  # feature, is it "at most", threshold
Rule = tuple[Bound, ...]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()
    names: tuple[str, ...] = field(default=STATISTICS)


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of a text; zeros where there is nothing to count."""
    data = as_bytes(text)
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return (float(np.log1p(size)), *[0.0] * (len(STATISTICS) - 1))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    count = lambda chars: size - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = count(UPPER), count(LOWER)
    return (
        float(np.log1p(size)),
        float(np.log1p(n)),
        sum(map(len, known)) / len(known),
        len(known) / n,
        count(SYMBOLS) / size,
        data.count(b"!") / n,
        data.count(b"|") / n,
        upper / max(1, upper + lower),
        count(DIGITS) / size,
        count(PUNCTUATION) / size,
        count(HIGH) / size,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        repeat_words(ids, len(known)) / n,
        float(np.bincount(ids).max()) / n,
    )


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the statistics), a row for each row. Null and empty texts have zeros."""
    return map_texts(docs, key, text, ", ".join(f"{s} double" for s in STATISTICS), statistics)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[float, int, float] | None:
    """The best (gain, feature, threshold) for gradients g and their weights h."""
    best = None
    total_g, total_h = g.sum(), h.sum()
    for f, e in enumerate(edges):
        if not len(e):
            continue
        slot = np.searchsorted(e, x[:, f], side="left")  # at most e[k] is slot k or less
        left_g = np.cumsum(np.bincount(slot, g, len(e) + 1))[:-1]
        left_h = np.cumsum(np.bincount(slot, h, len(e) + 1))[:-1]
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, float(e[k]))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, c: RuleConfig) -> list[Rule]:
    """Paths of boosted trees, in the order they were grown, each once."""
    rng = np.random.default_rng(c.seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, c.bins + 1)[1:-1])) for f in range(x.shape[1])]
    score, found = np.zeros(len(y)), {}
    for _ in range(c.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        sample = rng.random(len(y)) < c.tree_share
        todo: list[tuple[Rule, np.ndarray]] = [((), np.ones(len(y), bool))]
        while todo:
            path, rows = todo.pop()
            if path:
                found.setdefault(tuple(sorted(path)))
            own = rows & sample
            split = _split(x[own], g[own], h[own], edges) if len(path) < c.depth and own.sum() >= 20 else None
            if split is None:
                score[rows] += c.rate * g[own].sum() / (h[own].sum() + 1)
                continue
            _, f, t = split
            side = x[:, f] <= t
            todo += [((*path, (f, True, t)), rows & side), ((*path, (f, False, t)), rows & ~side)]
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] <= t) == at_most for f, at_most, t in rule])


def lasso(z: np.ndarray, y: np.ndarray, c: RuleConfig) -> tuple[float, np.ndarray]:
    """Bias and weights of the logistic regression with an L1 penalty, by accelerated proximal gradients."""
    n = len(y)
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-9
    z = (z - mean) / scale
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w, b = np.zeros(z.shape[1]), 0.0
    v, vb, t = w, b, 1.0
    for _ in range(c.steps):
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * c.penalty, 0)
        nb, nt = vb - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b - (w * mean / scale).sum()), w / scale


def fit_rules(x: np.ndarray, y: np.ndarray, c: RuleConfig = RuleConfig()) -> RuleModel:
    """A model of rows x statistics and their labels 0 or 1. With one label only, or none, it is constant."""
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rules = [r for r in tree_rules(x, y, c) if c.least_support <= holds(r, x).mean() <= 1 - c.least_support]
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))))
    bias, w = lasso(np.column_stack([holds(r, x) for r in rules]).astype(float), y.astype(float), c)
    kept = [(r, round(float(k), 6)) for r, k in zip(rules, w) if abs(k) > 1e-6]
    return RuleModel(round(bias, 6), tuple(r for r, _ in kept), tuple(k for _, k in kept))


def learn_quality(stats: DataFrame, labels: DataFrame, key: str, label: str, c: RuleConfig = RuleConfig()) -> RuleModel:
    """Fit on at most about ``sample_rows`` labelled rows: those first by a seeded hash of the key.

    ``stats`` is what text_statistics() gives. A key with several labels counts by its
    highest. Rows without a label teach nothing.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    n = known.count()
    at = F.pmod(F.xxhash64(F.col(key), F.lit(c.seed)), F.lit(1 << 30)) / (1 << 30)
    picked = known.where(at < c.sample_rows / max(n, 1)) if n > c.sample_rows else known
    rows = stats.join(picked, key).select(key, "_label", *STATISTICS).toPandas().sort_values([key, *STATISTICS])
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["_label"].to_numpy(float), c)


def rule_column(rule: Rule, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(names[f]) <= t if at_most else F.col(names[f]) > t for f, at_most, t in rule])


def score_column(m: RuleModel) -> Column:
    """The probability of label 1, from columns with the statistics."""
    total = F.lit(m.bias)
    for rule, w in zip(m.rules, m.weights):
        total = total + F.when(rule_column(rule, m.names), w).otherwise(0.0)
    return 1 / (1 + F.exp(-total))
