"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are binned by quantiles. Boosting goes round the features in turn; each visit fits a
shallow tree on one feature's bins to the loss's gradients and adds its leaves, damped, to that feature's lookup
table. Then the pairs that explain most of what is left get small two-way tables the same way. A score is the
logistic of an intercept and one table entry per feature and pair, so scoring is a few vectorised additions.

The fit sees at most ``SAMPLE`` labelled rows (those of least id hash); scoring sees every row.

Defined cases: a null or empty text has all features 0 and gets the model's score for that; with no labelled
rows every score is 0.5, and with one class that class's smoothed rate; null labels are left out; several labels
of one document all count; extra columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import table

#: Most labelled rows that a fit uses, and the score from which a document is predicted good.
SAMPLE, THRESHOLD = 20_000, 0.7
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS, RIDGE, LEAST = 32, 120, 0.2, 6, 8, 40, 2.0, 20

FEATURES = [
    "log_words", "word_length", "upper", "digits", "symbols", "sentence_marks", "non_ascii", "spaces", "distinct_words",
    "repeated_next", "top_word", "symbol_ended", "symbol_only", "words_a_line", "distinct_lines", "longest_word", "capitalised", "brackets",
]
_UPPER, _DIGITS, _SPACES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"
_MARKS, _BRACKETS = b".,;:?'\"-", b"()[]{}<>"
_SYMBOLS = b"!#$%&*+/=@\\^_`|~"
_ENDS = tuple("!#$%&*+/=@\\^_`|~")


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n, words, lines = len(raw), text.split(), text.split("\n")
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    m = max(1, len(words))
    counts = Counter(words)
    return [
        float(np.log1p(len(words))), len(text) / m, share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_MARKS), (n - len(text)) / n, share(_SPACES), len(counts) / m,
        sum(map(str.__eq__, words, words[1:])) / m, max(counts.values(), default=0) / m, sum(w.endswith(_ENDS) for w in words) / m,
        sum(k for w, k in counts.items() if not w[0].isalnum() and not w[-1].isalnum()) / m, len(words) / len(lines), len(set(lines)) / len(lines),
        float(max(map(len, counts), default=0)), sum(k for w, k in counts.items() if w[0].isupper()) / m, share(_BRACKETS),
    ]


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of ordered bins; place 0 if there is none."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    rest_g, rest_h = g.sum() - a, h.sum() - b
    gain = a * a / (b + RIDGE) + rest_g * rest_g / (rest_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(b < 1e-9) | (rest_h < 1e-9)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 1e-12 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a tree of ``depth`` cuts at most along any path."""
    at = _cut(g, h)[1] if depth else 0
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _plane(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of a two-way tree on a grid: one cut of the rows, then one of the columns in each part; its gain."""
    best, values = 0.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(a)):
            gain, out = 0.0, np.zeros_like(a)
            for rows in (slice(0, at), slice(at, None)):
                x, y = a[rows].sum(0), b[rows].sum(0)
                won, col = _cut(x, y)
                gain += won + x.sum() ** 2 / (y.sum() + RIDGE)
                for cols in (slice(0, col), slice(col, None)):
                    if x[cols].size:
                        out[rows, cols] = x[cols].sum() / (y[cols].sum() + RIDGE)
            if gain > best:
                best, values = gain, out.T if turn else out
    return values, best - g.sum() ** 2 / (h.sum() + RIDGE)


class Model:
    """Bin edges and tables; ``score`` takes a feature matrix."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base, self.edges, self.tables, self.pairs = 0.0, [], [], []
        if not len(y):
            return
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if len(set(y.tolist())) < 2 or len(y) < LEAST:
            return
        bins, logit = self._bins(x), np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, own in enumerate(self.tables):
                p = _sigmoid(logit)
                g, h = (np.bincount(bins[j], v, len(own)) for v in (y - p, p * (1 - p)))
                step = RATE * np.clip(_tree(g, h, 2), -4, 4)
                own += step
                logit += step[bins[j]]
        p = _sigmoid(logit)
        coarse = [b * PAIR_BINS // len(t) for b, t in zip(bins, self.tables, strict=True)]
        grid = lambda a, b, v: np.bincount(coarse[a] * PAIR_BINS + coarse[b], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        gains = [(_plane(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1], a, b) for a in range(len(bins)) for b in range(a + 1, len(bins))]
        self.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for a, b, own in self.pairs:
                p = _sigmoid(logit)
                step = RATE * np.clip(_plane(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0], -4, 4)
                own += step
                logit += step[coarse[a], coarse[b]]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        if self.tables:
            bins = self._bins(x)
            coarse = [b * PAIR_BINS // len(t) for b, t in zip(bins, self.tables, strict=True)]
            for b, own in zip(bins, self.tables, strict=True):
                logit += own[b]
            for a, b, own in self.pairs:
                logit += own[coarse[a], coarse[b]]
        return _sigmoid(logit)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def held_out(doc="doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> Model:
    """A model of ``quality`` from at most ``sample`` labelled rows outside the held-out quarter."""
    rows = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and __id is not null").where(~held_out("__id"))
    some = rows.orderBy(F.xxhash64("__id"), "__id", "y").limit(sample)
    found = docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).join(F.broadcast(some), F.col("d") == F.col("__id")).select("__id", "y", _features("t").alias("x"))
    # An id may stand on many rows, so the bound holds for what is collected, too.
    seen = sorted(found.orderBy(F.xxhash64("__id"), "__id", "y", "x").limit(sample).collect(), key=lambda r: (r["__id"], r["y"], r["x"]))
    return Model(np.array([r["x"] for r in seen], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in seen], float))


def add_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    return docs.withColumn(out, scored(F.col(text)))


def op2_quality(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
