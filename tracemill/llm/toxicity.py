"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, on Nyström landmarks.

A text falls into units: its words without the signs in them, runs of three or more single letters joined, and for
what is longer than ``WIDTH`` letters windows of that many at every third place (so any ten neighbours are whole in one).
Two units are alike by the subsequences of three letters that they share, each weighing ``DECAY`` to the power of
the stretch that it covers in either: letters put between those of a word lower its likeness to the word and
don't end it. The kernel is that sum, normalised, to the power ``POWER``; its values at the landmarks give a unit's
coordinates, in which a linear machine of squared hinge loss is fitted. A text scores by the values of its worst units
(the first, second, fourth and eighth), clipped to the margin and put to a probability by a logistic curve over them and the number of its units.

The fit: sentences of the labelled documents take their document's label, equal ones count once, and Spark counts
for each unit the sentences of either label that have it. Units at home in toxic sentences alone are the positive
examples, together with copies of them that have one letter put in (virtual support vectors); landmarks are chosen to
cover them. A quarter of the ids is kept from the machine, for the curve. Negative examples are units of clean sentences by hash, and in each round those that the machine finds worst.

The fit uses at most ``SAMPLE`` labelled ids (those of least id hash) and whole texts; what the driver collects is bounded by ``POSITIVE``,
``NEGATIVE`` and ``HARD``. Scoring is one pass over the texts, without a shuffle.

Defined cases: a text without units (null, empty, signs only) scores as the machine does where nothing is alike; without labels
of both kinds, or without a unit that tells them apart, every score is (toxic + 1) / (labelled + 3); null labels are left out; several labels of one
document all count; equal texts score alike; other columns pass through and one named as the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, stored, table

#: Labelled ids that a fit uses, and the score from which a document is predicted toxic.
SAMPLE, THRESHOLD = 8_000, 0.5
WIDTH, STRIDE, DECAY, POWER = 12, 3, 0.8, 3
#: Landmarks from toxic and from clean units; examples; rounds of hard ones; the machine's cost and the weight of virtual examples.
TOXIC_MARKS, CLEAN_MARKS, POSITIVE, NEGATIVE, HARD, ROUNDS, COST, VIRTUAL = 64, 24, 1_000, 6_000, 4_000, 4, 10.0, 2.0
#: A unit is toxic if that many toxic sentences for a clean one have it, at equal totals; its least share of the toxic sentences.
RATIO, SHARE = 20, 1 / 4_000
#: Characters that are cut into units at once, and scores of units that a task keeps.
BLOCK, CACHE = 4_000_000, 500_000
#: A text is judged by its units at these ranks, the worst being the first.
RANKS = (1, 2, 4, 8)
_END = b".!?"
_TABLE: list[np.ndarray] = []
_PLACES = {n: np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3).T for n in range(WIDTH + 1)}


def _kinds() -> np.ndarray:
    """By code point: 1 to 26 for a to z, 27 to 30 for other letters, 31 for digits, 32 for white space, 0 for the rest."""
    if not _TABLE:
        kinds = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                kinds[c] = ord(low) - 96 if len(low) == 1 and "a" <= low <= "z" else 27 + c % 4
            elif x.isdigit():
                kinds[c] = 31
        kinds[[32, *range(9, 14)]] = 32
        _TABLE.append(kinds)
    return _TABLE[0]


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit of three letters or more: its text's number, the code point where it begins (texts joined), and its letters, five bits each."""
    whole = [t or "" for t in texts]
    kind = _kinds()[np.frombuffer("\n".join(whole).encode("utf-32-le"), "<u4")]
    stop = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)) + 1)
    gaps = np.cumsum(kind == 32, dtype=np.int64)
    at = np.flatnonzero((kind > 0) & (kind < 32))
    letter, word = kind[at], gaps[at]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(np.append(first, len(word)))
    own = np.searchsorted(stop, at[first], side="right")
    # Single letters that follow one another are one unit, too.
    single = size == 1
    joined = single & np.concatenate([[False], single[:-1] & (own[1:] == own[:-1])])[: len(single)]
    head = np.flatnonzero(single & ~joined)
    run = np.diff(np.append(np.cumsum(single)[head] - 1, single.sum()))
    first, size, own = (np.concatenate(x) for x in ((first, first[head[run > 2]]), (size, run[run > 2]), (own, own[head[run > 2]])))
    long = np.flatnonzero(size > WIDTH)
    more = -(-(size[long] - WIDTH) // STRIDE)
    source = np.repeat(long, more)
    step = np.arange(1, len(source) + 1) - np.repeat(np.cumsum(more) - more, more)
    begin = np.concatenate([first, first[source] + np.minimum(STRIDE * step, size[source] - WIDTH)])
    width, own = np.minimum(np.concatenate([size, size[source]]), WIDTH), np.concatenate([own, own[source]])
    keep = width > 2
    begin, width, own = begin[keep], width[keep], own[keep]
    padded = np.concatenate([letter, np.zeros(WIDTH, np.uint8)]).astype(np.int64)
    key = np.zeros(len(begin), np.int64)
    for i in range(WIDTH):
        key |= np.where(i < width, padded[begin + i], 0) << (5 * i)
    return own, at[begin], key


def letters(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys >> (5 * i) & 31 for i in range(WIDTH)], axis=1)


def encoded(rows: list[list[int]]) -> np.ndarray:
    return np.array([sum(v << (5 * i) for i, v in enumerate(r)) for r in rows], np.int64)


def _by_length(keys: np.ndarray, block: int = 1_024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of units of one length: their places in ``keys``, letters, subsequences of three by row, and the weights of these."""
    code = letters(keys)
    size = (code > 0).sum(axis=1)
    for n in range(3, WIDTH + 1):
        i, j, k = _PLACES[n]
        weight, own = DECAY ** (k - i + 1), np.flatnonzero(size == n)
        for at in range(0, len(own), block):
            rows = own[at : at + block]
            c = code[rows, :n]
            yield rows, c, c[:, i] * 1024 + c[:, j] * 32 + c[:, k], weight


def with_itself(c: np.ndarray) -> np.ndarray:
    """The kernel of each unit (a row of letters) with itself, by the usual recursion over its prefixes."""
    rows, n = c.shape
    square = DECAY * DECAY
    before = np.ones((n + 1, n + 1, rows))
    for _ in range(2):
        now = np.zeros((n + 1, n + 1, rows))
        for i in range(1, n + 1):
            run = np.zeros(rows)
            for j in range(1, n + 1):
                run = DECAY * run + (c[:, i - 1] == c[:, j - 1]) * square * before[i - 1, j - 1]
                now[i, j] = DECAY * now[i - 1, j] + run
        before = now
    return square * sum((c[:, i] == c[:, j]) * before[i, j] for i in range(n) for j in range(n))


def vectors(keys: np.ndarray) -> np.ndarray:
    """Rows of the units' weights by subsequence, of length 1."""
    out = np.zeros((len(keys), 1 << 15))
    for rows, _, triple, weight in _by_length(keys):
        np.add.at(out, (rows[:, None], triple), weight)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


class Marks:
    """Landmarks: the rows of their weights that are not zero, and where those are."""

    def __init__(self, keys: np.ndarray):
        dense = vectors(keys).T
        held = np.flatnonzero(dense.any(axis=1))
        self.where = np.zeros(1 << 15, np.int32)
        self.where[held] = np.arange(1, len(held) + 1)
        self.rows = np.concatenate([np.zeros((1, len(keys))), dense[held]])
        self.between = (dense.T @ dense) ** POWER

    def kernel(self, keys: np.ndarray) -> np.ndarray:
        """The kernel of each unit with each landmark."""
        out = np.zeros((len(keys), self.rows.shape[1]))
        for rows, c, triple, weight in _by_length(keys):
            at = self.where[triple]
            hit = at > 0
            some = hit.any(axis=1)
            if not some.any():
                continue
            begin = np.concatenate([[0], np.cumsum(hit[some].sum(axis=1))[:-1]])
            found = self.rows[at[hit]] * np.broadcast_to(weight, hit.shape)[hit][:, None]
            out[rows[some]] = (np.add.reduceat(found, begin, axis=0) / np.sqrt(with_itself(c[some]))[:, None]) ** POWER
        return out


def machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and intercept of least squared hinge loss, by Newton's method on the examples inside the margin."""
    a = np.column_stack([z, np.ones(len(z))])
    ridge = np.append(np.ones(z.shape[1]), 1e-6)
    w = np.zeros(a.shape[1])
    loss = lambda v: 0.5 * (ridge * v * v).sum() + COST * (weight * np.maximum(0, 1 - y * (a @ v)) ** 2).sum()
    for _ in range(60):
        slack = 1 - y * (a @ w)
        on = slack > 0
        slope = ridge * w - 2 * COST * a[on].T @ (weight[on] * y[on] * slack[on])
        step = np.linalg.solve(np.diag(ridge) + 2 * COST * (a[on].T * weight[on]) @ a[on], slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def _cover(keys: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Places of the units that one by one raise the likeness of all, weighed by ``count``, to the nearest chosen the most."""
    v = vectors(keys)
    alike = (v @ v.T) ** POWER
    best, chosen = np.zeros(len(keys)), []
    while len(chosen) < min(most, len(keys)):
        gain = (np.maximum(alike - best, 0) * count).sum(axis=1)
        k = int(gain.argmax())
        if gain[k] <= 1e-9:
            break
        chosen.append(k)
        best = np.maximum(best, alike[k])
    return np.array(chosen, np.int64)


class Model:
    """Landmarks with their weights, and the logistic curve; or one score for all."""

    def __init__(self, constant: float):
        self.constant, self.marks = constant, None
        self.weight, self.bias, self.slope, self.shift = np.zeros(0), 0.0, np.zeros(len(RANKS) + 1), 0.0

    def worth(self, keys: np.ndarray) -> np.ndarray:
        """The machine's value of each unit; summed by row, so that it doesn't hang on the units around."""
        return (self.marks.kernel(keys) * self.weight).sum(axis=1) + self.bias

    def evidence(self, blocks: Iterator[list[str | None]]) -> Iterator[np.ndarray]:
        """Of each text the values of its distinct units at ``RANKS`` from the worst, and the logarithm of their number; values of units are kept from block to block."""
        known, value = np.zeros(0, np.int64), np.zeros(0)
        for texts in blocks:
            own, _, key = units(texts)
            each, back = np.unique(key, return_inverse=True)
            at = np.minimum(np.searchsorted(known, each), max(0, len(known) - 1))
            new = known[at] != each if len(known) else np.ones(len(each), bool)
            here = np.empty(len(each))
            if len(known):
                here[~new] = value[at[~new]]
            here[new] = self.worth(each[new])
            if new.any():
                both, first = np.unique(np.concatenate([known, each[new]]), return_index=True)
                known, value = (both, np.concatenate([value, here[new]])[first]) if len(both) <= CACHE else (each[:CACHE], here[:CACHE])
            out = np.full((len(texts), len(RANKS) + 1), self.bias)
            pair = np.unique(own * max(1, len(each)) + back)
            own, worth = pair // max(1, len(each)), here[pair % max(1, len(each))]
            order = np.lexsort((-worth, own))
            count = np.bincount(own, minlength=len(texts))
            begin = np.cumsum(count) - count
            for i, rank in enumerate(RANKS):
                some = np.flatnonzero(count >= rank)
                out[some, i] = worth[order[begin[some] + rank - 1]]
            out = np.clip(out, -1, 1)  # within the margin, where one unit weighs as much as another
            out[:, -1] = np.log1p(count)
            yield np.round(out, 9)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((evidence * self.slope).sum(axis=1) + self.shift, -35, 35)))


def _blocks(texts: list) -> Iterator[list]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size > BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _evidence(model: Model):
    @F.arrow_udf("array<double>")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.concatenate([np.zeros((0, len(RANKS) + 1)), *model.evidence(_blocks(batch.to_pylist()))])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))

    return evidence


def _sentences(rows: DataFrame) -> DataFrame:
    """(s, y, key): each unit of each sentence of the labelled ``rows`` (y, t), once; key 0 stands for the sentence itself."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            at = 0
            for texts in _blocks(batch.column("t").to_pylist()):
                label = batch.column("y").slice(at, len(texts)).to_numpy(zero_copy_only=False)
                at += len(texts)
                whole = "\n".join(t or "" for t in texts)
                code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
                ends = np.flatnonzero(np.isin(code, [*_END, 10]))
                own, begin, key = units(texts)
                number = np.searchsorted(ends, begin)
                cuts = [0, *(ends + 1).tolist(), len(whole)]
                held = np.unique(number)
                digest = {k: np.uint64(xxh64_intdigest(whole[cuts[k] : cuts[k + 1]].strip())).astype(np.int64) for k in held.tolist()}
                s = np.array([digest[k] for k in number.tolist()], np.int64)
                y = label[own].astype(np.int64)
                table_ = np.unique(np.column_stack([np.concatenate([s, s]), np.concatenate([y, y]), np.concatenate([key, np.zeros(len(key), np.int64)])]), axis=0) if len(s) else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(table_[:, i]) for i in range(3)], names=["s", "y", "key"])

    return rows.mapInArrow(found, "s long, y long, key long")


def held_out(doc="doc_id"):
    """Whether crc32 of the id as text is a multiple of 5; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> Model:
    """A model of ``toxic`` from at most ``sample`` labelled ids outside the held-out fifth."""
    ids = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and __id is not null").where(~held_out("__id"))
    few = ids.select("__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    some = ids.distinct().join(F.broadcast(few), "__id")
    rows = stored(docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).join(F.broadcast(some), F.col("d") == F.col("__id")).select("y", "t", F.pmod(F.xxhash64("__id", F.lit(4)), F.lit(4)).alias("part")))
    totals = dict(rows.groupBy("y").count().collect())
    model = Model((totals.get(1, 0) + 1) / (sum(totals.values()) + 3))
    if len(totals) < 2:
        return model
    counts = cut(_sentences(rows.where("part > 0").select("y", "t")).distinct().groupBy("key").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")))
    total = counts.where("key = 0").first()
    if total is None or not total["p"] or not total["q"]:
        return model
    toxic = (F.col("p") >= max(2.0, total["p"] * SHARE)) & ((F.col("p") + 0.5) / (total["p"] + 1) >= RATIO * (F.col("q") + 0.5) / (total["q"] + 1))
    pairs = lambda df, *names: tuple(np.array(c) for c in zip(*df.select(*names).collect(), strict=True)) or (np.zeros(0, np.int64),) * len(names)
    positive, p = pairs(counts.where("key <> 0").where(toxic).orderBy(F.desc("p"), "key").limit(POSITIVE), "key", "p")
    if not len(positive):
        return model
    clean = counts.where("key <> 0 and q > 0").where(~toxic)
    negative, q = pairs(clean.orderBy(F.xxhash64("key"), "key").limit(NEGATIVE), "key", "q")
    own = positive[_cover(positive, p, TOXIC_MARKS)]
    rng = Random(7)
    extra, extra_weight = [], []
    for key, n in zip(positive.tolist(), p.tolist(), strict=True):
        word = [v for v in letters(np.array([key]))[0].tolist() if v]
        if n * 50 >= p.max() and len(word) < WIDTH:
            made = [word[:i] + [rng.randrange(1, 27)] + word[i:] for i in range(1, len(word)) for _ in range(2)]
            extra += made
            extra_weight += [VIRTUAL * np.log1p(n) / len(made)] * len(made)
    extra = encoded(extra)
    for _ in range(ROUNDS):
        hardest = negative[np.lexsort((negative, -model.worth(negative)))] if model.marks else negative
        marks = Marks(np.concatenate([own, hardest[:CLEAN_MARKS]]))
        value, axes = np.linalg.eigh(marks.between)
        root = axes @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ axes.T
        z = np.concatenate([marks.kernel(k) @ root for k in (positive, extra, negative)])
        y = np.concatenate([np.ones(len(positive) + len(extra)), -np.ones(len(negative))])
        w = machine(z, y, np.concatenate([np.log1p(p), extra_weight, np.log1p(q)]))
        model.marks, model.weight, model.bias = marks, root @ w[:-1], float(w[-1])
        worst, n = pairs(clean.select("key", "q", _worth(model)("key").alias("v")).orderBy(F.desc("v"), "key").limit(HARD), "key", "q")
        fresh = ~np.isin(worst, negative)
        negative, q = np.concatenate([negative, worst[fresh]]), np.concatenate([q, n[fresh]])
    # The curve, from texts that the machine hasn't seen.
    seen = rows.where("part = 0").select("y", _evidence(model)("t").alias("v")).orderBy("y", "v").limit(sample).collect()
    model.slope, model.shift = _curve(np.array([r["v"] for r in seen], float).reshape(-1, len(RANKS) + 1), np.array([r["y"] for r in seen], float))
    return model


def _worth(model: Model):
    @F.arrow_udf("double")
    def worth(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.worth(batch.to_numpy(zero_copy_only=False)), pa.float64())

    return worth


def _curve(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the logistic curve that fits the labels, smoothed as Platt does, best; the worst unit comes first."""
    up, down = y.sum(), (1 - y).sum()
    aim = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    used = np.arange(v.shape[1])
    while True:
        a = np.column_stack([v[:, used], np.ones(len(v))])
        w, ridge = np.zeros(a.shape[1]), np.append(np.where(used == 0, 0.01, 0.5), 1e-6)
        loss = lambda w: (np.logaddexp(0, a @ w) - aim * (a @ w)).sum() + 0.5 * (ridge * w * w).sum()  # noqa: B023, E731
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
            step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(ridge), a.T @ (p - aim) + ridge * w)
            size, now = 1.0, loss(w)
            while size > 1e-6 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        # A unit's value must not count against a text, nor the number of units for it.
        wrong = [k for k, x in zip(used.tolist(), w[:-1].tolist(), strict=True) if (x < 0 if k < len(RANKS) else x > 0)]
        if not wrong:
            slope = np.zeros(v.shape[1])
            slope[used] = w[:-1]
            return slope, float(w[-1])
        used = np.array([k for k in used.tolist() if k not in wrong], np.int64)


def add_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    if model.marks is None:
        return docs.withColumn(out, F.lit(model.constant))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.score(x) for x in model.evidence(_blocks(batch.to_pylist()))]
            yield pa.array(np.concatenate([np.zeros(0), *found]))

    return docs.withColumn(out, scored(F.col(text)))


def op11_toxicity(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
