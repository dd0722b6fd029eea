"""Confusion, class scores, probability scores, bootstrap and calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text

from tracemill.operators.sequence import numbered


def confusion(df: DataFrame, gold: str, pred: str, labels: list) -> DataFrame:
    """(gold, pred, n) for every pair of labels, zero where nothing falls."""
    spark = df.sparkSession
    kind = df.schema[gold].dataType.simpleString()
    every = spark.createDataFrame([(a, b) for a in labels for b in labels], f"gold {kind}, pred {kind}")
    n = df.groupBy(F.col(gold).alias("gold"), F.col(pred).cast(kind).alias("pred")).agg(F.count("*").alias("n"))
    return every.join(n, ["gold", "pred"], "left").fillna(0, ["n"])


def class_scores(matrix: DataFrame) -> DataFrame:
    """Per label: support, precision, recall and F1; a zero denominator gives 0. Works on one row per pair of labels."""
    gold = matrix.groupBy("gold").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = matrix.groupBy(F.col("pred").alias("gold")).agg(F.sum("n").alias("predicted"))
    out = gold.join(pred, "gold")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.try_divide("tp", "predicted")), zero(F.try_divide("tp", "support"))
    return out.select(F.col("gold").alias("label"), "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(zero(F.try_divide(2 * p * r, p + r)), 6).alias("f1"))


def nll(probability: Column, floor: float) -> Column:
    return -F.ln(F.greatest(probability, F.lit(floor)))


def brier(probabilities: Column, gold_place: Column) -> Column:
    """Sum over classes of (p - [gold])^2; ``gold_place`` is 0-based."""
    d = F.transform(probabilities, lambda p, i: F.pow(p - F.when(i == gold_place, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(d, F.lit(0.0), lambda a, x: a + x)


def draws(groups: DataFrame, group: str, replicates: int, broadcast_rows: int = 200_000) -> DataFrame:
    """(rep, group, times): each replicate draws as many groups as there are, with replacement, by hash.

    The table has a row for each replicate and group drawn, as any bootstrap over groups has; groups are numbered in ranges, so
    that no task sees them all, and broadcast only where a count allows.
    """
    g = numbered(groups.select(group).distinct(), [F.col(group)], "place").withColumn("place", F.col("place") - 1)
    n = g.count()
    slots = g.sparkSession.range(replicates * n).select((F.col("id") / n).cast("long").alias("rep"), (F.col("id") % n).alias("slot"))
    digest = F.sha2(F.concat_ws(":", F.col("rep").cast("string"), F.col("slot").cast("string")), 256)
    hit = slots.select("rep", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).alias("place"))
    side = F.broadcast(g) if n <= broadcast_rows else g
    return hit.groupBy("rep", "place").agg(F.count("*").alias("times")).join(side, "place").select("rep", group, "times")


#: Where the two ends of a 95 % interval stand among R sorted values, from 0, by three rules.
INTERVALS = {
    "floor_ceil": lambda r: (max(0, math.floor(0.025 * r)), min(r - 1, math.ceil(0.975 * r) - 1)),
    "probe": lambda r: (r * 25 // 1000 - 1, r * 975 // 1000 - 1),
    "inner": lambda r: (int(0.025 * (r - 1)), int(0.975 * (r - 1))),
}


def macro_f1(counts: DataFrame, keys: list[str], gold: str, pred: str, n: str, labels: list) -> DataFrame:
    """(keys, macro_f1, accuracy) from counted (gold, pred): the mean over all labels, 0 for one that is neither."""
    # Each counted pair is seen from its gold and from its predicted label; tp counts once.
    zero, kind = F.lit(0).cast("long"), counts.schema[gold].dataType
    seen = lambda label, support, predicted, tp: F.struct(F.col(label).cast(kind).alias("label"), support.alias("support"), predicted.alias("predicted"), tp.alias("tp"))
    right = F.when(F.col(gold) == F.col(pred), F.col(n)).otherwise(zero)
    side = F.explode(F.array(seen(gold, F.col(n), zero, right), seen(pred, zero, F.col(n), zero)))
    by = counts.select(*keys, side.alias("s")).groupBy(*keys, "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return by.groupBy(*keys).agg((F.sum(F.when(F.col("label").isin(labels), f1)) / len(labels)).alias("macro_f1"), F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"))


def paired_bootstrap(rows: DataFrame, group: str, gold: str, a: str, b: str, labels: list, replicates: int) -> DataFrame:
    """(metric, rep, difference): macro-F1 and accuracy of a less those of b, in replicates that draw whole groups; rep -1 is the whole.

    Rows are counted by group, gold and both predictions first; replicates weight these counts.
    """
    counts = rows.groupBy(group, gold, a, b).agg(F.count("*").alias("n"))
    drawn = draws(counts, group, replicates).join(counts, group).withColumn("n", F.col("n") * F.col("times")).drop("times", group)
    every = drawn.unionByName(counts.drop(group).withColumn("rep", F.lit(-1).cast("long"))).groupBy("rep", gold, a, b).agg(F.sum("n").alias("n"))
    one, two = (macro_f1(every, ["rep"], gold, p, "n", labels).select("rep", *[F.col(m).alias(f"{m}_{x}") for m in ("macro_f1", "accuracy")]) for p, x in ((a, "a"), (b, "b")))
    both = one.join(two, "rep")
    return both.select("rep", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_a") - F.col(f"{m}_b")).alias("difference")) for m in ("macro_f1", "accuracy")])).alias("x")).select("x.metric", "rep", "x.difference")


def intervals(replicated: DataFrame, keys: list[str], value: str, replicates: int, rule: str) -> DataFrame:
    """(keys, low, high): the ends of a 95 % interval over one row per replicate."""
    low, high = INTERVALS[rule](replicates)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    r = replicated.withColumn("__i", place).groupBy(*keys)
    return r.agg(F.max(F.when(F.col("__i") == low, F.col(value))).alias("low"), F.max(F.when(F.col("__i") == high, F.col(value))).alias("high"))


def log_score(probability: Column, floor: float = -9.21) -> Column:
    return F.greatest(F.ln(F.greatest(probability, F.lit(1e-12))), F.lit(floor))


def spherical_score(probability: Column, probabilities: Column) -> Column:
    return probability / F.greatest(F.sqrt(F.aggregate(probabilities, F.lit(0.0), lambda t, x: t + x * x)), F.lit(1e-9))


def ranked_score(probabilities: Column, gold_place: Column) -> Column:
    """The ranked probability score of ordered classes: squared differences of cumulative sums over the number of steps; ``gold_place`` is 0-based."""
    sums = F.transform(probabilities, lambda _, i: F.aggregate(F.slice(probabilities, F.lit(1), i + 1), F.lit(0.0), lambda t, x: t + x))
    squares = F.transform(sums, lambda c, i: F.pow(c - F.when(i >= gold_place, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(squares, F.lit(0.0), lambda t, x: t + x) / (F.size(probabilities) - 1)


def temperature(df: DataFrame, logs: str, gold_place: str, rounds: int = 60) -> tuple[float, float]:
    """The temperature that minimises the mean negative log-likelihood, and that value: golden section on ln T.

    Each step is one aggregate over ``df``, which should be cached; ``logs`` holds log-probabilities.
    """

    def loss(x: float) -> float:
        t = math.exp(x)
        z = F.transform(logs, lambda v: v / t)
        top = F.array_max(z)
        total = F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
        return df.agg(F.avg(F.ln(total) + top - F.element_at(z, F.col(gold_place) + 1))).first()[0]

    ratio, a, b = (math.sqrt(5) - 1) / 2, math.log(0.01), math.log(100)
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(rounds):
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = loss(d)
    return math.exp((a + b) / 2), loss((a + b) / 2)


def grouped_folds(sizes: list[tuple], k: int) -> dict:
    """Groups, largest first and by name, to the fold that holds least; works on one entry per group."""
    load, out = [0] * k, {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        f = load.index(min(load))
        out[name] = f
        load[f] += n
    return out


def fold_table(sizes: DataFrame, group: str, n: str, k: int, most: int = 1_000_000) -> DataFrame:
    """(group, fold) by ``grouped_folds``, which is sequential: one entry per group, on the driver; more than ``most`` groups are an error."""
    rows = sizes.select(group, n).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many groups to deal one after another")
    folds = grouped_folds([(r[0], r[1]) for r in rows], k)
    return sizes.sparkSession.createDataFrame(list(folds.items()) or [], f"{group} {sizes.schema[group].dataType.simpleString()}, fold int")


def same(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    """Whether two reported numbers are the same within an absolute tolerance."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def score_gradient(df: DataFrame, logits: str, gold: str, noise: str, sigma: float, floor: float = -9.21, spherical: float = 0.75) -> DataFrame:
    """Adds ``rewards``, ``loss_score``, ``loss_gold``, ``loss`` and ``gradient`` of the score-function estimator, by arrays within each row.

    ``noise`` holds two or more perturbations, each as long as ``logits``; what moves all logits alike is projected out. A perturbation's reward is
    the floored log score of the gold class (its place from 0) and a share of the spherical score; advantages are rewards less their mean over their standard deviation.
    The gradient by class is that of the perturbations' Gaussian log density, weighed by advantage, and that of cross-entropy.
    A row with fewer than two perturbations, one of another length, or anything that is null or not finite gets nulls.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    plain = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    good = (F.size(noise) > 1) & plain(F.col(logits)) & F.coalesce(F.forall(noise, lambda e: (F.size(e) == F.size(logits)) & plain(e)), F.lit(False)) & F.col(gold).between(0, F.size(logits) - 1)
    steps = df.withColumn("__noise", F.when(good, F.transform(noise, lambda e: F.transform(e, lambda x: x - total(e) / F.size(e)))))
    steps = steps.withColumns({"__p": text.softmax(F.col(logits)), "__each": F.transform("__noise", lambda e: text.softmax(F.zip_with(F.col(logits), e, lambda a, b: a + b)))})
    own = lambda p: F.get(p, F.col(gold))
    steps = steps.withColumn("rewards", F.transform("__each", lambda p: log_score(own(p), floor) + spherical * spherical_score(own(p), p)))
    steps = steps.withColumn("__raw", F.transform("rewards", lambda r: r - total(F.col("rewards")) / F.size("rewards")))
    scale = F.sqrt(total(F.transform("__raw", lambda r: r * r)) / (F.size("__raw") - 1)) + 1e-6
    steps = steps.withColumn("__scale", scale).withColumn("__advantages", F.transform("__raw", lambda r: r / F.col("__scale")))
    energy = F.zip_with("__advantages", "__noise", lambda a, e: a * total(F.transform(e, lambda x: x * x)))
    steps = steps.withColumns({"loss_score": total(energy) / (2 * sigma * sigma) / F.size("__noise"), "loss_gold": F.when(F.col("__noise").isNotNull(), -F.ln(F.greatest(own(F.col("__p")), F.lit(1e-12))))})
    pull = lambda i: total(F.zip_with("__advantages", "__noise", lambda a, e: a * F.get(e, i))) / (sigma * sigma) / F.size("__noise")
    gradient = F.transform("__p", lambda p, i: p - F.when(i == F.col(gold), 1.0).otherwise(0.0) - pull(i))
    steps = steps.withColumns({"loss": F.col("loss_score") + F.col("loss_gold"), "gradient": F.when(F.col("__noise").isNotNull(), gradient)})
    return steps.drop("__noise", "__p", "__each", "__raw", "__scale", "__advantages")
