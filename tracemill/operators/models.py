"""Cheap classifiers as tables: naive Bayes on presence features and logistic regression by SGD."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.shared import BROADCAST_ROWS, at_most, small_side, stored


def naive_bayes(train: DataFrame, docs: DataFrame, key: str, label: str, features: str, min_df: int = 2) -> DataFrame:
    """(key, label, score): log prior plus summed log likelihoods of a document's known features, per class.

    A feature that a class has not seen still counts: its likelihood is 1 / (total + V). That is a class constant
    times the number of known features, so only seen (class, feature) pairs are joined.
    """
    # Outer, since for an inner one the optimiser adds a filter that finds the features a second time.
    seen = train.select(key, label, F.explode_outer(features).alias("f")).where("f is not null")
    # Counted once and kept: vocabulary, its size and the class totals come from this table.
    counts = seen.groupBy(label, "f").agg(F.count("*").alias("c")).withColumn("df", F.sum("c").over(Window.partitionBy("f"))).where(F.col("df") >= min_df).drop("df").persist()
    vocabulary = counts.select("f").distinct()
    size = vocabulary.count()
    prior = train.groupBy(label).agg(F.count("*").alias("n")).persist()
    total = counts.groupBy(label).agg(F.sum("c").alias("tot"))
    rows, classes = prior.agg(F.sum("n"), F.count("*")).first()
    if not rows:
        return docs.select(key).join(prior.select(label, F.lit(0.0).alias("score")), F.lit(False))
    base = prior.join(total, label, "left").fillna(0, ["tot"]).select(label, F.ln((F.col("n") + 1) / F.lit(rows + classes)).alias("prior"), (-F.ln(F.col("tot") + size)).alias("unseen"))
    own = docs.select(key, F.explode_outer(features).alias("f")).join(vocabulary, "f")
    known = own.groupBy(key).agg(F.count("*").alias("m"))
    gain = own.join(counts, "f").groupBy(key, label).agg(F.sum(F.ln(F.col("c") + 1.0)).alias("gain"))
    # Every document meets every class: the classes are few, one row each.
    labels = F.array(*[F.lit(r[0]) for r in base.select(label).orderBy(label).collect()])
    out = docs.select(key).join(known, key, "left").fillna(0, ["m"]).withColumn(label, F.explode(labels))
    out = out.join(F.broadcast(base), label).join(gain, [key, label], "left").fillna(0.0, ["gain"])
    return out.select(key, label, (F.col("prior") + F.col("m") * F.col("unseen") + F.col("gain")).alias("score"))


def term_counts(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, feature, n) of the tokens in ``tokens``, an array column; rows of one key count together.

    A row's tokens are counted within the row, by runs of its sorted array, so only rows whose key is repeated are shuffled.
    """
    sorted_ = docs.select(key, F.sort_array(tokens).alias("__s"))
    begins = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda i: (i == 0) | (F.get("__s", i) != F.get("__s", i - 1)))
    runs = sorted_.withColumn("__b", F.when(F.size("__s") > 0, begins))
    each = F.transform("__b", lambda b, k: F.struct(F.get("__s", b).alias("feature"), (F.coalesce(F.get("__b", k + 1), F.size("__s")) - b).cast("long").alias("n")))
    counts = runs.select(key, F.explode_outer(each).alias("__x")).where("__x is not null").select(key, "__x.feature", "__x.n")
    twice = docs.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("c")).where("c > 1").select("__key")
    if not twice.limit(1).count():
        return counts
    twice, same = small_side(stored(twice)), F.col(key).eqNullSafe(F.col("__key"))
    again = counts.join(twice, same, "left_semi").groupBy(key, "feature").agg(F.sum("n").alias("n"))
    return counts.join(twice, same, "left_anti").union(again)


def tfidf_norms(counts: DataFrame, key: str, documents: int, min_df: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """(key, terms, squares, top): number, sum of squares and greatest of (1 + ln n) idf over a key's features in ``min_df`` keys or more.

    The ``most`` features of most keys are broadcast, and a key's sums over them leave its task as one row; only rows of rarer features are shuffled.
    """
    counts = stored(counts)
    known = stored(counts.groupBy("feature").agg(F.count("*").alias("df")).where(F.col("df") >= min_df))
    idf = (F.ln(F.lit(1 + documents) / (F.col("df") + 1)) + 1).alias("idf")
    w = ((F.ln("n") + 1) * F.col("idf")).alias("w")
    sums = lambda v: v.groupBy(key).agg(F.count("*").alias("terms"), F.sum(F.col("w") * F.col("w")).alias("squares"), F.max("w").alias("top"))
    if at_most(known, most):
        return sums(counts.join(F.broadcast(known.select("feature", idf)), "feature").select(key, w))
    often = stored(known.orderBy(F.desc("df"), "feature").limit(most).select("feature", idf))
    rare = known.join(F.broadcast(often), "feature", "left_anti").select("feature", idf)
    held = counts.join(F.broadcast(often), "feature").select(key, w)
    other = counts.join(F.broadcast(often), "feature", "left_anti").join(rare, "feature").select(key, w)
    both = sums(held).union(sums(other))
    return both.groupBy(key).agg(F.sum("terms").alias("terms"), F.sum("squares").alias("squares"), F.max("top").alias("top"))


def vocabulary(counts: DataFrame, documents: int, min_df: int, most: int) -> DataFrame:
    """(feature, idf) of the ``most`` features that stand in most documents, of at least ``min_df``; ties by name. ``counts`` has id, feature, n."""
    df = counts.groupBy("feature").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("df"), "feature").limit(most)
    return df.select("feature", (F.ln(F.lit(1.0 + documents) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf_vectors(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, feature, value): (1 + ln n) idf of known features over the row's L2 norm; ``known`` is bounded and broadcast."""
    v = counts.join(F.broadcast(known), "feature").select("id", "feature", ((F.ln("n") + 1) * F.col("idf")).alias("v"))
    norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return v.join(norm, "id").select("id", "feature", (F.col("v") / F.col("norm")).alias("value"))


def sgd_logistic(vectors: DataFrame, labels: DataFrame, candidates: list[tuple[str, float, int, float, int]]) -> DataFrame:
    """(candidate, label, feature, weight) of multinomial logistic models fitted by stochastic gradient steps.

    ``vectors`` has id, feature and value, ``labels`` id and label: one training sample of bounded size, since the updates are
    sequential. Each candidate (name, l2, epochs, rate, seed) is one task and the candidates run beside each other. The order of the
    rows is shuffled on from epoch to epoch, the step is rate / sqrt(epoch + 1), weights shrink once before each epoch and
    the bias, kept as feature '', does not.
    """
    spark = vectors.sparkSession
    plan = spark.createDataFrame(candidates, "candidate string, l2 double, epochs int, rate double, seed int")
    own = vectors.groupBy("id").agg(F.collect_list(F.struct("feature", "value")).alias("fs"))
    rows = labels.join(own, "id", "left").withColumn("candidate", F.explode(F.array(*[F.lit(c[0]) for c in candidates]))).join(F.broadcast(plan), "candidate")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        how, names = pdf.iloc[0], sorted(set(pdf["label"]))
        pairs = [sorted((f["feature"], f["value"]) for f in fs) if fs is not None else [] for fs in pdf["fs"]]
        terms = sorted({f for p in pairs for f, _ in p})
        place = {f: i for i, f in enumerate(terms)}
        xs = [(np.array([place[f] for f, _ in p], int), np.array([v for _, v in p], float)) for p in pairs]
        ys = [names.index(y) for y in pdf["label"]]
        w, bias = np.zeros((len(names), len(terms))), np.zeros(len(names))
        order, rng = list(range(len(xs))), random.Random(int(how["seed"]))
        for epoch in range(int(how["epochs"])):
            rng.shuffle(order)
            rate = how["rate"] / math.sqrt(epoch + 1)
            w *= max(0.0, 1 - rate * how["l2"])
            for i in order:
                at, v = xs[i]
                z = bias + w[:, at] @ v
                p = np.exp(z - z.max())
                p /= p.sum()
                p[ys[i]] -= 1
                bias -= rate * p
                w[:, at] -= rate * np.outer(p, v)
        found = [(how["candidate"], y, f, float(x)) for k, y in enumerate(names) for f, x in [("", bias[k]), *zip(terms, w[k], strict=True)]]
        return pd.DataFrame(found, columns=["candidate", "label", "feature", "weight"])

    return rows.groupBy("candidate").applyInPandas(fit, "candidate string, label string, feature string, weight double")


#: The tag of a saved model, without which none is read.
FORMAT = "tracemill-linear-1"


def saved(model: DataFrame) -> str:
    """A fitted model as one JSON text: its tag and its rows in order. Models are small: a row per class and feature of a bounded sample."""
    rows = [list(r) for r in model.orderBy(*model.columns).collect()]
    return json.dumps({"format": FORMAT, "schema": json.loads(model.schema.json()), "rows": rows}, sort_keys=True)


def read_saved(spark, text: str) -> DataFrame:
    """The table of a saved model; another format is an error."""
    found = json.loads(text)
    if found.get("format") != FORMAT:
        raise ValueError("not a saved linear model")
    return spark.createDataFrame([tuple(r) for r in found["rows"]], T.StructType.fromJson(found["schema"]))


def linear_scores(model: DataFrame, vectors: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, candidate, label, p) of each key of ``rows``: softmax over a candidate's labels of bias plus weights.

    ``vectors`` has key, feature, value; a row without known features gets the softmax of the biases.
    """
    bias = model.where("feature = ''").select("candidate", "label", F.col("weight").alias("bias"))
    sums = vectors.join(model.where("feature <> ''"), "feature").groupBy(key, "candidate", "label").agg(F.sum(F.col("weight") * F.col("value")).alias("z"))
    every = rows.select(key).distinct().crossJoin(F.broadcast(bias))  # few classes
    z = every.join(sums, [key, "candidate", "label"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)) + F.col("bias"))
    w = Window.partitionBy(key, "candidate")
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return e.select(key, "candidate", "label", (F.col("e") / F.sum("e").over(w)).alias("p"))


def tfidf_scores(model: DataFrame, counts: DataFrame, known: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """As ``linear_scores`` of ``tfidf_vectors``, in one row of sums for each key: the sums are linear, so the norm divides them at the end.

    ``known`` and ``model`` are bounded: the one is broadcast with a feature's weights beside it, of the other the biases are literals.
    """
    classes = [tuple(r) for r in model.where("feature = ''").select("candidate", "label", "weight").orderBy("candidate", "label").collect()]
    own = [F.coalesce(F.sum(F.when((F.col("candidate") == c) & (F.col("label") == y), F.col("weight"))), F.lit(0.0)).alias(f"w{k}") for k, (c, y, _) in enumerate(classes)]
    weights = known.join(model.where("feature <> ''").groupBy("feature").agg(*own), "feature", "left").fillna(0.0)
    v = counts.join(F.broadcast(weights), "feature").withColumn("v", (F.ln("n") + 1) * F.col("idf"))
    sums = v.groupBy(F.col(key).alias("__key")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), *[F.sum(F.col("v") * F.col(f"w{k}")).alias(f"z{k}") for k in range(len(classes))])
    z = rows.select(key).distinct().join(sums, F.col(key) == F.col("__key"), "left")
    z = z.select(key, *[(F.coalesce(F.col(f"z{k}") / F.col("norm"), F.lit(0.0)) + F.lit(b)).alias(f"z{k}") for k, (_, _, b) in enumerate(classes)])
    beside = {k: [j for j, x in enumerate(classes) if x[0] == c] for k, (c, _, _) in enumerate(classes)}
    most = lambda k: F.array_max(F.array(*[F.col(f"z{j}") for j in beside[k]]))
    e = z.select(key, *[F.exp(F.col(f"z{k}") - most(k)).alias(f"e{k}") for k in range(len(classes))])
    p = [F.struct(F.lit(c).alias("candidate"), F.lit(y).alias("label"), (F.col(f"e{k}") / sum((F.col(f"e{j}") for j in beside[k]), F.lit(0.0))).alias("p")) for k, (c, y, _) in enumerate(classes)]
    return e.select(key, F.explode(F.array(*p)).alias("__x")).select(key, "__x.candidate", "__x.label", "__x.p")
