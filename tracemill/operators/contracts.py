"""Contracts of predictions and inputs, as arrays of reasons or as checked projections."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import hashing


def _reasons(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules.items()]), lambda r: r.isNotNull())


def metric_reasons(df: DataFrame, labels: list[str], tolerance: float = 2e-6) -> DataFrame:
    """Adds ``reasons`` to record_id, gold_label, names and values: what a metric over fixed labels does not accept.

    The names must be the labels in their order; the values finite, not negative, and one in sum.
    """
    n = df.groupBy("record_id").agg(F.count("*").alias("__n"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    rules = {
        "record_id": F.coalesce("record_id", F.lit("")) == "",
        "repeated": F.col("__n") > 1,
        "gold_label": ~F.col("gold_label").isin(labels),
        "label_order": F.col("names") != F.array(*[F.lit(x) for x in labels]),
        "values": ~F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))),
        "sum": F.isnan(total) | (F.abs(total - 1) > tolerance),
    }
    return df.join(n, "record_id", "left").withColumn("reasons", _reasons(rules)).drop("__n")


def replay_reasons(df: DataFrame, labels: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Adds ``reasons`` to model_id, revision, elapsed_seconds, names and values: what a replay does not accept; names in any order."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    rules = {
        "model": blank("model_id") | blank("revision"),
        "elapsed": F.isnan("elapsed_seconds") | (F.col("elapsed_seconds") < 0) | (F.col("elapsed_seconds") == float("inf")),
        "labels": F.array_sort("names") != F.array(*[F.lit(x) for x in sorted(labels)]),
        "values": ~F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)),
        "sum": F.isnan(total) | (F.abs(total - 1) > tolerance),
    }
    return df.withColumn("reasons", _reasons(rules))


def renormalized(values: Column) -> Column:
    """The values over their sum, or null where that is not one but for each value's rounding to four digits."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.abs(total - 1) <= F.size(values) * 5e-5 + 1e-9, F.transform(values, lambda x: x / total))


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """An input of exactly these columns; any other, and any that lacks, is an error."""
    if set(df.columns) != set(names):
        raise ValueError(f"the columns must be {sorted(names)}, they are {sorted(df.columns)}")
    return df.select(*names)


def model_digest(*fields: Column) -> Column:
    """The digest of what a model sees; metadata is not among it, so it can't bear on it."""
    return F.sha2(F.concat_ws("\x1e", *[F.coalesce(f.cast("string"), F.lit("\x1f")) for f in fields]), 256)


def without_key(key: str):
    """A UDF that takes a key out of a JSON text at every depth; canonical JSON, null if it doesn't parse."""

    def drop(v):
        if isinstance(v, dict):
            return {k: drop(x) for k, x in v.items() if k != key}
        return [drop(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (c := hashing.canonical(t)) is None else json.dumps(drop(json.loads(c)), sort_keys=True, separators=(",", ":")))

    return run
