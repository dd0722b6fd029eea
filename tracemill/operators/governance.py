"""Selection rules, ledgers over time and replay: the relational part of running experiments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accumulation_windows(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Rows of each key in groups of ``size`` by their order; the last may be short."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("window", F.floor(place / size).cast("long"))


def best(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def seed_count(projected_seconds: float, left_seconds: float, reserve: float = 1.25) -> int:
    """Two seeds if both fit what is left with a reserve, else one; an error if none does."""
    each = projected_seconds * reserve
    if not math.isfinite(each) or each <= 0 or each > left_seconds:
        raise ValueError("not even one seed fits")
    return 2 if 2 * each <= left_seconds else 1


def broken_prefix(earlier: DataFrame, later: DataFrame, position: str) -> DataFrame:
    """Rows of ``earlier`` that ``later`` lacks or has otherwise at their position; none if it only extends it."""
    names = [c for c in earlier.columns if c != position]
    a, b = earlier.alias("a"), later.alias("b")
    same = F.col(f"a.{position}") == F.col(f"b.{position}")
    for c in names:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left_anti")


def expected_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem): missing, extra or changed files, from (path, sha256) on both sides."""
    e, a = expected.select("path", F.col("sha256").alias("e")), actual.select("path", F.col("sha256").alias("a"))
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") != F.col("e"), "changed")
    return e.join(a, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null")


def ordered_difference(a: DataFrame, b: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Positions where two ordered tables differ in any column, or that one of them lacks."""
    x, y = a.select(position, F.struct(*columns).alias("x")), b.select(position, F.struct(*columns).alias("y"))
    return x.join(y, position, "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select(position)


def replay(suite: DataFrame, stored: DataFrame) -> DataFrame:
    """(record_id, case, matches): cases with their stored predictions, one row per prediction; cases without keep 0.

    Predictions of records that are no case fail the job when they are read.
    """
    extra = stored.join(suite.select("record_id"), "record_id", "left_anti").limit(1).count()
    if extra:
        raise ValueError("a stored prediction belongs to no case")
    return suite.join(stored.groupBy("record_id").agg(F.count("*").alias("matches"), F.sum("correct").alias("correct")), "record_id", "left").fillna(0, ["matches", "correct"])
