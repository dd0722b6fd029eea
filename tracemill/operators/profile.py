"""Profiling aggregates: exact order statistics, duplicates, rates and overlaps.

Order statistics come from a histogram (one row per distinct value and key) and its running count. That is summed inside bins
of 1,024 values and from bin to bin, so no task holds a key's rows, and only sparse values let one hold its distinct values.
"""

from __future__ import annotations

from functools import reduce

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which sorted place stands for a fraction p of n values (0-based).
RULES = {
    "round": lambda n, p: F.rint((n - 1) * F.lit(p)),  # half to even
    "floor": lambda n, p: F.floor((n - 1) * F.lit(p)),
    "ceil": lambda n, p: F.ceil(n * F.lit(p)) - 1,
    "median_low": lambda n, p: F.floor((n - 1) / F.lit(2)) if p == 0.5 else F.floor((n - 1) * F.lit(p)),
}


def distribution(df: DataFrame, value: str, keys: list[str], fractions: dict[str, float], rule: str, digits: int = 2) -> DataFrame:
    """Per key: n, min, the named fractions, max and the rounded mean of a whole-number column; nulls are left out."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    hist = hist.withColumn("__b", F.shiftright(F.col("__v").cast("long"), 10))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    bins = hist.groupBy(*keys, "__b").agg(F.sum("__c").alias("__s"))
    bins = bins.withColumns({"__at": F.sum("__s").over(w.orderBy("__b")) - F.col("__s"), "__n": F.sum("__s").over(w)}).drop("__s").withColumnsRenamed({k: f"__{k}" for k in [*keys, "__b"]})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, "__b"]])
    inside = Window.partitionBy(*keys, "__b").orderBy("__v")
    cum = hist.join(bins, same).withColumn("__upto", F.col("__at") + F.sum("__c").over(inside))
    at = {name: F.min(F.when(F.col("__upto") > RULES[rule](F.col("__n"), p), F.col("__v"))).alias(name) for name, p in fractions.items()}
    mean = F.round(F.sum(F.col("__v") * F.col("__c")) / F.sum("__c"), digits).alias("mean")
    return cum.groupBy(*keys).agg(F.sum("__c").cast("long").alias("n"), F.min("__v").alias("min_v"), *at.values(), F.max("__v").alias("max_v"), mean)


def duplicates(df: DataFrame, *keys: Column) -> DataFrame:
    """One row: unique keys, groups of more than one row, rows in them, rows beyond the first, the largest group."""
    n = F.col("n")
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("unique_keys"),
        F.count_if(n > 1).alias("groups"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_groups"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("excess_rows"),
        F.coalesce(F.max(n), F.lit(0)).alias("largest"),
    )


def rate_by(df: DataFrame, over: Column, *keys: str) -> DataFrame:
    """Per key: rows, rows over, and their rate to six digits."""
    return df.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(over).alias("over")).withColumn("rate", F.round(F.try_divide("over", "candidates"), 6))


def required_rate(df: DataFrame, over: Column) -> DataFrame:
    """One row: rows, rows over, and their rate to six digits; fails when read if there are no rows."""
    counted = df.agg(F.count("*").alias("candidates"), F.count_if(over).alias("over"))
    return counted.withColumn("rate", F.when(F.col("candidates") == 0, F.raise_error(F.lit("no rows to take a rate of")).cast("double")).otherwise(F.round(F.try_divide("over", "candidates"), 6)))


def label_gap(df: DataFrame, labels: str, over: Column, options: DataFrame) -> DataFrame:
    """Per option: the rate of ``over`` among rows whose label set has it and among the others.

    Members are counted by exploding; the others follow by subtraction from the totals, so rows and options are
    never paired.
    """
    flagged = df.select(F.array_distinct(labels).alias("l"), over.cast("int").alias("o"))
    total = flagged.agg(F.count("*").alias("n"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_over")).first()
    members = flagged.select(F.explode_outer("l").alias("option"), "o").where("option is not null").groupBy("option").agg(F.count("*").alias("m"), F.sum("o").alias("m_over"))
    out = options.join(members, "option", "left").fillna(0, ["m", "m_over"])
    rest, rest_over = F.lit(total["n"]) - F.col("m"), F.lit(total["n_over"]) - F.col("m_over")
    return out.select("option", F.col("m").alias("members"), F.col("m_over").cast("long").alias("members_over"), rest.alias("others"), rest_over.cast("long").alias("others_over"), F.round(F.try_divide("m_over", "m") - F.try_divide(rest_over, rest), 6).alias("gap"))


def overlap_matrix(df: DataFrame, split: str, key: str) -> DataFrame:
    """Keys shared by each pair of splits; from each key's set of splits, not from a self-join."""
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where("size(s) > 1")
    pair = F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a as left_split, b as right_split))))")
    return sets.select(F.explode(pair).alias("p")).groupBy("p.left_split", "p.right_split").agg(F.count("*").alias("shared"))


def keep_first(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Rows with ``kept`` (first of its key in the order) and ``conflict`` (another label than the first's); nulls come first, a null key is a key.

    The first of a key is summed, not sorted, and joined to its rows, so a key of many rows is no task of its own. Rows of one key that are equal in the
    order are all kept; an id in the order tells them apart.
    """
    first = df.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(label).alias("label"))).alias("__first"))
    joined = df.join(first, F.col(key).eqNullSafe(F.col("__key")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__first.o{i}")) for i, c in enumerate(order)])
    return joined.withColumns({"kept": same, "conflict": ~F.col(label).eqNullSafe(F.col("__first.label"))}).drop("__key", "__first")
