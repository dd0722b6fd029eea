"""Budget sweeps: what each token budget keeps, how evenly, and the smallest budget that passes its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep(candidates: DataFrame, key: str, order: str, tokens: str, group: str, budgets: tuple[int, ...], envelope: int) -> DataFrame:
    """Per budget: candidates, retained, distinct retained, retention, and the widest gap of retention between groups.

    A candidate fits if its tokens are at most the budget less the envelope. One pass: every candidate is counted for
    all budgets at once, first per group and then over the groups. Of rows with one key the first in the order counts
    as distinct.
    """
    firsts = candidates.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    flagged = candidates.join(firsts, F.col(key).eqNullSafe(F.col("__key"))).select(F.col(group).alias("g"), F.col(tokens).alias("t"), F.col(order).eqNullSafe(F.col("__first")).alias("first"))
    fits = {b: F.col("t") <= b - envelope for b in budgets}
    per = flagged.groupBy("g").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"r{b}") for b, c in fits.items()], *[F.count_if(c & F.col("first")).alias(f"u{b}") for b, c in fits.items()])
    one = [F.struct(F.lit(b).alias("budget"), F.col(f"r{b}").alias("r"), F.col(f"u{b}").alias("u")) for b in budgets]
    long = per.select("g", "n", F.explode(F.array(*one)).alias("x")).select("g", "n", "x.*")
    return long.groupBy("budget").agg(
        F.sum("n").alias("candidates"), F.sum("r").alias("retained"), F.sum("u").alias("unique_retained"),
        F.round(F.sum("r") / F.sum("n"), 6).alias("retention"), F.round(F.max(F.col("r") / F.col("n")) - F.min(F.col("r") / F.col("n")), 6).alias("gap"),
    )


def with_choice(swept: DataFrame, least_retention: float, widest_gap: float) -> DataFrame:
    """Adds ``passed`` (both gates) and ``chosen`` (the smallest budget that passes)."""
    d = swept.withColumn("passed", (F.col("retention") >= least_retention) & (F.col("gap") <= widest_gap))
    smallest = F.min(F.when(F.col("passed"), F.col("budget"))).over(Window.partitionBy(F.lit(1)))
    return d.withColumn("chosen", F.coalesce(F.col("budget") == smallest, F.lit(False)))
