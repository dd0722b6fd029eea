"""Helpers shared by the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.shared import BROADCAST_ROWS, at_most, cut, shared_folder, small_side, stored

__all__ = ["BROADCAST_ROWS", "NOT_SPACE", "at_most", "cut", "fresh", "shared_folder", "small_side", "stored", "table", "word_count"]

#: Words of the contracts: runs of anything but ASCII white space.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores more as it takes that ``df`` has no such column."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")
