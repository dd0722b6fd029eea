"""Intermediate tables that are computed once, and sides of joins that are broadcast only after a count."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when a count has shown it to have at most so many rows.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of ``spark.checkpoint.dir``, or the one set on the context.

    Where neither is set, a local session gets a temporary one; on a cluster, whose executors would each write to a
    disk of their own, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="tracemill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that it is computed once and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table: compressed, and later reads take only the columns that they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if its counted size allows; else as it is, for a shuffled join."""
    return F.broadcast(df) if at_most(df, rows) else df
