"""Parquet shards: several files under their names, one schema for all, and strict scans."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_path(path: str) -> str:
    """A relative path that stays inside its folder; any other is an error."""
    p = PurePosixPath(path)
    if not path or p.is_absolute() or ".." in p.parts or "\\" in path:
        raise ValueError(f"not a path inside the folder: {path!r}")
    return str(p)


def confined(path: str, root: str) -> str:
    """``path`` under ``root`` with links followed; an error if it leads out."""
    from pathlib import Path

    found, base = (Path(root) / path).resolve(), Path(root).resolve()
    if found != base and base not in found.parents:
        raise ValueError(f"leads out of {root}: {path!r}")
    return str(found)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of the shards with ``file``, the name of each one's file."""
    rows = spark.read.parquet(*paths)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def schemas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(schema, shards): how many shards have each schema; one row where all agree. Only footers are read."""
    rows = [(p, spark.read.parquet(p).schema.simpleString()) for p in paths]
    return spark.createDataFrame(rows, "path string, schema string").groupBy("schema").agg(F.count("*").alias("shards"))


def manifest_problems(spark: SparkSession, manifest: list[dict], root: str) -> DataFrame:
    """(path, problem) of shards whose rows differ from the manifest's (path, rows), or that have another schema than the first."""
    found, first = [], None
    for entry in manifest:
        shard = spark.read.parquet(f"{root.rstrip('/')}/{safe_path(entry['path'])}")
        first = first or shard.schema.simpleString()
        if shard.schema.simpleString() != first:
            found.append((entry["path"], "schema"))
        if shard.count() != entry["rows"]:
            found.append((entry["path"], "rows"))
    return spark.createDataFrame(found, "path string, problem string")


def strict(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The named columns of ``rows``; fails when read if one of them is null, a key repeats, or there are no rows."""
    some = rows.select(*names)
    bad = some.groupBy(key).agg(F.count("*").alias("n"), F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in names], F.lit(0))).alias("nulls"))
    found = bad.agg(F.count("*").alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.max("nulls"), F.lit(0)).alias("nulls")).first()
    if not found["keys"]:
        raise ValueError("no records")
    if found["most"] > 1 or found["nulls"]:
        raise ValueError(f"{key} repeats or a field is null")
    return some
