"""JSON-lines sources: numbered lines, good and bad rows apart, validated loads, random access to a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators.records import record_reasons


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line, blank ones included, numbered from 1 within its file.

    Files are split and read in parallel: a line's number is its place in its block plus the lines of the blocks
    before it, so only one count per block is ever gathered.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("at") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def parsed(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Adds ``row`` and ``reason``: 'invalid_json' where the line is no JSON object of the schema; blank lines go."""
    rows = lines.where(F.trim(value) != "").withColumn("row", F.from_json(value, schema, {"mode": "PERMISSIVE"}))
    valid = F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))
    return rows.withColumn("reason", F.when(~valid, "invalid_json")).withColumn("row", F.when(valid, F.col("row")))


def strict(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """As ``parsed`` but a bad line fails the job when it is read."""
    rows = parsed(lines, schema, value)
    return rows.withColumn("row", F.when(F.col("reason").isNull(), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("invalid JSON at line "), F.col("line").cast("string"))).cast(rows.schema["row"].dataType)))


def validated(lines: DataFrame, value: str = "value") -> DataFrame:
    """(file, line, value) of records that all are valid; else, or if there is none, an error that names places and reasons."""
    rows = lines.where(F.trim(value) != "")
    bad = rows.withColumn("reasons", record_reasons(value)).where("size(reasons) > 0").orderBy("file", "line").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file']}:{r['line']}: {','.join(r['reasons'])}" for r in bad))
    if not rows.limit(1).count():
        raise ValueError("no records")
    return rows.select("file", "line", value)


def decoded(df: DataFrame, state: str = "state", others: tuple[str, ...] = ("questions", "gold")) -> DataFrame:
    """The columns as variants: a state that is no JSON is a string; another column that is none is null, and named in ``reason``."""
    plain = F.expr(f"variant_get(parse_json(to_json(struct({state} AS s))), '$.s', 'variant')")
    kept = {state: F.coalesce(F.try_parse_json(state), plain)}
    bad = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNotNull() & F.try_parse_json(c).isNull(), c) for c in others]), lambda x: x.isNotNull()), ",")
    return df.withColumn("reason", F.nullif(bad, F.lit(""))).withColumns(kept | {c: F.try_parse_json(c) for c in others})


def objects(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines, each of which must be a JSON object; any other fails the job when it is read."""
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json(value)), F.lit(""))
    where = F.concat_ws(":", "file", F.col("line").cast("string"))
    return lines.where(F.trim(value) != "").withColumn(value, F.when(kind.startswith("OBJECT"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("no JSON object at "), where))))


def source_line(lines: DataFrame, number: int) -> DataFrame:
    """One line and the digest of its bytes with the newline."""
    return lines.where(F.col("line") == number).select("line", "value", F.sha2(F.concat("value", F.lit("\n")), 256).alias("sha256"))


def frozen(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The lines of a file whose bytes have the digest; fails before decoding if they have another."""
    whole = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest"))
    checked = whole.select(F.when(F.col("digest") == sha256, F.decode("content", F.lit("UTF-8"))).otherwise(F.raise_error(F.lit("digest differs"))).alias("t"))
    return checked.select(F.posexplode(F.split("t", "\n")).alias("i", "value")).select((F.col("i") + 1).cast("long").alias("line"), "value").where("value <> ''")


def walk(df: DataFrame, column: str, depth: int) -> DataFrame:
    """(id, path, value) of every scalar of a JSON column down to ``depth``; list places read '[]'."""
    level = df.select("id", F.lit("").alias("path"), F.try_parse_json(column).alias("v"))
    out = None
    for _ in range(depth + 1):
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = level.where(~inner | kind.isNull()).select("id", "path", F.expr("cast(v as string)").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level.createOrReplaceTempView("__walk")
        step = "SELECT id, concat(path, CASE WHEN key IS NULL THEN '[]' ELSE concat(CASE WHEN path = '' THEN '' ELSE '.' END, key) END) AS path, value AS v FROM __walk, LATERAL variant_explode(v)"
        level = df.sparkSession.sql(step)
    return out
