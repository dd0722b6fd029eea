"""A corpus pipeline over the training-text operators.

Stages, in order: the quality classifier drops documents it rejects; line dedup drops boilerplate lines of each
source; near-dedup keeps one document of each group, linked by shingles of 5 words with a Jaccard index of 0.8 or more or
by SimHash; decontamination drops documents that hold a window of
a benchmark item; mixing deals the rest out to target weights, one row per copy. Each stage takes
(spark, docs, sf_dir) and works on all rows its predecessor kept; the cases its operator defines hold here too.

SQL expresses neither the classifier nor the covering hash, so ``ORACLE_SQL`` is None and the tests hold the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, line_dedup, near_copies, quality, source_mix
from tracemill.llm.common import cut, table, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.add_score(docs, model, out="__score").where(F.col("__score") >= quality.THRESHOLD).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that had nothing else goes, and n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs.select(COLUMNS), host="source")
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where((F.col("n_dropped") == 0) | (F.trim("text") != "")).select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles (Jaccard index 0.8 or more) or by SimHash."""
    return near_copies.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, numbered by ``copy`` from 1, with the document's columns.

    Rows equal in id and text share their copies evenly, rounded up.
    """
    # The text stays with its row: sizes, ranks and copies are found on narrow rows and joined back.
    rows = docs.select(COLUMNS).withColumn("__key", F.xxhash64("text"))
    copied = source_mix.copies(cut(rows.select("doc_id", "__key", "source", word_count(F.col("text")).alias("size"))))
    taken = copied.groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__k")).agg(F.ceil(F.sum("copies") / F.count("*")).cast("int").alias("n")).where("n > 0")
    out = rows.join(taken, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["__key"] == F.col("__k"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(*COLUMNS, "copy")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mix_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
