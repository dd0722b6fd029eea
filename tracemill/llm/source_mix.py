"""Mix sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies r = target / source size. Documents
stand in a fixed order (size in steps of 16 words, then md5 of the id), the expected copies are prefix-summed
along it, one random offset per source is added, and a copy is emitted for each integer boundary crossed.
Ordering by size first makes the words taken, not only the documents, come near the target.

The prefix sums are exact and distributed: rows are numbered inside (source, size step, md5 prefix) cells,
and the cells' offsets are summed from counts, so no source is ever in one task.

Defined cases: a null text has size 0; a null source is a source, sorted last; null ids sort first; documents
of equal id are numbered in an order that does not matter, since they are interchangeable but for size; an
empty table gives an empty table; a source of size 0 has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import cut, small_side, table, word_count

#: Weights dealt to the sources in order; share of all words asked for; most repeats of a source.
WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
STEP, PREFIX, SEED = 16, 3, "mix"


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, capped, excess reshared.

    Capping and resharing until nothing is above its cap has one fixed point: target = min(cap, level * weight).
    Sources are sorted by cap / weight and the level is that of the first whose cap holds it, the highest of those whose caps do. This works
    on one row per source.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(order) - 1) % n + 1).cast("long"))
    w = w.withColumn("cap", F.lit(most) * F.col("source_size"))
    # cap/w ascending, compared as whole numbers: all w divide the product of the weights.
    product = 1
    for x in weights:
        product *= x
    below = Window.orderBy(F.expr(f"cap * (bigint({product}) div w)"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    w = (
        w.withColumn("full", F.coalesce(F.sum("cap").over(below), F.lit(0)))
        .withColumn("used_w", F.coalesce(F.sum("w").over(below), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("level", (F.col("all_size") * share_percent - F.col("full") * 100).cast("double") / ((F.col("all_w") - F.col("used_w")) * 100).cast("double"))
        .withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))).over(everything))
    )
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def offset(source, seed: str = SEED):
    """A number in [0, 1) drawn once per source."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}\n"), F.coalesce(source, F.lit("\n"))), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and ``copies`` to a checkpointed table with doc_id, source, size and __key, a hash that deals out rows without an id."""
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\n"), F.col("__key").cast("string")), F.lit(""))
    rows = sized.withColumns({"__step": F.expr(f"size div {STEP}"), "__md5": F.md5(drawn.cast("binary"))})
    rows = rows.withColumn("__cell", F.substring("__md5", 1, PREFIX))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, most)
    goal = goal.withColumn("__u", offset(F.col("source"), seed)).withColumnRenamed("source", "__src")
    cells = rows.groupBy("source", "__step", "__cell").agg(F.count("*").alias("n"))
    steps = cells.groupBy("source", "__step").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("step_at", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    steps = steps.join(small_side(cut(goal)), F.col("source").eqNullSafe(F.col("__src"))).drop("__src")
    inside = Window.partitionBy("source", "__step").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_at", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n")
    key = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    cells = cells.alias("c").join(steps.alias("s"), key("c", "s", ["source", "__step"])).select("c.source", "c.__step", "c.__cell", (F.col("cell_at") + F.col("step_at")).alias("__at"), "source_size", "target", "__u")
    local = Window.partitionBy("source", "__step", "__cell").orderBy("__md5", "doc_id", "size")
    ranked = rows.withColumn("__rank", F.row_number().over(local))
    placed = ranked.alias("r").join(cells.alias("c"), key("r", "c", ["source", "__step", "__cell"])).select(*[F.col(f"r.{c}") for c in ranked.columns], "__at", "source_size", "target", "__u")
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size").cast("double"))
    rank = (F.col("__at") + F.col("__rank")).cast("double")
    crossed = F.floor(rate * rank + F.col("__u")) - F.floor(rate * (rank - 1) + F.col("__u"))
    return placed.withColumn("copies", crossed.cast("long")).drop("__step", "__md5", "__cell", "__rank", "__at", "__u")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and copies of every document."""
    return copies(cut(docs.select("doc_id", "source", F.xxhash64("text").alias("__key"), word_count(F.col("text")).alias("size"))), **how).drop("__key")


def op8_source_mix(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
x AS (SELECT *,
  coalesce(sum(cap) OVER (ORDER BY cap * (10 // w), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_caps,
  coalesce(sum(w) OVER (ORDER BY cap * (10 // w), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_w,
  sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w FROM w),
y AS (SELECT *, CAST(all_size * 150 - full_caps * 100 AS DOUBLE) / CAST((all_w - used_w) * 100 AS DOUBLE) AS lvl FROM x),
z AS (SELECT *, max(CASE WHEN cap >= lvl * w THEN lvl END) OVER () AS water FROM y),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(water * w, CAST(cap AS DOUBLE))) AS target,
  CAST(CAST(concat('0x', substr(sha256(concat('mix', chr(10), coalesce(source, chr(10)))), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM z),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
  CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / CAST(t.source_size AS DOUBLE) END AS rate,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size // 16, md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size) AS DOUBLE) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * rank + u) - floor(rate * (rank - 1) + u) AS BIGINT) * size AS taken FROM r
"""
