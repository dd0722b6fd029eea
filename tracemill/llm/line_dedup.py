"""Drop boilerplate lines: lines that a large share of one host's pages carry.

Pages are grouped by host. For each line, the host's *distinct* pages containing it are divided by the
host's distinct pages; lines above the ratio are dropped from every page of that host. Pages with equal
text count once, so a document copied a thousand times does not turn its own lines into boilerplate.

Defined cases: a null host is a host of its own; a null text stays null and has no lines; lines that are
empty after trimming spaces are never counted or dropped; hosts where a line is on fewer than
``min_pages`` distinct pages keep it (a host of one page would otherwise lose everything); repeated rows stay
repeated; extra columns pass through unchanged, but for ones named n_lines or n_dropped, which are replaced; an empty
table gives an empty table. Line keys are 64-bit hashes of the trimmed line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import BROADCAST_ROWS, at_most, cut, fresh, table

#: Share of a host's distinct pages above which a line is boilerplate, and the least number of such pages.
RATIO, MIN_PAGES = 0.05, 5


def _trimmed(text):
    return F.transform(F.split(text, "\n", -1), lambda line: F.trim(line))


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_key, n_pages, host_pages) of the lines that exceed ``ratio``."""
    # The empty line stands for the page itself: its count is the host's number of distinct pages.
    seen = (
        pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
        .where(F.col("text").isNotNull())
        .select("host", F.xxhash64("text").alias("page_key"), F.explode_outer(F.array_distinct(F.concat(F.array(F.lit("")), _trimmed(F.col("text"))))).alias("line"))
        .select("host", "page_key", F.when(F.col("line") != "", F.xxhash64("line")).alias("line_key"))
    )
    counts = seen.groupBy("host", "line_key").agg(F.count_distinct("page_key").alias("n_pages")).where(F.col("n_pages") >= F.when(F.col("line_key").isNull(), 1).otherwise(min_pages))
    counts = cut(counts)
    totals = counts.where("line_key is null").select(F.col("host").alias("h"), F.col("n_pages").alias("host_pages"))
    return counts.where("line_key is not null").join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages")).select("host", "line_key", "n_pages", "host_pages")


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``; adds ``n_lines`` and ``n_dropped``.

    A host has at most (lines per page / ratio) boilerplate lines, so its set fits in one row. The sets are
    broadcast when a count shows that all lines are few; else each text's lines are joined to them one by one, by host and
    line, and a page's row gets the lines that it has.
    """
    own, drop, lines, hit, kept, key = fresh(pages, "__host", "__drop", "__lines", "__hit", "__kept", "__key")
    found = cut(boilerplate(pages, host, text, ratio, min_pages).select("host", "line_key"))
    trimmed = lambda line: F.xxhash64(F.trim(line))
    if at_most(found, broadcast_rows):
        sets = found.groupBy(F.col("host").alias(own)).agg(F.collect_set("line_key").alias(drop))
        joined = pages.join(F.broadcast(sets), pages[host].eqNullSafe(F.col(own)), "left").withColumn(lines, F.split(F.col(text), "\n", -1))
        # The page's own lines among the host's, found by a hash set; few, so that each line is held against few.
        joined = joined.withColumn(hit, F.array_intersect(F.transform(lines, trimmed), F.col(drop))).drop(drop)
    else:
        # The lines of each text meet the host's, and only those that both have come back to the pages.
        each = pages.select(F.col(host).alias("h"), F.xxhash64(text).alias("k"), F.explode_outer(F.array_distinct(F.transform(F.split(F.col(text), "\n", -1), trimmed))).alias("l")).where("l is not null").distinct()
        hits = each.join(found, F.col("h").eqNullSafe(F.col("host")) & (F.col("l") == F.col("line_key"))).groupBy(F.col("h").alias(own), F.col("k").alias(key)).agg(F.collect_set("l").alias(hit))
        joined = pages.join(hits, pages[host].eqNullSafe(F.col(own)) & (F.xxhash64(pages[text]) == F.col(key)), "left").drop(key).withColumn(lines, F.split(F.col(text), "\n", -1))
    rest = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col(hit), trimmed(line)))
    joined = joined.withColumn(kept, F.when(F.coalesce(F.size(hit), F.lit(0)) == 0, F.col(lines)).otherwise(rest))
    return (
        joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col("n_dropped") == 0, F.col(text)).otherwise(F.array_join(kept, "\n")))
        .drop(own, lines, hit, kept)
    )


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    """Every document with its source as host: doc_id, source, n_lines, n_dropped, text without boilerplate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, host="source").select("doc_id", "source", "n_lines", "n_dropped", "text")


OP7_SQL = """
WITH seen AS (
  SELECT DISTINCT source, text, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))) AS line
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(DISTINCT text) AS host_pages FROM documents WHERE text IS NOT NULL GROUP BY source),
bad AS (
  SELECT s.source, s.line FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.line <> '' GROUP BY s.source, s.line, t.host_pages
  HAVING count(*) >= 5 AND count(*) > 0.05 * t.host_pages),
sets AS (SELECT source, list(line) AS drop_lines FROM bad GROUP BY source),
cut AS (
  SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS lines,
    list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(s.drop_lines, []), trim(x, ' '))) AS kept
  FROM documents d LEFT JOIN sets s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NULL THEN NULL WHEN len(lines) = len(kept) THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
"""
