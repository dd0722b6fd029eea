"""Queries of sweeps, detectors, parity and dataset checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import hashing, text
from tracemill.operators import gates, sweep
from tracemill.plans import traces
from tracemill.plans.evaluation import predictions
from tracemill.plans.registry import query, table

_WORDS = r"len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}'))"


@query(f"""
WITH d AS (SELECT lang, {_WORDS} AS t, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS f FROM documents),
g AS (SELECT b, lang, count(*) AS n, count(*) FILTER (t <= b - 97) AS r, count(*) FILTER (t <= b - 97 AND f) AS u FROM d, (SELECT unnest([512, 640, 768, 1024]) AS b) GROUP BY ALL),
s AS (SELECT b, sum(n) AS n, sum(r) AS r, sum(u) AS u, round(sum(r) / sum(n), 6) AS retention, round(max(r / n) - min(r / n), 6) AS gap FROM g GROUP BY b),
p AS (SELECT *, retention >= 0.7 AND gap <= 0.2 AS passed FROM s)
SELECT CAST(b AS INTEGER) AS budget, CAST(n AS BIGINT) AS candidates, CAST(r AS BIGINT) AS retained, CAST(u AS BIGINT) AS unique_retained, retention, gap, passed, coalesce(b = (SELECT min(b) FROM p WHERE passed), false) AS chosen FROM p
""")
def budget_sweep(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("k"), F.size(text.word_tokens(F.col("text"))).alias("t"))
    return sweep.with_choice(sweep.sweep(d, "k", "doc_id", "t", "lang", S.BUDGETS, 97), 0.7, 0.2)


@query(rf"""
SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '{S.REDACTED}')) AS redacted,
  count(*) FILTER (regexp_matches(text, '{S.OUTPUT_LIKE}')) AS output_like,
  count(*) FILTER (regexp_matches(text, '{S.REASONING_MARKER}')) AS reasoning,
  CAST(sum(len(regexp_extract_all(text, '[^\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+'))) AS BIGINT) AS words
FROM documents GROUP BY source
""")
def text_detectors(spark, sf_dir):
    has = lambda p: F.count_if(F.col("text").rlike(p))
    d = table(spark, sf_dir, "documents").groupBy("source")
    return d.agg(F.count("*").alias("n"), has(S.REDACTED).alias("redacted"), has(S.OUTPUT_LIKE).alias("output_like"), has(S.REASONING_MARKER).alias("reasoning"), F.sum(text.whitespace_words(F.col("text"))).cast("long").alias("words"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM v), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
q AS (SELECT vec_id, p, list_transform(p, lambda x: round(x, 3)) AS r FROM p)
SELECT count(*) AS n, round(max(list_max(list_transform(range(1, 11), lambda i: abs(p[i] - r[i])))), 6) AS max_difference, count(*) FILTER (list_position(p, list_max(p)) = list_position(r, list_max(r))) AS same_choice FROM q
""")
def prediction_parity(spark, sf_dir):
    """Stored predictions against the same rounded to three digits."""
    p = predictions(spark, sf_dir).withColumn("r", F.transform("p", lambda x: F.round(x, 3)))
    worst = F.array_max(F.zip_with("p", "r", lambda a, b: F.abs(a - b)))
    return p.agg(F.count("*").alias("n"), F.round(F.max(worst), 6).alias("max_difference"), F.count_if(text.argmax(F.col("p")) == text.argmax(F.col("r"))).alias("same_choice"))


@query("""
WITH r AS (SELECT conv_id, turn, role, lead(role) OVER w AS nxt, length(text) % 4 AS calls, lead(length(text) % 3) OVER w AS results FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT count(*) AS pairs, CAST(sum(least(calls, results)) AS BIGINT) AS linked FROM r WHERE role = 'assistant' AND nxt = 'user'
""")
def adjacent_pair_count(spark, sf_dir):
    """Calls of a turn that the results of the next can answer: the smaller count, summed."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.char_length("text")
    r = table(spark, sf_dir, "conversations").select("role", F.lead("role").over(w).alias("nxt"), (n % 4).alias("calls"), F.lead(n % 3).over(w).alias("results"))
    return r.where("role = 'assistant' and nxt = 'user'").agg(F.count("*").alias("pairs"), F.sum(F.least("calls", "results")).alias("linked"))


@query(f"""
WITH {traces._GROUPS}, x AS (SELECT task_group, {traces._SPLIT} AS split, conv_id FROM s)
SELECT 'groups_cross' AS name, count(*) = 0 AS passed, count(*) AS n FROM (SELECT task_group FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'ids_repeat', count(*) = 0, count(*) FROM (SELECT conv_id FROM x GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'task_missing', count(*) = 0, count(*) FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM x))
UNION ALL SELECT 'target_in_prefix', count(*) = 0, count(*) FROM conversations c WHERE role = 'assistant' AND length(text) >= 24 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.text = c.text)
""")
def dataset_checks(spark, sf_dir):
    """(name, passed, n): checks that a verified dataset must pass, each one aggregate."""
    c = table(spark, sf_dir, "conversations")
    x = traces.grouped(c)
    w = Window.partitionBy("conv_id", F.sha2("text", 256)).orderBy("turn")
    found = {
        "groups_cross": x.groupBy("task_group").agg(F.count_distinct("split").alias("k")).where("k > 1"),
        "ids_repeat": x.groupBy("conv_id").count().where("count > 1"),
        "task_missing": c.select("conv_id").distinct().join(x, "conv_id", "left_anti"),
        "target_in_prefix": c.withColumn("r", F.row_number().over(w)).where("role = 'assistant' and char_length(text) >= 24 and r > 1"),
    }
    return gates.checks(found)


@query(f"SELECT doc_id, concat('t2d-i3-', substr(sha256(concat(CAST(doc_id AS VARCHAR), chr(10), source)), 1, 32)) AS id, {traces.bucket_sql(S.SPLIT_SEED_3WAY, 'sha256(text)')} AS bucket FROM documents")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.stable_id("t2d-i3-", F.col("doc_id").cast("string"), F.col("source")).alias("id"), hashing.bucket(S.SPLIT_SEED_3WAY, F.sha2("text", 256)).alias("bucket"))
