"""Queries of selection, ledgers, scans and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import governance
from tracemill.plans.registry import query, table


@query("SELECT \"window\", user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS \"window\" FROM events) GROUP BY ALL")
def accumulation_windows(spark, sf_dir):
    w = governance.accumulation_windows(table(spark, sf_dir, "events"), "user_id", "event_id", 16)
    return w.groupBy("window", "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_candidate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return governance.best(o, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"])


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def snapshot_prefix(spark, sf_dir):
    """Rows of an earlier ledger that a later one lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return governance.broken_prefix(d.where("doc_id % 3 = 0"), d.where("doc_id % 2 = 0"), "doc_id").select("doc_id")


@query("""
WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN concat(text, '!') ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT path, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'extra' ELSE 'changed' END AS problem FROM e FULL OUTER JOIN a USING (path) WHERE a.h IS DISTINCT FROM e.h
""")
def file_manifest_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return governance.expected_files(d.where("doc_id % 5 <> 0").select(path, F.sha2("text", 256).alias("sha256")), d.where("doc_id % 7 <> 0").select(path, F.sha2(changed, 256).alias("sha256")))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 9 = 4 OR label = 3")
def ordered_equality(spark, sf_dir):
    """Positions where two copies of a table differ: one has other labels and lacks some rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    other = e.where("vec_id % 9 <> 4").withColumn("label", F.when(F.col("label") == 3, 30).otherwise(F.col("label")))
    return governance.ordered_difference(e, other, "vec_id", ["label"])


@query("""
WITH s AS (SELECT vec_id AS record_id FROM embeddings WHERE vec_id % 2 = 0), p AS (SELECT vec_id AS record_id, label < 5 AS ok FROM embeddings WHERE vec_id % 4 = 0 UNION ALL SELECT vec_id, label > 6 FROM embeddings WHERE vec_id % 8 = 0)
SELECT record_id, count(ok) AS matches, CAST(coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END), 0) AS BIGINT) AS correct FROM s LEFT JOIN p USING (record_id) GROUP BY record_id
""")
def replay_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    record = F.col("vec_id").alias("record_id")
    stored = e.where("vec_id % 4 = 0").select(record, (F.col("label") < 5).cast("int").alias("correct")).union(e.where("vec_id % 8 = 0").select(record, (F.col("label") > 6).cast("int")))
    return governance.replay(e.where("vec_id % 2 = 0").select(record), stored)


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' OR doc_id = 7")
def case_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'de' or doc_id = 7").select("doc_id", "lang", "source")


@query("SELECT c.c_name, c.c_mktsegment, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def metadata_enrichment(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_name", "c_mktsegment", "n_name", "r_name")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def prefix_slice(spark, sf_dir):
    """The head of a table in source order; the limit is the feature."""
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(50).select("doc_id", "n_chars")


@query("SELECT l_orderkey, l_linenumber, coalesce(l_quantity, -1) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' UNION SELECT o_orderkey, -1, -1 FROM orders WHERE o_orderstatus = 'F'")
def split_union(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp '1995-01-01'").select("l_orderkey", "l_linenumber", F.coalesce("l_quantity", F.lit(-1.0)).alias("q"))
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).alias("l_linenumber"), F.lit(-1.0).alias("q"))
    return a.unionByName(b).distinct()


@query("""
WITH k AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS kinds FROM lineitem GROUP BY 1)
SELECT array_to_string(kinds, '|') AS combination, count(*) AS n, CAST(CASE len(kinds) WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END AS BIGINT) AS permutations, bool_and(list_has_all(['A', 'N', 'R'], kinds)) AS known FROM k GROUP BY kinds
""")
def combination_counts(spark, sf_dir):
    """Sets of flags per order: how often each occurs, its permutations, and whether only known flags are in it."""
    k = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("kinds"))
    known = F.forall("kinds", lambda x: x.isin("A", "N", "R"))
    return k.groupBy("kinds").agg(F.count("*").alias("n"), F.every(known).alias("known")).select(F.array_join("kinds", "|").alias("combination"), "n", F.factorial(F.size("kinds")).alias("permutations"), "known")


@query("""
WITH p AS (SELECT doc_id, CAST(quality AS DOUBLE) * 0.8 + 0.1 AS p FROM labels), d AS (SELECT doc_id, 1 - p AS f, p AS t FROM p)
SELECT doc_id, round(f, 4) AS p_false, round(t, 4) AS p_true, t >= 0.5 AS selected, CAST(json_array_length(to_json([f, t])) AS INTEGER) AS options FROM d
""")
def binary_distribution(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality").cast("double") * 0.8 + 0.1).alias("p"))
    m = p.withColumn("m", F.create_map(F.lit("false"), 1 - F.col("p"), F.lit("true"), F.col("p")))
    return m.select("doc_id", F.round(F.col("m")["false"], 4).alias("p_false"), F.round(F.col("m")["true"], 4).alias("p_true"), (F.col("p") >= 0.5).alias("selected"), F.size("m").alias("options"))


@query("SELECT event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY 1, 2")
def two_key_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id % 3 AS part, CAST(month(ts) AS INTEGER) AS m, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2, 3")
def three_key_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("part"), F.month("ts").alias("m")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT event_type) > 1 AS crossing FROM events GROUP BY user_id")
def crossing_count(spark, sf_dir):
    kinds = F.count_distinct("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), kinds.alias("kinds"), (kinds > 1).alias("crossing"))


@query("SELECT user_id, event_id, row_number() OVER w AS place, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def latest_before_row(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"), F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("last_purchase"))
