"""Profiling queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import models, neardup, profile
from tracemill.plans.registry import query, table


def _places(rule: str, p: float) -> str:
    return {"round": f"round_even((n - 1) * {p}, 0)", "floor": f"floor((n - 1) * {p})", "median_low": f"floor((n - 1) * {p})", "ceil": f"ceil(n * {p}) - 1"}[rule]


def _distribution_sql(source: str, value: str, key: str, rule: str, fractions: dict[str, float], digits: int = 2) -> str:
    at = ", ".join(f"s[CAST({_places(rule, p)} AS BIGINT) + 1] AS {k}" for k, p in fractions.items())
    return f"WITH l AS (SELECT {key}, list_sort(list({value})) AS s, count({value}) AS n, round(avg({value}), {digits}) AS mean FROM {source} GROUP BY 1) SELECT {key}, n, s[1] AS min_v, {at}, s[-1] AS max_v, mean FROM l"


@query(_distribution_sql("documents", "n_chars", "source", "round", {"p50": 0.5, "p95": 0.95}))
def nearest_rank_round(spark, sf_dir):
    return profile.distribution(table(spark, sf_dir, "documents"), "n_chars", ["source"], {"p50": 0.5, "p95": 0.95}, "round")


@query(_distribution_sql("documents", "n_chars", "lang", "round", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}))
def quantiles_round(spark, sf_dir):
    return profile.distribution(table(spark, sf_dir, "documents"), "n_chars", ["lang"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, "round")


@query(_distribution_sql("documents", "n_chars", "lang", "round", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, 3).replace("documents", "(SELECT * FROM documents WHERE source IS NOT NULL)"))
def quantiles_fine(spark, sf_dir):
    """As ``quantiles_round``, of rows with a source, with the mean to three digits."""
    return profile.distribution(table(spark, sf_dir, "documents").where("source is not null"), "n_chars", ["lang"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, "round", digits=3)


@query(_distribution_sql("documents", "n_chars", "lang", "floor", {"p50": 0.5, "p95": 0.95}))
def nearest_rank_floor(spark, sf_dir):
    return profile.distribution(table(spark, sf_dir, "documents"), "n_chars", ["lang"], {"p50": 0.5, "p95": 0.95}, "floor")


@query(_distribution_sql("lineitem", "CAST(l_partkey AS BIGINT)", "l_returnflag", "median_low", {"p50": 0.5, "p95": 0.95}))
def median_low(spark, sf_dir):
    return profile.distribution(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_returnflag"], {"p50": 0.5, "p95": 0.95}, "median_low")


@query("""
WITH l AS (SELECT event_type, list_sort(list(CAST(round(value * 1000) AS BIGINT))) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, s[CAST(ceil(n * 0.95) AS BIGINT)] AS p95, (s[(n + 1) // 2] + s[n // 2 + 1]) / 2.0 AS median FROM l
""")
def latency_summary(spark, sf_dir):
    """Median (mean of the middle two) and nearest-rank 95th percentile."""
    e = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 1000).cast("long").alias("v"))
    hist = e.groupBy("event_type", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    cum = hist.withColumns({"upto": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)})
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v")))
    return cum.groupBy("event_type").agg(F.max("n").alias("n"), at(F.ceil(F.col("n") * 0.95)).alias("p95"), ((at(F.expr("(n + 1) div 2")) + at(F.expr("n div 2 + 1"))) / 2.0).alias("median"))


@query("SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (n_chars > {b}) AS over_{b}, round(100.0 * count(*) FILTER (n_chars > {b}) / count(*), 2) AS pct_{b}" for b in (512, 768, 1024)) + " FROM documents GROUP BY source")
def threshold_exceedance(spark, sf_dir):
    n = F.count("*")
    cols = [c for b in (512, 768, 1024) for c in (F.count_if(F.col("n_chars") > b).alias(f"over_{b}"), F.round(100 * F.count_if(F.col("n_chars") > b) / n, 2).alias(f"pct_{b}"))]
    return table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("n"), *cols)


@query("SELECT source, lang, count(*) AS candidates, count(*) FILTER (n_chars > 1024) AS over, round(count(*) FILTER (n_chars > 1024) / count(*), 6) AS rate FROM documents GROUP BY source, lang")
def over_budget_by_key(spark, sf_dir):
    return profile.rate_by(table(spark, sf_dir, "documents"), F.col("n_chars") > 1024, "source", "lang")


@query("SELECT count(*) AS candidates, count(*) FILTER (n_chars > 1024) AS over, round(count(*) FILTER (n_chars > 1024) / count(*), 6) AS rate FROM documents")
def required_rate(spark, sf_dir):
    """The rate over all rows; without any, the job fails rather than giving one."""
    return profile.required_rate(table(spark, sf_dir, "documents"), F.col("n_chars") > 1024)


_OPTIONS = ["the", "of", "der", "que", "les", "xyzzy"]


@query(f"""
WITH o AS (SELECT unnest({_OPTIONS}) AS option), d AS (SELECT n_chars > 1024 AS big, regexp_extract_all(lower(text), '[a-z0-9_./:-]+') AS l FROM documents),
t AS (SELECT option, big, list_contains(l, option) AS m FROM d, o),
a AS (SELECT option, count(*) FILTER (m) AS members, count(*) FILTER (m AND big) AS members_over, count(*) FILTER (NOT m) AS others, count(*) FILTER (NOT m AND big) AS others_over FROM t GROUP BY option)
SELECT *, round(members_over / nullif(members, 0) - others_over / nullif(others, 0), 6) AS gap FROM a
""")
def label_rate_gap(spark, sf_dir):
    options = spark.createDataFrame([(o,) for o in _OPTIONS], "option string")
    labels = F.array_intersect(text.probe_tokens(F.col("text")), F.array(*[F.lit(o) for o in _OPTIONS]))
    return profile.label_gap(table(spark, sf_dir, "documents"), labels, F.col("n_chars") > 1024, options)


_DUPLICATES = """count(*) AS unique_keys, count(*) FILTER (n > 1) AS groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_groups,
CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows, coalesce(max(n), 0) AS largest"""


@query(f"SELECT {_DUPLICATES} FROM (SELECT count(*) AS n FROM documents GROUP BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))")
def duplicate_summary(spark, sf_dir):
    return profile.duplicates(table(spark, sf_dir, "documents"), F.sha2(text.task_family(F.col("text")), 256).alias("k"))


@query(f"SELECT {_DUPLICATES} FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)")
def duplicate_stats(spark, sf_dir):
    return profile.duplicates(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_partkey"))


@query("""
WITH j AS (SELECT sha256(d.text) AS k, d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT *, row_number() OVER w AS i, first_value(quality) OVER w AS q FROM j WINDOW w AS (PARTITION BY k ORDER BY doc_id))
SELECT count(*) FILTER (i = 1) AS kept, count(*) FILTER (i > 1) AS dropped, count(*) FILTER (quality <> q) AS conflicts FROM r
""")
def keep_first_dedup(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("k")).join(table(spark, sf_dir, "labels"), "doc_id")
    r = profile.keep_first(j, "k", ["doc_id"], "quality")
    return r.agg(F.count_if(F.col("kept")).alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.count_if(F.col("conflict")).alias("conflicts"))


@query("""
SELECT event_type, user_id % 5 AS shard, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(grouping(event_type, user_id % 5) AS BIGINT) AS level
FROM events GROUP BY GROUPING SETS ((event_type, user_id % 5), (event_type), (user_id % 5), ())
""")
def multi_grouping_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 5).withColumn("ok", F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    return e.cube("event_type", "shard").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"), F.grouping_id().alias("level"))


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) AS token, doc_id FROM documents) SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, min(doc_id), token LIMIT 30")
def most_common(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(text.probe_tokens(F.col("text"))).alias("token")).where("token is not null")
    return w.groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(F.col("n").desc(), "first", "token").limit(30).select("token", "n")


@query("SELECT doc_id, sha256(concat('sample', chr(10), CAST(doc_id AS VARCHAR))) AS h FROM documents ORDER BY h LIMIT 12")
def hash_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("sample\n"), F.col("doc_id").cast("string")), 256).alias("h")).orderBy("h").limit(12)


@query("SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source")
def stratified_min_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))


@query("SELECT source, doc_id FROM documents WHERE n_chars < 400 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def first_examples(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").where("n_chars < 400").select("source", "doc_id", F.row_number().over(w).alias("r")).where("r <= 3").drop("r")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def set_collect(spark, sf_dir):
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"), F.count_distinct("event_type").alias("n"))


@query("SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def ordered_digest(spark, sf_dir):
    """A digest per group over its sorted ids; the group's ids stand in one row."""
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sha2(F.array_join(ids, "\n"), 256).alias("digest"))


_GATES = [
    ("ids_unique", "count(*) = count(DISTINCT doc_id)"),
    ("texts_present", "count(*) = count(text)"),
    ("lengths_agree", "sum(CASE WHEN {length} = n_chars THEN 0 ELSE 1 END) = 0"),
    ("enough_rows", "count(*) >= 500"),
    ("few_duplicates", "count(DISTINCT text) >= 0.99 * count(*)"),
]


@query("WITH g AS (SELECT " + ", ".join(f"{sql.format(length='length(text)')} AS {name}" for name, sql in _GATES) + " FROM documents) " + " UNION ALL ".join(f"SELECT '{name}' AS name, {name} AS passed FROM g" for name, _ in _GATES) + " UNION ALL SELECT 'all', " + " AND ".join(name for name, _ in _GATES) + " FROM g")
def gate_table(spark, sf_dir):
    g = table(spark, sf_dir, "documents").agg(*[F.expr(sql.format(length="char_length(text)")).alias(name) for name, sql in _GATES])
    rows = [F.struct(F.lit(name).alias("name"), F.col(name).alias("passed")) for name, _ in _GATES]
    every = F.struct(F.lit("all").alias("name"), F.expr(" AND ".join(name for name, _ in _GATES)).alias("passed"))
    return g.select(F.explode(F.array(*rows, every)).alias("g")).select("g.name", "g.passed")


@query("SELECT event_type, count(*) AS n, count(k) AS parsed, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def json_props_typed(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("parsed"), F.sum("k").alias("total"))


@query(r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li\s*>', 1)) AS INTEGER) AS n, sha256(array_to_string(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li\s*>', 1), chr(10))) AS digest FROM pages")
def tag_payloads(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("f")).select("page_id", F.size("f").alias("n"), F.sha2(F.array_join("f", "\n"), 256).alias("digest"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')"


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS token FROM documents), d AS (SELECT token, count(*) AS df FROM w GROUP BY token HAVING count(*) >= 2) SELECT token, df, row_number() OVER (ORDER BY df DESC, token) AS rank FROM d ORDER BY df DESC, token LIMIT 4000")
def token_vocabulary(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode_outer(F.array_distinct(text.word_tokens(F.col("text")))).alias("token")).where("token is not null")
    top = w.groupBy("token").agg(F.count("*").alias("df")).where("df >= 2").orderBy(F.col("df").desc(), "token").limit(4000)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("df").desc(), "token")).cast("long"))


@query(f"""
WITH t AS (SELECT doc_id, {_WORDS} AS t FROM documents), g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1]))) AS gram FROM t)
SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 20
""")
def ngram_counts(spark, sf_dir):
    # Tokens are a column first: inside the n-gram lambda they would be found again for every position.
    t = table(spark, sf_dir, "documents").select(text.word_tokens(F.col("text")).alias("t"))
    g = t.select(F.explode_outer(text.ngrams(F.col("t"), 2)).alias("gram")).where("gram is not null")
    return g.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 20")


@query(f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS c FROM w GROUP BY ALL),
d AS (SELECT token, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY token HAVING count(*) >= 2),
x AS (SELECT doc_id, token, (1 + ln(c)) * idf AS w FROM c JOIN d USING (token))
SELECT doc_id, count(*) AS terms, round(sqrt(sum(w * w)), 6) AS norm, round(max(w) / sqrt(sum(w * w)), 6) AS top FROM x GROUP BY doc_id
""")
def tfidf_l2(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = models.term_counts(d.select("doc_id", text.word_tokens(F.col("text")).alias("t")), "doc_id", "t")
    norm = F.sqrt("squares")
    return models.tfidf_norms(c, "doc_id", d.count(), 2).select("doc_id", "terms", F.round(norm, 6).alias("norm"), F.round(F.col("top") / norm, 6).alias("top"))


def word_sets(spark, sf_dir):
    """(doc_id, split, tokens) of the documents: their distinct words."""
    b = F.col("doc_id") % 10
    return table(spark, sf_dir, "documents").select("doc_id", F.when(b < 8, "train").when(b < 9, "dev").otherwise("test").alias("split"), F.array_remove(F.array_distinct(F.split(text.task_family(F.col("text")), " ")), "").alias("tokens"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 10 AS b, list_sort(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))) AS s FROM documents),
k AS (SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'dev' ELSE 'test' END AS split, s FROM d WHERE s <> [''])
SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard
FROM k a JOIN k b ON a.split <> b.split AND a.doc_id < b.doc_id AND len(a.s) * 100 >= 85 * len(b.s) AND len(b.s) * 100 >= 85 * len(a.s)
WHERE len(list_intersect(a.s, b.s)) * 100 >= 85 * len(list_distinct(list_concat(a.s, b.s)))
""")
def near_duplicate_cross_split(spark, sf_dir):
    return neardup.cross_split_pairs(word_sets(spark, sf_dir), "doc_id", "split", "tokens", 85)


@query("""
WITH RECURSIVE d AS (SELECT doc_id, doc_id % 10 AS b, list_sort(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))) AS s FROM documents),
k AS (SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'dev' ELSE 'test' END AS split, s FROM d WHERE s <> ['']),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, a.split <> b.split AS across FROM k a JOIN k b ON a.doc_id <> b.doc_id AND len(a.s) * 100 >= 85 * len(b.s) AND len(b.s) * 100 >= 85 * len(a.s)
  WHERE len(list_intersect(a.s, b.s)) * 100 >= 85 * len(list_distinct(list_concat(a.s, b.s)))),
r AS (SELECT doc_id, doc_id AS other FROM k UNION SELECT r.doc_id, p.y FROM r JOIN p ON p.x = r.other)
SELECT r.doc_id, min(other) AS class_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links FROM r LEFT JOIN (SELECT x, count(*) FILTER (across) AS n FROM p GROUP BY x) c ON c.x = r.doc_id GROUP BY r.doc_id
""")
def near_duplicate_classes(spark, sf_dir):
    """Of every document its class of similar word sets and the number of documents of other splits that it is similar to, without pairs of copies."""
    return neardup.classes(word_sets(spark, sf_dir), "doc_id", "split", "tokens", 85).withColumnRenamed("id", "doc_id")


@query("SELECT d.doc_id, b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) >= 24")
def target_string_leak(spark, sf_dir):
    return neardup.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 24)
