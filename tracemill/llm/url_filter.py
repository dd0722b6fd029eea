"""URL filters as a temporal list join.

Dated list entries (add or remove a key) become validity intervals; each capture is evaluated against the
entries active at its fetch time: an as-of join of (key, fetch time) with (key, [valid_from, valid_to)).

Keys of a URL: ``host`` (exact), ``domain`` (the host and each parent of two labels or more), ``prefix``
(host plus path up to each slash) and ``url`` (without fragment). Entries have a list, an effect
(block or allow), a kind, a key, an action (add or remove) and a time.

To keep the join from pairing every capture of a key with every interval of it, both sides carry a bucket of
``BUCKET_DAYS`` days: captures have one, intervals one per bucket they touch. Intervals of one key and list do
not overlap, so a capture meets at most one per list and key. Equal (url, time) captures are evaluated once.

Defined cases: a null or unparsable URL, or a null time, matches nothing and is not blocked; two entries of one
key at one time: an add beats a remove; an entry of null key or time is ignored; an allow beats a block;
repeated captures keep their rows; extra columns pass through, but for
those named as the results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import BROADCAST_ROWS, cut, fresh, small_side, table

BUCKET_DAYS = 30


def intervals(entries: DataFrame) -> DataFrame:
    """(list, effect, kind, key, valid_from, valid_to) from dated entries; valid_to is null while open."""
    by = ["list", "effect", "kind", "key"]
    state = entries.where("key is not null and at is not null").groupBy(*by, "at").agg(F.max(F.col("action") == "add").alias("on"))
    w = Window.partitionBy(*by).orderBy("at")
    # Repeated adds or removes change nothing; only switches bound an interval.
    state = state.withColumn("was", F.lag("on", 1, False).over(w)).where(F.col("on") != F.col("was"))
    return state.withColumn("valid_to", F.lead("at").over(w)).where("on").select(*by, F.col("at").alias("valid_from"), "valid_to")


def url_keys(url):
    """Array of (kind, key) of a URL column."""
    host = F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit("."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    labels = F.split(host, r"\.", -1)
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    parents = F.transform(F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: i < F.size(labels)), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.split(path, "/", -1)
    # Parts are '' before the first slash, then the segments; a prefix ends at each slash.
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: pair("prefix", F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    exact = F.array(pair("host", host), pair("url", F.regexp_replace(url, "#.*$", "")))
    return F.when((host == "") | url.isNull(), F.array().cast("array<struct<kind:string,key:string>>")).otherwise(F.concat(exact, parents, prefixes))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``captures`` with n_rules (active rules that match), rules (sorted, 'list:effect:kind:key') and blocked."""
    probes = captures.select(F.col(url).alias("u"), F.col(at).alias("t")).where("u is not null and t is not null").distinct()
    span = captures.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    bucket = lambda c: F.expr(f"unix_date(cast({c} as date)) div {BUCKET_DAYS}")
    active = intervals(entries).withColumns({"first": F.greatest(F.col("valid_from"), F.lit(span["a"])), "last": F.least(F.coalesce(F.col("valid_to"), F.lit(span["b"])), F.lit(span["b"]))})
    active = cut(active.where("first <= last").withColumn("bucket", F.explode(F.sequence(bucket("first"), bucket("last")))).drop("first", "last"))
    keyed = probes.withColumn("bucket", bucket("t")).withColumn("k", F.explode(url_keys(F.col("u")))).select("u", "t", "bucket", "k.kind", "k.key")
    hits = keyed.join(small_side(active, broadcast_rows), ["kind", "key", "bucket"]).where("valid_from <= t and (valid_to is null or t < valid_to)")
    rule = F.concat_ws(":", "list", "effect", "kind", "key")
    u, t = fresh(captures, "__u", "__t")
    verdict = hits.groupBy(F.col("u").alias(u), F.col("t").alias(t)).agg(F.array_join(F.array_sort(F.collect_set(rule)), "\n").alias("rules"), F.count_distinct(rule).alias("n_rules"), (F.max(F.col("effect") == "block") & ~F.max(F.col("effect") == "allow")).alias("blocked"))
    captures = captures.drop("rules", "n_rules", "blocked")
    out = captures.join(verdict, (captures[url] == F.col(u)) & (captures[at] == F.col(t)), "left").drop(u, t)
    return out.withColumns({"rules": F.coalesce("rules", F.lit("")), "n_rules": F.coalesce("n_rules", F.lit(0)).cast("long"), "blocked": F.coalesce("blocked", F.lit(False))})


#: Rules by hand beside those derived from the hosts: (list, effect, kind, key, action, day of the year 2024).
RULES = [
    ("manual", "block", "domain", "example.org", "add", 40),
    ("manual", "block", "domain", "example.org", "remove", 120),
    ("manual", "block", "prefix", "tionsh.example.net/en/", "add", 10),
    ("manual", "block", "prefix", "tionsh.example.net/en/", "remove", 60),
    ("manual", "block", "prefix", "tionsh.example.net/en/", "add", 200),
    ("partners", "allow", "host", "m.thther.example.org", "add", 80),
    ("partners", "allow", "host", "m.thther.example.org", "remove", 300),
    ("partners", "allow", "domain", "tionsh.example.net", "add", 220),
]


def derived_entries(pages: DataFrame) -> DataFrame:
    """The tables have no list, so one is made: a third of the hosts are listed, delisted, and some listed again."""
    spark = pages.sparkSession
    hosts = pages.select(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)).alias("key")).where("key <> ''").distinct()
    h = F.conv(F.substring(F.sha2("key", 256), 1, 6), 16, 10).cast("long")
    plan = hosts.withColumn("h", h).where("h % 3 = 0").withColumn("d", F.expr("int(h div 3 % 200)"))
    events = F.array(
        F.struct(F.lit("add").alias("action"), F.col("d").alias("day")),
        F.struct(F.lit("remove").alias("action"), (F.col("d") + 60).alias("day")),
        F.when(F.col("h") % 2 == 0, F.struct(F.lit("add").alias("action"), (F.col("d") + 150).alias("day"))),
    )
    made = plan.withColumn("e", F.explode(F.filter(events, lambda e: e.isNotNull()))).select(F.lit("derived").alias("list"), F.lit("block").alias("effect"), F.lit("host").alias("kind"), "key", "e.action", "e.day")
    manual = spark.createDataFrame(RULES, "list string, effect string, kind string, key string, action string, day int")
    return made.union(manual).withColumn("at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, day)")).drop("day")


def op1_url_filter(spark, sf_dir) -> DataFrame:
    """Every page, fetched at a time derived from its id: page_id, url, fetched_at, n_rules, rules, blocked."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id * 7919 % 366 as int), cast(page_id % 24 as int))"))
    return evaluate(captures, derived_entries(pages)).select("page_id", "url", "fetched_at", "n_rules", "rules", "blocked")


OP1_SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 7919 % 366 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) AS fetched_at,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS key FROM pages),
h AS (SELECT key, CAST(concat('0x', substr(sha256(key), 1, 6)) AS BIGINT) AS h FROM hosts WHERE key <> ''),
p AS (SELECT key, h, CAST(h // 3 % 200 AS INTEGER) AS d FROM h WHERE h % 3 = 0),
entries AS (
  SELECT 'derived' AS list, 'block' AS effect, 'host' AS kind, key, 'add' AS action, d AS day FROM p
  UNION ALL SELECT 'derived', 'block', 'host', key, 'remove', d + 60 FROM p
  UNION ALL SELECT 'derived', 'block', 'host', key, 'add', d + 150 FROM p WHERE h % 2 = 0
  UNION ALL SELECT * FROM (VALUES
    ('manual', 'block', 'domain', 'example.org', 'add', 40), ('manual', 'block', 'domain', 'example.org', 'remove', 120),
    ('manual', 'block', 'prefix', 'tionsh.example.net/en/', 'add', 10), ('manual', 'block', 'prefix', 'tionsh.example.net/en/', 'remove', 60),
    ('manual', 'block', 'prefix', 'tionsh.example.net/en/', 'add', 200),
    ('partners', 'allow', 'host', 'm.thther.example.org', 'add', 80), ('partners', 'allow', 'host', 'm.thther.example.org', 'remove', 300),
    ('partners', 'allow', 'domain', 'tionsh.example.net', 'add', 220))),
state AS (SELECT list, effect, kind, key, TIMESTAMP '2024-01-01' + to_days(day) AS eff, bool_or(action = 'add') AS is_on FROM entries GROUP BY ALL),
sw AS (SELECT *, lag(is_on, 1, false) OVER (PARTITION BY list, effect, kind, key ORDER BY eff) AS was FROM state),
iv AS (SELECT *, lead(eff) OVER (PARTITION BY list, effect, kind, key ORDER BY eff) AS valid_to FROM sw WHERE is_on <> was),
keys AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS key FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'url', regexp_replace(url, '#.*$', '') FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'domain', unnest(list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'prefix', unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: concat(host, array_to_string(string_split(path, '/')[1:i], '/'), '/'))) FROM captures WHERE host <> ''),
hits AS (
  SELECT k.page_id, concat_ws(':', i.list, i.effect, i.kind, i.key) AS rule, i.effect FROM keys k JOIN iv i
  ON k.kind = i.kind AND k.key = i.key AND i.is_on AND i.eff <= k.fetched_at AND (i.valid_to IS NULL OR k.fetched_at < i.valid_to)),
v AS (SELECT page_id, string_agg(DISTINCT rule, chr(10) ORDER BY rule) AS rules, count(DISTINCT rule) AS n_rules,
  bool_or(effect = 'block') AND NOT bool_or(effect = 'allow') AS blocked FROM hits GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, CAST(coalesce(v.n_rules, 0) AS BIGINT) AS n_rules, coalesce(v.rules, '') AS rules, coalesce(v.blocked, false) AS blocked
FROM captures c LEFT JOIN v USING (page_id)
"""
