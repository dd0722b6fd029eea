"""Cases that once went wrong: side matter in pages, long tags, lone ids, shared windows, clashing names, rows without ids."""

import datetime
import random
import time

from pyspark.sql import functions as F

from tracemill.llm import decontaminate, html_extract, line_dedup, simhash, source_mix, url_filter, winnow
from tracemill.llm.html_extract import Page


def text_of(html):
    return [t for _, t in Page(html).kept()]


def test_side_matter_inside_and_outside_an_article():
    body = "<h1>Title</h1>" + "<p>A long paragraph of the text itself.</p>" * 4
    side = '<section id="comments"><p>first!</p></section><div class="ad">Buy now</div><div class="cookie-notice">We use cookies</div>'
    want = ["Title", *["A long paragraph of the text itself."] * 4]
    assert text_of(f"<article>{body}{side}</article>") == want
    assert text_of(f"<body>{body}{side}</body>") == want
    # A name on what holds the heading, or most of the text, says something else; parts of words say nothing.
    assert text_of(f'<body><div class="page with-sidebar">{body}</div>{side}</body>') == want
    assert text_of(f'<body><h1>Title</h1><div class="related ad">{"<p>A long paragraph of the text itself.</p>" * 4}</div></body>') == want
    assert text_of(f'<body>{body}<p class="gradient commentary">kept</p></body>') == [*want, "kept"]


def test_tags_of_many_quoted_values():
    many = " ".join(f'd{i}="a>b"' for i in range(5_000))
    assert text_of(f"<article><p {many}>text</p></article>") == ["text"]
    for piece in ("<a '\">' ", "<a b=\"c' ", "<a b='\">", '<p x="'):
        began = time.perf_counter()
        Page(piece * 40_000)
        assert time.perf_counter() - began < 20


def test_a_lone_id_far_away_widens_no_run(spark):
    ids = spark.range(20_000).union(spark.createDataFrame([(1 << 50,)], "id long"))
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    placed = winnow.with_next(docs)
    assert placed.where("closing").count() < 200
    assert winnow._width(docs.limit(0)) == winnow.ID_BITS
    assert winnow._width(docs.select((F.col("doc_id") * 1000).alias("doc_id"), "text").where("doc_id < 30000000")) > winnow.ID_BITS


def test_windows_that_many_items_share(spark):
    stem = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(f"i{k:04d}", f"{stem} own{k}") for k in range(300)], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"before {stem} after {k}") for k in range(20)], "doc_id long, text string")
    found, wins = decontaminate.occurrences(docs, items)
    assert "items" not in found.columns and found.count() == 20 and wins.count() == 301
    got = decontaminate.hits(docs, items).collect()
    assert len(got) == 20 and all(r["hit_items"] == [f"i{k:04d}" for k in range(300)] and r["n_hit"] == 10 for r in got)


CLASHES = ["__doc", "__key", "__drop", "__host", "__lines", "__hit", "__kept", "__u", "__t", "__row"]


def test_columns_of_any_name_pass_through(spark):
    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k l", "other words that stand here alone", None, ""]
    docs = spark.createDataFrame([(i, t, "s", *(f"{c}{i}" for c in CLASHES)) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES))
    items = spark.createDataFrame([("x", "a b c d e f g h i j")], "item_id string, text string")
    for out, n in ((decontaminate.clean(docs, items), 3), (simhash.keep_one(docs), 3), (line_dedup.drop_boilerplate(docs, host="source"), 5), (line_dedup.drop_boilerplate(docs, host="source", broadcast_rows=0), 5)):
        rows = out.collect()
        assert len(rows) == n and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)
    captures = docs.select(F.lit("http://a.example/x").alias("url"), F.lit(datetime.datetime(2024, 3, 1)).alias("fetched_at"), *CLASHES)
    entries = spark.createDataFrame([("l", "block", "domain", "a.example", "add", datetime.datetime(2024, 1, 1))], "list string, effect string, kind string, key string, action string, at timestamp")
    out = url_filter.evaluate(captures, entries)
    assert out.count() == 5 and set(CLASHES) < set(out.columns)


def test_line_sets_joined_one_by_one_equal_broadcast_ones(spark):
    rng = random.Random(4)
    lines = [f"line {k}" for k in range(30)]
    docs = spark.createDataFrame([(i, rng.choice(["a", "b", None]), rng.choice([None, "", "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))])) for i in range(200)], "doc_id long, source string, text string")
    one, two = (sorted(map(str, line_dedup.drop_boilerplate(docs, host="source", broadcast_rows=n).collect())) for n in (0, 10_000))
    assert one == two


def test_rows_without_ids_are_dealt_over_cells(spark):
    docs = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("two "), F.col("id").cast("string")).alias("text"))
    sized = source_mix.cut(docs.select("doc_id", "source", F.xxhash64("text").alias("__key"), F.lit(2).cast("long").alias("size")))
    assert sized.select(F.substring(F.md5(F.concat(F.lit("\n"), F.col("__key").cast("string"))), 1, source_mix.PREFIX).alias("c")).distinct().count() > 1_000
    out = source_mix.mix(docs)
    taken = out.agg(F.sum(F.col("copies") * F.col("size")), F.first("target")).first()
    assert out.count() == 3_000 and abs(taken[0] - taken[1]) <= 2 * 16
