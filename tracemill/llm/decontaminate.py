"""Benchmark decontamination by a prefix-filtered set join.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. A window is ``WINDOW`` consecutive
words of an item; an item of fewer words, but not none, is one window. A window is the set of its shingles of
three words with their positions. All shingles of a window must be in a document that contains it, so with the
shingles ordered by rarity in the corpus the necessary prefix is the rarest one: only that one is joined. The
positional bound (the match must leave room for the window's words before it) and the length bound (and after
it) drop candidates; the rest are verified word by word against the words around the match.

Two passes over the texts. The first counts how often each item shingle stands in them, on hashes alone, summed
before they are shuffled; a shingle that stands nowhere rules its windows out. The second joins the prefixes, with
the words around each match. Where the keys are too many to be broadcast, it is (row, position, hash) that is
shuffled, and candidates go back to their texts for the words.

Defined cases: a null text has no words; a null item id counts as the empty string; rows of equal doc_id are
verified each against its own text; equal items and repeated windows count each item once; empty tables give
empty results or no hits; extra columns, also ones named as those used here, pass through.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import BROADCAST_ROWS, at_most, cut, fresh, small_side, table

WINDOW, SHINGLE = 10, 3
#: Shingles of the items that may be broadcast, eight bytes each.
BROADCAST_KEYS = 2_000_000
#: Stands for the end of a document among the hashes.
MARK = 0
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; A-Z is lower-cased, other letters are left as they are."""
    text = F.coalesce(text, F.lit(""))
    # lower() is fast on ASCII texts and would change others.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(low, _BREAK, -1), "")


def windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, ws, len, items, w): each distinct window, its words, the ids that have it, and its number."""
    w = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("ws"))
    return w.groupBy(F.array_join("ws", " ").alias("win"), "ws").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumns({"len": F.size("ws"), "w": F.monotonically_increasing_id()})


def _positions(df: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """keep, ws and, for each whole shingle of ``ws``, its place pos (from 0) and hash h; last a row of pos = size(ws) and h = ``MARK``."""
    df = df.select(*keep, "ws", F.concat(F.transform("ws", lambda w: F.xxhash64(w)), F.array(F.lit(0).cast("long"))).alias("hs"))
    # Outer, since for an inner one the optimiser adds a filter that finds the array a second time.
    rows = df.select(*keep, "ws", "hs", F.posexplode_outer("hs").alias("pos", "w0"))
    hashed = lambda n: F.when(F.col("pos") + n <= F.size("ws"), F.xxhash64(F.lit(n), "w0", *[F.get("hs", F.col("pos") + k) for k in range(1, n)]))
    first = F.when(F.col("pos") == F.size("ws"), F.lit(MARK)).otherwise(hashed(lengths[0]))
    if len(lengths) == 1:
        rows = rows.withColumn("h", first)
    else:
        rows = rows.withColumn("h", F.explode_outer(F.array(first, *[hashed(n) for n in lengths[1:]])))
    return rows.where("h is not null").select(*keep, "ws", "pos", "h")


def _prefixes(wins: DataFrame, rows: DataFrame, lengths: list[int], broadcast_keys: int) -> DataFrame:
    """(h, at, win, len, w): of each window that ``rows`` can hold, the rarest shingle and its place."""
    parts = [_positions(wins.where(F.least(F.lit(SHINGLE), F.col("len")) == n), ["win", "len", "w"], [n]) for n in lengths]
    own = cut(reduce(DataFrame.union, parts).where(F.col("h") != MARK).select("h", F.col("pos").alias("at"), "win", "len", "w"))
    keys = small_side(own.select("h").distinct(), broadcast_keys)
    rarity = cut(_positions(rows, [], lengths).select("h").join(keys, "h").groupBy("h").agg(F.count("*").alias("seen")))
    # A window with a shingle that occurs nowhere has the left join's null first, and goes.
    first = Window.partitionBy("win").orderBy(F.col("seen").asc_nulls_first(), "h", "at")
    return cut(own.join(rarity, "h", "left").withColumn("r", F.row_number().over(first)).where("r = 1 and seen is not null").select("h", "at", "win", "len", "w"))


def occurrences(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_keys: int = BROADCAST_KEYS, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc, text_key, n_words, start, len, w) of each place where a window stands, n_words null; and the windows by number.

    With ``every``, there is also a row of doc, text_key and n_words for each row of ``docs``.
    """
    wins = cut(windows(items, window=window))
    lengths = sorted(r[0] for r in wins.select(F.least(F.lit(SHINGLE), F.col("len")).alias("n")).distinct().collect()) or [SHINGLE]  # of 1, 2, 3
    rows = docs.select(F.col(doc).alias("doc"), text_key(F.col(text)), words(F.col(text)).alias("ws"))
    prefix = _prefixes(wins, rows.select("ws"), lengths, broadcast_keys)
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("len") <= F.size("ws"))
    exact = lambda start: F.array_join(F.slice("ws", start + 1, F.col("len")), " ") == F.col("win")
    if at_most(prefix, broadcast_keys // 10):
        if every:  # the last row of each document meets this one
            blank = {f.name: F.lit(MARK) if f.name == "h" else F.lit(None).cast(f.dataType) for f in prefix.schema}
            prefix = prefix.union(docs.sparkSession.range(1).select(*[c.alias(n) for n, c in blank.items()]))
        met = _positions(rows, ["doc", "text_key"], lengths).join(F.broadcast(prefix), "h")
        ends = F.col("at").isNull() & (F.col("pos") == F.size("ws"))
        return met.where(ends | fits & exact(F.greatest(start, F.lit(0)))).select("doc", "text_key", F.when(ends, F.size("ws")).cast("long").alias("n_words"), start.alias("start"), "len", "w"), wins
    # Hashes and places are shuffled; what meets a prefix goes back to its text for the words.
    met = _positions(rows, ["doc", "text_key"], lengths).select("doc", "text_key", "pos", "h", F.size("ws").alias("n")).join(prefix, "h")
    met = met.where((start >= 0) & (start + F.col("len") <= F.col("n"))).groupBy(F.col("doc").alias("d"), F.col("text_key").alias("k")).agg(F.collect_set(F.struct(start.alias("start"), "len", "win", "w")).alias("met"))
    held = docs.select(F.col(doc).alias("doc"), text_key(F.col(text)), F.col(text).alias("t")).join(small_side(cut(met)), F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    true = held.select("doc", "text_key", words(F.col("t")).alias("ws"), "met").select("doc", "text_key", "ws", F.explode_outer("met").alias("m")).select("doc", "text_key", "ws", "m.*").where(exact(F.col("start")))
    found = true.select("doc", "text_key", F.lit(None).cast("long").alias("n_words"), "start", "len", "w")
    return (found.unionByName(rows.select("doc", "text_key", F.size("ws").cast("long").alias("n_words")), allowMissingColumns=True) if every else found), wins


def _per_document(found: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc, text_key, n_hit, hit_items) from occurrences; ids come in once for each window of a document."""
    spans = F.transform(F.collect_set(F.struct("start", "len")), lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))
    # Rows of equal id and text are found once each; sets make them one.
    per_doc = cut(found.where("start is not null").groupBy("doc", "text_key").agg(F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"), F.collect_set("w").alias("ws")))
    named = per_doc.select("doc", "text_key", F.explode("ws").alias("w")).join(wins.select("w", "items"), "w")
    named = named.groupBy(F.col("doc").alias("d"), F.col("text_key").alias("k")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("hit_items"))
    return per_doc.join(named, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).select("doc", "text_key", "n_hit", "hit_items")


def hits(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc, text_key, n_hit, hit_items) of the documents that hold a window; text_key tells rows of equal id apart."""
    return _per_document(*occurrences(docs, items, doc, text, window, broadcast_keys))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")


def clean(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    own, key = fresh(docs, "__doc", "__key")
    held = cut(occurrences(docs, items, doc, text, window)[0].select(F.col("doc").alias(own), F.col("text_key").alias(key)).distinct())
    return docs.join(small_side(held, broadcast_rows), docs[doc].eqNullSafe(F.col(own)) & (text_key(docs[text]) == F.col(key)), "left_anti")


def report(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc, n_words, n_hit, hit_items) of every row of ``docs``; texts are not shuffled."""
    found, wins = occurrences(docs, items, doc, text, window, broadcast_keys, every=True)
    found = cut(found)
    narrow = found.where("n_words is not null").select("doc", "text_key", "n_words")
    held = cut(_per_document(found, wins)).withColumnsRenamed({"doc": "d", "text_key": "k"})
    out = narrow.join(small_side(held), narrow["doc"].eqNullSafe(F.col("d")) & (narrow["text_key"] == F.col("k")), "left")
    return out.select("doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"))


def op9_decontaminate(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
s AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS a FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[a:a + 9], ' ') AS win FROM s),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS a FROM d, lens WHERE len(ws) >= n),
occ AS (SELECT g.doc_id, g.a, g.n, w.item FROM (SELECT doc_id, a, n, array_to_string(ws[a:a + n - 1], ' ') AS win FROM g) g JOIN win w ON g.n = w.n AND g.win = w.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
