"""Document fingerprints by winnowing.

Words (white-space separated) give k-gram hashes; of each window of ``WINDOW`` consecutive k-grams the least
hash is chosen, the rightmost on ties, and kept with its position. Two texts that share ``K + WINDOW - 1`` words
in a row share at least one chosen hash (the match guarantee).

A chosen k-gram is one positive long: 32 bits of hash above 31 bits that fall as the position rises, so the
least long is the least hash, rightmost on ties. Window minima come from three rounds of doubling.

Defined cases: a null text is empty; a text without words has an empty fingerprint; one of fewer than K words
has one gram, all its words; fewer than WINDOW grams make one window; two empty fingerprints have likeness 1. Documents
stand by descending id, null ids last, equal ids by a hash of the text and then the text; after the last comes the
first, and a single one follows itself. Equal rows are rows each; an empty table gives none; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import at_most, small_side, table

K, WINDOW = 5, 8
_MAXPOS = (1 << 31) - 1
#: Documents are dealt by runs of ids that hold about so many rows (a power of two), to find each one's neighbour in order.
ID_BITS = 9
#: A run of more rows than this, of null or repeated ids, is dealt further by its texts' hashes.
HEAVY = 4 << ID_BITS
#: Chains of at most so many keys are ordered in one task.
CHAIN_ROWS = 50_000


def chosen(grams_of: Column) -> Column:
    """Chosen (hash, position) longs of an array of word hashes."""
    h = grams_of
    n = F.size(h)
    full = F.transform(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), lambda i: F.shiftleft(F.xxhash64(*[F.get(h, i + j) for j in range(K)]).bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(_MAXPOS).cast("long") - i.cast("long")))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(full)


def with_fingerprint(df: DataFrame, text: str, out: str, hashes: str) -> DataFrame:
    """Adds ``out``, the chosen longs of column ``text`` in order, and ``hashes``, their distinct hashes."""
    df = df.withColumn("__h", F.transform(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), ""), lambda w: F.xxhash64(w)))
    df = df.withColumn("__m", chosen(F.col("__h")))
    step = 1
    while step < WINDOW:
        df = df.withColumn("__m", F.zip_with("__m", F.slice("__m", step + 1, F.greatest(F.size("__m"), F.lit(1))), lambda a, b: F.least(a, b)))
        step *= 2
    df = df.withColumn(out, F.array_distinct(F.slice("__m", F.lit(1), F.greatest(F.size("__m") - (WINDOW - 1), F.lit(1)))))
    df = df.withColumn(hashes, F.array_distinct(F.transform(out, lambda m: F.shiftright(m, 31))))
    return df.drop("__h", "__m")


def as_text(longs: str) -> Column:
    """Chosen grams as 'hash:position', comma-joined."""
    one = lambda m: F.concat(F.lower(F.hex(F.shiftright(m, 31))), F.lit(":"), (F.lit(_MAXPOS).cast("long") - m.bitwiseAND(F.lit(_MAXPOS).cast("long"))).cast("string"))
    return F.array_join(F.transform(longs, one), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / F.greatest(every, F.lit(1)))


def following(keys: DataFrame) -> DataFrame:
    """(k, next): of distinct longs, the next lower one; null for the lowest. Runs by runs while they are many."""
    if at_most(keys, CHAIN_ROWS):
        return keys.withColumn("next", F.lead("k").over(Window.orderBy(F.col("k").desc())))
    runs = keys.withColumn("run", F.shiftright("k", ID_BITS))
    heads = runs.groupBy("run").agg(F.max("k").alias("head"))
    chain = following(heads.select(F.col("run").alias("k")))
    after = chain.join(heads.withColumnRenamed("head", "next_head"), chain["next"] == heads["run"], "left").select(F.col("k").alias("run"), "next_head")
    inside = F.lead("k").over(Window.partitionBy("run").orderBy(F.col("k").desc()))
    return runs.withColumn("inside", inside).join(after, "run").select("k", F.coalesce("inside", "next_head").alias("next"))


def _width(docs: DataFrame) -> int:
    """Bits of the ids in a run: the least with which runs that have rows have half of ``ID_BITS`` worth of them on average.

    Runs are counted by their ids, so that single ids far away from all others are runs of their own and widen no other.
    """
    widths = [*range(ID_BITS, 52, 2), 52]
    n, *runs = docs.where("doc_id is not null").agg(F.count("doc_id"), *[F.approx_count_distinct(F.shiftright("doc_id", b)) for b in widths]).first()
    return next((b for b, k in zip(widths, runs, strict=True) if k << (ID_BITS - 1) <= n), 52) if n else ID_BITS


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h, run, part, closing): the documents and, in each (run, part), a closing row with the text that follows it.

    The order is descending id (null ids last), then h, a hash of the text, then text; after the last comes the first.
    """
    bits = _width(docs)
    lowest = F.lit(-(1 << (63 - bits)) - 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"h": F.shiftrightunsigned(F.xxhash64("text"), 1), "run": F.coalesce(F.shiftright("doc_id", bits), lowest)})
    # Parts of a heavy run: by id, and by as many bits of the hash as leave about a run's rows in each.
    heavy = rows.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    heavy = heavy.select(F.col("run").alias("heavy_run"), F.least(F.ceil(F.log2(F.col("n") * 4 / HEAVY)).cast("int"), F.lit(62 - bits)).alias("b"))
    mask = (1 << bits) - 1
    placed = F.expr(f"shiftleft({mask}L - coalesce(doc_id & {mask}L, {mask}L), b) | shiftright(h, 63 - b)")
    rows = rows.join(small_side(heavy), F.col("run") == F.col("heavy_run"), "left").withColumn("part", F.when(F.col("b").isNull(), F.lit(0).cast("long")).otherwise(placed)).drop("heavy_run", "b")
    heads = rows.groupBy("run", "part").agg(F.min_by("text", F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "h", "text")).alias("text"))
    parts = heads.select("run", "part").withColumn("inside", F.lead("part").over(Window.partitionBy("run").orderBy("part")))
    firsts = parts.groupBy("run").agg(F.min("part").alias("first"))
    chain = following(firsts.select(F.col("run").alias("k")))
    top = firsts.agg(F.max("run")).first()[0]
    after = chain.select(F.col("k").alias("run"), F.coalesce("next", F.lit(top).cast("long")).alias("next_run")).join(firsts.select(F.col("run").alias("next_run"), "first"), "next_run")
    ends = parts.join(after, "run").select("run", "part", F.when(F.col("inside").isNull(), F.col("next_run")).otherwise(F.col("run")).alias("r"), F.coalesce("inside", "first").alias("p"))
    closing = ends.join(heads.select(F.col("run").alias("r"), F.col("part").alias("p"), "text"), ["r", "p"]).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), "run", "part", F.lit(True).alias("closing"))
    return rows.withColumn("closing", F.lit(False)).unionByName(closing)


def op6_winnow(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return with_edited(table(spark, sf_dir, "documents"))


def with_edited(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, n_chars, digest of the edited text, both fingerprints, and their likeness to each other and the next row's."""
    docs = docs.select("doc_id", "text")
    rows = with_fingerprint(with_next(docs).repartition("run", "part"), "text", "fp", "hs")
    w = Window.partitionBy("run", "part").orderBy("closing", F.col("doc_id").desc_nulls_last(), "h", "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_hs": F.lead("hs").over(w)}).where("not closing")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.expr("int(n_chars div 2)"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - half)"), F.expr("substring(next_text, 1, half)"))).drop("next_text", "text", "half")
    rows = with_fingerprint(rows, "edited", "efp", "ehs")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"), likeness("hs", "ehs").alias("near_edited"), likeness("hs", "next_hs").alias("near_next"))
