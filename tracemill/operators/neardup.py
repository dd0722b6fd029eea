"""Near-duplicates across splits and exact containment, without pairing everything with everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import graph, parts
from tracemill.operators.shared import stored

#: Word pairs that may be broadcast, and short items that are looked for in one pass.
KEYS, NEEDLES = 200_000, 500


def _linked(df: DataFrame, key: str, split: str, tokens: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, split, node) of the rows with tokens, (node, n) of their distinct sets, and (x, y, i, u) of the similar ones, x before y."""
    rows = stored(df.select(F.col(key).alias("id"), F.col(split).alias("split"), F.array_sort(tokens).alias("s")).where("size(s) > 0").withColumn("key", F.unhex(F.sha2(F.array_join("s", " "), 256))))
    # Numbers are given where the sets are written, once; from there on a node is 8 bytes.
    nodes = stored(rows.groupBy("key").agg(F.first("s").alias("s")).withColumn("node", F.monotonically_increasing_id()))
    placed = stored(rows.select("id", "split", "key").join(nodes.select("key", "node"), "key").select("id", "split", "node"))
    return placed, nodes.select("node", F.size("s").alias("n")), parts.similar(nodes.select("node", "s"), percent)


def cross_split_pairs(df: DataFrame, key: str, split: str, tokens: str, percent: int) -> DataFrame:
    """(left_id, right_id, jaccard) of rows in different splits whose token sets have a Jaccard index of ``percent``/100 or more.

    Equal sets are one node, so copies meet in pairs only in the result; where copies are many, ``classes`` says the same without pairs.
    """
    rows, nodes, links = _linked(df, key, split, tokens, percent)
    links = links.union(links.select("y", "x", "i", "u")).union(nodes.select("node", F.col("node").alias("n2"), "n", F.col("n").alias("m")))
    left = rows.select(F.col("id").alias("left_id"), F.col("split").alias("ls"), F.col("node").alias("x"))
    right = rows.select(F.col("id").alias("right_id"), F.col("split").alias("rs"), F.col("node").alias("y"))
    return links.join(left, "x").join(right, "y").where("ls <> rs and left_id < right_id").select("left_id", "right_id", F.round(F.col("i") / F.col("u"), 6).alias("jaccard"))


def first_pairs(df: DataFrame, key: str, split: str, tokens: str, percent: int, most: int) -> DataFrame:
    """(left_id, right_id): the first ``most`` of ``cross_split_pairs`` in order, without the others.

    A row stands on the left of a pair if a similar set has a greater id of another split, so greatest ids of sets and splits tell
    the rows that do; the first ``most`` of these have as many pairs, and only they are joined with rows.
    """
    rows, nodes, links = _linked(df, key, split, tokens, percent)
    each_way = stored(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).union(nodes.select("node", F.col("node").alias("y"))))
    top = rows.groupBy(F.col("node").alias("y"), F.col("split").alias("rs")).agg(F.max("id").alias("top"))
    beyond = each_way.join(top, "y").groupBy(F.col("x").alias("at"), "rs").agg(F.max("top").alias("top"))
    left = stored(rows.join(beyond, (F.col("node") == F.col("at")) & (F.col("split") != F.col("rs")) & (F.col("id") < F.col("top")), "left_semi"))
    last = left.select("id").orderBy("id").limit(most).agg(F.max("id")).first()[0]
    left = left.where(F.col("id") <= F.lit(last)).select(F.col("id").alias("left_id"), F.col("split").alias("ls"), F.col("node").alias("x"))
    right = rows.select(F.col("id").alias("right_id"), F.col("split").alias("rs"), F.col("node").alias("y"))
    return left.join(each_way, "x").join(right, "y").where("ls <> rs and left_id < right_id").select("left_id", "right_id").orderBy("left_id", "right_id").limit(most)


def classes(df: DataFrame, key: str, split: str, tokens: str, percent: int) -> DataFrame:
    """(id, class_id, n_links) of every row with tokens: the least id that similar sets connect it to, and how many rows of other splits have a similar set.

    Link counts come from how many rows of each split a set has, so a set of 10^5 rows gives 10^5 rows here and no pair. Ids are not null;
    rows of one id count each.
    """
    rows, nodes, links = _linked(df, key, split, tokens, percent)
    each_way = links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).union(nodes.select("node", F.col("node").alias("y")))
    counts = stored(rows.groupBy("node", "split").agg(F.count("*").alias("c")))
    near = stored(each_way.join(counts.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node"), "split").agg(F.sum("c").alias("c")))
    every = near.groupBy("node").agg(F.sum("c").alias("every"))
    own = near.withColumnsRenamed({"node": "own_node", "split": "own_split"})
    found = counts.join(every, "node").join(own.withColumnRenamed("c", "own"), (F.col("node") == F.col("own_node")) & F.col("split").eqNullSafe(F.col("own_split")))
    found = found.select("node", F.col("split").alias("of_split"), (F.col("every") - F.col("own")).alias("n_links"))
    roots = graph.components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "r_node")
    placed = rows.join(roots, F.col("node") == F.col("r_node"), "left").select("id", "split", "node", F.coalesce("root", "node").alias("root"))
    named = placed.groupBy("root").agg(F.min("id").alias("class_id"))
    out = placed.join(named, "root").join(found.withColumnRenamed("node", "f_node"), (F.col("node") == F.col("f_node")) & F.col("split").eqNullSafe(F.col("of_split")))
    return out.select("id", "class_id", F.col("n_links").cast("long").alias("n_links"))


def comparisons(df: DataFrame, split: str) -> DataFrame:
    """How many pairs of rows stand in different splits: half of the square of all less the squares of each."""
    n = df.groupBy(split).agg(F.count("*").cast("decimal(38,0)").alias("n"))
    return n.agg(F.coalesce((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2, F.lit(0)).cast("long").alias("comparisons"))


def contained(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(doc_id, item_id) where a document's text holds an item's whole text of ``least`` or more code points.

    Both sides meet on two of the item's words, in a row, that are whole in any text that contains it (its second and third), then
    containment is verified. Items of fewer than four words have no such pair; they are looked for ``NEEDLES`` at a time, in one pass
    over the texts for each such block.
    """
    word = lambda c: F.split(c, r"\s+")
    i = items.where(F.char_length("text") >= least).select("item_id", F.col("text").alias("needle"), word(F.col("text")).alias("w"))
    i = i.withColumn("h", F.when(F.size("w") >= 4, F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2))))).persist()
    keys = i.where("h is not null").select("h").distinct()
    if keys.limit(KEYS + 1).count() <= KEYS:
        keys = F.broadcast(keys)
    d = docs.select("doc_id", "text", word(F.col("text")).alias("w"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda k: F.xxhash64(F.get("w", k), F.get("w", k + 1))))
    met = d.select("doc_id", F.explode_outer(grams).alias("h")).join(keys, "h")
    hits = met.join(i.where("h is not null").select("h", "item_id"), "h").select("doc_id", "item_id").distinct()
    found = hits.join(docs.select("doc_id", "text"), "doc_id").join(i.select("item_id", "needle"), "item_id").where(F.contains("text", "needle")).select("doc_id", "item_id")
    short = [(r["item_id"], r["needle"]) for r in i.where("h is null").select("item_id", "needle").toLocalIterator()]
    for at in range(0, len(short), NEEDLES):
        needles = F.array(*[F.struct(F.lit(k).alias("item_id"), F.lit(v).alias("needle")) for k, v in short[at : at + NEEDLES]])
        held = F.filter(needles, lambda x: F.contains("text", x["needle"]))
        found = found.union(docs.select("doc_id", F.explode(held).alias("x")).select("doc_id", "x.item_id"))
    return found
