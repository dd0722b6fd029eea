"""SimHash near-dedup with a covering locality-sensitive hash.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Fingerprints link at
``RADIUS`` = 2 or fewer differing bits. Each bit position gets a non-zero vector of 3 bits, dealt round; the
table of a non-zero vector v keeps the positions whose vector has an odd product with v. Two differing positions
span at most two of three dimensions, so some v is orthogonal to both vectors and its table masks both out:
every pair within the radius collides in one of 7 tables, each keyed by 36 or so bits.

Texts of equal fingerprint are one node; only distinct fingerprints go into tables. Buckets of more than
``BUCKET`` fingerprints are not paired but dealt again by 21 finer masks, each leaving out two of seven groups of
the bits that the table left free. Two differing bits lie in two groups at most, so again no pair is lost, and
what is left free is 8 bits or fewer: such a bucket has at most 256 fingerprints. From each bucket comes a
spanning forest of its links, not all pairs. Components are found by large-star and small-star rounds.

Defined cases: a null or empty text has fingerprint zero and links like any other; a null doc_id takes part, and
a component of null ids only has a null component_id; equal rows stay equal rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import cut, fresh, small_side, table
from tracemill.llm.decontaminate import text_key

RADIUS, SHINGLE, SEED, BUCKET = 2, 3, 42, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 14
#: Edges of a task in a round of components: a small table would else cost a task and some files for each partition of each shuffle.
EDGES = 20_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text as an unsigned number."""
    from xxhash import xxh64_digest

    words = (text or "").encode().translate(_LOWER).split()  # on the ASCII white space only
    if not words:
        return 0
    join, seed, n = b" ".join, SEED, max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + SHINGLE - 1]
        grams = zip(part, part[1:], part[2:], strict=False) if len(words) >= SHINGLE else [words]
        hashes = b"".join([xxh64_digest(join(g), seed) for g in grams])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> list[int]:
    """The 7 covering masks: position i has vector i % 7 + 1, and is kept by v where the product is odd."""
    return [sum(1 << i for i in range(64) if ((i % 7 + 1) & v).bit_count() % 2) for v in range(1, 8)]


def finer(mask: int) -> list[int]:
    """``mask`` and all but two of seven groups of the positions that it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    groups = [sum(1 << i for i in free[k::7]) for k in range(7)]
    return [~(groups[a] | groups[b]) & (1 << 64) - 1 for a in range(7) for b in range(a + 1, 7)]


def _keys(column: str, numbered: list[tuple[int, int]]):
    return F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.col(column).bitwiseAND(F.lit(_signed(m))).alias("k")) for n, m in numbered]))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
def _forest(buckets: pd.Series) -> pd.Series:
    """Of each bounded bucket, edges from each fingerprint to the least of its component in the bucket."""
    out = []
    for values in buckets:
        v = np.asarray(values, np.int64)
        near = np.bitwise_count(v[:, None].view(np.uint64) ^ v[None, :].view(np.uint64)) <= RADIUS
        best = v.copy()
        while True:
            step = np.where(near, best[None, :], np.iinfo(np.int64).max).min(axis=1)
            if (step == best).all():
                break
            best = step
        out.append([{"a": int(x), "b": int(y)} for x, y in zip(v, best, strict=True) if x != y])
    return pd.Series(out)


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``f`` as all pairs within the radius would."""
    keyed = nodes.select("f", _keys("f", list(enumerate(masks()))).alias("x")).select("f", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["t", "k"]))
    small = shared.where(F.col("n") <= bucket).select("f", "t", "k")
    tables = [F.when(F.col("t") == t, F.array(*[F.struct(F.lit(100 * (t + 1) + i).alias("t"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(finer(mask))])) for t, mask in enumerate(masks())]
    large = shared.where(F.col("n") > bucket).select("f", F.explode(F.coalesce(*tables)).alias("x")).select("f", "x.t", "x.k")
    groups = small.union(large).groupBy("t", "k").agg(F.collect_list("f").alias("fs")).where("size(fs) > 1")
    return cut(groups.select(F.explode(_forest("fs")).alias("e")).select("e.a", "e.b").distinct())


def components(edges: DataFrame, each: int = EDGES) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes that have edges; no node is its own row twice.

    A round never has more edges than the one before, so their first count tells how many tasks all rounds need.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    tasks = edges.count() // each + 1
    edges = edges.coalesce(tasks)
    while not _stars(edges, tasks):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        # Large star: each neighbour above a node is tied to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).coalesce(tasks)
        big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        # Small star: a node and its lower neighbours are tied to the least of them.
        low = big.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).coalesce(tasks)
        edges = cut(small.distinct().coalesce(tasks))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame, tasks: int) -> bool:
    """Whether each node has one edge and no edge leads on from where another ends; then nothing is left to do."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1))).coalesce(tasks)
    return not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").coalesce(tasks).limit(1).count()


def grouped(docs: DataFrame, doc: str = "doc_id", text: str = "text", bucket: int = BUCKET, extra: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, f, root, component_id) of every row, then ``extra``; root tells components apart that share their least doc_id."""
    prints = cut(docs.select(F.col(doc).alias("doc_id"), _fingerprints(F.col(text)).alias("f"), *extra))
    nodes = cut(prints.groupBy("f").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes.select("f"), bucket))
    rooted = nodes.join(roots, nodes["f"] == roots["node"], "left").select("f", "rep", F.coalesce("root", "f").alias("root"))
    best = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(rooted.join(best, "root").select("f", "root", "component_id"), "f").select("doc_id", "f", "root", "component_id", *prints.columns[2:])


def cluster(docs: DataFrame, doc: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, f, component_id) of every row: signed fingerprint and the least doc_id that can be reached."""
    return grouped(docs, doc, text, bucket).select("doc_id", "f", "component_id")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: its least doc_id; of rows equal in that id, the least text.

    Rows of a component without any doc_id are kept.
    """
    return keep_least(docs, grouped(docs, doc, text, extra=(text_key(F.col(text)),)), doc, text)


def keep_least(docs: DataFrame, groups: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the least (doc_id, text) of each root of ``groups`` (doc_id, text_key, root), and all rows of a root without ids.

    Rows are told apart by id and text, so none goes for another of its id. Only narrow keys are joined.
    """
    own, key = fresh(docs, "__doc", "__key")
    same = lambda df: df[doc].eqNullSafe(F.col(own)) & (text_key(df[text]) == F.col(key))
    rows = cut(groups.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")))
    least = rows.where("doc_id is not null").groupBy("root").agg(F.min("doc_id").alias("low"))
    firsts = cut(rows.join(least, "root").where("doc_id = low").groupBy("root", "low").agg(F.min("text_key").alias("first"), F.count("*").alias("k")))
    # Texts are read only where a component's least id comes with several.
    tied = cut(firsts.where("k > 1").join(rows, "root").where("doc_id = low").select("root", F.col("doc_id").alias(own), F.col("text_key").alias(key)))
    if tied.limit(1).count():
        texts = docs.join(small_side(tied), same(docs)).groupBy("root").agg(F.min(F.struct(F.coalesce(text, F.lit("")).alias("t"), F.col(key).alias("k")))["k"].alias("named"))
        firsts = firsts.join(texts, "root", "left").withColumn("first", F.coalesce("named", "first"))
    firsts = firsts.select("root", "low", "first")
    judged = cut(rows.join(firsts, "root").select(F.col("doc_id").alias(own), F.col("text_key").alias(key), "n", F.expr("doc_id <=> low and text_key = first").alias("kept")).where("not kept or n > 1"))
    out = docs.join(small_side(judged.where("not kept").select(own, key)), same(docs), "left_anti")
    equal = judged.where("kept").select(own, key)
    if not equal.limit(1).count():
        return out
    equal = small_side(equal)
    once = out.join(equal, same(out), "left_semi").withColumn(key, text_key(F.col(text))).dropDuplicates([doc, key]).drop(key)
    return out.join(equal, same(out), "left_anti").unionByName(once)


def op5_simhash(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
