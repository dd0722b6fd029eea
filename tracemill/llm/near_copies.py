"""Near copies by the Jaccard index of word shingles: a prefix-filtered self-join that loses no pair.

A text's set holds the hashes of its shingles of ``SHINGLE`` lower-cased words (of all its words, if fewer). Two texts
link where the index of their sets is ``PERCENT``/100 or more. Whatever order all hashes are put in, two sets that
similar share one of their first n - ceil(t n) + 1 hashes, and the first that they share leaves room for the overlap
they need; so only prefixes are joined, and candidates are verified on the whole sets. Hashes that are common in a
sample of texts come last in the order from the start. A hash whose nodes, counted over all, fall apart, more than ``HOT`` of them
outside its largest component, goes behind all others in every set that has it; prefixes are cut and joined again until
there is no such hash that could still go back. So a passage of many texts, known to the sample or not, is joined only for texts that have little else.

One pass over the texts finds each one's set's digest (its node), size, counts in cells, prefix and fingerprint; all that
follows works on that table, and only the sets of likely pairs are found again, from one text each.

Equal sets are one node. Only components are asked for, so all nodes of a shared hash are first tried against the
one in which it stands first and then pairs only across the components found: a large group of near copies costs its size, not all pairs.
Of two similar sets the smaller has the first shared hash within its first tenth or so (where it has room for a set like
itself), so nodes of one hash that stay apart are paired only from there: texts that a passage fills to less than that meet none.

Defined cases: null and empty texts have the empty set and are copies of one another; a null doc_id takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import simhash
from tracemill.llm.common import at_most, small_side, stored
from tracemill.llm.decontaminate import text_key

SHINGLE, PERCENT, SEED = 5, 80, 42
#: Texts of the sample that orders the hashes, least count there of a common one, and most that are kept.
SAMPLE, COMMON, COMMON_MOST = 5_000, 5, 50_000
#: Nodes of one hash that it may leave outside its largest component, and hashes put back that tasks may hold.
HOT, KNOWN = 512, 1_000_000
#: Cells in which a set's hashes are counted, and rows that a worker turns into one batch.
CELLS, ROWS = 512, 1_000


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    from xxhash import xxh64_digest

    words = (text or "").lower().encode().split()  # on the ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    join, n = b" ".join, max(1, len(words) - k + 1)
    hashes = b"".join([xxh64_digest(join(words[i : i + k]), SEED) for i in range(n)])
    return np.unique(np.frombuffer(hashes, ">i8").astype(np.int64))


def _node(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(s.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _counts(s: np.ndarray) -> bytes | None:
    """How many of the hashes fall into each of ``CELLS``, a byte each; none where a byte is too small."""
    c = np.bincount(s & (CELLS - 1), minlength=CELLS)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else None


def _sets(k: int, common: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_in_order(shingles(t, k), common) for t in texts], dtype=object)

    return sets


def _in_order(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """An ascending set with the hashes common in the sample last."""
    if not len(s) or not len(common):
        return s
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~last], s[last]])


def _prefix(s: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The hashes of which two similar sets share one: the first few."""
    return _in_order(s, common)[: len(s) - (len(s) * percent + 99) // 100 + 1]


def _last(k: int, common: np.ndarray, known: np.ndarray, percent: int):
    """A UDF giving a text's prefix with the hashes ``known`` behind all others, in their own order."""
    order = np.argsort(known, kind="stable")
    ascending = known[order]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def prefix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                s = _in_order(shingles(t, k), common)
                at = np.minimum(np.searchsorted(ascending, s), len(ascending) - 1)
                hot = ascending[at] == s
                late = s[hot][np.argsort(order[at[hot]], kind="stable")]
                out.append(np.concatenate([s[~hot], late])[: len(s) - (len(s) * percent + 99) // 100 + 1])
            yield pd.Series(out, dtype=object)

    return prefix


def _put_back(some: DataFrame, texts_of, sets_of, known: DataFrame, k: int, common: np.ndarray, percent: int, most: int) -> DataFrame:
    """(node, prefix) of ``some`` nodes with the hashes of ``known`` (h, round, c) behind all others: in the texts' tasks, or beyond ``most`` hashes by a join."""
    last = known.orderBy("round", "c", "h")
    if at_most(known, most):
        order = np.array([r[0] for r in last.select("h").collect()], np.int64)
        return stored(texts_of(some).select("node", _last(k, common, order, percent)("t").alias("prefix")))
    each = sets_of(some).select("node", F.posexplode("s").alias("at", "h")).join(known, "h", "left")
    rank = F.struct(F.coalesce("round", F.lit(-1)).alias("round"), F.coalesce("c", F.lit(0)).alias("c"), F.when(F.col("c").isNull(), F.col("at")).otherwise(F.lit(0)).alias("at"), "h")
    whole = each.groupBy("node").agg(F.sort_array(F.collect_list(rank)).alias("s"))
    long = F.size("s") - F.ceil(F.size("s") * percent / 100).cast("int") + 1
    return stored(whole.select("node", F.slice("s", F.lit(1), long)["h"].alias("prefix")))


def prints(docs: DataFrame, common: np.ndarray, doc: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, f, node, n, cells, prefix) of every row, in one pass: f is its SimHash."""
    rows = docs.select(F.col(doc).alias("doc_id"), text_key(F.col(text)), F.col(text).alias("t"))
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string("f long, node long, n int, cells binary, prefix array<long>").fields])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("t").to_pylist()
                bits = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
                nodes, sizes, cells, prefixes = [], [], [], []
                for t in texts:
                    s = shingles(t, k)
                    nodes.append(_node(s))
                    sizes.append(len(s))
                    cells.append(_counts(s))
                    prefixes.append(_prefix(s, percent, common))
                ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
                columns = [pa.array(bits), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(cells, pa.binary()), flat]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *columns], names=schema.names)

    return rows.mapInArrow(found, schema)


@F.pandas_udf(T.IntegerType())
def _bound(x: pd.Series, y: pd.Series) -> pd.Series:
    """The most hashes that two sets can share by their counts in cells; null where these are not known."""
    return pd.Series([None if a is None or b is None else int(np.minimum(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).sum()) for a, b in zip(x, y, strict=True)], dtype="Int32")


def _common(docs: DataFrame, text: str, k: int, sample: int) -> np.ndarray:
    """Hashes that many texts of a sample have, ascending."""
    rows, grain = docs.count(), 1 << 20
    some = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(grain)) < int(grain * min(1, sample / max(rows, 1))) + 1).distinct()
    seen = some.select(F.explode_outer(_sets(k, np.zeros(0, np.int64))("t")).alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    return np.sort(np.array([r[0] for r in seen.where("h is not null").orderBy(F.col("c").desc(), "h").limit(COMMON_MOST).select("h").collect()], np.int64))


def grouped(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, sample: int = SAMPLE, bits: bool = False, hot: int = HOT, most: int = KNOWN) -> DataFrame:
    """(doc_id, text_key, root) of every row: root is the same for the texts of one component.

    With ``bits``, texts whose fingerprints SimHash links are in one component, too.
    """
    common = _common(docs, text, k, sample)
    rows = stored(prints(docs, common, doc, text, k, percent))
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("prefix").alias("prefix")))

    def texts_of(some: DataFrame) -> DataFrame:
        """(node, t): the text of one row of each of ``some`` nodes."""
        wanted = some.join(nodes, "node").select("node", F.col("row.doc_id").alias("__doc"), F.col("row.text_key").alias("__key"))
        wanted = stored(wanted)
        texts = docs.select(F.col(doc).alias("i"), F.col(text).alias("t"), text_key(F.col(text)).alias("key"))
        found = texts.join(small_side(wanted), F.col("i").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__key"))).select("node", "t")
        # Rows equal in id and text give a node more than once.
        return found.dropDuplicates(["node"]) if found.select("node").count() > wanted.count() else found

    def sets_of(some: DataFrame) -> DataFrame:
        return stored(texts_of(some).select("node", _sets(k, common)("t").alias("s")))

    def room(n, at, other_n, other_at):
        """Whether a hash can be the first that two similar sets share: enough must stand behind it in both."""
        return F.least(n - at, other_n - other_at) * (100 + percent) >= (n + other_n) * percent

    def enough(both, n):
        return both * 100 >= (n - both) * percent

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of the candidate ``pairs`` of nodes that are similar: by sizes, counts in cells, then their whole sets."""
        a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}")) for x in "ab")
        sized = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        likely = sized.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), _bound("ca", "cb").alias("most"))
        likely = stored(likely.where(F.col("most").isNull() | enough(F.col("most"), F.col("n"))).select("a", "b", "n"))
        found = sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())
        one, two = (found.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        both = likely.join(one, "a").join(two, "b").select("a", "b", "n", F.size(F.array_intersect("sa", "sb")).alias("i"))
        return stored(both.where(enough(F.col("i"), F.col("n"))).select("a", "b").distinct())

    def pair(one, two):
        return F.least(one, two).alias("a"), F.greatest(one, two).alias("b")

    near = stored(_by_bits(rows)) if bits else None
    tried = known = changed = None
    prefixes, opened = nodes.select("node", "n", "prefix"), []
    while True:
        each = prefixes.select("node", "n", F.posexplode_outer("prefix").alias("at", "h")).where("h is not null")
        if changed is not None:  # all other hashes stand where they stood
            each = each.join(small_side(changed), "h", "left_semi")
        # Of each hash that several nodes have, the node in which it stands first; its place and that node's size in one long.
        place = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
        lead = each.groupBy("h").agg(F.min_by("node", place).alias("lead"), F.min(place).alias("place"), F.count("*").alias("c")).where("c > 1")
        shared = stored(each.join(small_side(stored(lead)), "h"))
        lead_n, lead_at = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("place", 32)
        stars = shared.where("node <> lead").where(room(F.col("n"), F.col("at"), lead_n, lead_at)).select(*pair(F.col("node"), F.col("lead"))).distinct()
        stars = stored(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"))
        tried = stars if tried is None else tried.union(stars)
        found = verified(stars)
        near = found if near is None else near.union(found)
        roots = simhash.components(near).withColumnRenamed("node", "__node")
        placed = shared.join(roots, F.col("node") == F.col("__node"), "left").select("h", "c", "node", "n", "at", F.coalesce("root", "node").alias("root"))
        # Of each hash the nodes outside its largest component: pairs across are at most so many for each of its nodes.
        mixed = stored(placed.groupBy("h", "c", "root").agg(F.count("*").alias("own")).groupBy("h", "c").agg((F.col("c") - F.max("own")).alias("out")).where("out > 0"))
        open_ = stored(shared.join(small_side(mixed.select("h")), "h", "left_semi").select("h", "node", "n", "at"))
        opened.append((open_, changed))
        heavy = mixed.where(F.col("out") > hot).select("h", "c")
        heavy = stored(heavy if known is None else heavy.join(known.select("h"), "h", "left_anti"))
        if not heavy.limit(1).count():
            break
        heavy = heavy.withColumn("round", F.lit(len(opened)))
        known = heavy if known is None else stored(known.unionByName(heavy))
        held = stored(open_.join(small_side(heavy.select("h")), "h", "left_semi").select("node").distinct())
        again = _put_back(held, texts_of, sets_of, known, k, common, percent, most)
        changed = stored(again.select(F.explode("prefix").alias("h")).distinct())
        prefixes = stored(prefixes.join(small_side(again.withColumnRenamed("prefix", "again")), "node", "left").select("node", "n", F.coalesce("again", "prefix").alias("prefix")))
    # A hash counts as the last round that had it found it; one put back since, and in no prefix any more, does not.
    open_, later = opened.pop()
    while opened:
        gone = known.select("h").union(later).distinct()
        earlier, before = opened.pop()
        open_ = open_.union(earlier.join(small_side(stored(gone)), "h", "left_anti"))
        later = later if before is None else later.union(before)
    open_ = open_.join(roots, F.col("node") == F.col("__node"), "left").select("h", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    a, b = (open_.select("h", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "at", "root")]) for x in "ab")
    # The smaller of two similar sets has room behind the hash for a set of its own size.
    a = a.where(room(F.col("a_n"), F.col("a_at"), F.col("a_n"), F.col("a_at")))
    smaller = (F.col("a_n") < F.col("b_n")) | (F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node"))
    across = a.join(b, "h").where(smaller & (F.col("a_root") != F.col("b_root")) & room(F.col("a_n"), F.col("a_at"), F.col("b_n"), F.col("b_at")))
    rest = stored(across.select(*pair(F.col("a_node"), F.col("b_node"))).distinct().join(tried, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        roots = simhash.components(near.union(verified(rest))).withColumnRenamed("node", "__node")
    return rows.select("doc_id", "text_key", "node").join(roots, F.col("node") == F.col("__node"), "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def _by_bits(rows: DataFrame) -> DataFrame:
    """(a, b): nodes of texts that SimHash links, each with the least of its component."""
    texts = rows.select("node", "f").distinct()
    roots = simhash.components(simhash.links(rows.select("f").distinct())).withColumnRenamed("node", "__f")
    placed = stored(texts.join(roots, F.col("f") == F.col("__f"), "left").select("node", F.coalesce("root", "f").alias("bits")))
    least = placed.groupBy("bits").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").drop("most")
    return placed.join(least, "bits").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the least (doc_id, text) of each group of near copies, and all rows of a group without ids.

    Texts are near copies by their shingles, or by fingerprints within the radius of SimHash.
    """
    return simhash.keep_least(docs, stored(grouped(docs, doc, text, bits=True)), doc, text)
