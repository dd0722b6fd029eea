"""Pairs of sets with a high Jaccard index, found by equal parts of the sets and verified in tiles of blocks; no pair is lost.

Sets of n to U tokens (a level) and the larger ones that can be similar to them differ from those by at most d = U (100 - p) / p
tokens. Their tokens are dealt by their hashes over d + c parts, so at least c parts of two similar sets are equal, and of the
first d + m parts of each in any common order at least m. A part's hash (its signature) stands for all its tokens, so unlike single
rare tokens it hardly ever meets another text's by chance, however many texts there are. The order puts parts of much
information first, as a sample of the sets weighs tokens; it changes the work, never the result.

Nodes that share a signature meet in tiles, not in pairs: each node has a block, its share of the largest group that it has a
signature of, and a pair of blocks brings each of its nodes' sets once. A group of c near copies brings c sets a few times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.shared import stored

#: Sets of the sample that weighs tokens, least count there of a known token, and most that are known.
SAMPLE, COMMON, COMMON_MOST = 5_000, 5, 50_000
#: Nodes of a block, sets whose signatures are found at once, and tokens that are counted at once.
BLOCK, ROWS, COLUMNS = 512, 2_000, 4_096


def _level(low: int, percent: int) -> tuple[int, int, int, int]:
    """(U, d, m, c) of the level whose smallest set has ``low`` tokens."""
    top = low * 100 // percent
    d = top * (100 - percent) // percent
    m = 1 + min(6, d // 6)
    return top, d, m, m + min(7, d // 4)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signatures(tokens: np.ndarray, ends: np.ndarray, weights: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]:
    """By level: (places of its sets, low, m, their signatures, whether each is of a set of the level itself).

    ``tokens`` are the hashes of all sets and ``ends`` where each set's begin and end.
    """
    sizes, low = np.diff(ends), 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    most = sizes.max(initial=0)
    while low <= most:
        top, d, m, c = _level(low, percent)
        sets = np.flatnonzero((sizes >= low) & (sizes <= top * 100 // percent))
        if d and len(sets):  # where d is 0 only equal sets are similar
            place = np.full(len(sizes), -1)
            place[sets] = np.arange(len(sets))
            mine = place[owner] >= 0
            t = tokens[mine]
            parts = d + c
            key = place[owner[mine]] * parts + (_mix(t, 12_345 + low) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key = key[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums, information = np.zeros(len(sets) * parts, np.uint64), np.zeros(len(sets) * parts, np.int64)
            sums[key[start]] = np.add.reduceat(_mix(t, 777)[order], start)
            information[key[start]] = np.add.reduceat(weights[mine][order], start)
            found = _mix(sums + np.tile(_mix(np.arange(parts, dtype=np.uint64), low), len(sets)), 99).reshape(len(sets), parts)
            first = np.lexsort((found, -information.reshape(len(sets), parts)), axis=1)[:, : d + m]
            of = np.repeat(sets, first.shape[1])
            yield of, low, m, np.take_along_axis(found, first, axis=1).ravel(), sizes[of] <= top
        low = top + 1


def _weigher(nodes: DataFrame):
    """A function giving tokens' information in sixteenths of a bit, by how many sets of a sample hold each."""
    rows, grain = nodes.count(), 1 << 20
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(grain)) < int(grain * min(1, SAMPLE / max(rows, 1))) + 1)
    seen = some.select(F.explode_outer("h").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    top = seen.orderBy(F.col("c").desc(), "h").limit(COMMON_MOST).collect()
    hashes, counts = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], float)
    order, sets = np.argsort(hashes), max(2 * COMMON, min(rows, SAMPLE))
    hashes, bits = hashes[order], np.maximum(1, np.round(16 * np.log2(sets / counts[order]))).astype(np.int64)
    other = int(16 * np.log2(2 * sets / COMMON))

    def weights(tokens: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.full(len(tokens), other, np.int64)
        at = np.minimum(np.searchsorted(hashes, tokens), len(hashes) - 1)
        return np.where(hashes[at] == tokens, bits[at], other)

    return weights


def _signed(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, tag, own, sig): signatures of each node; the tag holds the level and how many two similar nodes share there."""
    hashed = nodes.select("node", F.transform("s", lambda t: F.xxhash64(t)).alias("h"))
    weights = _weigher(hashed)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                h, node = part.column("h"), part.column("node").to_numpy()
                ends = h.offsets.to_numpy()
                tokens = h.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
                for of, low, m, sig, own in signatures(tokens, ends - ends[0], weights(tokens), percent):
                    yield pa.RecordBatch.from_arrays([pa.array(node[of]), pa.array(np.full(len(of), low * 8 + m, np.int32)), pa.array(own), pa.array(sig.view(np.int64))], names=["node", "tag", "own", "sig"])

    return hashed.mapInArrow(found, "node long, tag int, own boolean, sig long")


def _tiles(signed: DataFrame, block: int) -> DataFrame:
    """(bi, bj, tag, side, node): the nodes of two blocks (or of one) of which some share enough signatures of a level."""
    same, one = Window.partitionBy("sig"), Window.partitionBy("node")
    shared = signed.withColumn("c", F.count("*").over(same)).withColumn("some", F.max("own").over(same)).where("c > 1 and some")
    home = F.max(F.struct("c", "sig")).over(one)
    share = F.pmod(F.xxhash64("node"), F.ceil(F.col("home.c") / block))
    shared = stored(shared.withColumn("home", home).select("sig", "tag", "own", "node", F.xxhash64("home.sig", share).alias("block")))
    blocks = shared.groupBy("sig", F.col("block").alias("other")).agg(F.count("*").alias("k"), F.max("own").alias("any"))
    met = shared.join(blocks, "sig").where(F.col("own") | F.col("any")).where((F.col("block") != F.col("other")) | (F.col("k") > 1))
    rows = met.select(F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "tag", (F.col("block") > F.col("other")).alias("side"), "node")
    return rows.groupBy("bi", "bj", "tag", "side", "node").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("tag") % 8).drop("n")


def _similar(tile: pa.Table, percent: int) -> pa.RecordBatch | None:
    """(x, y, i, u) of the similar pairs of a tile whose smaller set is of the tile's level."""
    one = tile.column("bi")[0].as_py() == tile.column("bj")[0].as_py()
    side, node = tile.column("side").to_numpy(), tile.column("node").to_numpy()
    if len(node) < 2 or not one and (side.all() or not side.any()):
        return None
    s = tile.column("s").combine_chunks()
    sizes = pc.list_value_length(s).to_numpy().astype(np.int64)
    codes = pc.dictionary_encode(s.flatten()).indices.to_numpy()
    left, right = (np.arange(len(node)),) * 2 if one else (np.flatnonzero(~side), np.flatnonzero(side))
    owner, codes = np.repeat(np.arange(len(node)), sizes), codes.astype(np.int64)
    # Only tokens of several sets are in an intersection.
    times = np.bincount(codes)
    many = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[many] = np.arange(len(many))
    at = place[codes]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(many), COLUMNS):
        here = slice(*np.searchsorted(at, [start, start + COLUMNS]))
        held = np.zeros((len(node), min(COLUMNS, len(many) - start)), np.float32)
        held[owner[here], at[here] - start] = 1
        both += held[left] @ held[right].T
    both = both.astype(np.int64)
    a, b = sizes[left][:, None], sizes[right][None, :]
    union = a + b - both
    top = _level(tile.column("tag")[0].as_py() // 8, percent)[0]
    fit = (both * 100 >= union * percent) & (np.minimum(a, b) <= top)
    if one:
        fit &= left[:, None] < right[None, :]
    i, j = np.nonzero(fit)
    x, y = node[left[i]], node[right[j]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(both[i, j].astype(np.int32)), pa.array(union[i, j].astype(np.int32))], names=["x", "y", "i", "u"])


def similar(nodes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(x, y, i, u), x before y, of the ``nodes`` (node, s: distinct sets) whose Jaccard index i / u is ``percent``/100 or more."""
    tiles = _tiles(_signed(nodes, percent), block).join(nodes.select("node", "s"), "node")
    keys = ["bi", "bj", "tag"]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile's rows follow each other; a tile may begin in one batch and end in a later one."""
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for start, end in zip([0, *change], [*change, batch.num_rows], strict=True):
                now = tuple(c[start] for c in columns)
                if held and now != last:
                    if (found := _similar(pa.Table.from_batches(held), percent)) is not None:
                        yield found
                    held = []
                held.append(batch.slice(start, end - start))
                last = now
        if held and (found := _similar(pa.Table.from_batches(held), percent)) is not None:
            yield found

    dealt = tiles.select(*keys, "side", "node", "s").repartition(*keys).sortWithinPartitions(*keys)
    return stored(dealt.mapInArrow(verified, "x long, y long, i int, u int"))
