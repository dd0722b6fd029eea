"""Centroid clustering: Lloyd's rounds on whole numbers, so that every sum and distance is exact.

A vector counts if it has the wanted number of components, none null or not finite; each component x becomes
floor(256 x). The first centroids are the vectors whose ids have the least hashes. In a round, each task holds its
vectors against the broadcast centroids (k times 64 numbers, whatever the input) and passes on one row of sums per
centroid; these meet in a groupBy, and the driver gets k rows. Vectors themselves are never shuffled: a round is one pass.

Distances are found one centroid at a time, in 64-bit integers where no square can overflow and in Python's integers
elsewhere. Components are clamped to 32 bits and a distance to 64, since a long has to hold the result.

Defined cases: rows that don't count give no row; a null id hashes as an empty one; rows equal in id are told apart by
their components and equal rows cluster alike; fewer vectors than centroids make fewer; an empty centroid stays where
it is; equal distances go to the smaller number; other columns pass through, and those named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import table

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components are clamped to this size; below the second, a sum of squared differences fits 64 bits.
LARGEST, SMALL, LONG = 1 << 31, 1 << 27, (1 << 63) - 1
#: Vectors that are held against the centroids at once.
BLOCK = 4_096


def whole(vector: str, dimensions: int = DIMENSIONS) -> Column:
    """The vector's integers; null where it does not count."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good, F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * SCALE)))))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid and the squared distance, by row of ``x``."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) >= SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    away = np.empty((len(x), len(centroids)), x.dtype)
    for k, c in enumerate(centroids):
        apart = x - c
        away[:, k] = (apart * apart).sum(axis=1)
    own = away.argmin(axis=1)
    least = away[np.arange(len(x)), own]
    return own, np.minimum(least, LONG).astype(np.int64)


def _blocks(frames: Iterator[pd.DataFrame], dimensions: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), BLOCK):
            part = frame.iloc[at : at + BLOCK]
            yield part, np.concatenate(part["__x"].to_list()).astype(np.int64).reshape(-1, dimensions)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least id hash, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r[0] for r in rows.select("__x", digest.alias("h")).orderBy("h", "__x").limit(k).select("__x").collect()], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then each centroid to the floor of its vectors' mean."""
    k, dimensions = centroids.shape
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    sums = [f"s{i}" for i in range(dimensions)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ["cluster", "n", *sums]])

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, x in _blocks(frames, dimensions):
            own, _ = nearest(x, sent.value)
            order = np.argsort(own, kind="stable")
            held, begin = np.unique(own[order], return_index=True)
            total[held] += np.add.reduceat(x[order], begin, axis=0)
            n += np.bincount(own, minlength=k)
        held = np.flatnonzero(n)
        yield pd.DataFrame(np.column_stack([held, n[held], total[held]]), columns=schema.names)

    # A task's sums fit 64 bits for 2^32 vectors; beyond that, sums of sums are decimals.
    parts = rows.select("__x").mapInPandas(added, schema)
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(20,0)")).alias(s) for s in sums]).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"]] = [int(r[s]) // r["n"] for s in sums]
    sent.unpersist()
    return out


def fit(vectors: DataFrame, vec: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The centroids after ``rounds`` rounds, one row each; the input is read once a round."""
    rows = _counted(vectors, vec, vector, dimensions)
    centroids = first_centroids(rows, k, seed).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids)
    return centroids


def _counted(vectors: DataFrame, vec: str, vector: str, dimensions: int) -> DataFrame:
    return vectors.select(F.col(vec).alias("__id"), whole(vector, dimensions).alias("__x")).where("__x is not null")


def assign(vectors: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """The rows that count, with ``cluster`` and ``distance``."""
    dimensions = centroids.shape[1]
    keep = [c for c in vectors.columns if c not in ("cluster", "distance")]
    rows = vectors.select(F.struct(*keep).alias("__row"), whole(vector, dimensions).alias("__x")).where("__x is not null")
    if not len(centroids):
        return rows.select(*[F.col("__row")[c].alias(c) for c in keep], F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("struct<cluster: int, distance: bigint>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [nearest(x, sent.value) for _, x in _blocks(iter([batch.to_frame("__x")]), dimensions)]
            own, away = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield pd.DataFrame({"cluster": own.astype(np.int32), "distance": away})

    made = rows.select("__row", placed("__x").alias("__made"))
    return made.select(*[F.col("__row")[c].alias(c) for c in keep], "__made.cluster", "__made.distance")


def inertia(assigned: DataFrame) -> dict[int, int]:
    """The sum of distances by cluster: at most one row for each centroid."""
    return {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}


def op13_lloyd(spark, sf_dir) -> DataFrame:
    """Per vector that counts: vec_id, cluster, distance, cluster_inertia, inertia and its centroid's digest."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centroids = fit(vectors)
    assigned = assign(vectors, centroids).select("vec_id", "cluster", "distance")
    sums = inertia(assigned) if len(centroids) else {}
    rows = [(k, min(v, LONG), min(sum(sums.values()), LONG), sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, v in sums.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """The rounds as common table expressions over (vector, component) rows."""
    parts = [
        f"""WITH good AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c, x FROM good QUALIFY c < {CENTROIDS})"""
    ]
    near = "a{0} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(list_zip(g.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM good g, c{0} k) GROUP BY r)"
    for i in range(rounds):
        parts.append(near.format(i))
        parts.append(
            f"""m{i + 1} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY p) AS x FROM
  (SELECT c, p, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(g.x) AS v, generate_subscripts(g.x, 1) AS p FROM good g JOIN a{i} a USING (r)) GROUP BY c, p) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN m{i + 1} m USING (c))"""
        )
    parts.append(near.format(rounds))
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN good USING (r) JOIN c{rounds} k USING (c)"""


OP13_SQL = _sql()
