import math
from itertools import cycle

from pyspark.sql import functions as F

from tracemill.llm import source_mix


def reshared(sizes: dict, percent=150, most=2, weights=(5, 2, 1)):
    """Targets by the rule as stated: cap, reshare the excess, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = dict(zip(order, cycle(weights)))
    left, total, out = set(order), sum(sizes.values()) * percent / 100, {}
    while left:
        level = (total - sum(out.values())) / sum(w[s] for s in left)
        full = {s for s in left if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in left}
        out |= {s: most * sizes[s] for s in full}
        left -= full
    return out


def test_targets_are_the_fixed_point_of_resharing(spark):
    for sizes in ({"a": 100, "b": 5000, "é": 40, None: 900, "Z": 7}, {"a": 10}, {"a": 0, "b": 0}, {f"s{i}": 100 + 37 * i % 91 for i in range(25)}):
        rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in source_mix.targets(rows).collect()}
        want = reshared(sizes)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want), (got, want)


def test_mix_meets_targets_and_is_stable(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", " ".join(["w"] * (1 + i * 7919 % 400))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = source_mix.mix(docs).withColumn("taken", F.col("copies") * F.col("size"))
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r["t"] - r["target"]) <= 0.02 * r["target"] + 400 for r in per), per
    assert got.where("copies < 0 or copies > 2").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, source_mix.mix(docs.repartition(7)).select(got.columns[:-1]).withColumn("taken", F.col("copies") * F.col("size")).collect()))


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "a b"), (1, None, "a b"), (None, "x", None), (None, "x", ""), (2, "x", "a " * 50)], "doc_id long, source string, text string")
    got = source_mix.mix(docs)
    assert got.count() == 5
    assert source_mix.mix(docs.limit(0)).count() == 0
