"""Similar sets by equal parts, against all pairs; and how the work grows."""

import random

from pyspark.sql import functions as F

from tracemill.operators import neardup, parts


def near_sets(rng, n, words, k=8):
    """Groups of near copies of sets of many sizes, and sets of their own."""
    out = set()
    while len(out) < n:
        base = set(rng.sample(words, min(len(words), rng.choice([1, 2, 5, 9, 20, 60, 150, 400]))))
        for _ in range(rng.choice([1, 1, k])):
            s = set(base)
            for _ in range(rng.randrange(1 + len(s) // 8)):
                s ^= {rng.choice(words)}
            if s:
                out.add(tuple(sorted(s)))
    return sorted(out)


def test_similar_sets_match_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    sets = near_sets(rng, 260, words)
    df = spark.createDataFrame(list(enumerate(sets)), "node long, s array<string>").repartition(3)
    for percent in (85, 60):
        want = {(a, b, len({*x} & {*y}), len({*x} | {*y})) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and 100 * len({*x} & {*y}) >= percent * len({*x} | {*y})}
        for block, size in ((512, 10_000), (3, 7)):  # one tile a group; many tiles that begin and end within batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            try:
                got = [tuple(r) for r in parts.similar(df, percent, block).collect()]
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_texts_of_one_vocabulary_do_not_meet(spark):
    """Sets of frequent words of one vocabulary: prefixes of rare words make pairs by the square of the sets; parts make next to none."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(1_500)]
    made = []
    for n in (300, 1_200):
        sets = [sorted(set(rng.choices(words, [1 / (i + 5) for i in range(1_500)], k=150))) for _ in range(n)]
        signed = parts._signed(spark.createDataFrame(list(enumerate(sets)), "node long, s array<string>"), 85)
        made.append(parts._tiles(signed, parts.BLOCK).count())
    assert made[1] <= 5 * max(made[0], 20), made


def test_group_of_near_copies_brings_each_set_to_few_tiles(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    sets = [sorted({*base, f"x{i}"} - {rng.choice(base)}) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(sets)), "node long, s array<string>")
    assert parts._tiles(parts._signed(df, 85), 100).count() <= 600 * 20  # of 599 pairs a set
    assert parts.similar(df, 85, 100).count() == 600 * 599 // 2


def test_first_pairs_without_all(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    sets = near_sets(rng, 60, words)
    rows = [(i, rng.choice(["train", "dev", "test"]), list(rng.choice(sets))) for i in range(300)] + [(7, "dev", list(sets[0])), (9, None, list(sets[0])), (None, "dev", list(sets[0]))]
    df = spark.createDataFrame(rows, "id long, split string, tokens array<string>")
    every = sorted((r["left_id"], r["right_id"]) for r in neardup.cross_split_pairs(df, "id", "split", "tokens", 85).collect())
    for n in (1, 20, 10_000):
        assert [tuple(r) for r in neardup.first_pairs(df, "id", "split", "tokens", 85, n).collect()] == every[:n]
    copies = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("split"), F.array(F.lit("same"), F.lit("words")).alias("tokens"))
    assert [tuple(r) for r in neardup.first_pairs(copies, "id", "split", "tokens", 85, 100).collect()] == [(0, 2 * k + 1) for k in range(100)]
