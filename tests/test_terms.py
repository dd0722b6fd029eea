"""Counts of terms within rows, norms over frequent and rare terms, and scores in one row of sums, against plain Python and the longer way."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracemill.operators import models


def made(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, 7, None]), [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))]) for i in range(80)] + [(900, []), (901, None)]
    want = defaultdict(Counter)
    for k, t in rows:
        want[k].update(t or [])
    return spark.createDataFrame(rows, "id long, t array<string>"), {(k, f): n for k, c in want.items() for f, n in c.items()}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_counts_with_and_without_repeated_keys(spark):
    df, want = made(spark, 1)
    got = models.term_counts(df, "id", "t").collect()
    assert len(got) == len(want) and {(r["id"], r["feature"]): r["n"] for r in got} == want
    assert shuffles(models.term_counts(df.where("id >= 900"), "id", "t")) == 0


def test_norms_with_few_and_many_terms(spark):
    df, want = made(spark, 2)
    df_of, n = Counter(f for _, f in want), 82
    vectors = defaultdict(list)
    for (k, f), c in want.items():
        if df_of[f] >= 2:
            vectors[k].append((1 + math.log(c)) * (math.log((1 + n) / (1 + df_of[f])) + 1))
    for most in (1_000, 5):
        got = models.tfidf_norms(models.term_counts(df, "id", "t"), "id", n, 2, most).collect()
        assert {r["id"] for r in got} == set(vectors) and len(got) == len(vectors)
        for r in got:
            v = vectors[r["id"]]
            assert r["terms"] == len(v) and math.isclose(r["squares"], sum(x * x for x in v)) and math.isclose(r["top"], max(v))


def test_scores_in_one_row_of_sums(spark):
    df, _ = made(spark, 3)
    df = df.where("id is not null")
    counts = models.term_counts(df, "id", "t")
    known = models.vocabulary(counts, 60, 2, 12)
    rng = random.Random(4)
    features = [r["feature"] for r in known.collect()][1:]
    model = spark.createDataFrame([(c, y, f, rng.uniform(-2, 2)) for c in ("c1", "c2") for y in ("0", "1", "2") for f in ["", *features]], "candidate string, label string, feature string, weight double")
    want = {tuple(r)[:3]: r["p"] for r in models.linear_scores(model, models.tfidf_vectors(counts, known), df, "id").collect()}
    found = models.tfidf_scores(model, counts, known, df, "id")
    got = {tuple(r)[:3]: r["p"] for r in found.collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.agg(F.round(F.sum("p"), 6)).first()[0] == 2 * df.select("id").distinct().count()
