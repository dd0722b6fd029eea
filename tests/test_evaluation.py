"""Queries of the evaluation plans that have no SQL."""

import math
import random

import pytest

from tracemill.operators import metrics, models
from tracemill.plans import evaluation


def test_sgd_logistic_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 100_001 + "lastword"), (2, "other text lastword")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert "lastword" in {r["feature"] for r in evaluation.sgd_logistic(spark, str(tmp_path)).collect()}


def test_temperature_fit_makes_the_rounds_of_the_reference(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 0, [1.0] * 10)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = []
    monkeypatch.setattr(metrics, "temperature", lambda *args, rounds=60: made.append(rounds) or (1.0, 0.0))
    evaluation.temperature_fit(spark, str(tmp_path))
    assert made == [100]


def test_sgd_equals_updates_one_by_one(spark):
    rng = random.Random(61)
    rows = [(i, rng.choice("xyz"), {f: rng.random() for f in rng.sample("abcdef", rng.randint(0, 4))}) for i in range(25)]
    vectors = spark.createDataFrame([(i, f, v) for i, _, fs in rows for f, v in fs.items()], "id int, feature string, value double")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "id int, label string")
    got = {(r["candidate"], r["label"], r["feature"]): r["weight"] for r in models.sgd_logistic(vectors, labels, [("p", 0.5, 3, 0.2, 7), ("q", 20.0, 2, 0.2, 8)]).collect()}
    for name, l2, epochs, rate, seed in [("p", 0.5, 3, 0.2, 7), ("q", 20.0, 2, 0.2, 8)]:
        w, order, draw = {y: {"": 0.0} for y in "xyz"}, list(range(25)), random.Random(seed)
        for epoch in range(epochs):
            draw.shuffle(order)
            step = rate / math.sqrt(epoch + 1)
            for own in w.values():
                for f in own:
                    own[f] *= 1 if f == "" else max(0.0, 1 - step * l2)
            for i in order:
                _, y, fs = rows[i]
                e = {k: math.exp(own[""] + sum(own.get(f, 0.0) * v for f, v in fs.items())) for k, own in w.items()}
                for k, own in w.items():
                    g = step * ((k == y) - e[k] / sum(e.values()))
                    own[""] += g
                    for f, v in fs.items():
                        own[f] = own.get(f, 0.0) + g * v
        for k, own in w.items():
            for f, x in own.items():
                assert got[name, k, f] == pytest.approx(x, abs=1e-12)


def test_score_gradient_of_odd_rows(spark):
    from tracemill.operators import metrics

    nan = float("nan")
    rows = [([0.0, 0.0], 0, [[1.0, -1.0], [-1.0, 1.0]]), ([0.0, 0.0], 0, [[1.0, -1.0]]), ([0.0, nan], 0, [[1.0, 0.0], [0.0, 1.0]]), ([0.0, 0.0], 2, [[1.0, 0.0], [0.0, 1.0]]), (None, 0, [[1.0, 0.0], [0.0, 1.0]]), ([0.0, 0.0], 1, [[1.0], [0.0, 1.0]]), ([3.0, 3.0], 1, [[7.0, 7.0], [-7.0, -7.0]])]
    got = metrics.score_gradient(spark.createDataFrame(rows, "z array<double>, gold int, e array<array<double>>"), "z", "gold", "e", 1.0).collect()
    assert [r["loss"] is None for r in got] == [False, True, True, True, True, True, False]
    # Two opposite perturbations: advantages are 1 and -1 over the root of two; what moves both logits alike counts for nothing.
    assert abs(got[0]["gradient"][0] - (-0.5 - 1 / 2**0.5)) < 1e-4 and abs(got[0]["gradient"][1] - (0.5 + 1 / 2**0.5)) < 1e-4
    assert got[6]["gradient"] == [0.5, -0.5] and got[6]["loss_score"] == 0
