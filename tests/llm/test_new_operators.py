"""Fill-in-the-middle and centroid clustering against plain Python, and their defined cases."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.llm import fill_middle, lloyd

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", " \n\t", "a", " a", "a ", "a b", "é\U0001f600 x y z ", "no <P> cut", "<S>", "a<b <<M> c", "<", "ends with <", "<S", "x" * 200_000, "word " * 40_000]


def plain_cut(doc, text, rate=50):
    t = text or ""
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    u = TOKEN.findall(t)
    n = len(u)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_on_odd_texts(spark):
    rng = random.Random(12)
    texts = ODD + ["".join(rng.choice("ab <>PSM\nü") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, i % 7, "mine") for i, t in enumerate(texts)] + [(None, "of no id at all", 1, "x"), (None, None, 1, "x"), (5, "twice", 1, "x"), (5, "twice", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, whole string")
    made = fill_middle.transform(docs, rate=95).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "text", "whole", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = made.collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_cut(r["doc_id"], r["text"], 95)
        assert r["back"] == (r["text"] or "")


def test_fill_middle_on_no_rows_and_bad_markers(spark):
    assert fill_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("p", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.transform(spark.createDataFrame([], "doc_id long, text string"), markers=bad)


def plain_lloyd(vectors, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cents = [v for _, v in first]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for j in set(own):
            mine = [v for o, (_, v) in zip(own, kept, strict=True) if o == j]
            cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((-1 if i is None else i, place(v)[1], min(place(v)[0], lloyd.LONG)) for i, v in kept), cents


@pytest.mark.parametrize("size", [1.0, 3e5, 1.9e6])
def test_lloyd_against_plain_rounds(spark, size):
    rng = random.Random(13)
    rows = [(i % 190 if i % 50 else None, [rng.gauss(rng.randrange(4), 0.3) * size for _ in range(3)]) for i in range(240)]
    rows += [(500, [1.0, 2.0]), (501, None), (502, [1.0, None, 2.0]), (503, [1.0, float("nan"), 2.0]), (504, [float("inf"), 0.0, 0.0]), (505, []), (506, [1.0] * 4)] + rows[:9]
    vectors = spark.createDataFrame([(i, v, 7, "mine") for i, v in rows], "vec_id long, embedding array<double>, cluster int, __x string").repartition(3)
    cents = lloyd.fit(vectors, k=9, rounds=3, dimensions=3)
    out = lloyd.assign(vectors, cents)
    assert out.columns == ["vec_id", "embedding", "__x", "cluster", "distance"]
    want, wanted = plain_lloyd(rows, 9, 3, 3)
    assert cents.tolist() == wanted
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()) == want


def test_lloyd_on_few_rows_ties_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)]):
        empty = spark.createDataFrame(rows, schema)
        cents = lloyd.fit(empty)
        assert not len(cents) and lloyd.assign(empty, cents).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(5)], schema)
    cents = lloyd.fit(same)
    assert cents.tolist() == [[128] * 64] * 5  # all equal: number 0 takes all, the empty ones stay
    assert {(r["cluster"], r["distance"]) for r in lloyd.assign(same, cents).collect()} == {(0, 0)}


def test_lloyd_query_without_vectors(spark, tmp_path):
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert lloyd.op13_lloyd(spark, str(tmp_path)).count() == 0


def test_lloyd_on_components_beyond_32_bits(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    cents = lloyd.fit(rows, k=2, rounds=1, dimensions=2)
    got = lloyd.assign(rows, cents).collect()
    assert len(got) == 3 and all(0 <= r["distance"] <= lloyd.LONG for r in got)
    assert lloyd.inertia(lloyd.assign(rows, cents))
