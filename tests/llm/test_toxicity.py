"""The subsequence kernel against its definition, and the fitted machine on made and on given texts."""

import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from tracemill.llm import toxicity

SF = "/root/testdata/sf0.1"
WORDS = ["river", "stone", "house", "window", "garden", "yellow", "market", "paper", "silver", "morning", "bridge", "letter", "summer", "coffee", "winter", "forest", "island", "music"]
INSULTS = ["blockhead", "numskull", "twerp"]


def key(word):
    return toxicity.units([word])[2][0]


def plain(a, b):
    """The sum over all pairs of equal subsequences of three, by enumeration."""
    decay = toxicity.DECAY
    cover = lambda w: [("".join(w[i] for i in p), decay ** (p[2] - p[0] + 1)) for p in itertools.combinations(range(len(w)), 3)]
    return sum(x * y for s, x in cover(a) for t, y in cover(b) if s == t)


def test_kernel_is_its_definition():
    rng = random.Random(1)
    words = ["aaaa", "abcabcabcabc", "abc", "xyz", *("".join(rng.choice("abcd") for _ in range(rng.randrange(3, 13))) for _ in range(40))]
    keys = np.array([key(w) for w in words])
    got = toxicity.Marks(keys[:9]).kernel(keys)
    for i, a in enumerate(words):
        for j, b in enumerate(words[:9]):
            want = (plain(a, b) / np.sqrt(plain(a, a) * plain(b, b))) ** toxicity.POWER
            assert got[i, j] == pytest.approx(want, rel=1e-9, abs=1e-12)
    rows = toxicity.letters(keys)
    for i, a in enumerate(words):
        assert toxicity.with_itself(rows[i : i + 1, : len(a)])[0] == pytest.approx(plain(a, a))


def spelled(text):
    return sorted("".join(chr(96 + v) for v in row if v) for row in toxicity.letters(toxicity.units([text])[2]))


def test_units():
    assert spelled("Some w.o.r-d ab a!") == ["some", "word"]
    assert spelled("x i d * i o t. end") == ["end", "xidiot"]
    assert spelled("a b no c d") == []
    assert spelled("abcdefghijklmno") == ["abcdefghijkl", "defghijklmno"]
    assert spelled("") == spelled(None) == spelled("!? .") == []
    own, begin, _ = toxicity.units([None, "one two", "", "a b c"])
    assert own.tolist() == [1, 1, 3] and begin.tolist() == [1, 5, 10]
    # Any ten neighbours of a long run are whole in one unit.
    run = "".join(random.Random(2).choice("abcdefgh") for _ in range(70))
    made = spelled(run)
    assert all(any(run[i : i + 10] in u for u in made) for i in range(61))


def made_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            sentences[rng.randrange(5)] += f" {rng.choice(INSULTS)} indeed"
        out.append((i, ". ".join(sentences) + ".", int(i % 4 == 0)))
    return out


def test_fit_and_scores_of_altered_insults(spark):
    rows = made_texts(600, 3)
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    clean = rows[1][1]
    tries = [("plain", "blockhead"), ("shout", "NUMSKULL!!"), ("spaced", "t w e r p"), ("dotted", "num.sku-ll"), ("inserted", "numsxkull"), ("inserted", "blockqhead"), ("in a run", "xyzblockheadxyz")]
    odd = spark.createDataFrame([(k, f"{clean} you {w} go", w) for k, w in tries] + [("none", clean, ""), ("none", clean, ""), ("none", None, ""), ("none", "", ""), ("none", "??", ""), ("none", clean * 3000, "")], "kind string, text string, score string")
    out = toxicity.add_score(odd, model)
    assert out.columns == ["kind", "text", "score"]
    got = out.collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.5) == (r["kind"] != "none") for r in got), [(r["kind"], r["score"]) for r in got]
    again = toxicity.add_score(docs.repartition(7), toxicity.fit(docs.repartition(5), labels)).select("doc_id", "score").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in toxicity.add_score(docs, model).select("doc_id", "score").collect()}


def test_fits_that_can_tell_nothing(spark):
    docs = spark.createDataFrame([(1, "same words here"), (2, "same words here"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, want in ((none, 1 / 3), (spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"), 1 / 5), (spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), 2 / 5)):
        model = toxicity.fit(docs, labels)
        assert [r["score"] for r in toxicity.add_score(docs, model).collect()] == pytest.approx([want] * 3)
    assert toxicity.add_score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_held_out_documents_of_the_given_tables(spark):
    got = toxicity.op11_toxicity(spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id"]))
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    seen = got[got["held_out"]].merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert (seen["predicted"] == seen["toxic"]).mean() > 0.97
    assert seen.loc[seen["toxic"] == 1, "predicted"].mean() > 0.85 and seen.loc[seen["toxic"] == 0, "predicted"].mean() < 0.01
