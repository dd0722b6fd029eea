"""Nulls, repeats, empty tables, ties and clashing names through whole operators and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import chat_format, decontaminate, html_extract, line_dedup, quality, simhash, source_mix, winnow

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, __score double, copy int, f string"


def written(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.0, 9, "x") for i, t, s in docs], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(51)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    a, b, c, item = prose(60), prose(180), prose(40), prose(14)
    near = b.split()
    near[40], near[120] = "changed", "words"
    docs = [(1, a, "s"), (1, a, "s"), (1, b, "s"), (None, c, "s"), (None, c, "s"), (2, a, "s"), (3, None, "s"), (4, "", "s"), (5, f"{prose(9)} {item} {prose(9)}", "s"), (6, " ".join(near), "s"), (7, prose(30), "s")]
    folder = written(spark, tmp_path, docs, [(k, 1, 0) for k in (1, 2, 6, 7)] * 3 + [(None, 1, None), (3, None, None)], [("i", item), (None, None), ("e", "")])
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*corpus_pipeline.COLUMNS, "copy"]
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert got == {(1, a), (1, b), (None, c), (3, None), (7, docs[-1][1])}


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [], [])).count() == 0


def test_a_fit_collects_no_more_than_its_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "Model", lambda x, y: seen.append((len(x), len(y))))
    docs = spark.range(200).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), sample=20)
    quality.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), sample=20)
    assert seen == [(20, 20), (0, 0)]


def test_quality_against_tables_added_one_by_one(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "12", "Gamma!", "##", "x"], rng.integers(1, 40))) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("##" in (t or "").split())) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["s"] for r in quality.add_score(docs, model, out="s").collect()}
    for i, t in enumerate(texts):
        x, logit = quality.features(t), model.base
        bins = [int(sum(edge <= v for edge in e)) for e, v in zip(model.edges, x, strict=True)]
        for k, own in zip(bins, model.tables, strict=True):
            logit += own[k]
        for p, q, own in model.pairs:
            logit += own[bins[p] * quality.PAIR_BINS // len(model.tables[p]), bins[q] * quality.PAIR_BINS // len(model.tables[q])]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
    held = {r["doc_id"] for r in docs.where(quality.held_out()).select("doc_id").collect()}
    agree = [(got[i] >= 0.5) == ("##" in (texts[i] or "").split()) for i in held]
    assert sum(agree) > 0.9 * len(agree)


def test_clashing_names_pass_through_or_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j\nk", "s", "p", "q", 7, "w")], "doc_id long, text string, source string, doc string, text_key string, n_lines int, ws string")
    assert line_dedup.drop_boilerplate(docs, host="source").columns == [*docs.columns, "n_dropped"]
    items = spark.createDataFrame([("x", "A b c d e f g h i J k")], "item_id string, text string")
    assert decontaminate.clean(docs, items).count() == 0 and decontaminate.clean(docs, items.limit(0)).collect() == docs.collect()
    assert decontaminate.report(docs, items).first()["n_hit"] == 11
    mixed = docs.withColumns({"target": F.lit("t"), "copies": F.lit("c"), "__cell": F.lit("x"), "size": F.lit("s")})
    assert source_mix.mix(mixed).columns == ["doc_id", "source", "size", "source_size", "target", "copies"]
    assert simhash.keep_one(docs.withColumns({"f": F.lit(1), "root": F.lit(2)})).count() == 1
    turns = spark.createDataFrame([(1, 0, "user", "hi", "b", 3, 4)], "conv_id long, turn long, role string, text string, block string, i int, lead int")
    assert chat_format.windows(turns).first()["formatted"] == "[INST]hi[/INST]"
    pages = spark.createDataFrame([(1, "http://h.org/a", "<p>x</p>", "low", "site")], "page_id long, url string, html string, low string, blocks string")
    assert html_extract.extract(pages).collect()[0].asDict() == {"page_id": 1, "url": "http://h.org/a", "low": "low", "blocks": "site", "text": "x"}


def test_mix_of_odd_sources(spark):
    rows = [(None, None, None), (1, "a b c", None), (1, "a b c", None), (2, "", "s"), (3, "one two", ""), (None, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = source_mix.mix(docs).collect()
    assert len(out) == 6 and all(0 <= r["copies"] <= 2 for r in out)
    assert {r["source"]: r["source_size"] for r in out} == {None: 6, "s": 1, "": 2}
    assert source_mix.mix(docs.limit(0)).count() == 0
    assert winnow.with_edited(docs).count() == 6
