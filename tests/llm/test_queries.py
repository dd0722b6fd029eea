"""The queries on the smallest tables: against their SQL, or against plain Python."""

import hashlib
import math
import os
import re
import struct
from html import unescape

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in SQL if n.startswith("op")])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = c.sql(SQL[name]).df(), run(spark, name)
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda f: sorted(tuple(map(plain, r)) for r in f[sorted(f.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_quality_is_learned_from_the_other_rows(spark):
    got = run(spark, "op2_quality").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert len(run(spark, "op2_quality")) == len(documents())
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    import zlib

    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def test_main_text_of_the_template(spark):
    got = run(spark, "op4_html_extract").set_index("page_id")
    for p in pd.read_parquet(f"{SF}/pages.parquet").itertuples():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", ""))).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert got.loc[p.page_id, "text"] == "\n".join(b for b in blocks if b)
        assert got.loc[p.page_id, "n_chars"] == len(got.loc[p.page_id, "text"])


def test_simhash_against_all_pairs(spark):
    from xxhash import xxh64_intdigest

    got = run(spark, "op5_simhash").set_index("doc_id")
    want = {}
    for d in documents().itertuples():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        want[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    assert all(int(got.loc[i, "fingerprint"], 16) == f for i, f in want.items())
    part = {i: i for i in want}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(want)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (want[a] ^ want[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                part[y] = x
    assert all(got.loc[i, "component_id"] == root(i) for i in ids)


def winnowed(text):
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [signed(xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams = []
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxh64_intdigest(struct.pack("<q", w), h)
        grams.append(h & 0xFFFFFFFF)
    kept = {}
    for at in range(max(1, len(grams) - 7) if grams else 0):
        window = grams[at : at + 8]
        kept[max(at + k for k, g in enumerate(window) if g == min(window))] = None
    return [(grams[i], i) for i in kept]


def test_winnowing_against_plain_windows(spark):
    got = run(spark, "op6_winnow").set_index("doc_id")
    docs = documents().sort_values("doc_id", ascending=False)
    texts = docs["text"].tolist()
    like = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / max(1, len({h for h, _ in a} | {h for h, _ in b})) if a or b else 1.0
    for k, (i, text) in enumerate(zip(docs["doc_id"], texts, strict=True)):
        other = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got.loc[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == ",".join(f"{h:x}:{p}" for h, p in winnowed(text))
        assert r["edited_fingerprint"] == ",".join(f"{h:x}:{p}" for h, p in winnowed(edited))
        assert np.isclose(r["near_edited"], like(winnowed(text), winnowed(edited))) and np.isclose(r["near_next"], like(winnowed(text), winnowed(other)))


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = run(spark, "op10_token_counts").set_index("doc_id")
    for d in documents().itertuples():
        n = len(model.encode(d.text, num_threads=1))
        assert (got.loc[d.doc_id, "n_tokens"], got.loc[d.doc_id, "n_bytes"], got.loc[d.doc_id, "over_limit"]) == (n, len(d.text.encode()), n > 4096)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = run(spark, "op2_quality").set_index("doc_id")["score"]
    frames = [docs.toPandas()]
    for _, stage in p.STAGES:
        docs = stage(spark, spark.createDataFrame(frames[-1], docs.schema if "copy" not in docs.columns else None), SF)
        frames.append(docs.toPandas())
    first, good, lines, single, clean, mixed = frames
    assert all(list(f.columns) == p.COLUMNS for f in frames[:-1])
    assert set(good["doc_id"]) == set(scores[scores >= 0.7].index)
    # Line dedup: a line goes where more than a twentieth of the source's distinct texts, and five or more, have it.
    pages = {s: set(g["text"]) for s, g in good.groupby("source")}
    for d in good.itertuples():
        own = pages[d.source]
        bad = {x for x in (y.strip(" ") for y in d.text.split("\n")) if x and (n := sum(x in {z.strip(" ") for z in t.split("\n")} for t in own)) >= 5 and n > 0.05 * len(own)}
        want = "\n".join(y for y in d.text.split("\n") if y.strip(" ") not in bad)
        kept = lines[lines["doc_id"] == d.doc_id]
        assert kept["text"].tolist() == ([want] if want.strip() or not bad else []) and (kept["n_chars"] == kept["text"].map(len)).all()
    assert set(single["doc_id"]) <= set(lines["doc_id"]) and single["text"].is_unique
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda w: {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    held = set().union(*(grams(words(t)) for t in pd.read_parquet(f"{SF}/benchmark.parquet")["text"]))
    assert set(clean["doc_id"]) == {d.doc_id for d in single.itertuples() if not grams(words(d.text)) & held}
    times = mixed.groupby("doc_id").size()
    assert set(times.index) <= set(clean["doc_id"]) and times.max() <= 2
    size = lambda f: f["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).sum()
    assert abs(size(mixed) - 1.5 * size(clean)) < 0.1 * size(clean)
