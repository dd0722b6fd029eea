"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns; brute force where SQL has none."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import chat_format, decontaminate, html_extract, line_dedup, near_copies, quality, simhash, token_counts, url_filter, winnow
from tracemill.llm.html_extract import Page

DOCS = "doc_id long, text string, source string, n int, d string, h long, ws string, __keep string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, s, 1, "d", 2, "w", "k") for i, t, s in rows], DOCS)


@pytest.fixture
def odd(spark):
    return docs(spark, (1, "a b c d e f g h i j k l", "s"), (1, "a b c d e f g h i j k l", "s"), (None, None, None), (2, "", "s"), (3, "long " * 30000, None), (4, "　 é\U0001f642\n\n", "s"), (None, "a b c d e f g h i j k", "s"))


def test_line_dedup_cases(spark, odd):
    out = line_dedup.drop_boilerplate(odd, host="source")
    assert out.count() == 7 and set(odd.columns) < set(out.columns)
    assert line_dedup.drop_boilerplate(odd.limit(0), host="source").count() == 0
    many = docs(spark, *[(i, f"Same line\nown {i}\n  Same line  ", "x") for i in range(10)], *[(100 + i, "copy\nof one", "y") for i in range(50)])
    for rows in (many, many.repartition(5)):
        for most in (0, 1000):  # shuffled and broadcast
            got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(rows, host="source", broadcast_rows=most).collect()}
            assert got[3] == "own 3" and got[100] == "copy\nof one"


def test_decontaminate_cases(spark, odd):
    items = spark.createDataFrame([("x", "A b, c d e f g h i j"), ("y", "k l"), ("z", "g"), ("e", None), (None, "nowhere at all"), ("x2", "a B c d e f g h i j")], "item_id string, text string")
    for keys in (0, 1000):
        found = decontaminate.hits(odd, items, broadcast_keys=keys).collect()
        got = {(r["doc"], r["n_hit"]): r["hit_items"] for r in found}
        assert got == {(1, 12): ["x", "x2", "y", "z"], (None, 10): ["x", "x2", "z"]}
    assert decontaminate.report(odd, items).count() == 7
    assert decontaminate.clean(odd, items).count() == 4
    assert decontaminate.report(odd, items.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.report(odd.limit(0), items).count() == 0


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    d = [(i, text(rng.randint(0, 80)), "s") for i in range(40)]
    b = [(f"i{k}", text(rng.choice([1, 2, 3, 9, 12, 15]))) for k in range(12)]
    both = [{r["doc"]: (r["n_words"], r["n_hit"], r["hit_items"]) for r in decontaminate.report(docs(spark, *d), spark.createDataFrame(b, "item_id string, text string"), broadcast_keys=k).collect()} for k in (0, 1_000_000)]
    got = both[0]
    assert both[1] == got
    for i, t, _ in d:
        w, hit, items = t.split(), set(), set()
        for name, s in b:
            v = s.split()
            for at in range(max(1, len(v) - 9)):
                win = v[at : at + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        items.add(name)
        assert got[i] == (len(w), len(hit), sorted(items))


def test_winnow_cases(spark, odd):
    out = winnow.with_fingerprint(winnow.with_next(odd.select("doc_id", "text")), "text", "fp", "hs").collect()
    by = {}
    for r in out:
        by.setdefault(r["text"], set()).add(tuple(r["fp"]))
    assert all(len(v) == 1 for v in by.values()) and by[""] == {()}
    keys = spark.createDataFrame([(k,) for k in [-(2**40), -5, 0, 3, 700, 701, 2**50]], "k long")
    old, winnow.CHAIN_ROWS = winnow.CHAIN_ROWS, 2
    try:
        got = {r["k"]: r["next"] for r in winnow.following(keys).collect()}
    finally:
        winnow.CHAIN_ROWS = old
    assert got == {2**50: 701, 701: 700, 700: 3, 3: 0, 0: -5, -5: -(2**40), -(2**40): None}


@pytest.mark.parametrize("ids", ["dense", "sparse", "null", "repeated", "mixed"])
def test_winnow_neighbours_in_any_order_of_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(winnow, "HEAVY", 6)
    monkeypatch.setattr(winnow, "CHAIN_ROWS", 3)
    rng = random.Random(21)
    pick = {"dense": lambda i: i, "sparse": lambda i: i * 2**40 - 2**44, "null": lambda i: None, "repeated": lambda i: 7, "mixed": lambda i: rng.choice([None, 5, 600, i, -i * 1000])}[ids]
    rows = [(pick(i), rng.choice([None, "", f"text {i} " + "word " * rng.randint(0, 9), "a copy of one"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed[r[1]], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        half, other = len(t) // 2, order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in winnow.with_edited(df.repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_winnow_of_empty_and_single_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert winnow.with_edited(df.limit(0)).count() == 0
    assert [r["near_next"] for r in winnow.with_edited(df).collect()] == [1.0]


def test_simhash_buckets_of_any_size_lose_no_link(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(40)} | {0, 1, 3, 7, (1 << 64) - 1}
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "f long")
    part = {v: v for v in values}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    listed = sorted(values)
    for n, a in enumerate(listed):
        for b in listed[n + 1 :]:
            if (a ^ b).bit_count() <= 2:
                part[root(b)] = root(a)
    want = {}
    for v in values:
        want.setdefault(root(v), set()).add(v)
    for bucket in (1, 3, 64):
        got = {}
        rooted = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(nodes, bucket)).collect()}
        for v in values:
            got.setdefault(rooted.get(v, v), set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_masks_cover_and_cases(spark, odd):
    masks = simhash.masks()
    assert all(any((1 << a | 1 << b) & m == 0 for m in masks) for a in range(64) for b in range(64))
    for m in masks:
        fine = simhash.finer(m)
        free = [i for i in range(64) if not m >> i & 1]
        assert all(f & m == m and (~f & (1 << 64) - 1).bit_count() <= 8 for f in fine)
        assert all(any((1 << a | 1 << b) & f == 0 for f in fine) for a in free for b in free)
    got = simhash.cluster(odd).collect()
    assert len(got) == 7 and {r["component_id"] for r in got if r["f"] == 0} == {2}
    assert simhash.cluster(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.where("doc_id = 1").count() == 1 and kept.columns == odd.columns


def test_keep_one_decides_by_row(spark):
    a, b, c, e = ("alpha beta gamma delta", "one two three four five", "red green blue black white", "sun moon star sky rain")
    rows = docs(spark, (1, a, "s"), (None, a, "s"), (None, b, "s"), (2, a, "s"), (2, c, "s"), (5, e, "s"), (5, e, "s"), (7, "x y z", "s"), (7, "p q r", "s"), (8, "", "s"), (8, None, "s"), (None, "u v w", "s"), (None, "u v w", "s"), (9, "Far Away", "s"), (9, "far away", "s"))
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(rows.repartition(3)).collect()), key=str)
    empty = [x for x in got if x[0] == 8]
    assert len(empty) == 1
    want = [(1, a), (None, b), (2, c), (5, e), (7, "x y z"), (7, "p q r"), (None, "u v w"), (None, "u v w"), (9, "Far Away")]
    assert [x for x in got if x[0] != 8] == sorted(want, key=str)


def test_near_copies_against_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases, texts = [[word() for _ in range(rng.choice([3, 20, 60, 150, 250]))] for _ in range(12)], ["", None, "A b", "a  B"]
    notice = [word() for _ in range(12)]  # common to unrelated texts
    for b in bases:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w + (notice if rng.random() < 0.5 else [])))
    rows = docs(spark, *[(i, t, "s") for i, t in enumerate(texts)])
    grams = lambda w: frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = [grams((t or "").lower().split()) for t in texts]
    part = list(range(len(texts)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                part[root(i)] = root(j)
    want = {}
    for i in range(len(texts)):
        want.setdefault(root(i), set()).add(i)
    assert 20 < len(want) < len(texts) - 20
    for common, hot, most in ((5, 64, 9), (10_000, 9, 0)):  # the order bears on the work only
        monkeypatch.setattr(near_copies, "COMMON", common)
        got = {}
        for r in near_copies.grouped(rows, hot=hot, most=most).collect():
            got.setdefault(r["root"], set()).add(r["doc_id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert near_copies.grouped(rows.limit(0)).count() == 0
    # With fingerprints: what either links.
    bits = [simhash.fingerprint(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= simhash.RADIUS:
                part[root(i)] = root(j)
    want, got = {}, {}
    for i in range(len(texts)):
        want.setdefault(root(i), set()).add(i)
    for r in near_copies.grouped(rows, bits=True).collect():
        got.setdefault(r["root"], set()).add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_copies_of_passages_grow_with_the_texts(spark, monkeypatch):
    """Texts that a passage fills to 70 to 88 per cent, which link to none: candidates don't grow with the square of the texts."""
    monkeypatch.setattr(near_copies, "COMMON", 10_000)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passages, made = [[word() for _ in range(60)] for _ in range(3)], []
    for n in (150, 600):
        pairs = []
        texts = [" ".join([word() for _ in range(rng.randrange(9, 20))] + passages[i % 3]) for i in range(n)]
        keep = near_copies.stored
        monkeypatch.setattr(near_copies, "stored", lambda df, seen=pairs: (out := keep(df), seen.append(out.count()) if out.columns == ["a", "b"] else 0)[0])
        got = near_copies.grouped(docs(spark, *[(i, t, "s") for i, t in enumerate(texts)]), hot=8).collect()
        monkeypatch.setattr(near_copies, "stored", keep)
        assert len({r["root"] for r in got}) == n
        made.append(sum(pairs))
    assert made[1] <= 5 * max(made[0], 20)


def test_near_dedup_stage_finds_edited_copies(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(180)]
    edited = [*w[:60], "changed", *w[61:150], "added", *w[150:]]
    assert (simhash.fingerprint(" ".join(w)) ^ simhash.fingerprint(" ".join(edited))).bit_count() > simhash.RADIUS
    other = " ".join(rng.choice(w) for _ in range(100))
    rows = spark.createDataFrame([(3, " ".join(w), "en", "s", 1), (2, " ".join(edited), "en", "s", 1), (None, other, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in p.near_dedup_stage(spark, rows, "").collect()} == {2, None}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and got[101] == 100


def test_components_of_few_edges_take_few_tasks(spark):
    """Rounds over a small table don't cost a task, with its files and log, for each partition of each shuffle."""
    sc, wide = spark.sparkContext, {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 130)]
    want = {i: 0 for i in range(1, 61)} | {j: 100 for j in range(101, 130)}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "components")
        got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        seen = sc.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup("few-tasks") for s in seen.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := seen.getStageInfo(s)))
    finally:
        sc.setJobGroup("other", "")
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k: v for k, v in got.items() if k != v} == want
    assert tasks < 600  # several rounds of a handful of shuffles; each shuffle at full width takes 50
    # Several tasks, as for a large table, give the same.
    assert {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), each=10).collect()} == got


def test_quality_cases(spark, odd):
    model = quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["s"] for r in quality.add_score(odd, model, out="s").collect()} == {0.5}
    one = quality.fit(odd, spark.createDataFrame([(1, 1), (2, None), (3, 1)], "doc_id long, quality int"))
    assert all(0.5 < r["s"] < 1 for r in quality.add_score(odd, one, out="s").collect())
    x = np.random.default_rng(0).normal(size=(2000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no main effect: only a pair can tell
    m = quality.Model(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.85


def test_token_counter_against_the_library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, library = token_counts.Counter(token_counts.load(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    letters = "ab thein  \n\t<s></s>é日本語あ🙂的一 ▁ \x00_--==##//**aeioust0123​\r"
    draw = lambda of, most: "".join(rng.choice(of) for _ in range(rng.randint(1, most)))
    texts = ["", " ", "</s>", "a" * 5000, "  " * 40, "=" * 77, "x" + " " * 33 + "y"] + [draw("etha", 900) for _ in range(300)] + [draw("abcdefghijklmnopqrstuvwxyz", 900) for _ in range(200)]
    texts += [(" " * rng.randint(0, 60)).join(draw("x=\n", 4) for _ in range(6)) for _ in range(300)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    assert counter.count(texts) == [len(t) for t in library.encode(texts, num_threads=1)]


@pytest.mark.parametrize("piece", [" ", "the", "=", "eth", "inger", "a", "\n", "的", None])
def test_token_counts_of_a_long_text_without_breaks_take_seconds(piece):
    import public_tokenizers
    import sentencepiece

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    text = (piece * 1_000_000)[:1_000_000] if piece else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    counter, began = token_counts.Counter(token_counts.load(path)), time.perf_counter()
    found = counter.count([text])
    took = time.perf_counter() - began
    assert found == [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))] and took < 20


def test_token_count_cases(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = token_counts.add_counts(odd.repartition(16), path, out="n")
    got = {(r["doc_id"], r["text"]): r["n"] for r in out.collect()}
    assert out.count() == 7 and out.columns == odd.columns and got[None, None] == got[2, ""] == 0 and got[3, "long " * 30000] == 30001
    assert token_counts.add_counts(odd.limit(0), path).count() == 0


def chat_format_plain(role, text):
    """A turn in its marks, by the template."""

    def escaped(t):
        t = t.replace("~", "~0")
        for mark in ("[INST]", "[/INST]"):
            t = t.replace(mark, "~1" + mark[1:])
        return re.sub(r"<(?=/?s>|</?SYS>>)", "~2", t)

    left, right = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}.get(role, (f"[INST]<<SYS>>{escaped(role)}<</SYS>>", "[/INST]"))
    return left + escaped(text) + right


@pytest.mark.parametrize("block", [512, 8, 1])
def test_chat_windows_round_trip(spark, block):
    rng = random.Random(8)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "~", "~1", "[", "<", "/INST]", "é", "\n", "word ", "\\", "$1"]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 25)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool", "<s>x", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(1, 60))), "word " * rng.randint(1, 300)])))
    rows += [(3, 1, "user", "again"), (None, 0, "user", "x"), (3, None, "assistant", "first")]
    w = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=block).cache()
    back = chat_format.read_back(w).orderBy("conv_id", "window").collect()
    got, targets = {}, {}
    for r in back:
        got.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
        targets.setdefault(r["conv_id"], []).extend(r["targets"])
    none_first = lambda v: (v is not None, v or 0)
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (none_first(r[1]), r[2] or "", r[3] or ""))]
        assert got[c] == want and targets[c] == [t for role, t in want if role == "assistant"]
    assert w.where("window > 1 and n_context > 0").count() > 0
    # The repeats are the turns that stand before, and the latest system turn if it isn't among them.
    frames = {c: [(chat_format_plain(role, t), role, -(-len(t) // 4) + 4) for role, t in got[c]] for c in got}
    for r in back:
        at = r["window"] - 1
        own, near, cost = frames[r["conv_id"]], [], 0
        for k in range(at - 1, max(-1, at - 4), -1):
            cost += own[k][2]
            if cost > 128:
                break
            near.insert(0, k)
        system = [k for k in range(at) if own[k][1] == "system"][-1:]
        context = [k for k in system if k < at - len(near)] + near
        assert r["n_context"] == len(context) and r["formatted"].startswith("".join(own[k][0] for k in context))
    assert chat_format.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_url_filter_cases(spark):
    entries = spark.createDataFrame(
        [("l", "block", "domain", "bad.com", "add", "2024-01-10"), ("l", "block", "domain", "bad.com", "remove", "2024-02-10"), ("l", "block", "prefix", "ok.org/x/", "add", "2024-01-01"), ("a", "allow", "host", "good.bad.com", "add", "2024-01-15"), ("l", "block", "domain", None, "add", "2024-01-01"), ("l", "block", "url", "http://ok.org/q?a=1", "add", "2024-03-01"), ("l", "block", "url", "http://ok.org/q?a=1", "remove", "2024-03-01")],
        "list string, effect string, kind string, key string, action string, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    cases = [("http://u@Good.BAD.com:80/", "2024-01-12", True), ("http://good.bad.com/", "2024-01-20", False), ("http://x.bad.com/", "2024-01-10", True), ("http://x.bad.com/", "2024-02-10", False), ("http://notbad.com/", "2024-01-20", False), ("https://ok.org/x/y#z", "2024-05-01", True), ("https://ok.org/xy", "2024-05-01", False), ("http://ok.org/q?a=1#f", "2024-03-02", True), (None, "2024-01-20", False), ("nonsense", "2024-01-20", False), ("http://x.bad.com/", None, False), ("http://x.bad.com/", "2024-01-10", True)]
    captures = spark.createDataFrame([(i, u, t, "k") for i, (u, t, _) in enumerate(cases)], "i int, url string, t string, key string").withColumn("fetched_at", F.col("t").cast("timestamp"))
    for most in (0, 1000):
        got = {r["i"]: r["blocked"] for r in url_filter.evaluate(captures, entries, broadcast_rows=most).collect()}
        assert got == {i: b for i, (_, _, b) in enumerate(cases)}
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0 and url_filter.evaluate(captures, entries.limit(0)).where("blocked").count() == 0


def main_text(html):
    return "\n".join(t for _, t in Page(html).kept())


def test_html_meaning_and_repairs():
    html = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id=menu>Menu</div><main><div class="cookie-notice">We use</div><article class=post><h1>T &amp; x</h1><p>a<b>b</b>c<br>d &nbsp; e<p>second
    <div role="search">find</div><ul><li>one<li>two</ul><script>if(a<b){}</script><table><tr><td>x<td>y</table><article class="comment">bad</article><div hidden>h</div></article></main><aside>s</aside><form><input> q</form><footer>f</footer></body></html>"""
    assert main_text(html) == "T & x\nabc d e\nsecond\none\ntwo\nx\ny"
    assert main_text("plain <i>text</i> &lt;x&gt; 3 < 4 <p class='") == "plain text <x> 3 < 4 <p class='"
    assert main_text("<div>one<div>two</div>three</div><!-- no --><nav>n</nav>") == "one\ntwo\nthree"
    assert main_text("<p title=don't>a</p><p title='x>y'>b</p>1 < 2 <!-- open <p>c") == "a\nb\n1 < 2"


@pytest.mark.parametrize("start", ['h2 id="discussion"', 'section id="discussion"', 'h2 id="search-algorithms"', 'section class="related-work"', 'p class="share-price"', 'h2 id="reply-to-smith"', 'p id="rail-network"', 'div class="notice-of-works"', 'blockquote class="social"', 'div class="header-image-caption"'])
def test_html_names_decide_nothing(start):
    assert main_text(f"<article><{start}>kept</{start.split()[0]}><p>more</article>") == "kept\nmore"


@pytest.mark.parametrize("part, end", [("<a ", ""), ("<a ", ">x"), ('<a "', ">x"), ('<a b="> ', ""), ("<div>x", ""), ("<b>x", ""), ("<!--", ""), ("<", ">"), ("</a ", ""), ("<ul><li>", "")])
def test_html_of_any_shape_takes_linear_time(part, end):
    began = time.perf_counter()
    page = Page(part * (1_000_000 // len(part)) + end)
    page.branches(page.kept())
    assert time.perf_counter() - began < 20


def hosts(rng):
    """Pages of hosts with a repeated strip, a list with a few entries and stories of their own; some are copies."""
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    pages = []
    for host, n in (("a.com", 12), ("b.org", 7), ("c.net", 4), ("d.net", 6)):
        strip, entries = word(), [word() for _ in range(3)]
        for i in range(n):
            story = "".join(f"<p>{word()} {word()} {word() * 8}</p>" for _ in range(rng.randint(1, 3)))
            extra = f"<ul class=more><li>{rng.choice(entries)}<li>{rng.choice(entries)}</ul>" if rng.random() < 0.8 else ""
            core = ("<main>", "</main>") if host == "d.net" else ("", "")
            pages.append((f"http://{host}/{i}", f"<div class=top>{strip} <a href=/>home</a></div>{core[0]}<div class=tag{i}>{strip}</div><div class=story>{story}</div>{extra}{core[1]}"))
    return pages + pages[:3] + [("http://a.com/x", None), (None, "<p>alone</p>"), ("http://copies.org/1", "<div class=s><p>the same on all</p></div>")] + [(f"http://copies.org/{i}", "<div class=s><p>the same on all</p></div>") for i in range(9)]


def brute_importance(pages):
    """{(host, path): (m, importance)} and the low paths of each host, from the definition."""
    by_host = {}
    for url, html in pages:
        page = Page(html or "")
        kept = page.kept()
        by_host.setdefault(re.sub("^http://([^/]*).*", r"\1", url or ""), {}).setdefault("\n".join(t for _, t in kept), page.branches(kept))
    found, low = {}, {}
    for host, distinct in by_host.items():
        styles, features, chains, chars = {}, {}, {}, {}
        for paths, _, seen in distinct.values():
            for path, style, n, chain in paths:
                styles.setdefault(path, []).append(style)
                chains[path] = chain
                chars[path] = chars.get(path, 0) + n
            for p, f in seen:
                features.setdefault((paths[p][0], f), []).append(1)
        whole = sum(n for p, n in chars.items() if len(chains[p]) == 1)
        for path, seen in styles.items():
            m = len(seen)
            if m < 2:
                found[host, path] = (m, 1.0)
                continue
            share = [seen.count(s) / m for s in set(seen)]
            presentation = -sum(x * math.log(x, m) for x in share)
            worth = [1 - math.log(len(k), max(2, len(styles[at]))) for (at, _), k in features.items() if path in chains[at]]
            content = sum(worth) / len(worth) if worth else 0.0
            damp = 0.9 ** (len(share) - 1)
            found[host, path] = (m, (1 - damp) * presentation + damp * content)
            if found[host, path][1] < 0.2 and m >= 5 and chars[path] * 2 <= whole:
                low.setdefault(host, set()).add(path)
    return found, low


def test_html_style_tree_against_its_definition(spark):
    pages = hosts(random.Random(9))
    want, low = brute_importance(pages)
    df = spark.createDataFrame([(i, u, h, "kept", "low") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, row string, text string")
    sites = {r["s"]: r["h"] for r in df.select(html_extract.host_of(F.col("url")).alias("h"), F.xxhash64(html_extract.host_of(F.col("url"))).alias("s")).distinct().collect()}
    got = {(sites[r["site"]], r["path"] % (1 << 64)): (r["m"], r["importance"]) for r in html_extract.importance(html_extract.parsed(df).cache()).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == m and got[k][1] == pytest.approx(x, abs=1e-9) for k, (m, x) in want.items())
    assert set(low) >= {"a.com", "b.org"} and "copies.org" not in low and "c.net" not in low
    changed = 0
    for most in (0, 1000):  # shuffled and broadcast
        out = html_extract.extract(df, broadcast_rows=most)
        assert out.columns == ["page_id", "url", "row", "text"]
        for r in out.collect():
            url, html = pages[r["page_id"]]
            page = Page(html or "")
            kept = page.kept()
            paths, ranges, _ = page.branches(kept)
            gone = {i for p, a, b in ranges if paths[p][0] in low.get(re.sub("^http://([^/]*).*", r"\1", url or ""), ()) for i in range(a, b)}
            assert r["text"] == "\n".join(t for i, (_, t) in enumerate(kept) if i not in gone) and r["row"] == "kept"
            changed += bool(gone)
    assert changed > 20  # the tree decides
    assert html_extract.extract(df.limit(0)).count() == 0
