"""Components, classes instead of pairs, first rows without windows, and prefix digests, against plain Python."""

import random

from pyspark.sql import functions as F

from tracemill.operators import graph, neardup, prefixes, profile


def find(part, x):
    while part[x] != x:
        x = part[x]
    return x


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 470)] + [(600, k) for k in range(601, 900)] + [(5, 5)]
    part = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(part, a), find(part, b)
        part[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(part, x) for x in part if find(part, x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_count_links_as_pairs_do(spark):
    rng = random.Random(2)
    bases = [rng.sample(range(200), rng.randrange(4, 30)) for _ in range(12)]
    rows = []
    for i in range(150):
        s = set(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            s ^= {rng.randrange(200)}
        rows.append((i, rng.choice(["train", "dev", "test"]), [f"w{x}" for x in s]))
    rows += [(200, "train", []), (201, None, rows[0][2])]
    df = spark.createDataFrame(rows, "id long, split string, tokens array<string>")
    sets = {i: (p, set(t)) for i, p, t in rows if t}
    part, n = {i: i for i in sets}, dict.fromkeys(sets, 0)
    for i, (p, a) in sets.items():
        for j, (q, b) in sets.items():
            if i != j and len(a & b) * 100 >= 85 * len(a | b):
                n[i] += p != q
                x, y = find(part, i), find(part, j)
                part[max(x, y)] = min(x, y)
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in neardup.classes(df, "id", "split", "tokens", 85).collect()}
    assert got == {i: (find(part, i), n[i]) for i in sets}
    known = df.where("split is not null")
    pairs = neardup.cross_split_pairs(known, "id", "split", "tokens", 85)
    assert pairs.count() * 2 == sum(r["n_links"] for r in neardup.classes(known, "id", "split", "tokens", 85).collect())


def test_many_copies_give_rows_and_no_pairs(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("split"), F.array(F.lit("same"), F.lit("words")).alias("tokens"))
    out = neardup.classes(df, "id", "split", "tokens", 85).agg(F.count("*"), F.min("n_links"), F.max("n_links"), F.max("class_id")).first()
    assert tuple(out) == (20_000, 10_000, 10_000, 0)


def test_keep_first(spark):
    rows = [("k", 3, 1), ("k", 1, 0), ("k", 2, None), (None, 5, 1), (None, 4, 1), ("x", 9, 2)]
    df = spark.createDataFrame(rows, "key string, id int, label int")
    got = {r["id"]: (r["kept"], r["conflict"]) for r in profile.keep_first(df, "key", ["id"], "label").collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, True), 4: (True, False), 5: (False, False), 9: (True, False)}
    plan = profile.keep_first(df, "key", ["id"], "label")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_prefix_digests_tell_equal_prefixes(spark):
    rng = random.Random(3)
    conversations = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(60)] + [["a"] * 40]
    rows = spark.createDataFrame([(c, i, t) for c, ts in enumerate(conversations) for i, t in enumerate(ts)], "conv long, i int, t string")
    for block in (4, 4_096):
        found = {(r["conv"], r["i"]): r for r in prefixes.digests(rows, F.col("t"), block=block).collect()}
        by_text = {}
        for (c, i), r in found.items():
            assert r["n_before"] == i
            by_text.setdefault(tuple(conversations[c][:i]), set()).add(r["prefix"])
        assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
        if block == 4:
            small = {k: r["prefix"] for k, r in found.items()}
    assert small == {k: r["prefix"] for k, r in found.items()}
    plan = prefixes.digests(rows, F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    again = prefixes.repeated(prefixes.digests(rows, F.col("t")), "t").where("labels > 1")
    assert again.count() == sum(len({conversations[c][len(p)] for c in range(len(conversations)) if tuple(conversations[c][: len(p)]) == p and len(conversations[c]) > len(p)}) > 1 for p in by_text)


def test_one_target_a_conversation(spark):
    rows = spark.createDataFrame([(c, i, "assistant" if i % 2 else "user") for c in range(20) for i in range(9)] + [(99, 0, "user")], "conv long, i int, role string")
    out = prefixes.cut_at_one_target(rows).groupBy("conv").agg(F.max("i").alias("last"), F.first("target").alias("t"), F.count("*").alias("n")).collect()
    assert len(out) == 20 and all(r["last"] == r["t"] == r["n"] - 1 and r["t"] % 2 for r in out)
