"""Gates, contracts, shards, sinks and the evaluation that is no SQL."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import hashing
from tracemill.operators import contracts, gates, metrics, models, records, sequence
from tracemill.sources import jsonl, shards, sinks

GOOD = {"state": "s", "questions": {"q": {"type": "choice", "instructions": "i", "criteria": {"a": "x", "b": "y"}}}}


def test_paired_bootstrap_equals_replicates_made_row_by_row(spark):
    rng = random.Random(41)
    rows = [(f"g{rng.randrange(6)}", rng.choice("abc"), rng.choice("abc"), rng.choice("abc")) for _ in range(200)]
    df = spark.createDataFrame(rows, "grp string, gold string, a string, b string")
    labels = ["a", "b", "c", "d"]
    drawn = metrics.draws(df, "grp", 12).collect()
    got = {(r["metric"], r["rep"]): r["difference"] for r in metrics.paired_bootstrap(df, "grp", "gold", "a", "b", labels, 12).collect()}

    def scores(sample, k):
        f1 = []
        for x in labels:
            tp = sum(r[1] == x == r[k] for r in sample)
            every = sum(r[1] == x for r in sample) + sum(r[k] == x for r in sample)
            f1.append(2 * tp / every if every else 0.0)
        return sum(f1) / len(labels), sum(r[1] == r[k] for r in sample) / len(sample)

    for rep in range(-1, 12):
        sample = rows if rep < 0 else [r for d in drawn if d["rep"] == rep for r in rows if r[0] == d["grp"] for _ in range(d["times"])]
        (f_a, acc_a), (f_b, acc_b) = scores(sample, 2), scores(sample, 3)
        assert got["macro_f1", rep] == pytest.approx(f_a - f_b) and got["accuracy", rep] == pytest.approx(acc_a - acc_b)
    assert metrics.INTERVALS["floor_ceil"](1000) == (25, 974) and metrics.INTERVALS["probe"](5000) == (124, 4874) and metrics.INTERVALS["inner"](1000) == (24, 974)


def test_numbering_in_ranges(spark):
    rng = random.Random(42)
    values = [rng.choice([None, rng.randrange(50)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v int")
    got = {r["i"]: r["place"] for r in sequence.numbered(df, [F.col("v"), F.col("i")], "place").collect()}
    want = sorted(range(500), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert [got[i] for i in want] == list(range(1, 501))
    assert sequence.numbered(df.limit(0), [F.col("i")], "place").count() == 0


def test_linear_models_are_saved_and_scored(spark):
    model = spark.createDataFrame([("m", "x", "", 0.5), ("m", "x", "f", 2.0), ("m", "y", "", 0.0), ("m", "y", "g", -1.0)], "candidate string, label string, feature string, weight double")
    back = models.read_saved(spark, models.saved(model))
    assert sorted(back.collect()) == sorted(model.collect())
    vectors = spark.createDataFrame([(1, "f", 0.5), (1, "g", 2.0), (2, "other", 1.0)], "id int, feature string, value double")
    got = {(r["id"], r["label"]): r["p"] for r in models.linear_scores(back, vectors, spark.range(1, 4), "id").collect()}
    assert got[1, "x"] == pytest.approx(1 / (1 + math.exp(-3.5))) and got[2, "x"] == pytest.approx(1 / (1 + math.exp(-0.5))) and got[3, "y"] == pytest.approx(1 / (1 + math.exp(0.5))) and len(got) == 6
    with pytest.raises(ValueError):
        models.read_saved(spark, json.dumps({"format": "other", "rows": []}))


def test_contracts(spark):
    nan = float("nan")
    rows = [("a", "x", ["x", "y"], [0.5, 0.5]), ("a", "x", ["x", "y"], [0.5, 0.5]), ("b", "z", ["y", "x"], [0.7, 0.7]), (None, None, None, None), ("c", "y", ["x", "y"], [nan, 1.0]), ("d", "y", ["x", "y"], [None, 1.0]), ("e", "y", ["x", "y"], [-0.5, 1.5])]
    df = spark.createDataFrame(rows, "record_id string, gold_label string, names array<string>, values array<double>")
    got = [r["reasons"] for r in contracts.metric_reasons(df, ["x", "y"]).select("record_id", "reasons").orderBy(F.col("record_id").asc_nulls_first()).collect()]
    assert got == [["record_id", "repeated", "gold_label", "label_order", "values", "sum"], ["repeated"], ["repeated"], ["gold_label", "label_order", "sum"], ["values", "sum"], ["values", "sum"], ["values"]]
    replay = df.where("record_id in ('b', 'e')").withColumns({"model_id": F.lit("m"), "revision": F.lit(" "), "elapsed_seconds": F.lit(1.0)})
    assert [r["reasons"] for r in contracts.replay_reasons(replay, ["x", "y"]).orderBy("record_id").collect()] == [["model", "sum"], ["model", "values"]]
    with pytest.raises(ValueError):
        contracts.only(df, ["record_id"])
    assert contracts.only(df.select("record_id", "names"), ["names", "record_id"]).columns == ["names", "record_id"]
    texts = spark.createDataFrame([('{"b": [{"r": 1, "a": {"r": {}, "c": "r"}}], "r": 2}',), ("no",)], "t string")
    assert [r[0] for r in texts.select(contracts.without_key("r")("t")).collect()] == ['{"b":[{"a":{"c":"r"}}]}', None]


def test_canary_and_digest_notice_changes(spark):
    df = spark.createDataFrame([(1, "t", "s"), (2, "u", "u s")], "k int, target string, state string")
    leaks = gates.changed_by(df, "k", "target", F.lit("CANARY"), F.concat("state", F.when(F.col("k") == 2, F.col("target")).otherwise("")))
    assert [r["k"] for r in leaks.collect()] == [2]
    one, two = (gates.table_digest(d).first()["digest"] for d in (df.repartition(3), df.orderBy(F.desc("k"))))
    assert one == two != gates.table_digest(df.withColumn("state", F.lit("s"))).first()["digest"] != gates.table_digest(df.union(df)).first()["digest"]
    bad = gates.verdict(gates.checks({"a": df.where("k > 5"), "b": df}))
    assert [tuple(r) for r in bad.collect()] == [("a", True, 0), ("b", False, 2), ("all", False, 1)]


def test_shards(spark, tmp_path):
    for k in range(3):
        spark.range(k + 1).write.parquet(f"{tmp_path}/s{k}")
    spark.range(2).selectExpr("id", "'x' AS y").write.parquet(f"{tmp_path}/other")
    paths = [f"{tmp_path}/s{k}" for k in range(3)]
    assert shards.read(spark, paths).count() == 6 and [r["shards"] for r in shards.schemas(spark, paths).collect()] == [3]
    assert sorted(r["shards"] for r in shards.schemas(spark, [*paths, f"{tmp_path}/other"]).collect()) == [1, 3]
    listed = [{"path": "s0", "rows": 1}, {"path": "s1", "rows": 5}, {"path": "other", "rows": 2}]
    assert sorted(map(tuple, shards.manifest_problems(spark, listed, str(tmp_path)).collect())) == [("other", "schema"), ("s1", "rows")]
    for bad in ("/etc/x", "a/../../b", "", "a\\b"):
        with pytest.raises(ValueError):
            shards.safe_path(bad)
    assert shards.confined("s0", str(tmp_path)).endswith("/s0")
    with pytest.raises(ValueError):
        shards.confined("../x", str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, v string")
    for part in (rows, rows.where("id = 2"), rows.limit(0)):
        with pytest.raises(ValueError):
            shards.strict(part, "id", ["id", "v"])
    assert shards.strict(rows.where("v = 'a'"), "id", ["id", "v"]).count() == 1


def test_validated_lines_and_sinks(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text(json.dumps(GOOD) + "\n\n" + json.dumps(GOOD | {"state": 1}) + "\n[1]\n")
    lines = jsonl.numbered_lines(spark, str(path))
    with pytest.raises(ValueError, match=r"in.jsonl:3: state; .*in.jsonl:4: not_an_object"):
        jsonl.validated(lines)
    assert jsonl.validated(lines.where("line = 1")).count() == 1
    with pytest.raises(ValueError, match="no records"):
        jsonl.validated(lines.limit(0))
    assert jsonl.objects(lines.where("line < 4")).count() == 2
    with pytest.raises(Exception, match="no JSON object at"):
        jsonl.objects(lines).collect()
    columns = spark.createDataFrame([("plain text", '{"q": 1}', None), ('{"s": 2}', "{", "[]")], "state string, questions string, gold string")
    got = jsonl.decoded(columns).selectExpr("cast(state as string) s", "cast(questions as string) q", "reason").collect()
    assert [tuple(r) for r in got] == [("plain text", '{"q":1}', None), ('{"s":2}', None, "questions")]
    texts = spark.createDataFrame([(1, json.dumps(GOOD)), (0, json.dumps(GOOD | {"state": "first"}))], "i int, record string")
    sinks.write_valid(texts, "record", ["i"], f"{tmp_path}/out")
    assert [json.loads(r["value"])["state"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["first", "s"]
    with pytest.raises(ValueError):
        sinks.write_valid(texts.withColumn("record", F.lit("{}")), "record", ["i"], f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    sinks.write_lines(spark.createDataFrame([(2, 1)], "z int, a int"), ["z"], f"{tmp_path}/kept", by_name=False)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/kept").collect()] == ['{"z":2,"a":1}']
    sinks.create_once(f"{tmp_path}/once", b"a\nb\n")
    with pytest.raises(FileExistsError):
        sinks.create_once(f"{tmp_path}/once", b"c")
    assert sinks.file_stats(f"{tmp_path}/once") == {"bytes": 4, "rows": 2, "sha256": hashing.hashlib.sha256(b"a\nb\n").hexdigest()}
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("tmp")) == []


def test_envelope_takes_no_nan():
    assert len(records.envelope({"p": 0.5}, "x")) == 64
    with pytest.raises(ValueError):
        records.envelope({"p": float("nan")}, "x")


RECORDS = {
    "good": {"state": "s", "questions": {"q": {"type": "choice", "instructions": "i", "criteria": {"a": "x", "b": "y"}}}, "gold": {"q": {"type": "choice", "label": "a", "probabilities": {"a": 0.25, "b": 0.75}}}},
    "order": {"state": "s", "questions": {"q": {"type": "choice", "instructions": "i", "criteria": {"a": "x", "b": "y"}}}, "gold": {"q": {"type": "choice", "label": "a", "probabilities": {"b": 0.75, "a": 0.25}}}},
    "sum": {"state": {}, "questions": {"q": {"type": "noul", "instructions": "i", "criteria": None}}, "gold": {"q": {"type": "noul", "label": None, "probabilities": {"false": 0.5, "true": 0.4}}}},
    "one level": {"state": [], "questions": {"q": {"type": "score", "instructions": "i", "criteria": ["only"]}}},
    "no state": {"questions": {"q": {"type": "score", "instructions": " ", "criteria": ["a", "b"]}}},
}


def test_records_of_each_kind(spark):
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in RECORDS.items()], "name string, record string")
    got = {r["name"]: r["reasons"] for r in rows.select("name", records.record_reasons("record").alias("reasons")).collect()}
    assert got == {"good": [], "order": ["q:probability_keys"], "sum": ["q:probability_sum"], "one level": ["q:criteria"], "no state": ["state", "q:instructions"]}
