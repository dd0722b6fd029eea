"""Functions and operators on rows made for them."""

import json
import random
import re

from pyspark.sql import functions as F

import plain_budget
from tracemill import schemas as S
from tracemill.functions import text
from tracemill.operators import classify, metrics, neardup, profile, records, render, sequence, tagged
from tracemill.sources import jsonl, sinks


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_bounded_keeps_both_ends_and_length(spark):
    rng = random.Random(1)
    values = ["", "abc", "é🙂" * 300] + ["".join(rng.choice("ab é🙂\n") for _ in range(rng.randint(0, 900))) for _ in range(50)]
    for v, got in zip(values, column(spark, values, lambda c: text.bounded(c, 200)), strict=True):
        assert got == plain_budget.shorten(v, 200)
        assert len(got) == min(len(v), 200)


def test_strip_reasoning(spark):
    cases = {"<think>a</think>b": ("b", True), "b": ("b", True), "<think>a": (None, False), "a</think>": (None, False), "<think><think>x</think></think>": (None, False), "<THINK x=1>a</think >b<think>c</think>d": ("bd", True)}
    got = column(spark, list(cases), text.strip_reasoning)
    for (value, (want, ok)), r in zip(cases.items(), got, strict=True):
        assert r["valid"] is ok, value
        assert not ok or r["text"] == want


def test_payloads(spark):
    call = '<tool_call>{"name": "terminal"}</tool_call>'
    cases = {"done": [], call: ['{"name": "terminal"}'], call + "</tool_call>": None, "<tool_call><tool_call>{}</tool_call>": None, "<tool_call>{}</tool_call>": None, '<tool_call>{"name": 1}</tool_call>': None, "<tool_call>[1]</tool_call>": None}
    assert column(spark, list(cases), lambda c: text.payloads(c, "call")) == list(cases.values())


def test_tool_action_precedence(spark):
    cases = {"read_search": "read", "Grep-It": "search", "find_edit": "search", "patch_shell": "edit", "run": "execute", "my-terminal": "execute", "browse": "other_tool", "": "other_tool"}
    assert column(spark, list(cases), text.tool_action) == list(cases.values())


def test_word_tokens_match_python(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("abÉß_1 .,-'日本́ ") for _ in range(60)) for _ in range(200)]
    ours = column(spark, values, text.word_tokens)
    assert sum(a != re.findall(r"(?u)\b\w\w+\b", v.lower()) for a, v in zip(ours, values, strict=True) if "́" not in v) == 0


def test_sections_and_previous_action(spark):
    body = "TASK\nt\n\nSYSTEM CONSTRAINTS\ns\n\nAVAILABLE ACTIONS\na\n\nLATEST RELEVANT OBSERVATION\nTOOL_CALL {\"name\":\"grep\"}\n\nRECENT HISTORY\nTOOL_CALL {\"name\":\"bash\"}"
    got = column(spark, [body, "TASK\nx"], text.sections)
    assert got[0]["TASK"] == "t" and got[0]["RECENT HISTORY"].startswith("TOOL_CALL") and got[1] is None
    assert column(spark, [body, 'x "name":"bash"'], text.previous_action) == ["search", None]


def msg(role, content, **more):
    return {"role": role, "content": content, "reasoning_content": None, "tool_calls": None, "tool_call_id": None, "name": None} | more


def test_rendering_in_both_orders_equals_python(spark):
    calls = [{"id": "c1", "type": "function", "function": {"name": "gr\u00e9p", "arguments": '{"a": "\u00e9\U0001f642\\\\n\n\x1f"}'}}, {"id": None, "type": "function", "function": {"name": None, "arguments": "x"}}]
    ms = [msg("assistant", "hi", tool_calls=calls), msg("tool", "r" * 5000, tool_call_id="c1", name="n"), msg(None, None), msg("user", ""), msg("tool", "x", tool_call_id="", name="")]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(ms)], f"i int, m {S.MESSAGE}")
    got = [(r[0], r[1]) for r in df.orderBy("i").select(render.message(F.col("m"), 1), render.message(F.col("m"), 2)).collect()]
    assert [g for _, g in got] == [plain_budget.shown(m) for m in ms]
    assert got[1][0].startswith("[TOOL]\nname=n\nTOOL_RESULT id=c1\nr") and len(got[1][0]) > len(got[1][1])


def message(role, content="x", calls=None, result=None):
    return {"role": role, "content": content, "reasoning_content": None, "tool_calls": calls, "tool_call_id": result, "name": None}


def call(name, i="1", kind="function", arguments="{}"):
    return {"id": i, "type": kind, "function": {"name": name, "arguments": arguments}}


def row(calls, prefix=None, **change):
    messages = (prefix or [message("user", "do")]) + [message("assistant", calls=calls)]
    base = {"task": "t", "lang": "en", "category": "c", "split": "train", "source_trajectory_sha256": "a" * 64, "assistant_step": 1, "assistant_steps": 1, "target_message_index": len(messages) - 1, "n_messages": len(messages), "messages": messages}
    return base | change


def test_whole_turn_reasons(spark):
    opened = [message("user", "do"), message("assistant", calls=[call("read", "9")])]
    cases = [
        (row([call("read")]), None), (row([call("read"), call("read_file", "2")]), None), (row([call("read"), call("bash", "2")]), "mixed_target_categories"),
        (row([]), classify.NO_CALL), (row(None), "target_tool_calls_not_list"), (row([call("read", arguments=None)]), "malformed_target_tool_call"), (row([call("read", kind="x")]), "malformed_target_tool_call"),
        (row([call("read")], target_message_index=5), "invalid_cumulative_target_boundary"), (row([call("read")], opened), "unresolved_prefix_tool_call"),
        (row([call("read")], [*opened, message("tool", result="9")]), None), (row([call("read")], [message("user", ""), message("user", "later")]), "missing_initial_user_task"),
        (row([call("read")], source_trajectory_sha256=None), "missing_source_identity"), (row([call("read")], assistant_step=0), "invalid_assistant_step"), (row([call("read")], assistant_step=3), "invalid_assistant_steps"),
        (row([], source_trajectory_sha256=None), classify.NO_CALL),
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(cases)], "i int, j string").select("i", F.from_json("j", S.CUMULATIVE_ROW).alias("r")).select("i", "r.*")
    assert [r["reason"] for r in classify.whole_turn(rows).orderBy("i").collect()] == [want for _, want in cases]
    first = classify.first_call(rows, 1).orderBy("i").collect()
    assert (first[2]["label"], first[3]["label"]) == ("read", "respond_or_finish")
    assert first[10]["reason"] is None and classify.first_call(rows, 2).orderBy("i").collect()[10]["reason"] == "missing_initial_user_task"


def test_tagged_candidates_one_or_both(spark):
    c, r = '<tool_call>{"name": "terminal"}</tool_call>', '<tool_response>{"name": "terminal"}</tool_response>'
    turns = lambda *v: [{"from": f, "value": x} for f, x in zip(("gpt", "tool", "gpt"), v, strict=True)]
    data = [("ok", turns(c, r, c)), ("no response", turns(c, "plain", c)), ("bad think", turns(c, r, "<think>x")), ("mismatch", turns(c, r.replace("terminal", "patch"), c))]
    rows = spark.createDataFrame([(i, "", "", "task", "[]", t) for i, t in data], S.TAGGED_ROW)
    both = {r["id"]: r["reason"] for r in tagged.candidates(rows, True).collect()}
    one = {r["id"]: r["reason"] for r in tagged.candidates(rows, False).collect()}
    assert both == {"ok": None, "mismatch": "linkage"} and one == {"ok": None, "no response": "linkage", "mismatch": "linkage"}


def test_metric_closed_form(spark):
    df = spark.createDataFrame([(g, "a") for g in ("a", "b")], "gold string, pred string")
    f1 = metrics.class_scores(metrics.confusion(df, "gold", "pred", list("abcdef"))).agg(F.avg("f1")).first()[0]
    assert abs(f1 - (2 / 3) / 6) < 1e-6
    assert metrics.grouped_folds([("a", 5), ("b", 5), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 0, "d": 1}


def test_transitions_do_not_bridge_gaps(spark):
    df = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y"), ("t", 4, "x")], "k string, step int, s string")
    got = {(r["previous"], r["state"]): r["n"] for r in sequence.transitions(df, "k", "step", "s", ["x", "y"]).collect()}
    assert got == {("x", "x"): 0, ("x", "y"): 1, ("y", "x"): 0, ("y", "y"): 0}


def test_order_statistics_match_sorted_lists(spark):
    rng = random.Random(3)
    values = [(k, rng.randint(0, 20)) for k in "ab" for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame(values, "k string, v int")
    for rule, place in (("round", lambda n, p: round((n - 1) * p)), ("floor", lambda n, p: int((n - 1) * p))):
        for r in profile.distribution(df, "v", ["k"], {"p50": 0.5, "p95": 0.95}, rule).collect():
            s = sorted(v for k, v in values if k == r["k"])
            assert (r["p50"], r["p95"]) == (s[place(len(s), 0.5)], s[place(len(s), 0.95)])


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(4)
    sets = [sorted({f"w{rng.randint(0, 25)}" for _ in range(rng.randint(1, 14))}) for _ in range(60)]
    sets += [s[:-1] + ["w99"] if len(s) > 8 else s for s in sets]
    rows = [(i, f"s{i % 7}", s) for i, s in enumerate(sets)]
    got = {(r["left_id"], r["right_id"]) for r in neardup.cross_split_pairs(spark.createDataFrame(rows, "id int, split string, tokens array<string>"), "id", "split", "tokens", 85).collect()}
    want = {(a, b) for a, sa, x in rows for b, sb, y in rows if a < b and sa != sb and 100 * len({*x} & {*y}) >= 85 * len({*x} | {*y})}
    assert got == want and want


def test_record_reasons():
    q = {"q": {"type": "choice", "instructions": "i", "criteria": {"a": 1, "b": 2}}}
    gold = lambda **p: {"q": {"type": "choice", "label": None, "probabilities": p}}
    bad = {
        "invalid_json": "{", "questions": {"state": "s", "questions": {}}, "q:probability_keys": {"state": "s", "questions": q, "gold": gold(b=0.5, a=0.5)}, "q:probability_sum": {"state": "s", "questions": q, "gold": gold(a=0.5, b=0.4)},
        "q:probability_values": {"state": "s", "questions": q, "gold": gold(a=True, b=0)}, "gold_keys": {"state": "s", "questions": q, "gold": {"z": {}}}, "q:criteria": {"state": "s", "questions": {"q": {"type": "choice", "instructions": "i", "criteria": {"a": 1}}}},
    }
    for want, record in bad.items():
        assert want in records.reasons(record if isinstance(record, str) else json.dumps(record))
    assert records.reasons(json.dumps({"state": "s", "questions": q, "gold": gold(a=0.5, b=0.5)})) == []


def test_numbered_lines_and_gated_sink(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n{bad\n' + "\n".join(f'{{"a": {i}}}' for i in range(3, 500)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = jsonl.numbered_lines(spark, str(path))
        got = {r["line"]: r["value"] for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(path.read_text().split("\n")[:-1], 1))
    parsed = jsonl.parsed(jsonl.numbered_lines(spark, str(path)), "a int")
    assert [(r["line"], r["reason"]) for r in parsed.where("reason is not null").collect()] == [(4, "invalid_json")]
    rows = parsed.where("reason is null").select("line", "row.a")
    gates = spark.createDataFrame([("g", True), ("h", False)], "name string, passed boolean")
    assert not sinks.write_if(gates, rows, ["line"], str(tmp_path / "no")) and not (tmp_path / "no").exists()
    assert sinks.write_if(gates.where("passed"), rows, ["line"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == rows.count()


def test_walk_collapses_list_places(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1}, {"b": 2}], "c": "x"}')], "id int, j string")
    assert sorted((r["path"], r["value"]) for r in jsonl.walk(df, "j", 4).collect()) == [("a[].b", "1"), ("a[].b", "2"), ("c", "x")]
