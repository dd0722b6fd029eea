"""The exact token budget against plain refilling: words, and a subword tokenizer where its files are there."""

import random

import pytest

import plain_budget
from tracemill import schemas as S
from tracemill.functions import tokens
from tracemill.operators import token_budget


def msg(role, content, **more):
    return {"role": role, "content": content, "reasoning_content": None, "tool_calls": None, "tool_call_id": None, "name": None} | more


def conversations(n, seed, longest=22):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "stone", "Straße", "naïve", "x1", "don't", "日本", "🙂", "<|x|>", "...", "\t", "\n\n", "  "])
    out = []
    for c in range(n):
        roles = [rng.choice(["system", "user", "assistant", "assistant", "tool", "tool", None]) for _ in range(rng.randint(1, longest))]
        ms = []
        for r in roles:
            size = rng.choice([0, 1, 5, 30, 30, 60, 1300 if rng.random() < 0.2 else 9])
            text = rng.choice([None, "", " ".join(word() for _ in range(size)), "\n lead " + word(), "trail \n\n"])
            calls = [{"id": "c", "type": "function", "function": {"name": word(), "arguments": '{"a":"é\\n"}'}}] if r == "assistant" and rng.random() < 0.4 else None
            ms.append(msg(r, text, name=rng.choice([None, "n"]), tool_call_id="c" if r == "tool" else None, tool_calls=calls))
        out.append((c, ms))
    return out


def rows(spark, found):
    flat = [(c, i, tuple(m[k] for k in ("role", "content", "reasoning_content")) + ([(x["id"], x["type"], tuple(x["function"].values())) for x in m["tool_calls"]] if m["tool_calls"] else None, m["tool_call_id"], m["name"])) for c, ms in found for i, m in enumerate(ms)]
    return spark.createDataFrame(flat, f"conv long, i long, m {S.MESSAGE}")


def compare(spark, found, room, count, one):
    messages = rows(spark, found).cache()
    got = {(r["conv"], r["i"]): r for r in token_budget.states(messages, room, count).collect()}
    t = token_budget.targets(messages, room, count)
    left = {}
    for r in token_budget.omitted(t, messages).collect():
        left.setdefault((r["conv"], r["i"]), []).append(r["place"])
        assert r["role"] == dict(found)[r["conv"]][r["place"]]["role"] and r["reason"] == "optional_history_budget"
    n = 0
    for c, ms in found:
        for i, m in enumerate(ms):
            if m["role"] != "assistant":
                continue
            n += 1
            state, kept, omitted, seen, before, limits = plain_budget.fill(ms[:i], room, one)
            r = got[(c, i)]
            assert (r["observation"], r["pre_policy_tokens"]) == (seen, before)
            assert r["state"] == state and r["kept"] == kept
            assert (None if limits is None else tuple(r["limits"][f] for f in ("system", "observation", "task"))) == limits
            assert r["omitted"] == (None if omitted is None else len(omitted)) and sorted(left.get((c, i), [])) == (omitted or [])
    assert n == len(got)
    messages.unpersist()
    return n


def test_words_against_plain_refilling(spark):
    found = conversations(60, 1)
    assert sum(compare(spark, found, room, tokens.words, plain_budget.words) for room in (100, 415)) > 200


def test_subwords_against_plain_refilling(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    count = tokens.subwords(path)
    assert compare(spark, conversations(60, 2), 415, count, lambda t: count([t])[0]) > 150


def test_empty_and_short(spark):
    none = rows(spark, [(0, [msg("user", "only")])])
    assert token_budget.states(none).count() == 0 and token_budget.states(none.limit(0)).count() == 0
    alone = token_budget.states(rows(spark, [(0, [msg("assistant", "x")])])).collect()
    assert len(alone) == 1 and alone[0]["kept"] == [] and "[NO OBSERVATION]" in alone[0]["state"] and alone[0]["observation"] is None
    assert token_budget.ROOM == 415
    assert token_budget.states(rows(spark, [(0, [msg("user", "t " * 5000), msg("assistant", "x")])]), 20).first()["state"] is None


def test_ladders():
    assert token_budget.ladder("system") == [3000, 2600, 2200, 1800, 1400, 1000, 600, 200, 100]
    assert token_budget.ladder("task")[-2:] == [400, 300] and len(token_budget.ladder("observation")) == 18
