"""State texts under a token budget for every target of every conversation, each message tokenized once.

A subword tokenizer's counts don't add up over any pieces, but they do where the next piece begins at a token's begin: a
piece then costs what it adds in front of that begin (``followed``), blank line included, or its own count if it is last.
Messages begin with ``[`` at a line's start and sections with a heading, which tokenizers that split before a mark, or
before a letter after a line break, never join to what stands before. So filling history newest first
until the first overflow needs no text: with running sums of costs over a conversation, the newest message that does not
fit any more is the last one whose key lies below the target's, found by one sort of keys and a running maximum.

Protected sections (system, observation, task) are cut in fixed steps, in this order, until they fit alone; their costs at
each step are found once per text. Only what is kept is joined to the targets as text: as much as the budget lets in.

Rows are messages (conversation, place, message), not prefixes: a conversation of n messages is n rows in all of this, sorted by
place within the conversation; the rows of these sorts are a few numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import text, tokens
from tracemill.functions.tokens import Count
from tracemill.operators import render
from tracemill.operators.shared import cut, stored

#: Protected sections in the order in which they are cut: first limit and floor; a step's size.
FIELDS, STEP = {"system": (3000, 100), "observation": (7000, 300), "task": (6000, 300)}, 400
#: What the smallest budget leaves beside the empty envelope.
ROOM = S.BUDGETS[0] - S.ENVELOPE_TOKENS
NO_OBSERVATION, NO_HISTORY = "[NO OBSERVATION]", "[NO ADDITIONAL HISTORY]"
_HEAD = dict(zip(("task", "system", "actions", "observation", "history"), S.SECTIONS, strict=True))
_NEXT = {"task": _HEAD["system"], "system": _HEAD["actions"], "observation": _HEAD["history"]}


def ladder(field: str) -> list[int]:
    """The limits of a protected section, from the first to its floor."""
    first, floor = FIELDS[field]
    return [max(floor, first - k * STEP) for k in range(-(-(first - floor) // STEP) + 1)]


def _costs(count: Count, after: str):
    """A UDF giving (own, followed): a text's tokens if it is last, and what it adds before a blank line and ``after``."""

    @F.pandas_udf("struct<own: bigint, followed: bigint>")
    def costs(texts: pd.Series) -> pd.DataFrame:
        values = texts.fillna("").tolist()
        known = count([after])[0]
        return pd.DataFrame({"own": count(values), "followed": [n - known for n in count([f"{t}\n\n{after}" for t in values])]})

    return costs


def _ladder_costs(count: Count, after: str):
    """A UDF of an array of texts: what each adds before ``after``, a null as much as the first."""

    @F.pandas_udf("array<bigint>")
    def costs(arrays: pd.Series) -> pd.Series:
        flat = [f"{t}\n\n{after}" for a in arrays for t in a if t is not None]
        known = count([after])[0]
        found = iter(count(flat))
        out = []
        for a in arrays:
            own = [next(found) - known if t is not None else None for t in a]
            out.append([own[0] if n is None else n for n in own])
        return pd.Series(out)

    return costs


def _section(field: str, body: Column) -> Column:
    return F.concat(F.lit(f"{_HEAD[field]}\n"), body)


def _at_limits(count: Count, field: str, body: Column) -> Column:
    """Costs of a protected section at each of its limits, where a limit that does not cut costs as the first."""
    first, *rest = ladder(field)
    parts = [_section(field, text.bounded(body, first)), *[F.when(F.char_length(body) > limit, _section(field, text.bounded(body, limit))) for limit in rest]]
    return _ladder_costs(count, _NEXT[field])(F.array(*parts))


def _limits(step: Column) -> dict[str, Column]:
    """The place in its ladder of each protected section after ``step`` cuts."""
    out, before = {}, 0
    for field in FIELDS:
        most = len(ladder(field)) - 1
        out[field] = F.greatest(F.lit(0), F.least(F.lit(most), step - before)).cast("int")
        before += most
    return out


def targets(messages: DataFrame, room: int = ROOM, count: Count = tokens.words, conv: str = "conv", at: str = "i", message: str = "m") -> DataFrame:
    """One row for each assistant message: conv, i, step (cuts of protected sections; null if they can't fit), cut, observation, task, system and totals.

    History is what stands after place ``cut``, without the observation, the task and system messages. pre_policy_tokens counts the state with
    all history under the first limits, envelope included. Places must be distinct within a conversation and not negative.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(at).cast("long").alias("i"), F.col(f"{message}.role").alias("role"), F.coalesce(F.col(f"{message}.content"), F.lit("")).alias("content"), render.message(F.col(message), 2).alias("shown"))
    whole = Window.partitionBy("conv")
    upto = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("i"))).over(whole)
    cost = stored(rows.withColumn("c", _costs(count, "[")("shown")).select("conv", "i", "role", "c.own", "c.followed"))
    cost = cost.withColumns({"first_user": first("user"), "first_system": first("system")})
    plain = F.coalesce(F.col("role") != "system", F.lit(True)) & ~F.col("i").eqNullSafe(F.col("first_user"))
    cost = cost.withColumn("plain", plain).withColumn("f", F.when(plain, F.col("followed")).otherwise(F.lit(0)))
    last = lambda when: F.max(F.when(when, F.col("i"))).over(upto)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    cost = cost.withColumns(
        {
            "sum": before(F.col("f")), "observation": F.coalesce(last(F.col("role") == "tool"), last(F.col("plain"))),
            "newest": last(F.col("plain")), "n": before(F.col("plain").cast("int")),
            "task": F.when(F.col("first_user") < F.col("i"), F.col("first_user")), "system": F.when(F.col("first_system") < F.col("i"), F.col("first_system")),
        }
    )
    cost = stored(cost)
    t = cost.where("role = 'assistant'").select("conv", "i", "sum", "observation", "newest", "n", "task", "system")
    # Costs of the protected sections: of a conversation's task and system text once, of each observation once.
    blank = lambda field, body: _at_limits(count, field, F.lit(body))
    firsts = cost.where("i <=> first_user or i <=> first_system").select("conv", "i").join(rows.select("conv", "i", "content"), ["conv", "i"])
    own = {f: firsts.select(F.col("conv").alias(f"{f}_conv"), F.col("i").alias(f), _at_limits(count, f, F.col("content")).alias(f"{f}_costs")) for f in ("task", "system")}
    seen = t.select("conv", F.col("observation").alias("i")).where("i is not null").distinct().join(rows.select("conv", "i", "shown"), ["conv", "i"])
    own["observation"] = seen.select(F.col("conv").alias("observation_conv"), F.col("i").alias("observation"), _at_limits(count, "observation", F.col("shown")).alias("observation_costs"))
    for f, part in own.items():
        t = t.join(part, (F.col("conv") == F.col(f"{f}_conv")) & (t[f] == part[f]), "left").drop(f"{f}_conv", part[f])
        t = t.withColumn(f"{f}_costs", F.coalesce(f"{f}_costs", blank(f, NO_OBSERVATION if f == "observation" else "")))
    fixed = count([f"{_HEAD['actions']}\n{', '.join(S.ONTOLOGY)}\n\n{_HEAD['observation']}"])[0] - count([_HEAD["observation"]])[0]
    empty = count([f"{_HEAD['history']}\n{NO_HISTORY}"])[0]
    head = count([f"{_HEAD['history']}\n["])[0] - count(["["])[0]
    protected = lambda k: sum((F.get(F.col(f"{f}_costs"), p) for f, p in _limits(k).items()), F.lit(fixed))
    steps = F.sequence(F.lit(0), F.lit(sum(len(ladder(f)) - 1 for f in FIELDS)))
    t = t.withColumn("step", F.get(F.filter(steps, lambda k: protected(k) + empty <= room), F.lit(0)))
    observed = cost.select(F.col("conv").alias("o_conv"), F.col("i").alias("o"), F.col("f").alias("o_f"))
    t = t.join(observed, (F.col("conv") == F.col("o_conv")) & (F.col("observation") == F.col("o")), "left").drop("o_conv", "o")
    # Everything from the oldest candidate on: all followed but the newest.
    newest = cost.where("plain").select(F.col("conv").alias("n_conv"), F.col("i").alias("n_i"), (F.col("followed") - F.col("own")).alias("over"), F.max("i").over(upto).alias("n_before"))
    aside = F.when(F.col("newest") == F.col("observation"), 1).otherwise(0)
    # The newest candidate is the newest plain message, or the one before it where that is the observation.
    t = t.join(newest.select("n_conv", "n_i", "n_before"), (F.col("conv") == F.col("n_conv")) & (F.col("newest") == F.col("n_i")), "left").drop("n_conv", "n_i")
    t = t.withColumn("newest", F.when(aside == 1, F.col("n_before")).otherwise(F.col("newest"))).drop("n_before")
    t = t.join(newest.select("n_conv", "n_i", "over"), (F.col("conv") == F.col("n_conv")) & (F.col("newest") == F.col("n_i")), "left").drop("n_conv", "n_i")
    history = F.when(F.col("newest").isNull(), F.lit(empty)).otherwise(head + F.col("sum") - F.coalesce("o_f", F.lit(0)) - F.col("over"))
    t = t.withColumn("pre_policy_tokens", S.ENVELOPE_TOKENS + protected(F.lit(0)) + history).withColumn("n", F.col("n") - F.when(F.col("o_f").isNotNull(), 1).otherwise(0))
    # The newest message that does not fit: the largest place of those whose key lies below the target's.
    t = cut(t)
    below = F.col("sum") + protected(F.col("step")) + head - room
    t = t.withColumn("__tail", below).withColumn("__rest", below - F.coalesce("o_f", F.lit(0)))
    keys = cost.where("plain").select("conv", (F.col("sum") + F.col("f") - F.col("own")).alias("key"), F.lit(1).alias("kind"), F.col("i").alias("j"), F.lit(None).cast("long").alias("target"))
    asked = t.where("step is not null").select("conv", F.explode(F.array(F.struct(F.col("__tail").alias("key"), F.lit(-1).alias("kind")), F.struct(F.col("__rest").alias("key"), F.lit(0).alias("kind")))).alias("q"), F.col("i").alias("target"))
    both = keys.unionByName(asked.select("conv", "q.key", "q.kind", F.lit(None).cast("long").alias("j"), "target"))
    running = Window.partitionBy("conv").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("over", F.max("j").over(running)).where("kind < 1").groupBy("conv", "target").agg(F.max(F.when(F.col("kind") == -1, F.col("over"))).alias("j1"), F.max(F.when(F.col("kind") == 0, F.col("over"))).alias("j2"))
    t = t.join(found.withColumnsRenamed({"conv": "f_conv", "target": "f_i"}), (F.col("conv") == F.col("f_conv")) & (F.col("i") == F.col("f_i")), "left")
    last_out = F.when(F.col("observation").isNull() | (F.col("j1") > F.col("observation")), F.col("j1")).when(F.col("j2").isNotNull(), F.least(F.col("j2"), F.col("observation") - 1))
    return cut(t.withColumn("cut", F.coalesce(last_out, F.lit(-1))).select("conv", "i", "step", "cut", "observation", "task", "system", F.col("n").cast("long").alias("candidates"), F.col("pre_policy_tokens").cast("long").alias("pre_policy_tokens")))


def kept(found: DataFrame, messages: DataFrame, conv: str = "conv", at: str = "i", message: str = "m") -> DataFrame:
    """(conv, i, place, shown) of the history that each target keeps: rows in proportion to what the budget lets in."""
    m = messages.select(F.col(conv).alias("m_conv"), F.col(at).cast("long").alias("place"), F.col(f"{message}.role").alias("role"), render.message(F.col(message), 2).alias("shown"))
    span = found.where("step is not null and cut < i - 1").select("conv", "i", "task", "observation", F.explode(F.sequence(F.col("cut") + 1, F.col("i") - 1)).alias("k"))
    own = span.where(~F.col("k").eqNullSafe(F.col("task")) & ~F.col("k").eqNullSafe(F.col("observation")))
    return own.join(m, (F.col("conv") == F.col("m_conv")) & (F.col("k") == F.col("place"))).where("not role <=> 'system'").select("conv", "i", "place", "shown")


def omitted(found: DataFrame, messages: DataFrame, conv: str = "conv", at: str = "i", message: str = "m") -> DataFrame:
    """(conv, i, place, role, reason) of the history that each target leaves out; a target's are all candidates up to its cut, so this can be long."""
    m = messages.select(F.col(conv).alias("m_conv"), F.col(at).cast("long").alias("place"), F.col(f"{message}.role").alias("role"))
    span = found.where("step is not null and cut >= 0").select("conv", "i", "task", "observation", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut"))).alias("k"))
    own = span.where(~F.col("k").eqNullSafe(F.col("task")) & ~F.col("k").eqNullSafe(F.col("observation")))
    return own.join(m, (F.col("conv") == F.col("m_conv")) & (F.col("k") == F.col("place"))).where("not role <=> 'system'").select("conv", "i", "place", "role", F.lit("optional_history_budget").alias("reason"))


def states(messages: DataFrame, room: int = ROOM, count: Count = tokens.words, conv: str = "conv", at: str = "i", message: str = "m") -> DataFrame:
    """Each target's row with ``kept`` (places, ascending), ``omitted`` (their number), ``limits`` and the ``state`` text; null where protected sections can't fit."""
    found = targets(messages, room, count, conv, at, message)
    history = kept(found, messages, conv, at, message).groupBy("conv", "i").agg(F.sort_array(F.collect_list(F.struct("place", "shown"))).alias("h")).withColumnsRenamed({"conv": "h_conv", "i": "h_i"})
    texts = messages.select(F.col(conv).alias("x_conv"), F.col(at).cast("long").alias("x_i"), F.coalesce(F.col(f"{message}.content"), F.lit("")).alias("content"), render.message(F.col(message), 2).alias("shown"))
    out = found.join(history, (F.col("conv") == F.col("h_conv")) & (F.col("i") == F.col("h_i")), "left").drop("h_conv", "h_i")
    for f, c in (("task", "content"), ("system", "content"), ("observation", "shown")):
        part = texts.select(F.col("x_conv").alias(f"{f}_conv"), F.col("x_i").alias(f"{f}_i"), F.col(c).alias(f"{f}_text"))
        out = out.join(part, (F.col("conv") == F.col(f"{f}_conv")) & (F.col(f) == F.col(f"{f}_i")), "left").drop(f"{f}_conv", f"{f}_i")
    limit = {f: F.get(F.array(*[F.lit(x) for x in ladder(f)]), p) for f, p in _limits(F.coalesce("step", F.lit(0))).items()}
    out = out.withColumns({f"{f}_limit": c for f, c in limit.items()})
    body = {f: text.bounded(F.coalesce(f"{f}_text", F.lit(NO_OBSERVATION if f == "observation" else "")), F.col(f"{f}_limit")) for f in FIELDS}
    pieces = [body["task"], body["system"], F.lit(", ".join(S.ONTOLOGY)), body["observation"], F.coalesce(F.array_join(F.col("h.shown"), "\n\n"), F.lit(NO_HISTORY))]
    state = F.concat_ws("\n\n", *[F.concat(F.lit(f"{h}\n"), p) for h, p in zip(S.SECTIONS, pieces, strict=True)])
    places = F.coalesce(F.col("h.place"), F.array().cast("array<bigint>"))
    fits = F.col("step").isNotNull()
    return out.select(
        "conv", "i", "observation", F.when(fits, places).alias("kept"), F.when(fits, F.col("candidates") - F.size(places)).alias("omitted"), "candidates", "pre_policy_tokens",
        F.when(fits, F.struct(*[F.col(f"{f}_limit").alias(f) for f in FIELDS])).alias("limits"), F.when(fits, state).alias("state"),
    )
