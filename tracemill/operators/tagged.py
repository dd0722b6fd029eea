"""Candidates from tagged conversations: an assistant turn after a call and its response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import hashing, text


def candidates(rows: DataFrame, need_both: bool, splits: list[str] | None = None) -> DataFrame:
    """One row per candidate target: id, index, state, labels, reason, split.

    Rows outside ``splits`` are dropped on the raw task text, below any parsing of values. ``need_both`` asks for
    both wrappers, else one is enough and a missing one is an exclusion.
    """
    d = rows.withColumn("split", hashing.split_4way(text.template_task(F.col("task"))))
    if splits is not None:
        d = d.where(F.col("split").isin(splits))
    d = d.withColumn("clean", F.transform("conversations", lambda m: F.struct(m["from"].alias("role"), text.strip_reasoning(F.coalesce(m["value"], F.lit(""))).alias("r"))))
    d = d.where(F.forall("clean", lambda m: m["r"]["valid"]))  # one malformed message drops the conversation
    each = d.select("id", "task", "split", "clean", F.posexplode("clean").alias("i", "m")).where("i >= 2 and m.role = 'gpt'")
    each = each.withColumns({"call": F.get("clean", F.col("i") - 2), "result": F.get("clean", F.col("i") - 1)}).where("call.role = 'gpt' and result.role = 'tool'")
    each = each.withColumns({"calls": text.payloads(F.col("call.r.text"), "call"), "results": text.payloads(F.col("result.r.text"), "response"), "targets": text.payloads(F.col("m.r.text"), "call")})
    c, r = F.coalesce(F.size("calls"), F.lit(1)) > 0, F.coalesce(F.size("results"), F.lit(1)) > 0
    each = each.where(c & r if need_both else c | r)
    names = lambda col: F.transform(col, lambda p: F.try_variant_get(F.try_parse_json(p), "$.name", "string"))
    known = lambda col: F.forall(names(col), lambda n: n.isin(S.TOOLSET))
    linked = F.coalesce((F.size("calls") > 0) & (names(F.col("calls")) == names(F.col("results"))) & known(F.col("calls")), F.lit(False))
    valid = F.coalesce(known(F.col("targets")), F.lit(False))
    state = F.concat(F.lit("Task:\n"), F.col("task"), F.lit("\nAvailable tools: " + ", ".join(S.TOOLSET) + "\nPrevious assistant call:\n"), F.col("call.r.text"), F.lit("\nLatest tool response:\n"), F.col("result.r.text"))
    return each.select("id", "i", "split", state.alias("state"), F.when(valid, F.array_sort(F.array_distinct(names(F.col("targets"))))).alias("labels"), F.when(~linked, "linkage").when(~valid, "target").alias("reason"))


def exact_toolset(rows: DataFrame) -> DataFrame:
    """Rows whose tool definitions name exactly the six tools."""
    names = F.from_json("tools", "array<struct<name:string,function:struct<name:string>>>")
    found = F.array_sort(F.transform(names, lambda d: F.coalesce(d["function"]["name"], d["name"])))
    return rows.where(F.coalesce(found == F.array(*[F.lit(t) for t in S.TOOLSET]), F.lit(False)))
