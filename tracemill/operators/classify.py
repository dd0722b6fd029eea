"""Classification of each trace row's target under three policies, with one reason per excluded row.

``first_call`` (policies 1 and 2) labels a turn by its first call and a turn without calls 'respond_or_finish'.
``whole_turn`` (policy 3) wants one category over all calls and excludes what it can't decide. The policies are
kept apart because their results differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import hashing, text

NO_CALL = "no_call_without_positive_completion"


def _names(calls: Column) -> Column:
    return F.transform(calls, lambda c: F.coalesce(c["function"]["name"], F.lit("")))


def unresolved(prefix: Column) -> Column:
    """Whether a call id of any role in the prefix has no result from a tool."""
    ids = F.filter(F.flatten(F.transform(prefix, lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["id"]), F.array().cast("array<string>")))), lambda i: i.isNotNull() & (i != ""))
    results = F.transform(F.filter(prefix, lambda m: (m["role"] == "tool") & m["tool_call_id"].isNotNull()), lambda m: m["tool_call_id"])
    return F.size(F.array_except(ids, results)) > 0


def _first(prefix: Column, role: str, full: bool) -> Column:
    """Content of the first message of a role; with ``full`` of the first that isn't empty."""
    found = F.filter(prefix, lambda m: (m["role"] == role) & (F.lit(not full) | (F.coalesce(m["content"], F.lit("")) != "")))
    return F.coalesce(F.get(found, F.lit(0))["content"], F.lit(""))


def with_parts(rows: DataFrame) -> DataFrame:
    """Adds prefix, target and calls to rows of cumulative traces."""
    n = F.size("messages")
    return rows.withColumns({"prefix": F.when(n > 0, F.slice("messages", F.lit(1), n - 1)), "target": F.try_element_at("messages", F.lit(-1))}).withColumn("calls", F.col("target.tool_calls"))


def first_call(rows: DataFrame, policy: int) -> DataFrame:
    """reason (null if kept), label, task, task_group and split under policy 1 or 2."""
    if policy not in (1, 2):
        raise ValueError("policy 1 or 2")
    d = with_parts(rows)
    bad = F.coalesce(F.size("messages") < 1, F.lit(True)) | (F.col("target_message_index") != F.size("messages") - 1) | (F.col("target.role") != "assistant")
    if policy == 1:
        bad = bad | (F.col("n_messages") != F.size("messages")) | (F.coalesce("source_trajectory_sha256", F.lit("")) == "") | (F.col("assistant_step") < 1)
    bad = F.coalesce(bad, F.lit(True))
    task = _first(F.col("prefix"), "user", policy == 1)
    reason = F.when(bad, "malformed_row").when(task == "", "missing_initial_user_task").when(unresolved(F.col("prefix")), "unresolved_prefix_tool_call")
    label = F.when(F.coalesce(F.size("calls"), F.lit(0)) <= 0, "respond_or_finish").otherwise(text.tool_action(F.get(_names(F.col("calls")), F.lit(0))))
    return _grouped(d.withColumns({"reason": reason, "label": label, "task_text": task}))


def whole_turn(rows: DataFrame) -> DataFrame:
    """reason (null if kept), label, categories, task, task_group and split under policy 3; the first failure counts.

    Identity failures override what the target says, unless the target has no call; task and linkage are only
    looked at in rows that are still kept.
    """
    d = with_parts(rows)
    bounds = F.coalesce((F.size("messages") > 0) & (F.col("target_message_index") == F.size("messages") - 1) & (F.col("target.role") == "assistant"), F.lit(False))
    malformed = F.exists(
        "calls",
        lambda c: ~F.coalesce((c["type"] == "function") & (c["id"] != "") & (F.trim(c["function"]["name"]) != "") & c["function"]["arguments"].isNotNull(), F.lit(False)),
    )
    kinds = F.array_sort(F.array_distinct(F.transform(_names(F.col("calls")), text.tool_action)))
    target = (
        F.when(~bounds, "invalid_cumulative_target_boundary")
        .when(F.exists("messages", lambda m: m.isNull()), "malformed_message_structure")
        .when(F.col("calls").isNull(), "target_tool_calls_not_list")
        .when(F.size("calls") == 0, NO_CALL)
        .when(malformed, "malformed_target_tool_call")
        .when(F.size(kinds) != 1, "mixed_target_categories")
    )
    d = d.withColumns({"t": target, "categories": F.when(bounds & F.col("calls").isNotNull() & ~F.coalesce(malformed, F.lit(False)), F.when(F.size("calls") == 0, F.array(F.lit("respond_or_finish"))).otherwise(kinds))})
    identity = (
        F.when(F.coalesce(F.col("t") == NO_CALL, F.lit(False)), F.lit(NO_CALL))
        .when(F.coalesce("source_trajectory_sha256", F.lit("")) == "", "missing_source_identity")
        .when(F.coalesce(F.col("assistant_step") < 1, F.lit(True)), "invalid_assistant_step")
        .when(F.coalesce(F.col("assistant_steps") < F.col("assistant_step"), F.lit(True)), "invalid_assistant_steps")
        .otherwise(F.col("t"))
    )
    task = _first(F.col("prefix"), "user", False)
    reason = F.coalesce(identity, F.when(task == "", "missing_initial_user_task").when(unresolved(F.col("prefix")), "unresolved_prefix_tool_call"))
    d = d.withColumns({"reason": reason, "task_text": task, "label": F.when(reason.isNull(), F.get("categories", F.lit(0)))})
    return _grouped(d).drop("t")


def _grouped(d: DataFrame) -> DataFrame:
    group = F.when(F.col("task_text") != "", F.sha2(text.normalize_task(F.col("task_text")), 256))
    return d.withColumn("task_group", F.coalesce(group, F.lit("unknown"))).withColumn("row_split", F.when(F.col("task_text") != "", hashing.split_3way(F.col("task_group"))).otherwise("unknown")).drop("prefix", "target", "calls")


def changed_assignments(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows whose split differs from the one assigned before; must be empty."""
    return new.alias("n").join(old.alias("o"), ["source_trajectory_sha256", "assistant_step"]).where(~F.col("n.row_split").eqNullSafe(F.col("o.row_split"))).select("source_trajectory_sha256", "assistant_step")


def trajectory_audit(d: DataFrame) -> DataFrame:
    """Per trajectory: kept, excluded, counts by label and by reason, and the split of its first step."""
    each = d.groupBy("source_trajectory_sha256", "label", "reason").agg(F.count("*").alias("n"), F.min(F.struct("assistant_step", "row_split")).alias("first"))
    pairs = lambda c: F.map_from_entries(F.sort_array(F.filter(F.collect_list(F.struct(c, "n")), lambda e: e[c].isNotNull())))
    return each.groupBy("source_trajectory_sha256").agg(
        F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("retained"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)).alias("excluded"),
        pairs("label").alias("by_label"), pairs("reason").alias("by_reason"), F.min("first")["row_split"].alias("split"),
    )
