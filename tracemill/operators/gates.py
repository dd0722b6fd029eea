"""Checks and gates as (name, passed, n) rows: each one counts what breaks a rule, and none may be left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import schemas as S


def checks(found: dict[str, DataFrame]) -> DataFrame:
    """(name, passed, n) from the rows that break each rule."""
    rows = [bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("passed"), "n") for name, bad in found.items()]
    return reduce(DataFrame.union, rows)


def verdict(gates: DataFrame) -> DataFrame:
    """``gates`` with a last row ``all``."""
    every = gates.agg(F.lit("all").alias("name"), F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n"))
    return gates.select("name", "passed", "n").union(every)


def crossing(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("k")).where("k > 1")


def verified_records(records: DataFrame, sources: DataFrame, assigned: DataFrame) -> dict[str, DataFrame]:
    """What breaks the rules of a verified set.

    records: id, trajectory, task_group, step, line, split, state, label. sources: line, label, state (rendered again), prefix,
    strings (texts of the target). assigned: trajectory, step, split. A text of the target may stand in the state only if the prefix has it,
    too; short ones (under 24 code points) don't tell.
    """
    s = sources.select("line", F.col("label").alias("s_label"), F.col("state").alias("s_state"), "prefix", "strings", F.lit(True).alias("known"))
    r = records.join(s, "line", "left")
    found = r.where("known")
    own = F.exists("strings", lambda t: (F.char_length(t) >= 24) & ~F.contains("prefix", t) & F.contains("state", t))
    named = F.exists(F.array("id", "trajectory", "task_group"), lambda m: (m != "") & F.contains("state", m))
    old = assigned.select("trajectory", "step", F.col("split").alias("old"))
    return {
        "ids_repeat": records.groupBy("id").count().where("count > 1"),
        "metadata_missing": records.where("id is null or trajectory is null or task_group is null or step is null"),
        "trajectories_cross": crossing(records, "trajectory", "split"),
        "trajectories_of_several_groups": crossing(records, "trajectory", "task_group"),
        "groups_cross": crossing(records, "task_group", "split"),
        "states_cross": crossing(records, "state", "split"),
        "source_missing": r.where("known is null"),
        "label_differs": found.where("not label <=> s_label"),
        "state_differs": found.where("not state <=> s_state"),
        "split_differs": records.join(old, ["trajectory", "step"], "left").where("not split <=> old"),
        "metadata_in_state": records.where(named),
        "target_in_state": found.where(own),
    }


def retained_gates(retained: DataFrame, splits: list[str], tools: list[str], given: dict[str, bool], support: int = 10, split_gap: float = 0.10, label_gap: float = 0.20) -> DataFrame:
    """The gates of a retained set: trajectory, proxy_group, split, labels (array), state, fits, over, linked, key; then ``all``.

    ``over`` tells whether the unbounded form was over budget. ``given`` holds gates that were decided elsewhere (a digest, canaries).
    """
    spark = retained.sparkSession
    labels = retained.select("trajectory", "split", "over", F.array_distinct("labels").alias("labels"))
    has = labels.select("trajectory", "split", "over", F.explode_outer("labels").alias("tool")).where("tool is not null")
    cells = spark.createDataFrame([(s, t) for s in splits for t in tools], "split string, tool string")
    members = has.groupBy("split", "tool").agg(F.count_distinct("trajectory").alias("positive"), F.count("*").alias("m"), F.sum(F.col("over").cast("int")).alias("m_over"))
    totals = labels.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("over").cast("int")).alias("n_over"))
    rate = lambda over, n: F.coalesce(F.try_divide(over, n), F.lit(0.0))
    by = cells.join(members, ["split", "tool"], "left").join(totals, "split", "left").fillna(0)
    by = by.withColumn("gap", F.abs(rate(F.col("m_over"), F.col("m")) - rate(F.col("n_over") - F.col("m_over"), F.col("n") - F.col("m"))))
    rates = spark.createDataFrame([(s,) for s in splits], "split string").join(totals, "split", "left").fillna(0).agg((F.max(rate(F.col("n_over"), F.col("n"))) - F.min(rate(F.col("n_over"), F.col("n")))).alias("g"))
    out = checks(
        {
            "zero_residual_reasoning_markers": retained.where(F.col("state").rlike(S.REASONING_MARKER)),
            "complete_linkage": retained.where(~F.col("linked")),
            "valid_retained_labels": retained.where(F.size(F.array_except("labels", F.array(*[F.lit(t) for t in tools]))) > 0),
            "no_truncation": retained.where(~F.col("fits")),
            "exact_representation_unique": retained.groupBy("key").count().where("count > 1"),
            "trajectory_split_isolation": crossing(retained, "trajectory", "split"),
            "proxy_group_split_isolation": crossing(retained, "proxy_group", "split"),
            "minimum_positive_trajectory_support": by.where(F.col("positive") < support),
            "split_over_budget_difference": rates.where(F.col("g") > split_gap),
            "label_over_budget_difference": by.where(F.col("gap") > label_gap),
        }
    )
    if given:
        out = spark.createDataFrame([(k, v, int(not v)) for k, v in given.items()], "name string, passed boolean, n long").union(out)
    return verdict(out)


def table_digest(df: DataFrame) -> DataFrame:
    """(n, digest) of a table whatever the order of its rows: 128 bits summed over rows."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(row, 256), at, 15), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1).cast("string"), part(17).cast("string")), 256).alias("digest"))


def changed_by(df: DataFrame, key: str, target: str, mutated: Column, seen: Column) -> DataFrame:
    """Keys for which ``seen`` is another when ``target`` is ``mutated``: a canary that nothing may notice."""
    before = df.withColumn("__before", seen)
    return before.withColumn(target, mutated).withColumn("__after", seen).where("not __before <=> __after").select(key)
