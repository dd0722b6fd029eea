"""Prefixes, neighbours and linkage inside ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(*keys: str, order: list) -> Window:
    """The rows of the group that stand before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def contiguous_previous(df: DataFrame, key: str, step: str, value: str, start: str = "START") -> Column:
    """The previous value if it is one step back, else ``start``."""
    w = Window.partitionBy(key).orderBy(step)
    return F.when(F.col(step) - F.lag(step).over(w) == 1, F.lag(value).over(w)).otherwise(F.lit(start))


def position_bin(step: Column) -> Column:
    return F.when(step <= 3, step.cast("string")).when(step <= 5, "4-5").when(step <= 10, "6-10").otherwise("11+")


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per key, the most frequent label; of equal counts the least label."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col(label))).alias("b")).select(*keys, F.col(f"b.{label}").alias(label), F.col("b.n").alias("n"))


def transitions(df: DataFrame, key: str, step: str, state: str, states: list[str], alpha: float = 1.0) -> DataFrame:
    """(previous, state, n, p): smoothed probabilities from pairs that stand one step apart, for every pair of states."""
    w = Window.partitionBy(key).orderBy(step)
    pairs = df.select(F.lag(state).over(w).alias("previous"), F.col(state).alias("state"), (F.col(step) - F.lag(step).over(w)).alias("gap")).where("gap = 1")
    counts = pairs.groupBy("previous", "state").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(a, b) for a in states for b in states], "previous string, state string")
    full = every.join(counts, ["previous", "state"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("previous"))
    return full.withColumn("p", F.round((F.col("n") + alpha) / (total + alpha * len(states)), 6))


def newest_fit(key: str, order: str, cost: Column, limit: int) -> Column:
    """Whether a row fits when rows are taken newest first until the first overflow.

    Costs are not negative, so the rows that fit are those whose running cost, newest first, is within the limit;
    every row but the newest costs two more for its separator.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(cost + 2).over(newest) - 2 <= limit


def multiset_links(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of ``left``: its count, that of ``right``, links (the smaller) and what is missing."""
    a = left.groupBy(*keys).agg(F.count("*").alias("calls"))
    b = right.groupBy(*keys).agg(F.count("*").alias("results"))
    out = a.join(b, keys, "left").fillna(0, ["results"])
    return out.withColumn("linked", F.least("calls", "results")).withColumn("missing", F.col("calls") - F.col("linked"))


def shared_ids(a: Column, b: Column) -> Column:
    """The distinct ids in both arrays; an empty id is none."""
    return F.array_remove(F.array_intersect(a, b), "")


def covered_spans(df: DataFrame, key: str, order: str, calls: str, results: str) -> DataFrame:
    """Adds matched_next, how many of a span's call ids the next span of its key answers, and covered, whether there are any and it answers all.

    Both are null for a last span.
    """
    after = F.lead(results).over(Window.partitionBy(key).orderBy(order))
    df = df.withColumn("__next", after).withColumn("matched_next", F.when(F.col("__next").isNotNull(), F.size(shared_ids(F.col(calls), F.col("__next")))))
    own = F.array_remove(F.array_distinct(calls), "")
    return df.withColumn("covered", F.when(F.col("__next").isNotNull(), (F.size(own) > 0) & (F.size(F.array_except(own, F.col("__next"))) == 0))).drop("__next")


def smoothed(df: DataFrame, previous: str, state: str, states: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(previous, state, p): add-alpha probabilities of every state after each previous one that is seen; ``states`` has one row each."""
    counts = df.groupBy(previous, state).agg(F.count("*").alias("n"))
    totals = counts.groupBy(previous).agg(F.sum("n").alias("total"))
    k = states.agg(F.count("*").alias("k"))
    every = totals.crossJoin(states.select(state)).crossJoin(k)  # of known states, few
    return every.join(counts, [previous, state], "left").select(previous, state, ((F.coalesce("n", F.lit(0)) + alpha) / (F.col("total") + alpha * F.col("k"))).alias("p"))


def looked_up(df: DataFrame, model: DataFrame, fallback: DataFrame, previous: str, state: str) -> DataFrame:
    """Adds ``p``: the model's for (previous, state), or the fallback's where the model does not know the previous."""
    known = df.join(F.broadcast(model), [previous, state], "left")
    return known.join(F.broadcast(fallback.withColumnRenamed("p", "__p")), state, "left").withColumn("p", F.coalesce("p", "__p")).drop("__p")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, each row's place from 1 in a total order over all rows.

    Rows are sorted into ranges, counted by range, and numbered inside it, so that no task sees them all. The ranges are
    persisted, since both readings must see the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    keyed = keyed.repartitionByRange(parts, "__order").withColumn("__range", F.spark_partition_id()).persist()
    sizes = keyed.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__at"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__order"))
    return keyed.withColumn("__i", inside).join(F.broadcast(before), "__range").withColumn(out, (F.col("__at") + F.col("__i")).cast("long")).drop("__order", "__range", "__i", "__at")
