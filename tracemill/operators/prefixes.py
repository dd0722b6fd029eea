"""Digests of every prefix of every conversation, without putting a prefix together.

Each message gets numbers from a digest of its place and itself; a prefix's digest is made of the sums of the numbers before
it. Sums compose: a long conversation is split into blocks of places, each summed on its own, and a block begins with
the sums of those before it. Equal prefixes have equal digests; others differ as far as 120 bits of a sum of digests tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.shared import stored

#: Places of a conversation in one block, and bits of a message's digest that are summed, as two numbers of hex digits.
BLOCK, DIGITS = 4_096, 15


def numbers(at: Column, content: Column) -> list[Column]:
    """Two whole numbers from the digest of a place and what stands there."""
    digest = F.sha2(F.concat(at.cast("string"), F.lit(":"), content).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(20,0)") for k in range(2)]


def digests(messages: DataFrame, content: Column, conv: str = "conv", at: str = "i", block: int = BLOCK) -> DataFrame:
    """``messages`` with ``n_before`` and ``prefix``, the digest of all that stands before each; places are 0, 1, ... within a conversation.

    ``content`` is the text that stands for a message; a null counts as empty.
    """
    one, two = numbers(F.col(at), F.coalesce(content, F.lit("")))
    rows = stored(messages.withColumns({"__block": F.floor(F.col(at) / block).cast("long"), "__one": one, "__two": two}))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = rows.groupBy(F.col(conv).alias("__conv"), F.col("__block").alias("__of")).agg(F.sum("__one").alias("one"), F.sum("__two").alias("two"), F.count("*").alias("n"))
    of = Window.partitionBy("__conv").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__conv", "__of", *[F.coalesce(F.sum(c).over(of), zero).alias(f"__{c}_at") for c in ("one", "two")], F.coalesce(F.sum("n").over(of), F.lit(0)).alias("__n_at"))
    inside = Window.partitionBy(conv, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__a": F.coalesce(F.sum("__one").over(inside), zero), "__b": F.coalesce(F.sum("__two").over(inside), zero), "__n": F.count("*").over(inside)})
    joined = rows.join(sums, F.col(conv).eqNullSafe(F.col("__conv")) & (F.col("__block") == F.col("__of")))
    n = F.col("__n_at") + F.col("__n")
    text = F.concat_ws(":", n.cast("string"), (F.col("__a") + F.col("__one_at")).cast("decimal(38,0)").cast("string"), (F.col("__b") + F.col("__two_at")).cast("decimal(38,0)").cast("string"))
    return joined.select(*messages.columns, n.cast("long").alias("n_before"), F.sha2(text, 256).alias("prefix"))


def repeated(targets: DataFrame, label: str, prefix: str = "prefix") -> DataFrame:
    """(prefix, n, labels) of the prefixes that stand before several targets; more than one label is a conflict."""
    return targets.groupBy(prefix).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).where("n > 1")


def cut_at_one_target(messages: DataFrame, role: str = "role", conv: str = "conv", at: str = "i", salt: int = 0) -> DataFrame:
    """Each conversation up to one of its assistant messages, drawn by hash, as ``target``: a target can be changed there without being in another's prefix."""
    own = messages.where(F.col(role) == "assistant").groupBy(F.col(conv).alias("__c")).agg(F.min_by(at, F.xxhash64(conv, at, F.lit(salt))).alias("target"))
    return messages.join(own, F.col(conv).eqNullSafe(F.col("__c"))).where(F.col(at) <= F.col("target")).drop("__c")
