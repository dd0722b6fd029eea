"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns by prefix sums of turn tokens. Prefix sums are divided into
cells of ``CELL`` tokens; a turn belongs to the cell where it begins. A turn that runs over its cell's end by at
most ``SPILL`` tokens stays, else it is a window of its own. So the new turns of a window hold at most
CELL + SPILL tokens, unless one turn alone is longer; turns are never cut. Each window but the first also gets,
before its new turns, the latest system turn before it and up to ``HISTORY`` turns of at most ``HISTORY_TOKENS``
tokens that stand directly before it. Those repeats are context: only new assistant turns are in the loss mask,
so every assistant text is a target exactly once. So a window's budget is CELL + SPILL + HISTORY_TOKENS and its
system turn, which is kept whole. Each ``BLOCK`` turn numbers begin a new window: tokens are summed inside blocks and from
block to block, and a block brings along the turns that its first windows repeat, so a long conversation is many tasks.

Template: ``<<SYS>>text<</SYS>>`` for system, ``[INST]text[/INST]`` for user, ``<s>text</s>`` for assistant, and
``[INST]<<SYS>>role<</SYS>>text[/INST]`` for any other role. Inside texts and roles '~' is written '~0', and a
bracket that begins one of the six control strings '~1' ('[') or '~2' ('<'); undone in reverse, this is exact.

Defined cases: null text is empty, a null role is the role ''; turns stand by turn, role, text, null turns first;
repeated rows are repeated turns; a null conv_id is one conversation; an empty table gives no windows; other columns
are not carried. A row of the output holds one window, so memory goes with the budget and the longest turn. Rows of one turn
number, or of none, of one conversation are ordered in one task. Only the digests of ``op3_chat_format`` need a whole
conversation in one row; the windows do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import cut, small_side, table

CELL, SPILL, HISTORY, HISTORY_TOKENS = 256, 64, 3, 128
#: Turn numbers of a block, a power of two.
BLOCK = 512
_PARTS = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(text, r"\[(?=/?INST\])", "~1"), r"<(?=/?s>|</?SYS>>)", "~2")


def unescape(text: Column) -> Column:
    for code, plain in (("~2", "<"), ("~1", "["), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """Budget units of a turn: one for each four code points begun, and four for its marks."""
    return (F.ceil(F.char_length(text) / 4) + 4).cast("long")


def framed(role: Column, body: Column) -> Column:
    """A turn in its marks; ``body`` is escaped."""
    other = F.concat(F.lit("[INST]<<SYS>>"), escape(role), F.lit("<</SYS>>"), body, F.lit("[/INST]"))
    return (
        F.when(role == "system", F.concat(F.lit("<<SYS>>"), body, F.lit("<</SYS>>")))
        .when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), body, F.lit("</s>")))
        .otherwise(other)
    )


def _brought(rows: DataFrame, history: int) -> tuple[DataFrame, DataFrame]:
    """Of blocks that are not their conversation's first: (conv_id, block, i0, at0), what stands before them, and their brought turns.

    These are the ``history`` turns before the block and the latest system turn, with i and at in the whole conversation.
    """
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.max((F.col("role") == "system").cast("int")).alias("has"))
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumns(
        {
            "i0": F.coalesce(F.sum("n").over(before), F.lit(0)), "at0": F.coalesce(F.sum("cost").over(before), F.lit(0)), "blocks": F.count("*").over(Window.partitionBy("conv_id")),
            "from": F.concat(F.array(*[F.lag(F.struct("block"), k).over(order) for k in range(1, history + 1)]), F.array(F.last(F.when(F.col("has") == 1, F.struct("block")), ignorenulls=True).over(before))),
        }
    )
    blocks = cut(blocks.where("blocks > 1").select("conv_id", "block", "i0", "at0", "from"))
    some = small_side(blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "i0", "at0"))
    long = rows.join(some, rows["conv_id"].eqNullSafe(F.col("c")) & rows["block"].eqNullSafe(F.col("b"))).drop("c", "b")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    back = Window.partitionBy("conv_id", "block").orderBy(F.desc("i"))
    long = long.withColumns({"i": F.row_number().over(inside) + F.col("i0"), "at": F.col("at0") + F.sum("cost").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cost")})
    later = F.sum((F.col("role") == "system").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, -1))
    tails = long.withColumns({"k": F.row_number().over(back), "last_system": (F.col("role") == "system") & (F.coalesce(later, F.lit(0)) == 0)}).where((F.col("k") <= history) | F.col("last_system"))
    tails = tails.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "role", "text", "i", "at", "last_system")
    wanted = blocks.where("i0 > 0").select("conv_id", "block", "i0", F.posexplode("from").alias("k", "f")).where("f is not null")
    brought = wanted.join(tails, wanted["conv_id"].eqNullSafe(F.col("c")) & wanted["f.block"].eqNullSafe(F.col("b"))).where(F.when(F.col("k") == history, F.col("last_system")).otherwise(F.col("i") > F.col("i0") - history))
    return blocks.where("i0 > 0").drop("from"), brought.select("conv_id", "block", "role", "text", "i", "at").distinct()


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", cell: int = CELL, spill: int = SPILL, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, block: int = BLOCK) -> DataFrame:
    """One row per window: conv_id, window (the number of its first new turn, from 1), formatted, n_context (turns repeated) and loss, an array of (start, len) in code points."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"cost": tokens(F.col("text")), "block": F.shiftright("turn", block.bit_length() - 1)})
    before, brought = _brought(rows, history)
    before = small_side(cut(before.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "i0", "at0")))
    rows = rows.join(before, rows["conv_id"].eqNullSafe(F.col("c")) & rows["block"].eqNullSafe(F.col("b")), "left").drop("c", "b").fillna(0, ["i0", "at0"])
    rows = rows.withColumn("lead", F.lit(False)).unionByName(cut(brought).withColumn("lead", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("conv_id", "block").orderBy(F.desc("lead"), F.col("i"), "turn", "role", "text")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    own = lambda x: F.when(F.col("lead"), 0).otherwise(x)
    # Brought turns have their numbers; the others count on from what stands before the block.
    rows = rows.withColumns({"n_before": F.coalesce(F.sum(own(1)).over(prior), F.lit(0)), "cost_before": F.coalesce(F.sum(own(F.col("cost"))).over(prior), F.lit(0))})
    rows = rows.withColumns({"i": F.coalesce("i", F.col("i0") + F.col("n_before") + 1).cast("long"), "at": F.coalesce("at", F.col("at0") + F.col("cost_before")).cast("long")}).drop("n_before", "cost_before", "i0", "at0")
    # Marked here and not before, so that texts are shuffled once and not thrice.
    rows = rows.withColumn("body", escape(F.col("text"))).withColumn("framed", framed(F.col("role"), F.col("body"))).drop("text")
    order = Window.partitionBy("conv_id", "block").orderBy("i")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    part = F.expr(f"at div {cell}")
    alone = F.col("at") + F.col("cost") > (part + 1) * cell + spill
    rows = rows.withColumn("w", part * 2 + F.when(alone, 1).otherwise(0))
    # What stands before each turn: the last few turns, newest first, and the latest system turn.
    rows = rows.withColumn("past", F.array(*[F.lag(F.struct("i", "at", "framed"), k).over(order) for k in range(1, history + 1)]))
    rows = rows.withColumn("system", F.last(F.when(F.col("role") == "system", F.struct("i", "framed")), ignorenulls=True).over(prior)).where(~F.col("lead"))
    piece = F.struct("i", "role", "framed", F.char_length("body").alias("len"))
    found = rows.groupBy("conv_id", "block", "w").agg(
        F.sort_array(F.collect_list(piece)).alias("new"),
        F.min_by(F.struct("i", "at", "past", "system"), "i").alias("head"),
    )
    near = F.filter("head.past", lambda t: t.isNotNull() & (F.col("head.at") - t["at"] <= history_tokens))
    found = found.withColumn("near", F.reverse(F.transform(near, lambda t: t["framed"]))).withColumn("oldest", F.col("head.i") - F.size(near))
    system = F.when(F.col("head.system.i") < F.col("oldest"), F.array("head.system.framed")).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("context", F.concat(system, "near")).withColumn("prefix", F.array_join("context", ""))
    # Where each new turn starts, by a running sum over the window's own turns.
    starts = F.aggregate(
        F.transform("new", lambda t: F.char_length(t["framed"])),
        F.array(F.char_length("prefix")),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )
    found = found.withColumn("starts", starts)
    spans = F.zip_with("new", F.slice("starts", F.lit(1), F.size("new")), lambda t, s: F.when(t["role"] == "assistant", F.struct((s + 3).cast("long").alias("start"), t["len"].cast("long").alias("len"))))
    return found.select(
        "conv_id",
        F.col("head.i").alias("window"),
        F.concat("prefix", F.array_join(F.transform("new", lambda t: t["framed"]), "")).alias("formatted"),
        F.size("context").cast("long").alias("n_context"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns, the (role, text) of the new turns, and targets, the texts under the loss mask, read from ``formatted``."""

    def turn(part):
        inner = lambda left, right: F.substring(part, F.lit(left + 1), F.char_length(part) - (left + right))
        body = inner(6, 7)
        named = F.instr(body, "<<SYS>>") == 1
        role = F.substring_index(F.substring(body, F.lit(8), F.char_length(body)), "<</SYS>>", 1)
        rest = F.substring(body, F.char_length(role) + 16, F.char_length(body))
        make = lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text"))
        return (
            F.when(F.startswith(part, F.lit("<s>")), make(F.lit("assistant"), inner(3, 4)))
            .when(F.startswith(part, F.lit("<<SYS>>")), make(F.lit("system"), inner(7, 8)))
            .when(named, make(role, rest))
            .otherwise(make(F.lit("user"), body))
        )

    parts = F.regexp_extract_all("formatted", F.lit(_PARTS), F.lit(0))
    return formatted.withColumn("parts", parts).withColumn("turns", F.transform(F.slice("parts", F.col("n_context").cast("int") + 1, F.greatest(F.size("parts"), F.lit(1))), turn)).withColumn(
        "targets", F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["len"].cast("int"))))
    ).drop("parts")


def op3_chat_format(spark, sf_dir) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # What is under the mask is sent along only if it isn't the assistants' texts, as it should be.
    spoken = lambda turns: F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    target = F.array_join("targets", "")
    back = read_back(windows(turns)).select("conv_id", "window", F.char_length("formatted").alias("chars"), "turns", F.when(target != spoken(F.col("turns")), target).alias("other"))
    parts = F.sort_array(F.collect_list(F.struct("window", "turns", "other")))
    whole = back.groupBy("conv_id").agg(parts.alias("parts"), F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    every = F.flatten(F.transform("parts", lambda x: x["turns"]))
    said = F.array_join(F.transform(every, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("parts", lambda x: F.coalesce(x["other"], spoken(x["turns"]))), "")
    whole = whole.select("conv_id", F.size(every).cast("long").alias("n_turns"), said.alias("said"), masked.alias("target"), "formatted_chars", "n_windows")
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("target").cast("long").alias("loss_chars"), F.sha2("target", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '~', '~0'), '\[(/?INST\])', '~1\1', 'g'), '<(/?s>|</?SYS>>)', '~2\1', 'g') AS body,
  CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS cost FROM t),
f AS (SELECT *, length(body) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 28 + length(role) END AS chars,
  row_number() OVER o AS i, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT *, pos // 256 * 2 + CASE WHEN pos + cost > (pos // 256 + 1) * 256 + 64 THEN 1 ELSE 0 END AS w,
  lag(pos, 1) OVER o AS p1, lag(pos, 2) OVER o AS p2, lag(pos, 3) OVER o AS p3,
  lag(chars, 1) OVER o AS c1, lag(chars, 2) OVER o AS c2, lag(chars, 3) OVER o AS c3,
  max(CASE WHEN role = 'system' THEN i END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sys
  FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
h AS (SELECT *, turn // 512 AS blk, row_number() OVER (PARTITION BY conv_id, turn // 512, w ORDER BY i) AS r,
  coalesce(CAST(pos - p1 <= 128 AS INTEGER), 0) + coalesce(CAST(pos - p2 <= 128 AS INTEGER), 0) + coalesce(CAST(pos - p3 <= 128 AS INTEGER), 0) AS n_near FROM g),
ctx AS (SELECT h.conv_id, h.w,
  CASE WHEN n_near >= 1 THEN c1 ELSE 0 END + CASE WHEN n_near >= 2 THEN c2 ELSE 0 END + CASE WHEN n_near >= 3 THEN c3 ELSE 0 END
  + CASE WHEN h.sys < h.i - n_near THEN s.chars ELSE 0 END AS ctx_chars
  FROM h LEFT JOIN f s ON s.conv_id = h.conv_id AND s.i = h.sys WHERE r = 1),
total AS (SELECT conv_id, CAST(sum(ctx_chars) AS BIGINT) AS ctx_chars, count(*) AS n_windows FROM ctx GROUP BY conv_id)
SELECT f.conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(chars) + any_value(ctx_chars) AS BIGINT) AS formatted_chars, any_value(n_windows) AS n_windows
FROM f JOIN total USING (conv_id) GROUP BY f.conv_id
"""
