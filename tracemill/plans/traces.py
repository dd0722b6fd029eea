"""Queries over conversations and events as traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import hashing, text
from tracemill.operators import contracts, profile, sequence
from tracemill.plans.registry import query, table

_NORMAL = r"trim(regexp_replace(lower(text), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))"
_FIRST_USER = "SELECT conv_id, min_by(text, turn) AS task FROM conversations WHERE role = 'user' AND coalesce(text, '') <> '' GROUP BY conv_id"
_SPLIT = "CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'dev' ELSE 'test' END"


def normal_sql(c: str) -> str:
    """The normalised text of a column."""
    return _NORMAL.replace("text", c)


def bucket_sql(seed: str, key: str) -> str:
    return f"CAST(CAST(concat('0x', substr(sha256(concat('{seed}', chr(10), {key})), 1, 16)) AS UBIGINT) % 10000 AS INTEGER)"


_GROUPS = f"""
t AS ({_FIRST_USER}), g AS (SELECT conv_id, sha256({normal_sql("task")}) AS task_group FROM t),
s AS (SELECT conv_id, task_group, {bucket_sql(S.SPLIT_SEED_3WAY, "task_group")} AS b FROM g)"""


def first_user(conversations):
    """The first non-empty user text of each conversation."""
    users = conversations.where("role = 'user' and coalesce(text, '') <> ''")
    return users.groupBy("conv_id").agg(F.min_by("text", "turn").alias("task"))


def grouped(conversations):
    """(conv_id, task_group, split) of each conversation that has a task."""
    g = first_user(conversations).withColumn("task_group", F.sha2(text.normalize_task(F.col("task")), 256))
    return g.select("conv_id", "task_group", hashing.split_3way(F.col("task_group")).alias("split"))


@query(f"""
WITH {_GROUPS},
w AS (SELECT conv_id, turn, role, length(coalesce(text, '')) + length(role) + 3 AS cost, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prior_role FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.prior_role, p.turn AS pt, sum(p.cost + 2) OVER (PARTITION BY a.conv_id, a.turn ORDER BY p.turn DESC ROWS UNBOUNDED PRECEDING) - 2 AS used
  FROM w a LEFT JOIN w p ON a.conv_id = p.conv_id AND p.turn < a.turn WHERE a.role = 'assistant'),
f AS (SELECT conv_id, turn, any_value(prior_role) AS prior_role, count(pt) AS n_prior, count(*) FILTER (used <= 600) AS n_fit FROM p GROUP BY conv_id, turn)
SELECT f.conv_id, f.turn, {_SPLIT} AS split, prior_role, CAST(n_prior AS BIGINT) AS n_prior, CAST(n_fit AS BIGINT) AS n_fit FROM f LEFT JOIN s USING (conv_id)
""")
def turn_overview(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cost = F.char_length(F.coalesce("text", F.lit(""))) + F.char_length("role") + 3
    # The rows that fit stand directly before the turn: those whose running cost is within the limit of its own start.
    rows = c.select("conv_id", "turn", "role", (cost + 2).alias("cost"))
    rows = rows.withColumns({"prior_role": F.lag("role").over(order), "n_prior": F.count("*").over(before), "ends": F.sum("cost").over(order)})
    rows = rows.withColumn("at", F.col("ends") - F.col("cost"))
    reach = Window.partitionBy("conv_id").orderBy("at").rangeBetween(-602, -1)
    rows = rows.withColumn("n_fit", F.count("*").over(reach))
    return rows.where("role = 'assistant'").join(grouped(c), "conv_id", "left").select("conv_id", "turn", "split", "prior_role", "n_prior", "n_fit")


@query("""
SELECT conv_id, turn, count(*) OVER b AS n_prior, lag(role) OVER o AS prior_role, coalesce(bool_or(role = 'user') OVER b, false) AS user_seen,
  last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER b AS last_user_turn
FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn), b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
QUALIFY role = 'assistant'
""")
def prefix_targets(spark, sf_dir):
    b = sequence.before("conv_id", order=["turn"])
    o = Window.partitionBy("conv_id").orderBy("turn")
    user = F.col("role") == "user"
    out = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.count("*").over(b).alias("n_prior"), F.lag("role").over(o).alias("prior_role"),
        F.coalesce(F.max(user).over(b), F.lit(False)).alias("user_seen"), F.last(F.when(user, F.col("turn")), ignorenulls=True).over(b).alias("last_user_turn"),
    )
    return out.where("role = 'assistant'").drop("role")


@query(f"WITH {_GROUPS} SELECT conv_id, task_group, {_SPLIT} AS split, concat('t2d-', substr(sha256(concat(CAST(conv_id AS VARCHAR), chr(10), '1', chr(10), task_group)), 1, 32)) AS id FROM s")
def first_user_group_split(spark, sf_dir):
    g = grouped(table(spark, sf_dir, "conversations"))
    return g.withColumn("id", hashing.stable_id("t2d-", F.col("conv_id").cast("string"), F.lit("1"), F.col("task_group")))


def template_sql(c: str) -> str:
    """The normalised template of a task column."""
    return rf"""regexp_replace(regexp_replace({normal_sql(c)}, '\b\d+(?:\.\d+)*\b', '<num>', 'g'), '`[^`]+`|''[^'']+''|"[^"]+"', '<quoted>', 'g')"""


@query(f"""
WITH g AS (SELECT doc_id, {template_sql("text")} AS g FROM documents),
s AS (SELECT doc_id, {bucket_sql(S.SPLIT_SEED_4WAY, "g")} AS b FROM g)
SELECT CASE WHEN b < 7000 THEN 'train' WHEN b < 8000 THEN 'development' WHEN b < 9000 THEN 'calibration' ELSE 'test' END AS split, count(*) AS n, CAST(sum(b) AS BIGINT) AS bucket_sum FROM s GROUP BY 1
""")
def group_split_4way(spark, sf_dir):
    g = text.template_task(F.col("text"))
    d = table(spark, sf_dir, "documents").select(hashing.split_4way(g).alias("split"), hashing.bucket(S.SPLIT_SEED_4WAY, g).alias("b"))
    return d.groupBy("split").agg(F.count("*").alias("n"), F.sum("b").alias("bucket_sum"))


@query(f"""
WITH {_GROUPS}, k AS (SELECT task_group, {_SPLIT.replace("b <", "b2 <")} AS split FROM (SELECT task_group, {bucket_sql("rows", "CAST(conv_id AS VARCHAR)")} AS b2 FROM s)),
c AS (SELECT task_group, count(*) AS n, count(DISTINCT split) AS splits FROM k GROUP BY 1)
SELECT count(*) AS groups, count(*) FILTER (splits > 1) AS crossing, CAST(max(n) AS BIGINT) AS largest FROM c
""")
def split_crossings(spark, sf_dir):
    b = hashing.bucket("rows", F.col("conv_id").cast("string"))
    k = grouped(table(spark, sf_dir, "conversations")).withColumn("by_row", F.when(b < 8000, "train").when(b < 9000, "dev").otherwise("test"))
    c = k.groupBy("task_group").agg(F.count("*").alias("n"), F.count_distinct("by_row").alias("splits"))
    return c.agg(F.count("*").alias("groups"), F.count_if(F.expr("splits > 1")).alias("crossing"), F.max("n").alias("largest"))


@query("""
WITH k AS (SELECT DISTINCT source, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS family FROM documents)
SELECT a.source AS left_split, b.source AS right_split, count(*) AS shared FROM k a JOIN k b ON a.family = b.family AND a.source < b.source GROUP BY 1, 2
""")
def split_overlap_matrix(spark, sf_dir):
    return profile.overlap_matrix(table(spark, sf_dir, "documents").withColumn("family", text.task_family(F.col("text"))), "source", "family")


@query("""
SELECT conv_id, turn, role, CASE WHEN turn - lag(turn) OVER w = 1 THEN lag(role) OVER w ELSE 'START' END AS previous
FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def predecessor_contiguity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.select("conv_id", "turn", "role", sequence.contiguous_previous(c, "conv_id", "turn", "role").alias("previous"))


EVENT_STEPS = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"


def event_steps(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


@query(f"""
WITH e AS {EVENT_STEPS}, p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS previous, event_type AS state FROM e),
k AS (SELECT DISTINCT event_type FROM events),
f AS (SELECT a.event_type AS previous, b.event_type AS state, count(p.previous) AS n FROM k a CROSS JOIN k b LEFT JOIN p ON p.previous = a.event_type AND p.state = b.event_type GROUP BY 1, 2)
SELECT previous, state, n, round((n + 1.0) / (sum(n) OVER (PARTITION BY previous) + (SELECT count(*) FROM k)), 6) AS p FROM f
""")
def transition_matrix(spark, sf_dir):
    e = event_steps(spark, sf_dir)
    states = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # the label set
    return sequence.transitions(e, "user_id", "step", "event_type", states)


_BIN = "CASE WHEN step <= 3 THEN CAST(step AS VARCHAR) WHEN step <= 5 THEN '4-5' WHEN step <= 10 THEN '6-10' ELSE '11+' END"


@query(f"""
WITH c AS (SELECT {_BIN} AS position, event_type, count(*) AS n FROM {EVENT_STEPS} GROUP BY 1, 2)
SELECT position, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY position ORDER BY n DESC, event_type) = 1
""")
def position_bin_majority(spark, sf_dir):
    e = event_steps(spark, sf_dir).withColumn("position", sequence.position_bin(F.col("step")))
    return sequence.majority(e, ["position"], "event_type")


@query(f"""
WITH e AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY step), 'START') AS previous, {_BIN} AS position FROM {EVENT_STEPS}),
tr AS (SELECT * FROM e WHERE user_id % 4 <> 0),
fine AS (SELECT position, previous, event_type AS guess FROM (SELECT position, previous, event_type, count(*) AS n FROM tr WHERE value > 60 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY position, previous ORDER BY n DESC, event_type) = 1),
coarse AS (SELECT position, event_type AS guess FROM (SELECT position, event_type, count(*) AS n FROM tr WHERE step > 1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY position ORDER BY n DESC, event_type) = 1),
whole AS (SELECT event_type AS guess FROM tr GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT e.event_id, coalesce(f.guess, c.guess, w.guess) AS guess, CASE WHEN f.guess IS NOT NULL THEN 'fine' WHEN c.guess IS NOT NULL THEN 'coarse' ELSE 'global' END AS level
FROM e LEFT JOIN fine f ON e.position = f.position AND e.previous = f.previous LEFT JOIN coarse c ON e.position = c.position CROSS JOIN whole w WHERE e.user_id % 4 = 0
""")
def step_lookup_fallback(spark, sf_dir):
    e = event_steps(spark, sf_dir)
    e = e.withColumns({"previous": sequence.contiguous_previous(e, "user_id", "step", "event_type"), "position": sequence.position_bin(F.col("step"))})
    train = e.where("user_id % 4 <> 0")
    fine = sequence.majority(train.where("value > 60"), ["position", "previous"], "event_type").select("position", "previous", F.col("event_type").alias("f"))
    coarse = sequence.majority(train.where("step > 1"), ["position"], "event_type").select("position", F.col("event_type").alias("c"))
    whole = train.groupBy("event_type").count().orderBy(F.col("count").desc(), "event_type").limit(1).first()
    # Both tables have a row for each bin and label at most.
    out = e.where("user_id % 4 = 0").join(F.broadcast(fine), ["position", "previous"], "left").join(F.broadcast(coarse), "position", "left")
    return out.select("event_id", F.coalesce("f", "c", F.lit(whole["event_type"] if whole else None)).alias("guess"), F.when(F.col("f").isNotNull(), "fine").when(F.col("c").isNotNull(), "coarse").otherwise("global").alias("level"))


@query("""
WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS cost FROM conversations),
f AS (SELECT conv_id, turn, cost, sum(cost + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - 2 <= 1500 AS fits FROM c)
SELECT conv_id, count(*) AS candidates, count(*) FILTER (fits) AS retained, count(*) FILTER (NOT fits) AS omitted, CAST(coalesce(sum(cost) FILTER (fits), 0) AS BIGINT) AS chars FROM f GROUP BY conv_id
""")
def greedy_history_fit(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("cost"))
    f = c.withColumn("fits", sequence.newest_fit("conv_id", "turn", F.col("cost"), 1500))
    return f.groupBy("conv_id").agg(F.count("*").alias("candidates"), F.count_if(F.expr("fits")).alias("retained"), F.count_if(F.expr("not fits")).alias("omitted"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("cost"))), F.lit(0)).alias("chars"))


def bounded_sql(c: str, limit: int) -> str:
    marker = f"concat(chr(10), '...[TRUNCATED ', length({c}) - {limit}, ' CHARS]...', chr(10))"
    room = f"({limit} - length({marker}))"
    return f"CASE WHEN length({c}) <= {limit} THEN {c} ELSE concat(substr({c}, 1, {room} // 2), {marker}, substr({c}, length({c}) - ({room} - {room} // 2) + 1)) END"


@query(f"SELECT doc_id, sha256({bounded_sql('text', 400)}) AS digest, CAST(length({bounded_sql('text', 400)}) AS INTEGER) AS n FROM documents")
def bounded_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.bounded(F.col("text"), 400).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("digest"), F.char_length("t").alias("n"))


@query(f"""
SELECT conv_id, turn, concat('[', upper(role), ']', chr(10), CASE WHEN coalesce(text, '') = '' THEN '[EMPTY]' ELSE {bounded_sql('text', 300)} END) AS rendered FROM conversations
""")
def render_messages(spark, sf_dir):
    body = F.when(F.coalesce("text", F.lit("")) == "", "[EMPTY]").otherwise(text.bounded(F.col("text"), 300))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), body).alias("rendered"))


_STATE = f"""
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
task AS (SELECT conv_id, min_by(text, turn) AS task, min(turn) AS tt FROM r WHERE role = 'user' GROUP BY 1),
sys AS (SELECT conv_id, min_by(text, turn) AS sys FROM r WHERE role = 'system' GROUP BY 1),
h AS (SELECT r.conv_id, r.turn, concat('[', upper(role), ']', chr(10), CASE WHEN coalesce(text, '') = '' THEN '[EMPTY]' ELSE {bounded_sql('text', 4000)} END) AS m FROM r JOIN task USING (conv_id) WHERE role <> 'system' AND turn <> tt),
f AS (SELECT *, sum(length(m) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - 2 <= 14000 AS fits FROM h),
hist AS (SELECT conv_id, count(*) FILTER (NOT fits) AS omitted, string_agg(m, chr(10) || chr(10) ORDER BY turn) FILTER (fits) AS history FROM f GROUP BY 1)"""


@query(f"""
WITH {_STATE}
SELECT t.conv_id, CAST(coalesce(omitted, 0) AS BIGINT) AS omitted, sha256(concat('TASK', chr(10), {bounded_sql('task', 6000)}, chr(10), chr(10), 'SYSTEM CONSTRAINTS', chr(10), {bounded_sql("coalesce(sys, '')", 2500)},
  chr(10), chr(10), 'AVAILABLE NEXT-ACTION TYPES', chr(10), 'read, search, edit, execute, other_tool, respond_or_finish', chr(10), chr(10), 'OBSERVABLE HISTORY BEFORE TARGET', chr(10),
  CASE WHEN omitted > 0 THEN concat('[OMITTED ', omitted, ' OLDER MESSAGES]', chr(10), chr(10)) ELSE '' END, coalesce(history, '[NO PRIOR ACTION HISTORY]'))) AS state_sha256
FROM task t LEFT JOIN sys USING (conv_id) LEFT JOIN hist USING (conv_id)
""")
def char_budget_state(spark, sf_dir):
    """The whole state text of each conversation under the character budgets."""
    c = table(spark, sf_dir, "conversations")
    heads = c.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("task"), F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("tt"),
        F.min_by("text", F.when(F.col("role") == "system", F.col("turn"))).alias("sys"),
    ).where("tt is not null")
    body = F.when(F.coalesce("text", F.lit("")) == "", "[EMPTY]").otherwise(text.bounded(F.col("text"), S.MAX_MESSAGE_CHARS))
    h = c.join(heads.select("conv_id", "tt"), "conv_id").where("role <> 'system' and turn <> tt").select("conv_id", "turn", F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), body).alias("m"))
    f = h.withColumn("fits", sequence.newest_fit("conv_id", "turn", F.char_length("m"), S.MAX_HISTORY_CHARS))
    # What fits is bounded by the budget, so a group's list is too.
    kept = F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("turn", "m"))))
    hist = f.groupBy("conv_id").agg(F.count_if(F.expr("not fits")).alias("omitted"), F.array_join(F.transform(kept, lambda x: x["m"]), "\n\n").alias("history"))
    out = heads.join(hist, "conv_id", "left").withColumn("omitted", F.coalesce("omitted", F.lit(0)))
    history = F.concat(F.when(F.col("omitted") > 0, F.concat(F.lit("[OMITTED "), F.col("omitted").cast("string"), F.lit(" OLDER MESSAGES]\n\n"))).otherwise(""), F.coalesce(F.nullif("history", F.lit("")), F.lit("[NO PRIOR ACTION HISTORY]")))
    state = F.concat(
        F.lit("TASK\n"), text.bounded(F.col("task"), S.MAX_TASK_CHARS), F.lit("\n\nSYSTEM CONSTRAINTS\n"), text.bounded(F.coalesce("sys", F.lit("")), S.MAX_SYSTEM_CHARS),
        F.lit("\n\nAVAILABLE NEXT-ACTION TYPES\n" + ", ".join(S.ONTOLOGY) + "\n\nOBSERVABLE HISTORY BEFORE TARGET\n"), history,
    )
    return out.select("conv_id", "omitted", F.sha2(state, 256).alias("state_sha256"))


@query("""
WITH c AS (SELECT l_orderkey AS k, count(*) AS calls FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), r AS (SELECT o_orderkey AS k, count(*) AS results FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(least(calls, coalesce(results, 0))) AS BIGINT) AS linked, CAST(sum(calls - least(calls, coalesce(results, 0))) AS BIGINT) AS missing FROM c LEFT JOIN r USING (k)
""")
def multiset_id_link(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("k"))
    results = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"))
    return sequence.multiset_links(calls, results, ["k"]).agg(*[F.sum(c).alias(c) for c in ("calls", "linked", "missing")])


@query("""
WITH u AS (SELECT user_id AS k, ts, event_id AS i, event_type = 'click' AS is_call FROM events WHERE event_type IN ('click', 'purchase')),
f AS (SELECT *, bool_or(is_call) OVER (PARTITION BY k ORDER BY ts, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM u)
SELECT k, count(*) FILTER (NOT is_call AND coalesce(seen, false)) AS linked, count(*) FILTER (NOT is_call AND NOT coalesce(seen, false)) AS orphans FROM f GROUP BY k
""")
def ordered_asof_link(spark, sf_dir):
    """A result links only if a call of its key stands before it."""
    u = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("i"), (F.col("event_type") == "click").alias("is_call"))
    seen = F.coalesce(F.max("is_call").over(sequence.before("k", order=["ts", "i"])), F.lit(False))
    return u.withColumn("seen", seen).groupBy("k").agg(F.count_if(F.expr("not is_call and seen")).alias("linked"), F.count_if(F.expr("not is_call and not seen")).alias("orphans"))


@query("""
WITH n AS (SELECT user_id, event_type, lead(event_type) OVER w AS nxt, lead(value) OVER w AS nv, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_type, count(*) AS n, count(*) FILTER (nxt IS NOT NULL) AS with_next, count(*) FILTER (nxt = event_type) AS same_next, count(*) FILTER (nv >= value) AS covered FROM n GROUP BY event_type
""")
def next_event_link(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = table(spark, sf_dir, "events").select("event_type", "value", F.lead("event_type").over(w).alias("nxt"), F.lead("value").over(w).alias("nv"))
    return n.groupBy("event_type").agg(F.count("*").alias("n"), F.count("nxt").alias("with_next"), F.count_if(F.expr("nxt = event_type")).alias("same_next"), F.count_if(F.expr("nv >= value")).alias("covered"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unresolved_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return c.join(orders, c["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT text AS shared FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1")
def leakage_intersect(spark, sf_dir):
    """Texts on both sides of a split by parity of the id."""
    d = table(spark, sf_dir, "documents")
    return d.where("doc_id % 2 = 0").select(F.col("text").alias("shared")).intersect(d.where("doc_id % 2 = 1").select("text"))


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key")).subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT conv_id, turn, count(*) OVER w AS seen, turn = max(turn) OVER (PARTITION BY conv_id) AS is_final FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def final_step_marking(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    w = Window.partitionBy("conv_id")
    return c.select("conv_id", "turn", F.count("*").over(w.orderBy("turn")).alias("seen"), (F.col("turn") == F.max("turn").over(w)).alias("is_final"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, CAST(arg_max(length(text), turn) AS INTEGER) AS n FROM conversations GROUP BY conv_id")
def keep_latest(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by(F.char_length("text"), "turn").alias("n"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2 DESC, turn) AS r FROM conversations) SELECT conv_id, turn, role FROM r WHERE r = 1")
def keep_latest_first_of_ties(spark, sf_dir):
    """The row of the highest step; of equal steps (two turns make one) the first."""
    best = F.max_by(F.struct("turn", "role"), F.struct(F.expr("turn div 2"), -F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(best.alias("b")).select("conv_id", "b.turn", "b.role")


@query("WITH w AS (SELECT conv_id, turn, role, first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS task, lag(text, 2) OVER o AS call, lag(text) OVER o AS response FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sha256(concat(coalesce(task, ''), chr(10), call, chr(10), response)) AS digest FROM w WHERE role = 'assistant' AND call IS NOT NULL AND response IS NOT NULL")
def allowed_input(spark, sf_dir):
    """What a model may see of a target: the task and the two values before it, and nothing else."""
    o = Window.partitionBy("conv_id").orderBy("turn")
    task = F.first(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    w = table(spark, sf_dir, "conversations").withColumns({"task": F.coalesce(task, F.lit("")), "call": F.lag("text", 2).over(o), "response": F.lag("text").over(o)})
    seen = contracts.only(w.where("role = 'assistant' and call is not null and response is not null").select("conv_id", "turn", "task", "call", "response"), ["conv_id", "turn", "task", "call", "response"])
    return seen.select("conv_id", "turn", F.sha2(F.concat_ws("\n", "task", "call", "response"), 256).alias("digest"))


@query("""
WITH r AS (SELECT conv_id, turn, role, lag(role) OVER w AS r1, lag(role, 2) OVER w AS r2, lag(length(text)) OVER w AS n1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn FROM r WHERE role = 'assistant' AND r1 = 'user' AND r2 = 'assistant' AND n1 >= 40
""")
def adjacent_triples(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("r1"), F.lag("role", 2).over(w).alias("r2"), F.lag(F.char_length("text")).over(w).alias("n1"))
    return r.where("role = 'assistant' and r1 = 'user' and r2 = 'assistant' and n1 >= 40").select("conv_id", "turn")
