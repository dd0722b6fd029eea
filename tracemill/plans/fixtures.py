"""Queries that need tool calls, tags or records, over rows given here or made from the tables."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import hashing, text
from tracemill.operators import classify, records, render, tagged, token_budget
from tracemill.plans.registry import query, table
from tracemill.plans.traces import bounded_sql, bucket_sql, normal_sql, template_sql

_TOOL_NAMES = ["read", "Read-File", "read_notes", "ls", "deep_search", "find_all", "apply-patch", "rewrite", "bash", "my_shell", "terminal", "browser", " Execute_Code ", ""]


def _action_sql(c: str) -> str:
    n = f"replace(trim(lower({c}), ' '), '-', '_')"
    quoted = lambda names: ", ".join(f"'{x}'" for x in names)
    return (
        f"CASE WHEN {n} IN ({quoted(S.READ_NAMES)}) OR starts_with({n}, 'read_') THEN 'read' WHEN {n} IN ({quoted(S.SEARCH_NAMES)}) OR regexp_matches({n}, 'search|grep|glob|find') THEN 'search' "
        f"WHEN {n} IN ({quoted(S.EDIT_NAMES)}) OR regexp_matches({n}, 'edit|write|patch') THEN 'edit' WHEN {n} IN ({quoted(S.EXECUTE_NAMES)}) OR regexp_matches({n}, 'shell|terminal|execute') THEN 'execute' ELSE 'other_tool' END"
    )


@query(f"WITH n AS (SELECT unnest({_TOOL_NAMES}) AS name UNION SELECT event_type FROM events) SELECT name, {_action_sql('name')} AS action FROM n")
def tool_action_map(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in _TOOL_NAMES], "name string").union(table(spark, sf_dir, "events").select("event_type")).distinct()
    return names.select("name", text.tool_action(F.col("name")).alias("action"))


def _wrapped(role, body):
    """Turns as tagged values: assistants think and some tags are broken, by the turn's number."""
    return F.when(role == "assistant", F.concat(F.when(F.col("turn") % 7 == 3, "<think>a<think>b</think>").when(F.col("turn") % 2 == 1, "<think>plan</think>").otherwise(""), body)).otherwise(body)


@query("""
WITH v AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN concat(CASE WHEN turn % 7 = 3 THEN '<think>a<think>b</think>' WHEN turn % 2 = 1 THEN '<think>plan</think>' ELSE '' END, text) ELSE text END AS v FROM conversations),
t AS (SELECT *, array_to_string(list_transform(regexp_extract_all(v, '(?i)<think\\b[^>]*>|</think\\s*>'), lambda x: CASE WHEN starts_with(x, '</') THEN 'C' ELSE 'O' END), '') AS tags FROM v)
SELECT conv_id, turn, regexp_full_match(tags, '(OC)*') AS valid, CASE WHEN regexp_full_match(tags, '(OC)*') THEN sha256(regexp_replace(v, '(?is)<think\\b[^>]*>.*?</think\\s*>', '', 'g')) END AS digest FROM t
""")
def think_validity(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_reasoning(_wrapped(F.col("role"), F.col("text"))).alias("r"))
    return r.select("conv_id", "turn", "r.valid", F.when(F.col("r.valid"), F.sha2("r.text", 256)).alias("digest"))


def exchanges(spark, sf_dir):
    """Conversations with ``ms``, the messages of each turn: assistant turns call tools picked by their place, and results of
    those calls stand before the next user text."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.expr("conv_id * 7 + turn * 3"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("read_file", "grep", "write_file", "bash", "browser")]), (F.col("k") % 5 + 1).cast("int"))
    call = lambda i, n: F.struct(F.concat(F.lit("c"), F.col("turn").cast("string"), F.lit(i)).alias("id"), F.lit("function").alias("type"), F.struct(n.alias("name"), F.lit("{}").alias("arguments")).alias("function"))
    second = F.when(F.col("k") % 4 == 0, F.lit("bash")).otherwise(name)
    calls = F.when((F.col("role") == "assistant") & (F.col("k") % 6 != 0), F.array(call("a", name), call("b", second))).when(F.col("role") == "assistant", F.array().cast(f"array<{S.CALL}>"))
    result = F.when((F.col("role") == "user") & (F.col("turn") > 0) & (F.col("k") % 11 != 0), True).otherwise(False)
    # Both results of the assistant turn before stand in tool messages after it.
    own = F.struct("role", F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning_content"), calls.alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"))
    tool = lambda i: F.struct(F.lit("tool").alias("role"), F.lit("ok").alias("content"), F.lit(None).cast("string").alias("reasoning_content"), F.lit(None).cast(f"array<{S.CALL}>").alias("tool_calls"), F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"), F.lit(i)).alias("tool_call_id"), F.lit("grep" if i == "a" else None).cast("string").alias("name"))
    return c.withColumn("ms", F.when(result, F.array(tool("a"), tool("b"), own)).otherwise(F.array(own)))


def cumulative(spark, sf_dir):
    """Cumulative trace rows: each assistant turn's row holds its whole prefix, as this kind of source does."""
    c = exchanges(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"messages": F.flatten(F.collect_list("ms").over(w)), "assistant_step": F.sum((F.col("role") == "assistant").cast("int")).over(w).cast("int")}).where("role = 'assistant'")
    n = F.size("messages")
    return c.select(
        "conv_id", "turn", F.sha2(F.col("conv_id").cast("string"), 256).alias("source_trajectory_sha256"), "assistant_step", F.max("assistant_step").over(Window.partitionBy("conv_id")).alias("assistant_steps"),
        F.when(F.col("k") % 23 == 0, n).otherwise(n - 1).alias("target_message_index"), (n + F.when(F.col("k") % 31 == 0, 1).otherwise(0)).alias("n_messages"), "messages",
    )


_TRACE = f"""
c AS (SELECT *, conv_id * 7 + turn * 3 AS k FROM conversations),
m AS (SELECT *, ['read_file', 'grep', 'write_file', 'bash', 'browser'][k % 5 + 1] AS name FROM c),
x AS (SELECT *, CASE WHEN role = 'assistant' AND k % 6 <> 0 THEN [name, CASE WHEN k % 4 = 0 THEN 'bash' ELSE name END] ELSE [] END AS names, role = 'user' AND turn > 0 AND k % 11 <> 0 AS answers FROM m),
y AS (SELECT *, bool_or(role = 'assistant' AND len(names) > 0 AND NOT EXISTS (SELECT 1 FROM x r WHERE r.conv_id = x.conv_id AND r.turn = x.turn + 1 AND r.answers)) OVER b AS open_before,
  first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER b AS task FROM x WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kinds AS (SELECT *, list_sort(list_distinct(list_transform(names, lambda n: {_action_sql('n')}))) AS cats FROM y WHERE role = 'assistant')"""


@query(f"""
WITH {_TRACE},
r AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'invalid_cumulative_target_boundary' WHEN len(names) = 0 THEN 'no_call_without_positive_completion' WHEN len(cats) <> 1 THEN 'mixed_target_categories'
  WHEN coalesce(task, '') = '' THEN 'missing_initial_user_task' WHEN coalesce(open_before, false) THEN 'unresolved_prefix_tool_call' END AS reason FROM kinds)
SELECT coalesce(reason, 'retained') AS outcome, CASE WHEN reason IS NULL THEN cats[1] END AS label, count(*) AS n FROM r GROUP BY 1, 2
""")
def whole_turn_ledger(spark, sf_dir):
    d = classify.whole_turn(cumulative(spark, sf_dir))
    return d.groupBy(F.coalesce("reason", F.lit("retained")).alias("outcome"), "label").agg(F.count("*").alias("n"))


def _first_call_sql(policy: int) -> str:
    malformed = "k % 23 = 0 OR k % 31 = 0" if policy == 1 else "k % 23 = 0"  # only the first policy looks at the number of messages
    return f"""
WITH {_TRACE},
r AS (SELECT *, CASE WHEN len(names) = 0 THEN 'respond_or_finish' ELSE {_action_sql('names[1]')} END AS label, CASE WHEN {malformed} THEN 'malformed_row' WHEN coalesce(task, '') = '' THEN 'missing_initial_user_task' WHEN coalesce(open_before, false) THEN 'unresolved_prefix_tool_call' END AS reason FROM kinds)
SELECT coalesce(reason, 'retained') AS outcome, label, count(*) AS n FROM r GROUP BY 1, 2"""


@query(_first_call_sql(1))
def first_call_v1(spark, sf_dir):
    return classify.first_call(cumulative(spark, sf_dir), 1).groupBy(F.coalesce("reason", F.lit("retained")).alias("outcome"), "label").agg(F.count("*").alias("n"))


@query(_first_call_sql(2))
def first_call_v2(spark, sf_dir):
    return classify.first_call(cumulative(spark, sf_dir), 2).groupBy(F.coalesce("reason", F.lit("retained")).alias("outcome"), "label").agg(F.count("*").alias("n"))


@query(f"""
WITH {_TRACE},
r AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'invalid_cumulative_target_boundary' WHEN len(names) = 0 THEN 'no_call_without_positive_completion' WHEN len(cats) <> 1 THEN 'mixed_target_categories'
  WHEN coalesce(task, '') = '' THEN 'missing_initial_user_task' WHEN coalesce(open_before, false) THEN 'unresolved_prefix_tool_call' END AS reason FROM kinds),
z AS (SELECT *, {bucket_sql(S.SPLIT_SEED_3WAY, "sha256(" + normal_sql("task") + ")")} AS b FROM r),
l AS (SELECT conv_id, string_agg(concat('"', label, '":', n), ',' ORDER BY label) AS j FROM (SELECT conv_id, cats[1] AS label, count(*) AS n FROM r WHERE reason IS NULL GROUP BY ALL) GROUP BY 1),
rs AS (SELECT conv_id, string_agg(concat('"', reason, '":', n), ',' ORDER BY reason) AS j FROM (SELECT conv_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT sha256(CAST(z.conv_id AS VARCHAR)) AS source_trajectory_sha256, count(*) FILTER (reason IS NULL) AS retained, count(*) FILTER (reason IS NOT NULL) AS excluded, concat('{{', coalesce(any_value(l.j), ''), '}}') AS by_label, concat('{{', coalesce(any_value(rs.j), ''), '}}') AS by_reason,
  arg_min(CASE WHEN coalesce(task, '') = '' THEN 'unknown' WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'dev' ELSE 'test' END, turn) AS split FROM z LEFT JOIN l USING (conv_id) LEFT JOIN rs USING (conv_id) GROUP BY z.conv_id
""")
def trajectory_audit(spark, sf_dir):
    """Per trajectory: kept and excluded rows with their counts by label and reason."""
    a = classify.trajectory_audit(classify.whole_turn(cumulative(spark, sf_dir)))
    return a.withColumns({"by_label": F.to_json("by_label"), "by_reason": F.to_json("by_reason")})


def tagged_rows(spark, sf_dir):
    """Tagged conversations made from conversations: call and response wrappers round each exchange."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("k", F.expr("conv_id * 5 + turn"))
    name = F.element_at(F.array(*[F.lit(t) for t in S.TOOLSET]), (F.col("conv_id") % 6 + 1).cast("int"))
    wrong = F.when(F.col("k") % 13 == 0, F.lit("other")).otherwise(name)
    value = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>x</think><tool_call>{\"name\": \""), name, F.lit("\"}</tool_call>"))).otherwise(F.concat(F.lit("<tool_response>{\"name\": \""), wrong, F.lit("\"}</tool_response>")))
    turn = F.struct("turn", F.struct(F.when(F.col("role") == "assistant", "gpt").otherwise("tool").alias("from"), value.alias("value")).alias("m"))
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("task"), F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["m"]).alias("conversations")).withColumn("id", F.col("conv_id").cast("string"))


@query("""
WITH c AS (SELECT *, conv_id * 5 + turn AS k FROM conversations WHERE role <> 'system'), o AS (SELECT *, lag(role) OVER w AS r1, lag(role, 2) OVER w AS r2, lag(k) OVER w AS k1 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CASE WHEN k1 % 13 = 0 THEN 'linkage' ELSE 'kept' END AS outcome, count(*) AS n FROM o WHERE role = 'assistant' AND r1 <> 'assistant' AND r2 = 'assistant' GROUP BY 1
""")
def tagged_candidates(spark, sf_dir):
    d = tagged.candidates(tagged_rows(spark, sf_dir), need_both=True)
    return d.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


_TAGGED = """
c AS (SELECT *, conv_id * 5 + turn AS k, [{tools}][conv_id % 6 + 1] AS name FROM conversations WHERE role <> 'system'),
o AS (SELECT conv_id, turn, role, name, k, lag(role) OVER w AS r1, lag(role, 2) OVER w AS r2, lag(k) OVER w AS k1, row_number() OVER w - 1 AS i, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS task FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, CAST(CAST(concat('0x', substr(sha256(concat('{seed}', chr(10), {task})), 1, 16)) AS UBIGINT) % 10000 AS INTEGER) AS b FROM o)""".format(tools=", ".join(f"'{t}'" for t in S.TOOLSET), seed=S.SPLIT_SEED_4WAY, task=template_sql("task"))


@query(f"""
WITH {_TAGGED}, k AS (SELECT *, concat('<tool_call>{{"name": "', name, '"}}</tool_call>') AS call, concat('<tool_response>{{"name": "', CASE WHEN k1 % 13 = 0 THEN 'other' ELSE name END, '"}}</tool_response>') AS answer FROM b WHERE b < 8000 AND role = 'assistant' AND r1 <> 'assistant' AND r2 = 'assistant')
SELECT CAST(conv_id AS VARCHAR) AS id, CAST(i AS INTEGER) AS i, CASE WHEN b < 7000 THEN 'train' ELSE 'development' END AS split, sha256(concat('Task:', chr(10), task, chr(10), 'Available tools: {", ".join(S.TOOLSET)}', chr(10), 'Previous assistant call:', chr(10), call, chr(10), 'Latest tool response:', chr(10), answer)) AS digest FROM k
""")
def tagged_states(spark, sf_dir):
    """State texts of the candidates of two splits; the others are dropped before their values are parsed."""
    d = tagged.candidates(tagged_rows(spark, sf_dir), need_both=False, splits=["train", "development"])
    return d.select("id", "i", "split", F.sha2("state", 256).alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 1")
def exact_toolset(spark, sf_dir):
    """Rows whose tool definitions, in either of two shapes and any order, name exactly the six tools; some lack one or have one more."""
    plain = [json.dumps([{"name": t} for t in S.TOOLSET]), json.dumps([{"function": {"name": t}} for t in reversed(S.TOOLSET)])]
    wrong = json.dumps([{"name": t} for t in [*S.TOOLSET, "other"]])
    missing = json.dumps([{"name": t} for t in S.TOOLSET[1:]])
    by = F.col("doc_id")
    tools = F.when(by % 4 == 1, wrong).when(by % 3 != 0, missing).when(by % 2 == 0, plain[0]).otherwise(plain[1])
    return tagged.exact_toolset(table(spark, sf_dir, "documents").select("doc_id", tools.alias("tools"))).select("doc_id")


_ODD_NAMES = ["Bash", "run_command", "read_file", "Glob", "web_fetch", "browser", "mystery", ""]
_ARGUMENTS = ["", "  ", "{}", "[]", "null", "None", "{ }", "x"]


@query(f"SELECT name, argument, CASE WHEN regexp_matches(name, '(?i)bash|shell|terminal|exec|command') THEN 'shell' WHEN regexp_matches(name, '(?i)read|write|edit|file|glob|grep|search') THEN 'file' WHEN regexp_matches(name, '(?i)web|browser|fetch|http') THEN 'web' ELSE 'other' END AS family, argument IS NULL OR trim(argument, ' ') IN ('', '{{}}', '[]', 'null', 'None') AS empty FROM (SELECT unnest({_ODD_NAMES}) AS name) CROSS JOIN (SELECT unnest({_ARGUMENTS} || [NULL]) AS argument) UNION ALL SELECT DISTINCT event_type, '{{}}', 'other', true FROM events")
def call_shapes(spark, sf_dir):
    """Families of tool names, and whether arguments are empty."""
    rows = spark.createDataFrame([(n, a) for n in _ODD_NAMES for a in [*_ARGUMENTS, None]], "name string, argument string")
    rows = rows.union(table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", F.lit("{}")))
    return rows.select("name", "argument", text.tool_family(F.col("name")).alias("family"), text.empty_argument(F.col("argument")).alias("empty"))


@query("""
SELECT doc_id, array_to_string(CASE WHEN doc_id % 11 = 0 THEN ['q:instructions'] ELSE list_filter([CASE WHEN doc_id % 5 = 0 THEN 'q:probability_keys' WHEN doc_id % 7 = 0 THEN 'q:probability_sum' END, CASE WHEN doc_id % 13 = 0 THEN 'q:label' END], lambda x: x IS NOT NULL) END, ',') AS reasons FROM documents
""")
def record_validation(spark, sf_dir):
    """A record for each document and the rules that it breaks; key order matters, so they are texts."""
    by = lambda m, yes, no: F.when(F.col("doc_id") % m == 0, yes).otherwise(no)
    question = F.concat(F.lit('{"q": {"type": "choice", "instructions": "'), by(11, " ", "i"), F.lit('", "criteria": {"a": "x", "b": "y"}}}'))
    shares = by(5, '{"b": 0.75, "a": 0.25}', by(7, '{"a": 0.25, "b": 0.65}', F.lit('{"a": 0.25, "b": 0.75}')))
    gold = F.concat(F.lit('{"q": {"type": "choice", "label": '), by(13, '"z"', "null"), F.lit(', "probabilities": '), shares, F.lit("}}"))
    record = F.concat(F.lit('{"state": '), F.to_json(F.array("source")), F.lit(', "questions": '), question, F.lit(', "gold": '), gold, F.lit("}"))
    d = table(spark, sf_dir, "documents").select("doc_id", record.alias("record"))
    return d.select("doc_id", F.array_join(records.record_reasons("record"), ",").alias("reasons"))


@query("""SELECT event_id, sha256(concat('{"k":', json_extract_string(props, '$.k'), ',"t":"', event_type, '","\\u00e9":[1.5,null]}')) AS digest FROM events""")
def canonical_digests(spark, sf_dir):
    """The digest of each event's properties, with its type and a key that isn't ASCII, as canonical JSON."""
    text_of = F.concat(F.lit('{"t": "'), "event_type", F.lit('", "\u00e9" : [1.5, null], "k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", text_of.alias("j")).select("event_id", hashing.canonical_digest("j").alias("digest"))


def _messages_sql(policy: int) -> tuple[str, str, str]:
    """The two results before a turn's text, and its own message, rendered, from conversations with k and names as in ``_TRACE``."""
    limit = S.MAX_MESSAGE_CHARS if policy == 1 else S.MAX_RENDERED_CHARS
    call = "concat('TOOL_CALL {\"arguments\":\"{}\",\"id\":\"c', turn, i, '\",\"name\":\"', n, '\"}')"
    calls = f"list_transform(list_zip(names, ['a', 'b'][1:len(names)]), lambda p: {call.replace(', i,', ', p[2],').replace(', n,', ', p[1],')})"
    own = f"concat('[', upper(role), ']', chr(10), coalesce(nullif(array_to_string(list_concat(CASE WHEN coalesce(text, '') = '' THEN [] ELSE [{bounded_sql('text', limit)}] END, {calls}), chr(10)), ''), '[EMPTY]'))"
    first = "concat('[TOOL]', chr(10), 'name=grep', chr(10), 'TOOL_RESULT id=c', turn - 1, 'a', chr(10), 'ok')" if policy == 1 else "concat('[TOOL]', chr(10), 'TOOL_RESULT id=c', turn - 1, 'a', chr(10), 'name=grep', chr(10), 'ok')"
    return first, "concat('[TOOL]', chr(10), 'TOOL_RESULT id=c', turn - 1, 'b', chr(10), 'ok')", own


def _rendered_sql(policy: int) -> str:
    first, second, own = _messages_sql(policy)
    return f"concat(CASE WHEN answers THEN concat({first}, chr(10), chr(10), {second}, chr(10), chr(10)) ELSE '' END, {own})"


@query(f"WITH {_TRACE.split('y AS')[0].rstrip().rstrip(',')} SELECT conv_id, turn, sha256({_rendered_sql(1)}) AS first_policy, sha256({_rendered_sql(2)}) AS second_policy FROM x")
def render_full(spark, sf_dir):
    """Each turn's messages with names, results, content and calls, in the orders of both policies."""
    joined = lambda policy: F.sha2(F.array_join(F.transform("ms", lambda m: render.message(m, policy)), "\n\n"), 256)
    return exchanges(spark, sf_dir).select("conv_id", "turn", joined(1).alias("first_policy"), joined(2).alias("second_policy"))


def messages(spark, sf_dir):
    """The messages of ``exchanges`` one by one: conv, i (place in the conversation, from 0), m."""
    one = exchanges(spark, sf_dir).select(F.col("conv_id").alias("conv"), "turn", F.posexplode("ms").alias("at", "m"))
    return one.withColumn("i", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "at")) - 1).select("conv", "i", "m")


def _budget_sql(room: int) -> str:
    first, second, own = _messages_sql(2)
    words = lambda c: f"len(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))"
    head = lambda task, system, seen: "concat('TASK', chr(10), " + task + ", chr(10), chr(10), 'SYSTEM CONSTRAINTS', chr(10), " + system + f", chr(10), chr(10), 'AVAILABLE ACTIONS', chr(10), '{', '.join(S.ONTOLOGY)}', chr(10), chr(10), 'LATEST RELEVANT OBSERVATION', chr(10), " + seen + ", chr(10), chr(10), 'RECENT HISTORY', chr(10))"
    cut = head(*[bounded_sql(c, limit) for c, limit in (("task_text", "l_task"), ("system_text", "l_system"), ("seen_text", "l_seen"))])
    # Limits fall by 400 in turn: 8 times to 100, 17 times to 300, 15 times to 300.
    return f"""
WITH {_TRACE.split("y AS")[0].rstrip().rstrip(",")},
p AS (SELECT conv_id, role, content, shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn, o) - 1 AS i FROM (
  SELECT conv_id, turn, 0 AS o, 'tool' AS role, 'ok' AS content, {first} AS shown FROM x WHERE answers UNION ALL SELECT conv_id, turn, 1, 'tool', 'ok', {second} FROM x WHERE answers
  UNION ALL SELECT conv_id, turn, 2, role, coalesce(text, ''), {own} FROM x)),
g AS (SELECT t.conv_id, t.i, min(p.i) FILTER (p.role = 'user') AS task, min(p.i) FILTER (p.role = 'system') AS system, max(p.i) FILTER (p.role = 'tool') AS tool
  FROM p t LEFT JOIN p ON p.conv_id = t.conv_id AND p.i < t.i WHERE t.role = 'assistant' GROUP BY ALL),
s AS (SELECT g.conv_id, g.i, g.task, coalesce(g.tool, (SELECT max(p.i) FROM p WHERE p.conv_id = g.conv_id AND p.i < g.i AND p.role <> 'system' AND p.i IS DISTINCT FROM g.task)) AS seen,
  coalesce(a.content, '') AS task_text, coalesce(b.content, '') AS system_text FROM g LEFT JOIN p a ON a.conv_id = g.conv_id AND a.i = g.task LEFT JOIN p b ON b.conv_id = g.conv_id AND b.i = g.system),
z AS (SELECT s.*, coalesce(p.shown, '[NO OBSERVATION]') AS seen_text FROM s LEFT JOIN p ON p.conv_id = s.conv_id AND p.i = s.seen),
l AS (SELECT *, greatest(100, 3000 - 400 * least(k, 8)) AS l_system, greatest(300, 7000 - 400 * greatest(0, least(k - 8, 17))) AS l_seen, greatest(300, 6000 - 400 * greatest(0, k - 25)) AS l_task FROM z, (SELECT unnest(range(41)) AS k)),
h AS (SELECT *, {cut} AS head FROM l),
f AS (SELECT conv_id, i, task, seen, min(k) FILTER ({words("head")} + 5 <= {room}) AS k, arg_min(head, k) AS whole FROM h GROUP BY ALL),
b AS (SELECT f.*, h.head, {words("h.head")} AS base FROM f LEFT JOIN h ON h.conv_id = f.conv_id AND h.i = f.i AND h.k = f.k),
cand AS (SELECT b.conv_id, b.i, p.i AS j, p.shown, b.base + sum({words("p.shown")}) OVER (PARTITION BY b.conv_id, b.i ORDER BY p.i DESC) AS tokens
  FROM b JOIN p ON p.conv_id = b.conv_id AND p.i < b.i AND p.role <> 'system' AND p.i IS DISTINCT FROM b.task AND p.i IS DISTINCT FROM b.seen),
d AS (SELECT conv_id, i, count(*) AS candidates, count(*) FILTER (tokens <= {room}) AS kept, string_agg(shown, chr(10) || chr(10) ORDER BY j) FILTER (tokens <= {room}) AS history, CAST(sum({words("shown")}) AS BIGINT) AS total FROM cand GROUP BY ALL)
SELECT b.conv_id, CAST(b.i AS BIGINT) AS i, CAST(b.seen AS BIGINT) AS observation, CASE WHEN b.k IS NOT NULL THEN CAST(coalesce(d.kept, 0) AS BIGINT) END AS kept, CASE WHEN b.k IS NOT NULL THEN CAST(coalesce(d.candidates - d.kept, 0) AS BIGINT) END AS omitted,
  CAST({S.ENVELOPE_TOKENS} + {words("b.whole")} + coalesce(d.total, 5) AS BIGINT) AS pre_policy_tokens, sha256(concat(b.head, coalesce(d.history, '[NO ADDITIONAL HISTORY]'))) AS digest
FROM b LEFT JOIN d ON d.conv_id = b.conv_id AND d.i = b.i"""


@query(_budget_sql(token_budget.ROOM))
def token_budget_states(spark, sf_dir):
    """The state of every target under the smallest budget, with what it kept and left out; each message is tokenized once."""
    s = token_budget.states(messages(spark, sf_dir))
    return s.select(F.col("conv").alias("conv_id"), "i", "observation", F.size("kept").cast("long").alias("kept"), "omitted", "pre_policy_tokens", F.sha2("state", 256).alias("digest"))


@query("SELECT CAST(count(*) AS BIGINT) AS reservations, round(sum(greatest(o_totalprice / 1000, CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 1000 ELSE o_totalprice / 900 END)), 6) AS charged FROM orders")
def budget_charge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ledger = o.select(F.col("o_orderkey").alias("token"), (F.col("o_totalprice") / 1000).alias("reserved_seconds"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") / 900).alias("actual_seconds"))
    return records.ledger_charge(ledger)
