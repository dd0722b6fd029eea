"""Queries of verifiers, gates and contracts on the driver's tables, with some rows made to break each rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import hashing, text
from tracemill.operators import classify, contracts, gates, neardup, prefixes, sequence, token_budget
from tracemill.operators.shared import stored
from tracemill.plans import profiles, traces
from tracemill.plans.evaluation import _P, predictions
from tracemill.plans.fixtures import _TRACE, cumulative, messages
from tracemill.plans.registry import SQL, query, table
from tracemill.sources import shards

_SOURCES = f"""
{traces._GROUPS.lstrip().rstrip()}, x AS (SELECT task_group, {traces._SPLIT} AS split, conv_id FROM s),
w AS (SELECT conv_id, turn, role, text, conv_id * 7 + turn * 3 AS k, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prefix FROM conversations),
a AS (SELECT w.*, task_group, split, concat('id-', conv_id, '-', turn) AS id, conv_id * 1000 + turn AS line, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM w JOIN x USING (conv_id) WHERE role = 'assistant'),
r AS (SELECT CASE WHEN k % 37 = 0 THEN 'id-same' ELSE id END AS id, CAST(conv_id AS VARCHAR) AS trajectory, task_group, turn AS step, line + CASE WHEN k % 29 = 0 THEN 1000000000 ELSE 0 END AS line, CASE WHEN k % 41 = 0 THEN 'dev' ELSE split END AS split,
  CASE WHEN k % 17 = 0 THEN concat(prefix, text) WHEN k % 31 = 0 THEN concat(prefix, id) ELSE prefix END AS state, CASE WHEN k % 19 = 0 THEN 'none' ELSE label END AS label, text, prefix, label AS s_label, split AS old, k FROM a),
f AS (SELECT * FROM r WHERE k % 29 <> 0)"""


def _sources(spark, sf_dir):
    """Assistant turns as source lines: state and prefix are the text before them."""
    c = table(spark, sf_dir, "conversations")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    a = c.withColumns({"k": F.expr("conv_id * 7 + turn * 3"), "prefix": before}).where("role = 'assistant'").join(traces.grouped(c), "conv_id")
    even = F.when(F.char_length("text") % 2 == 0, "even").otherwise("odd")
    return a.select("conv_id", "k", "task_group", "split", "prefix", "text", F.col("turn").alias("step"), F.concat(F.lit("id-"), "conv_id", F.lit("-"), "turn").alias("id"), F.expr("conv_id * 1000 + turn").alias("line"), even.alias("label"))


@query(f"""
WITH {_SOURCES},
n AS (SELECT 'ids_repeat' AS name, count(*) AS n FROM (SELECT id FROM r GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'metadata_missing', count(*) FROM r WHERE id IS NULL OR trajectory IS NULL OR task_group IS NULL OR step IS NULL
UNION ALL SELECT 'trajectories_cross', count(*) FROM (SELECT trajectory FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'trajectories_of_several_groups', count(*) FROM (SELECT trajectory FROM r GROUP BY 1 HAVING count(DISTINCT task_group) > 1)
UNION ALL SELECT 'groups_cross', count(*) FROM (SELECT task_group FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'states_cross', count(*) FROM (SELECT state FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'source_missing', count(*) FROM r WHERE k % 29 = 0
UNION ALL SELECT 'label_differs', count(*) FROM f WHERE label <> s_label
UNION ALL SELECT 'state_differs', count(*) FROM f WHERE state <> prefix
UNION ALL SELECT 'split_differs', count(*) FROM r WHERE split <> old
UNION ALL SELECT 'metadata_in_state', count(*) FROM r WHERE contains(state, id) OR contains(state, trajectory) OR contains(state, task_group)
UNION ALL SELECT 'target_in_state', count(*) FROM f WHERE length(text) >= 24 AND NOT contains(prefix, text) AND contains(state, text))
SELECT name, n = 0 AS passed, n FROM n
""")
def verified_records(spark, sf_dir):
    """The rules of a verified set, each broken by some rows."""
    s = _sources(spark, sf_dir)
    broken = lambda m: F.col("k") % m == 0
    r = s.select(
        F.when(broken(37), "id-same").otherwise(F.col("id")).alias("id"), F.col("conv_id").cast("string").alias("trajectory"), "task_group", "step", (F.col("line") + F.when(broken(29), 1_000_000_000).otherwise(0)).alias("line"),
        F.when(broken(41), "dev").otherwise(F.col("split")).alias("split"), F.when(broken(17), F.concat("prefix", "text")).when(broken(31), F.concat("prefix", "id")).otherwise(F.col("prefix")).alias("state"), F.when(broken(19), "none").otherwise(F.col("label")).alias("label"),
    )
    sources = s.select("line", "label", F.col("prefix").alias("state"), "prefix", F.array("text").alias("strings"))
    assigned = s.select(F.col("conv_id").cast("string").alias("trajectory"), "step", "split")
    return gates.checks(gates.verified_records(r, sources, assigned))


_TOOLS_SQL = "[" + ", ".join(f"'{t}'" for t in S.TOOLSET) + "]"
_RETAINED = f"""
{traces._GROUPS.lstrip().rstrip()}, x AS (SELECT task_group, {traces._SPLIT} AS split, conv_id FROM s),
u AS (SELECT c.conv_id, task_group, split, text AS state, {_TOOLS_SQL}[(conv_id * 7 + turn * 3) % 6 + 1] AS tool, length(text) > 150 AS over, turn > 0 AS linked, sha256(text) AS key FROM conversations c JOIN x USING (conv_id) WHERE role = 'user'),
cells AS (SELECT split, tool FROM (SELECT unnest(['train', 'dev', 'test']) AS split) CROSS JOIN (SELECT unnest({_TOOLS_SQL}) AS tool)),
tot AS (SELECT split, count(*) AS n, count(*) FILTER (over) AS n_over FROM u GROUP BY 1),
mem AS (SELECT split, tool, count(DISTINCT conv_id) AS positive, count(*) AS m, count(*) FILTER (over) AS m_over FROM u GROUP BY ALL),
cell AS (SELECT split, tool, coalesce(positive, 0) AS positive, abs(coalesce(m_over / nullif(m, 0), 0) - coalesce((n_over - coalesce(m_over, 0)) / nullif(n - coalesce(m, 0), 0), 0)) AS gap FROM cells LEFT JOIN mem USING (split, tool) LEFT JOIN tot USING (split)),
rate AS (SELECT max(coalesce(n_over / nullif(n, 0), 0)) - min(coalesce(n_over / nullif(n, 0), 0)) AS g FROM (SELECT DISTINCT split FROM cells) LEFT JOIN tot USING (split))"""


@query(f"""
WITH {_RETAINED},
n AS (SELECT 'source_checksum' AS name, 0 AS n UNION ALL SELECT 'canary_invariance', 0
UNION ALL SELECT 'zero_residual_reasoning_markers', count(*) FROM u WHERE regexp_matches(state, '{S.REASONING_MARKER}')
UNION ALL SELECT 'complete_linkage', count(*) FROM u WHERE NOT linked
UNION ALL SELECT 'valid_retained_labels', 0 UNION ALL SELECT 'no_truncation', count(*) FROM u WHERE over
UNION ALL SELECT 'exact_representation_unique', count(*) FROM (SELECT key FROM u GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'trajectory_split_isolation', count(*) FROM (SELECT conv_id FROM u GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'proxy_group_split_isolation', count(*) FROM (SELECT task_group FROM u GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'minimum_positive_trajectory_support', count(*) FROM cell WHERE positive < 10
UNION ALL SELECT 'split_over_budget_difference', count(*) FROM rate WHERE g > 0.10
UNION ALL SELECT 'label_over_budget_difference', count(*) FROM cell WHERE gap > 0.20)
SELECT name, n = 0 AS passed, CAST(n AS BIGINT) AS n FROM n UNION ALL SELECT 'all', bool_and(n = 0), count(*) FILTER (n > 0) FROM n
""")
def retained_gates(spark, sf_dir):
    """The gates of a retained set on user turns, each with a tool by its place."""
    c = table(spark, sf_dir, "conversations")
    tool = F.element_at(F.array(*[F.lit(t) for t in S.TOOLSET]), (F.expr("conv_id * 7 + turn * 3") % 6 + 1).cast("int"))
    over = F.char_length("text") > 150
    u = c.where("role = 'user'").join(traces.grouped(c), "conv_id")
    u = u.select(F.col("conv_id").alias("trajectory"), F.col("task_group").alias("proxy_group"), "split", F.array(tool).alias("labels"), F.col("text").alias("state"), (~over).alias("fits"), over.alias("over"), (F.col("turn") > 0).alias("linked"), F.sha2("text", 256).alias("key"))
    return gates.retained_gates(u, ["train", "dev", "test"], S.TOOLSET, {"source_checksum": True, "canary_invariance": True})


@query("""
WITH g AS (SELECT count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (role = 'user' AND coalesce(text, '') <> '') AS seen FROM conversations),
n AS (SELECT 'minimum_train_rows' AS name, users >= 1500 AS passed FROM g UNION ALL SELECT 'minimum_val_rows', assistants >= 300 FROM g UNION ALL SELECT 'observable_history', seen / nullif(users, 0) >= 0.5 FROM g
UNION ALL SELECT 'trajectory_disjoint', count(*) = 0 FROM (SELECT conv_id FROM conversations WHERE role = 'user' INTERSECT SELECT conv_id FROM conversations WHERE role = 'tool'))
SELECT name, passed FROM n UNION ALL SELECT 'all', bool_and(passed) FROM n
""")
def viability_gates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    g = c.agg(F.count_if(F.expr("role = 'user'")).alias("users"), F.count_if(F.expr("role = 'assistant'")).alias("assistants"), F.count_if(F.expr("role = 'user' and coalesce(text, '') <> ''")).alias("seen"))
    rows = {"minimum_train_rows": F.col("users") >= 1500, "minimum_val_rows": F.col("assistants") >= 300, "observable_history": F.try_divide("seen", "users") >= 0.5}
    own = g.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), p.alias("passed")) for n, p in rows.items()])).alias("x")).select("x.*")
    both = c.where("role = 'user'").select("conv_id").intersect(c.where("role = 'tool'").select("conv_id"))
    own = own.union(gates.checks({"trajectory_disjoint": both}).select("name", "passed"))
    return own.union(own.agg(F.lit("all").alias("name"), F.bool_and("passed").alias("passed")))


_TURNS = """
m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
h AS (SELECT *, sha256(concat(i, ':', role, chr(10), coalesce(text, ''))) AS h FROM m),
p AS (SELECT conv_id, i, role, text, count(*) OVER w AS n, coalesce(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)) OVER w, 0) AS one, coalesce(sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)) OVER w, 0) AS two
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT conv_id, i, role, text, n AS n_before, sha256(concat(n, ':', one, ':', two)) AS prefix FROM p)"""


def _turns(spark, sf_dir):
    """conv_id, i (place from 0), role, text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", place.alias("i"), "role", "text")


def _prefixes(spark, sf_dir):
    return prefixes.digests(_turns(spark, sf_dir), F.concat("role", F.lit("\n"), F.coalesce("text", F.lit(""))), conv="conv_id", block=64)


@query(f"WITH {_TURNS} SELECT conv_id, CAST(i AS INTEGER) AS i, n_before, prefix FROM d WHERE role = 'assistant'")
def prefix_digests(spark, sf_dir):
    """The digest of all that stands before each target, from sums."""
    return _prefixes(spark, sf_dir).where("role = 'assistant'").select("conv_id", "i", "n_before", "prefix")


@query(f"""
WITH {_TURNS}, t AS (SELECT prefix, sha256(coalesce(text, '')) AS label FROM d WHERE role = 'assistant'), g AS (SELECT prefix, count(*) AS n, count(DISTINCT label) AS labels FROM t GROUP BY prefix)
SELECT count(*) AS states, count(*) FILTER (n > 1) AS repeated, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus, count(*) FILTER (labels > 1) AS conflicts FROM g
""")
def duplicate_states(spark, sf_dir):
    """Targets that come after equal prefixes, of any conversation, and those of them that differ."""
    t = _prefixes(spark, sf_dir).where("role = 'assistant'").select("prefix", F.sha2(F.coalesce("text", F.lit("")), 256).alias("label"))
    g = t.groupBy("prefix").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))
    return g.agg(F.count("*").alias("states"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"), F.count_if(F.col("labels") > 1).alias("conflicts"))


@query("""
WITH n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations WHERE role = 'assistant')
SELECT maker, n AS targets, CASE WHEN maker = 'peeking' THEN n ELSE 0 END AS noticed, CASE WHEN maker = 'peeking' THEN n ELSE 0 END AS holding FROM n, (SELECT unnest(['token_budget', 'prefix_digest', 'peeking']) AS maker)
""")
def target_canary(spark, sf_dir):
    """A target of each conversation swapped for a canary: neither the state nor the prefix digest may notice or hold it; one that peeks must be caught."""
    canary = "CANARY-7f3a"
    before = prefixes.cut_at_one_target(messages(spark, sf_dir).withColumn("role", F.col("m.role")))
    before = stored(before.drop("role"))
    after = before.withColumn("m", F.when(F.col("i") == F.col("target"), F.col("m").withField("content", F.lit(canary))).otherwise(F.col("m")))

    def made(rows):
        at = rows.where("i = target").select(F.col("conv").alias("c"), F.col("target").alias("t"))
        own = lambda df: df.join(at, (F.col("conv") == F.col("c")) & (F.col("i") == F.col("t")))
        state = own(token_budget.states(rows)).select("conv", F.lit("token_budget").alias("maker"), F.coalesce("state", F.lit("")).alias("made"))
        digest = own(prefixes.digests(rows.drop("target"), F.to_json("m"))).select("conv", F.lit("prefix_digest").alias("maker"), F.col("prefix").alias("made"))
        peek = rows.groupBy("conv").agg(F.lit("peeking").alias("maker"), F.array_join(F.array_sort(F.collect_set("m.content")), "\n").alias("made"))
        return state.union(digest).union(peek)

    both = made(before).join(made(after).withColumnRenamed("made", "again"), ["conv", "maker"])
    return both.groupBy("maker").agg(F.count("*").alias("targets"), F.count_if(F.col("made") != F.col("again")).alias("noticed"), F.count_if(F.contains("again", F.lit(canary))).alias("holding"))


@query("SELECT true AS same_digest, (SELECT count(*) FROM documents) AS n")
def rerun_digest(spark, sf_dir):
    """A derived table made twice, in other partitions: rows and digest must agree."""
    make = lambda d: d.select("doc_id", hashing.bucket(S.SPLIT_SEED_3WAY, F.sha2("text", 256)).alias("b"), text.bounded(F.col("text"), 400).alias("t"))
    d = table(spark, sf_dir, "documents")
    a, b = gates.table_digest(make(d)), gates.table_digest(make(d.repartition(7))).withColumnsRenamed({"n": "m", "digest": "other"})
    return a.crossJoin(b).select(F.expr("n = m and digest = other").alias("same_digest"), "n")  # one row each


@query("SELECT doc_id, sha256(concat(text, chr(30), lang)) AS digest, false AS changed FROM documents")
def metadata_invariance(spark, sf_dir):
    """What a model sees of each document, before and after its metadata is another."""
    d = table(spark, sf_dir, "documents")
    other = d.withColumn("source", F.concat(F.lit("changed-"), "source"))
    digest = lambda f: f.select("doc_id", contracts.model_digest(F.col("text"), F.col("lang")).alias("digest"))
    return digest(d).join(digest(other).withColumnRenamed("digest", "other"), "doc_id").select("doc_id", "digest", (F.col("digest") != F.col("other")).alias("changed"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def source_semi_join(spark, sf_dir):
    """Source rows whose key was retained."""
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    source = table(spark, sf_dir, "lineitem")
    return source.join(kept, source["l_orderkey"] == kept["o_orderkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS records, count(o_orderkey) AS found, count(*) - count(o_orderkey) AS missing FROM (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS line FROM lineitem) LEFT JOIN orders ON o_orderkey = line")
def record_source_join(spark, sf_dir):
    """Records and their source lines; some name a line that isn't there."""
    r = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 100_000_000).otherwise(0)).alias("line"))
    j = r.join(table(spark, sf_dir, "orders"), F.col("line") == F.col("o_orderkey"), "left")
    return j.agg(F.count("*").alias("records"), F.count("o_orderkey").alias("found"), F.count_if(F.col("o_orderkey").isNull()).alias("missing"))


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(coalesce(sum(a.n * b.n), 0) AS BIGINT) AS comparisons FROM n a JOIN n b ON a.source < b.source")
def comparison_count(spark, sf_dir):
    return neardup.comparisons(table(spark, sf_dir, "documents"), "source")


@query(f"SELECT left_id, right_id FROM ({SQL['near_duplicate_cross_split']}) ORDER BY left_id, right_id LIMIT 100")
def first_near_duplicates(spark, sf_dir):
    """The first hundred pairs, as a report shows them."""
    return neardup.first_pairs(profiles.word_sets(spark, sf_dir), "doc_id", "split", "tokens", 85, 100)


_SPAN = "string_split(coalesce(text, ''), ' ')"


@query(f"""
WITH n AS (SELECT conv_id, turn, list_filter(list_distinct({_SPAN}[1:2]), lambda x: x <> '') AS calls, list_distinct({_SPAN}) AS results, list_filter(list_distinct({_SPAN}[1:5]), lambda x: x <> '') AS a, {_SPAN}[6:10] AS b FROM conversations),
o AS (SELECT *, lead(results) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM n)
SELECT conv_id, turn, CAST(len(list_intersect(a, b)) AS INTEGER) AS same_span, CAST(len(calls) AS INTEGER) AS call_ids, CASE WHEN nxt IS NOT NULL THEN CAST(len(list_intersect(calls, nxt)) AS INTEGER) END AS matched_next, CASE WHEN nxt IS NOT NULL THEN len(calls) > 0 AND list_has_all(nxt, calls) END AS covered FROM o
""")
def span_coverage(spark, sf_dir):
    """Ids of a span's calls among its own results and the next span's; covered if all are."""
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    n = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_remove(F.array_distinct(F.slice(words, 1, 2)), "").alias("calls"), F.array_distinct(words).alias("results"), F.slice(words, 1, 5).alias("a"), F.slice(words, 6, 5).alias("b"))
    return sequence.covered_spans(n, "conv_id", "turn", "calls", "results").select("conv_id", "turn", F.size(sequence.shared_ids(F.col("a"), F.col("b"))).alias("same_span"), F.size("calls").alias("call_ids"), "matched_next", "covered")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
t AS (SELECT * FROM e WHERE user_id % 2 = 0), k AS (SELECT DISTINCT event_type FROM t),
c AS (SELECT prev, event_type, count(*) AS n FROM t WHERE prev IS NOT NULL AND prev <> 'signup' GROUP BY ALL), m AS (SELECT prev, sum(n) AS total FROM c GROUP BY 1),
f AS (SELECT event_type, count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY 1)
SELECT event_id, round(CASE WHEN m.total IS NULL THEN f.p ELSE (coalesce(n, 0) + 1) / (m.total + (SELECT count(*) FROM k)) END, 6) AS p FROM e JOIN f USING (event_type) LEFT JOIN m ON m.prev = e.prev LEFT JOIN c ON c.prev = e.prev AND c.event_type = e.event_type WHERE user_id % 2 = 1
""")
def transition_lookup(spark, sf_dir):
    """The probability of each event after the one before it; types that the model lacks, and first events, take the fallback."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("prev"))
    train = e.where("user_id % 2 = 0")
    model = sequence.smoothed(train.where("prev is not null and prev <> 'signup'"), "prev", "event_type", train.select("event_type").distinct())
    prior = train.groupBy("event_type").agg(F.count("*").alias("n"))
    fallback = prior.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).select("event_type", "p")  # one row a type
    return sequence.looked_up(e.where("user_id % 2 = 1"), model, fallback, "prev", "event_type").select("event_id", F.round("p", 6).alias("p"))


@query(f"""
WITH {_P}, q AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 THEN list_transform(p, lambda x: x * 1.01) WHEN vec_id % 13 = 0 THEN list_transform(p, lambda x: x - 0.2) ELSE p END AS v FROM p)
SELECT vec_id, array_to_string(list_filter([CASE WHEN vec_id % 17 = 0 THEN 'gold_label' END, CASE WHEN vec_id % 19 = 0 THEN 'label_order' END, CASE WHEN list_min(v) < 0 THEN 'values' END, CASE WHEN abs(list_sum(v) - 1) > 2e-6 THEN 'sum' END], lambda x: x IS NOT NULL), ',') AS metric,
  array_to_string(list_filter([CASE WHEN vec_id % 23 = 0 THEN 'model' END, CASE WHEN vec_id % 29 = 0 THEN 'elapsed' END, CASE WHEN list_min(v) < 0 OR list_max(v) > 1 THEN 'values' END, CASE WHEN abs(list_sum(v) - 1) > 1e-6 THEN 'sum' END], lambda x: x IS NOT NULL), ',') AS replay FROM q
""")
def prediction_contracts(spark, sf_dir):
    """What the metric and the replay contract find wrong with predictions, some of which are spoilt."""
    labels = [f"c{i}" for i in range(10)]
    by = lambda m: F.col("vec_id") % m == 0
    v = F.when(by(11), F.transform("p", lambda x: x * 1.01)).when(by(13), F.transform("p", lambda x: x - 0.2)).otherwise(F.col("p"))
    names = F.array(*[F.lit(x) for x in labels])
    d = predictions(spark, sf_dir).select(
        "vec_id", F.col("vec_id").cast("string").alias("record_id"), F.when(by(17), "other").otherwise(F.concat(F.lit("c"), "label")).alias("gold_label"), v.alias("values"), F.when(by(19), F.reverse(names)).otherwise(names).alias("names"),
        F.when(~by(23), "m").alias("model_id"), F.lit("r").alias("revision"), F.when(by(29), -1.0).otherwise(0.5).alias("elapsed_seconds"),
    )
    a = contracts.metric_reasons(d, labels).select("vec_id", F.array_join("reasons", ",").alias("metric"))
    return a.join(contracts.replay_reasons(d, labels).select("vec_id", F.array_join("reasons", ",").alias("replay")), "vec_id")


@query(f"WITH {_P}, r AS (SELECT vec_id, list_transform(p, lambda x: round(x, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 4 END)) AS v FROM p) SELECT vec_id, round(CASE WHEN abs(list_sum(v) - 1) <= 10 * 5e-5 + 1e-9 THEN list_max(v) / list_sum(v) END, 6) AS top FROM r")
def renormalized_probabilities(spark, sf_dir):
    """Rounded probabilities over their sum, null where rounding can't explain it."""
    r = predictions(spark, sf_dir).select("vec_id", F.transform("p", lambda x: F.when(F.col("vec_id") % 3 == 0, F.round(x, 1)).otherwise(F.round(x, 4))).alias("v"))
    return r.select("vec_id", F.round(F.array_max(contracts.renormalized(F.col("v"))), 6).alias("top"))


@query(f"""
WITH {_TRACE},
r AS (SELECT *, k % 23 = 0 AS outside, CASE WHEN len(names) > 0 AND len(cats) = 1 AND coalesce(task, '') <> '' AND NOT coalesce(open_before, false) THEN true ELSE false END AS kept FROM kinds)
SELECT conv_id, turn FROM r WHERE kept AND NOT outside AND conv_id % 9 = 0
""")
def split_immutability(spark, sf_dir):
    """Retained rows whose split is another than the one assigned before; the old assignment of every ninth conversation is spoilt."""
    d = cumulative(spark, sf_dir)
    new = classify.whole_turn(d).where("reason is null")
    old = new.select("source_trajectory_sha256", "assistant_step", F.when(F.col("conv_id") % 9 == 0, "held").otherwise(F.col("row_split")).alias("row_split"))
    changed = classify.changed_assignments(new, old)
    return new.join(changed, ["source_trajectory_sha256", "assistant_step"], "left_semi").select("conv_id", "turn")


_KINDS = ["choice", "score", "noul"]


@query(f"WITH q AS (SELECT doc_id, unnest([{', '.join(repr(k) for k in _KINDS)}][1:doc_id % 3 + 1]) AS kind FROM documents UNION ALL SELECT doc_id, 'choice' FROM documents WHERE doc_id % 5 = 0) SELECT kind, count(*) AS questions, count(DISTINCT doc_id) AS records FROM q GROUP BY 1")
def question_kinds(spark, sf_dir):
    """Questions of each type inside records' maps."""
    q = F.map_from_entries(F.concat(F.transform(F.slice(F.array(*[F.lit(k) for k in _KINDS]), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda k: F.struct(F.concat(F.lit("q-"), k), F.struct(k.alias("type")))), F.when(F.col("doc_id") % 5 == 0, F.array(F.struct(F.lit("again"), F.struct(F.lit("choice").alias("type"))))).otherwise(F.array().cast("array<struct<col1:string,col2:struct<type:string>>>"))))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.map_values(q)).alias("q"))
    return d.groupBy(F.col("q.type").alias("kind")).agg(F.count("*").alias("questions"), F.count_distinct("doc_id").alias("records"))


@query("SELECT event_id, row_number() OVER (ORDER BY coalesce(CASE WHEN event_id % 4 <> 0 THEN user_id END, -1), event_type, event_id) AS place FROM events")
def ledger_order(spark, sf_dir):
    """Places of ledger rows: by line, where none counts as -1, then reason."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("line"), F.col("event_type").alias("reason"))
    return sequence.numbered(e, [F.coalesce("line", F.lit(-1)), F.col("reason"), F.col("event_id")], "place").select("event_id", "place")


_LIKE = lambda names: " OR ".join(f"contains(lower(text), '{x}')" for x in names)


@query(f"SELECT source, count(*) FILTER ({_LIKE(S.FAILURE_LIKE)}) AS failure_like, count(*) FILTER ({_LIKE(S.SUCCESS_LIKE)}) AS success_like, count(*) FILTER (regexp_matches(concat('functions.', lang, ':', CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE CAST(doc_id AS VARCHAR) END), '{S.RESPONSE_ID}')) AS id_shapes, count(*) FILTER (regexp_matches(concat(source, CASE WHEN doc_id % 2 = 0 THEN '_result' ELSE '' END), '{S.OBSERVATION_KEY}')) AS observation_keys FROM documents GROUP BY source")
def response_detectors(spark, sf_dir):
    low = F.lower("text")
    like = lambda names: F.count_if(F.exists(F.array(*[F.lit(x) for x in names]), lambda x: F.contains(low, x)))
    shape = F.concat(F.lit("functions."), "lang", F.lit(":"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("doc_id").cast("string")))
    key = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "_result").otherwise(""))
    return table(spark, sf_dir, "documents").groupBy("source").agg(like(S.FAILURE_LIKE).alias("failure_like"), like(S.SUCCESS_LIKE).alias("success_like"), F.count_if(shape.rlike(S.RESPONSE_ID)).alias("id_shapes"), F.count_if(key.rlike(S.OBSERVATION_KEY)).alias("observation_keys"))


@query("SELECT 'orders.parquet' AS file, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders UNION ALL SELECT 'lineitem.parquet', count(*), count(DISTINCT l_orderkey) FROM lineitem")
def shard_sample(spark, sf_dir):
    """Chosen shards, each under its file's name."""
    named = lambda name, key: shards.read(spark, [f"{sf_dir}/{name}.parquet"]).groupBy("file").agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"))
    return named("orders", "o_orderkey").union(named("lineitem", "l_orderkey"))


@query("SELECT o_orderkey AS id, o_orderstatus AS label, o_custkey AS state FROM orders")
def strict_scan(spark, sf_dir):
    """Projected records; a repeated id, a null or an empty table is an error."""
    rows = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "label", "o_custkey": "state"})
    return shards.strict(rows, "id", ["id", "label", "state"])
