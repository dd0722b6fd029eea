"""Models and their evaluation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import text
from tracemill.operators import metrics, models
from tracemill.plans.registry import query, table

_LABELS = list(range(10))
#: Class probabilities of each embedding: the softmax of its first ten places, as doubles.
_P = """v AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
e AS (SELECT vec_id, label, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM v),
p AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""


def predictions(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("z"))
    return v.withColumn("p", text.softmax(F.col("z"))).withColumn("pred", (text.argmax(F.col("p")) - 1).cast("int"))


@query(f"WITH {_P}, k AS (SELECT unnest(range(10)) AS k), n AS (SELECT label, list_position(p, list_max(p)) - 1 AS pred, count(*) AS n FROM p GROUP BY ALL) SELECT CAST(a.k AS INTEGER) AS gold, CAST(b.k AS INTEGER) AS pred, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN n ON n.label = a.k AND n.pred = b.k")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), "label", "pred", _LABELS)


@query(f"""
WITH {_P}, d AS (SELECT label, list_position(p, list_max(p)) - 1 AS pred FROM p),
c AS (SELECT k.k AS label, (SELECT count(*) FROM d WHERE d.label = k.k) AS support, (SELECT count(*) FROM d WHERE d.pred = k.k) AS predicted, (SELECT count(*) FROM d WHERE d.label = k.k AND d.pred = k.k) AS tp FROM (SELECT unnest(range(10)) AS k) k),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS pr, coalesce(tp / nullif(support, 0), 0.0) AS re FROM c)
SELECT CAST(label AS INTEGER) AS label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1 FROM r
""")
def class_f1(spark, sf_dir):
    return metrics.class_scores(metrics.confusion(predictions(spark, sf_dir), "label", "pred", _LABELS))


@query(f"""
WITH {_P}, s AS (SELECT label, list_position(p, list_max(p)) - 1 = label AS ok, -ln(greatest(p[label + 1], 1e-12)) AS nll,
  list_sum(list_transform(range(1, 11), lambda i: (p[i] - CASE WHEN i = label + 1 THEN 1.0 ELSE 0.0 END) ** 2)) AS brier, list_max(p) AS conf FROM p)
SELECT count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier, round(avg(conf) FILTER (ok), 6) AS conf_right, round(avg(conf) FILTER (NOT ok), 6) AS conf_wrong FROM s
""")
def nll_brier(spark, sf_dir):
    s = predictions(spark, sf_dir).select((F.col("pred") == F.col("label")).alias("ok"), metrics.nll(F.element_at("p", F.col("label") + 1), 1e-12).alias("nll"), metrics.brier(F.col("p"), F.col("label")).alias("brier"), F.array_max("p").alias("conf"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg("brier"), 6).alias("brier"), F.round(F.avg(F.when(F.col("ok"), F.col("conf"))), 6).alias("conf_right"), F.round(F.avg(F.when(~F.col("ok"), F.col("conf"))), 6).alias("conf_wrong"))


@query(f"WITH {_P} SELECT label, count(*) AS n, round(sum(-ln(greatest(p[label + 1], 1e-12))) / (SELECT count(*) FROM p), 6) AS nll_share, count(*) FILTER (list_position(p, list_max(p)) - 1 <> label) AS errors FROM p GROUP BY label")
def class_breakdown(spark, sf_dir):
    p = predictions(spark, sf_dir)
    n = p.count()
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(metrics.nll(F.element_at("p", F.col("label") + 1), 1e-12)) / n, 6).alias("nll_share"), F.count_if(F.col("pred") != F.col("label")).alias("errors"))


@query(f"WITH {_P}, s AS (SELECT vec_id, list_position(p, list_max(p)) - 1 AS pred, list_reverse_sort(p) AS q FROM p) SELECT vec_id, CAST(pred AS INTEGER) AS pred, round(q[1] - q[2], 6) AS margin, q[1] - q[2] <= 0.05 AS ambiguous FROM s")
def argmax_margin(spark, sf_dir):
    q = F.sort_array("p", asc=False)
    margin = F.get(q, F.lit(0)) - F.get(q, F.lit(1))
    return predictions(spark, sf_dir).select("vec_id", "pred", F.round(margin, 6).alias("margin"), (margin <= 0.05).alias("ambiguous"))


@query(f"WITH {_P}, s AS (SELECT least(CAST(floor(list_max(p) * 10) AS BIGINT), 9) AS bin, list_max(p) AS conf, list_position(p, list_max(p)) - 1 = label AS ok FROM p) SELECT bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s GROUP BY bin")
def reliability_bins(spark, sf_dir):
    s = predictions(spark, sf_dir).select(F.array_max("p").alias("conf"), (F.col("pred") == F.col("label")).alias("ok")).withColumn("bin", F.least(F.floor(F.col("conf") * 10), F.lit(9).cast("long")))
    return s.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("confidence"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query(f"WITH {_P}, t AS (SELECT vec_id, label, list_transform(p, lambda x: exp(ln(x) / 2.5)) AS e FROM p) SELECT vec_id, round(e[label + 1] / list_sum(e), 6) AS p_gold, round(list_max(e) / list_sum(e), 6) AS confidence FROM t")
def temperature_scaled(spark, sf_dir):
    e = F.transform("p", lambda x: F.exp(F.ln(x) / 2.5))
    t = predictions(spark, sf_dir).withColumn("e", e).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return t.select("vec_id", F.round(F.element_at("e", F.col("label") + 1) / F.col("total"), 6).alias("p_gold"), F.round(F.array_max("e") / F.col("total"), 6).alias("confidence"))


@query()
def temperature_fit(spark, sf_dir):
    """The fitted temperature and its loss; an iterative search, so rows only."""
    p = predictions(spark, sf_dir).select(F.transform("p", lambda x: F.ln(x)).alias("logs"), "label").cache()
    t, loss = metrics.temperature(p, "logs", "label", rounds=100)
    p.unpersist()
    return spark.createDataFrame([(round(t, 4), round(loss, 6))], "temperature double, nll double")


@query(f"WITH {_P} SELECT vec_id, label, list_position(p, list_max(p)) - 1 AS pred, round(list_max(p), 6) AS confidence FROM p WHERE list_position(p, list_max(p)) - 1 <> label ORDER BY list_max(p) DESC, vec_id LIMIT 20".replace("list_position(p, list_max(p)) - 1 AS pred", "CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred"))
def confident_mistakes(spark, sf_dir):
    p = predictions(spark, sf_dir).where("pred <> label").withColumn("c", F.array_max("p"))
    return p.orderBy(F.col("c").desc(), "vec_id").limit(20).select("vec_id", "label", "pred", F.round("c", 6).alias("confidence"))


@query("""
WITH g AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place, count(*) AS n, count(*) FILTER (value > 50) AS ok FROM events GROUP BY user_id),
k AS (SELECT count(*) AS k FROM g), s AS (SELECT r.r AS rep, i.i AS slot FROM range(200) r(r), range((SELECT k FROM k)) i(i)),
d AS (SELECT rep, CAST(concat('0x', substr(sha256(concat(rep, ':', slot)), 1, 8)) AS BIGINT) % k AS place FROM s, k),
a AS (SELECT rep, sum(ok) / sum(n) AS accuracy FROM d JOIN g USING (place) GROUP BY rep),
l AS (SELECT list_sort(list(accuracy)) AS l FROM a)
SELECT round(l[CAST(floor(0.025 * 200) AS BIGINT) + 1], 6) AS low, round(l[CAST(ceil(0.975 * 200) AS BIGINT)], 6) AS high FROM l
""")
def cluster_bootstrap_hash(spark, sf_dir):
    """A 95 % interval of accuracy over 200 replicates that draw whole users; counts are summed per user first."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("ok"))
    d = metrics.draws(g, "user_id", 200)
    a = d.join(g, "user_id").groupBy("rep").agg((F.sum(F.col("ok") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("a"))
    r = a.withColumn("i", F.row_number().over(Window.orderBy("a")))
    return r.agg(F.round(F.max(F.when(F.col("i") == 6, F.col("a"))), 6).alias("low"), F.round(F.max(F.when(F.col("i") == 195, F.col("a"))), 6).alias("high"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_./:-]+') AS t FROM documents),
f AS (SELECT doc_id, list_distinct(list_concat(list_transform(t, lambda x: concat('u=', x)), list_transform(range(1, len(t)), lambda i: concat('b=', t[i], '_', t[i + 1])))) AS f FROM t),
tr AS (SELECT f.doc_id, quality, f FROM f JOIN labels USING (doc_id) WHERE doc_id % 2 = 0),
c AS (SELECT quality, x, count(*) AS c FROM (SELECT quality, unnest(f) AS x FROM tr) GROUP BY ALL),
v AS (SELECT x FROM c GROUP BY x HAVING sum(c) >= 2), cv AS (SELECT c.* FROM c JOIN v USING (x)),
base AS (SELECT quality, ln((count(*) + 1) / ((SELECT count(*) FROM tr) + (SELECT count(DISTINCT quality) FROM tr))) AS prior, -ln((SELECT sum(c) FROM cv WHERE cv.quality = tr.quality) + (SELECT count(*) FROM v)) AS unseen FROM tr GROUP BY quality),
own AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(f) AS x FROM f WHERE doc_id % 2 = 1) JOIN v USING (x)),
m AS (SELECT doc_id, count(*) AS m FROM own GROUP BY doc_id),
gain AS (SELECT doc_id, quality, sum(ln(c + 1.0)) AS gain FROM own JOIN cv USING (x) GROUP BY ALL)
SELECT f.doc_id, b.quality, round(prior + coalesce(m, 0) * unseen + coalesce(gain, 0), 4) AS score
FROM f CROSS JOIN base b LEFT JOIN m USING (doc_id) LEFT JOIN gain g ON g.doc_id = f.doc_id AND g.quality = b.quality WHERE f.doc_id % 2 = 1
""")
def naive_bayes_scores(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.probe_tokens(F.col("text")).alias("t"))
    f = t.select("doc_id", text.presence_features(F.col("t")).alias("f"))
    train = f.where("doc_id % 2 = 0").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "f")
    return models.naive_bayes(train, f.where("doc_id % 2 = 1"), "doc_id", "quality", "f").withColumn("score", F.round("score", 4))


@query("SELECT quality AS label, count(*) AS n, round((count(*) + 1.0) / ((SELECT count(*) FROM labels) + 2), 6) AS p FROM labels GROUP BY quality")
def majority_model(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    counts = labels.groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("p", F.round((F.col("n") + 1) / (total + 2), 6))


#: Candidates of the logistic model: name, l2, epochs, rate, seed; and the bounded sample and vocabulary that they are fitted on.
CANDIDATES = [("c1", 1.0 / 1000, 20, 0.15, 42), ("c2", 1.0 / 100, 20, 0.15, 42)]
SAMPLE, MIN_DF, FEATURES = 1000, 2, 4000


def _word_counts(docs):
    """(id, feature, n) of single words and pairs of whole texts."""
    t = docs.select("id", text.word_tokens(F.col("text")).alias("t"))
    return models.term_counts(t.select("id", F.concat("t", text.ngrams(F.col("t"), 2)).alias("f")), "id", "f")


def _fitted(spark, sf_dir):
    """The models and their vocabulary."""
    some = table(spark, sf_dir, "labels").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    d = table(spark, sf_dir, "documents").join(F.broadcast(some), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label"), "text").persist()
    counts = _word_counts(d).persist()
    known = models.vocabulary(counts, d.count(), MIN_DF, FEATURES).persist()
    return models.sgd_logistic(models.tfidf_vectors(counts, known), d.select("id", "label"), CANDIDATES), known


@query()
def sgd_logistic(spark, sf_dir):
    """Two candidate models on one bounded sample of labelled documents; sequential updates, so rows only."""
    return _fitted(spark, sf_dir)[0]


@query("""
WITH a AS (SELECT vec_id, label, embedding[1] > 0 AS stored FROM embeddings WHERE vec_id % 3 <> 0), b AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0)
SELECT count(*) FILTER (a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL) AS matched, count(*) FILTER (a.vec_id IS NULL) AS missing, count(*) FILTER (b.vec_id IS NULL) AS extra FROM a FULL OUTER JOIN b USING (vec_id)
""")
def prediction_join(spark, sf_dir):
    """Records against stored predictions: matched, missing and extra."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.where("vec_id % 3 <> 0").select("vec_id", F.lit(1).alias("a")), e.where("vec_id % 2 = 0").select("vec_id", F.lit(1).alias("b"))
    j = a.join(b, "vec_id", "full_outer")
    return j.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("matched"), F.count_if(F.expr("a is null")).alias("missing"), F.count_if(F.expr("b is null")).alias("extra"))


_SECOND = "CASE WHEN vec_id % 4 = 0 THEN label ELSE (list_position(p, list_max(p)) + 2) % 10 END"


@query(f"""
WITH {_P}, d AS (SELECT vec_id % 50 AS grp, label AS gold, list_position(p, list_max(p)) - 1 AS a, {_SECOND} AS b FROM p),
g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS place FROM (SELECT DISTINCT grp FROM d)), k AS (SELECT count(*) AS k FROM g),
t AS (SELECT rep, place, count(*) AS times FROM (SELECT r.r AS rep, CAST(concat('0x', substr(sha256(concat(r.r, ':', i.i)), 1, 8)) AS BIGINT) % (SELECT k FROM k) AS place FROM range(100) r(r), range((SELECT k FROM k)) i(i)) GROUP BY ALL),
w AS (SELECT rep, gold, a, b, sum(times) AS n FROM t JOIN g USING (place) JOIN d USING (grp) GROUP BY ALL UNION ALL SELECT -1, gold, a, b, count(*) FROM d GROUP BY ALL),
m AS (SELECT rep, 'a' AS model, gold, a AS pred, n FROM w UNION ALL SELECT rep, 'b', gold, b, n FROM w),
l AS (SELECT rep, model, label, sum(s) AS s, sum(q) AS q, sum(tp) AS tp FROM (SELECT rep, model, gold AS label, n AS s, 0 AS q, CASE WHEN gold = pred THEN n ELSE 0 END AS tp FROM m UNION ALL SELECT rep, model, pred, 0, n, 0 FROM m) GROUP BY ALL),
sc AS (SELECT rep, model, sum(coalesce(2.0 * tp / nullif(s + q, 0), 0)) / 10 AS macro_f1, CAST(sum(tp) AS DOUBLE) / sum(s) AS accuracy FROM l GROUP BY ALL),
x AS (SELECT rep, 'macro_f1' AS metric, max(macro_f1) FILTER (model = 'a') - max(macro_f1) FILTER (model = 'b') AS difference FROM sc GROUP BY rep UNION ALL SELECT rep, 'accuracy', max(accuracy) FILTER (model = 'a') - max(accuracy) FILTER (model = 'b') FROM sc GROUP BY rep),
o AS (SELECT metric, list_sort(list(difference) FILTER (rep >= 0)) AS s, max(difference) FILTER (rep = -1) AS observed FROM x GROUP BY metric)
SELECT metric, rule, round(observed, 6) AS observed, round(s[low + 1], 6) AS low, round(s[high + 1], 6) AS high FROM o CROSS JOIN (VALUES ('floor_ceil', 2, 97), ('probe', 1, 96), ('inner', 2, 96)) r(rule, low, high)
""")
def paired_bootstrap(spark, sf_dir):
    """Differences of two models' macro-F1 and accuracy, with the ends of a 95 % interval by each of three rules."""
    second = F.when(F.col("vec_id") % 4 == 0, F.col("label")).otherwise(((F.col("pred") + 3) % 10).cast("int"))
    p = predictions(spark, sf_dir).select((F.col("vec_id") % 50).alias("grp"), F.col("label").alias("gold"), F.col("pred").alias("a"), second.alias("b"))
    found = metrics.paired_bootstrap(p, "grp", "gold", "a", "b", _LABELS, 100).persist()
    whole = found.where("rep = -1").select("metric", F.round("difference", 6).alias("observed"))
    out = None
    for rule in metrics.INTERVALS:
        r = metrics.intervals(found.where("rep >= 0"), ["metric"], "difference", 100, rule).select("metric", F.lit(rule).alias("rule"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
        out = r if out is None else out.union(r)
    return out.join(whole, "metric")


@query(f"""
WITH {_P}, g AS (SELECT vec_id, label, p, p[label + 1] AS q FROM p)
SELECT vec_id, round(greatest(ln(greatest(q, 1e-12)), -9.21), 6) AS log_score, round(q / greatest(sqrt(list_sum(list_transform(p, lambda x: x * x))), 1e-9), 6) AS spherical,
  round(list_sum(list_transform(range(1, 11), lambda i: (list_sum(p[1:i]) - CASE WHEN i - 1 >= label THEN 1.0 ELSE 0.0 END) ** 2)) / 9, 6) AS ranked FROM g
""")
def proper_scores(spark, sf_dir):
    """Log, spherical and ranked probability scores of each prediction."""
    q = F.element_at("p", F.col("label") + 1)
    p = predictions(spark, sf_dir)
    return p.select("vec_id", F.round(metrics.log_score(q), 6).alias("log_score"), F.round(metrics.spherical_score(q, F.col("p")), 6).alias("spherical"), F.round(metrics.ranked_score(F.col("p"), F.col("label")), 6).alias("ranked"))


@query("""
WITH v AS (SELECT vec_id, label % 6 AS gold, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS z, list_transform([0, 1, 2, 3], lambda k: list_transform(embedding[7 + 6 * k:12 + 6 * k], lambda x: CAST(x AS DOUBLE))) AS e FROM embeddings),
c AS (SELECT vec_id, gold, z, unnest(e) AS e, generate_subscripts(e, 1) AS k FROM v),
n AS (SELECT vec_id, gold, z, k, list_transform(e, lambda x: x - list_sum(e) / 6) AS e FROM c),
w AS (SELECT *, list_transform([1, 2, 3, 4, 5, 6], lambda i: exp(z[i] + e[i])) AS x FROM n),
p AS (SELECT *, list_transform(x, lambda y: y / list_sum(x)) AS p FROM w),
r AS (SELECT *, greatest(ln(greatest(p[gold + 1], 1e-12)), -9.21) + 0.75 * p[gold + 1] / greatest(sqrt(list_sum(list_transform(p, lambda y: y * y))), 1e-9) AS reward FROM p),
a AS (SELECT *, (reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-6) AS advantage FROM r WINDOW g AS (PARTITION BY vec_id)),
s AS (SELECT vec_id, any_value(gold) AS gold, any_value(z) AS z, sum(advantage * list_sum(list_transform(e, lambda y: y * y))) / 0.5 / 4 AS loss_score,
  [sum(advantage * e[1]), sum(advantage * e[2]), sum(advantage * e[3]), sum(advantage * e[4]), sum(advantage * e[5]), sum(advantage * e[6])] AS pull FROM a GROUP BY vec_id),
q AS (SELECT *, list_transform(z, lambda y: exp(y) / list_sum(list_transform(z, lambda u: exp(u)))) AS p FROM s),
t AS (SELECT *, list_transform([1, 2, 3, 4, 5, 6], lambda i: p[i] - CASE WHEN i = gold + 1 THEN 1 ELSE 0 END - pull[i] / 0.25 / 4) AS g FROM q)
SELECT vec_id, round(loss_score - ln(greatest(p[gold + 1], 1e-12)), 4) AS loss, round(g[1], 4) AS g0, round(g[2], 4) AS g1, round(g[3], 4) AS g2, round(g[4], 4) AS g3, round(g[5], 4) AS g4, round(g[6], 4) AS g5 FROM t
""")
def score_gradients(spark, sf_dir):
    """Loss and gradient of the score-function estimator: six logits of each vector, perturbed by its next four sixes of components."""
    part = lambda at: F.transform(F.slice("embedding", at, 6), lambda x: x.cast("double"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 6).alias("gold"), part(1).alias("z"), F.array(*[part(7 + 6 * k) for k in range(4)]).alias("e"))
    g = metrics.score_gradient(v, "z", "gold", "e", 0.5)
    return g.select("vec_id", F.round("loss", 4).alias("loss"), *[F.round(F.get("gradient", F.lit(i)), 4).alias(f"g{i}") for i in range(6)])


@query()
def sgd_scores(spark, sf_dir):
    """Class probabilities of documents under the fitted models, which are saved and read again; rows only, as the fit is."""
    fitted, known = _fitted(spark, sf_dir)
    fitted, known = (models.read_saved(spark, models.saved(x)) for x in (fitted, known))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return models.tfidf_scores(fitted, _word_counts(d), known, d, "id").withColumnRenamed("id", "doc_id")


@query()
def grouped_cross_validation(spark, sf_dir):
    """Per fold of users: events held out and the accuracy of the type that is most frequent in the other folds; folds are dealt greedily."""
    e = table(spark, sf_dir, "events")
    sizes = e.groupBy("user_id").agg(F.count("*").alias("n"))
    folds = metrics.fold_table(sizes, "user_id", "n", 5)
    counts = e.join(folds, "user_id").groupBy("fold", "event_type").agg(F.count("*").alias("n")).persist()
    total = counts.groupBy("event_type").agg(F.sum("n").alias("all_n"))
    rest = counts.select("fold").distinct().crossJoin(total).join(counts, ["fold", "event_type"], "left").fillna(0)  # folds by types
    best = rest.groupBy("fold").agg(F.max_by("event_type", F.struct(F.col("all_n") - F.col("n"), F.col("event_type"))).alias("guess"), F.sum("n").alias("held_out"))
    hit = best.join(counts, (best["fold"] == counts["fold"]) & (best["guess"] == counts["event_type"]), "left")
    return hit.select(best["fold"], "held_out", "guess", F.round(F.coalesce("n", F.lit(0)) / F.col("held_out"), 6).alias("accuracy"))


@query(f"""
WITH {_P}, r AS (SELECT vec_id, list_position(p, list_max(p)) - 1 AS pred, CASE WHEN vec_id % 5 <> 0 THEN label END AS label, list_transform(range(1, 11), lambda i: p[11 - i]) AS gold FROM p)
SELECT vec_id, CAST(coalesce(label, list_position(gold, list_max(gold)) - 1) AS INTEGER) AS reference, coalesce(label, list_position(gold, list_max(gold)) - 1) = pred AS agrees FROM r
""")
def reference_agreement(spark, sf_dir):
    """Predictions against the gold label or, where it is null, the likeliest option of the gold distribution (here the reversed one)."""
    p = predictions(spark, sf_dir).select("vec_id", "pred", F.when(F.col("vec_id") % 5 != 0, F.col("label")).alias("label"), F.reverse("p").alias("gold"))
    reference = F.coalesce("label", (text.argmax(F.col("gold")) - 1).cast("int"))
    return p.select("vec_id", reference.alias("reference"), (reference == F.col("pred")).alias("agrees"))


@query(f"""
WITH {_P}, m AS (SELECT label, list_position(p, list_max(p)) - 1 = label AS ok, -ln(greatest(p[label + 1], 1e-12)) AS nll FROM p),
r AS (SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS accuracy, avg(nll) AS nll, count(*) FILTER (ok) / count(*) AS a FROM m), c AS (SELECT sum(l) / sum(n) AS b FROM (SELECT sum(nll) AS l, count(*) AS n FROM m GROUP BY label))
SELECT 'accuracy' AS metric, abs(accuracy - a) <= 1e-10 AS same FROM r, c UNION ALL SELECT 'nll', abs(nll - b) <= 1e-10 FROM r, c UNION ALL SELECT 'spoilt', abs(nll - a) <= 1e-10 FROM r, c
""")
def reported_metrics(spark, sf_dir):
    """Metrics as reported against the same recomputed from counts, within 1e-10; one report is spoilt."""
    p = predictions(spark, sf_dir)
    loss = metrics.nll(F.element_at("p", F.col("label") + 1), 1e-12)
    reported = p.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.avg(loss).alias("nll"))
    counted = metrics.confusion(p, "label", "pred", _LABELS).agg((F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))) / F.sum("n")).alias("a")).crossJoin(p.groupBy("label").agg(F.sum(loss).alias("l"), F.count("*").alias("c")).agg((F.sum("l") / F.sum("c")).alias("b")))  # one row each
    pairs = {"accuracy": ("accuracy", "a"), "nll": ("nll", "b"), "spoilt": ("nll", "a")}
    return reported.crossJoin(counted).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), metrics.same(F.col(x), F.col(y)).alias("same")) for n, (x, y) in pairs.items()])).alias("x")).select("x.*")
