"""Classification, resampling and distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from versloom.functions import statistics as st
from versloom.functions.wordlists import FUNCTION_WORDS
from versloom.operators import features, groups as G, infer as I, learn as L, pairs as P
from versloom.plans.registry import query, sql_list
from versloom.plans.segment_queries import _CURRENT, _RUN, _current, _run
from versloom.plans.text_queries import _LANG, _T1, _lang
from versloom.session import staged
from versloom.tables import table

# --- Delta over units of language and source

_UNITS = f"""slots AS (SELECT unnest(range(0, {len(FUNCTION_WORDS)})) AS s, unnest({sql_list(FUNCTION_WORDS)}) AS word), d AS (SELECT {_LANG} AS l, {_LANG} || '/' || source AS u, {_T1} AS ts FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
t AS (SELECT u, l, sum(len(ts)) AS total FROM d GROUP BY ALL), c AS (SELECT u, word, count(*) AS n FROM (SELECT u, unnest(ts) AS word FROM d) GROUP BY ALL),
f AS (SELECT t.u, t.l, s.s, CASE WHEN total = 0 THEN 0.0 ELSE coalesce(n, 0) / total * 1000 END AS v FROM t CROSS JOIN slots s LEFT JOIN c ON c.u = t.u AND c.word = s.word)"""


def _units(spark, d):
    docs = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(_lang("lang").alias("l"), F.concat(_lang("lang"), F.lit("/"), "source").alias("u"), "text")
    return features.word_profile(docs, ["u", "l"], "text").select("u", "l", F.col("slot").alias("s"), F.col("per_1000").alias("v"))


def _delta_sql(source="f"):
    return f"""p AS (SELECT h.u AS unit, h.l AS truth, h.s, h.v AS own, f.l, f.v FROM {source} h JOIN {source} f ON h.s = f.s AND h.u <> f.u),
m AS (SELECT unit, truth, s, any_value(own) AS own, avg(v) AS mu, CASE WHEN coalesce(stddev_samp(v), 0) = 0 THEN 1 ELSE stddev_samp(v) END AS sd FROM p GROUP BY unit, truth, s), k AS (SELECT unit, s, l, avg(v) AS c FROM p GROUP BY unit, s, l),
z AS (SELECT m.unit, m.truth, k.l AS label, avg(abs((own - mu) / sd - (c - mu) / sd)) AS delta FROM k JOIN m ON m.unit = k.unit AND m.s = k.s GROUP BY ALL), g AS (SELECT unit, truth, label AS guess FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(delta, 12), label) AS r FROM z) WHERE r = 1)"""


def _delta(spark, d):
    return L.delta_distances(staged(_units(spark, d), "units"), "u", "l", "s", "v")


@query(f"WITH {_UNITS}, {_delta_sql()} SELECT unit, truth, label, round(delta, 8) AS delta FROM z")
def delta_loo(spark, d):
    return _delta(spark, d).select("unit", "truth", "label", F.round("delta", 8).alias("delta"))


@query(f"""
WITH {_UNITS}, {_delta_sql()}, rc AS (SELECT truth, avg(CAST(truth = guess AS DOUBLE)) AS r, count(*) AS n FROM g GROUP BY truth) SELECT CAST(sum(n) AS BIGINT) AS n, round(avg(r), 9) AS balanced_accuracy FROM rc
""")
def delta_balanced_accuracy(spark, d):
    s = G.summary_metrics(L.nearest(_delta(spark, d), "unit", "truth", "label", "delta"), "truth", "guess")
    return s.select("n", F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


@query(f"""
WITH {_UNITS}, top AS (SELECT s FROM f GROUP BY s ORDER BY round(avg(v), 12) DESC, s LIMIT 50), q AS (SELECT * FROM f WHERE s IN (SELECT s FROM top)), {_delta_sql('q')} SELECT unit, truth, guess FROM g
""")
def delta_topk(spark, d):
    f = staged(_units(spark, d), "units")
    kept = f.join(F.broadcast(L.top_slots(f, "s", "v", 50)), "s", "left_semi")  # 50 rows
    return L.nearest(L.delta_distances(kept, "u", "l", "s", "v"), "unit", "truth", "label", "delta")


# --- nearest centroids and metrics over embeddings

_CENTROIDS = """x AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT label, i, sum(v) AS s, count(*) AS n FROM x GROUP BY ALL),
dd AS (SELECT x.vec_id, x.label AS truth, s.label AS guess, sqrt(sum(pow((CASE WHEN x.label = s.label THEN (s - v) / (n - 1) ELSE s / n END) - v, 2))) AS distance FROM x JOIN s ON x.i = s.i WHERE n > 1 OR x.label <> s.label GROUP BY ALL),
g AS (SELECT vec_id, truth, guess, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), guess) AS r FROM dd) WHERE r = 1)"""


def _guesses(spark, d):
    return L.centroid_loo(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query(f"WITH {_CENTROIDS} SELECT vec_id, truth, guess, round(distance, 6) AS distance FROM g")
def centroid_loo(spark, d):
    return _guesses(spark, d).select("vec_id", "truth", "guess", F.round("distance", 6).alias("distance"))


@query(f"WITH {_CENTROIDS}, l AS (SELECT truth AS l FROM g UNION SELECT guess FROM g) SELECT a.l AS truth, b.l AS guess, count(g.vec_id) AS n FROM l a CROSS JOIN l b LEFT JOIN g ON g.truth = a.l AND g.guess = b.l GROUP BY ALL")
def confusion_matrix(spark, d):
    return G.confusion(_guesses(spark, d), "truth", "guess")


_Z = st.Z975
_METRICS = f"""a AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = guess) AS hits FROM g GROUP BY 1), b AS (SELECT guess AS label, count(*) AS predicted FROM g GROUP BY 1),
j AS (SELECT label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted FROM a FULL JOIN b USING (label)),
r AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM j), k AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


@query(f"""
WITH {_CENTROIDS}, {_METRICS} SELECT label, support, predicted, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
round(greatest(0, (recall + {_Z} * {_Z} / (2 * support)) / (1 + {_Z} * {_Z} / support) - {_Z} * sqrt(recall * (1 - recall) / support + {_Z} * {_Z} / (4 * support * support)) / (1 + {_Z} * {_Z} / support)), 9) AS recall_low,
round(least(1, (recall + {_Z} * {_Z} / (2 * support)) / (1 + {_Z} * {_Z} / support) + {_Z} * sqrt(recall * (1 - recall) / support + {_Z} * {_Z} / (4 * support * support)) / (1 + {_Z} * {_Z} / support)), 9) AS recall_high FROM k WHERE support > 0
""")
def per_class_prf(spark, d):
    m = G.class_metrics(_guesses(spark, d), "truth", "guess").where("support > 0")
    return m.select("label", "support", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "recall_low", "recall_high")])


@query(f"""
WITH {_CENTROIDS}, {_METRICS} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 9) AS accuracy, round(avg(recall), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM k WHERE support > 0
""")
def balanced_accuracy(spark, d):
    s = G.summary_metrics(_guesses(spark, d), "truth", "guess")
    return s.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


@query(f"""
WITH {_CENTROIDS}, a AS (SELECT vec_id % 37 AS run, truth, avg(CAST(truth = guess AS DOUBLE)) AS a FROM g GROUP BY ALL), b AS (SELECT truth, avg(a) AS a FROM a GROUP BY truth) SELECT round(avg(a), 9) AS balanced FROM b
""")
def run_weighted_accuracy(spark, d):
    g = _guesses(spark, d).withColumn("run", F.col("vec_id") % 37)
    return G.group_weighted_accuracy(g, "run", "truth", "guess").select(F.round("balanced", 9).alias("balanced"))


# --- permutations, bootstrap, multiplicity

_RUNSCORE = f"""b AS (SELECT block_id, {_RUN} AS run, quote_status AS label, target_size FROM ({_CURRENT})), s0 AS (SELECT block_id, score FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY scored_at DESC, score DESC NULLS LAST) AS r FROM block_scores) WHERE r = 1),
u AS (SELECT b.block_id AS unit, run, label, target_size, score FROM b JOIN s0 USING (block_id) WHERE score IS NOT NULL AND label IS NOT NULL)"""
_B = 50


def _scored_units(spark, d):
    from versloom.tables import latest_rows

    b = _current(spark, d, ["run_id", "quote_status", "target_size"]).select(F.col("block_id").alias("unit"), _run().alias("run"), F.col("quote_status").alias("label"), "target_size")
    s = latest_rows(table(spark, d, "block_scores"), "block_id", "scored_at", ["score"]).withColumnRenamed("block_id", "unit")
    return staged(b.join(s, "unit").where("score IS NOT NULL AND label IS NOT NULL"), "scored")


def _perm_sql(stratum):
    p = "perm_id, run" if stratum else "perm_id"
    on = "AND a.run = c.run" if stratum else ""
    return f"""r AS (SELECT perm_id, unit, run, label, row_number() OVER (PARTITION BY {p} ORDER BY unit) AS bn, row_number() OVER (PARTITION BY {p} ORDER BY md5('42|' || perm_id || '|' || unit), unit) AS bh FROM u, (SELECT unnest(range(0, {_B})) AS perm_id)),
perms AS (SELECT a.perm_id, a.unit, c.label FROM r a JOIN r c ON a.perm_id = c.perm_id {on} AND a.bh = c.bn)"""


_GAP = "avg(score) FILTER (label = 'original') - avg(score) FILTER (label <> 'original')"


def _gap():
    return F.avg(F.when(F.col("label") == "original", F.col("score"))) - F.avg(F.when(F.col("label") != "original", F.col("score")))


@query(f"WITH {_RUNSCORE}, {_perm_sql(False)} SELECT perm_id, unit, label FROM perms", ints=("perm_id",))
def perm_table_hash(spark, d):
    return I.permuted_labels(_scored_units(spark, d), "unit", "label", _B)


@query(f"WITH {_RUNSCORE}, {_perm_sql(True)} SELECT perm_id, count(*) AS n, count(*) FILTER (perms.label = u.label) AS unmoved FROM perms JOIN u USING (unit) GROUP BY perm_id", ints=("perm_id",))
def blocked_perm_table(spark, d):
    u = _scored_units(spark, d).withColumn("own", F.col("label"))
    p = I.permuted_labels(u, "unit", "label", _B, "run", keep=("own",))
    return p.groupBy("perm_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("own")).alias("unmoved"))


def _pvalue_sql(stratum):
    return f"""WITH {_RUNSCORE}, {_perm_sql(stratum)}, nul AS (SELECT perm_id, round(avg(score) FILTER (perms.label = 'original') - avg(score) FILTER (perms.label <> 'original'), 9) AS gap FROM perms JOIN u USING (unit) GROUP BY perm_id), o AS (SELECT round({_GAP}, 9) AS observed FROM u)
SELECT observed, count(*) AS n, count(*) FILTER (gap >= observed) AS exceed, round((count(*) FILTER (gap >= observed) + 1) / (count(*) + 1), 9) AS p, round(avg(gap), 7) AS null_mean, round(stddev_pop(gap), 7) AS null_sd, round(quantile_cont(gap, 0.025), 7) AS low, round(quantile_cont(gap, 0.975), 7) AS high FROM nul, o GROUP BY observed"""


def _pvalue(spark, d, stratum):
    u = _scored_units(spark, d)
    p = I.permuted_labels(u, "unit", "label", _B, stratum, keep=("score",))
    null = p.groupBy("perm_id").agg(F.round(_gap(), 9).alias("gap"))
    e = I.exceedance(null, u.agg(F.round(_gap(), 9).alias("gap")), "gap", [])
    return e.select("observed", "n", "exceed", F.round("p", 9).alias("p"), *[F.round(c, 7).alias(c) for c in ("null_mean", "null_sd", "low", "high")])


@query(_pvalue_sql(False))
def perm_pvalue(spark, d):
    return _pvalue(spark, d, None)


@query(_pvalue_sql(True))
def blocked_perm_pvalue(spark, d):
    return _pvalue(spark, d, "run")


@query(f"""
WITH {_RUNSCORE}, {_perm_sql(False)}, nul AS (SELECT perm_id, target_size AS variant, round(avg(score) FILTER (perms.label = 'original') - avg(score) FILTER (perms.label <> 'original'), 9) AS gap FROM perms JOIN u USING (unit) GROUP BY ALL), o AS (SELECT target_size AS variant, round({_GAP}, 9) AS observed FROM u GROUP BY 1),
w AS (SELECT perm_id, max(gap) AS top FROM nul WHERE gap IS NOT NULL GROUP BY perm_id HAVING count(DISTINCT variant) = (SELECT count(*) FROM o))
SELECT variant, observed, count(*) AS n, round((count(*) FILTER (gap >= observed) + 1) / (count(*) + 1), 9) AS p_raw, round((count(*) FILTER (top >= observed) + 1) / (count(*) + 1), 9) AS p_adjusted FROM nul JOIN w USING (perm_id) JOIN o USING (variant) WHERE gap IS NOT NULL GROUP BY variant, observed
""")
def maxt_pvalue(spark, d):
    u = _scored_units(spark, d).withColumnRenamed("target_size", "variant")
    p = I.permuted_labels(u, "unit", "label", _B, keep=("score", "variant"))
    null = p.groupBy("perm_id", "variant").agg(F.round(_gap(), 9).alias("gap"))
    o = u.groupBy("variant").agg(F.round(_gap(), 9).alias("gap"))
    return I.max_statistic(null, o, "variant", "gap").select("variant", "observed", "n", F.round("p_raw", 9).alias("p_raw"), F.round("p_adjusted", 9).alias("p_adjusted"))


_USERS = "m AS (SELECT user_id AS unit, avg(value) AS v FROM events GROUP BY 1)"


def _users(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("unit")).agg(F.avg("value").alias("v"))


@query(f"""
WITH {_USERS}, p AS (SELECT unit, v, row_number() OVER (ORDER BY unit) - 1 AS place, count(*) OVER () AS n FROM m), r AS (SELECT boot_id, place, n FROM p, (SELECT unnest(range(0, 100)) AS boot_id)),
k AS (SELECT boot_id, CAST('0x' || substr(md5('42|' || boot_id || '|' || place), 1, 12) AS BIGINT) % n AS place FROM r), b AS (SELECT boot_id, avg(v) AS score FROM k JOIN p USING (place) GROUP BY boot_id)
SELECT count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.025), 6) AS low, round(quantile_cont(score, 0.975), 6) AS high FROM b
""")
def bootstrap_ci_hash(spark, d):
    u = staged(_users(spark, d), "users")
    b = I.bootstrap_draws(u, "unit", 100, keep=("v",)).groupBy("boot_id").agg(F.avg("v").alias("score"))
    i = I.interval(b, [], "score", expected=100)
    return i.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type
""")
def percentile_ci(spark, d):
    i = I.interval(table(spark, d, "events"), ["event_type"], "value")
    return i.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("""
WITH p AS (SELECT p_type, p_brand, round(count(*) FILTER (p_size > 25) / count(*), 6) AS p FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM p)
SELECT p_type, p_brand, p, round(least(1, min(p * n / r) OVER (PARTITION BY p_type ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_adjusted FROM r
""")
def bh_fdr(spark, d):
    p = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.round(F.count_if(F.col("p_size") > 25) / F.count(F.lit(1)), 6).alias("p"))
    return I.false_discovery(p, ["p_type"], "p").withColumn("p_adjusted", F.round("p_adjusted", 9))


@query("""
WITH r AS (SELECT draw_id, genre, doc_id, n_chars, row_number() OVER (PARTITION BY draw_id, genre ORDER BY md5('42|' || draw_id || '|' || doc_id), doc_id) AS r FROM documents, (SELECT unnest(range(0, 10)) AS draw_id) WHERE genre IS NOT NULL), l AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM documents WHERE genre IS NOT NULL GROUP BY genre))
SELECT draw_id, genre, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM r, l WHERE r <= least GROUP BY ALL
""", ints=("draw_id",))
def downsample_equal(spark, d):
    docs = table(spark, d, "documents").where("genre IS NOT NULL").select("doc_id", "genre", "n_chars")
    return I.downsampled(docs, "genre", "doc_id", 10).groupBy("draw_id", "genre").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""
WITH {_RUNSCORE}, s AS (SELECT label, unit, score, sum(score) OVER (PARTITION BY label) AS s, count(*) OVER (PARTITION BY label) AS n FROM u) SELECT label, unit, round(s / n - (s - score) / (n - 1), 9) AS influence FROM s
""")
def jackknife_influence(spark, d):
    return I.jackknife_mean(_scored_units(spark, d), ["label"], "unit", "score").withColumn("influence", F.round("influence", 9))


@query("""
WITH u AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT event_type, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM u GROUP BY event_type)
SELECT event_type, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round((mean - 20) / (sd / sqrt(n)), 5) AS t, round(sqrt((n + 100.0) / n) * exp(-pow(round((mean - 20) / (sd / sqrt(n)), 5), 2) / (2 * (1 + n * 0.01))), 6) AS bf01 FROM m
""")
def tost_moments(spark, d):
    u = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    m = u.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    t = F.round((F.col("mean") - 20) / (F.col("sd") / F.sqrt("n")), 5)
    return m.withColumn("t", t).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "t", F.round(st.bayes_factor_null(F.col("t"), F.col("n")), 6).alias("bf01"))


@query()
def tost_equivalence(spark, d):
    """Equivalence of the mean of each event type to 20 within 5: a handful of moments, tested on the driver."""
    m = tost_moments(spark, d).collect()
    rows = [(r["event_type"], *(float(v) for v in list(st.tost(r["mean"], r["sd"], r["n"], 20.0, 5.0).values())[:5])) for r in m]
    return spark.createDataFrame(rows, "event_type string, p_lower double, p_upper double, p double, low double, high double")


@query("""
WITH m AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY 1)
SELECT a.event_type AS a, b.event_type AS b, round(CASE WHEN sqrt((a.sd * a.sd + b.sd * b.sd) / 2) > 0 THEN (a.mean - b.mean) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2) ELSE 0 END, 9) AS d FROM m a JOIN m b ON a.event_type < b.event_type
""")
def cohens_d(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    a, b = m.toDF("a", "ma", "sa"), m.toDF("b", "mb", "sb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(st.cohens_d(F.col("ma"), F.col("sa"), F.col("mb"), F.col("sb")), 9).alias("d"))


# --- distances

_PAIRS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.label, 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query(f"WITH {_PAIRS} SELECT label, count(*) AS pairs, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM p GROUP BY label")
def cosine_within_class(spark, d):
    return P.cosine_moments(table(spark, d, "embeddings"), "label", "embedding").select("label", "pairs", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"WITH {_PAIRS} SELECT label, round(min(d), 6) AS least, round(max(d), 6) AS most FROM p GROUP BY label")
def cosine_extremes(spark, d):
    return P.cosine_extremes(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("label", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query("""
WITH h AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, md5('42|' || vec_id) AS h FROM embeddings), n AS (SELECT e, lead(e) OVER w AS e2, lead(vec_id) OVER w AS b FROM h WINDOW w AS (PARTITION BY label ORDER BY h, vec_id)),
m AS (SELECT e, label, lead(e) OVER w AS e2, lead(label) OVER w AS l2, lead(vec_id) OVER w AS b FROM h WINDOW w AS (PARTITION BY substr(h, 1, 1) ORDER BY h, vec_id))
SELECT 'same' AS kind, count(*) AS pairs, round(avg(1 - list_cosine_similarity(e, e2)), 6) AS mean, round(stddev_pop(1 - list_cosine_similarity(e, e2)), 6) AS sd FROM n WHERE b IS NOT NULL
UNION ALL SELECT 'different', count(*), round(avg(1 - list_cosine_similarity(e, e2)), 6), round(stddev_pop(1 - list_cosine_similarity(e, e2)), 6) FROM m WHERE b IS NOT NULL AND label <> l2
""")
def cosine_same_vs_diff(spark, d):
    e = table(spark, d, "embeddings")
    out = None
    for kind, same in (("same", True), ("different", False)):
        p = P.sampled_pairs(e, "vec_id", "label", "embedding", 1, same)
        s = p.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("distance"), 6).alias("mean"), F.round(F.stddev_pop("distance"), 6).alias("sd")).withColumn("kind", F.lit(kind))
        out = s if out is None else out.unionByName(s)
    return out


@query("""
WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT label, i, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT i, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM p GROUP BY i),
a AS (SELECT sum(q - s * s / n) AS within, count(DISTINCT label) AS classes FROM p), b AS (SELECT sum(q - s * s / n) AS total, max(n) AS n FROM t)
SELECT CAST(n AS BIGINT) AS n, classes, round(within, 4) AS within, round(total, 4) AS total, round((total - within) / (classes - 1) / (within / (n - classes)), 6) AS f FROM a, b
""")
def permanova_f(spark, d):
    p = P.pseudo_f(table(spark, d, "embeddings"), "label", "embedding")
    return p.select("n", "classes", F.round("within", 4).alias("within"), F.round("total", 4).alias("total"), F.round("f", 6).alias("f"))


@query("""
WITH c AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS ab, sum(n) AS n FROM c), r AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((ab - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) AS index FROM t, r, k
""")
def adjusted_rand(spark, d):
    return P.adjusted_rand(table(spark, d, "embeddings").withColumn("k", F.col("vec_id") % 7), "label", "k").select(F.round("index", 9).alias("index"))


# --- learners that SQL can't express


#: Permutations of the null of the grouped regression: enough for a look; a study passes its own number.
PERMUTATIONS = 24


def _matrix(spark, d):
    """Function-word features of units of source, genre and language, labelled by genre: a task that is not trivial.

    All documents with a source and a genre count; those without a language are
    units of the language '?'.
    """
    docs = table(spark, d, "documents").where("source IS NOT NULL AND genre IS NOT NULL").select(F.col("genre").alias("l"), F.concat_ws("/", "source", "genre", _lang("lang")).alias("u"), "text")
    f = features.word_profile(docs, ["u", "l"], "text")
    return L.matrix_of(f, "u", "l", "slot", "per_1000")


def _sources(units):
    return np.array([u.rsplit("/", 2)[0] for u in units])


def _folds(units, k):
    """The fold of each unit: whole sources, so that none is in training and test at once."""
    names, sizes = np.unique(_sources(units), return_counts=True)
    fold = G.grouped_folds(list(zip(names.tolist(), sizes.tolist(), strict=True)), k)
    return np.array([fold[s] for s in _sources(units)])


@query()
def logit_loo(spark, d):
    units, x, y, labels = _matrix(spark, d)
    groups = _sources(units)
    folds = sorted(set(groups))
    shared = spark.sparkContext.broadcast((x, y, groups))

    def work(i):
        x, y, groups = shared.value
        own = groups == folds[i]
        guess = L.held_out_guesses(x, y, np.where(own, "held", "rest"))
        return [(units[k], labels[y[k]], labels[guess[k]] if guess[k] >= 0 else None) for k in np.flatnonzero(own)]

    return L.per_task(spark, list(range(len(folds))), work, "unit string, truth string, guess string")


@query()
def logit_c_grid(spark, d):
    units, x, y, _ = _matrix(spark, d)
    groups = _folds(units, 5)
    shared, grid = spark.sparkContext.broadcast((x, y, groups)), [0.01, 0.1, 1.0, 10.0, 100.0]
    return L.per_task(spark, list(range(len(grid))), lambda i: [(grid[i], L.balanced_accuracy(shared.value[1], L.held_out_guesses(*shared.value, c=grid[i])))], "c double, balanced_accuracy double")


@query()
def unmasking_curve(spark, d):
    units, x, y, labels = _matrix(spark, d)
    groups = _folds(units, 5)
    shared = spark.sparkContext.broadcast((x, y, groups))
    pairs = [(a, b) for a in range(len(labels)) for b in range(a + 1, len(labels))]

    def work(i):
        x, y, g = shared.value
        a, b = pairs[i]
        ok = (y == a) | (y == b)
        return [(labels[a], labels[b], r, float(ba), k) for r, ba, k in L.unmasking(x[ok], (y[ok] == b).astype(int), g[ok], rounds=5)]

    return L.per_task(spark, list(range(len(pairs))), work, "a string, b string, round int, balanced_accuracy double, features int")


@query()
def logit_perm_null(spark, d, permutations=PERMUTATIONS):
    """Null of the grouped logistic regression: one permutation a row, the matrix sent once; row 0 has the true labels."""
    units, x, y, _ = _matrix(spark, d)
    groups = _folds(units, 3)
    shared = spark.sparkContext.broadcast((x, y, groups))

    def work(i):
        x, y, g = shared.value
        label = y if i == 0 else np.random.RandomState(42 + int(i)).permutation(y)
        return [(int(i), float(L.balanced_accuracy(label, L.held_out_guesses(x, label, g))))]

    return L.per_task(spark, list(range(permutations + 1)), work, "perm_id long, score double")


def held_out_halves(spark, d, fit):
    """Share of the embeddings of each class that a model is right about which was fitted on the other half of the rows, by hash."""
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("label", F.pmod(F.xxhash64("vec_id"), F.lit(2)).alias("half"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    e, out = staged(e, "halves"), None
    for half in (0, 1):
        part = fit(e.where(F.col("half") != half)).transform(e.where(F.col("half") == half)).select("label", "prediction")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"))


@query()
def mllib_logit(spark, d):
    """MLlib's regression over the embeddings, each row judged by the model that did not see it."""
    return held_out_halves(spark, d, lambda e: L.logistic_model(e, "features", "label"))


@query()
def kmeans_clusters(spark, d):
    """K-means over the embeddings against their labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    k = KMeans(k=10, seed=42).fit(e).transform(e)
    return P.adjusted_rand(k, "label", "prediction")


def _study(spark, d, kinds, names=("words", "first_50", "trigrams")):
    from versloom import study

    docs = table(spark, d, "documents").select("source", "genre", _lang("lang").alias("lang"), "text")
    settings = study.Settings(permutations=8, bootstraps=4, penalties=(0.1, 1.0, 10.0), folds=3)
    variants = {n: v for n, v in study.document_variants(docs).items() if n in names}
    return staged(study.run_study(spark, variants, settings, kinds=("observed", *kinds)), "study"), settings


@query()
def study_tests(spark, d):
    """A small study over all documents: three variants against shuffled labels, with maxT, false discovery and a refitted bootstrap."""
    from versloom.study import summary

    return summary(*_study(spark, d, ("permuted", "blocked", "bootstrap")))


@query()
def study_contrasts(spark, d):
    """What the score of the function words becomes without each source, by penalty, for pairs of classes and without each class."""
    from versloom.study import contrasts

    return contrasts(_study(spark, d, ("without group", "penalty", "classes"), ("words",))[0])
