"""Filters, rankings and studies that complete the catalogue."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from versloom.operators import learn as L, sequences as S
from versloom.plans.registry import query
from versloom.plans.segment_queries import _CURRENT, _RUN, _current, _run
from versloom.plans.study_queries import _UNITS, _delta_sql, _folds, _matrix, _sources, _units, held_out_halves
from versloom.session import staged
from versloom.tables import table


@query("SELECT block_id, voice FROM voice_blocks WHERE target_size = 1000 AND quote_status = 'original' AND voice IN ('NISUSHEVO', 'PILOFIKU', 'TIHIDUHE')")
def block_filter(spark, d):
    keep = (F.col("target_size") == 1000) & (F.col("quote_status") == "original") & F.col("voice").isin("NISUSHEVO", "PILOFIKU", "TIHIDUHE")
    return table(spark, d, "voice_blocks").where(keep).select("block_id", "voice")


@query(f"WITH b AS ({_CURRENT}) SELECT block_id, verse_count FROM b ORDER BY verse_count DESC NULLS LAST, block_id LIMIT 10")
def largest_blocks(spark, d):
    return _current(spark, d, ["verse_count"]).orderBy(F.desc_nulls_last("verse_count"), "block_id").limit(10).select("block_id", "verse_count")


@query("""
SELECT block_id, start_chapter IN (12, 13, 14) AND coalesce(book LIKE 'K%', false) AS excluded, coalesce(start_chapter BETWEEN 3 AND 7 OR (start_chapter = 9 AND start_verse IN (1, 2)), false) AS in_range FROM voice_blocks WHERE start_chapter IS NOT NULL
""")
def membership_flags(spark, d):
    b = table(spark, d, "voice_blocks").where("start_chapter IS NOT NULL")
    flags = {
        "excluded": F.col("start_chapter").isin(12, 13, 14) & F.col("book").startswith("K"),
        "in_range": F.col("start_chapter").between(3, 7) | ((F.col("start_chapter") == 9) & F.col("start_verse").isin(1, 2)),
    }
    return S.column_flags(b, **flags).select("block_id", *flags)


@query("SELECT doc_id, substr(text, 1, 50) AS first_chars, lang IS NULL OR n_chars < 100 AS needs_review, concat_ws(',', CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN n_chars < 100 THEN 'short' END) AS reasons FROM documents WHERE lang IS NULL OR n_chars < 100")
def review_records(spark, d):
    why = F.concat_ws(",", F.when(F.col("lang").isNull(), "no language"), F.when(F.col("n_chars") < 100, "short"))
    rows = table(spark, d, "documents").where("lang IS NULL OR n_chars < 100")
    return rows.select("doc_id", F.substring("text", 1, 50).alias("first_chars"), F.lit(True).alias("needs_review"), why.alias("reasons"))


@query(f"""
WITH b AS (SELECT {_RUN} AS run, quote_status FROM ({_CURRENT}) WHERE quote_status IS NOT NULL), c0 AS (SELECT run, quote_status, count(*) AS n FROM b GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY run) AS total FROM c0)
SELECT run, quote_status AS label, n, CAST(total AS BIGINT) AS total FROM c WHERE n >= 0.8 * total
""")
def pure_runs(spark, d):
    """Runs of which at least 80 % have one label."""
    c = _current(spark, d, ["run_id", "quote_status"]).where("quote_status IS NOT NULL").groupBy(_run().alias("run"), F.col("quote_status").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("run").agg(F.sum("n").alias("total"))
    return c.join(total, "run").where(F.col("n") >= 0.8 * F.col("total")).select("run", "label", "n", "total")


@query(f"""
WITH RECURSIVE b AS (SELECT {_RUN} AS run, quote_status AS v, coalesce(word_count, 0) AS n, row_number() OVER (PARTITION BY {_RUN} ORDER BY block_id) AS i FROM ({_CURRENT})),
m(run, i, v, segment, rows, words) AS (SELECT run, i, v, 1, 1, CAST(n AS BIGINT) FROM b WHERE i = 1
  UNION ALL SELECT b.run, b.i, b.v, CASE WHEN j THEN segment ELSE segment + 1 END, CASE WHEN j THEN rows + 1 ELSE 1 END, CASE WHEN j THEN words + b.n ELSE b.n END FROM (SELECT m.*, b.i AS bi, b.v AS bv, m.v IS NOT DISTINCT FROM b.v AND (b.n < 500 OR m.words < 500) AS j FROM m JOIN b ON b.run = m.run AND b.i = m.i + 1) m JOIN b ON b.run = m.run AND b.i = m.bi)
SELECT run, segment, any_value(v) AS voice, max(rows) AS n_rows, max(words) AS words FROM m GROUP BY run, segment
""")
def merged_segments(spark, d):
    b = _current(spark, d, ["run_id", "quote_status", "word_count"]).select(_run().alias("run"), "block_id", "quote_status", "word_count")
    return S.merged_segments(b, ["run"], ["block_id"], "quote_status", "word_count")


@query(f"""
WITH {_UNITS}, sm AS (SELECT s, sum(v) AS sv, count(*) AS n FROM f GROUP BY s), rk AS (SELECT u, s, row_number() OVER (PARTITION BY u ORDER BY round((sv - v) / (n - 1), 10) DESC, s) AS r FROM f JOIN sm USING (s)) SELECT s AS slot, count(*) AS folds FROM rk WHERE r <= 50 GROUP BY s
""", ints=("slot",))
def fold_ranking(spark, d):
    """In how many folds each slot is among the 50 most frequent, ranked without the held-out unit."""
    top = L.top_slots_by_fold(_units(spark, d), "u", "s", "v", 50)
    return top.groupBy("slot").agg(F.count(F.lit(1)).alias("folds"))


def _counts_sql():
    parts = []
    for k in (50, 100, 150):
        inner = _delta_sql(f"q{k}")
        for name in ("p", "m", "k", "z", "g"):
            inner = inner.replace(f"{name} AS (SELECT", f"{name}{k} AS (SELECT")
        inner = inner.replace("FROM p GROUP", f"FROM p{k} GROUP").replace("FROM k JOIN m ON m.unit = k.unit AND m.s = k.s", f"FROM k{k} k JOIN m{k} m ON m.unit = k.unit AND m.s = k.s").replace("FROM z)", f"FROM z{k})")
        parts.append(f"q{k} AS (SELECT * FROM f WHERE s IN (SELECT s FROM f GROUP BY s ORDER BY round(avg(v), 12) DESC, s LIMIT {k})), {inner}")
    union = " UNION ALL ".join(f"SELECT {k} AS features, count(*) AS n, count(*) FILTER (truth = guess) AS hits FROM g{k}" for k in (50, 100, 150))
    return f"WITH {_UNITS}, {', '.join(parts)} {union}"


@query(_counts_sql())
def feature_counts(spark, d):
    """Hits of Delta with the 50, 100 and 150 most frequent slots."""
    f, out = staged(_units(spark, d), "units"), None
    for k in (50, 100, 150):
        kept = f.join(F.broadcast(L.top_slots(f, "s", "v", k)), "s", "left_semi")  # k rows
        g = L.nearest(L.delta_distances(kept, "u", "l", "s", "v"), "unit", "truth", "label", "delta")
        row = g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("guess")).alias("hits")).withColumn("features", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def jackknife_loo(spark, d):
    """How the balanced accuracy of grouped regression changes without each source."""
    units, x, y, _ = _matrix(spark, d)
    sources, folds = _sources(units), _folds(units, 3)
    names = sorted(set(sources))
    shared = spark.sparkContext.broadcast((x, y, sources, folds))
    whole = L.balanced_accuracy(y, L.held_out_guesses(x, y, folds))

    def work(i):
        x, y, s, g = shared.value
        ok = s != names[i]
        return [(names[i], float(whole - L.balanced_accuracy(y[ok], L.held_out_guesses(x[ok], y[ok], g[ok]))))]

    return L.per_task(spark, list(range(len(names))), work, "source string, influence double")


@query()
def label_predictability(spark, d):
    """Whether units tell their genre or their source better: genre with whole sources held out, source with whole genres."""
    units, x, y, _ = _matrix(spark, d)
    source = np.unique(_sources(units), return_inverse=True)[1]
    shared = spark.sparkContext.broadcast((x, [("genre", y, _folds(units, 3)), ("source", source, y)]))

    def work(i):
        name, label, groups = shared.value[1][i]
        return [(name, float(L.balanced_accuracy(label, L.held_out_guesses(shared.value[0], label, groups))))]

    return L.per_task(spark, [0, 1], work, "label string, balanced_accuracy double")


@query()
def feature_importance(spark, d):
    """The 30 slots with the largest mean absolute coefficient."""
    _, x, y, _ = _matrix(spark, d)
    a, _ = L.scaled(x, x[:1])
    coef, _ = L.fit_logistic(a, y, L.balanced_weights(y))
    weight = np.abs(coef).mean(axis=0)
    order = np.argsort(-weight, kind="stable")[:30]
    return spark.createDataFrame([(int(i), float(weight[i])) for i in order], "slot int, weight double")


def _vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    return table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query()
def forest_importance(spark, d):
    weights = L.forest_importance(_vectors(spark, d), "features", "label", trees=20)
    return spark.createDataFrame(list(enumerate(weights)), "feature int, weight double")


@query()
def svm_one_vs_rest(spark, d):
    return held_out_halves(spark, d, lambda e: L.linear_svm(e, "features", "label"))


@query()
def pca_components(spark, d):
    """Explained variance of the first five principal components."""
    from pyspark.ml.feature import PCA

    model = PCA(k=5, inputCol="features", outputCol="pc").fit(_vectors(spark, d))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.explainedVariance.toArray())], "component int, explained double")


_LINES = "SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY scanned_at DESC) AS r FROM raw_lines) WHERE r = 1"


@query(f"""
WITH l AS ({_LINES}), w0 AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda t: t <> '') AS w FROM l), w1 AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w0),
w2 AS (SELECT doc_id, line_no, b + unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM w1), s AS (SELECT doc_id, CAST(pos // 200 + 1 AS INTEGER) AS segment, min(line_no) AS start_line, max(line_no) AS end_line, CAST(count(*) AS INTEGER) AS n_words, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM w2 GROUP BY ALL HAVING count(*) >= 100),
h AS (SELECT doc_id, line_no AS start, line AS book FROM l WHERE regexp_matches(line, '^CHAPTER [IVXLC]+\\.$')), m AS (SELECT *, (start_line + end_line) // 2 AS mid FROM s),
a AS (SELECT m.*, h.book FROM m ASOF LEFT JOIN h ON m.doc_id = h.doc_id AND m.mid >= h.start), b AS (SELECT a.*, h.book AS b1 FROM a ASOF LEFT JOIN h ON a.doc_id = h.doc_id AND a.start_line >= h.start), c AS (SELECT b.*, h.book AS b2 FROM b ASOF LEFT JOIN h ON b.doc_id = h.doc_id AND b.end_line >= h.start)
SELECT doc_id, segment, start_line, end_line, n_words, digest, book, b1 IS DISTINCT FROM b2 AS spans_boundary FROM c
""")
def line_segments(spark, d):
    from versloom.plans.segment_queries import _HEADING, _lines

    lines = staged(_lines(spark, d), "lines")
    bounds = lines.where(F.col("line").rlike(_HEADING)).select("doc_id", F.col("line_no").alias("start"), F.col("line").alias("book"))
    out = S.line_segments(lines, "doc_id", "line_no", "line", 200, bounds)
    return out.select("doc_id", "segment", "start_line", "end_line", "n_words", F.md5("text").alias("digest"), "book", "spans_boundary")


@query("""
WITH u AS (SELECT event_type, user_id AS unit, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY unit) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM u),
k AS (SELECT boot_id, event_type, CAST('0x' || substr(md5('42|' || boot_id || '|' || event_type || '|' || place), 1, 12) AS BIGINT) % n AS place FROM p, (SELECT unnest(range(0, 20)) AS boot_id)), b AS (SELECT boot_id, avg(v) AS score FROM k JOIN p USING (event_type, place) GROUP BY boot_id)
SELECT count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.05), 6) AS low, round(quantile_cont(score, 0.95), 6) AS high FROM b
""")
def stratified_bootstrap(spark, d):
    from versloom.operators import infer as I

    u = staged(table(spark, d, "events").groupBy("event_type", F.col("user_id").alias("unit")).agg(F.avg("value").alias("v")), "units")
    b = I.bootstrap_draws(u, "unit", 20, ["event_type"]).join(u, ["event_type", "unit"]).groupBy("boot_id").agg(F.avg("v").alias("score"))
    i = I.interval(b, [], "score", level=0.9)
    return i.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("SELECT CAST(least(9, floor(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 10)) AS INTEGER) AS b, count(*) AS n FROM (SELECT value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events WHERE value IS NOT NULL) GROUP BY 1")
def histogram(spark, d):
    """Ten equal bins of all values, the maximum in the last."""
    from versloom.sources.sinks import histogram as bins

    return bins(table(spark, d, "events").where("value IS NOT NULL"), "value", 10).select(F.col("bin").alias("b"), "n").where("n > 0")


@query("""
WITH u AS (SELECT vec_id AS unit, vec_id % 5 AS stratum, label FROM embeddings), r AS (SELECT perm_id, unit, stratum, label, row_number() OVER (PARTITION BY perm_id, stratum ORDER BY unit) AS bn, row_number() OVER (PARTITION BY perm_id, stratum ORDER BY md5('42|' || perm_id || '|' || unit), unit) AS bh FROM u, (SELECT unnest(range(0, 20)) AS perm_id)),
g AS (SELECT a.perm_id, a.unit, c.label FROM r a JOIN r c ON a.perm_id = c.perm_id AND a.stratum = c.stratum AND a.bh = c.bn UNION ALL SELECT -1, unit, label FROM u),
x AS (SELECT vec_id AS unit, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT perm_id, label, i, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM g JOIN x USING (unit) GROUP BY ALL),
w AS (SELECT perm_id, sum(q - s * s / n) AS within, count(DISTINCT label) AS k FROM p GROUP BY perm_id), t AS (SELECT perm_id, sum(q - s * s / n) AS total, max(n) AS n FROM (SELECT perm_id, i, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM p GROUP BY ALL) GROUP BY perm_id),
f AS (SELECT perm_id, round((total - within) / (k - 1) / (within / (n - k)), 6) AS f FROM w JOIN t USING (perm_id))
SELECT o.f AS observed, count(*) AS n, count(*) FILTER (f.f >= o.f) AS exceed, round((count(*) FILTER (f.f >= o.f) + 1) / (count(*) + 1), 9) AS p FROM f, (SELECT f FROM f WHERE perm_id = -1) o WHERE f.perm_id >= 0 GROUP BY o.f
""")
def permanova_p(spark, d):
    """PERMANOVA with labels shuffled within strata: the observed statistic against that of 20 shuffles."""
    from versloom.operators import infer as I, pairs as P

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), (F.col("vec_id") % 5).alias("stratum"), "label", "embedding")
    perms = I.permuted_labels(e.select("unit", "label", "stratum"), "unit", "label", 20, "stratum").select("perm_id", "unit", "label")
    null = P.pseudo_f(perms.join(e.select("unit", "embedding"), "unit"), "label", "embedding", ["perm_id"]).select("perm_id", F.round("f", 6).alias("f"))
    seen = P.pseudo_f(e, "label", "embedding").select(F.round("f", 6).alias("f"))
    return I.exceedance(null, seen, "f", []).select("observed", "n", "exceed", F.round("p", 9).alias("p"))
