import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versloom.functions import statistics as st
from versloom.operators import groups as G, infer as I, joins as J, learn as L, pairs as P
from versloom.plans import join_queries as Q2, more_queries as M, study_queries as Q


def test_t_distribution():
    assert abs(st.t_cdf(2.228138852, 10) - 0.975) < 1e-8
    assert abs(st.t_quantile(0.95, 5) - 2.015048373) < 1e-6
    assert abs(st.t_cdf(0, 3) - 0.5) < 1e-12


def test_published_numbers():
    """Counts and p-values whose results are known."""
    assert st.arrangements([4, 5, 2, 3]) == 2_522_520
    r = st.tost(0.25, 0.1, 14, 0.25, 0.15)
    assert r["equivalent"] and abs(r["p_lower"] - r["p_upper"]) < 1e-9


def test_false_discovery(spark):
    ps = [0.549, 0.176, 0.5, 0.353, 0.137, 0.255]
    df = spark.createDataFrame([(p,) for p in [*ps, None]], "p double")
    got = {r.p: round(r.p_adjusted, 3) for r in I.false_discovery(df, [], "p").collect()}
    order = sorted(ps)
    want, least = {}, 1.0
    for i in range(len(order), 0, -1):
        least = min(least, order[i - 1] * len(order) / i)
        want[order[i - 1]] = round(least, 3)
    assert got == want


def test_baselines(spark):
    rows = [("a",)] * 171 + [("b",)] * 39 + [("c",)] * 22 + [("d",)] * 12
    b = G.baselines(spark.createDataFrame(rows, "l string"), "l").first()
    assert (b.majority, round(b.majority_share, 5), round(b.stratified, 5), round(b.trivial_f1, 5)) == ("a", 0.70082, 0.52724, 0.20602)


def test_permutations_keep_strata(spark):
    u = spark.createDataFrame([(f"u{i}", "xyz"[i % 3], i // 4) for i in range(21)], "unit string, label string, s int")
    p = I.permuted_labels(u, "unit", "label", 20, "s")
    assert p.count() == 420
    counts = p.groupBy("perm_id", "s", "label").count().groupBy("s", "label").agg(F.count_distinct("count").alias("d"), F.max("count").alias("c")).collect()
    own = {(r.s, r.label): r["count"] for r in u.groupBy("s", "label").count().collect()}
    assert all(r.d == 1 and own[r.s, r.label] == r.c for r in counts)
    single = p.where("s = 5").select("label").distinct().collect()
    assert len(single) == 1
    assert I.distinct_permutations(I.permuted_labels(u.limit(3), "unit", "label", 50), "unit", "label", 100).select("perm_id").distinct().count() <= 6


def test_kept_columns_stay_with_their_unit(spark):
    rows = [(f"u{i:02d}", "xyz"[i % 3], i % 2, float(i)) for i in range(20)]
    u = spark.createDataFrame(rows, "unit string, label string, s int, v double")
    for stratum in (None, "s"):
        want = set()
        for k in range(5):
            for t in {r[2] for r in rows} if stratum else {None}:
                own = [r for r in rows if t in (None, r[2])]
                by_hash = sorted(own, key=lambda r: hashlib.md5(f"42|{k}|{r[0]}".encode()).hexdigest())
                want |= {(k, b[0], a[1], b[3]) for a, b in zip(own, by_hash, strict=True)}
        p = I.permuted_labels(u, "unit", "label", 5, stratum, keep=("v",))
        assert {(r.perm_id, r.unit, r.label, r.v) for r in p.collect()} == want


def rows_broadcast(df):
    """The most rows that a broadcast of the finished plan collected on the driver."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name, kids = p.nodeName(), p.children()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif name.startswith("BroadcastExchange"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


@pytest.mark.parametrize("name", ["blocked_perm_pvalue", "bootstrap_ci_hash", "perm_table_hash", "blocked_perm_table", "maxt_pvalue", "perm_pvalue"])
def test_replicates_are_not_broadcast(name, spark, folder):
    """One row of results a replicate and group may reach the driver, but not the replicates of the units."""
    assert rows_broadcast(getattr(Q, name)(spark, folder)) <= 150


def test_bootstrap_and_interval(spark):
    u = spark.range(30).withColumnRenamed("id", "unit")
    b = I.bootstrap_draws(u, "unit", 40)
    assert b.groupBy("boot_id").count().where("count = 30").count() == 40
    rows = [("b", 1.0), (None, 2.0), ("a", 3.0)]
    k = I.bootstrap_draws(spark.createDataFrame(rows, "unit string, v double"), "unit", 20, keep=("v",))
    pick = lambda b, d: [("a", 3.0), ("b", 1.0), (None, 2.0)][int(hashlib.md5(f"42|{b}|{d}".encode()).hexdigest()[:12], 16) % 3]
    assert {(r.boot_id, r.draw, r.unit, r.v) for r in k.collect()} == {(i, d, *pick(i, d)) for i in range(20) for d in range(3)}
    v = spark.createDataFrame([(float(i),) for i in range(101)], "s double")
    i = I.interval(v, [], "s").first()
    assert (round(i.low, 9), round(i.high, 9), i.mean) == (2.5, 97.5, 50.0)
    assert I.interval(v, [], "s", expected=200).first().low is None


def test_exceedance_and_maxt(spark):
    null = spark.createDataFrame([(p, v, float(p if v == "a" else 9 - p)) for p in range(10) for v in "ab"], "perm_id int, variant string, s double")
    obs = spark.createDataFrame([("a", 8.0), ("b", 2.0)], "variant string, s double")
    e = {r.variant: r for r in I.exceedance(null, obs, "s", ["variant"]).collect()}
    assert (e["a"].exceed, e["b"].exceed) == (2, 8) and abs(e["a"].p - 3 / 11) < 1e-12
    assert abs(I.exceedance(null, obs, "s", ["variant"], plus_one=False).where("variant = 'a'").first().p - 0.2) < 1e-12
    m = {r.variant: r.p_adjusted for r in I.max_statistic(null, obs, "variant", "s").collect()}
    assert abs(m["a"] - 5 / 11) < 1e-12 and m["b"] == 1.0


def delta_by_hand(x, y):
    out = []
    for i in range(len(x)):
        t = np.arange(len(x)) != i
        mu, sd = x[t].mean(0), x[t].std(0, ddof=1)
        sd[sd == 0] = 1
        z = (x - mu) / sd
        out.append(min(sorted(set(y)), key=lambda k: (round(float(np.abs(z[i] - z[t & (y == k)].mean(0)).mean()), 12), k)))
    return out


def test_delta(spark):
    rng = np.random.RandomState(0)
    y = np.array(["a", "b", "c"] * 4)
    x = rng.rand(12, 7) + (y == "b")[:, None] * 0.3
    x[:, 3] = 1.0
    f = spark.createDataFrame([(f"u{i:02}", y[i], s, float(x[i, s])) for i in range(12) for s in range(7)], "u string, l string, s int, v double")
    got = [r.guess for r in L.nearest(L.delta_distances(f, "u", "l", "s", "v"), "unit", "truth", "label", "delta").orderBy("unit").collect()]
    assert got == delta_by_hand(x, y)


def test_logistic_is_optimal():
    rng = np.random.RandomState(1)
    x, y = rng.randn(11, 40), np.array([0, 1, 2] * 3 + [0, 1])
    w = L.balanced_weights(y)
    coef, b = L.fit_logistic(x, y, w, c=0.7)
    m = x @ coef.T + b
    p = np.exp(m - m.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    g = (w[:, None] * (p - np.eye(3)[y])).T @ x + coef / 0.7
    assert np.abs(g).max() < 1e-6 and np.abs((w[:, None] * (p - np.eye(3)[y])).sum(0)).max() < 1e-6


def test_mllib_has_the_same_optimum(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.RandomState(2)
    x, y = rng.randn(30, 4), rng.randint(0, 3, 30)
    df = spark.createDataFrame([(Vectors.dense(a), float(k)) for a, k in zip(x, y, strict=True)], ["f", "l"])
    m = L.logistic_model(df, "f", "l", c=0.5)
    coef, _ = L.fit_logistic(x, y, np.ones(30), c=0.5)
    assert np.abs((m.coefficientMatrix.toArray() - m.coefficientMatrix.toArray().mean(0)) - (coef - coef.mean(0))).max() < 1e-3


def test_controls():
    """A planted signal is found, labels without one give chance."""
    rng = np.random.RandomState(3)
    y, groups = np.arange(60) % 2, np.arange(60) // 6
    strong = rng.randn(60, 10) + 3 * y[:, None]
    assert L.balanced_accuracy(y, L.held_out_guesses(strong, y, groups)) > 0.95
    weak = [L.balanced_accuracy(y, L.held_out_guesses(rng.randn(60, 10), y, groups)) for _ in range(8)]
    assert 0.35 < np.mean(weak) < 0.65
    curve = L.unmasking(strong[:, :8], y, groups, rounds=3, drop=3)
    assert [k for _, _, k in curve] == [8, 5]
    assert (L.held_out_guesses(strong[:6], np.array([0, 0, 0, 1, 1, 1]), np.array([1, 1, 1, 2, 2, 2])) == -1).all()


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a", 1), ("a", "b", 1), ("b", "b", 2), ("c", "a", 3)], "t string, g string, run int")
    m = {r.label: r for r in G.class_metrics(df, "t", "g").collect()}
    assert (m["a"].recall, m["a"].precision, m["c"].f1) == (0.5, 0.5, 0.0)
    assert abs(G.summary_metrics(df, "t", "g").first().balanced_accuracy - 0.5) < 1e-12
    assert G.confusion(df, "t", "g").count() == 9
    assert G.grouped_folds([("a", 5), ("b", 4), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert G.upper_median(df, ["t"], "run").where("t = 'a'").first().median == 1


def test_cosine_moments_like_pairs(spark):
    rng = np.random.RandomState(4)
    v = rng.randn(40, 5)
    df = spark.createDataFrame([(i, i % 2, [float(a) for a in v[i]]) for i in range(40)] + [(99, 0, [0.0] * 5)], "i int, l int, e array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {r.l: r for r in P.cosine_moments(df, "l", "e").collect()}
    ext = {r.label: r for r in P.cosine_extremes(df, "i", "l", "e", block=7).collect()}
    for k in (0, 1):
        d = [1 - u[i] @ u[j] for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2 == k]
        assert abs(got[k].mean - np.mean(d)) < 1e-9 and abs(got[k].sd - np.std(d)) < 1e-9 and got[k].pairs == len(d)
        assert abs(ext[k].least - min(d)) < 1e-12 and abs(ext[k].most - max(d)) < 1e-12


def test_lookups_and_sets(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 15.0), (2, 1, None)], "a int, b int, x double")
    first = spark.createDataFrame([(1, 2, "exact")], "a int, b int, v string")
    second = spark.createDataFrame([(1, "by a")], "a int, v string")
    got = {(r.a, r.b): r.v for r in J.override_lookup(df, [(first, ["a", "b"]), (second, ["a"])], "v", "none").collect()}
    assert got == {(1, 1): "by a", (1, 2): "exact", (2, 1): "none"}
    bands = spark.createDataFrame([(0.0, 10.0, "low"), (10.0, 15.0, "mid")], "lo double, hi double, band string")
    assert [r.band for r in J.range_lookup(df, "x", bands, "lo", "hi", "band").orderBy("a", "b").collect()] == ["low", None, None]
    j = J.set_relation(spark.createDataFrame([("a",), ("b",), (None,)], "v string"), spark.createDataFrame([("b",), ("c",)], "v string"))
    assert {r.value: r.place for r in j.collect()} == {"a": "left", "b": "both", "c": "right"}
    m = J.best_match(spark.createDataFrame([("the old book",), ("",), (None,)], "x string"), spark.createDataFrame([("the old books",), ("the new book",)], "y string"), "x", "y").collect()
    assert [(r.x, r.y) for r in m] == [("the old book", "the old books")]
    a = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(10)], "k int, l string")
    assert J.agreement(a, a, ["k"], "l").first().kappa == 1.0


@pytest.mark.parametrize("n, d, k", [(60, 40, 8), (120, 169, 4)])
def test_logistic_by_conjugate_gradients(n, d, k):
    rng = np.random.RandomState(7)
    x, y = rng.randn(n, d), np.arange(n) % k
    w = L.balanced_weights(y)
    coef, b = L.fit_logistic(x, y, w)
    m = x @ coef.T + b
    p = np.exp(m - m.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.abs((w[:, None] * (p - np.eye(k)[y])).T @ x + coef).max() < 1e-6


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """Four sources, each with its own function words, in three genres and five ways to state a language."""
    at = str(tmp_path_factory.mktemp("study"))
    words = {"a": "the the of", "b": "and and in", "c": "to to that", "x/d": "was was his"}
    rows = [(s, g, lang, f"{w} {g} {'with' if g == 'g1' else 'for' if g == 'g2' else 'not'}") for s, w in words.items() for g in ("g1", "g2", "g3") for lang in ("en", "EN", "de", None, "und")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, genre string, lang string, text string")
    df.write.parquet(f"{at}/documents.parquet")
    return at


def test_matrix_has_all_languages(spark, study):
    units, x, y, labels = Q._matrix(spark, study)
    assert sorted(units) == sorted(f"{s}/{g}/{lang}" for s in ("a", "b", "c", "x/d") for g in ("g1", "g2", "g3") for lang in ("en", "de", "?", "un"))
    assert {r.unit for r in Q.logit_loo(spark, study).collect()} == set(units) and labels == ["g1", "g2", "g3"]


def test_folds_keep_sources_whole(spark, study):
    units = Q._matrix(spark, study)[0]
    for k in (3, 5):
        folds = Q._folds(units, k)
        assert len(set(folds)) == min(k, 4) and len(set(zip(Q._sources(units), folds, strict=True))) == 4


def test_source_is_predicted_as_it_is(spark, study):
    got = {r.label: r.balanced_accuracy for r in M.label_predictability(spark, study).collect()}
    assert got == {"genre": 1.0, "source": 1.0}


def test_number_of_permutations(spark, study):
    rows = Q.logit_perm_null(spark, study, permutations=30).collect()
    assert sorted(r.perm_id for r in rows) == list(range(31)) and max(rows, key=lambda r: r.score).perm_id == 0
    assert Q.logit_perm_null.__defaults__ == (24,)


def test_best_match_without_a_common_word(spark):
    a, b = spark.createDataFrame([("Kafoze",), ("thé óld bóok",)], "x string"), spark.createDataFrame([("Kafose",), ("the old book",), ("zzzzzz",)], "y string")
    assert {r.x: r.y for r in J.best_match(a, b, "x", "y").collect()} == {"Kafoze": "Kafose", "thé óld bóok": "the old book"}
    assert J.best_match(a, b, "x", "y", common_word=True).count() == 0


def test_best_match_like_brute_force(spark, tmp_path):
    """Accents, words that all have a changed letter, and titles of one parity: nothing above the threshold is lost."""
    rng = random.Random(8)
    titles = ["Of thé Humblé Kíndréd", "Of the Humble Kindred", "Kafoze", "Kafose", "a", "b", "ab", "İstanbul", "istanbul", "aaaaaaaaaa", "aaaaaaaaab", "", None]
    for _ in range(60):
        t = "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 24))).strip()
        titles += [t, "".join(rng.choice("abé") if rng.random() < 0.2 else c for c in t)]
    df = spark.createDataFrame([(2 * i + 1, t) for i, t in enumerate(titles)], "gutenberg_id long, title string")
    df.write.parquet(f"{tmp_path}/works_manifest.parquet")
    texts = df.select(F.col("title").alias("text")).where("title <> ''").distinct()
    near = 1 - F.levenshtein(F.lower("text"), F.lower("other")) / F.greatest(F.length("text"), F.length("other"))
    want = {}
    for r in texts.crossJoin(texts.toDF("other")).where("text <> other").withColumn("s", F.round(near, 9)).where("s >= 0.7").collect():
        want[r.text] = min(want.get(r.text, (0, "")), (-r.s, r.other))
    got = {r.text: (-r.similarity, r.other) for r in Q2.fuzzy_best_match(spark, str(tmp_path)).collect()}
    assert got == want and {"Kafoze", "Of thé Humblé Kíndréd"} <= set(got)


def test_histogram_keeps_the_maximum(spark, tmp_path):
    spark.createDataFrame([(min(float(i), 20.0),) for i in range(30)] + [(None,)], "value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.b: r.n for r in M.histogram(spark, str(tmp_path)).collect()}
    assert got == {b: 12 if b == 9 else 2 for b in range(10)}


def test_study_goes_on(spark, study, tmp_path):
    """Every job is scored once, the true labels beat their nulls, and a second run does nothing anew."""
    from versloom import study as W

    docs = spark.read.parquet(f"{study}/documents.parquet").withColumn("lang", F.coalesce("lang", F.lit("?")))
    variants = W.document_variants(docs)
    settings = W.Settings(permutations=8, bootstraps=6, penalties=(1.0,), folds=3)
    scores = W.run_study(spark, variants, settings, str(tmp_path / "scores"), batch=30).orderBy("perm_id").collect()
    assert [r.perm_id for r in scores] == list(range(len(W.jobs_of(variants, settings))))
    again = W.run_study(spark, variants, settings, str(tmp_path / "scores"), batch=30)
    assert again.orderBy("perm_id").collect() == scores
    rows = W.summary(again, settings).collect()
    assert {(r.variant, r.test) for r in rows} == {(v, t) for v in ("words", "first_50", "trigrams") for t in ("permuted", "blocked")}
    assert all(1 / 9 - 1e-9 <= r.p <= r.p_family + 1e-9 <= 1 + 1e-9 and r.p <= r.p_adjusted for r in rows)
    assert next(r for r in rows if r.variant == "trigrams" and r.test == "permuted").observed == 1.0
    kinds = {r.detail for r in W.contrasts(again).where("kind = 'classes'").collect()}
    assert kinds == {"g1 | g2", "g1 | g3", "g2 | g3"}
    assert "## Tests" in W.study_report(again, settings)


def test_redraws_and_shuffles():
    from versloom import study as W

    y, strata = np.array([0, 0, 1, 1, 2, 2, 2]), np.array([0, 0, 0, 1, 1, 1, 1])
    rng = np.random.RandomState(0)
    for _ in range(20):
        assert (np.bincount(y[W.redrawn(y, rng)]) == np.bincount(y)).all()
        mixed = W.shuffled(y, strata, rng)
        assert all(sorted(mixed[strata == s]) == sorted(y[strata == s]) for s in (0, 1))


def test_study_from_the_command_line(spark, study, tmp_path):
    from versloom import study as W

    assert W.main([study, str(tmp_path), "--quick", "--permutations", "3", "--bootstraps", "2"]) == 0
    assert spark.read.json(f"{tmp_path}/summary").count() == 6
    assert spark.read.text(f"{tmp_path}/report", wholetext=True).first()[0].startswith("# Study")
