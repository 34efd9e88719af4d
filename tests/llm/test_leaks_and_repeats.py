import random

import numpy as np
from pyspark.sql import functions as F

from versloom.functions.words import terms
from versloom.llm import leaks as K, repeats as R


def longest_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (K.MATCH if a[i - 1] == b[j - 1] else K.MISMATCH), h[i - 1, j] + K.GAP, h[i, j - 1] + K.GAP)
    return h.max()


def test_alignment():
    rng = np.random.RandomState(0)
    pairs = [(rng.randint(0, 4, rng.randint(0, 25)), rng.randint(0, 4, rng.randint(1, 25))) for _ in range(80)]
    for (a, b), score, lo, hi, run in zip(pairs, *K.align(*map(list, zip(*pairs, strict=True))), strict=True):
        assert score == smith_waterman(a, b) and run == longest_run(list(a), list(b))
        assert 0 <= lo <= hi <= len(a) and (score == 0 or smith_waterman(a[lo:hi], b) == score)


def test_stretches_lie_apart():
    assert K.stretches([(5, 1), (9, 5), (900, 0)], 20) == [(4 - K.MARGIN, 24 + K.MARGIN), (900 - K.MARGIN, 920 + K.MARGIN)]


def test_leaks_like_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{chr(97 + i)}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(1, 40))) for i in range(30)] + [(98, None), (99, ""), (None, "x")]
    docs = [(i, text(rng.randint(0, 80))) for i in range(80)] + [(900, None), (901, "")]
    for d in range(40):
        t = items[rng.randrange(30)][1].split()
        k = rng.randrange(len(t))
        docs.append((1000 + d, text(5) + " " + " ".join(t[k : k + 14]).upper() + ", " + text(3)))
    df = spark.createDataFrame(docs, "id long, text string").withColumn("score", F.lit("extra")).repartition(3)
    it = spark.createDataFrame(items, "id long, text string")
    got = {(r.id, r.id_item): r.longest_run for r in K.find_leaks(df, "id", "text", it, "id", "text").collect()}
    want = {(d, i) for d, t in docs for i, u in items if i is not None and longest_run(terms(u), terms(t)) >= 12}
    assert {k for k, n in got.items() if n >= 12} == want and want
    assert K.find_leaks(df.limit(0), "id", "text", it, "id", "text").count() == 0
    assert K.find_leaks(df, "id", "text", it.limit(0), "id", "text").count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 20)
    it = spark.createDataFrame([(i, " ".join(f"{chr(97 + i)}{chr(97 + k)}" for k in range(14))) for i in range(8)], "item int, t string")
    df = it.select(F.col("item").cast("long").alias("doc"), F.concat(F.lit("zz "), "t").alias("body"))
    got = K.find_leaks(df, "doc", "body", it, "item", "t").where("longest_run >= 12").collect()
    assert sorted((r.doc, r.item) for r in got) == [(i, i) for i in range(8)]


def test_edited_copy_is_scored(spark):
    words = [f"{a}{b}" for a in "abcdefg" for b in "hijklmn"]
    item = " ".join(words)
    edited = " ".join(w for i, w in enumerate(words) if i % 9 != 5)
    out = K.find_leaks(spark.createDataFrame([(1, edited)], "d int, t string"), "d", "t", spark.createDataFrame([(2, item)], "i int, u string"), "i", "u").first()
    assert out.longest_run < 12 and out.score > len(words)


def test_repeated_terms_by_definition():
    rng = random.Random(3)
    docs = [[rng.choice("abc") for _ in range(rng.randint(0, 60))] for _ in range(200)] + [[], ["a"] * 8, ["a"] * 9, list("abcdefgh") * 2]
    n, again = R.repeated_terms(docs)
    for d, k, r in zip(docs, n, again, strict=True):
        flags = R._repeated_exact(np.array(d), 8) if d else np.zeros(0, bool)
        assert k == len(d) and r == flags.sum()


def test_repetition_table(spark):
    rows = [(1, "Go on. Go on. Stop."), (2, None), (3, ""), (4, "para one\n\npara one\n\nb"), (5, "a b c d e f g h " * 20000)]
    df = spark.createDataFrame(rows, "id int, t string").withColumns({"score": F.lit(1), "n_terms": F.lit("clash"), "_text": F.lit("x")})
    got = {r.id: r for r in R.repetition(df, "t").collect()}
    assert got[2].n_terms == got[3].n_terms == 0 and got[3].phrase_share == 0
    assert abs(got[1].sentence_share - 5 / 15) < 0.1 and got[4].paragraph_share == 8 / 17
    assert got[5].n_terms == 160000 and got[5].repeated_terms == 160000 - 8
    assert R.repetition(df.limit(0), "t").count() == 0


def test_binomial_bounds():
    assert abs(R.binomial_cdf(0, 10, 0.1) - 0.9**10) < 1e-12 and R.binomial_cdf(10, 10, 0.5) == 1
    assert abs(R.upper_bound(0, 59, 0.05) - (1 - 0.05 ** (1 / 59))) < 1e-9


def test_cutoffs_control_the_risk(spark):
    rng = random.Random(4)
    rows = [("big", rng.random() * 0.5, True) for _ in range(3000)] + [("big", 0.6 + rng.random() * 0.4, False) for _ in range(300)] + [("tiny", 0.1, True)] * 5 + [("none", 0.9, False)]
    df = spark.createDataFrame(rows, "s string, score double, good boolean")
    got = {r.stratum: r for r in R.risk_controlled_cutoffs(df, "s", "score", "good", risk=0.02).collect()}
    assert got["big"].certified and 0.45 < got["big"].cutoff <= 0.51 and got["big"].bound <= 0.02
    assert not got["tiny"].certified and got["tiny"].cutoff is None and not got["none"].certified


def test_false_refusals_stay_under_the_risk(spark):
    """Over many holdouts, the true rate at the chosen cutoff is above the risk in at most a share `error` of them."""
    bad, runs = 0, 60
    rng = np.random.RandomState(5)
    for _ in range(runs):
        scores = rng.rand(800)
        counts = np.bincount(np.minimum(100, np.floor(scores * 100 + 1e-9)).astype(int), minlength=101)
        refused, best = 0, 1.0
        for k in range(100, 0, -1):
            refused += counts[k]
            if R.binomial_cdf(int(refused), 800, 0.05) > 0.1:
                break
            best = k / 100
        bad += 1 - best > 0.05
    assert bad / runs < 0.2


def test_edited_copy_with_one_run_of_six(spark, tmp_path):
    """Of 60 terms every sixth is changed but one, so a single run of 6 or more is left: 49 matches, ten changes between them."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"][:60]
    edited = [f"zz{i:02}".translate(str.maketrans("0123456789", "qrstuvwxyz")) if i in (5, 10, 15, 20, 25, 32, 37, 42, 47, 52, 57) else w for i, w in enumerate(words)]
    other = [f"y{w}" for w in words]
    spark.createDataFrame([(1, " ".join(edited)), (3, " ".join(other)), (4, " ".join(other[:6]) + " u v w")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words)), (8, " ".join(other))], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {(r.doc_id, r.item_id): (r.longest_run, r.score) for r in K.p8_leaks(spark, str(tmp_path)).collect()}
    assert got == {(1, 7): (6, smith_waterman(words, edited)), (3, 8): (60, 120)}
    assert [r.doc_id for r in K.p8_found(spark, str(tmp_path)).collect()] == [3]


def test_edited_copies_are_found(spark, folder):
    rows = K.p8_recall(spark, folder).collect()
    assert len(rows) == len(K.EDITS) and all(r.planted == 240 and r.found >= 0.95 * r.copies > 0 for r in rows)


def _letters(prefix, k):
    return F.concat(F.lit(prefix), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(chr(107 + k % 10) + chr(97 + k // 10)))


def _plain_documents(spark, n, first, lang, prefix, more=""):
    text = F.concat_ws(" ", *[_letters(prefix, k) for k in range(60)], F.lit(more))
    return spark.range(n).select((F.col("id") + first).alias("doc_id"), F.lit(lang).alias("lang"), text.alias("text"))


def test_cutoffs_count_every_document(spark, tmp_path):
    """600 documents of a small language are enough for a cutoff, however many others there are; ten are not."""
    docs = _plain_documents(spark, 8000, 0, "en", "p").union(_plain_documents(spark, 600, 10_000, "und", "q")).union(_plain_documents(spark, 10, 20_000, "fr", "r"))
    again = _plain_documents(spark, 5, 30_000, "und", "s", "a b c d e f g h " * 9).union(_plain_documents(spark, 5, 40_000, "fr", "t", "a b c d e f g h " * 9))
    docs.union(again).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.stratum: r for r in R.p9_cutoffs(spark, str(tmp_path)).collect()}
    assert {s: r.certified for s, r in got.items()} == {"en": True, "un": True, "fr": False, "*": True}
    assert all(0.15 < r.cutoff <= 0.3 and r.bound <= 0.02 for r in got.values() if r.certified)
    assert all(r.held_refused <= 0.04 * r.held_good and r.held_caught == r.held_spam for s, r in got.items() if s in ("en", "un"))
    want = sorted([30_000 + i for i in range(5)] + [40_000 + i for i in range(5)])
    assert sorted(r.doc_id for r in R.p9_shares(spark, str(tmp_path)).where("refused").collect()) == want
    assert sorted(r.doc_id for r in R.p9_found(spark, str(tmp_path)).collect()) == want


def test_a_cutoff_changes_what_is_found(spark, tmp_path, monkeypatch):
    docs = _plain_documents(spark, 6, 0, "en", "p", "a b c d e f g h " * 6).union(_plain_documents(spark, 6, 10, "de", "q", "a b c d e f g h " * 6))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert R.p9_found(spark, str(tmp_path)).count() == 12  # nothing certified: the exact check alone
    cut = spark.createDataFrame([("en", 0.9), ("de", None), ("*", 0.3)], "stratum string, cutoff double")
    monkeypatch.setattr(R, "risk_controlled_cutoffs", lambda *a, **k: cut)
    assert sorted(r.doc_id for r in R.p9_found(spark, str(tmp_path)).collect()) == list(range(10, 16))


def test_planted_cases_have_the_share_of_their_label():
    rng = random.Random(11)
    spam = wrong = 0
    for _ in range(300):
        base = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(30, 300))]
        case = R.planted_case(base, np.zeros(len(base), bool))
        assert (case is None) == (len(base) < R.CASE)
        if case:
            n, again = R.repeated_terms([case[0]])
            # a copy put into another one breaks it, so spam may measure a little less
            wrong += case[1] != (again[0] >= R.SPAM * n[0])
            assert case[1] or again[0] < R.SPAM * n[0]
            spam += case[1]
    assert 40 < spam < 110 and wrong < 0.1 * spam


def test_binomial_sum_over_many():
    for n, p in ((50, 0.02), (400, 0.3), (1000, 0.7)):
        total = 0.0
        for k in range(n):
            total += R.exp(R.lgamma(n + 1) - R.lgamma(k + 1) - R.lgamma(n - k + 1) + k * R.log(p) + (n - k) * R.log(1 - p))
            assert abs(R.binomial_cdf(k, n, p) - total) < 1e-9
    assert abs(R.binomial_cdf(600_000, 30_000_000, 0.02) - 0.5) < 0.001
