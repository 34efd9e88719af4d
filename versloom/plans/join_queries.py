"""Joins, set operations and tables of counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from versloom.operators import groups as G
from versloom.operators import joins as J
from versloom.operators import sequences as S
from versloom.plans.registry import query
from versloom.plans.segment_queries import _CURRENT, _RUN, _current, _run
from versloom.plans.text_queries import _LANG, _lang
from versloom.tables import table


@query("""
SELECT r_name || ' / ' || n_name || ' / ' || c_name AS title, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
""")
def hierarchy_view(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.concat_ws(" / ", "r_name", "n_name", "c_name").alias("title"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")


@query("""
SELECT s_suppkey, coalesce(CASE WHEN s_nationkey = 3 AND s_suppkey % 2 = 0 THEN 'special' END, CASE WHEN n_regionkey = 1 THEN 'region one' END, r_name, 'UNKNOWN') AS narrator
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2
""")
def override_lookup(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey", "left").withColumn("even", F.col("s_suppkey") % 2)
    verse = spark.createDataFrame([(3, 0, "special")], "s_nationkey int, even long, narrator string")
    chapter = spark.createDataFrame([(1, "region one")], "n_regionkey int, narrator string")
    book = table(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("narrator"))
    return J.override_lookup(s, [(verse, ["s_nationkey", "even"]), (chapter, ["n_regionkey"]), (book, ["n_regionkey"])], "narrator", "UNKNOWN").select("s_suppkey", "narrator")


@query("""
WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT p.event_id, s.event_id AS signup_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts
""")
def asof_lookup(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    out = S.floor_lookup(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'signup'"), ["user_id"], "ts", "ts", "event_id", "signup_id")
    return out.select("event_id", "signup_id")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= -1000 AND c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN 'low' WHEN c_acctbal >= 5000 AND c_acctbal < 7500 THEN 'high' END AS band FROM customer
""")
def range_lookup(spark, d):
    bands = spark.createDataFrame([(-1000.0, 0.0, "debt"), (0.0, 2500.0, "low"), (5000.0, 7500.0, "high")], "low double, high double, band string")
    return J.range_lookup(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", bands, "low", "high", "band").select("c_custkey", "band")


@query()
def fuzzy_best_match(spark, d):
    """For each title, in whatever letters, the most similar other title of the whole table."""
    works = table(spark, d, "works_manifest")
    return J.best_match(works.select(F.col("title").alias("text")), works.select(F.col("title").alias("other")), "text", "other", equal=False).withColumn("similarity", F.round("similarity", 9))


def _scored(spark, d, scorer):
    s = table(spark, d, "block_scores").where((F.col("scorer") == scorer) & F.col("score").isNotNull())
    return s.groupBy("block_id").agg(F.max("score").alias("score")).select("block_id", (F.col("score") >= 0.5).alias("good"))


@query("""
WITH s AS (SELECT block_id, scorer, max(score) >= 0.5 AS good FROM block_scores WHERE score IS NOT NULL GROUP BY ALL), j AS (SELECT a.good AS x, b.good AS y FROM s a JOIN s b ON a.block_id = b.block_id AND a.scorer = 'auto' AND b.scorer = 'panel'),
t AS (SELECT count(*) AS n, count(*) FILTER (x = y) AS matches, count(*) FILTER (x) AS px, count(*) FILTER (y) AS py FROM j)
SELECT n, matches, round(matches / n, 9) AS rate, round((matches / n - (px * py + (n - px) * (n - py)) / (n * n)) / (1 - (px * py + (n - px) * (n - py)) / (n * n)), 9) AS kappa FROM t
""")
def annotation_agreement(spark, d):
    a = J.agreement(_scored(spark, d, "auto"), _scored(spark, d, "panel"), ["block_id"], "good")
    return a.select("n", "matches", F.round("rate", 9).alias("rate"), F.round("kappa", 9).alias("kappa"))


@query("""
WITH a AS (SELECT DISTINCT author AS value FROM works_manifest WHERE author IS NOT NULL), b AS (SELECT DISTINCT author AS value FROM control_corpora WHERE author IS NOT NULL)
SELECT value, CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN 'both' WHEN a.value IS NOT NULL THEN 'left' ELSE 'right' END AS place FROM a FULL JOIN b USING (value)
""")
def set_relation(spark, d):
    return J.set_relation(table(spark, d, "works_manifest").select("author"), table(spark, d, "control_corpora").select("author"))


@query("SELECT DISTINCT source AS value FROM documents WHERE lang = 'en' INTERSECT SELECT DISTINCT source FROM documents WHERE lang = 'de'")
def set_intersect(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en'").select(F.col("source").alias("value")).intersect(docs.where("lang = 'de'").select("source"))


@query("SELECT DISTINCT source AS value FROM documents EXCEPT SELECT DISTINCT source FROM documents WHERE genre = 'sermon' AND lang = 'fr'")
def set_except(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("value")).exceptAll(docs.limit(0).select("source")).distinct().subtract(docs.where("genre = 'sermon' AND lang = 'fr'").select("source"))


@query("SELECT voice AS value FROM documents UNION SELECT voice FROM voice_blocks")
def set_union(spark, d):
    return table(spark, d, "documents").select(F.col("voice").alias("value")).union(table(spark, d, "voice_blocks").select("voice")).distinct()


@query(f"""
WITH b AS (SELECT {_RUN} AS run, voice FROM ({_CURRENT}) WHERE voice IS NOT NULL), c AS (SELECT run, voice, count(*) AS n FROM b GROUP BY ALL)
SELECT run AS fold, voice, n AS held_out, CAST(sum(n) OVER (PARTITION BY voice) - n AS BIGINT) AS train FROM c
""")
def held_out_sizes(spark, d):
    """Leave-one-group-out: blocks of a fold's voices that are held out and that train it, as totals less its own, so that no pairs are made."""
    c = _current(spark, d, ["run_id", "voice"]).where("voice IS NOT NULL").groupBy(_run().alias("fold"), "voice").agg(F.count(F.lit(1)).alias("held_out"))
    totals = c.groupBy("voice").agg(F.sum("held_out").alias("total"))
    return c.join(totals, "voice").select("fold", "voice", "held_out", (F.col("total") - F.col("held_out")).alias("train"))


@query(f"SELECT source, {_LANG} AS lang, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def contingency(spark, d):
    return G.contingency(table(spark, d, "documents").where("source IS NOT NULL").select("source", _lang("lang").alias("lang")), "source", "lang")


@query("""
SELECT source, count(*) FILTER (genre = 'poem') AS poem, count(*) FILTER (genre = 'novel') AS novel, count(*) FILTER (genre = 'sermon') AS sermon FROM documents GROUP BY source
""")
def contingency_pivot(spark, d):
    p = table(spark, d, "documents").groupBy("source").pivot("genre", ["poem", "novel", "sermon"]).agg(F.count(F.lit(1)))
    return p.na.fill(0, ["poem", "novel", "sermon"])


@query("""
WITH b AS (SELECT DISTINCT voice, book FROM voice_blocks WHERE voice IS NOT NULL AND book IS NOT NULL), e AS (SELECT DISTINCT voice, unnest(string_split(book, '/')) AS book FROM b)
SELECT count(DISTINCT voice) AS rows, count(DISTINCT book) AS columns, count(*) AS filled, round(1 - count(*) / (count(DISTINCT voice) * count(DISTINCT book)), 9) AS index FROM e
""")
def collinearity(spark, d):
    cells = G.contingency(table(spark, d, "voice_blocks").where("voice IS NOT NULL AND book IS NOT NULL").select("voice", "book"), "voice", "book", "/")
    return G.collinearity(cells, "voice", "book").withColumn("index", F.round("index", 9))


@query(f"WITH b AS ({_CURRENT}) SELECT coalesce(string_split(book, '/')[1], 'Unknown') AS stratum, count(*) AS n FROM b GROUP BY 1")
def strata(spark, d):
    return G.strata(_current(spark, d, ["book"]), "book").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT genre, count(*) AS c FROM documents WHERE genre IS NOT NULL GROUP BY genre), t AS (SELECT sum(c) AS n, count(*) AS k, max(c) AS m, sum(c * c) AS s FROM c)
SELECT CAST(n AS BIGINT) AS n, k AS classes, (SELECT genre FROM c ORDER BY c DESC, genre LIMIT 1) AS majority, round(m / n, 9) AS majority_share, round(1 / k, 9) AS uniform, round(s / (n * n), 9) AS stratified, round(2 * (m / n) / (m / n + 1) / k, 9) AS trivial_f1 FROM t
""")
def class_baselines(spark, d):
    b = G.baselines(table(spark, d, "documents").where("genre IS NOT NULL"), "genre")
    return b.select("n", "classes", "majority", *[F.round(c, 9).alias(c) for c in ("majority_share", "uniform", "stratified", "trivial_f1")])


@query(f"""
WITH b AS (SELECT voice, word_count FROM ({_CURRENT}) WHERE word_count IS NOT NULL), r AS (SELECT voice, word_count, row_number() OVER (PARTITION BY voice ORDER BY word_count) AS r, count(*) OVER (PARTITION BY voice) AS n FROM b)
SELECT voice, word_count AS median FROM r WHERE r = n // 2 + 1
""")
def upper_median(spark, d):
    return G.upper_median(_current(spark, d, ["voice", "word_count"]), ["voice"], "word_count")


@query("""
SELECT author, CASE WHEN grouping(author) = 1 THEN 'total' ELSE 'author' END AS level, count(*) AS works, CAST(sum(word_count) AS BIGINT) AS words FROM works_manifest GROUP BY ROLLUP (author)
""")
def corpus_rollup(spark, d):
    m = table(spark, d, "works_manifest")
    return m.rollup("author").agg(F.when(F.grouping("author") == 1, "total").otherwise("author").alias("level"), F.count(F.lit(1)).alias("works"), F.sum("word_count").alias("words"))


@query("SELECT filename, title FROM works_manifest WHERE filename IN (SELECT filename FROM voice_blocks)")
def sampled_keys(spark, d):
    """Drawn keys collapse: a work comes out once however many blocks name it."""
    return J.with_sampled(table(spark, d, "works_manifest").select("filename", "title"), table(spark, d, "voice_blocks"), "filename")


@query(f"""
WITH b AS ({_CURRENT}), f AS (SELECT block_id, 'doubtful' AS quote_status FROM block_scores GROUP BY block_id HAVING max(score) < 0.5)
SELECT block_id, coalesce(f.quote_status, b.quote_status) AS quote_status, f.quote_status IS NOT NULL AND f.quote_status IS DISTINCT FROM b.quote_status AS fixed FROM b LEFT JOIN f USING (block_id)
""")
def corrected_blocks(spark, d):
    """Blocks with a list of corrections by id: those never scored a half or more become doubtful."""
    low = table(spark, d, "block_scores").groupBy("block_id").agg(F.max("score").alias("s")).where("s < 0.5").select("block_id", F.lit("doubtful").alias("quote_status"))
    return J.corrected(_current(spark, d, ["quote_status"]), "block_id", low, ["quote_status"]).select("block_id", "quote_status", "fixed")
