"""Order: runs, blocks, chunks, folds, lookups along a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from versloom.operators import sequences as S
from versloom.plans.registry import query
from versloom.tables import latest_rows, table

_CURRENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) AS r FROM voice_blocks) WHERE r = 1"
_RUN = "CAST(regexp_replace(run_id, '[^0-9]', '', 'g') AS BIGINT)"


def _current(spark, d, columns):
    return latest_rows(table(spark, d, "voice_blocks").select("block_id", "ingested_at", *columns), "block_id", "ingested_at", columns)


def _run(col="run_id"):
    return F.regexp_replace(col, "[^0-9]", "").cast("bigint")


def _verses(spark, d):
    """The verses of the current blocks in order: run, block, place, reference, words."""
    b = _current(spark, d, ["run_id", "verse_refs"])
    return b.select(_run().alias("run"), "block_id", F.posexplode("verse_refs").alias("at", "v")).select("run", "block_id", "at", F.col("v.reference").alias("ref"), F.col("v.word_count").alias("words"))


_VERSES = f"""v0 AS (SELECT {_RUN} AS run, block_id, unnest(range(0, len(verse_refs))) AS pos, unnest(verse_refs) AS v FROM ({_CURRENT})),
v AS (SELECT run, block_id, pos, v.reference AS ref, coalesce(v.word_count, 0) AS words, row_number() OVER (PARTITION BY run ORDER BY block_id, pos) AS i FROM v0)"""

_EVENT_RUNS = """e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM e)"""


@query(f"""
WITH {_EVENT_RUNS}
SELECT user_id, CAST(run_no AS INTEGER) AS run_no, min_by(event_type, event_id) AS event_type, min(event_id) AS first_event_id, max_by(event_id, (ts, event_id)) AS last_event_id, count(*) AS n_rows FROM r GROUP BY user_id, run_no
""")
def voice_runs(spark, d):
    t = S.run_table(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], ["event_id"])
    return t.select("user_id", "run_no", "event_type", "first_event_id", "last_event_id", "n_rows")


@query(f"""
WITH {_EVENT_RUNS}, t AS (SELECT user_id, run_no, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run_no)
SELECT event_type, count(*) AS runs, max(n) AS longest, round(avg(n), 9) AS mean_rows FROM t GROUP BY event_type ORDER BY runs DESC
""")
def run_stats(spark, d):
    t = S.run_table(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], [])
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.max("n_rows").alias("longest"), F.round(F.avg("n_rows"), 9).alias("mean_rows")).orderBy(F.desc("runs"))


def _greedy(target):
    sql = f"""
WITH RECURSIVE {_VERSES},
g(run, i, ref, words, acc, no, first_ref, n) AS (
  SELECT run, i, ref, words, CAST(words AS BIGINT), 1, ref, 1 FROM v WHERE i = 1
  UNION ALL SELECT v.run, v.i, v.ref, v.words, CASE WHEN g.acc >= {target} THEN v.words ELSE g.acc + v.words END, CASE WHEN g.acc >= {target} THEN g.no + 1 ELSE g.no END,
    CASE WHEN g.acc >= {target} THEN v.ref ELSE g.first_ref END, CASE WHEN g.acc >= {target} THEN 1 ELSE g.n + 1 END FROM g JOIN v ON v.run = g.run AND v.i = g.i + 1),
b AS (SELECT run, no, max(acc) AS w, max_by(ref, i) AS last_ref, any_value(first_ref) AS first_ref, max(n) AS n FROM g GROUP BY run, no),
c AS (SELECT *, max(no) OVER (PARTITION BY run) AS last_no FROM b),
k AS (SELECT run, last_no AS no, w, last_ref, n FROM c WHERE no = last_no AND w < 300 AND last_no > 1)
SELECT c.run, CAST(c.no AS INTEGER) AS block_no, c.first_ref, coalesce(k.last_ref, c.last_ref) AS last_ref, CAST(c.n + coalesce(k.n, 0) AS INTEGER) AS n_rows, CAST(c.w + coalesce(k.w, 0) AS BIGINT) AS word_count,
c.no = c.last_no AND c.w < {target} AND c.w >= 300 AS is_remainder, c.last_no = 1 AND c.w < 300 AS is_undersized, k.run IS NOT NULL AS merged_remainder
FROM c LEFT JOIN k ON k.run = c.run AND k.no = c.no + 1 WHERE NOT (c.no = c.last_no AND c.w < 300 AND c.last_no > 1) AND c.w > 0"""

    @query(sql, name=f"greedy_blocks_{target}")
    def blocks(spark, d):
        return S.greedy_blocks(_verses(spark, d), "run", ["block_id", "at"], "ref", "words", target)

    return blocks


for _t in (500, 1000, 2000):
    _greedy(_t)


@query(f"""
WITH b AS ({_CURRENT})
SELECT target_size, CASE WHEN grouping(quote_status) = 1 THEN 'all' ELSE quote_status END AS status, count(*) AS n, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words, round(avg(word_count), 9) AS mean_words,
count(*) FILTER (is_undersized) AS undersized, count(*) FILTER (is_remainder) AS remainders, count(*) FILTER (merged_remainder) AS merged FROM b GROUP BY GROUPING SETS ((target_size), (target_size, quote_status))
""")
def block_statistics(spark, d):
    b = _current(spark, d, ["target_size", "quote_status", "word_count", "is_undersized", "is_remainder", "merged_remainder"])
    g = b.groupingSets([["target_size"], ["target_size", "quote_status"]], "target_size", "quote_status").agg(
        F.when(F.grouping("quote_status") == 1, "all").otherwise(F.col("quote_status")).alias("status"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.round(F.avg("word_count"), 9).alias("mean_words"),
        F.count_if("is_undersized").alias("undersized"), F.count_if("is_remainder").alias("remainders"), F.count_if("merged_remainder").alias("merged"),
    )
    return g.drop("quote_status")


_FLAGS = "event_type = 'signup' AS opens, event_type = 'purchase' AS closes, event_type = 'error' AS narrator, CASE WHEN event_type = 'signup' THEN CASE WHEN value < 10 THEN 'low' WHEN value < 30 THEN 'middle' END END AS speaker"


def _speech(spark, d):
    kind = F.col("event_type")
    who = F.when(kind == "signup", F.when(F.col("value") < 10, "low").when(F.col("value") < 30, "middle"))
    return S.column_flags(table(spark, d, "events"), opens=kind == "signup", closes=kind == "purchase", narrator=kind == "error").withColumn("speaker", who)


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, CAST(event_id AS VARCHAR) AS ref, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {_FLAGS} FROM events),
m(user_id, i, no, open, n, who, first_ref, closed, c_first, c_n, c_who, ref) AS (
  SELECT user_id, 0::BIGINT, 0, false, 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM e WHERE i = 1
  UNION ALL
  SELECT x.user_id, x.i, CASE WHEN starts THEN no + 1 ELSE no END, CASE WHEN starts THEN true WHEN why IS NOT NULL THEN false ELSE open END, CASE WHEN starts THEN 1 WHEN open AND why IS NULL THEN n + 1 ELSE 0 END,
    CASE WHEN starts THEN speaker WHEN why IS NOT NULL THEN NULL ELSE who END, CASE WHEN starts THEN xref ELSE first_ref END, why, first_ref, n + 1, who, xref
  FROM (SELECT *, opens AND ((NOT open) OR (why IS NOT NULL AND why <> 'new_speaker')) AS starts FROM (
    SELECT m.user_id, e.i, m.no, m.open, m.n, m.who, m.first_ref, e.opens, e.speaker, e.ref AS xref,
      CASE WHEN NOT m.open THEN NULL WHEN e.closes THEN 'explicit_close' WHEN e.narrator THEN 'narrator_self_id' WHEN m.n >= 50 THEN 'max_length_50' WHEN e.opens AND e.speaker IS NOT NULL AND e.speaker IS DISTINCT FROM m.who THEN 'new_speaker' END AS why
    FROM m JOIN e ON e.user_id = m.user_id AND e.i = m.i + 1)) x)
SELECT user_id, CAST(CASE WHEN open THEN no - 1 ELSE no END AS INTEGER) AS block_no, c_first AS first_ref, ref AS last_ref, CAST(c_n AS INTEGER) AS n_rows, c_who AS speaker, closed AS close_reason FROM m WHERE closed IS NOT NULL
UNION ALL SELECT user_id, CAST(no AS INTEGER), first_ref, ref, CAST(n AS INTEGER), who, 'end_of_text' FROM m WHERE open AND (user_id, i) IN (SELECT user_id, max(i) FROM e GROUP BY user_id)
""")
def speech_blocks_v2(spark, d):
    e = _speech(spark, d).withColumn("ref", F.col("event_id").cast("string"))
    return S.speech_blocks(e, ["user_id"], ["ts", "event_id"], "ref", "opens", "closes", "narrator", "speaker")


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, CAST(event_id AS VARCHAR) AS ref, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {_FLAGS} FROM events),
m(user_id, i, no, inside, position, ref) AS (
  SELECT user_id, 0::BIGINT, 0, false, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM e WHERE i = 1
  UNION ALL SELECT m.user_id, e.i, CASE WHEN NOT inside AND opens THEN no + 1 ELSE no END, CASE WHEN inside THEN NOT (closes OR narrator) ELSE opens END,
    CASE WHEN inside THEN CASE WHEN closes THEN 'END' WHEN narrator THEN 'END_IMPLICIT' ELSE 'MIDDLE' END WHEN opens THEN 'START' END, e.ref FROM m JOIN e ON e.user_id = m.user_id AND e.i = m.i + 1)
SELECT user_id, ref, CASE WHEN position IS NULL OR position = 'END_IMPLICIT' THEN NULL ELSE CAST(no AS INTEGER) END AS block_no, position FROM m WHERE i > 0
""")
def speech_blocks_v1(spark, d):
    e = _speech(spark, d).withColumn("ref", F.col("event_id").cast("string"))
    return S.speech_positions(e, ["user_id"], ["ts", "event_id"], "ref", "opens", "closes", "narrator")


_WS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"


def _chunk_sql(size, keep):
    return f"""
WITH d AS (SELECT doc_id, {_WS} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), {size})) AS s FROM d)
SELECT doc_id, CAST(s // {size} + 1 AS INTEGER) AS chunk, CAST(s AS INTEGER) AS first_word, CAST(least({size}, len(w) - s) AS INTEGER) AS n_words, md5(array_to_string(w[s + 1:s + {size}], ' ')) AS digest FROM c WHERE least({size}, len(w) - s) >= {keep}"""


def _digested(chunks):
    return chunks.select("doc_id", "chunk", "first_word", "n_words", F.md5("chunk_text").alias("digest"))


@query(_chunk_sql(100, 50))
def word_chunks_tail_half(spark, d):
    return _digested(S.word_chunks(table(spark, d, "documents"), "doc_id", "text", 100))


@query(_chunk_sql(100, 80))
def word_chunks_tail80(spark, d):
    return _digested(S.word_chunks(table(spark, d, "documents"), "doc_id", "text", 100, tail=0.8))


@query(f"""
WITH d AS (SELECT doc_id, {_WS} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w) - 199, 100)) AS s FROM d WHERE len(w) >= 200)
SELECT doc_id, CAST(s // 100 + 1 AS INTEGER) AS chunk, CAST(s AS INTEGER) AS first_word, 200 AS n_words, md5(array_to_string(w[s + 1:s + 200], ' ')) AS digest FROM c
""")
def rolling_chunks(spark, d):
    return _digested(S.word_chunks(table(spark, d, "documents"), "doc_id", "text", 200, step=100))


_LINES = "SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY scanned_at DESC) AS r FROM raw_lines) WHERE r = 1"


def _lines(spark, d):
    rows = table(spark, d, "raw_lines").withColumn("k", F.struct("doc_id", "line_no"))
    return latest_rows(rows, "k", "scanned_at", ["doc_id", "line_no", "line"]).drop("k")


_HEADING = "^CHAPTER [IVXLC]+\\.$"


@query(f"""
WITH l AS ({_LINES}), h AS (SELECT doc_id, line_no, line AS heading FROM l WHERE regexp_matches(line, '{_HEADING}'))
SELECT l.doc_id, l.line_no, h.heading FROM l ASOF LEFT JOIN h ON l.doc_id = h.doc_id AND l.line_no >= h.line_no
""")
def asof_chapter(spark, d):
    lines = _lines(spark, d).drop("line")
    heads = _lines(spark, d).where(F.col("line").rlike(_HEADING)).select("doc_id", F.col("line_no").alias("start"), F.col("line").alias("heading_line"))
    return S.floor_lookup(lines, heads, ["doc_id"], "line_no", "start", "heading_line", "heading")


@query(f"""
WITH l AS ({_LINES}), h AS (SELECT *, CASE WHEN regexp_matches(line, '{_HEADING}') THEN line END AS c FROM l)
SELECT doc_id, line_no, last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS chapter FROM h
""")
def carry_forward(spark, d):
    lines = _lines(spark, d).withColumn("c", F.when(F.col("line").rlike(_HEADING), F.col("line")))
    return S.carried_forward(lines, ["doc_id"], ["line_no"], "c", "chapter").select("doc_id", "line_no", "chapter")


@query(f"""
WITH l AS ({_LINES}), x AS (SELECT *, trim(line) = '' AS blank, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM l),
c AS (SELECT doc_id, i, line_no, line, lead(line) OVER w AS nxt, lead(i) OVER w - i - 1 AS skipped, lag(line) OVER w AS prv FROM x WHERE NOT blank WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT *, regexp_extract(line, '(\\S+)-\\s*$', 1) AS part, regexp_extract(nxt, '^\\S+') AS suffix, regexp_extract(line, '^\\S+') AS own, regexp_matches(prv, '\\S-\\s*$') AND trim(line) = regexp_extract(line, '^\\S+') AS eaten FROM c)
SELECT doc_id, line_no, part || suffix AS joined_word, CAST(skipped AS INTEGER) AS blanks_skipped FROM h
WHERE regexp_matches(line, '\\S-\\s*$') AND suffix <> '' AND NOT eaten AND (regexp_matches(suffix, '^\\p{{Ll}}') OR (part = upper(part) AND part <> lower(part) AND suffix = upper(suffix) AND suffix <> lower(suffix)))
""")
def dehyphenate(spark, d):
    out = S.dehyphenated(_lines(spark, d), "doc_id", "line_no", "line")
    return out.where("joined_word IS NOT NULL").select("doc_id", "line_no", "joined_word", "blanks_skipped")


@query(f"""
WITH b AS (SELECT {_RUN} AS run, block_id FROM ({_CURRENT}))
SELECT run, block_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5('42|' || block_id), block_id) AS r FROM b) WHERE r <= 20
""")
def capped_runs(spark, d):
    return S.capped(_current(spark, d, ["run_id"]).select(_run().alias("run"), "block_id"), "run", "block_id", 20)


@query("""
SELECT doc_id, lang, CAST((row_number() OVER w - 1) // 5 AS INTEGER) AS position_group, CASE WHEN row_number() OVER w <= count(*) OVER (PARTITION BY lang) // 2 THEN 'first' ELSE 'second' END AS half FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)
""")
def positional_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return S.halves(S.positional_groups(docs, ["lang"], ["doc_id"], 5), ["lang"], ["doc_id"])


@query(f"""
WITH l AS ({_LINES}), n AS (SELECT doc_id, line_no, line, regexp_matches(trim(line), '^(?i)(\\d+\\s+)?(the )?(first )?(book|words|record) of [a-z]+[.,:]?(\\s+\\d+)?$') AND regexp_matches(trim(line), '(^\\d+\\s)|(\\s\\d+$)') OR trim(line) IN ('BOOK OF NOTHING. B47') AS header FROM l)
SELECT doc_id, line_no, CASE WHEN header THEN '<!-- PAGE_HEADER: ' || trim(line) || ' -->' ELSE line END AS line, header FROM n WHERE line_no >= 3
""")
def header_mark(spark, d):
    from versloom.operators.paratext import numbered_header, without_headers

    lines = _lines(spark, d).where("line_no >= 3")
    return without_headers(lines, "line", numbered_header(F.col("line"), ["BOOK OF NOTHING. B47"]), "mark").select("doc_id", "line_no", "line", "header")


@query(f"""
WITH l AS ({_LINES}), c AS (SELECT doc_id, min(line_no) AS s FROM l WHERE regexp_matches(line, '^\\s*(?i)chap(ter)?\\.?\\s*i\\.?\\s*$') GROUP BY doc_id)
SELECT l.doc_id, l.line_no, md5(regexp_replace(line, '\\s+([,.;])', '\\1', 'g')) AS digest FROM l JOIN c USING (doc_id) WHERE line_no >= s AND NOT regexp_matches(trim(line), '^\\d+$')
""")
def chapter_start_filter(spark, d):
    from versloom.operators.paratext import from_first_chapter

    return from_first_chapter(_lines(spark, d), "doc_id", "line_no", "line").select("doc_id", "line_no", F.md5("line").alias("digest"))


@query("""
SELECT doc_id, md5(regexp_replace(CASE WHEN strpos(text, 'insomuch') > 0 THEN substr(text, strpos(text, 'insomuch') + 8) WHEN strpos(text, 'Behold') > 0 THEN substr(text, strpos(text, 'Behold') + 6) ELSE text END, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents
""")
def paratext_strip(spark, d):
    from versloom.operators.paratext import between_markers

    return table(spark, d, "documents").select("doc_id", F.md5(between_markers(F.col("text"), ["insomuch", "Behold"], [], line_rest=False)).alias("digest"))


@query(f"""
WITH l AS ({_LINES}), x AS (SELECT *, regexp_extract(line, '^([A-Z]+) ([IVXLC]+)\\.$', 1) AS book, regexp_extract(line, '^([A-Z]+) ([IVXLC]+)\\.$', 2) AS chapter FROM l)
SELECT doc_id, line_no, book, chapter, line AS reference FROM x WHERE book <> ''
""")
def keyed_lines(spark, d):
    from versloom.sources.readers import keyed

    return keyed(_lines(spark, d), "line", r"^([A-Z]+) ([IVXLC]+)\.$", ["book", "chapter"]).select("doc_id", "line_no", "book", "chapter", F.col("line").alias("reference"))
