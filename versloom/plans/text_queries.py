"""Text: tokenizers, profiles, normalisers, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from versloom.functions import text as X
from versloom.functions.wordlists import FUNCTION_WORDS, distinct_words
from versloom.operators import features
from versloom.plans.registry import query, sql_list
from versloom.tables import table

R = 9  # decimals kept where the order of a sum may differ


def _docs(spark, d):
    return table(spark, d, "documents")


def _lang(col):
    return F.coalesce(F.lower(F.substring(F.trim(col), 1, 2)), F.lit("?"))


_T1 = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]+'))"
_WS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"
_WSL = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')"
_LANG = "coalesce(lower(substr(trim(lang), 1, 2)), '?')"
_SLOTS = f"slots AS (SELECT unnest(range(0, {len(FUNCTION_WORDS)})) AS slot, unnest({sql_list(FUNCTION_WORDS)}) AS word)"


@query(f"""
WITH {_SLOTS}, d AS (SELECT {_LANG} AS lang, source, {_T1} AS ts FROM documents),
t AS (SELECT lang, source, sum(len(ts)) AS total FROM d GROUP BY ALL),
w AS (SELECT lang, source, unnest(ts) AS word FROM d),
c AS (SELECT lang, source, word, count(*) AS n FROM w GROUP BY ALL)
SELECT t.lang, t.source, slot, s.word, coalesce(n, 0) AS n, CAST(total AS BIGINT) AS total, CASE WHEN total = 0 THEN 0.0 ELSE coalesce(n, 0) / total * 1000 END AS per_1000
FROM t CROSS JOIN slots s LEFT JOIN c ON c.lang = t.lang AND c.source IS NOT DISTINCT FROM t.source AND c.word = s.word
""", ints=("slot",))
def fw_profile_by_group(spark, d):
    return features.word_profile(_docs(spark, d).select(_lang("lang").alias("lang"), "source", "text"), ["lang", "source"], "text")


def _hits(tokens):
    return F.size(F.filter(tokens, lambda t: t.isin(distinct_words(FUNCTION_WORDS))))


_FW = sql_list(distinct_words(FUNCTION_WORDS))


@query(f"SELECT doc_id, coalesce(len({_T1}), 0) AS n, coalesce(len(list_filter({_T1}, lambda t: list_contains({_FW}, t))), 0) AS hits FROM documents", ints=("n", "hits"))
def tok_t1_counts(spark, d):
    t = X.tokens_letters(F.col("text"))
    return _docs(spark, d).select("doc_id", F.coalesce(F.size(t), F.lit(0)).alias("n"), F.coalesce(_hits(t), F.lit(0)).alias("hits"))


@query(f"""SELECT doc_id, coalesce(len({_WS}), 0) AS n, coalesce(len(list_filter({_WSL}, lambda t: list_contains({_FW}, regexp_replace(t, '^[.,;:!?"''-]+|[.,;:!?"''-]+$', '', 'g')))), 0) AS hits FROM documents""", ints=("n", "hits"))
def tok_t2_counts(spark, d):
    return _docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("n"), F.coalesce(_hits(X.tokens_trimmed(F.col("text"))), F.lit(0)).alias("hits"))


@query(f"SELECT doc_id, coalesce(len({_WS}), 0) AS n, coalesce(len(list_filter({_WSL}, lambda t: list_contains({_FW}, regexp_replace(t, '[^a-z]', '', 'g')))), 0) AS hits FROM documents", ints=("n", "hits"))
def tok_t3_counts(spark, d):
    return _docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("n"), F.coalesce(_hits(X.tokens_squeezed(F.col("text"))), F.lit(0)).alias("hits"))


_T4 = "regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')"


@query(f"SELECT doc_id, coalesce(len({_T4}), 0) AS n, CASE WHEN coalesce(len({_T4}), 0) = 0 THEN 0.0 ELSE len(list_filter({_T4}, lambda t: list_contains({_FW}, t))) / len({_T4}) END AS share FROM documents", ints=("n",))
def tok_t4_counts(spark, d):
    t = X.tokens_apostrophe(F.col("text"))
    n = F.coalesce(F.size(t), F.lit(0))
    return _docs(spark, d).select("doc_id", n.alias("n"), F.when(n > 0, _hits(t) / n).otherwise(0.0).alias("share"))


_LEN = "list_transform({t}, lambda x: len(x))".format(t=_T1)


@query(f"""
WITH s AS (SELECT doc_id, {_LEN} AS z FROM documents), m AS (SELECT doc_id, coalesce(len(z), 0) AS n, z FROM s)
SELECT doc_id, n AS n_tokens, round(CASE WHEN n = 0 THEN 0.0 ELSE list_avg(z) END, 9) AS mean_length, round(CASE WHEN n = 0 THEN 0.0 ELSE list_stddev_pop(z) END, 6) AS sd_length,
{", ".join(f"round(CASE WHEN n = 0 THEN 0.0 ELSE len(list_filter(z, lambda x: x {'>=' if k == 8 else '='} {k})) / n * 100 END, 9) AS pct_{k}" for k in range(1, 9))} FROM m
""", ints=("n_tokens",))
def word_length_dist(spark, d):
    out = features.word_lengths(_docs(spark, d).select("doc_id", "text"), "text")
    return out.select("doc_id", "n_tokens", F.round("mean_length", R).alias("mean_length"), F.round("sd_length", 6).alias("sd_length"), *[F.round(f"pct_{k}", R).alias(f"pct_{k}") for k in range(1, 9)])


@query(f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS z FROM documents),
u AS (SELECT doc_id, unnest(z) AS text FROM s), w AS (SELECT doc_id, sum(len({_T1})) AS words, sum(length(text)) AS chars FROM u GROUP BY doc_id)
SELECT s.doc_id, coalesce(len(z), 0) AS n_sentences, round(coalesce(words / len(z), 0.0), 9) AS mean_words, round(coalesce(chars / len(z), 0.0), 9) AS mean_chars FROM s LEFT JOIN w USING (doc_id)
""", ints=("n_sentences",))
def sentence_stats(spark, d):
    out = features.sentence_profile(_docs(spark, d).select("doc_id", "text"), "text")
    return out.select("doc_id", "n_sentences", F.round("mean_words", R).alias("mean_words"), F.round("mean_chars", R).alias("mean_chars"))


@query(f"""
WITH t AS (SELECT doc_id, unnest({_T1}) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapax, round(count(*) / sum(n), 9) AS ttr, round(count(*) FILTER (n = 1) / count(*), 9) AS hapax_ratio,
round(10000.0 * (sum(n * n) - sum(n)) / (sum(n) * sum(n)), 6) AS yules_k FROM c GROUP BY doc_id
""")
def vocab_richness(spark, d):
    r = features.richness(_docs(spark, d), "doc_id", "text")
    return r.select("doc_id", "tokens", "types", "hapax", F.round("ttr", R).alias("ttr"), F.round("hapax_ratio", R).alias("hapax_ratio"), F.round("yules_k", 6).alias("yules_k"))


def _ngram(n):
    sql = f"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z ]', '', 'g') AS t FROM documents), g AS (SELECT doc_id, length(t) - {n - 1} AS total, unnest(range(1, length(t) - {n - 2})) AS i, t FROM d WHERE length(t) >= {n}),
c AS (SELECT doc_id, substr(t, i, {n}) AS gram, count(*) AS n, min(i) AS f, any_value(total) AS total FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM c)
SELECT doc_id, gram, n, CAST(rank AS INTEGER) AS rank, n / total * 1000 AS per_1000 FROM r WHERE rank <= 100"""

    @query(sql, name=f"char_ngram_top_{n}")
    def top(spark, d):
        return features.top_ngrams(_docs(spark, d), "doc_id", "text", n)

    return top


for _n in (2, 3, 4):
    _ngram(_n)


@query("""
WITH d AS (SELECT source, trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents),
g AS (SELECT source, substr(t, i, 3) AS gram, count(*) AS n FROM (SELECT source, t, unnest(range(1, length(t) - 1)) AS i FROM d WHERE length(t) >= 3) GROUP BY ALL),
b AS (SELECT source, CAST(CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 16384 AS INTEGER) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL)
SELECT source, bucket, n, n / sum(n) OVER (PARTITION BY source) AS share FROM b WHERE source IS NOT NULL
""")
def hashed_trigram_l1(spark, d):
    return features.hashed_ngrams(_docs(spark, d).where("source IS NOT NULL"), "source", "text")


@query(f"""
WITH d AS (SELECT source, {_T1} AS ts FROM documents WHERE source IS NOT NULL), n AS (SELECT source, t, count(*) AS n FROM (SELECT source, unnest(ts) AS t FROM d) GROUP BY ALL),
m AS (SELECT t, sum(n) AS m FROM n GROUP BY t), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p, m / (SELECT sum(m) FROM m) AS q FROM n JOIN m USING (t))
SELECT source, round(sum(p / 2 * log2(2 * p / (p + q)) + q / 2 * log2(2 * q / (p + q)) - q / 2) + 0.5, 8) AS jsd FROM p GROUP BY source
""")
def js_divergence(spark, d):
    return features.divergence(_docs(spark, d).where("source IS NOT NULL"), "source", "text").withColumn("jsd", F.round("jsd", 8))


_PLAIN = "translate(nfc_normalize(text), '‘’“”–—…   ', '''''\"\"--.   ')"


@query(f"""
SELECT doc_id, md5({_PLAIN}) AS digest, CAST(length(nfc_normalize(text)) - length(translate(nfc_normalize(text), '‘’“”', '')) AS INTEGER) AS quotes,
CAST(length(nfc_normalize(text)) - length(translate(nfc_normalize(text), '–—', '')) AS INTEGER) AS dashes, CAST(length(nfc_normalize(text)) - length(translate(nfc_normalize(text), '   ', '')) AS INTEGER) AS spaces FROM documents
""")
def normalize_unicode(spark, d):
    n = _docs(spark, d).select("doc_id", X.normal_form("NFC")("text").alias("t"))
    c = F.col("t")
    return n.select("doc_id", F.md5(X.plain_characters(c)).alias("digest"), X.count_characters(c, "‘’“”").alias("quotes"), X.count_characters(c, "–—").alias("dashes"), X.count_characters(c, "   ").alias("spaces"))


@query("""
SELECT doc_id, coalesce(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')), 0) AS words, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed,
md5(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')) AS fewer,
md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS comparable FROM documents
""", ints=("words",))
def whitespace_forms(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", X.word_count(t).alias("words"), F.md5(X.collapsed(t)).alias("collapsed"), F.md5(X.fewer_blanks(t)).alias("fewer"), F.md5(X.comparable(t)).alias("comparable"))


@query()
def ngram_texts(spark, d):
    """Both n-gram normalisers; the first after NFKC, which DuckDB lacks."""
    t = _docs(spark, d).select("doc_id", "text", X.normal_form("NFKC")("text").alias("k"))
    return t.select("doc_id", F.md5(X.ngram_text(F.col("k"))).alias("with_apostrophes"), F.md5(X.ngram_text(F.col("text"), False)).alias("letters_only"))


_FIXES = [("--", "—"), ("o'er", "over"), ("over and", "above and")]


@query("""
WITH a AS (SELECT doc_id, text AS t0, replace(text, '--', '—') AS t1 FROM documents), b AS (SELECT *, replace(t1, 'o''er', 'over') AS t2 FROM a), c AS (SELECT *, replace(t2, 'over and', 'above and') AS t3 FROM b)
SELECT doc_id, md5(t3) AS digest, CAST((length(t0) - length(replace(t0, '--', ''))) / 2 AS INTEGER) AS fix_0, CAST((length(t1) - length(replace(t1, 'o''er', ''))) / 4 AS INTEGER) AS fix_1,
CAST((length(t2) - length(replace(t2, 'over and', ''))) / 8 AS INTEGER) AS fix_2 FROM c
""")
def literal_corrections(spark, d):
    text, counts = X.corrected(F.col("text"), _FIXES)
    return _docs(spark, d).select("doc_id", F.md5(text).alias("digest"), *[c.alias(f"fix_{i}") for i, c in enumerate(counts)])


@query("SELECT DISTINCT title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, 'https://example.org/files/' || gutenberg_id || '.txt' AS url FROM works_manifest")
def title_slugs(spark, d):
    return table(spark, d, "works_manifest").select("title", X.slug(F.col("title")).alias("slug"), F.concat(F.lit("https://example.org/files/"), F.col("gutenberg_id").cast("string"), F.lit(".txt")).alias("url")).distinct()


_NAMES = ["vesefur", "liza", "kafoze", "voma", "suzes", "higoda"]


@query(f"""
WITH w AS (SELECT doc_id, {_WS} AS ws FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(ws, lambda w: CASE WHEN list_contains({sql_list(_NAMES)}, regexp_replace(lower(w), '[^a-z]', '', 'g')) THEN '[NAME]' ELSE w END), ' ')) AS digest,
len(list_filter(ws, lambda w: list_contains({sql_list(_NAMES)}, regexp_replace(lower(w), '[^a-z]', '', 'g')))) AS n FROM w
""", ints=("n",))
def mask_names(spark, d):
    m = X.masked(F.col("text"), _NAMES)
    n = F.size(F.filter(X.words_by_blanks(F.col("text")), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "").isin(_NAMES)))
    return _docs(spark, d).select("doc_id", F.md5(m).alias("digest"), n.alias("n"))


@query("SELECT CASE WHEN publication_year <= 1904 THEN 'early' WHEN publication_year > 1904 THEN 'late' END AS period, genre, count(*) AS works, CAST(sum(word_count) AS BIGINT) AS words FROM works_manifest GROUP BY ALL")
def period_by_genre(spark, d):
    m = table(spark, d, "works_manifest").withColumn("period", X.period(F.col("publication_year")))
    return m.groupBy("period", "genre").agg(F.count(F.lit(1)).alias("works"), F.sum("word_count").alias("words"))


def _rule_sql(family):
    return "coalesce(regexp_matches(low, '" + "|".join(f"(?:{p})" for _, p in X.DISCOURSE[family]).replace("'", "''") + "'), false)"


_HEAD = f"list_filter({sql_list(_NAMES)}, lambda n: contains(lower(substr(text, 1, 80)), n))[1]"


@query(f"""
WITH l AS (SELECT doc_id, text, regexp_replace(lower(text), '\\s+', ' ', 'g') AS low FROM documents),
f AS (SELECT doc_id, {_HEAD} AS name, {", ".join(f'{_rule_sql(k)} AS has_{k}' for k in X.DISCOURSE)} FROM l)
SELECT doc_id, {", ".join(f"has_{k}" for k in X.DISCOURSE)}, CASE WHEN has_speech_open AND NOT has_self THEN 'EMBED_SPEECH' WHEN has_scripture THEN 'EMBED_SCRIPTURE' WHEN has_document THEN 'EMBED_DOCUMENT' ELSE 'NONE' END AS embed_type,
CASE WHEN has_self THEN 'HIGH' WHEN has_speech_open AND name IS NOT NULL THEN 'HIGH' WHEN has_speech_open OR has_document THEN 'MEDIUM' WHEN has_speech_close THEN 'LOW' ELSE 'HIGH' END AS confidence,
concat_ws(',', {", ".join(f"CASE WHEN has_{k} THEN '{k}' END" for k in X.DISCOURSE)}) AS markers, CASE WHEN has_speech_open AND NOT has_self THEN name END AS speaker FROM f
""")
def discourse_flags(spark, d):
    return X.with_discourse(_docs(spark, d).select("doc_id", "text"), "text", X.first_name(F.col("text"), _NAMES)).drop("text")


@query(f"SELECT doc_id, {_HEAD} AS speaker FROM documents")
def speaker_extract(spark, d):
    return _docs(spark, d).select("doc_id", X.first_name(F.col("text"), _NAMES).alias("speaker"))


_CASCADE = [("north", "^[A-F]"), ("middle", "^[G-M]"), ("unknown", "UNKNOWN"), ("south", "^[N-Z]")]


@query("""
SELECT voice, CASE WHEN regexp_matches(upper(voice), '^[A-F]') THEN 'north' WHEN regexp_matches(upper(voice), '^[G-M]') THEN 'middle' WHEN regexp_matches(upper(voice), 'UNKNOWN') THEN 'unknown' WHEN regexp_matches(upper(voice), '^[N-Z]') THEN 'south' ELSE 'other' END AS category, count(*) AS n FROM voice_blocks GROUP BY ALL
""")
def voice_categories(spark, d):
    b = table(spark, d, "voice_blocks")
    return b.select("voice", X.first_rule(F.upper("voice"), _CASCADE, "other").alias("category")).groupBy("voice", "category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes, text IS NOT NULL AS present FROM documents")
def manifest_sha256(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").alias("n_bytes"), F.col("text").isNotNull().alias("present"))


@query("""
SELECT 'text' AS field, count(*) AS n, count(*) FILTER (length(trim(text)) < 50) AS short FROM documents
UNION ALL SELECT 'title', count(*), count(*) FILTER (title IS NULL) FROM documents
""")
def review_counts(spark, d):
    docs = _docs(spark, d)
    a = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim("text")) < 50).alias("short")).withColumn("field", F.lit("text"))
    b = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("title").isNull()).alias("short")).withColumn("field", F.lit("title"))
    return a.unionByName(b)
