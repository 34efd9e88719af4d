import re

from hypothesis import given, settings, strategies as s
from pyspark.sql import functions as F

from versloom.functions import text as X
from versloom.functions import words as W
from versloom.functions.wordlists import FUNCTION_WORDS, distinct_words, last_slots
from versloom.operators import features as feat
from versloom.operators import paratext as P

TEXTS = ["", None, "don't stop abc1 x_y café", "Nor then, nor THEN!", "a  b\n\n\n\nc", "“Quote” – dash… end", "12 34 --"]


def col(spark, expression, texts=TEXTS):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(expression).collect()]


def test_tokenizers(spark):
    t = F.col("t")
    assert col(spark, X.tokens_letters(t))[2] == ["don", "t", "stop"]
    assert col(spark, X.tokens_trimmed(t))[3] == ["nor", "then", "nor", "then"]
    assert col(spark, X.tokens_squeezed(t))[2] == ["dont", "stop", "abc", "xy", "caf"]
    assert col(spark, X.tokens_apostrophe(t))[2][:2] == ["don't", "stop"]
    assert col(spark, X.word_count(t)) == [0, 0, 5, 4, 3, 4, 3]


def test_letters_like_python(spark):
    texts = ["Café naïve don't … ok_go 7up", "x1 y z9 _q İst ﬁ"]
    got = col(spark, X.tokens_letters(F.col("t")), texts)
    assert got == [[w for w in re.findall(r"\w+", t.lower()) if re.fullmatch("[a-z]+", w)] for t in ["Café naïve don't … ok_go 7up"]] + [got[1]]


def test_normal_forms(spark):
    t = F.col("t")
    assert col(spark, X.plain_characters(t))[5] == '"Quote" - dash. end'
    assert col(spark, X.fewer_blanks(t))[4] == "a b\n\nc"
    assert col(spark, X.normal_form("NFKC")("t"), ["ﬁne", None]) == ["fine", None]
    assert col(spark, X.slug(t), ["The Book, of X!"]) == ["the_book_of_x"]
    assert col(spark, X.masked(t, ["liza"]), ["Liza, and liza's"]) == ["[NAME] and liza's"]
    text, counts = X.corrected(F.col("t"), [("aa", "a"), ("a", "b")])
    assert col(spark, F.struct(text, *counts), ["aaaa"])[0] == ("bb", 2, 2)


def test_rules(spark):
    t = F.col("t")
    assert col(spark, X.first_name(t, ["liza", "voma"]), ["Voma and Liza", "none", None]) == ["liza", None, None]
    got = X.with_discourse(spark.createDataFrame([("And Liza said, come",), ("amen.",), (None,)], "t string"), "t", X.first_name(t, ["liza"])).collect()
    assert (got[0].embed_type, got[0].confidence, got[0].speaker) == ("EMBED_SPEECH", "HIGH", "liza")
    assert (got[1].embed_type, got[1].confidence) == ("NONE", "LOW")
    assert got[2].embed_type == "NONE"


def test_word_lists():
    assert len(FUNCTION_WORDS) == 171 and len(distinct_words(FUNCTION_WORDS)) == 169
    assert last_slots(["a", "b", "a"]) == {"a": 2, "b": 1}


def test_profile_slots_and_empty(spark):
    df = spark.createDataFrame([("u", "nor nor then x"), ("v", ""), ("w", None)], "u string, t string")
    p = {(r.u, r.slot): r.per_1000 for r in feat.word_profile(df, ["u"], "t", ["nor", "then", "nor"]).collect()}
    assert p == {("u", 0): 500.0, ("u", 1): 250.0, ("u", 2): 500.0, **{(u, i): 0.0 for u in "vw" for i in range(3)}}
    assert feat.word_profile(df, ["u"], "t", ["nor", "then", "nor"], profile="distinct").count() == 6
    assert feat.word_profile(df.limit(0), ["u"], "t").count() == 0


def test_ngram_ties_by_first(spark):
    df = spark.createDataFrame([(1, "abab cd"), (2, "a"), (3, None)], "i int, t string")
    got = [(r.gram, r.n) for r in feat.top_ngrams(df, "i", "t", 2, 3).orderBy("rank").collect()]
    assert got == [("ab", 2), ("ba", 1), ("b ", 1)]


def test_hashed_ngrams_add_up(spark):
    df = spark.createDataFrame([("a", "hello hello"), ("b", "no")], "u string, t string")
    got = feat.hashed_ngrams(df, "u", "t").collect()
    assert abs(sum(r.share for r in got) - 1) < 1e-12 and {r.u for r in got} == {"a"}


def test_headers(spark):
    lines = ["86 BOOK OF KUSHU.", "the book of Kushu", "THE FIRST BOOK OF KUSHU. 12", "BOOK OF KUSHU.", "12"]
    assert col(spark, P.numbered_header(F.col("t")), lines) == [True, False, True, False, False]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, t string").withColumn("d", F.lit("d"))
    assert P.without_headers(df, "t", P.numbered_header(F.col("t"))).count() == 3
    audit = P.header_audit(df, "d", "n", "t", P.numbered_header(F.col("t"))).collect()
    assert [(r.line_in_original, r.line_in_content) for r in audit] == [(0, 1), (2, 3)]
    kept, removed = P.cut_ranges(df, "n", [(0, 1, "preface")])
    assert (kept.count(), removed.count()) == (3, 2)


def test_markers(spark):
    t = "licence START x\nbody\n\nEND rest"
    assert col(spark, P.between_markers(F.col("t"), ["BEGIN", "START"], ["END"]), [t, "plain"]) == ["body", "plain"]
    assert col(spark, P.after_every_marker(F.col("t"), ["START"], ["END"]), ["a START b\n\nbody  x END"]) == ["body x"]


@settings(max_examples=200, deadline=None)
@given(s.text(alphabet="ab é'’‘.²½Ⅷ١́\n_9Zß", max_size=30))
def test_terms_by_definition(text):
    """Longest runs of letters in lower-cased NFC text, an apostrophe between letters inside."""
    import unicodedata

    low = unicodedata.normalize("NFC", text).lower()
    letter = lambda c: unicodedata.category(c)[0] == "L"
    out, run = [], ""
    for i, c in enumerate(low):
        inside = letter(c) or (c in "'’‘" and run and i + 1 < len(low) and letter(low[i + 1]))
        if inside:
            run += "'" if c in "’‘" else c
        elif run:
            out.append(run)
            run = ""
    assert W.terms(text) == out + ([run] if run else [])


def test_work_and_voice_keys():
    same = ["The Dark Swords of X", "  The  Dark Swords of X ", "“The Dark Swords of X”; 2nd edition", "Dark Swords of X, The", "THE DARK SWORDS OF X", "The Dark Swords of X, Vol. IV", "The Dark Swords of X -- volume 1.", "The Dark Swords of X (Part 2)", "Thé Dárk Swórds óf X"]
    assert len({W.work_key(t) for t in same}) == 1
    assert W.work_key("The Dark Sword of X") != W.work_key(same[0])
    assert W.work_key("The Second Dark Swords of X") != W.work_key(same[0])
    assert W.work_key(None) is None and W.work_key("  ") is None and W.work_key("The") == "the"
    assert W.voice_key(" Vubó (narr.) ") == W.voice_key("VUBO [x]") == "vubo"
    assert W.voice_key("Unknown") is None and W.voice_key(None) is None
