"""Column expressions over text: tokenizers, normalisers, counts.

All of them are built-in expressions except the Unicode normal forms, which
Spark lacks. A null text gives null or an empty array, never an error.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic characters and their plain forms.
PLAIN_FORMS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": ".", " ": " ", " ": " ", " ": " "}


# --- tokenizers: profiles that differ on purpose


def tokens_letters(text: Column) -> Column:
    """T1: runs of word characters that consist of a-z only, lower-cased ("don't" gives don and t, "abc1" nothing)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike("^[a-z]+$"))


def words_by_blanks(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def tokens_trimmed(text: Column) -> Column:
    """T2: words between blanks, lower-cased, without punctuation at either end."""
    return F.transform(words_by_blanks(F.lower(text)), lambda t: F.regexp_replace(t, r"^[.,;:!?\"'\-]+|[.,;:!?\"'\-]+$", ""))


def tokens_squeezed(text: Column) -> Column:
    """T3: words between blanks, lower-cased, without anything but a-z ("don't" gives dont)."""
    return F.transform(words_by_blanks(F.lower(text)), lambda t: F.regexp_replace(t, "[^a-z]", ""))


def tokens_apostrophe(text: Column) -> Column:
    """T4: runs of a-z with at most one apostrophe part ("don't" stays whole)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))


TOKENIZERS = {"letters": tokens_letters, "trimmed": tokens_trimmed, "squeezed": tokens_squeezed, "apostrophe": tokens_apostrophe}


def word_count(text: Column) -> Column:
    """Words between blanks; 0 for null."""
    return F.coalesce(F.size(words_by_blanks(text)), F.lit(0))


def sentences(text: Column) -> Column:
    """Stretches between marks of end, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


# --- normal forms


def normal_form(form: str):
    """A UDF for a Unicode normal form (NFC, NFKC, NFD or NFKD)."""

    @F.pandas_udf(T.StringType())
    def apply(v: pd.Series) -> pd.Series:
        return v.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return apply


def plain_characters(text: Column, forms: dict[str, str] | None = None) -> Column:
    """``text`` with typographic quotes, dashes and spaces in plain form."""
    forms = forms or PLAIN_FORMS
    return F.translate(text, "".join(forms), "".join(forms.values()))


def count_characters(text: Column, chars: str) -> Column:
    """How many of ``chars`` occur in ``text``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def fewer_blanks(text: Column) -> Column:
    """At most one blank line in a row and one space."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " +", " ")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def comparable(text: Column) -> Column:
    """Lower case, without punctuation, white space collapsed."""
    return collapsed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""))


def ngram_text(text: Column, apostrophes: bool = True) -> Column:
    """Lower-case letters a-z, single spaces and, unless left out, apostrophes. Apply NFKC first where compatibility forms matter."""
    return collapsed(F.regexp_replace(F.lower(text), r"[^a-z\s']" if apostrophes else r"[^a-z\s]", ""))


def slug(text: Column) -> Column:
    """Lower case with runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def masked(text: Column, names: list[str], mark: str = "[NAME]") -> Column:
    """Words between blanks with every one whose letters spell a name replaced; the number of words stays."""
    plain = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")
    return F.array_join(F.transform(words_by_blanks(text), lambda w: F.when(plain(w).isin(names), mark).otherwise(w)), " ")


def corrected(text: Column, corrections: list[tuple[str, str]]) -> tuple[Column, list[Column]]:
    """``text`` after literal replacements in order, and how often each applied to the text as it then was."""
    counts = []
    for wrong, right in corrections:
        after = F.replace(text, F.lit(wrong), F.lit(""))
        counts.append(((F.length(text) - F.length(after)) / len(wrong)).cast("int"))
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text, counts


def period(year: Column, last_early: int = 1904) -> Column:
    """early or late; null without a year."""
    return F.when(year <= last_early, "early").when(year > last_early, "late")


def per_thousand(count: Column, total: Column) -> Column:
    """Frequency per thousand, 0 where the total is 0. The order of the operations is part of the definition."""
    return F.when(total == 0, F.lit(0.0)).otherwise(count / total * 1000)


# --- rules


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the first rule whose pattern is found in ``text``."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def last_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the last rule whose pattern is found in ``text``: later rules override earlier ones."""
    return first_rule(text, rules[::-1], default)


def any_rule(text: Column, rules: list[str | tuple[tuple[str, ...], str]]) -> Column:
    """Whether one of ``rules`` is found; false for null.

    A rule is a pattern, or literals and a pattern that can only be found where
    the text holds one of them: the search for literals is far cheaper.
    """
    out = F.lit(False)
    for rule in rules:
        literals, pattern = rule if isinstance(rule, tuple) else ((), rule)
        hit = text.rlike(pattern)
        if literals:
            some = F.contains(text, F.lit(literals[0]))
            for w in literals[1:]:
                some = some | F.contains(text, F.lit(w))
            hit = some & hit
        out = out | hit
    return F.coalesce(out, F.lit(False))


def first_name(text: Column, names: list[str], within: int = 80) -> Column:
    """The first of ``names``, in their order, that the first ``within`` characters contain; null if none does."""
    head = F.substring(F.lower(text), 1, within)
    return F.try_element_at(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(head, F.lower(n))), F.lit(1))


# Markers of embedded discourse by family. A boundary is the start or a character other than a-z, 0-9 and _.
_B, _E = r"(?:^|[^a-z0-9_])", r"(?:$|[^a-z0-9_])"
DISCOURSE = {
    "speech_open": [
        ((" said", " saith", " spake", " cried", " answered", " proclaimed", " testified"), rf"{_B}(?:and|now) [a-z]+ (?:said|saith|spake|cried|answered|proclaimed|testified){_E}"),
        (("began to ", "did to "), rf"{_B}(?:began|did) to (?:say|teach|preach|speak){_E}"),
        (("these are the words",), rf"{_B}these are the words (?:of|which){_E}"),
        (("opened his mouth and ",), rf"{_B}opened his mouth and (?:taught|said|spake){_E}"),
        (("he spake unto them",), rf"{_B}he spake unto them{_E}"),
        (("i say unto you",), rf"{_B}behold,? i say unto you{_E}"),
        (("saying",), rf"{_B}saying ?[:;,]"),
    ],
    "speech_close": [
        (("ended the ",), rf"{_B}(?:thus|now) ended the (?:words|sayings|preaching|speech) of{_E}"),
        (("had made an end", "had finished"), rf"{_B}had (?:made an end|finished){_E}"),
        (("had ended ",), rf"{_B}had ended (?:his|their) words{_E}"),
        ((" had spoken", " had said", " had finished speaking"), rf"{_B}when [a-z]+ had (?:spoken|said|finished speaking) (?:these )?words{_E}"),
        ((" had spoken", " had said"), rf"{_B}(?:after [a-z]+|when (?:he|she|they)) had (?:spoken|said){_E}"),
        (("having said these things",), rf"{_B}having said these things{_E}"),
        (("amen",), rf"{_B}amen{_E}"),
    ],
    "document": [
        (("an epistle",), rf"{_B}an epistle{_E}"),
        (("this is the ",), rf"{_B}this is the (?:epistle|letter|record|decree|proclamation){_E}"),
        (("the words of", "the words which"), rf"{_B}the words (?:of|which).*wrote{_E}"),
        (("the copy of the ",), rf"{_B}the copy of the (?:epistle|letter){_E}"),
        (("it is written in the book of",), rf"{_B}it is written in the book of{_E}"),
    ],
    "scripture": [(("thus saith the lord",), rf"{_B}thus saith the lord{_E}"), (("according to the words of",), rf"{_B}according to the words of{_E}")],
    "self": [(("i, ",), rf"{_B}i, [a-z]+,"), ((" write ", " wrote "), rf"{_B}i [a-z]+ (?:write|wrote) {_E}")],
    "aside": [(("and thus we see",), rf"{_B}and thus we see{_E}"), (("behold i ", "behold, i "), rf"{_B}behold,? i (?:say|write|speak){_E}")],
}


def with_discourse(df: DataFrame, text: str, speaker: Column, families: dict[str, list] | None = None) -> DataFrame:
    """``df`` with flags, markers, type and confidence of embedded discourse.

    One flag has_… for each family; ``embed_type`` by precedence speech (unless
    the narrator names itself), scripture, document; ``confidence`` HIGH for a
    narrator or a speech with a known ``speaker``, MEDIUM for other openings and
    documents, LOW for a close without an opening, else HIGH. Each pattern is
    looked for once: later columns are made from the flags, not from the text.
    """
    families = families or DISCOURSE
    low = df.withColumn("_low", F.regexp_replace(F.lower(text), r"\s+", " ")).withColumn("_speaker", speaker)
    flagged = low.withColumns({f"has_{n}": any_rule(F.col("_low"), patterns) for n, patterns in families.items()})
    speech = F.col("has_speech_open") & ~F.col("has_self")
    kind = F.when(speech, "EMBED_SPEECH").when(F.col("has_scripture"), "EMBED_SCRIPTURE").when(F.col("has_document"), "EMBED_DOCUMENT").otherwise("NONE")
    sure = F.when(F.col("has_self"), "HIGH").when(F.col("has_speech_open") & F.col("_speaker").isNotNull(), "HIGH").when(F.col("has_speech_open") | F.col("has_document"), "MEDIUM")
    sure = sure.when(F.col("has_speech_close"), "LOW").otherwise("HIGH")
    markers = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"has_{n}"), n) for n in families])), ",")
    return flagged.withColumns({"embed_type": kind, "confidence": sure, "markers": markers, "speaker": F.when(speech, F.col("_speaker"))}).drop("_low", "_speaker")
