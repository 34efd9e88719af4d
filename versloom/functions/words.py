"""Words and terms of a text, the same in every operator.

A *term* is a longest run of Unicode letters in the lower-cased text after NFC;
an apostrophe between letters belongs to it and is written straight. A *word*
is a longest run of characters that are not white space.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

APOSTROPHES = "'’‘"
_CURLY = str.maketrans({"’": "'", "‘": "'"})


@lru_cache(maxsize=1)
def _number_signs() -> frozenset[str]:
    """Characters that ``[^\\W\\d_]`` matches although they are no letters, such as one half."""
    every = map(chr, range(128, sys.maxunicode + 1))
    return frozenset(c for c in every if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L")


#: Pattern of a term in a text without number signs.
_LETTER = r"[^\W\d_]"
_TERM = re.compile(f"{_LETTER}+(?:[{APOSTROPHES}]{_LETTER}+)*")


def terms(text: str | None) -> list[str]:
    """The terms of ``text`` in order; none for a null or empty text."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).lower()
        for sign in _number_signs() & set(text):
            text = text.replace(sign, " ")
        found = _TERM.findall(text)
        if "’" in text or "‘" in text:
            return [t.translate(_CURLY) for t in found]
        return found
    return _ascii_terms(text.lower())


_ascii_terms = re.compile(r"[a-z]+(?:'[a-z]+)*").findall

#: White space as in the Unicode property of that name; the no-break space is part of it.
_WORD = re.compile(r"\S+")


def word_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end offset of every word of ``text``."""
    return [m.span() for m in _WORD.finditer(text)] if text else []


def strip_accents(text: str) -> str:
    """``text`` without combining marks, in NFC."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


#: Articles, and words that mark a volume, part or edition of a work.
ARTICLES = ("a", "an", "the")
VOLUME_WORDS = ("volume", "vol", "part", "pt", "book", "bk", "tome", "edition", "ed")

_ROMAN_OR_NUMBER = r"(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)"
_ORDINAL = r"(?:\d+\s*(?:st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|new|revised|enlarged)"
_MARK = re.compile(
    rf"(?:^|[\s,;:.()\[\]–—\"”-])\s*(?:(?:volume|vol|part|pt|tome|edition|ed)\b\.?\s*{_ROMAN_OR_NUMBER}|{_ORDINAL}\s+(?:edition|ed)\b)[\s.,;:)\]]*$"
)


def work_key(title: str | None) -> str | None:
    """What titles of the same work have in common; null for a null or blank title.

    Case, accents, punctuation, spacing, one leading or trailing article and
    closing volume, part or edition marks are left out. A title that consists
    of nothing else keeps its words.
    """
    if title is None or not title.strip():
        return None
    text = strip_accents(title).casefold().strip()
    while (m := _MARK.search(text)) and m.start() > 0:
        text = text[: m.start()].rstrip()
    words = re.findall(r"[^\W_]+", text.replace("'", "").replace("’", ""))
    if len(words) > 1 and words[0] in ARTICLES:
        words = words[1:]
    if len(words) > 1 and words[-1] in ARTICLES:
        words = words[:-1]
    return " ".join(words) or " ".join(re.findall(r"\w+", strip_accents(title).casefold())) or None


def voice_key(voice: str | None) -> str | None:
    """``voice`` without case, accents, outer blanks and remarks in brackets; null if nothing or UNKNOWN is left."""
    if voice is None:
        return None
    text = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", " ", voice)
    text = " ".join(strip_accents(text).casefold().split())
    return None if text in ("", "unknown") else text
