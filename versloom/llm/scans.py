"""Problem 2: noise in text from scanned pages.

Method: line classifiers tell running headers and page numbers from text, and a
line-pair classifier decides how a word broken at a line end goes together.
Candidates for misread words come from an inverted join of character q-grams
over the distinct words (prefix filtering: two words one confusion apart share
one of their four rarest bigrams), and gradient-boosted trees choose the
replacement. All models are trained here, on bounded samples: lines and words
of the collection itself, damaged on purpose, and headers that an older
clean-up logged.

A volume may hold a large part of all lines. Lines are therefore read in chunks
of line numbers with a margin on either side; only distinct words, of which no
volume holds many, are joined.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.llm.boosting import BoostedTrees
from versloom.operators.positions import with_running_total
from versloom.session import staged
from versloom.tables import latest_rows, table

#: Lines of a chunk, lines of its margins, and the most titles, lines and words that models are trained on.
CHUNK, MARGIN, TITLES, LINES, WORDS = 2048, 64, 400, 4000, 4000
#: How many times more often than the misread form a replacement occurs that counts as sure, for the counts of confusions.
RATIO = 8

# What scanners put for a character or two, as (read, meant).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("3", "b"), ("2", "z"), ("4", "a"), ("7", "t"), ("ã", "a"), ("à", "a"),
    ("c", "e"), ("e", "c"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("nn", "m"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("j", "i"), ("i", "j"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"),
    ("f", "s"), ("s", "f"), ("f", "t"), ("t", "f"), ("n", "u"), ("u", "n"), ("b", "h"), ("h", "b"), ("y", "v"), ("v", "y"), ("h", "li"), ("li", "h"), ("o", "c"), ("c", "o"), ("q", "g"), ("g", "q"), ("ri", "n"), ("in", "m"), ("k", "lc"), ("lc", "k"),
]
# What may stand for a digit.
DIGITS = {"0": "0OoQD", "1": "1lIi|!", "2": "2Zz", "3": "3B", "4": "4A", "5": "5Ss", "6": "6bG", "7": "7T", "8": "8&B", "9": "9gq"}
HYPHENS = "-‐­¬="
_LIKE = set("".join(DIGITS.values()))
_STRIP = ".,;:?!()[]{}\"“”‘’'`«»*—–-_"
_CONTENTS = r"(?i)^\W*(TABLE\s+OF\s+)?C\s*[O0]\s*N\s*T\s*E\s*N\s*T\s*[S5]\W*(OR\s+INDEX\W*)?$"
_CHAPTER = r"^\s*CHAP[A-Z0-9]*\b[.\s]+[A-Za-z0-9]+\W*$"
_FIRST = r"^\s*CHAP[A-Z0-9]*\b[.\s]+[I1l]\W*$"
_FOLD = str.maketrans("01l|!IJL58Q", "OIIIIIIISBO")


def _letters(text: str) -> str:
    return re.sub(r"[^A-Z]", "", text.replace("l", "I").upper().translate(_FOLD))


def _number_like(token: str) -> bool:
    token = token.strip("[]()-—–.,:")
    return 0 < len(token) <= 5 and all(c in _LIKE for c in token)


@lru_cache(maxsize=4096)
def _title_letters(title: str) -> tuple[str, str]:
    """The letters of a title with and without its article."""
    wanted = _letters(title)
    return (wanted, wanted[3:]) if wanted.startswith("THE") else (wanted, "THE" + wanted)


def header_likeness(line: str, title: str | None) -> tuple[float, float]:
    """How much a line looks like the title, at most 1, and whether it does so beside a number.

    Ratios are worked out only where the lengths let them be higher than what is known.
    """
    tokens = line.split()
    forms = [tokens]
    if len(tokens) > 1:
        forms += [tokens[1:]] * _number_like(tokens[0]) + [tokens[:-1]] * _number_like(tokens[-1])
    like = number = 0.0
    for k, form in enumerate(forms):
        text = _letters("".join(form))
        for w in _title_letters(title or ""):
            if not text or not w:
                continue
            near, most = abs(len(text) - len(w)) <= 6, 2 * min(len(text), len(w)) / (len(text) + len(w))
            if not (near and most > like or k and not number and most > 0.8):
                continue
            s = SequenceMatcher(None, text, w, autojunk=False).ratio()
            like = max(like, s) if near else like
            number = 1.0 if k and s > 0.8 else number
    return like, number


def header_features(line: str, title: str | None, blank_before: bool, blank_after: bool, chapter_after: bool, known: tuple[float, float] | None = None) -> list[float]:
    """How much a line looks like the volume's title, with or without a number, and what stands around it."""
    like, number = known or header_likeness(line, title)
    tokens = line.split()
    alpha = [c for c in line if c.isalpha()]
    upper = sum(c.isupper() for c in alpha) / max(1, len(alpha))
    starts = sum(t[0].isupper() for t in tokens if t[0].isalpha()) / max(1, sum(t[0].isalpha() for t in tokens))
    return [like, number, upper, starts, len(line.strip()) / max(1, len(title or "")), blank_before, blank_after, chapter_after]


def page_features(line: str) -> list[float]:
    """How much a line looks like a page number alone."""
    s = line.strip()
    core = re.sub(r"^(?:p\.|P\.|page|Page)\s*", "", s)
    core = core.strip("[](){}-—–. ")
    like = sum(c in _LIKE for c in core)
    return [like / max(1, len(core)), len(core), sum(c.isdigit() for c in core), float(core != s), s.count(" "), len(s)]


def _damaged(rng: random.Random, text: str, digits: bool) -> str:
    chars = list(text)
    for i, c in enumerate(chars):
        if rng.random() < 0.08:
            if c.isdigit():
                chars[i] = rng.choice(DIGITS[c])
            elif not digits:
                chars[i] = rng.choice({"O": "0Q", "I": "l1", "S": "5", "B": "8", "E": "F", "D": "0", "i": "l"}.get(c, c))
    return "".join(chars)


def _headers_like(rng: random.Random, title: str) -> str:
    t = title.strip().rstrip(".,:")
    t = t[4:] if t.upper().startswith("THE ") and rng.random() < 0.5 else t
    t += rng.choice([".", ".", "", ",", ":"])
    t = rng.choice([t, t, t.title(), " ".join(t.replace(" ", "  "))])
    t = _damaged(rng, t, False)
    for _ in range(rng.choice([0, 0, 0, 1, 2])):  # a sign that no list foresees
        k = rng.randrange(len(t))
        t = t[:k] + rng.choice("ABCEFHIKLMNPRTUVX0178") + t[k + 1 :] if t[k].isalpha() else t
    number, gap = _damaged(rng, str(rng.randint(1, 999)), True), " " * rng.choice([1, 1, 3, 9])
    return rng.choice([t, f"{number}{gap}{t}", f"{t}{gap}{number}"])


def train_line_models(titles: list[str], lines: list[str], logged: list[tuple[str, str]], seed: int = 7) -> tuple[BoostedTrees, BoostedTrees]:
    """Classifiers for running headers and page numbers.

    ``titles`` are titles of volumes, ``lines`` any lines of text, ``logged``
    pairs of a title and a header that was found under it.
    """
    rng = random.Random(seed)
    x, y, px, py = [], [], [], []
    coin = lambda: rng.random() < 0.5
    titles = titles or ["THE BOOK OF NOTHING."]
    for line, title in [(_headers_like(rng, t), t) for t in titles for _ in range(6)] + [(h, t) for t, h in logged]:
        x.append(header_features(line, title, coin(), coin(), rng.random() < 0.05))
        y.append(1)
    for t in titles:
        for line in (t, _damaged(rng, t, False)):
            x.append(header_features(line, t, True, True, True))
            y.append(0)
        if _letters(other := rng.choice(titles)) != _letters(t):
            x.append(header_features(other, t, coin(), coin(), coin()))
            y.append(0)
    for line in lines:
        f = header_features(line, rng.choice(titles), coin(), coin(), rng.random() < 0.1)
        if f[0] < 0.75:  # else perhaps a header itself
            x.append(f)
            y.append(0)
        f = page_features(line)
        if f[0] < 1 or f[1] > 5:  # else perhaps a page number itself
            px.append(f)
            py.append(0)
        for word in [w for w in line.split()[:3] if len(w) > 2]:
            px.append(page_features(word))
            py.append(float(word.isdigit()))
    for _ in range(1500):
        n = _damaged(rng, str(rng.randint(1, rng.choice([9, 99, 999, 1999]))), True)
        px.append(page_features(rng.choice([n, f"({n})", f"[{n}]", f"— {n} —", f"- {n} -", f"p. {n}", f"    {n}"])))
        py.append(1)
    for text in ("CHAPTER I.", "CHAPTER XII.", "C0NTENTS", "Iosib.", "Bobol!", "soil."):
        px.append(page_features(text))
        py.append(0)
    return BoostedTrees(rounds=100).fit(x, y), BoostedTrees().fit(px, py)


def volume_facts(lines: DataFrame) -> DataFrame:
    """(doc_id, chapter_at, title_at, title, toc_at): the first chapter heading of each volume, the title above it and the heading of its table of contents."""
    chapter = F.col("line").rlike(_CHAPTER)
    first = lines.groupBy("doc_id").agg(F.min(F.when(chapter, F.col("line_no"))).alias("chapter_at"))
    above = lines.join(first, "doc_id").where((F.trim("line") != "") & (F.col("line_no") < F.col("chapter_at")))
    last = F.max(F.struct("line_no", "line"))
    toc = F.min(F.when(F.col("line").rlike(_CONTENTS), F.col("line_no")))
    facts = above.groupBy("doc_id", "chapter_at").agg(last.alias("t"), toc.alias("toc_at"))
    titled = F.regexp_count("t.line", F.lit("[A-Z]")) * 2 > F.regexp_count("t.line", F.lit("[A-Za-z]"))
    facts = facts.select("doc_id", "toc_at", F.when(titled, F.col("t.line_no")).alias("title_at"), F.when(titled, F.col("t.line")).alias("title"))
    return first.join(facts, "doc_id", "left")


_KINDS = "doc_id string, line_no int, line string, kind string, left string, right string, goes_on boolean, starts boolean"


def classify_lines(lines: DataFrame, facts: DataFrame, models: tuple[BoostedTrees, BoostedTrees]) -> DataFrame:
    """Every line with its kind and what it shares with the next line of text.

    Kinds: blank, front, toc, title, heading, header, page_number, text.
    ``left`` and ``right`` are the parts of a word broken at the end of the
    line; ``goes_on`` says that the first word of the line is the rest of such
    a word, ``starts`` that a paragraph begins.
    """
    header_model, page_model = models
    own = F.floor(F.col("line_no") / CHUNK).cast("int")
    near = F.array_distinct(F.array(F.floor((F.col("line_no") - MARGIN) / CHUNK).cast("int"), own, F.floor((F.col("line_no") + MARGIN) / CHUNK).cast("int")))
    spread = lines.join(facts, "doc_id", "left").withColumn("chunk", F.explode(near))

    def classify(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_no", kind="stable").reset_index(drop=True)
        text = frame["line"].fillna("").tolist()
        at = frame["line_no"].to_numpy()
        n = len(text)
        blank = [not t.strip() for t in text]
        f = frame.iloc[0]
        chapter_at, title_at, toc_at, title = f["chapter_at"], f["title_at"], f["toc_at"], f["title"]
        title = title if isinstance(title, str) else None
        body = title_at if pd.notna(title_at) else chapter_at
        chapter = [bool(re.match(_CHAPTER, t)) for t in text]
        kinds, hx, hi, px, pi = ["text"] * n, [], [], [], []
        follow = n
        following = [n] * n
        for i in range(n - 1, -1, -1):
            following[i] = follow
            if not blank[i]:
                follow = i
        for i, t in enumerate(text):
            if blank[i]:
                kinds[i] = "blank"
            elif pd.notna(body) and at[i] < body:
                kinds[i] = "toc" if pd.notna(toc_at) and at[i] >= toc_at else "front"
            elif pd.notna(title_at) and at[i] == title_at:
                kinds[i] = "title"
            elif chapter[i]:
                kinds[i] = "heading"
            else:
                if len(t.strip()) <= 14:
                    px.append(page_features(t))
                    pi.append(i)
                if title and 0.5 <= len(re.sub(r"[^A-Za-z0-9]", "", t)) / max(1, len(_letters(title))) <= 1.6:
                    known = header_likeness(t, title)
                    if known[0] > 0.5:
                        after = following[i] < n and bool(re.match(_FIRST, text[following[i]]))
                        hx.append(header_features(t, title, i == 0 or blank[i - 1], i + 1 >= n or blank[i + 1], after, known))
                        hi.append(i)
        if hx:
            for i, p, x in zip(hi, header_model.predict(hx), hx, strict=True):
                if p > 0.5:
                    kinds[i] = "header"
                elif x[0] > 0.8 and x[5] and x[6] and x[7]:
                    kinds[i] = "title"
        if px:
            for i, p in zip(pi, page_model.predict(px), strict=True):
                if p > 0.5:
                    kinds[i] = "page_number"
        left, right = [None] * n, [None] * n
        goes_on, starts = np.zeros(n, bool), np.zeros(n, bool)
        width = float(np.quantile([len(t) for t, k in zip(text, kinds, strict=True) if k == "text"] or [0], 0.9))
        before, gap, furniture = None, False, False
        for i in range(n):
            if kinds[i] == "text":
                if before is None:
                    starts[i] = True
                elif not goes_on[i]:
                    ended = text[before].rstrip().rstrip("\"'”’)").endswith((".", "!", "?"))
                    starts[i] = ended and ((gap and not furniture) or len(text[before]) < 0.75 * width)
                words = text[i].split()
                if words and words[-1][-1] in HYPHENS and len(words[-1].rstrip(HYPHENS)) > 0:
                    j = next((j for j in range(i + 1, n) if kinds[j] not in ("blank", "header", "page_number")), None)
                    if j is not None and kinds[j] == "text":
                        part, rest = words[-1].rstrip(HYPHENS).lstrip(_STRIP), text[j].split()[0].rstrip(_STRIP)
                        if part and rest and part[-1].isalpha() and rest[0].isalpha():
                            left[i], right[i] = part.lower(), rest.lower()
                            goes_on[j] = True
                before, gap, furniture = i, False, False
            elif kinds[i] == "blank":
                gap = True
            elif kinds[i] in ("header", "page_number"):
                furniture = True
            else:
                before = None
        mine = at // CHUNK == int(key[1])
        out = pd.DataFrame({"doc_id": frame["doc_id"], "line_no": at, "line": text, "kind": kinds, "left": left, "right": right, "goes_on": goes_on, "starts": starts})
        return out[mine]

    return spread.groupBy("doc_id", "chunk").applyInPandas(classify, _KINDS)


def _stripped(token: Column) -> Column:
    marks = r"[.,;:?!()\[\]{}\"“”‘’'`«»*—–_\-]"
    return F.regexp_replace(token, rf"^{marks}+|{marks}+$", "")


def running_words(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, at, raw, word): whole words of text lines in lower case; parts of broken words are left out."""
    tokens = F.filter(F.split("line", r"(?U)\s+"), lambda t: t != "")
    at = lines.where("kind = 'text'").select("doc_id", "line_no", "goes_on", F.col("left").isNotNull().alias("broken"), F.size(tokens).alias("n"), F.posexplode(tokens).alias("at", "raw"))
    whole = at.where(~(F.col("goes_on") & (F.col("at") == 0)) & ~(F.col("broken") & (F.col("at") == F.col("n") - 1)))
    return whole.select("doc_id", "line_no", "at", _stripped(F.col("raw")).alias("raw")).withColumn("word", F.lower("raw")).where("word rlike '\\\\p{L}'")


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n, volumes, capital): how often and in how many volumes a word occurs, and which share of it with a capital."""
    capital = F.sum((F.substring("raw", 1, 1) != F.substring("word", 1, 1)).cast("long"))
    by = words.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"), capital.alias("c"))
    return by.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("volumes"), (F.sum("c") / F.sum("n")).alias("capital"))


# --- words broken at a line end

_JOIN = ["joined", "hyphened", "n_left", "n_right", "len_left", "len_right"]


def train_join_model(words: dict[str, int], seed: int = 7) -> BoostedTrees:
    """Whether a broken word keeps a hyphen, from words cut on purpose: compounds at their hyphen, others anywhere, some as if never seen."""
    rng, x, y = random.Random(seed), [], []
    for w, n in words.items():
        for _ in range(12 if "-" in w else 1):
            if "-" in w.strip("-"):
                a, b = w.rsplit("-", 1)
                joined, hyphened, keep = words.get(a + b, 0), n, 1
            else:
                if len(w) < 4:
                    continue
                k = rng.randint(2, len(w) - 2)
                a, b, hyphened, keep = w[:k], w[k:], 0, 0
                joined = 0 if rng.random() < 0.1 else n
            x.append([*np.log1p([joined, hyphened, words.get(a, 0), words.get(b, 0)]), len(a), len(b)])
            y.append(keep)
    if not x:
        x, y = [[0.0] * 6, [0.0] * 6], [0, 0]
    return BoostedTrees(rounds=20).fit(x, y)


def joined_words(lines: DataFrame, words: DataFrame, model: BoostedTrees) -> DataFrame:
    """(left, right, whole): every distinct pair of broken parts as one word."""
    pairs = lines.where("left IS NOT NULL").select("left", "right").distinct()
    forms = pairs.withColumns({"solid": F.concat("left", "right"), "compound": F.concat_ws("-", "left", "right")})
    for name, form in (("joined", "solid"), ("hyphened", "compound"), ("n_left", "left"), ("n_right", "right")):
        forms = forms.join(words.select(F.col("word").alias(form), F.col("n").alias(name)), form, "left")

    def decide(frames):
        for f in frames:
            x = np.column_stack([np.log1p(f[c].fillna(0).to_numpy(float)) for c in _JOIN[:4]] + [f["left"].str.len(), f["right"].str.len()])
            keep = model.predict(x) > 0.5 if len(f) else np.zeros(0, bool)
            yield pd.DataFrame({"left": f["left"], "right": f["right"], "whole": np.where(keep, f["compound"], f["solid"])})

    return forms.mapInPandas(decide, "left string, right string, whole string")


# --- misread words


def one_confusion(read: str, meant: str) -> tuple[str, str] | None:
    """The stretch in which two words differ, if it has at most two characters on one side and one on the other."""
    if read == meant:
        return None
    i, end = 0, min(len(read), len(meant))
    while i < end and read[i] == meant[i]:
        i += 1
    j = 0
    while j < end - i and read[-1 - j] == meant[-1 - j]:
        j += 1
    a, b = read[i : len(read) - j], meant[i : len(meant) - j]
    # an equal character may belong to either side: "vv" for "w" after a v
    if a and not b and i:
        a, b = read[i - 1] + a, read[i - 1]
    if b and not a and i:
        a, b = read[i - 1], read[i - 1] + b
    return (a, b) if a and b and len(a) + len(b) <= 3 else None


_FEATURES = ["n_meant", "n_read", "ratio", "known", "seen", "odd", "length", "len_a", "len_b", "first", "v_read", "capital", "choices"]
_KNOWN = set(CONFUSIONS)


def _pair_features(read, meant, a, b, n_read, n_meant, v_read, cap_read, cap_meant, seen, choices) -> list[float]:
    return [
        np.log1p(n_meant), np.log1p(n_read), np.log(n_meant / max(1, n_read)), float((a, b) in _KNOWN), np.log1p(seen), float(not read.replace("-", "").replace("'", "").isalpha() or "ã" in read),
        len(meant), len(a), len(b), float(read[0] != meant[0]), np.log1p(v_read), abs(cap_read - cap_meant), choices,
    ]


def train_ranker(words: dict[str, tuple[int, float]], seen: dict[tuple[str, str], int], seed: int = 7) -> BoostedTrees:
    """Chance that a candidate is what was meant, from words damaged on purpose and from words that are merely rare.

    ``words`` has the count and share of capitals of a sample, ``seen`` how many
    distinct words of the collection show a confusion.
    """
    words = {w: v for w, v in words.items() if len(w) <= 40}
    rng, keys = random.Random(seed), defaultdict(set)
    for w in words:
        for size in (1, 2):
            for i in range(len(w) - size + 1):
                keys[w[:i], w[i + size :]].add(w)

    def candidates(read: str, n_read: int, ratio: int = 1) -> list[tuple[str, str, str]]:
        found = {m for size in (1, 2) for i in range(len(read) - size + 1) for m in keys.get((read[:i], read[i + size :]), ())}
        out = []
        for m in sorted(found):
            if words[m][0] > n_read and words[m][0] >= ratio * n_read and (ab := one_confusion(read, m)):
                out.append((m, *ab))
        return out

    x, y = [], []
    for w, (n, capital) in words.items():
        if len(w) < 3 or not w.isalpha() or any((p, q) in _KNOWN for _, p, q in candidates(w, n, RATIO)):
            continue  # perhaps a misread word itself
        spots = [(i, a, b) for a, b in CONFUSIONS for i in range(len(w) - len(b) + 1) if w.startswith(b, i)]
        # frequent words are misread more often, in count and in number of ways
        for i, a, b in rng.sample(spots, min(3 + n // 30, 24, len(spots))) if n >= 2 else []:
            read = w[:i] + a + w[i + len(b) :]
            if read in words:
                continue
            # one sign in many is misread, and in one of several ways
            n_read = max(1, int(n / 2 ** (4 + 6 * rng.random())))
            found = candidates(read, n_read)
            own = rng.choice([0.0, capital, float(rng.random() < capital)]) if capital < 0.9 else capital  # a few occurrences show their share badly
            for m, p, q in found:
                x.append(_pair_features(read, m, p, q, n_read, words[m][0], rng.randint(1, n_read), own, words[m][1], seen.get((p, q), 0), len(found)))
                y.append(float(m == w))
        # a word as often as it occurs, as if it were rare, and nearly as often as what it looks like
        for n_read in (n, rng.choice([1, 1, 2, 3, 5, 8]), None):
            found = [c for c in candidates(w, n_read or 1) if c[0] != w]
            for m, p, q in found:
                k = n_read or int(words[m][0] / 2 ** (3 * rng.random()))
                if n_read or k >= 8:
                    x.append(_pair_features(w, m, p, q, k, words[m][0], rng.randint(1, k), capital, words[m][1], seen.get((p, q), 0), len(found)))
                    y.append(0.0)
    if not any(y):
        x, y = [[0.0] * len(_FEATURES)] * 2, [0.0, 0.0]
    return BoostedTrees(rounds=60, depth=4).fit(x, y)


def candidate_pairs(words: DataFrame) -> DataFrame:
    """(read, meant, a, b, …) for words one confusion apart of which ``meant`` is more frequent.

    A confusion destroys at most three bigrams of either word, so the two share
    one among the four that are rarest in the vocabulary: only those are joined.
    """
    from pyspark.sql import Window


    def cut(frames):
        for f in frames:
            pairs = [(w, g) for w in f["word"] for g in {a + b for a, b in zip("^" + w, w + "$", strict=True)}]
            yield pd.DataFrame(pairs, columns=["word", "gram"])

    grams = words.select("word").mapInPandas(cut, "word string, gram string")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("in_words"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("in_words", "gram"))
    prefix = staged(grams.join(counts, "gram").withColumn("r", rank).where("r <= 4").join(words, "word").select("word", "gram", "n", "volumes", "capital"), "grams")
    read = prefix.select(F.col("word").alias("read"), "gram", F.col("n").alias("n_read"), F.col("volumes").alias("v_read"), F.col("capital").alias("cap_read"))
    meant = prefix.select(F.col("word").alias("meant"), "gram", F.col("n").alias("n_meant"), F.col("capital").alias("cap_meant")).where("n_meant >= 2")
    near = (F.col("n_meant") > F.col("n_read")) & (F.abs(F.length("read") - F.length("meant")) <= 1) & (F.length("read") >= 2)
    pairs = read.join(meant, "gram").where(near).drop("gram").distinct()

    def differ(frames):
        for f in frames:
            ab = [one_confusion(r, m) for r, m in zip(f["read"], f["meant"], strict=True)]
            ok = np.array([x is not None for x in ab], bool)
            f = f[ok].copy()
            # as text even where none is left: an empty list would be a column of numbers, which Arrow can't turn into text
            for k, side in enumerate("ab"):
                f[side] = pd.Series([x[k] for x in ab if x], f.index, object)
            yield f

    return pairs.mapInPandas(differ, T.StructType([*pairs.schema.fields, T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))


def corrections(words: DataFrame) -> DataFrame:
    """(read, meant): words of the vocabulary that are misread, and what they should be: the candidate the ranker thinks likeliest, if above one half."""
    from pyspark.sql import Window

    pairs = staged(candidate_pairs(words), "candidates")
    sure = pairs.where(f"n_meant >= {RATIO} * n_read")
    table_ = sure.groupBy("a", "b").agg(F.count_distinct("read").alias("seen"))
    counts = staged(table_.where("seen > 1"), "confusions")
    # for the training only; the candidates are joined with all counts
    seen = {(r["a"], r["b"]): r["seen"] for r in counts.orderBy(F.desc("seen"), "a", "b").limit(5000).collect()}
    frequent = words.orderBy(F.desc("n"), "word").limit(WORDS // 2)
    others = words.where("n >= 4").orderBy(F.xxhash64("word")).limit(WORDS // 2)
    sample = frequent.union(others).distinct().orderBy("word").collect()  # at most WORDS rows
    ranker = train_ranker({r["word"]: (r["n"], r["capital"]) for r in sample}, seen)
    scored = pairs.join(counts, ["a", "b"], "left").na.fill(0, ["seen"]).withColumn("choices", F.count(F.lit(1)).over(Window.partitionBy("read")))

    def rank(frames):
        for f in frames:
            x = [_pair_features(r.read, r.meant, r.a, r.b, r.n_read, r.n_meant, r.v_read, r.cap_read, r.cap_meant, r.seen, r.choices) for r in f.itertuples()]
            yield pd.DataFrame({"read": f["read"], "meant": f["meant"], "p": ranker.predict(np.array(x)) if x else np.zeros(0)})

    best = scored.mapInPandas(rank, "read string, meant string, p double").groupBy("read").agg(F.max(F.struct("p", "meant")).alias("best"))
    return best.where("best.p > 0.5").select("read", F.col("best.meant").alias("meant"))


# --- the whole


class Repair:
    """The stages of one collection of scanned lines, each written once."""

    def __init__(self, lines: DataFrame, log: DataFrame | None = None):
        """``lines`` (doc_id, line_no, line, scanned_at); ``log`` as in preprocessing_log.

        Of repeated and late rows of a line the latest counts. Rows without a
        volume or a number are left out, null lines are blank. An empty table
        gives empty results.
        """
        key = F.concat_ws("\u0001", "doc_id", "line_no")
        rows = lines.where("doc_id IS NOT NULL AND line_no IS NOT NULL").select(key.alias("_key"), "doc_id", F.col("line_no").cast("int").alias("line_no"), F.coalesce("line", F.lit("")).alias("line"), "scanned_at")
        self.lines = staged(latest_rows(rows, "_key", "scanned_at", ["doc_id", "line_no", "line"]).drop("_key"), "lines")
        self.facts = staged(volume_facts(self.lines), "facts")
        titles = [r["title"] for r in self.facts.where("title IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(TITLES).collect()]
        some = [r["line"] for r in self.lines.where("line rlike '[a-z]' AND NOT line rlike '^\\\\W*[A-Z]{4}'").orderBy(F.xxhash64("doc_id", "line_no")).limit(LINES).collect()]
        logged = []
        if log is not None:
            found = log.select("doc_id", F.explode("stats.page_headers_matched.text").alias("text")).where("text rlike '[A-Za-z]{3}'").distinct()
            logged = [(r["title"], r["text"]) for r in found.join(self.facts.where("title IS NOT NULL"), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(TITLES).select("title", "text").collect()]
        self.kinds = staged(classify_lines(self.lines, self.facts, train_line_models(titles, some, logged)), "kinds")
        self.words = running_words(self.kinds)
        self.vocabulary = staged(vocabulary(self.words), "vocabulary")
        sample = self.vocabulary.orderBy(F.desc(F.col("word").contains("-")), F.desc(F.least("n", F.lit(20))), F.xxhash64("word")).limit(WORDS).collect()
        self.whole = staged(joined_words(self.kinds, self.vocabulary, train_join_model({r["word"]: r["n"] for r in sample})), "whole")
        self.corrections = staged(corrections(self.vocabulary), "corrections")

    def found(self) -> DataFrame:
        """(doc_id, line_no, kind, word): what was found on which line; see ``p2_found`` in the data description."""
        empty = F.lit("").alias("word")
        furniture = self.kinds.where("kind IN ('header', 'page_number', 'toc')").select("doc_id", "line_no", "kind", empty)
        broken = self.kinds.where("left IS NOT NULL").join(self.whole, ["left", "right"]).select("doc_id", "line_no", F.lit("hyphen").alias("kind"), F.col("whole").alias("word"))
        misread = self.words.join(self.corrections.withColumnRenamed("read", "word"), "word").select("doc_id", "line_no", F.lit("misread").alias("kind"), F.col("meant").alias("word"))
        return furniture.unionByName(broken).unionByName(misread).distinct()

    def paragraphs(self) -> DataFrame:
        """(doc_id, first_line, last_line, text): continuous paragraphs, without furniture and with words whole and corrected."""
        text = self.kinds.where("kind = 'text'")
        escaped = F.regexp_replace("raw", r"([\[\]\\.^$*+?(){}|])", r"\\$1")
        whole_word = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), escaped, F.lit(r"(?![\p{L}\p{N}])"))
        capital = F.concat(F.upper(F.substring("meant", 1, 1)), F.expr("substring(meant, 2)"))
        cased = F.when(F.substring("raw", 1, 1).rlike(r"\p{Lu}"), capital).otherwise(F.col("meant"))
        fixes = self.words.join(self.corrections.withColumnRenamed("read", "word"), "word").select("doc_id", "line_no", whole_word.alias("raw"), cased.alias("meant"))
        fixes = fixes.groupBy("doc_id", "line_no").agg(F.collect_set(F.struct("raw", "meant")).alias("fixes"))
        whole = text.join(self.whole, ["left", "right"], "left").join(fixes, ["doc_id", "line_no"], "left")
        mended = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<raw:string,meant:string>>")), F.col("line"), lambda line, f: F.regexp_replace(line, f["raw"], f["meant"]))
        # the whole word stands where it began; the rest leaves the next line
        head = F.regexp_replace(F.trim(mended), r"\S+$", "")
        tail = F.regexp_extract(F.trim("line"), r"(\S+)$", 1)
        hyphened = F.col("whole") == F.concat_ws("-", "left", "right")
        stem = F.regexp_replace(tail, f"[{HYPHENS}\\s]+$", "")
        line = F.when(F.col("left").isNull(), mended).otherwise(F.concat(head, stem, F.when(hyphened, "-").otherwise(""), F.lit("\u0002")))
        flat = whole.select("doc_id", "line_no", "starts", F.trim(line).alias("line"))
        numbered = with_running_total(flat.withColumn("start", F.col("starts").cast("int")), [F.col("doc_id"), F.col("line_no")], "start")
        by = numbered.withColumn("paragraph", F.col("before") + F.col("start")).groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
        joined = F.regexp_replace(F.array_join("ls.line", " "), "\u0002\\s*", "")
        return by.select("doc_id", F.col("ls")[0]["line_no"].alias("first_line"), F.element_at("ls", -1)["line_no"].alias("last_line"), joined.alias("text"))


def _repair(spark: SparkSession, folder: str) -> Repair:
    return Repair(table(spark, folder, "raw_lines"), table(spark, folder, "preprocessing_log"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repair(spark, folder).found()


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return _repair(spark, folder).paragraphs()


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
