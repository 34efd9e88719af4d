import random

import numpy as np
import pytest

from versloom.llm import scans as S
from versloom.llm.boosting import BoostedTrees


def test_boosting():
    rng = np.random.RandomState(0)
    x = rng.rand(2000, 5)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    assert np.allclose(m.predict(x), BoostedTrees().fit(x[:1500], y[:1500]).predict(x))
    assert BoostedTrees().fit(np.zeros((3, 2)), np.zeros(3)).predict(np.zeros((1, 2)))[0] < 0.1


@pytest.mark.parametrize(("read", "meant", "want"), [("orcharcl", "orchard", ("cl", "d")), ("larnent", "lament", ("rn", "m")), ("c0w", "cow", ("0", "o")), ("hstened", "listened", ("h", "li")), ("vvas", "was", ("vv", "w")), ("same", "same", None), ("abcd", "wxyz", None)])
def test_one_confusion(read, meant, want):
    assert S.one_confusion(read, meant) == want


def test_contents_and_chapter_patterns():
    import re

    assert all(re.match(S._CONTENTS, t) for t in ("C0NTENTS", "TABLE OF CONTENTS", "CONTENTS, OR INDEX", "Contents."))
    assert not re.match(S._CONTENTS, "the contents of the chest") and re.match(S._CHAPTER, "CHAPTER IV.") and not re.match(S._CHAPTER, "CHAPTER IV. The king")


def volume(rng, name, vocabulary, lines=260):
    """A volume with all kinds of noise, and what is wrong on which line."""
    title = f"THE BOOK OF {name.upper()}."
    text, truth = [], set()
    add = lambda t, *kinds: (text.append(t), [truth.add((name, len(text), k, w)) for k, w in kinds])
    add("PREFATORY NOTE.")
    add(" ".join(rng.choice(vocabulary) for _ in range(6)) + ".")
    add("")
    add("C0NTENTS", ("toc", ""))
    add("1. the old tower .... 3", ("toc", ""))
    add("")
    add("2. the king — 1O", ("toc", ""))
    add("")
    add(title)
    add("")
    add("CHAPTER I.")
    add("")
    page, part = 3, None
    for i in range(lines):
        words, kinds = [rng.choice(vocabulary) for _ in range(8)], []
        if part:
            words.insert(0, part)
            part = None
        elif rng.random() < 0.06:
            k = rng.randrange(1, 8)
            w = words[k]
            a, b = rng.choice([("0", "o"), ("c", "e"), ("rn", "m"), ("cl", "d"), ("5", "s"), ("j", "i"), ("u", "n")])
            if b in w and "-" not in w and len(w) > 4:
                words[k] = w.replace(b, a, 1)
                kinds.append(("misread", w))
        line = " ".join(words)
        if rng.random() < 0.2 and i < lines - 1:
            w = rng.choice(vocabulary)
            cut = w.index("-") if "-" in w else rng.randrange(2, max(3, len(w) - 2))
            if len(w) > 4:
                line += " " + w[:cut] + rng.choice("-‐¬=") + rng.choice(["", " "])
                part = w[cut + 1 :] if "-" in w else w[cut:]
                kinds.append(("hyphen", w))
        add(line + ("" if part else rng.choice(["", "", ".", ","])), *kinds)
        if i % 24 == 23:
            page += 1
            if rng.random() < 0.5:
                add(rng.choice([f"{page} BOOK OF {name.upper()}.", f"BOOK OF {name.upper()}. {page}", f"Book Of {name.title()}.      {page}", f"BOOK OF {name.upper()[:-1]}0."]), ("header", ""))
            else:
                add(rng.choice([f"— {page} —", f"({page})", f"    {page}", str(page)]), ("page_number", ""))
            if rng.random() < 0.5:
                add("")
    return text, truth


def test_planted_noise_is_found(spark):
    rng = random.Random(11)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    vocabulary = ["".join(syllable() for _ in range(rng.randint(2, 4))) + rng.choice(["", "dom", "ed", "ness"]) for _ in range(250)] + ["hill-dweller", "corn-field"]
    rows, truth = [], set()
    for name in ("Rumedo", "Takosuli", "Venagora", "Polimesi", "Dobarefu", "Zukamani"):
        text, wrong = volume(rng, name, vocabulary)
        truth |= wrong
        rows += [(name, n, t, n) for n, t in enumerate(text, 1)]
    rows += [rows[5], ("Rumedo", None, "x", 1), (None, 3, "x", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, line_no int, line string, s int").selectExpr("doc_id", "line_no", "line", "timestamp_seconds(s) AS scanned_at")
    repair = S.Repair(df)
    got = {tuple(r) for r in repair.found().collect()}
    for kind in ("header", "page_number", "toc", "hyphen", "misread"):
        mine, theirs = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(mine & theirs) >= 0.9 * len(theirs), (kind, sorted(theirs - mine)[:5])
        assert len(mine & theirs) >= 0.9 * len(mine), (kind, sorted(mine - theirs)[:5])
    text = " ".join(r.text for r in repair.paragraphs().collect())
    assert "BOOK OF" not in text and "—" not in text and not any(h in text for h in "‐¬=")


def test_empty_and_plain_tables(spark):
    schema = "doc_id string, line_no int, line string, scanned_at timestamp"
    assert S.Repair(spark.createDataFrame([], schema)).found().count() == 0
    one = spark.createDataFrame([("d", 1, None, None), ("d", 2, "a plain line of words", None), ("e", 1, "x" * 100_000, None)], schema)
    assert S.Repair(one).found().count() == 0


def test_rare_words_have_candidates(spark):
    """A misreading of a word seen a few times reaches the ranker; a word that is not more frequent is no candidate."""
    words = [("bigisore", 4), ("biglsore", 1), ("pugepibi", 3), ("pugeplbi", 1), ("house", 90), ("hoase", 20), ("even", 2), ("evcn", 2)]
    df = spark.createDataFrame([(w, n, 1, 0.0) for w, n in words], "word string, n long, volumes long, capital double")
    got = {(r.read, r.meant) for r in S.candidate_pairs(df).collect()}
    assert got == {("biglsore", "bigisore"), ("pugeplbi", "pugepibi"), ("hoase", "house")}


def test_words_alike_without_a_confusion(spark):
    """Words that share a rare bigram but are more than a confusion apart: a batch without any candidate gives no rows, not an error."""
    df = spark.createDataFrame([("abc", 5, 1, 0.0), ("axy", 1, 1, 0.0)], "word string, n long, volumes long, capital double")
    assert S.candidate_pairs(df).collect() == []
    lines = spark.createDataFrame([("d", n, line, None) for n, line in enumerate(("abc abc", "abc axy", "abc abc"), 1)], "doc_id string, line_no int, line string, scanned_at timestamp")
    repair = S.Repair(lines)
    assert repair.found().collect() == [] and [r.text for r in repair.paragraphs().collect()] == ["abc abc abc axy abc abc"]
