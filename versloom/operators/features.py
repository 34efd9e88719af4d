"""Lexical features of texts, in long form (unit, feature, value)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.functions import text as X
from versloom.functions.wordlists import FUNCTION_WORDS


def word_slots(words: list[str], profile: str = "slots") -> Column:
    """Array of (slot, word) for each slot of ``words``: every slot, the distinct words, or only the last slot of each word."""
    if profile not in ("slots", "distinct", "last"):
        raise ValueError("profile is slots, distinct or last")
    last = {w: i for i, w in enumerate(words)}
    rows = [(i, w) for i, w in enumerate(words) if profile == "slots" or (profile == "last" and last[w] == i) or (profile == "distinct" and words.index(w) == i)]
    return F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(w).alias("word")) for i, w in rows])


def word_profile(df: DataFrame, units: list[str], text: str, words: list[str] | None = None, tokenizer: str = "letters", profile: str = "slots") -> DataFrame:
    """(units, slot, word, n, total, per_1000) for every unit and slot.

    The frequency of a unit is the ratio of its sums, not a mean over texts.
    ``total`` counts all tokens of the tokenizer, or all words between blanks
    for the tokenizers trimmed and squeezed. Slots without a hit are 0, as is
    every slot of a unit without tokens. The tokens of a text are counted before
    anything is exchanged, and only list words leave the scan.
    """
    words = FUNCTION_WORDS if words is None else words
    own = sorted(set(words))
    tokens = X.TOKENIZERS[tokenizer](F.col(text))
    total = X.word_count(F.col(text)) if tokenizer in ("trimmed", "squeezed") else F.coalesce(F.size(tokens), F.lit(0))
    base = df.select(*units, tokens.alias("_tokens"), total.alias("_total"))
    totals = base.groupBy(*units).agg(F.sum("_total").alias("total"))
    listed = F.filter("_tokens", lambda t: t.isin(own))
    counts = base.select(*units, F.explode(listed).alias("word")).groupBy(*units, "word").agg(F.count(F.lit(1)).alias("n"))
    grid = totals.withColumn("_s", F.explode(word_slots(words, profile))).select(*units, "total", "_s.slot", "_s.word")
    same = [F.col(f"g.{u}").eqNullSafe(F.col(f"c.{u}")) for u in units] + [F.col("g.word") == F.col("c.word")]
    joined = grid.alias("g").join(counts.alias("c"), same, "left")
    n = F.coalesce(F.col("c.n"), F.lit(0))
    return joined.select(*[f"g.{u}" for u in units], "g.slot", "g.word", n.alias("n"), "g.total", X.per_thousand(n, F.col("g.total")).alias("per_1000"))


def top_ngrams(df: DataFrame, unit: str, text: str, n: int, k: int = 100) -> DataFrame:
    """(unit, gram, count, rank, per_1000): the ``k`` most frequent character n-grams of each text.

    Letters and spaces only, lower-cased; other characters, line breaks
    included, are deleted first. Equal counts go by the first occurrence. A
    text never leaves its task, so nothing is exchanged. Null and short texts
    give no row.
    """
    clean = F.regexp_replace(F.lower(text), "[^a-z ]", "")
    schema = T.StructType([df.schema[unit]]).add("gram", "string").add("n", "long").add("rank", "integer").add("per_1000", "double")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(0)
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t or len(t) < n:
                    continue
                total = len(t) - n + 1
                for rank, (gram, c) in enumerate(Counter(map("".join, zip(*(t[j:] for j in range(n))))).most_common(k), 1):
                    at.append(i)
                    rows.append((gram, c, rank, c / total * 1000))
            if rows:
                gram, c, rank, share = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([units.take(pa.array(at)), pa.array(gram), pa.array(c, pa.int64()), pa.array(rank, pa.int32()), pa.array(share)], names=schema.names)

    return df.select(unit, clean.alias("_clean")).mapInArrow(count, schema)


def hashed_ngrams(df: DataFrame, unit: str, text: str, n: int = 3, buckets: int = 1 << 14) -> DataFrame:
    """(unit, bucket, n, share): character n-grams hashed into ``buckets``; the shares of a unit add up to 1.

    The bucket comes from MD5, so that any engine can repeat it. Distinct
    n-grams are counted before they are hashed.
    """
    clean = X.ngram_text(F.col(text), apostrophes=False)
    schema = T.StructType([df.schema[unit]]).add("gram", "string").add("n", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict = {}
            for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and len(t) >= n:
                    by.setdefault(u, Counter()).update(map("".join, zip(*(t[j:] for j in range(n)))))
            for u, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(c), batch.schema.field(0).type), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=schema.names)

    counts = df.select(unit, clean.alias("_clean")).mapInArrow(count, schema).groupBy(unit, "gram").agg(F.sum("n").alias("n"))
    bucket = F.pmod(F.conv(F.substring(F.md5("gram"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    by = counts.groupBy(unit, bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    totals = by.groupBy(unit).agg(F.sum("n").alias("total"))
    return by.join(totals, unit).select(unit, "bucket", "n", (F.col("n") / F.col("total")).alias("share"))


def _equal_to(k: int):
    return lambda x: x == k


def _at_least(k: int):
    return lambda x: x >= k


def word_lengths(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the mean and population deviation of the lengths of the tokens, and the percentage of each length 1 to 7 and above; 0 without tokens."""
    sized = df.withColumn("_z", F.coalesce(F.transform(X.tokens_letters(F.col(text)), F.length), F.array().cast("array<int>")))
    add = lambda a, x: a + x
    counts = {f"_{k}": F.size(F.filter("_z", _at_least(8) if k == 8 else _equal_to(k))) for k in range(1, 9)}
    sums = sized.withColumns({"n_tokens": F.size("_z"), "_t": F.aggregate("_z", F.lit(0), add), "_q": F.aggregate("_z", F.lit(0), lambda a, x: a + x * x)} | counts)
    n = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    mean = F.coalesce(F.col("_t") / n, F.lit(0.0))
    var = F.coalesce(F.col("_q") / n - mean * mean, F.lit(0.0))
    out = {"mean_length": mean, "sd_length": F.sqrt(F.greatest(var, F.lit(0.0)))} | {f"pct_{k}": F.coalesce(F.col(f"_{k}") / n * 100, F.lit(0.0)) for k in range(1, 9)}
    return sums.withColumns(out).drop("_z", "_t", "_q", *counts)


def sentence_profile(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the number of sentences, mean words and mean characters of a sentence; 0 without any."""
    add = lambda a, x: a + x
    cut = df.withColumn("_s", F.coalesce(X.sentences(F.col(text)), F.array().cast("array<string>")))
    sums = cut.withColumns({
        "n_sentences": F.size("_s"),
        "_w": F.aggregate(F.transform("_s", lambda x: F.size(X.tokens_letters(x))), F.lit(0), add),
        "_c": F.aggregate(F.transform("_s", F.length), F.lit(0), add),
    })
    n = F.when(F.col("n_sentences") > 0, F.col("n_sentences"))
    return sums.withColumns({"mean_words": F.coalesce(F.col("_w") / n, F.lit(0.0)), "mean_chars": F.coalesce(F.col("_c") / n, F.lit(0.0))}).drop("_s", "_w", "_c")


def richness(df: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, tokens, types, hapax, ttr, hapax_ratio, yules_k) of each text."""
    tokens = df.select(unit, F.explode(X.tokens_letters(F.col(text))).alias("t"))
    per = tokens.groupBy(unit, "t").agg(F.count(F.lit(1)).alias("n"))
    by = per.groupBy(unit).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("n") == 1).alias("hapax"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    n = F.col("tokens")
    k = 10000.0 * (F.col("squares") - n) / (n * n)
    return by.select(unit, "tokens", "types", "hapax", (F.col("types") / n).alias("ttr"), (F.col("hapax") / F.col("types")).alias("hapax_ratio"), k.alias("yules_k"))


def divergence(df: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, jsd): Jensen-Shannon divergence in bits between the tokens of each unit and those of all units together."""
    tokens = df.select(unit, F.explode(X.tokens_letters(F.col(text))).alias("t"))
    by = tokens.groupBy(unit, "t").agg(F.count(F.lit(1)).alias("n"))
    every = by.groupBy("t").agg(F.sum("n").alias("m"))
    totals = by.groupBy(unit).agg(F.sum("n").alias("total"))
    whole = every.agg(F.sum("m").alias("whole"))
    p, q = F.col("n") / F.col("total"), F.col("m") / F.col("whole")
    mid = (p + q) / 2
    joined = by.join(every, "t").join(totals, unit).crossJoin(F.broadcast(whole))  # one row
    # words that the unit lacks add q/2 * log2(q / (q/2)) = q/2 each
    part = p / 2 * F.log2(p / mid) + q / 2 * F.log2(q / mid) - q / 2
    return joined.groupBy(unit).agg((F.sum(part) + 0.5).alias("jsd"))
