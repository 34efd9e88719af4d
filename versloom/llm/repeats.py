"""Problem 9: repetition inside a single document.

Each document is measured for repeated phrases, sentences and paragraphs.
Method of the decision: risk-controlled thresholds. On a labelled holdout, for
every stratum and for all together, cutoffs are tested from the strictest down;
a cutoff counts as safe while the exact binomial test rejects that more than
``risk`` of the good documents would be refused, at an error level divided by
the number of tests (Bonferroni), with the fixed order of the cutoffs taking
care of the rest. Documents at or above the cutoff of their stratum are
candidates, and the exact definition is checked on those.

The holdout is made from every document: its own repetition is taken out and
repetition of a known share is planted, so that the label is known without
being measured. Three of four cases set the cutoffs, the fourth shows what they
refuse and what they catch.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.functions.words import terms
from versloom.session import staged
from versloom.tables import table

#: Terms of a phrase, and characters that are measured at once.
PHRASE, SLICE = 8, 2_000_000
#: Fewest terms of a case of the holdout, and from which share on repetition is spam.
CASE, SPAM = 40, 0.3
_SENTENCE = re.compile(r"[.!?]+[\"'”’»)\]]*\s+|\n+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _repeated_exact(ids: np.ndarray, phrase: int) -> np.ndarray:
    seen: set = set()
    flags = np.zeros(len(ids), bool)
    for i in range(len(ids) - phrase + 1):
        key = tuple(ids[i : i + phrase])
        if key in seen:
            flags[i : i + phrase] = True
        seen.add(key)
    return flags


def repeated_flags(docs: list[list[str]], phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Number of terms of each document, and for every term of all whether it lies in a phrase that also occurs earlier in its document."""
    lengths = np.fromiter((len(d) for d in docs), np.int64, len(docs))
    n = int(lengths.sum())
    if n == 0:
        return lengths, np.zeros(0, bool)
    flat = pa.array([t for d in docs for t in d], pa.string()).dictionary_encode()
    ids = flat.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), lengths)
    if n < phrase:
        return lengths, np.zeros(n, bool)
    codes, width = _mixed(ids), n - phrase + 1
    h = _mixed(doc[:width])
    for k in range(phrase):
        h = h * np.uint64(0x100000001B3) + codes[k : k + width]
    at = np.flatnonzero(doc[:width] == doc[phrase - 1 :])
    order = at[np.argsort(h[at], kind="stable")]
    same = np.zeros(len(order), bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    later = order[same]
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))][same]
    equal = doc[later] == doc[first]
    for k in range(phrase):
        equal &= ids[later + k] == ids[first + k]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, later[equal], 1)
    np.add.at(edge, later[equal] + phrase, -1)
    flags = np.cumsum(edge[:-1]) > 0
    for d in np.unique(doc[later[~equal]]):  # phrases that differ behind the same hash
        lo, hi = np.searchsorted(doc, [d, d + 1])
        flags[lo:hi] = _repeated_exact(ids[lo:hi], phrase)
    return lengths, flags


def _per_document(lengths: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[np.concatenate(([0], np.cumsum(lengths)))])


def repeated_terms(docs: list[list[str]], phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Number of terms of each document, and of those in a phrase that also occurs earlier in it."""
    lengths, flags = repeated_flags(docs, phrase)
    return lengths, _per_document(lengths, flags)


def planted_case(terms_: list[str], repeated: np.ndarray, phrase: int = PHRASE) -> tuple[list[str], bool] | None:
    """A document with repetition of a known share, made from ``terms_`` without what they repeat, and whether it is spam; None below ``CASE`` terms.

    A stretch of the document is put in again at random places: one case of
    four up to 35 to 95 % of the terms (spam), the others up to 22 % (good, as
    documents with a refrain). Good ones also get lines shorter than a phrase
    many times, as lists and formulas have. The choice follows from the terms.
    """
    base = [t for t, again in zip(terms_, repeated.tolist(), strict=True) if not again]
    n = len(base)
    if n < CASE:
        return None
    rng = random.Random(zlib.crc32(" ".join(base).encode()))
    spam = rng.random() < 0.25
    share = rng.uniform(0.35, 0.95) if spam else rng.uniform(0.0, 0.22)
    length = rng.randint(phrase, max(phrase, min(5 * phrase, n // 4)))
    copies = max(int(spam), int(share / (1 - share) * n / length))
    at = rng.randrange(n - length + 1)
    parts = [base[at : at + length]] * copies
    if not spam:
        k = rng.randrange(n - phrase)
        parts += [base[k : k + rng.randint(2, phrase - 2)]] * rng.randint(0, n // 20)
    out, last = [], 0
    for p, part in sorted(zip((rng.randrange(n + 1) for _ in parts), parts, strict=True), key=lambda x: x[0]):
        out += base[last:p] + part
        last = p
    out += base[last:]
    return out, copies * length >= SPAM * len(out)




def _segment_share(text: str, pattern: re.Pattern[str]) -> float:
    """Share of the characters in segments that repeat an earlier one, without regard to case and outer blanks."""
    seen: set[str] = set()
    whole = again = 0
    for s in pattern.split(text):
        if s := s.strip().lower():
            whole += len(s)
            if s in seen:
                again += len(s)
            else:
                seen.add(s)
    return again / whole if whole else 0.0


_MEASURES = T.StructType().add("n_terms", "long").add("repeated_terms", "long").add("phrase_share", "double").add("sentence_share", "double").add("paragraph_share", "double")
_CASES = T.StructType().add("case_spam", "boolean").add("case_share", "double")


def repetition(df: DataFrame, text: str, phrase: int = PHRASE, cases: bool = False) -> DataFrame:
    """``df`` without ``text``, with measures of what its text repeats.

    ``n_terms`` and ``repeated_terms`` are exact: a term is repeated if it lies
    in ``phrase`` consecutive terms that also occur at an earlier position.
    ``phrase_share`` is their ratio; ``sentence_share`` and ``paragraph_share``
    are the shares of the characters in sentences (lines end sentences) and
    paragraphs (blank lines end them) seen before. A null, empty or very short
    text repeats nothing: all measures are 0. With ``cases`` each row also has
    ``case_spam``, the label of the case planted in its text, and
    ``case_share``, the phrase share measured in it; null for texts too short
    for one. Columns of ``df`` named like a measure are replaced. Repeated rows
    are measured each for itself. Texts are read whole; no shuffle is needed.
    """
    added = [*_MEASURES.fields, *(_CASES.fields if cases else [])]
    taken = {f.name for f in added}
    names = [c for c in df.columns if c != text and c not in taken]
    row = F.struct(*names).alias("_row") if names else F.struct(F.lit(1).alias("_none")).alias("_row")
    source = df.select(row, F.col(text).cast("string").alias("_text"))

    def share_of(again: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.divide(again, n, out=np.zeros(len(n)), where=n > 0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text")
            sizes = np.cumsum([0 if v is None else v for v in pc.utf8_length(column).to_pylist()])
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE, "right")))
                texts = [v or "" for v in column.slice(lo, hi - lo).to_pylist()]
                docs = [terms(t) for t in texts]
                n, flags = repeated_flags(docs, phrase)
                again = _per_document(n, flags)
                columns = [pa.array(n), pa.array(again), pa.array(share_of(again, n))]
                columns += [pa.array([_segment_share(t, p) for t in texts], pa.float64()) for p in (_SENTENCE, _PARAGRAPH)]
                if cases:
                    made = [planted_case(d, f, phrase) for d, f in zip(docs, np.split(flags, np.cumsum(n)[:-1]), strict=True)]
                    k, more = repeated_terms([c[0] if c else [] for c in made], phrase)
                    shares = share_of(more, k)
                    columns += [pa.array([c and c[1] for c in made], pa.bool_()), pa.array([s if c else None for c, s in zip(made, shares.tolist(), strict=True)], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(lo, hi - lo), *columns], names=["_row", *(f.name for f in added)])
                lo = hi

    out = source.mapInArrow(measure, T.StructType([source.schema["_row"], *added]))
    return out.select(*[F.col("_row")[c].alias(c) for c in names], *(f.name for f in added))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws with chance p."""
    if k >= n:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p <= 0)
    # from k away from the mean, until what follows is too small to count
    below = k <= n * p
    i, total = (k, 0.0) if below else (k + 1, 0.0)
    term = exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p))
    while term > total * 1e-17:
        total += term
        if i == (0 if below else n):
            break
        term *= i * (1 - p) / ((n - i + 1) * p) if below else (n - i) * p / ((i + 1) * (1 - p))
        i += -1 if below else 1
    return min(1.0, total) if below else max(0.0, 1 - total)


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate after k of n cases."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > error else (lo, mid)
    return hi


#: The stratum that stands for all together.
EVERY = "*"


def risk_controlled_cutoffs(holdout: DataFrame, stratum: str, score: str, good: str, risk: float = 0.02, error: float = 0.05, grid: int = 100, strictest: float = 1.0) -> DataFrame:
    """(stratum, cutoff, n_good, refused, bound, certified): the lowest score at which each stratum may refuse.

    ``holdout`` has a stratum, a score from 0 to 1 and whether the record is
    good. Cutoffs are tried from ``strictest`` down in steps of 1 / ``grid``;
    the lowest one before the first that fails is kept. The stratum ``*`` holds all records. With
    probability 1 - ``error`` no stratum refuses more than ``risk`` of its good
    records. A stratum with too few records to certify any cutoff has the
    cutoff null and ``certified`` false. Records with a null stratum, score or
    label don't count. What reaches the driver is one row for each stratum and
    step.
    """
    step = F.least(F.lit(grid), F.floor(F.col(score) * grid + 1e-9)).cast("int")
    known = holdout.where(F.col(stratum).isNotNull() & F.col(score).isNotNull() & F.col(good).isNotNull())
    rows = known.groupBy(F.col(stratum).alias("stratum"), step.alias("step")).agg(F.count_if(good).alias("n")).collect()
    by: dict = {EVERY: {}} if rows else {}
    for r in rows:
        for s in (r["stratum"], EVERY):
            counts = by.setdefault(s, {})
            counts[r["step"]] = counts.get(r["step"], 0) + r["n"]
    out = []
    for s, counts in by.items():
        first = round(strictest * grid)
        n, refused, best = sum(counts.values()), sum(c for k, c in counts.items() if k > first), None
        for k in range(first, 0, -1):
            refused += counts.get(k, 0)
            if not n or binomial_cdf(refused, n, risk) > error / len(by):
                break
            best = (k / grid, refused)
        out.append((s, best[0] if best else None, n, best[1] if best else None, upper_bound(best[1], n, error / len(by)) if best else None, best is not None))
    return holdout.sparkSession.createDataFrame(out, "stratum string, cutoff double, n_good long, refused long, bound double, certified boolean")


def with_cutoff(df: DataFrame, stratum: str, cutoffs: DataFrame) -> DataFrame:
    """``df`` with the ``cutoff`` of its stratum, or that of all together where its own is not certified; null where neither is.

    ``cutoffs`` has one row a stratum, as many as there are languages.
    """
    own = cutoffs.where(F.col("stratum") != EVERY).select(F.col("stratum").alias(stratum), F.col("cutoff").alias("_own"))
    whole = cutoffs.where(F.col("stratum") == EVERY).agg(F.max("cutoff").alias("_every"))  # one row
    both = df.drop("cutoff").join(F.broadcast(own), stratum, "left").crossJoin(F.broadcast(whole))
    return both.withColumn("cutoff", F.coalesce("_own", "_every")).drop("_own", "_every")


def _measured(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Measured documents with their strata (languages), and the cutoffs set by three of four cases.

    A cutoff above ``SPAM`` would let documents through that the problem asks
    for, so none is tried; where ``SPAM`` itself refuses too many good
    documents, the stratum has no cutoff of its own.
    """
    docs = table(spark, folder, "documents").select("doc_id", F.lower(F.substring(F.trim("lang"), 1, 2)).alias("stratum"), "text")
    m = staged(repetition(docs.withColumn("stratum", F.coalesce("stratum", F.lit("?"))), "text", cases=True), "repeats")
    m = m.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    return m, risk_controlled_cutoffs(m.where("NOT held").withColumn("good", ~F.col("case_spam")), "stratum", "case_share", "good", strictest=SPAM)


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    """Measured documents with ``refused``; without a certified cutoff none is refused on its score and ``open`` is true."""
    m, cutoffs = _measured(spark, folder)
    refused = F.coalesce(F.col("phrase_share") >= F.col("cutoff"), F.lit(False))
    return with_cutoff(m, "stratum", cutoffs).withColumn("refused", refused).withColumn("open", F.col("cutoff").isNull())


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents refused at the certified cutoff of their stratum (all where there is none); then the exact check of the definition."""
    exact = (F.col("n_terms") > 0) & (F.col("repeated_terms") * 10 >= F.col("n_terms") * 3)
    return _decided(spark, folder).where("refused OR open").where(exact).select("doc_id")


def p9_terms(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "n_terms", "repeated_terms")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select("doc_id", "n_terms", "repeated_terms", F.round("sentence_share", 6).alias("sentence_share"), F.round("paragraph_share", 6).alias("paragraph_share"), "refused")


def p9_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """The cutoffs, and what they do to the cases that did not set them: good ones and those refused, spam and what is caught."""
    m, cutoffs = _measured(spark, folder)
    held = with_cutoff(m.where("held AND case_spam IS NOT NULL"), "stratum", cutoffs).withColumn("hit", F.coalesce(F.col("case_share") >= F.col("cutoff"), F.lit(False)))
    counts = held.groupBy("stratum").agg(
        F.count_if(~F.col("case_spam")).alias("held_good"), F.count_if(~F.col("case_spam") & F.col("hit")).alias("held_refused"), F.count_if("case_spam").alias("held_spam"), F.count_if(F.col("case_spam") & F.col("hit")).alias("held_caught")
    )
    return cutoffs.join(counts, "stratum", "left")


_L = "[\\p{L}]"
P9_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(replace(replace(lower(nfc_normalize(text)), '’', ''''), '‘', ''''), '{_L}+(?:''{_L}+)*') AS ts FROM documents),
g AS (SELECT doc_id, i, array_to_string(ts[i:i + 7], ' ') AS p FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - 6)) AS i FROM t WHERE len(ts) >= 8)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS r FROM g) WHERE r > 1),
c AS (SELECT doc_id, sum(least(8, d)) AS n FROM (SELECT doc_id, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8) AS d FROM a) GROUP BY doc_id)
"""
QUERIES = {"p9_found": p9_found, "p9_terms": p9_terms, "p9_shares": p9_shares, "p9_cutoffs": p9_cutoffs}
ORACLE_SQL = {
    "p9_found": P9_SQL + "SELECT t.doc_id FROM t JOIN c USING (doc_id) WHERE n * 10 >= len(ts) * 3",
    "p9_terms": P9_SQL + "SELECT t.doc_id, CAST(coalesce(len(ts), 0) AS BIGINT) AS n_terms, CAST(coalesce(n, 0) AS BIGINT) AS repeated_terms FROM t LEFT JOIN c USING (doc_id)",
}
