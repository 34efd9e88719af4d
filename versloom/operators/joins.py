"""Lookups, matches and set operations between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a lookup table is sent to every task instead of being exchanged.
SMALL = 100_000


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if a count shows that it is small, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def override_lookup(df: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str, default: str | Column) -> DataFrame:
    """``df`` with ``value`` from the first lookup table that knows the row.

    Each table has its key columns and ``value``, unique by its keys; earlier
    tables win over later ones. Rows that none knows get ``default``.
    """
    found = []
    for i, (dim, keys) in enumerate(lookups):
        name = f"_value{i}"
        df = df.join(_small(dim.select(*keys, F.col(value).alias(name))), keys, "left")
        found.append(F.col(name))
    default = default if isinstance(default, Column) else F.lit(default)
    return df.withColumn(value, F.coalesce(*found, default)).drop(*[f"_value{i}" for i in range(len(lookups))])


def range_lookup(df: DataFrame, at: str, bands: DataFrame, low: str, high: str, value: str) -> DataFrame:
    """``df`` with ``value`` of the band [low, high) that holds ``at``; null without one. Bands may not overlap.

    The bands are few and checked to be: they are turned into one sorted array,
    and a row finds its band by its place in it, without a nested-loop join.
    """
    rows = bands.where(F.col(low).isNotNull()).orderBy(low).limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        from versloom.operators.sequences import floor_lookup

        both = floor_lookup(df.withColumn("_k", F.lit(1)), bands.withColumn("_k", F.lit(1)).withColumn("_band", F.struct(high, value)), ["_k"], at, low, "_band", "_band")
        inside = F.col(at) < F.col(f"_band.{high}")
        return both.withColumn(value, F.when(inside, F.col(f"_band.{value}"))).drop("_k", "_band")
    out = F.lit(None).cast(bands.schema[value].dataType)
    for r in reversed(rows):
        out = F.when((F.col(at) >= r[low]) & (F.col(at) < r[high]), F.lit(r[value])).otherwise(out)
    return df.withColumn(value, out)


def _rare_pairs(a: DataFrame, b: DataFrame, text: str, other: str, least: float) -> DataFrame:
    """(text, other): every pair that can reach the similarity ``least``, and some that can't.

    An edit changes at most two of the pairs of letters of a text with its ends
    marked, so similar texts have a number of them in common and must share one
    among their rarest (prefix filter). From one half down nothing need be shared.
    """
    if least <= 0.5:
        return a.crossJoin(b)

    def grams(df, c):
        s = F.concat(F.lit("\u0002"), F.lower(c), F.lit("\u0003"))
        g = df.select(c, F.length(F.lower(c)).alias("m"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length(F.lower(c)) + 1), lambda i: F.substring(s, i, F.lit(2)))).alias("at", "g"))
        return g.withColumn("nth", F.row_number().over(Window.partitionBy(c, "g").orderBy("at")))

    x, y = grams(a, text), grams(b, other)
    freq = x.select("g", "nth").unionAll(y.select("g", "nth")).groupBy("g", "nth").agg(F.count(F.lit(1)).alias("n"))

    def prefix(g, c):
        need = F.ceil((2 * least - 1) * F.col("m") + 1 - 1e-9)
        rank = F.row_number().over(Window.partitionBy(c).orderBy("n", "g", "nth"))
        return g.join(freq, ["g", "nth"]).withColumn("r", rank).where(F.col("r") <= F.col("m") + 2 - need).select(c, "g", "nth")

    return prefix(x, text).join(prefix(y, other), ["g", "nth"]).select(text, other)


def best_match(left: DataFrame, right: DataFrame, text: str, other: str, least: float = 0.7, length_share: float = 0.5, common_word: bool = False, equal: bool = True) -> DataFrame:
    """(text, other, similarity) for each distinct text its most similar distinct other.

    Similarity is 1 - edit distance / longer length, on lower-cased text; pairs
    whose lengths differ by more than ``length_share`` of the longer are not
    looked at, nor with ``common_word`` those that have no word in common, nor
    without ``equal`` a text and itself. The cheap conditions come before the
    edit distance and lose no pair of the similarity ``least``. Ties go to the
    smaller other. Texts without a match are left out; null and empty texts
    match nothing.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    a = left.select(text).where(F.col(text) != "").distinct()
    b = right.select(other).where(F.col(other) != "").distinct()
    la, lb = F.length(text), F.length(other)
    longer = F.greatest(la, lb)
    if common_word:
        met = a.select(text, F.explode(words(F.col(text))).alias("w")).join(b.select(other, F.explode(words(F.col(other))).alias("w")), "w")
    else:
        # lengths may differ by the edits allowed; lower case may be longer than what it is made of, never shorter
        met = _rare_pairs(a, b, text, other, least)
    apart = F.lit(True) if equal else F.col(text) != F.col(other)
    # an edit changes the length by at most one
    apart = apart & (F.abs(F.length(F.lower(text)) - F.length(F.lower(other))) <= (1 - least) * longer + 1e-9)
    pairs = met.where((F.abs(la - lb) <= length_share * longer) & apart).select(text, other).distinct()
    sim = 1 - F.levenshtein(F.lower(text), F.lower(other)) / longer
    scored = pairs.withColumn("similarity", sim).where(F.col("similarity") >= least)
    w = Window.partitionBy(text).orderBy(F.desc("similarity"), other)
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def agreement(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(n, matches, rate, kappa) between two sources that label the same keys, each key once."""
    both = a.select(*keys, F.col(label).alias("x")).join(b.select(*keys, F.col(label).alias("y")), keys)
    cells = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    # labels are few: the table of pairs is summed within each side, then over all
    total = cells.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("c"))), F.lit(0)).alias("matches"))
    margins = cells.select(F.col("x").alias("l"), F.col("c").alias("cx"), F.lit(0).cast("long").alias("cy")).unionByName(cells.select(F.col("y").alias("l"), F.lit(0).cast("long").alias("cx"), F.col("c").alias("cy")))
    chance = margins.groupBy("l").agg((F.sum("cx") * F.sum("cy")).alias("p")).agg(F.sum("p").alias("p"))
    joined = total.crossJoin(chance)  # one row each
    rate, expected = F.col("matches") / F.col("n"), F.col("p") / (F.col("n") * F.col("n"))
    return joined.select("n", "matches", rate.alias("rate"), F.when(expected < 1, (rate - expected) / (1 - expected)).alias("kappa"))


def set_relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(value, place) for every distinct value of two one-column tables: both, left or right."""
    x = a.toDF("value").where("value IS NOT NULL").select("value", F.lit(1).alias("l"), F.lit(0).alias("r"))
    y = b.toDF("value").where("value IS NOT NULL").select("value", F.lit(0).alias("l"), F.lit(1).alias("r"))
    g = x.unionAll(y).groupBy("value").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return g.select("value", F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("place"))


def with_sampled(df: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    """Rows whose key was drawn, once each however often it was drawn."""
    return df.join(sampled.select(key), key, "left_semi")


def corrected(df: DataFrame, key: str, fixes: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the values that ``fixes`` (key, columns) has for a row in place of its own, and ``fixed``: whether a value changed.

    A null in ``fixes`` changes nothing; of several fixes of a key the greatest
    values count. Fixes of unknown keys are left out. Keys are compared as they
    are, and rows with a null key stay as they are. A column ``fixed`` of
    ``df`` is replaced.
    """
    new = fixes.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(f"_new_{c}") for c in columns])
    both = df.join(_small(new), key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    out = both.withColumn("fixed", changed)
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])
