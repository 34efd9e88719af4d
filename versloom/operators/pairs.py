"""Distances within and between classes of vectors, from moments instead of pairs where that is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn("_norm", norm).where("_norm > 0").withColumn("_u", F.transform(vector, lambda x: F.try_divide(x.cast("double"), F.col("_norm"))))


def cosine_moments(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, n, pairs, mean, sd): cosine distance over all pairs of a class, without making a pair.

    The mean follows from the sum of the unit vectors, the population deviation
    from the sum of their outer products: the work is linear in the rows. Zero
    vectors have no direction and are left out.
    """
    u = _unit_vectors(df, vector).select(label, "_u")
    first = u.select(label, F.posexplode("_u").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("s")).groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    outer = u.select(label, F.posexplode("_u").alias("i", "x"), "_u").select(label, "i", "x", F.posexplode("_u").alias("j", "y")).where("j >= i")
    second = outer.groupBy(label, "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("m")).groupBy(label).agg(F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(2) * F.col("m") * F.col("m")).alias("m2"))
    n = u.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    j = n.join(first, label).join(second, label).where("n > 1").withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    mean = (F.col("s2") - F.col("n")) / 2 / F.col("pairs")
    square = (F.col("m2") - F.col("n")) / 2 / F.col("pairs")
    return j.select(label, "n", "pairs", (1 - mean).alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd"))


def cosine_extremes(df: DataFrame, item: str, label: str, vector: str, block: int = 1024) -> DataFrame:
    """(label, least, most): smallest and largest cosine distance of a pair in each class.

    Every pair must be looked at for that. Classes are cut into blocks, and a
    task multiplies the vectors of two blocks: no task holds a class.
    """
    import numpy as np
    import pandas as pd

    u = _unit_vectors(df, vector)
    sizes = u.groupBy(label).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("_blocks"))
    b = u.join(sizes, label).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    cells = b.select(label, item, "_u", "_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o")).select(label, item, "_u", "_b", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))
    kind = df.schema[label].dataType.simpleString()

    def multiply(key, frame):
        m = np.stack(frame["_u"].to_numpy())
        d = 1 - m @ m.T
        ok = np.triu(np.ones(d.shape, bool), 1)
        if key[1] != key[2]:
            s = frame["_b"].to_numpy()
            ok &= s[:, None] != s[None, :]
        v = d[ok]
        return pd.DataFrame({"label": [key[0]], "least": [v.min() if len(v) else None], "most": [v.max() if len(v) else None]})

    return cells.groupBy(label, "_lo", "_hi").applyInPandas(multiply, f"label {kind}, least double, most double").groupBy("label").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def sampled_pairs(df: DataFrame, item: str, label: str, vector: str, n: int, same: bool, seed: int = 42) -> DataFrame:
    """(a, b, distance): pairs with equal or different labels, at most one for each item.

    The partner is the n-th next by hash within the label or, for different
    labels, within a sixteenth of all items by hash: the pairs are linear in
    the rows and no task holds them all.
    """
    from pyspark.sql import Window

    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string")))
    w = Window.partitionBy(label).orderBy(h, item) if same else Window.partitionBy(F.substring(h, 1, 1)).orderBy(h, item)
    u = _unit_vectors(df, vector)
    nxt = u.select(F.col(item).alias("a"), F.col(label).alias("la"), F.col("_u").alias("x"), F.lead(item, n).over(w).alias("b"), F.lead(label, n).over(w).alias("lb"), F.lead("_u", n).over(w).alias("y"))
    kept = nxt.where(F.col("b").isNotNull() & ((F.col("la") == F.col("lb")) == F.lit(same)))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return kept.select("a", "b", (1 - dot).alias("distance"))


def pseudo_f(df: DataFrame, label: str, vector: str, keys: list[str] | None = None) -> DataFrame:
    """([keys,] n, classes, within, total, f): PERMANOVA's statistic for squared Euclidean distances, from sums of the classes; for each of ``keys`` if given."""
    keys = keys or []
    x = df.select(*keys, label, F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    per = x.groupBy(*keys, label, "i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    apart = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    within = per.groupBy(*keys).agg(F.sum(apart).alias("within"), F.count_distinct(label).alias("classes"))
    whole = per.groupBy(*keys, "i").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    total = whole.groupBy(*keys).agg(F.sum(apart).alias("total"), F.max("n").alias("n"))
    j = within.join(total, keys) if keys else within.crossJoin(total)  # one row each
    f = (F.col("total") - F.col("within")) / (F.col("classes") - 1) / (F.col("within") / (F.col("n") - F.col("classes")))
    return j.select(*keys, "n", "classes", "within", "total", f.alias("f"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(index): agreement of two partitions beyond chance, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2
    both = cells.agg(F.sum(two(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("b"))
    j = both.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("a") * F.col("b") / two(F.col("n"))
    return j.select(F.try_divide(F.col("ab") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("index"))
