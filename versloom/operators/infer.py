"""Resampling inference: permutations, bootstrap, intervals, multiplicity.

Draws come from MD5 of a seed, the number of the replicate and the unit, so
that any engine gives the same tables, and no replicate depends on another:
replicates are just more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versloom.operators.positions import with_running_total


def _order(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def replicates(df: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` once for each replicate 0 to n-1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def permuted_labels(units: DataFrame, unit: str, label: str, n: int, stratum: str | None = None, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(perm_id[, stratum], unit, label[, keep]): labels shuffled over the units, within strata if one is given.

    The label of the unit at a place by name goes to the unit at the same place
    by hash; label counts stay in every stratum, and a stratum of one is fixed.
    ``keep`` names other columns that stay with their unit, so that no join with
    the units is needed after. Places by name are the same in every permutation
    and exist once. The join is a merge: Spark estimates exploded rows as if
    there was one permutation and would collect all of them on the driver.
    """
    within = [stratum] if stratum else []
    base = units.select(unit, label, *within, *keep)
    if stratum:
        by_name = base.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy(unit)) - 1)
    else:  # places in a global order, without a window over everything
        by_name = with_running_total(base.select(unit, label).withColumn("_one", F.lit(1)), [F.col(unit)], "_one", "_place")
    labels = by_name.select(*within, "_place", label)
    w = Window.partitionBy("perm_id", *within).orderBy(_order(seed, F.col("perm_id"), F.col(unit)), unit)
    places = replicates(base.drop(label), n, "perm_id").withColumn("_place", F.row_number().over(w) - 1)
    return places.join(labels.hint("merge"), [*within, "_place"]).select("perm_id", *within, unit, label, *keep)


def distinct_permutations(perms: DataFrame, unit: str, label: str, most: int) -> DataFrame:
    """The first ``most`` permutations whose assignments differ, by number."""
    whole = perms.groupBy("perm_id").agg(F.array_sort(F.collect_list(F.struct(unit, label))).alias("a"))
    first = whole.groupBy(F.md5(F.to_json("a")).alias("h")).agg(F.min("perm_id").alias("perm_id"))
    kept = first.orderBy("perm_id").limit(most).select("perm_id")
    return perms.join(kept, "perm_id", "left_semi")


def exceedance(null: DataFrame, observed: DataFrame, score: str, keys: list[str], plus_one: bool = True) -> DataFrame:
    """(keys, n, exceed, p, null_mean, null_sd, low, high) of a null against the observed score; null scores that are null count nowhere."""
    o = observed.select(*keys, F.col(score).alias("observed"))
    j = null.where(F.col(score).isNotNull()).join(o, keys) if keys else null.where(F.col(score).isNotNull()).crossJoin(o)
    by = [*keys, "observed"]
    hit = F.count_if(F.col(score) >= F.col("observed"))
    n = F.count(F.lit(1))
    p = (hit + 1) / (n + 1) if plus_one else hit / n
    return j.groupBy(*by).agg(n.alias("n"), hit.alias("exceed"), p.alias("p"), F.avg(score).alias("null_mean"), F.stddev_pop(score).alias("null_sd"), F.percentile(score, F.lit(0.025)).alias("low"), F.percentile(score, F.lit(0.975)).alias("high"))


def max_statistic(null: DataFrame, observed: DataFrame, variant: str, score: str) -> DataFrame:
    """(variant, observed, n, p_raw, p_adjusted): each variant against its own null and against the maximum over the family.

    A replicate counts only if every variant has a score in it.
    """
    size = observed.select(variant).distinct().count()
    whole = null.where(F.col(score).isNotNull()).groupBy("perm_id").agg(F.max(score).alias("top"), F.count_distinct(variant).alias("k")).where(F.col("k") == size)
    own = null.join(whole, "perm_id")
    j = own.join(observed.select(variant, F.col(score).alias("observed")), variant)
    return j.groupBy(variant, "observed").agg(
        F.count(F.lit(1)).alias("n"), ((F.count_if(F.col(score) >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_raw"), ((F.count_if(F.col("top") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_adjusted")
    )


def bootstrap_draws(units: DataFrame, unit: str, n: int, part: list[str] | None = None, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(boot_id, part, draw, unit[, keep]): as many draws with replacement as units, within each part.

    ``keep`` names other columns that come with the drawn unit. A unit without a
    name comes last. The join is a merge, as in :func:`permuted_labels`.
    """
    part = part or []
    base = units.select(unit, *part, *keep)
    if part:
        w = Window.partitionBy(*part)
        placed = base.withColumns({"_place": F.row_number().over(w.orderBy(F.asc_nulls_last(unit))) - 1, "_n": F.count(F.lit(1)).over(w)})
    else:  # places in a global order, without a window over everything
        placed = with_running_total(base.withColumn("_one", F.lit(1)), [F.asc_nulls_last(unit)], "_one", "_place").withColumn("_n", F.lit(units.count())).drop("_one")
    r = replicates(placed.select(*part, "_place", "_n"), n, "boot_id")
    pick = F.pmod(F.conv(F.substring(_order(seed, F.col("boot_id"), *[F.col(p) for p in part], F.col("_place")), 1, 12), 16, 10).cast("long"), F.col("_n"))
    drawn = r.select("boot_id", *part, F.col("_place").alias("draw"), pick.alias("_place"))
    return drawn.join(placed.drop("_n").hint("merge"), [*part, "_place"]).select("boot_id", *part, "draw", unit, *keep)


def interval(df: DataFrame, keys: list[str], score: str, level: float = 0.95, expected: int | None = None, least: float = 0.95) -> DataFrame:
    """(keys, n, mean, low, high) by percentiles; without bounds where fewer than ``least`` of the ``expected`` replicates are valid."""
    tail = (1 - level) / 2
    out = df.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.percentile(score, F.lit(tail)).alias("low"), F.percentile(score, F.lit(1 - tail)).alias("high"))
    if expected:
        ok = F.col("n") >= least * expected
        out = out.withColumns({"low": F.when(ok, F.col("low")), "high": F.when(ok, F.col("high"))})
    return out


def false_discovery(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """``df`` with Benjamini and Hochberg's adjusted p-values within ``keys`` as ``p_adjusted``; null p-values are left out of the family."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    valid = df.where(F.col(p).isNotNull())
    ranked = valid.withColumns({"_r": F.row_number().over(w.orderBy(p)), "_n": F.count(F.lit(1)).over(w)})
    raw = F.col(p) * F.col("_n") / F.col("_r")
    least = F.min("_q").over(w.orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("_q", raw).withColumn("p_adjusted", F.least(least, F.lit(1.0))).drop("_r", "_n", "_q")


def downsampled(df: DataFrame, label: str, item: str, n: int, seed: int = 42) -> DataFrame:
    """(draw_id, label, item, …): ``n`` samples in which every class has as many rows as the smallest."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("_least"))
    r = replicates(df, n, "draw_id")
    w = Window.partitionBy("draw_id", label).orderBy(_order(seed, F.col("draw_id"), F.col(item)), item)
    return r.withColumn("_r", F.row_number().over(w)).crossJoin(F.broadcast(sizes)).where(F.col("_r") <= F.col("_least")).drop("_r", "_least")  # one row


def jackknife_mean(df: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """(keys, unit, influence): how the mean of ``keys`` changes without each unit, from sums, without repeating the rest."""
    w = Window.partitionBy(*keys)
    s, n = F.sum(value).over(w), F.count(value).over(w)
    without = F.when(n > 1, (s - F.col(value)) / F.when(n > 1, n - 1))
    return df.where(F.col(value).isNotNull()).select(*keys, unit, (s / n - without).alias("influence"))
