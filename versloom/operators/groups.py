"""Tables of counts, baselines and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versloom.functions.statistics import wilson


def contingency(df: DataFrame, row: str, column: str, sep: str | None = None) -> DataFrame:
    """(row, column, n); with ``sep`` a row counts in each of the values its column joins."""
    if sep:
        df = df.withColumn(column, F.explode(F.split(column, sep)))
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def collinearity(cells: DataFrame, row: str, column: str) -> DataFrame:
    """(rows, columns, filled, index): 1 - filled cells over all cells of a contingency table."""
    a = cells.where("n > 0").agg(F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("columns"), F.count(F.lit(1)).alias("filled"))
    return a.withColumn("index", 1 - F.try_divide(F.col("filled"), F.col("rows") * F.col("columns")))


def strata(df: DataFrame, column: str, sep: str = "/") -> DataFrame:
    """``df`` with the first of the values that ``column`` joins, Unknown for null."""
    return df.withColumn("stratum", F.coalesce(F.split(column, sep)[0], F.lit("Unknown")))


def baselines(df: DataFrame, label: str) -> DataFrame:
    """(n, classes, majority, majority_share, uniform, stratified, trivial_f1) of guessing without looking; equal counts go to the smaller label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    a = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("classes"), F.max("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
    best = counts.orderBy(F.desc("c"), label).limit(1).select(F.col(label).alias("majority"))
    share = F.col("m") / F.col("n")
    return a.crossJoin(best).select("n", "classes", "majority", share.alias("majority_share"), (1 / F.col("classes")).alias("uniform"), (F.col("s") / (F.col("n") * F.col("n"))).alias("stratified"), (2 * share / (share + 1) / F.col("classes")).alias("trivial_f1"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n) for every pair of labels, 0 included."""
    labels = df.select(F.col(truth).alias("l")).unionAll(df.select(F.col(guess))).where("l IS NOT NULL").distinct()
    grid = labels.select(F.col("l").alias("truth")).crossJoin(labels.select(F.col("l").alias("guess")))  # labels by labels
    cells = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cells, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1, recall_low, recall_high); what can't be divided is 0."""
    hit = F.col(truth) == F.col(guess)
    a = df.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(hit).alias("hits"))
    b = df.groupBy(F.col(guess).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    j = a.join(b, "label", "full").na.fill(0, ["support", "hits", "predicted"])
    p, r = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    low, high = wilson(F.col("hits"), F.col("support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return j.withColumns({"precision": p, "recall": r, "recall_low": low, "recall_high": high}).withColumn("f1", f1)


def summary_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(n, accuracy, balanced_accuracy, macro_f1, weighted_f1) over the classes that occur as truth."""
    m = class_metrics(df, truth, guess).where("support > 0")
    return m.agg(F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def group_weighted_accuracy(df: DataFrame, group: str, truth: str, guess: str) -> DataFrame:
    """(balanced): accuracy of each group, averaged over the groups of a class, then over classes."""
    by_group = df.groupBy(group, truth).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("a"))
    return by_group.groupBy(truth).agg(F.avg("a").alias("a")).agg(F.avg("a").alias("balanced"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the element at n div 2 of the sorted values, from 0; never an average of two."""
    w = Window.partitionBy(*keys)
    r = df.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})
    return r.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("median"))


def grouped_folds(sizes: list[tuple[str, int]], folds: int) -> dict[str, int]:
    """A fold for each group: the largest group goes to the emptiest fold; equal ones by name and number. For as many groups as a study has."""
    load, out = [0] * folds, {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        out[name], load[k] = k, load[k] + n
    return out
