"""Group-held-out classification: Burrows' Delta, nearest centroids, logistic regression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delta_distances(features: DataFrame, unit: str, label: str, slot: str, value: str) -> DataFrame:
    """(unit, truth, label, delta): Burrows' Delta of every unit to every class, leave-one-out.

    For each held-out unit the features are standardised with the mean and
    sample deviation of the others (0 counts as 1); a class is the mean of its
    standardised other units; Delta is the mean absolute difference. A class
    whose only member is held out is no candidate.

    The mean cancels in the difference of two standardised values, and the sums
    of the others are those of all less the unit's own, taken around the mean
    of the slot so that no digits are lost: the work is units by classes by
    slots, and no pairs of units are made.
    """
    f = features.select(F.col(unit).alias("unit"), F.col(label).alias("truth"), F.col(slot).alias("s"), F.col(value).cast("double").alias("v"))
    means = f.groupBy("s").agg(F.avg("v").alias("m"))
    x = f.join(means, "s").withColumn("x", F.col("v") - F.col("m")).drop("v", "m")
    every = x.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("squares"))
    classes = x.groupBy("s", F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("k"), F.sum("x").alias("class_sum"))
    n, rest = F.col("n") - 1, F.col("sum") - F.col("x")
    left = F.col("squares") - F.col("x") * F.col("x")
    var = F.when(n > 1, (left - rest * rest / n) / (n - 1))
    # what is left of a feature without variance is rounding: far below the size of its squares
    sd = F.when(var > 1e-24 + 1e-13 * F.col("squares"), F.sqrt(var)).otherwise(1.0)
    own = F.col("truth") == F.col("label")
    k = F.when(own, F.col("k") - 1).otherwise(F.col("k"))
    centre = (F.col("class_sum") - F.when(own, F.col("x")).otherwise(0.0)) / F.when(k > 0, k)
    z = x.join(every.where("n > 1"), "s").withColumn("sd", sd).join(classes, "s").where(k > 0).withColumn("d", F.abs(F.col("x") - centre) / F.col("sd"))
    return z.groupBy("unit", "truth", "label").agg(F.avg("d").alias("delta"))


def nearest(distances: DataFrame, unit: str, truth: str, label: str, distance: str, decimals: int = 12) -> DataFrame:
    """(unit, truth, guess): the label at the least distance; ties, to ``decimals``, go to the smaller label."""
    w = Window.partitionBy(unit).orderBy(F.round(distance, decimals), label)
    return distances.withColumn("r", F.row_number().over(w)).where("r = 1").select(unit, truth, F.col(label).alias("guess"))


def top_slots(features: DataFrame, slot: str, value: str, k: int) -> DataFrame:
    """The ``k`` slots with the highest mean; equal means go by slot."""
    means = features.groupBy(slot).agg(F.avg(value).alias("m"))
    return means.orderBy(F.desc(F.round("m", 12)), slot).limit(k).select(slot)


def centroid_loo(df: DataFrame, item: str, vector: str, label: str) -> DataFrame:
    """(item, truth, guess, distance): nearest class mean with the item's own vector taken out of its class.

    From the sums of the classes: linear in the rows. Classes of one have no
    mean without their only member and can't be guessed for it. Sent to the
    tasks are the class sums, as many as there are classes.
    """
    dims = df.select(label, F.posexplode(vector).alias("k", "x")).groupBy(label, "k").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda p: p["s"]).alias("sums"))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = sums.join(sizes, label).select(F.col(label).alias("guess"), "sums", "n")
    own = F.col(label) == F.col("guess")
    n = F.when(own, F.col("n") - 1).otherwise(F.col("n"))
    x = F.transform(vector, lambda v: v.cast("double"))
    mean = F.zip_with("sums", x, lambda s, v: F.when(own, s - v).otherwise(s) / n)
    distance = F.sqrt(F.aggregate(F.zip_with(mean, x, lambda m, v: (m - v) * (m - v)), F.lit(0.0), lambda a, d: a + d))
    j = df.crossJoin(F.broadcast(classes)).where(n > 0).select(item, F.col(label).alias("truth"), "guess", distance.alias("distance"))
    w = Window.partitionBy(item).orderBy(F.round("distance", 9), "guess")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


# --- logistic regression for many small fits


#: Unknowns of a fit beyond which the Newton steps come from conjugate gradients, without the matrix.
DENSE = 300


def _newton_step(z: np.ndarray, p: np.ndarray, weights: np.ndarray, penalty: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solution of Hessian times step = ``g`` by conjugate gradients, the more exact the smaller ``g`` is."""
    scale = (z**2).T @ (weights[:, None] * p * (1 - p)) + penalty[:, None] + 1e-10
    step, r = np.zeros_like(g), g.copy()
    q = r / scale
    v, rq = q.copy(), (r * q).sum()
    size = np.sqrt((g * g).sum())
    for _ in range(10 * g.size):
        if np.sqrt((r * r).sum()) <= min(0.1, size) * size:
            break
        m = p * (z @ v)
        hv = z.T @ (weights[:, None] * (m - p * m.sum(axis=1, keepdims=True))) + (penalty[:, None] + 1e-10) * v
        a = rq / (v * hv).sum()
        step, r = step + a * v, r - a * hv
        q = r / scale
        v, rq = q + (r * q).sum() / rq * v, (r * q).sum()
    return step


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, c: float = 1.0, classes: int | None = None, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression, sum of weighted losses + |W|^2 / (2C), intercept not penalised: (coefficients, intercepts).

    L2 without a penalty on the intercept does not change under rotation, so
    the fit runs in the at most n-1 coordinates that the rows span, by Newton
    steps with halving.
    """
    n, k = len(y), classes or int(y.max()) + 1
    centre = x.mean(axis=0)
    u, s, vt = np.linalg.svd(x - centre, full_matrices=False)
    keep = s > 1e-10 * max(1.0, s[0] if len(s) else 1.0)
    z = np.column_stack([u[:, keep] * s[keep], np.ones(n)])
    d = z.shape[1]
    onehot = np.eye(k)[y]
    w = np.zeros((d, k))
    penalty = np.ones(d) / c
    penalty[-1] = 0.0

    def state(w):
        m = z @ w
        m -= m.max(axis=1, keepdims=True)
        e = np.exp(m)
        p = e / e.sum(axis=1, keepdims=True)
        loss = -(weights * np.log(np.maximum(p[np.arange(n), y], 1e-300))).sum() + 0.5 * (penalty[:, None] * w**2).sum()
        return p, loss, z.T @ (weights[:, None] * (p - onehot)) + penalty[:, None] * w

    p, loss, g = state(w)
    for _ in range(steps):
        if np.abs(g).max() < 1e-9:
            break
        if k * d > DENSE:
            step = _newton_step(z, p, weights, penalty, g)
        else:
            h = np.zeros((k * d, k * d))
            for a in range(k):
                for b in range(k):
                    q = weights * p[:, a] * ((a == b) - p[:, b])
                    h[a * d : (a + 1) * d, b * d : (b + 1) * d] = z.T @ (q[:, None] * z) + (a == b) * np.diag(penalty)
            h[np.diag_indices(k * d)] += 1e-10
            step = np.linalg.lstsq(h, g.T.ravel(), rcond=None)[0].reshape(k, d).T
        t = 1.0
        while t > 1e-6:
            new = state(w - t * step)
            if new[1] <= loss:
                break
            t /= 2
        if t <= 1e-6:
            break
        w, (p, loss, g) = w - t * step, new
    w[-1] -= w[-1].mean()
    coef = (vt[keep].T @ w[:-1]).T
    return coef, w[-1] - coef @ centre


def balanced_weights(y: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """n / (classes * members) for each row, times ``base``."""
    counts = np.bincount(y)
    w = len(y) / ((counts > 0).sum() * counts[y])
    return w if base is None else w * base


def scaled(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides with mean and population deviation of ``train``; a deviation of 0 counts as 1."""
    mu, sd = train.mean(axis=0), train.std(axis=0)
    sd[sd == 0] = 1.0
    return (train - mu) / sd, (test - mu) / sd


def held_out_guesses(x: np.ndarray, y: np.ndarray, groups: np.ndarray, c: float = 1.0, base: np.ndarray | None = None) -> np.ndarray:
    """Guesses of a logistic regression trained without the group of each row; -1 where the rest has one class only."""
    out = np.full(len(y), -1)
    for g in np.unique(groups):
        test = groups == g
        known = np.unique(y[~test])
        if len(known) < 2:
            continue
        a, b = scaled(x[~test], x[test])
        own = np.searchsorted(known, y[~test])
        coef, icept = fit_logistic(a, own, balanced_weights(own, None if base is None else base[~test]), c, len(known))
        out[test] = known[np.argmax(b @ coef.T + icept, axis=1)]
    return out


def balanced_accuracy(y: np.ndarray, guess: np.ndarray) -> float:
    """Mean recall over the classes of ``y``; rows without a guess don't count."""
    ok = guess >= 0
    return float(np.mean([(guess[ok & (y == k)] == k).mean() for k in np.unique(y[ok])])) if ok.any() else float("nan")


def matrix_of(features: DataFrame, unit: str, label: str, slot: str, value: str, most: int = 20_000_000) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Units, matrix, label numbers and labels on the driver, for studies of a few hundred units; an error beyond ``most`` cells."""
    n = features.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{n} cells are too many for one matrix")
    frame = features.select(F.col(unit).alias("u"), F.col(label).alias("l"), F.col(slot).alias("s"), F.col(value).alias("v")).toPandas()
    wide = frame.pivot_table(index=["u", "l"], columns="s", values="v", fill_value=0.0).sort_index()
    labels = sorted(set(wide.index.get_level_values("l")))
    return [str(u) for u in wide.index.get_level_values("u")], wide.to_numpy(float), np.array([labels.index(x) for x in wide.index.get_level_values("l")]), labels


def per_task(spark, ids: list, work: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``work(id)`` for every id, spread over the tasks; for fits that share one small matrix."""
    base = spark.createDataFrame([(i,) for i in ids], "id long").repartition(min(len(ids), int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    names = T.StructType.fromDDL(schema).names

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for i in f["id"] for r in work(i)], columns=names)

    return base.mapInPandas(run, schema)


def unmasking(x: np.ndarray, y: np.ndarray, groups: np.ndarray, rounds: int = 10, drop: int = 5) -> list[tuple[int, float, int]]:
    """(round, balanced accuracy, features left): each round the features that weigh most are taken away."""
    left, out = np.arange(x.shape[1]), []
    for r in range(rounds):
        if len(left) <= drop:
            break
        out.append((r, balanced_accuracy(y, held_out_guesses(x[:, left], y, groups)), len(left)))
        a, _ = scaled(x[:, left], x[:1, left])
        coef, _ = fit_logistic(a, y, balanced_weights(y))
        left = np.delete(left, np.argsort(-np.abs(coef).mean(axis=0), kind="stable")[:drop])
    return out


def logistic_model(df: DataFrame, features: str, label: str, c: float = 1.0, weight: str | None = None):
    """MLlib's multinomial logistic regression with the penalty of a sum of losses: regParam = 1 / (C * total weight)."""
    from pyspark.ml.classification import LogisticRegression

    total = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", regParam=1.0 / (c * float(total)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9)
    return (lr.setWeightCol(weight) if weight else lr).fit(df)


def top_slots_by_fold(features: DataFrame, unit: str, slot: str, value: str, k: int) -> DataFrame:
    """(unit, slot): for each held-out unit the ``k`` slots with the highest mean over the others; equal means go by slot."""
    f = features.select(F.col(unit).alias("unit"), F.col(slot).alias("slot"), F.col(value).cast("double").alias("v"))
    sums = f.groupBy("slot").agg(F.sum("v").alias("t"), F.count(F.lit(1)).alias("n"))
    rest = f.join(sums, "slot").where("n > 1").withColumn("m", F.round((F.col("t") - F.col("v")) / (F.col("n") - 1), 10))
    w = Window.partitionBy("unit").orderBy(F.desc("m"), "slot")
    return rest.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("unit", "slot")


def arrangements_of(labels: list[str], most: int = 100_000) -> list[tuple[str, ...]]:
    """Every distinct arrangement of ``labels`` in order; an error if there are more than ``most``."""
    from versloom.functions.statistics import arrangements

    counts = {k: labels.count(k) for k in sorted(set(labels))}
    if (n := arrangements(list(counts.values()))) > most:
        raise ValueError(f"{n} arrangements: draw permutations instead")
    out: list[tuple[str, ...]] = []

    def place(left: dict[str, int], made: tuple[str, ...]) -> None:
        if len(made) == len(labels):
            out.append(made)
        for k, c in left.items():
            if c:
                place(left | {k: c - 1}, (*made, k))

    place(counts, ())
    return out


def forest_importance(df: DataFrame, features: str, label: str, trees: int = 100, seed: int = 42) -> list[float]:
    """Impurity importance of each feature in a random forest."""
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, seed=seed).fit(df)
    return [float(v) for v in model.featureImportances.toArray()]


def linear_svm(df: DataFrame, features: str, label: str, c: float = 1.0):
    """One-against-rest linear support vector machines (hinge loss)."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    svm = LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (c * df.count()), maxIter=20)
    return OneVsRest(classifier=svm, featuresCol=features, labelCol=label).fit(df)
