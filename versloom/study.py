"""A whole study: labelled units with features in, scores, nulls, intervals and a report out.

A study has one or more variants, each a table of features of the same units.
For every variant the balanced accuracy of a regression with whole groups held
out is observed, and set against nulls of shuffled labels (over all units, and
within strata), a bootstrap that refits every draw, the influence of each
group, penalties, pairs of classes and the study without each class. All fits
are rows of one table of jobs, worked off by the tasks and kept as they come,
so a study that was stopped goes on where it was.

    python -m versloom.study DATA OUT [--quick] [--permutations N] [--bootstraps N] [--folds K] [--no-checkpoint]
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versloom.operators import groups as G, infer as I, learn as L
from versloom.sources import sinks


@dataclass(frozen=True)
class Settings:
    """Replicates of a study. ``folds`` is the number of folds of whole groups; None holds out one group at a time."""

    permutations: int = 1000
    bootstraps: int = 1000
    penalties: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)
    folds: int | None = None
    seed: int = 42


QUICK = Settings(permutations=20, bootstraps=20, penalties=(0.1, 1.0, 10.0), folds=3)


#: What is fitted: the study itself, its nulls and its bootstrap, and what it is contrasted with.
KINDS = ("observed", "permuted", "blocked", "bootstrap", "without group", "penalty", "classes")


class Variant(NamedTuple):
    """One matrix of units by features, sorted by unit; labels and groups as numbers."""

    x: np.ndarray
    y: np.ndarray
    groups: np.ndarray
    strata: np.ndarray
    labels: list[str]
    names: list[str]


def variant_of(features: DataFrame, units: DataFrame, unit: str = "unit", label: str = "label", group: str = "group", stratum: str = "stratum", slot: str = "slot", value: str = "value") -> Variant:
    """``features`` (unit, slot, value) with what ``units`` (unit, label, group, stratum) says of each unit, on the driver.

    Units without a label or a group, and classes of a single unit, are left
    out; a null stratum is one of its own. The size is bounded by
    :func:`learn.matrix_of`, which refuses more cells than one machine holds.
    """
    known = units.where(F.col(label).isNotNull() & F.col(group).isNotNull()).dropDuplicates([unit])
    many = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(label)
    known = known.join(many, label, "left_semi")
    names, x, y, labels = L.matrix_of(features.join(known.select(unit, label), unit), unit, label, slot, value)
    of = {str(r[unit]): (str(r[group]), str(r[stratum])) for r in known.select(unit, group, stratum).collect()}  # as many rows as the matrix
    groups = np.unique([of[u][0] for u in names], return_inverse=True)
    strata = np.unique([of[u][1] for u in names], return_inverse=True)[1]
    return Variant(x, y, groups[1], strata, labels, groups[0].tolist())


def _folds(groups: np.ndarray, folds: int | None) -> np.ndarray:
    if folds is None:
        return groups
    sizes = [(int(g), int(n)) for g, n in zip(*np.unique(groups, return_counts=True), strict=True)]
    of = G.grouped_folds(sizes, folds)
    return np.array([of[int(g)] for g in groups])


def shuffled(y: np.ndarray, strata: np.ndarray | None, rng: np.random.RandomState) -> np.ndarray:
    """``y`` shuffled, within strata if they are given."""
    if strata is None:
        return rng.permutation(y)
    out = y.copy()
    for s in np.unique(strata):
        at = np.flatnonzero(strata == s)
        out[at] = out[at[rng.permutation(len(at))]]
    return out


def redrawn(y: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """As many rows of each class as it has, drawn with replacement. Clones keep their group, so none is in training and test at once."""
    return np.concatenate([rng.choice(np.flatnonzero(y == k), (y == k).sum()) for k in np.unique(y)])


def score(v: Variant, kind: str, detail: str, replicate: int, settings: Settings) -> float:
    """The balanced accuracy of one job; not a number where too few classes are left."""
    rng = np.random.RandomState(settings.seed + replicate)
    rows, y, c = np.arange(len(v.y)), v.y, 1.0
    if kind == "permuted":
        y = shuffled(y, None, rng)
    elif kind == "blocked":
        y = shuffled(y, v.strata, rng)
    elif kind == "bootstrap":
        rows = redrawn(y, rng)
    elif kind == "without group":
        rows = np.flatnonzero(v.groups != v.names.index(detail))
    elif kind == "penalty":
        c = float(detail)
    elif kind == "classes":
        wanted = [v.labels.index(x) for x in detail.split(" | ")]
        rows = np.flatnonzero(np.isin(y, wanted))
    y = y[rows]
    if len(np.unique(y)) < 2:
        return float("nan")
    return L.balanced_accuracy(y, L.held_out_guesses(v.x[rows], y, _folds(v.groups[rows], settings.folds), c=c))


def jobs_of(variants: dict[str, Variant], settings: Settings) -> list[tuple[int, str, str, str, int]]:
    """(perm_id, variant, kind, detail, replicate) of every fit; the number of a job depends on names and settings only."""
    out = []
    for name, v in sorted(variants.items()):
        out.append((name, "observed", "", 0))
        out += [(name, kind, "", i) for kind in ("permuted", "blocked") for i in range(settings.permutations)]
        out += [(name, "bootstrap", "", i) for i in range(settings.bootstraps)]
        out += [(name, "without group", g, 0) for g in v.names]
        out += [(name, "penalty", str(c), 0) for c in settings.penalties]
        out += [(name, "classes", " | ".join(p), 0) for p in combinations(v.labels, 2)]
        if len(v.labels) > 2:
            out += [(name, "classes", " | ".join(x for x in v.labels if x != k), 0) for k in v.labels]
    return [(i, *row) for i, row in enumerate(dict.fromkeys(out))]


_SCORES = "perm_id long, variant string, kind string, detail string, replicate int, score double"


def run_study(spark: SparkSession, variants: dict[str, Variant], settings: Settings = QUICK, folder: str | None = None, batch: int = 500, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Scores (perm_id, variant, kind, detail, replicate, score) of all jobs of the ``kinds`` asked for.

    With ``folder`` batches of jobs are written there and those already there
    are not done again.
    """
    shared = spark.sparkContext.broadcast(variants)
    table = spark.createDataFrame([job for job in jobs_of(variants, settings) if job[2] in kinds], _SCORES.rsplit(",", 1)[0])
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(frames):
        for f in frames:
            got = [score(shared.value[r.variant], r.kind, r.detail, r.replicate, settings) for r in f.itertuples()]
            yield f.assign(score=pd.Series(got, dtype=float))[["perm_id", "variant", "kind", "detail", "replicate", "score"]]

    def scores(jobs: DataFrame) -> DataFrame:
        return jobs.repartition(slots, "perm_id").mapInPandas(work, _SCORES)

    if folder is None:
        return scores(table)
    store = sinks.ReplicateStore(spark, folder, _SCORES)
    return store.run(table, lambda ids: scores(table.join(ids, "perm_id", "left_semi")), batch).drop("batch")


def summary(scores: DataFrame, settings: Settings = QUICK) -> DataFrame:
    """(variant, test, observed, n, p, p_family, p_adjusted, low, high) of every variant.

    ``p_family`` is against the highest score of all variants under the same
    shuffle (maxT), ``p_adjusted`` Benjamini and Hochberg's over the variants;
    ``low`` and ``high`` bound the refitted bootstrap, null where fewer than 95
    % of the draws could be fitted.
    """
    valid = scores.where(~F.isnan("score"))
    observed = valid.where("kind = 'observed'").select("variant", "score")
    bounds = I.interval(valid.where("kind = 'bootstrap'"), ["variant"], "score", expected=settings.bootstraps).select("variant", "low", "high")
    out = None
    for test in ("permuted", "blocked"):
        null = valid.where(F.col("kind") == test).select(F.col("replicate").alias("perm_id"), "variant", "score")
        own = I.exceedance(null, observed, "score", ["variant"]).select("variant", F.lit(test).alias("test"), "observed", "n", "p")
        family = I.max_statistic(null, observed, "variant", "score").select("variant", F.col("p_adjusted").alias("p_family"))
        part = own.join(family, "variant", "left")
        out = part if out is None else out.unionByName(part)
    return I.false_discovery(out, ["test"], "p").join(bounds, "variant", "left").select("variant", "test", "observed", "n", "p", "p_family", "p_adjusted", "low", "high")


def contrasts(scores: DataFrame) -> DataFrame:
    """(variant, kind, detail, score, change): the scores without a group, by penalty and for chosen classes, against what was observed."""
    observed = scores.where("kind = 'observed'").select("variant", F.col("score").alias("_observed"))
    kept = scores.where("kind IN ('without group', 'penalty', 'classes') AND NOT isnan(score)")
    return kept.join(observed, "variant").select("variant", "kind", "detail", "score", (F.col("score") - F.col("_observed")).alias("change"))


def study_report(scores: DataFrame, settings: Settings) -> str:
    return sinks.report("Study", {"Settings": str(settings), "Tests": summary(scores, settings).orderBy("variant", "test"), "Contrasts": contrasts(scores).orderBy("variant", "kind", "detail"), "Environment": str(sinks.environment())})


def document_variants(docs: DataFrame) -> dict[str, Variant]:
    """Variants of units of source, genre and language (``docs`` with source, genre, lang and text): function words, the most frequent of them, and hashed letter trigrams."""
    from versloom.operators import features

    named = docs.where("source IS NOT NULL AND genre IS NOT NULL").withColumn("unit", F.concat_ws("/", "source", "genre", F.coalesce("lang", F.lit("?"))))
    units = named.select("unit", F.col("genre").alias("label"), F.col("source").alias("group"), F.coalesce("lang", F.lit("?")).alias("stratum")).distinct()
    words = features.word_profile(named, ["unit"], "text").select("unit", "slot", F.col("per_1000").alias("value"))
    grams = features.hashed_ngrams(named, "unit", "text", 3, 256).select("unit", F.col("bucket").alias("slot"), F.col("share").alias("value"))
    return {name: variant_of(f, units) for name, f in {"words": words, "first_50": words.where("slot < 50"), "trigrams": grams}.items()}


def main(args: list[str] | None = None) -> int:
    from versloom.plans.text_queries import _lang
    from versloom.session import build_session
    from versloom.tables import table

    parser = argparse.ArgumentParser(prog="versloom.study", description="Runs a study over the documents of a data folder.")
    parser.add_argument("data")
    parser.add_argument("out")
    parser.add_argument("--quick", action="store_true")
    parser.add_argument("--permutations", type=int)
    parser.add_argument("--bootstraps", type=int)
    parser.add_argument("--folds", type=int)
    parser.add_argument("--master", default="local[8]")
    parser.add_argument("--no-checkpoint", action="store_true", help="start anew instead of going on")
    a = parser.parse_args(args)
    base = QUICK if a.quick else Settings()
    settings = Settings(a.permutations or base.permutations, a.bootstraps or base.bootstraps, base.penalties, a.folds or base.folds, base.seed)
    spark = SparkSession.getActiveSession() or build_session(a.master)
    place = f"{a.out}/scores-{settings.permutations}-{settings.bootstraps}-{settings.folds or 0}"
    if a.no_checkpoint:
        sinks.ReplicateStore(spark, place).clear()
    docs = table(spark, a.data, "documents").select("source", "genre", _lang("lang").alias("lang"), "text")
    scores = run_study(spark, document_variants(docs), settings, place)
    summary(scores, settings).coalesce(1).write.mode("overwrite").json(f"{a.out}/summary")
    spark.createDataFrame([(study_report(scores, settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/report")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
