"""Problem 5: capping records per dominant contributor.

Method: a global range sort by contributor and descending score; the counts of
the partitions, summed up, give every row its exact position; the position at
which its contributor starts is subtracted, and positions below the cap stay.
A contributor that holds a third of all rows simply spans many partitions:
no task ever holds a contributor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.llm.blocks import current_blocks, run_number, voice_key
from versloom.operators.positions import partition_table, range_sorted
from versloom.tables import latest_rows, table


def rank_in_contributor(df: DataFrame, contributor: str, score: str, item: str, out: str = "place") -> DataFrame:
    """``df`` with ``out``: 0 for the best row of its ``contributor``, 1 for the next and so on.

    Better is the higher ``score``; null and NaN scores are below all others;
    equal scores go by the smaller ``item``, and rows that are equal in all
    three (repeated rows) get different places in an undefined order. Rows with
    a null ``contributor`` form one contributor of their own; callers that
    exempt them filter before. An empty table gives an empty table. Other
    columns are kept as they are; one named ``out`` is replaced.
    """
    s = F.when(F.isnan(F.col(score).cast("double")), F.lit(None)).otherwise(F.col(score).cast("double"))
    key = F.coalesce(F.concat(F.lit("="), F.col(contributor).cast("string")), F.lit(""))
    base = df.select(F.struct(*df.columns).alias("_row"), key.alias("_key"), s.alias("_score"), F.col(item).alias("_item"))
    ordered = range_sorted(base, [F.col("_key").asc(), F.col("_score").desc_nulls_last(), F.col("_item").asc_nulls_last()])
    # what is collected: one row a partition
    bounds = partition_table(ordered, F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"))
    tails = {r["_part"]: r["tail"] for r in ordered.join(F.broadcast(ordered.sparkSession.createDataFrame([(r["_part"], r["last"]) for r in bounds], "_part int, _key string")), ["_part", "_key"]).groupBy("_part").agg(F.min("_at").alias("tail")).collect()} if bounds else {}
    base: dict[int, int] = {}
    carried: dict[int, tuple[str | None, int]] = {}  # the contributor under way where a partition begins, and where it started
    offset, under_way = 0, (None, 0)
    for r in bounds:
        base[r["_part"]], carried[r["_part"]] = offset, under_way
        if not (r["last"] == under_way[0] and r["first"] == r["last"]):
            under_way = (r["last"], offset + tails[r["_part"]])
        offset += r["n"]
    schema = T.StructType([ordered.schema["_row"], T.StructField("_place", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, key_now, start_now = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column("_part").to_numpy()
            for lo, hi in zip((cut := np.concatenate(([0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)])))[:-1], cut[1:], strict=True):
                piece = b.slice(lo, hi - lo)
                if (p := int(parts[lo])) != part:
                    part, (key_now, start_now) = p, carried[p]
                keys = piece.column("_key")
                at = piece.column("_at").to_numpy() + base[p]
                fresh = np.zeros(len(keys), bool)
                fresh[0] = keys[0].as_py() != key_now
                if len(keys) > 1:
                    fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
                starts = np.maximum.accumulate(np.where(fresh, at, -1))
                starts = np.where(starts < 0, start_now, starts)
                key_now, start_now = keys[-1].as_py(), int(starts[-1])
                yield pa.RecordBatch.from_arrays([piece.column("_row"), pa.array(at - starts, pa.int64())], names=["_row", "_place"])

    return ordered.mapInArrow(place, schema).select(*[F.col("_row")[c].alias(c) for c in df.columns if c != out], F.col("_place").alias(out))


def cap_contributors(df: DataFrame, contributor: str, score: str, item: str, max_count: int | None = None, max_share: float | None = None) -> DataFrame:
    """``df`` with ``kept``: whether the row is among the best its ``contributor`` may keep.

    A column ``kept`` of ``df`` is replaced. The limit is ``max_count`` rows, or ``max_share`` of all rows (rounded
    down), or the smaller of both. Rows without a contributor are not limited.
    See :func:`rank_in_contributor` for nulls, ties and repeated rows.
    """
    if max_count is None and max_share is None:
        raise ValueError("max_count or max_share is needed")
    cap = max_count
    if max_share is not None:
        by_share = int(df.count() * max_share)
        cap = by_share if cap is None else min(cap, by_share)
    named = df.where(F.col(contributor).isNotNull())
    ranked = rank_in_contributor(named, contributor, score, item, "kept")
    free = df.where(F.col(contributor).isNull()).withColumn("kept", F.lit(True))
    return ranked.withColumn("kept", F.col("kept") < cap).unionByName(free)


def scored_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Current blocks with run number, voice and score.

    The score of a block is that of its latest ``scored_at``, the highest if
    several rows share it; null if there is none.
    """
    blocks = current_blocks(spark, folder, ["run_id", "voice"]).select("block_id", run_number(F.col("run_id")).alias("run"), voice_key("voice").alias("voice"))
    scores = latest_rows(table(spark, folder, "block_scores").select("block_id", "score", "scored_at"), "block_id", "scored_at", ["score"])
    return blocks.join(scores, "block_id", "left")


def cap_blocks(blocks: DataFrame, per_run: int = 10, per_voice: int = 16) -> DataFrame:
    """``blocks`` with ``kept`` and ``dropped_by`` (run, voice or null): first the best of each run, of those the best of each voice."""
    by_run = cap_contributors(blocks, "run", "score", "block_id", per_run)
    first = by_run.where("kept").drop("kept")
    by_voice = cap_contributors(first, "voice", "score", "block_id", per_voice)
    out = by_run.where("not kept").withColumn("dropped_by", F.lit("run"))
    return out.unionByName(by_voice.withColumn("dropped_by", F.when(~F.col("kept"), F.lit("voice"))))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return cap_blocks(scored_blocks(spark, folder)).where("not kept").select("block_id")


def p5_kept(spark: SparkSession, folder: str) -> DataFrame:
    return cap_blocks(scored_blocks(spark, folder)).where("kept").select("block_id", "run", "voice", "score")


P5_SQL = """
WITH b AS (
  SELECT block_id, TRY_CAST(NULLIF(regexp_replace(run_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS run,
         NULLIF(NULLIF(trim(regexp_replace(lower(strip_accents(voice)), '\\([^()]*\\)|\\[[^\\[\\]]*\\]', ' ', 'g')), ''), 'unknown') AS voice
  FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) AS r FROM voice_blocks) WHERE r = 1),
s AS (SELECT block_id, score FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY scored_at DESC, score DESC NULLS LAST) AS r FROM block_scores) WHERE r = 1),
j AS (SELECT b.*, s.score FROM b LEFT JOIN s USING (block_id)),
k AS (SELECT *, run IS NULL OR row_number() OVER (PARTITION BY run ORDER BY score DESC NULLS LAST, block_id) <= 10 AS in_run FROM j),
v AS (SELECT *, voice IS NULL OR row_number() OVER (PARTITION BY voice ORDER BY score DESC NULLS LAST, block_id) <= 16 AS in_voice FROM k WHERE in_run)
"""
QUERIES = {"p5_found": p5_found, "p5_kept": p5_kept}
ORACLE_SQL = {
    "p5_found": P5_SQL + "SELECT block_id FROM k WHERE NOT in_run UNION ALL SELECT block_id FROM v WHERE NOT in_voice",
    "p5_kept": P5_SQL + "SELECT block_id, run, voice, score FROM v WHERE in_voice",
}
