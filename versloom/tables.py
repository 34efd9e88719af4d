"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "0001-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` as a DataFrame."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_rows(df: DataFrame, key: str, stamp: str, columns: list[str]) -> DataFrame:
    """For each non-null ``key`` the row with the greatest ``stamp``, as ``key`` and ``columns``.

    A null stamp is older than any other. Rows that tie are told apart by the
    greatest values of ``columns`` in order, so repeated rows give one row and
    the result does not depend on row order. Rows without a key are left out:
    they belong to no record. Partial aggregation runs before the shuffle, so a
    key that holds a large part of the rows costs one row per map task.
    """
    own = [c for c in columns if c != key]
    when = F.coalesce(F.col(stamp).cast("timestamp"), F.lit(EPOCH).cast("timestamp"))
    value = F.struct(*[F.col(c) for c in own]) if own else F.struct(F.lit(1).alias("one"))
    packed = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key), F.struct(when.alias("_when"), value.alias("_row")).alias("_v"))
        .groupBy(key)
        .agg(F.max("_v").alias("_v"))
    )
    return packed.select(key, *[F.col(f"_v._row.{c}").alias(c) for c in own])
