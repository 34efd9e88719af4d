"""Positions of rows in a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versloom.session import reliable_checkpoint


def range_sorted(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` in a global order, cut into partitions and checkpointed, with ``_part`` and ``_at``.

    ``_part`` is the partition and ``_at`` the place in it. The sort keys should
    tell rows apart: the partition bounds can then cut a value that holds a
    large part of all rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = reliable_checkpoint(ordered)
    ident = F.monotonically_increasing_id()
    return kept.withColumn("_id", ident).select(
        *kept.columns, F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")
    )


def partition_table(sorted_df: DataFrame, *aggs: Column) -> list:
    """One row of aggregates for each partition of ``range_sorted``; as many rows as partitions."""
    return sorted_df.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *aggs).orderBy("_part").collect()


def with_running_total(df: DataFrame, order: list[Column], size: str, out: str = "before") -> DataFrame:
    """Adds the sum of ``size`` over all rows that come before in ``order``."""
    from pyspark.sql import Window

    s = range_sorted(df, order)
    totals, offset, offsets = partition_table(s, F.sum(size).alias("total")), 0, {}
    for row in totals:
        offsets[row["_part"]] = offset
        offset += row["total"] or 0
    # one entry a partition
    table = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else F.create_map(F.lit(0), F.lit(0))
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(size).over(w), F.lit(0))
    return s.withColumn(out, (inside + table[F.col("_part")]).cast("long")).drop("_part", "_at")
