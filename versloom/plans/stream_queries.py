"""Streams read to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from versloom.plans.registry import query
from versloom.streaming import counts as C
from versloom.tables import table


def _events(spark, d):
    return C.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, d):
    return C.drained(C.key_counts(_events(spark, d), ["event_type", "user_id"]), "stream_counts", "complete")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    return C.drained(C.windowed_counts(_events(spark, d), "ts", ["event_type"]), "stream_windows", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))
