"""Structured Streaming: additive counts, windowed counts with late rows, runs as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema, names: str = "*.parquet", files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files in ``folder`` whose names fit the pattern ``names``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", names).parquet(folder)


def key_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, as in the batch form: the counts add up over micro-batches."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str = "1 hour", step: str | None = None, late: str = "2 hours") -> DataFrame:
    """Rows by time window and key; rows more than ``late`` behind the latest are dropped by the watermark."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    w = F.window(ts, size, step) if step else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def stream_runs(stream: DataFrame, key: str, ts: str, order: str, voice: str) -> DataFrame:
    """(key, run_no, voice, n_rows): runs of equal ``voice`` that have ended, with the run under way as state.

    Rows of a key must arrive in order over micro-batches; within one they are
    sorted by ``order``.
    """
    kind = dict(stream.dtypes)[key]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        no, now, n = state.get if state.exists else (1, None, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values([ts, order])
        for v in rows[voice]:
            if n and v != now:
                out.append((k[0], no, now, n))
                no, n = no + 1, 0
            now, n = v, n + 1
        state.update((no, now, n))
        yield pd.DataFrame(out, columns=["key", "run_no", "voice", "n_rows"])

    return stream.groupBy(key).applyInPandasWithState(update, f"key {kind}, run_no int, voice string, n_rows int", "no int, now string, n int", "append", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream gives when all that is there has been read."""
    import uuid

    from versloom.session import shared_dir

    spark = stream.sparkSession
    spot = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    q = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", spot).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(table)
