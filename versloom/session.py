"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` uses ``__`` for dots and wins over them."""
    builder = SparkSession.builder.master(master).appName("versloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, but only for a
    local master: on a cluster a machine-local folder would lose the data with
    the machine, so that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="versloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


#: Paths of the tables staged by this process.
_STAGED: list[str] = []


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged within the block when it ends: write or collect results inside it.

        with scratch(spark):
            operator(df).write.parquet(place)
    """
    first = len(_STAGED)
    try:
        yield
    finally:
        while len(_STAGED) > first:
            _delete(spark, _STAGED.pop())


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; keeps partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as a table into the shared folder and read back.

    Unlike ``checkpoint`` the last stage runs once and the columns stay
    prunable. Row order and partitions are not kept.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    _STAGED.append(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Deletes staged tables and stream positions older than that from the shared folder; how many were deleted.

    Staged tables can't be deleted by the operators that write them: the
    DataFrames they return are read later. Call this between jobs, or run a job
    within :func:`scratch`.
    """
    import time

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for part in ("tables", "streams"):
        folder = jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), part))
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            if status.getModificationTime() / 1000 < time.time() - older_than_hours * 3600:
                gone += bool(fs.delete(status.getPath(), True))
    return gone
