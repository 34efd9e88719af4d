"""Sinks: result documents, review files, manifests, checkpoints of replicates, reports."""

from __future__ import annotations

import json
import platform
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_document(path: str, sections: dict, drop: tuple[str, ...] = ("null_scores",)) -> str:
    """Nested results as indented JSON; arrays named in ``drop`` are left out, NumPy scalars become plain ones."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items() if k not in drop}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v.item() if hasattr(v, "item") else v

    text = json.dumps(plain(sections), indent=2, ensure_ascii=False, default=str)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def review_csv(df: DataFrame, path: str, text: str, chars: int = 50) -> None:
    """Rows with the beginning of their text as CSV with a header; quotes are doubled."""
    df.withColumn(text, F.substring(text, 1, chars)).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One JSON object a row, in folders by the given columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def manifest(spark: SparkSession, path: str, expected: list[tuple[str, str, str]]) -> DataFrame:
    """(name, parent, generator, exists, sha256, size, modified) of the expected files below ``path``; missing ones have exists false."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    wanted = spark.createDataFrame(expected, "name string, parent string, generator string")
    return wanted.join(found, "name", "left").withColumn("exists", F.col("sha256").isNotNull())


def environment() -> dict:
    """Where results came from: versions, platform and the commit of the working folder, if there is one."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except OSError:
        commit = None
    return {"python": platform.python_version(), "platform": platform.platform(), "commit": commit}


class ReplicateStore:
    """Scores of replicates in a Parquet folder that a stopped study goes on from.

    A batch is written under its own name, so a batch that is written again
    replaces itself; what is done is read from the files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = "perm_id long, variant string, score double"):
        self.spark, self.path, self.schema = spark, path, schema

    def done(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema + ", batch long").parquet(self.path)
        except Exception as e:  # the folder isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema + ", batch long")

    def run(self, ids: DataFrame, work: Callable[[DataFrame], DataFrame], batch: int = 500) -> DataFrame:
        """``work`` for every perm_id in ``ids`` without a score, in batches by number; all scores."""
        todo = ids.select("perm_id").distinct().join(self.done().select("perm_id").distinct(), "perm_id", "left_anti").withColumn("batch", F.floor(F.col("perm_id") / batch))
        for r in todo.select("batch").distinct().orderBy("batch").collect():  # one row a batch
            own = todo.where(F.col("batch") == r["batch"]).select("perm_id")
            work(own).write.mode("overwrite").parquet(f"{self.path}/batch={r['batch']}")
        return self.done()

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """The first rows of a small result as a Markdown table."""
    rows = df.limit(most).collect()
    show = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def report(title: str, sections: dict[str, str | DataFrame]) -> str:
    """A Markdown report; DataFrames become tables."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", markdown_table(body) if isinstance(body, DataFrame) else body]
    return "\n\n".join(parts) + "\n"


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n): equal bins between the extremes, the last with its upper edge; the data behind a histogram."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.when(width > 0, width)))).otherwise(0).cast("int")
    binned = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", b)  # one row
    return binned.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def strict_schema(schema: dict) -> dict:
    """A JSON schema in which no object allows further properties, at any depth; every property is required."""
    out = {k: strict_schema(v) if isinstance(v, dict) else [strict_schema(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in schema.items()}
    if out.get("type") == "object" or "properties" in out:
        out["additionalProperties"] = False
        out.setdefault("required", sorted(out.get("properties", {})))
    return out


def answered(df: DataFrame, prompt: str, client: Callable[[str], dict], answer_ddl: str | None = None) -> DataFrame:
    """``df`` with what ``client`` (an injected callable, called once a row) makes of a prompt, and the answer parsed by a schema if one is given."""
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields]).add("answer", "string").add("model", "string").add("error", "string")

    def ask(frames):
        for f in frames:
            got = []
            for p in f[prompt]:
                try:
                    r = client(p)
                    got.append((r.get("text"), r.get("model"), None))
                except Exception as e:  # a failed call is a result, not the end of the job
                    got.append((None, None, str(e)))
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(got, columns=["answer", "model", "error"])], axis=1)

    out = df.mapInPandas(ask, schema)
    return out.withColumn("parsed", F.from_json("answer", answer_ddl, {"mode": "PERMISSIVE"})) if answer_ddl else out
