"""Views of the ``voice_blocks`` table that several problems share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.functions import words
from versloom.tables import latest_rows, table


@F.pandas_udf(T.StringType())
def voice_key(v: pd.Series) -> pd.Series:
    return v.map(words.voice_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def work_key(v: pd.Series) -> pd.Series:
    return v.map(words.work_key, na_action="ignore")


def run_number(run_id: Column) -> Column:
    """The digits of ``run_id`` as a number; null where it has none."""
    digits = F.regexp_replace(run_id, r"\D", "")
    return F.when(digits != "", digits).try_cast("bigint")


def current_blocks(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The current row of every block: the one with the latest ``ingested_at``."""
    return latest_rows(table(spark, folder, "voice_blocks").select("block_id", "ingested_at", *columns), "block_id", "ingested_at", columns)
