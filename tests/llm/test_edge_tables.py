"""The queries over empty tables, and over tables with null rows, repeated rows and columns that nobody asked for."""

import pytest
from pyspark.sql import functions as F

from versloom.llm.queries import QUERIES

TABLES = "voice_blocks works_manifest control_corpora block_scores raw_lines preprocessing_log documents eval_items".split()
FOUND = [f"p{i}_found" for i in range(1, 10)] + ["p1_splits", "p3_counts", "p4_shares", "p5_kept", "p6_all_blocks", "p7_fill", "p8_leaks", "p9_shares", "p9_cutoffs", "p2_paragraphs"]


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def odd(spark, folder, tmp_path_factory):
    """Each table twice over, with two rows of nulls, rows with an empty or blank text, and clashing columns."""
    out = tmp_path_factory.mktemp("odd")
    extra = ["kept", "n", "component", "split", "_row", "_key", "word", "kind", "chunk", "score_", "_text", "container", "piece"]
    for t in TABLES:
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        nulls = df.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        text = next((c for c in ("text", "line", "title") if c in df.columns), None)
        more = df.limit(3).withColumn(text, F.lit(" \n ")) if text else df.limit(3)
        all_rows = df.unionByName(df).unionByName(nulls).unionByName(more.limit(0) if t in ("voice_blocks", "raw_lines") else more)
        all_rows.withColumns({c: F.lit("x") for c in extra if c not in df.columns}).write.parquet(f"{out}/{t}.parquet")
    return str(out)


@pytest.mark.parametrize("name", FOUND)
def test_empty_tables(name, spark, empty):
    assert QUERIES[name](spark, empty).count() == (1 if name == "p7_fill" else 0)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"])
def test_odd_rows_change_nothing(name, spark, folder, odd):
    """Copies and null rows are no records: the result is that of the plain tables."""
    got, want = QUERIES[name](spark, odd), QUERIES[name](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["p7_found", "p8_found", "p9_found", "p1_splits", "p9_shares", "p7_fill"])
def test_odd_rows_do_not_crash(name, spark, odd):
    assert QUERIES[name](spark, odd).count() >= 1
