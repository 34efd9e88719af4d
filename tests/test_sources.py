import json

import pytest
from pyspark.sql import functions as F

from versloom.operators.positions import with_running_total
from versloom.session import shared_dir
from versloom.sources import readers as R, schemas, sinks
from versloom.streaming import counts as C
from versloom.tables import latest_rows


def test_json_blocks(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"blocks": [{"block_id": "x", "word_count": 3, "verse_refs": [{"reference": "A 1:1", "word_count": 3}]}]}, indent=1))
    r = R.json_records(spark, str(tmp_path / "b.json"), "blocks", schemas.BLOCK).first()
    assert r.block_id == "x" and r.verse_refs[0].word_count == 3 and r.voice is None


def test_bad_bytes_and_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\n\xff two\n1 Ab 2:3 said")
    t = R.whole_texts(spark, str(tmp_path))
    lines = R.numbered_lines(t, "path", "text").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "one"), (2, "� two"), (3, "1 Ab 2:3 said")]
    v = R.verses(R.numbered_lines(t, "path", "text"), "line").first()
    assert (v.book, v.chapter, v.verse, v.text, v.reference) == ("1 Ab", 2, 3, "said", "1 Ab 2:3")


def test_scripts_and_markup(spark):
    lines = ["Chapter 1", "LIZA", "3 hello", "there", "VOMA₂ (aside)", "yes", "Chapter 2", "more"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "d string, n int, t string")
    got = [(r.speaker, r.chapter, r.text) for r in R.speaker_script(df, "d", "n", "t").orderBy("segment").collect()]
    assert got == [("LIZA", 1, "hello there"), ("VOMA₂ (aside)", 1, "yes"), ("VOMA₂ (aside)", 2, "more")]
    x = spark.createDataFrame([(1, "<w:d xmlns:w='u'><w:t>ab</w:t><w:p><w:t>c</w:t></w:p></w:d>")], "i int, x string")
    assert R.markup_text(x, "i", "x").first().text == "abc"
    s = spark.createDataFrame([(1, "<1,Ab,2,3>[Liza[hi you]] x [Voma[no]]")], "i int, t string")
    assert [(r.speaker, r.speech, r.verse_key) for r in R.bracketed_speech(s, "i", "t").orderBy("at").collect()] == [("Liza", "hi you", "Ab,2,3"), ("Voma", "no", "Ab,2,3")]
    p = spark.createDataFrame([("p", "**Version:** 2\n## Prompt Text\n```\nask\n```\n")], "k string, t string")
    assert R.prompts(p, "k", "t").first().prompt == "ask"


def test_corpus_filters_first(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("A")
    works = [{"filename": f, "genre": g, "publication_year": y} for f, g, y in [("a.txt", "novel", 1900), ("b.txt", "novel", 1900), ("c.txt", "poem", 1950)]]
    (tmp_path / "m.json").write_text(json.dumps(works))
    found, missing = R.corpus(spark, str(tmp_path / "m.json"), str(tmp_path / "texts"), genre="novel", period="early")
    assert [r.filename for r in found.collect()] == ["a.txt"] and [r.filename for r in missing.collect()] == ["b.txt"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", ok')], "i int, t string")
    sinks.review_csv(df, str(tmp_path / "c"), "t")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().t == 'say "x", ok'
    text = sinks.result_document(str(tmp_path / "r.json"), {"a": {"null_scores": [1], "b": 2}})
    assert json.loads(text) == {"a": {"b": 2}}
    m = {r.name: r for r in sinks.manifest(spark, str(tmp_path), [("r.json", "p", "g"), ("no.txt", "p", "g")]).collect()}
    assert m["r.json"].exists and not m["no.txt"].exists and len(m["r.json"].sha256) == 64
    assert "| 1 |" in sinks.report("T", {"S": df.select("i")})
    h = sinks.histogram(spark.range(11).select(F.col("id").cast("double").alias("v")), "v", 5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 2, 2, 2, 3]
    assert sinks.strict_schema({"type": "object", "properties": {"a": {"type": "object", "properties": {}}}})["properties"]["a"]["additionalProperties"] is False


def test_replicates_go_on(spark, tmp_path):
    calls = []

    def work(ids):
        calls.append(ids.count())
        return ids.select(F.col("perm_id"), F.lit("v").alias("variant"), F.col("perm_id").cast("double").alias("score"))

    store = sinks.ReplicateStore(spark, f"file://{tmp_path}/s")
    ids = spark.range(7).withColumnRenamed("id", "perm_id")
    assert store.run(ids.where("perm_id < 4"), work, 2).count() == 4
    assert store.run(ids, work, 2).count() == 7 and calls == [2, 2, 2, 1]
    store.clear()
    assert store.done().count() == 0


def test_injected_client(spark):
    def client(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return {"text": '{"a": 1}', "model": "m"}

    df = spark.createDataFrame([("ok",), ("bad",)], "p string")
    got = {r.p: r for r in sinks.answered(df, "p", client, "a int").collect()}
    assert got["ok"].parsed.a == 1 and got["bad"].error == "no"


def test_stream_runs(spark, tmp_path):
    rows = [("k", 1, 1, "a"), ("k", 2, 2, "a"), ("k", 3, 3, "b"), ("k", 4, 4, "a")]
    df = spark.createDataFrame(rows, "k string, ts long, i int, v string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = C.drained(C.stream_runs(C.file_stream(spark, str(tmp_path / "in"), df.schema), "k", "ts", "i", "v"), "runs", "append").orderBy("run_no").collect()
    assert [(r.run_no, r.voice, r.n_rows) for r in got] == [(1, "a", 2), (2, "b", 1)]


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")], "k string, s int, v string").withColumn("s", F.timestamp_seconds("s"))
    assert {(r.k, r.v) for r in latest_rows(df, "k", "s", ["v"]).collect()} == {("a", "y"), ("b", "z")}


def test_running_total(spark):
    df = spark.range(1000).withColumn("n", F.col("id") % 7)
    got = {r.id: r.before for r in with_running_total(df, [F.col("id")], "n").collect()}
    acc = 0
    for i in range(1000):
        assert got[i] == acc
        acc += i % 7
    assert with_running_total(df.limit(0), [F.col("id")], "n").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


@pytest.mark.parametrize("name", ["fw_profile_by_group", "voice_runs", "hierarchy_view"])
def test_scans_are_pruned(name, spark, folder):
    from versloom.plans.queries import QUERIES

    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "embedding" not in plan and "props" not in plan


def test_scratch_deletes_what_was_staged(spark):
    from pathlib import Path

    from versloom.session import _STAGED, scratch, staged

    kept = staged(spark.range(3).toDF("id"), "kept")
    path = _STAGED[-1]
    with scratch(spark):
        assert staged(spark.range(5).toDF("id"), "gone").count() == 5
        inner = _STAGED[-1]
        assert inner != path
    assert kept.count() == 3 and _STAGED[-1] == path and not Path(inner.removeprefix("file://")).exists()


def test_corrections_by_id(spark):
    from versloom.operators import joins as J

    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "b", 1), (3, None, 1), (None, "z", 1)], "id int, v string, fixed int")
    fixes = spark.createDataFrame([(1, "a"), (2, "x"), (2, "w"), (3, "n"), (9, "q"), (None, "no")], "id int, v string")
    got = sorted((r.id or 0, r.v, r.fixed) for r in J.corrected(df, "id", fixes, ["v"]).collect())
    assert got == [(0, "z", False), (1, "a", False), (2, "x", True), (2, "x", True), (3, "n", True)]
    assert J.corrected(df.limit(0), "id", fixes, ["v"]).count() == 0 and J.corrected(df, "id", fixes.limit(0), ["v"]).where("fixed").count() == 0
