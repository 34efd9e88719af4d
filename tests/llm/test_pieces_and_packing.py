import itertools
import random

import pytest
from hypothesis import given, settings, strategies as s
from pyspark.sql import functions as F

from versloom.llm import packing as K, pieces as P


@settings(max_examples=300, deadline=None)
@given(s.text(alphabet="a.! b\n é", max_size=200), s.integers(2, 12), s.sampled_from(["words", "bytes"]), s.data())
def test_pieces_join_again(text, limit, measure, data):
    limit = max(limit, 4) if measure == "bytes" else limit
    overlap = data.draw(s.integers(0, limit - 1))
    out = P.pieces_of(text, limit, overlap, measure)
    size = (lambda t: len(t.split())) if measure == "words" else (lambda t: len(t.encode()))
    if text.split():
        joined, done = "", 0
        for x in out:
            assert measure == "bytes" or size(x["piece"]) <= limit
            assert x["n_words"] >= 1 and x["first_word"] + x["n_words"] >= done
            done = x["first_word"] + x["n_words"]
        joined = P.pieces_of(text, limit, 0, measure)
        assert "".join(x["piece"] for x in joined) == text
    if measure == "words":
        for a, b in itertools.pairwise(out):
            assert b["first_word"] == a["first_word"] + a["n_words"] - overlap or b["first_word"] == a["first_word"] + 1
            if a["cut"] == "sentence":
                assert a["piece"].split()[-1].rstrip("\"')")[-1] in ".!?"


def test_natural_and_hard_cuts():
    text = " ".join(["w"] * 8 + ["w."] + ["w"] * 30)
    out = P.pieces_of(text, 10, 2)
    assert (out[0]["n_words"], out[0]["cut"]) == (9, "sentence") and out[1]["cut"] == "hard" and out[1]["first_word"] == 7
    assert P.longest_stretch("a b. c d e! f") == 3 and P.longest_stretch("") == 0


def test_split_table(spark):
    rows = [(1, "w " * 30, 5), (2, "short", None), (3, "", 1), (4, None, 1), (1, "w " * 30, 5), (5, "x " * 5000, 0)]
    df = spark.createDataFrame(rows, "id int, t string, piece int").withColumn("_row", F.array(F.lit("extra")))
    out = P.split_oversized(df, "t", 10, 3)
    n = {r.id: r["count"] for r in out.groupBy("id").count().collect()}
    assert n[2] == n[3] == n[4] == 1 and n[1] == 2 * len(P.pieces_of("w " * 30, 10, 3)) and n[5] == len(P.pieces_of("x " * 5000, 10, 3))
    assert out.schema["piece"].dataType.simpleString() == "string" and "_row" in out.columns
    assert P.split_oversized(df, "t", 10, 3, keep_small=False).where("id IN (2, 3, 4)").count() == 0
    assert P.split_oversized(df.limit(0), "t", 10, 3).count() == 0
    with pytest.raises(ValueError):
        P.split_oversized(df, "t", 10, 10)


def fewest(sizes, capacity):
    """By trying all set partitions."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_packing_is_optimal_on_small_cases():
    rng = random.Random(7)
    for _ in range(150):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 9))]
        out = K.bin_completion(sizes, 50)
        assert sorted(x for b in out for x in b) == sorted(sizes) and all(sum(b) <= 50 for b in out)
        assert len(out) == fewest(sorted(sizes, reverse=True), 50) >= K.lower_bound(sizes, 50)


def test_search_beats_best_fit():
    sizes = [6, 6, 5, 5, 4, 4, 3, 3, 2, 2] * 3
    out = K.bin_completion(sizes, 20, nodes=2000)
    assert len(out) <= len(K.best_fit(sizes, 20)) and sum(map(sum, out)) == sum(sizes)
    rng = random.Random(8)
    many = [rng.randint(50, 3000) for _ in range(512)]
    out = K.bin_completion(many, 4096)
    assert sorted(x for b in out for x in b) == sorted(many) and len(out) <= len(K.best_fit(many, 4096))


def test_fillings_are_all_and_in_order():
    """Every multiset of the items that leaves at most ``waste`` and that no single larger item could improve, fullest first."""
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(60):
        items, room = sorted(rng.randint(1, 20) for _ in range(rng.randint(0, 9))), rng.randint(1, 40)
        got = list(K.fillings(items, room, 6))
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True) and len(set(got)) == len(got)
        subsets = {tuple(sorted(c, reverse=True)) for n in range(len(items) + 1) for c in combinations(items, n) if room - 6 <= sum(c) <= room}
        assert set(got) <= subsets
        if subsets:
            assert sum(got[0]) == max(map(sum, subsets)) and {f for f in subsets if sum(f) == room} <= set(got)


def test_rounds_lose_little(spark):
    """Batches of 64 lose no container each: the whole stays within two of the bound, below best fit."""
    rng = random.Random(10)
    sizes = [int(rng.lognormvariate(6.9, 0.6)) % 4096 + 1 for _ in range(3000)]
    out = K.pack(spark.createDataFrame(list(enumerate(sizes)), "doc long, tokens int"), "doc", "tokens", 4096, batch=256)
    n = out.select("container").distinct().count()
    assert out.groupBy("container").agg(F.sum("size").alias("u")).where("u > 4096").count() == 0
    assert out.count() == 3000 and n <= K.lower_bound(sizes, 4096) + 3 and n <= len(K.best_fit(sizes, 4096))


def test_equal_rows_are_dealt_out(spark):
    """Two thirds null items of one size: repeated rows go to all batches."""
    df = spark.range(1200).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc"), F.lit(1000).alias("tokens"))
    out = K.pack(df, "doc", "tokens", 4096, batch=100)
    assert out.count() == 1200 and out.where("doc IS NULL").count() == 800
    assert out.groupBy("container").agg(F.sum("size").alias("u")).where("u > 4000").count() == 0 and out.select("container").distinct().count() == 300


def test_pack_table(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 1, 700, 4096, 4097, 9000, rng.randint(1, 3000)])) for i in range(1500)] + [(9999, None), (9999, None), (None, 10)]
    out = K.pack(spark.createDataFrame(rows, "doc long, tokens int"), "doc", "tokens", 4096, batch=200).collect()
    used, held = {}, {}
    for r in out:
        used[r.container] = used.get(r.container, 0) + r.size
        held.setdefault(r.doc, []).append((r.piece, r.start, r.size))
    assert max(used.values()) <= 4096
    for doc, size in rows:
        if doc is not None and doc != 9999:
            parts = sorted(held[doc])
            assert sum(p[2] for p in parts) == size and len(parts) == max(1, -(-size // 4096))
            assert [p[1] for p in parts] == [4096 * k for k in range(len(parts))]
    assert len(held[9999]) == 2 and held[None] == [(0, 0, 10)]
    assert K.pack(spark.createDataFrame([], "doc long, tokens int"), "doc", "tokens", 4096).count() == 0
    with pytest.raises(ValueError):
        K.pack(spark.createDataFrame([], "size long, tokens int"), "size", "tokens", 4096)
