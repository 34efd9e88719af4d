import random

import pytest
from pyspark.sql import functions as F

from versloom.llm import capping as C, splits as S


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 60):02}", f"n{rng.randint(0, 60):02}") for _ in range(45)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)] + [("x", None), (None, None), ("loop", "loop")]
    got = {r.node: r.component for r in S.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == union_find([e for e in edges if None not in e])
    assert S.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_incremental_components_and_quarantine(spark):
    previous = spark.createDataFrame([("a", "a", "train"), ("b", "a", "train"), ("c", "c", "test"), ("d", "d", "validation"), ("z", "z", "train")], "node string, component string, split string")
    links = spark.createDataFrame([("b", "n1"), ("c", "d"), ("n2", "n3")], "a string, b string")
    nodes = S.update_components(links, previous)
    got = {r.node: (r.component, tuple(r.splits)) for r in nodes.collect()}
    assert got["n1"] == ("a", ("train",)) and got["z"] == ("z", ("train",))
    assert got["c"][0] == got["d"][0] and set(got["c"][1]) == {"test", "validation"}
    assert got["n2"][1] == ()
    sizes = spark.createDataFrame([(n, 1) for n in got], "node string, n long")
    split = {r.component: (r.split, r.status) for r in S.assign_splits(nodes, sizes).collect()}
    assert split["a"] == ("train", "kept") and split[got["c"][0]] == (S.QUARANTINE, "quarantined") and split["n2"][1] == "new"


def test_proportions_and_whole_groups(spark):
    comps = [(f"c{i:04}", 1 + (i * 7919) % 9) for i in range(1500)] + [("giant", 1000)]
    nodes = spark.createDataFrame([(c, c, []) for c, _ in comps], "node string, component string, splits array<string>")
    sizes = spark.createDataFrame(comps, "node string, n long")
    got = S.assign_splits(nodes, sizes)
    share = {r.split: r.n for r in got.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    total = sum(n for _, n in comps)
    assert abs(share["train"] / total - 0.8) < 0.01 and abs(share["test"] / total - 0.1) < 0.01
    assert got.count() == len(comps) and got.where("split IS NULL").count() == 0
    assert S.assign_splits(nodes.limit(0), sizes).count() == 0


def test_blocks_added_later(spark, folder):
    """Components are those of a single go; a group keeps its split unless it joins groups of different splits."""
    got = S.p1_added(spark, folder).collect()
    once = {r.block_id: r.component for r in S.p1_splits(spark, folder).collect()}
    assert {r.block_id for r in got} == set(once)
    mine, groups = {r.block_id: r.component for r in got}, {}
    for b, c in once.items():
        groups.setdefault(c, set()).add(mine[b])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for rows in by.values():
        assert len({r.split for r in rows}) == 1
        before = {r.before for r in rows if r.before}
        assert rows[0].status == ("new" if not before else "kept" if len(before) == 1 else "quarantined")
        assert rows[0].status != "kept" or rows[0].split in before
    assert any(r.before for r in got) and not all(r.before for r in got)


def test_splits_hold_on_a_second_run(spark, folder):
    current, works = S.current_blocks(spark, folder, S._ENTITIES), S.table(spark, folder, "works_manifest")
    blocks, table = S.split_blocks(current, works)
    again, _ = S.split_blocks(current, works, table)
    assert blocks.select("block_id", "split").exceptAll(again.select("block_id", "split")).count() == 0
    assert again.where("status != 'kept'").count() == 0
    assert blocks.groupBy("component").agg(F.count_distinct("split").alias("d")).where("d > 1").count() == 0


def kept_by_hand(rows, cap):
    by = {}
    for r in rows:
        if r[1] is not None:
            by.setdefault(r[1], []).append(r)
    gone = set()
    for rs in by.values():
        rs.sort(key=lambda r: (-(r[2] if r[2] is not None and r[2] == r[2] else float("-inf")), r[0]))
        gone |= {r[0] for r in rs[cap:]}
    return gone


def test_caps_with_a_hot_contributor(spark):
    rng = random.Random(5)
    rows = [(f"i{k:05}", rng.choice(["hot"] * 5 + [f"c{k % 40}", None]), rng.choice([None, float("nan"), 0.1, 0.5, 0.5, 0.9, rng.random()])) for k in range(3000)]
    df = spark.createDataFrame(rows, "item string, who string, score double").withColumns({"kept": F.lit("old"), "_key": F.lit(1), "_part": F.lit(2), "_row": F.lit(3)})
    out = C.cap_contributors(df, "who", "score", "item", 7)
    assert out.count() == 3000 and set(out.columns) == set(df.columns)
    assert {r.item for r in out.where("NOT kept").collect()} == kept_by_hand(rows, 7)
    share = C.cap_contributors(df, "who", "score", "item", max_share=0.1)
    assert share.where("kept AND who = 'hot'").count() == 300
    assert C.cap_contributors(df.limit(0), "who", "score", "item", 3).count() == 0
    with pytest.raises(ValueError):
        C.cap_contributors(df, "who", "score", "item")


def test_repeated_rows_get_places(spark):
    df = spark.createDataFrame([("a", "x", 1.0)] * 5, "item string, who string, score double")
    assert sorted(r.place for r in C.rank_in_contributor(df, "who", "score", "item").collect()) == [0, 1, 2, 3, 4]
