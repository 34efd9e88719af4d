import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as s
from pyspark.sql import functions as F

from versloom.functions.words import terms
from versloom.llm import spans as P, terms as T


@settings(max_examples=60, deadline=None)
@given(s.lists(s.tuples(s.text(alphabet="abé", max_size=6), s.integers(1, 5))))
def test_burst_trie(items):
    trie, want = T.BurstTrie(burst=3), Counter()
    for t, n in items:
        trie.add(t, n, 1)
        want[t] += n
    got = {p + x: (o, r) for p, xs, os, rs in trie.containers() for x, o, r in zip(xs, os, rs, strict=True)}
    assert {t: o for t, (o, _) in got.items()} == dict(want) and sum(r for _, r in got.values()) == len(items)
    assert trie.entries == len(want)


def test_counts_like_a_counter(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "... 12", "It’s it's IT'S " * 1000]
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, term int").repartition(5)
    occ, rec = Counter(), Counter()
    for t in texts:
        occ.update(terms(t))
        rec.update(set(terms(t)))
    got = {r.term: (r.occurrences, r.records) for r in T.count_terms(df, "t").collect()}
    assert got == {t: (occ[t], rec[t]) for t in occ}
    assert T.count_terms(df.limit(0), "t").count() == 0
    values = {r.term: r.records for r in T.count_terms(df, "term", None).collect()}
    assert values == {"1": len(texts)}
    marks = {r.term: r.mark for r in T.mark_terms(T.count_terms(df, "t"), 400, 2, 0.5).collect()}
    assert all(m == "rare" for t, m in marks.items() if rec[t] <= 2)


def test_covers():
    for v, c in P.COVERS.items():
        assert {(a - b) % v for a in c for b in c} == set(range(v))
    assert P.cover_for(160)[0] == 91 and P.cover_for(160)[2] == 70


def test_every_match_has_a_common_anchor():
    rng = np.random.RandomState(0)
    shared = rng.randint(97, 123, 160).astype(np.uint8)
    for _ in range(60):
        x = np.concatenate([rng.randint(97, 123, rng.randint(0, 200)), shared, rng.randint(97, 123, 50)]).astype(np.uint8)
        y = np.concatenate([rng.randint(97, 123, rng.randint(0, 200)), shared, rng.randint(97, 123, 9)]).astype(np.uint8)
        data = np.concatenate([x, y])
        h, own = P.anchors(data, np.array([0, len(x)]), np.array([len(x), len(data)]), 160)
        assert set(h[own == 0]) & set(h[own == 1])


def longest_common(x, y):
    best, row = 0, [0] * (len(y) + 1)
    for a in x:
        new = [0] * (len(y) + 1)
        for j, b in enumerate(y):
            if a == b:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def pairs_of(spark, texts, length=40):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    total = sum(len(t.encode()) for t in texts if t)
    import hashlib

    name = {hashlib.md5(t.encode()).hexdigest(): t for t in texts if t}
    return {frozenset((name[r.text_a], name[r.text_b])): r for r in P.shared_spans(df, "t", length, total).collect()}


def test_shared_spans_like_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "gämma", "dél ta", "ep si lon", "ze"])
    texts = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(50)]
    texts += [texts[0], texts[1] + "x" + texts[2], "", None, "a" * 39, "b" * 500, "b" * 300 + "c"]
    got = pairs_of(spark, texts)
    distinct = sorted({t for t in texts if t})
    want = {frozenset((a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if longest_common(a, b) >= 40}
    assert set(got) == want
    assert all(r.longest == longest_common(*k) for k, r in got.items())


def test_hot_anchor_in_cells(spark):
    core = "".join(chr(97 + (i * i) % 23) for i in range(60))
    texts = [f"{i:03}" * 5 + core + f"{i:03}" * 4 for i in range(150)]
    got = pairs_of(spark, texts, 60)
    assert len(got) == 150 * 149 // 2


def test_hot_anchors_leave_a_bucket_early(spark):
    """Entries of an anchor that half of all texts hold, in small batches: what a bucket holds stays bounded, and no pair is lost."""
    rng = np.random.RandomState(2)
    h = np.concatenate((np.full(3000, 5 << 8), rng.randint(100, 1500, 3000) << 8)).astype(np.uint64)
    node = rng.randint(0, 2500, len(h))
    order = rng.permutation(len(h))
    h, node = h[order], node[order]
    rows = [P._packed(3, False, h[lo : lo + 100], node[lo : lo + 100].astype(np.int64), np.ones(len(h[lo : lo + 100]))) for lo in range(0, len(h), 100)]
    rows.append(P._packed(3, True, np.array([777 << 8], np.uint64), np.array([1], np.int64), np.ones(1)))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(r, strict=True), P._PACKED_ARROW, strict=True)], names=P._PACKED.names) for r in rows]
    held, P.HELD = P.HELD, 500
    try:
        out = [x for b in P._join_bucket()((pa.scalar(3),), iter(batches)) for x in b.to_pylist()]
    finally:
        P.HELD = held
    entries = {(int(x) >> 8, int(n)) for x, n in zip(h, node, strict=True)}
    hot = {(r["a"], r["b"]) for r in out if r["hot"]}
    assert {e for e in entries if e[0] in (5, 777)} <= hot <= entries
    members = {}
    for x, n in entries - hot:
        members.setdefault(x, set()).add(n)
    assert {(r["a"], r["b"]) for r in out if not r["hot"]} == {(a, b) for m in members.values() for a in m for b in m if a < b}


def test_long_text_in_segments(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(7_000_000))
    part = long[6_500_000:6_500_400]
    got = pairs_of(spark, [long, "tail " + part + " end"], 160)
    assert len(got) == 1 and next(iter(got.values())).longest >= 400


def test_equal_blocks_are_a_class(spark, folder):
    shares = P.p4_shares(spark, folder)
    assert shares.where("share < 0 OR share > 1").count() == 0
    found = P.p4_found(spark, folder)
    assert found.where(F.col("block_id_a") >= F.col("block_id_b")).count() == 0
    linked = {x for r in found.collect() for x in r}
    assert linked == {r.block_id for r in shares.where("shared_chars > 0").collect()}
