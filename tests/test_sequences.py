import random
import re

from pyspark.sql import functions as F

from versloom.operators import sequences as S


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "k int, i int, v string")
    assert [r.run_no for r in S.runs(df, ["k"], ["i"], ["v"]).orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]
    t = S.run_table(df, ["k"], ["i"], ["v"], ["i"]).orderBy("run_no").collect()
    assert [(r.first_i, r.last_i, r.n_rows) for r in t] == [(0, 1, 2), (2, 3, 2), (4, 4, 1), (5, 5, 1)]


def test_hot_keys_are_cut_across_parts(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, "hot", "hot", "hot", "b", "c"]), i, rng.choice(["x", "x", "y", None]), rng.choice([None, None, None, i])) for i in range(400)]
    rows += [("one", 1000 + i, "x", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v string, w int")
    for many in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(many))
        plain = S.runs(df, ["k"], ["i"], ["v"])
        cut = S.runs(df, ["k"], ["i"], ["v"], hot_rows=0)
        assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
        a = S.carried_forward(df, ["k"], ["i"], "w", "last")
        b = S.carried_forward(df, ["k"], ["i"], "w", "last", hot_rows=0)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def greedy(words, target, least=300):
    out, acc, n = [], 0, 0
    for w in words:
        acc, n = acc + (w or 0), n + 1
        if acc >= target:
            out.append([n, acc, False, False, False])
            acc, n = 0, 0
    if acc:
        if acc >= least:
            out.append([n, acc, True, False, False])
        elif out:
            out[-1] = [out[-1][0] + n, out[-1][1] + acc, False, False, True]
        else:
            out.append([n, acc, False, True, False])
    return out


def test_greedy_blocks(spark):
    rng = random.Random(1)
    data = {k: [rng.choice([None, 0, 40, 150, 290, 500]) for _ in range(rng.randint(1, 30))] for k in range(20)} | {100: [0], 101: [299], 102: [300], 103: [1000, 299]}
    rows = [(k, i, f"{k}:{i}", w) for k, ws in data.items() for i, w in enumerate(ws)]
    rng.shuffle(rows)
    got = S.greedy_blocks(spark.createDataFrame(rows, "run int, i int, ref string, w int"), "run", ["i"], "ref", "w", 1000).collect()
    for k, ws in data.items():
        mine = sorted((r for r in got if r.run == k), key=lambda r: r.block_no)
        assert [[r.n_rows, r.word_count, r.is_remainder, r.is_undersized, r.merged_remainder] for r in mine] == greedy(ws, 1000)
        assert sum(r.word_count for r in mine) == sum(w or 0 for w in ws)


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None), (4, "a b c d")], "i int, t string")
    got = {(r.i, r.chunk): r.n_words for r in S.word_chunks(df, "i", "t", 10).collect()}
    assert got == {(1, 1): 10, (1, 2): 10, (1, 3): 5}
    assert S.word_chunks(df, "i", "t", 10, tail=0.8).where("i = 1").count() == 2
    rolled = [(r.first_word, r.n_words) for r in S.word_chunks(df, "i", "t", 10, step=5).where("i = 1").orderBy("chunk").collect()]
    assert rolled == [(0, 10), (5, 10), (10, 10), (15, 10)]


def joined_by_hand(lines):
    """The rules again, over a list of lines."""
    out, i, lines = [], 0, list(lines)
    while i < len(lines):
        m = re.search(r"(\S+)-\s*$", lines[i])
        if m:
            j = i + 1
            while j < len(lines) and not lines[j].strip():
                j += 1
            first = re.match(r"\S+", lines[j]) if j < len(lines) else None
            if first and (first[0][0].islower() or (m[1].isupper() and first[0].isupper())):
                out.append(re.sub(r"-\s*$", "", lines[i]) + first[0])
                rest = lines[j][len(first[0]) :].lstrip()
                lines[j : j + 1] = [rest] if rest else []
                i = j
                continue
        out.append(lines[i])
        i += 1
    return out


def test_dehyphenation(spark):
    rng = random.Random(3)
    docs = {d: [rng.choice(["ab-", "cd e-", "x-  ", "", "low er", "Up per", "AB-", "CD", " in-", "z", "- "]) for _ in range(rng.randint(1, 12))] for d in range(60)}
    docs |= {100: ["a-", "b-", "c"], 101: ["x-", "", "y z-", "w"]}
    rows = [(d, i, t) for d, ls in docs.items() for i, t in enumerate(ls)]
    got = S.dehyphenated(spark.createDataFrame(rows, "d int, n int, t string"), "d", "n", "t").collect()
    for d, ls in docs.items():
        mine = [r.line for r in sorted((r for r in got if r.d == d), key=lambda r: r.n)]
        assert mine == joined_by_hand(ls), ls


def test_speech_machine(spark):
    flags = {"o": (True, False, False), "c": (False, True, False), "n": (False, False, True), ".": (False, False, False), "b": (True, True, False)}
    seq, who = "..o.co.n.b.b" + "." * 60 + "o", ["x"] * 80
    rows = [(1, i, str(i), *flags[s], who[i] if flags[s][0] else None) for i, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "k int, i int, ref string, o boolean, c boolean, n boolean, s string")
    got = S.speech_blocks(df, ["k"], ["i"], "ref", "o", "c", "n", "s").orderBy("block_no").collect()
    assert [(r.first_ref, r.last_ref, r.n_rows, r.close_reason) for r in got] == [
        ("2", "4", 3, "explicit_close"), ("5", "7", 3, "narrator_self_id"), ("9", "11", 3, "explicit_close"), ("11", "61", 51, "max_length_50"), ("72", "72", 1, "end_of_text"),
    ]
    positions = [r.position for r in S.speech_positions(df, ["k"], ["i"], "ref", "o", "c", "n").orderBy(F.col("ref").cast("int")).collect()]
    assert positions[:8] == [None, None, "START", "MIDDLE", "END", "START", "MIDDLE", "END_IMPLICIT"]


def test_floor_lookup(spark):
    bounds = spark.createDataFrame([("a", 5, "five"), ("a", 5, "fives"), ("a", 9, "nine")], "k string, s int, v string")
    df = spark.createDataFrame([("a", n) for n in (1, 5, 8, 9, 20)] + [("b", 7)], "k string, n int")
    got = {(r.k, r.n): r.out for r in S.floor_lookup(df, bounds, ["k"], "n", "s", "v", "out").collect()}
    assert got == {("a", 1): None, ("a", 5): "fives", ("a", 8): "fives", ("a", 9): "nine", ("a", 20): "nine", ("b", 7): None}


def test_capped_ignores_row_order(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    a = {r.id for r in S.capped(df, "g", "id", 5).collect()}
    b = {r.id for r in S.capped(df.orderBy(F.desc("id")), "g", "id", 5).collect()}
    assert a == b and len(a) == 15


def test_empty_tables(spark):
    df = spark.createDataFrame([], "run int, i int, ref string, w int")
    assert S.greedy_blocks(df, "run", ["i"], "ref", "w", 10).count() == 0
    assert S.runs(df, ["run"], ["i"], ["ref"]).count() == 0
