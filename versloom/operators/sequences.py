"""Order-dependent operators: runs, blocks, chunks, folds, carry-forward.

Folds that no window function can express read their rows in order, batch by
batch, and keep only the state of the run under way: a key that holds a large
part of all rows takes one task long, but never much memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a key up to which a window holds it in one task; beyond, the order is cut across keys.
HOT_ROWS = 20_000_000


def _hottest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the most frequent key, from a count that is combined before it is exchanged."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in global order with _part and _at."""
    from versloom.operators.positions import range_sorted

    return range_sorted(df, [F.col(c) for c in [*keys, *order]])


def _carried_table(df: DataFrame, keys: list[str], rows: list[tuple], columns: dict[str, T.DataType]) -> DataFrame:
    """(_part, _key, …): what a part takes over from the one before, for the key under way; one row a part."""
    key = T.StructType([df.schema[k] for k in keys])
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_key", key), *[T.StructField(c, k) for c, k in columns.items()]])
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def runs(df: DataFrame, keys: list[str], order: list[str], same: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``run_no``: a number from 1 that grows whenever one of the columns ``same`` changes along ``order``.

    Two nulls are the same. Rows of a key that are equal in ``order`` come in
    an undefined order. If a key has more than ``hot_rows`` rows, the rows are
    range-sorted instead of gathered by key; each part is numbered for itself,
    and a table of one row a part carries the numbers on.
    """
    if _hottest(df, keys) > hot_rows:
        return _runs_across_parts(df, keys, order, same)
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    flagged = df.withColumn("_new", F.when(first | changed, 1).otherwise(0))
    return flagged.withColumn("run_no", F.sum("_new").over(w).cast("int")).drop("_new")


def _runs_across_parts(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    s = _parts(df, keys, order)
    w = Window.partitionBy("_part", *keys).orderBy("_at")
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    inside = F.sum(F.when((F.row_number().over(w) > 1) & changed, 1).otherwise(0)).over(w)
    local = s.withColumn("_local", inside)
    key, at = F.struct(*keys), F.struct(*same)
    ends = local.groupBy("_part").agg(F.min_by(key, "_at").alias("fk"), F.max_by(key, "_at").alias("lk"), F.min_by(at, "_at").alias("fs"), F.max_by(at, "_at").alias("ls"), F.max_by("_local", "_at").alias("n")).orderBy("_part").collect()  # one row a part
    rows, before = [], None  # before: key, state and number at the end of the part before
    for r in ends:
        base = 1
        if before and before[0] == r["fk"]:
            base = before[2] + (before[1] != r["fs"])
            rows.append((r["_part"], tuple(r["fk"]), base))
        before = (r["lk"], r["ls"], r["n"] + (base if r["lk"] == r["fk"] else 1))
    carried = _carried_table(df, keys, rows, {"_base": T.IntegerType()})
    j = local.withColumn("_key", F.struct(*keys)).join(carried.withColumnsRenamed({"_part": "_p", "_key": "_k"}), (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    return j.withColumn("run_no", (F.col("_local") + F.coalesce("_base", F.lit(1))).cast("int")).select(*df.columns, "run_no")


def run_table(df: DataFrame, keys: list[str], order: list[str], same: list[str], first: list[str], total: str | None = None) -> DataFrame:
    """One row for each run: keys, run_no, ``same``, the ``first`` columns of its first row as first_…, of its last as last_…, length and total."""
    r = runs(df, keys, order, same)
    at = F.struct(*order)
    aggs = [F.min_by(c, at).alias(c) for c in same if c not in keys]
    aggs += [F.min_by(c, at).alias(f"first_{c}") for c in first] + [F.max_by(c, at).alias(f"last_{c}") for c in first]
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    if total:
        aggs.append(F.sum(F.coalesce(total, F.lit(0))).alias("total"))
    return r.groupBy(*keys, "run_no").agg(*aggs)


def carried_forward(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the last value of ``column`` that is not null, up to and with the row.

    Keys with more than ``hot_rows`` rows are treated as in :func:`runs`.
    """
    if _hottest(df, keys) <= hot_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(column, ignorenulls=True).over(w))
    s = _parts(df, keys, order)
    w = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = s.withColumn("_local", F.last(column, ignorenulls=True).over(w))
    key = F.struct(*keys)
    ends = local.groupBy("_part").agg(F.min_by(key, "_at").alias("fk"), F.max_by(key, "_at").alias("lk"), F.max_by(F.struct("_local"), "_at").alias("v")).orderBy("_part").collect()  # one row a part
    rows, before = [], None
    for r in ends:
        taken = before[1] if before and before[0] == r["fk"] else None
        if taken is not None:
            rows.append((r["_part"], tuple(r["fk"]), taken))
        last = r["v"]["_local"]
        before = (r["lk"], taken if last is None and r["lk"] == r["fk"] else last)
    carried = _carried_table(df, keys, rows, {"_taken": df.schema[column].dataType})
    j = local.withColumn("_key", key).join(carried.withColumnsRenamed({"_part": "_p", "_key": "_k"}), (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    return j.withColumn("_value", F.coalesce("_local", "_taken")).select(*[c for c in df.columns if c != out], F.col("_value").alias(out))


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, finish: Callable, schema: T.StructType | str) -> DataFrame:
    """Rows that a fold emits, key by key in ``order``.

    ``start`` makes the state of a key, ``step(state, row)`` and
    ``finish(state, key)`` give lists of tuples. Rows reach Python sorted and in
    batches, so a key of any size is read with the state alone in memory.
    """
    names = df.columns

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
        key, state, rows = None, None, []
        for frame in frames:
            values = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in names]
            for row in zip(*values, strict=True):
                record = dict(zip(names, row, strict=True))
                own = tuple(record[k] for k in keys)
                if own != key:
                    if state is not None:
                        rows += finish(state, key)
                    key, state = own, start()
                rows += step(state, record)
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=out_names)
                rows = []
        if state is not None:
            rows += finish(state, key)
        yield pd.DataFrame(rows, columns=out_names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)


def greedy_blocks(df: DataFrame, run: str, order: list[str], ref: str, words: str, target: int, least: int = 300) -> DataFrame:
    """Blocks of whole rows: a block is closed once it has ``target`` words.

    What is left of a run is a block of its own from ``least`` words on
    (is_remainder), else it joins the block before (merged_remainder, which
    leaves is_remainder false), else, if the run has no other block and any
    words, it is a block that is_undersized. Null word counts are 0. Runs
    without words give nothing.

    Columns: run, block_no from 1, first_ref, last_ref, n_rows, word_count,
    is_remainder, is_undersized, merged_remainder.
    """
    schema = T.StructType([T.StructField(run, df.schema[run].dataType)]).add("block_no", "integer").add("first_ref", "string").add("last_ref", "string").add("n_rows", "integer").add("word_count", "long")
    schema = schema.add("is_remainder", "boolean").add("is_undersized", "boolean").add("merged_remainder", "boolean")

    def start():
        return {"no": 0, "held": None, "open": None}

    def step(s, r):
        b = s["open"] = s["open"] or [r[ref], r[ref], 0, 0]
        b[1], b[2], b[3] = r[ref], b[2] + 1, b[3] + int(r[words] or 0)
        if b[3] < target:
            return []
        out = [s["held"]] if s["held"] else []
        s["no"] += 1
        s["held"], s["open"] = (r[run], s["no"], *b, False, False, False), None
        return out

    def finish(s, key):
        held, b = s["held"], s["open"]
        if not b or not b[3]:
            return [held] if held else []
        if b[3] >= least:
            return ([held] if held else []) + [(key[0], s["no"] + 1, *b, True, False, False)]
        if held:
            return [(*held[:3], b[1], held[4] + b[2], held[5] + b[3], False, False, True)]
        return [(key[0], 1, *b, False, True, False)]

    return ordered_fold(df.select(run, *dict.fromkeys([*order, ref, words])), [run], order, start, step, finish, schema)


def speech_blocks(df: DataFrame, keys: list[str], order: list[str], ref: str, opens: str, closes: str, narrator: str, speaker: str, most: int = 50) -> DataFrame:
    """Blocks of embedded speech by a state machine over the rows of a key.

    In a block the close is looked at first: an explicit close, else a narrator
    naming itself, else ``most`` rows reached, else an opening with another
    known speaker. The closing row ends the block and counts in it; it opens the
    next block only if it opens speech and did not close by a new speaker. An
    unclosed block ends with the last row (end_of_text).

    Columns: keys, block_no, first_ref, last_ref, n_rows, speaker, close_reason.
    """
    schema = T.StructType([df.schema[k] for k in keys]).add("block_no", "integer").add("first_ref", "string").add("last_ref", "string").add("n_rows", "integer").add("speaker", "string").add("close_reason", "string")

    def start():
        return {"no": 0, "open": None, "last": None}

    def step(s, r):
        out = []
        b = s["open"]
        s["last"] = r[ref]
        if b:
            if r[closes]:
                why = "explicit_close"
            elif r[narrator]:
                why = "narrator_self_id"
            elif b[1] >= most:
                why = f"max_length_{most}"
            elif r[opens] and r[speaker] and r[speaker] != b[2]:
                why = "new_speaker"
            else:
                b[1] += 1
                return out
            out.append((*[r[k] for k in keys], s["no"], b[0], r[ref], b[1] + 1, b[2], why))
            s["open"] = None
            if why == "new_speaker":
                return out
        if r[opens] and s["open"] is None:
            s["no"] += 1
            s["open"] = [r[ref], 1, r[speaker]]
        return out

    def finish(s, key):
        b = s["open"]
        return [(*key, s["no"], b[0], s["last"], b[1], b[2], "end_of_text")] if b else []

    return ordered_fold(df.select(*dict.fromkeys([*keys, *order, ref, opens, closes, narrator, speaker])), keys, order, start, step, finish, schema)


def speech_positions(df: DataFrame, keys: list[str], order: list[str], ref: str, opens: str, closes: str, narrator: str) -> DataFrame:
    """The simpler machine: each row with its block and START, MIDDLE, END or END_IMPLICIT.

    A row that opens starts a block if none is open; an explicit close ends it
    (END); a narrator naming itself ends it before the row (END_IMPLICIT, the
    row belongs to no block).
    """
    schema = T.StructType([df.schema[k] for k in keys]).add("ref", "string").add("block_no", "integer").add("position", "string")

    def start():
        return {"no": 0, "in": False}

    def step(s, r):
        key = [r[k] for k in keys]
        if s["in"]:
            if r[closes]:
                s["in"] = False
                return [(*key, r[ref], s["no"], "END")]
            if r[narrator]:
                s["in"] = False
                return [(*key, r[ref], None, "END_IMPLICIT")]
            return [(*key, r[ref], s["no"], "MIDDLE")]
        if r[opens]:
            s["no"], s["in"] = s["no"] + 1, True
            return [(*key, r[ref], s["no"], "START")]
        return [(*key, r[ref], None, None)]

    return ordered_fold(df.select(*dict.fromkeys([*keys, *order, ref, opens, closes, narrator])), keys, order, start, step, lambda s, key: [], schema)


def word_chunks(df: DataFrame, unit: str, text: str, size: int, tail: float = 0.5, step: int | None = None) -> DataFrame:
    """(unit, chunk, first_word, n_words, chunk_text): each text in chunks of ``size`` words.

    The last chunk stays if it has at least ``tail`` of ``size`` words; chunks
    are numbered from 1 without gaps. With ``step`` below ``size`` the chunks
    overlap (rolling windows); then only full windows come out. Words lie
    between ASCII blanks. A null or short text gives no chunk.
    """
    from versloom.functions.text import words_by_blanks

    w = F.col("_w")
    n = F.size(w)
    if step:
        last = F.floor((n - size) / step).cast("int")
        starts = F.when(n >= size, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))
    else:
        least = int(size // 2) if tail == 0.5 else tail * size
        last = F.floor((n - 1) / size).cast("int")
        starts = F.when(n > 0, F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: i * size), lambda s: F.least(F.lit(size), n - s) >= F.lit(least)))
    cut = df.select(unit, words_by_blanks(F.col(text)).alias("_w")).select(unit, "_w", F.posexplode(starts).alias("k", "s"))
    piece = F.slice("_w", F.col("s") + 1, F.lit(size))
    return cut.select(unit, (F.col("k") + 1).cast("int").alias("chunk"), F.col("s").cast("int").alias("first_word"), F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("chunk_text"))


def dehyphenated(lines: DataFrame, doc: str, number: str, line: str) -> DataFrame:
    """(doc, number, line, joined_word, blanks_skipped): lines after words broken at line ends were joined.

    A line that ends in a hyphen takes the first word of the next line with
    content, if that starts in column 0 and in lower case, or if both parts are
    upper case. Blank lines between are dropped, as is a line of which nothing
    is left. The joined word's own hyphen is not looked at again, the rest of
    the continuation is. ``joined_word`` is null where nothing was joined.
    """
    import re

    schema = T.StructType([T.StructField(doc, lines.schema[doc].dataType), T.StructField(number, lines.schema[number].dataType)]).add("line", "string").add("joined_word", "string").add("blanks_skipped", "integer")

    def start():
        return {"held": None, "blanks": []}

    def settle(s):
        """The held line and the blanks after it, as they are."""
        out = ([s["held"]] if s["held"] else []) + s["blanks"]
        s["held"], s["blanks"] = None, []
        return out

    def step(s, r):
        text, at = r[line] or "", (r[doc], r[number])
        out = []
        if s["held"]:
            if not text.strip():
                s["blanks"].append((*at, text, None, 0))
                return out
            before = s["held"][2]
            first = re.match(r"\S+", text)
            part = re.search(r"(\S+)-\s*$", before)
            suffix = first.group(0) if first else ""
            if suffix and (suffix[0].islower() or (part.group(1).isupper() and suffix.isupper())):
                out.append((*at[:1], s["held"][1], re.sub(r"-\s*$", "", before) + suffix, part.group(1) + suffix, len(s["blanks"])))
                s["held"], s["blanks"] = None, []
                text = text[len(suffix) :].lstrip()
                if not text:
                    return out
            else:
                out += settle(s)
        if re.search(r"\S-\s*$", text):
            s["held"] = (*at, text, None, 0)
        else:
            out.append((*at, text, None, 0))
        return out

    return ordered_fold(lines.select(doc, number, line), [doc], [number], start, step, lambda s, key: settle(s), schema)


def capped(df: DataFrame, group: str, item: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each group, chosen by an MD5 order that every engine repeats; without dependence on row order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string")))
    w = Window.partitionBy(group).orderBy(key, item)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def positional_groups(df: DataFrame, part: list[str], order: list[str], size: int, out: str = "position_group") -> DataFrame:
    """``df`` with the number of its place in ``order`` divided by ``size``."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(out, F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def halves(df: DataFrame, part: list[str], order: list[str], out: str = "half") -> DataFrame:
    """``df`` with first or second by place in ``order``; the middle row of an odd number is in the second half."""
    w = Window.partitionBy(*part)
    place = F.row_number().over(w.orderBy(*order))
    return df.withColumn(out, F.when(place <= F.floor(F.count(F.lit(1)).over(w) / 2), "first").otherwise("second"))


def floor_lookup(df: DataFrame, bounds: DataFrame, keys: list[str], at: str, start: str, value: str, out: str) -> DataFrame:
    """``df`` with ``value`` of the greatest ``start`` that is not above ``at`` within ``keys``: an as-of join.

    Both sides are sorted once by key and place; no pairs are made. Rows before
    the first bound get null. Of bounds that start together the greatest value
    counts.
    """
    kept = df.columns
    left = df.withColumns({"_at": F.col(at), "_side": F.lit(1), "_value": F.lit(None).cast(bounds.schema[value].dataType)})
    right = bounds.groupBy(*keys, F.col(start).alias("_at")).agg(F.max(value).alias("_value")).withColumn("_side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    filled = carried_forward(both, keys, ["_at", "_side"], "_value", out)
    return filled.where("_side = 1").select(*kept, out)


def column_flags(df: DataFrame, **flags: Column) -> DataFrame:
    """``df`` with boolean columns, false where the condition is unknown."""
    return df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def merged_segments(df: DataFrame, keys: list[str], order: list[str], voice: str, words: str, least: int = 500) -> DataFrame:
    """(keys, segment, voice, n_rows, words): rows in order; one below ``least`` words joins the segment before if that has its voice, else the next of its voice that follows at once."""
    schema = T.StructType([df.schema[k] for k in keys]).add("segment", "integer").add("voice", "string").add("n_rows", "integer").add("words", "long")

    def start():
        return {"no": 0, "open": None}

    def step(s, r):
        n, v, b = int(r[words] or 0), r[voice], s["open"]
        if b and b[0] == v and (n < least or b[2] < least):
            b[1], b[2] = b[1] + 1, b[2] + n
            return []
        out = finish(s, tuple(r[k] for k in keys))
        s["open"] = [v, 1, n]
        return out

    def finish(s, key):
        if not s["open"]:
            return []
        s["no"] += 1
        return [(*key, s["no"], *s["open"])]

    return ordered_fold(df.select(*dict.fromkeys([*keys, *order, voice, words])), keys, order, start, step, finish, schema)


def line_segments(lines: DataFrame, doc: str, number: str, line: str, size: int = 1000, bounds: DataFrame | None = None) -> DataFrame:
    """(doc, segment, start_line, end_line, n_words, text[, book, spans_boundary]): texts in segments of ``size`` words that know their lines.

    The last segment stays if it has at least half of ``size``; segments count
    from 1. With ``bounds`` (doc, start, book) a segment belongs to the book of
    its middle line, and ``spans_boundary`` says that its first and last lines
    lie in different ones. Only line totals are summed along a text; words are
    grouped by segment, never by text.
    """
    from versloom.functions.text import words_by_blanks

    w = Window.partitionBy(doc).orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.select(doc, F.col(number).alias("_line"), words_by_blanks(F.coalesce(line, F.lit(""))).alias("_w"))
    placed = counted.withColumn("_before", F.coalesce(F.sum(F.size("_w")).over(w), F.lit(0)))
    words = placed.select(doc, "_line", "_before", F.posexplode("_w").alias("_p", "_word")).withColumn("_at", F.col("_before") + F.col("_p"))
    by = words.groupBy(doc, (F.floor(F.col("_at") / size) + 1).cast("int").alias("segment"))
    out = by.agg(F.min("_line").alias("start_line"), F.max("_line").alias("end_line"), F.count(F.lit(1)).cast("int").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_word"))), lambda x: x["_word"]), " ").alias("text"))
    out = out.where(F.col("n_words") >= size // 2)
    if bounds is None:
        return out
    middle = F.floor((F.col("start_line") + F.col("end_line")) / 2)
    named = bounds.withColumnRenamed("book", "_book")
    for name, at in (("_first", F.col("start_line")), ("_last", F.col("end_line")), ("book", middle)):
        out = floor_lookup(out.withColumn("_mark", at), named, [doc], "_mark", "start", "_book", name).drop("_mark")
    return out.withColumn("spans_boundary", ~F.col("_first").eqNullSafe(F.col("_last"))).drop("_first", "_last")
