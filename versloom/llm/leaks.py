"""Problem 8: evaluation texts leaking into training text.

Method: rare n-gram seeds join the training passages to the test items, then a
Smith-Waterman alignment over terms scores the copies. A first pass counts in
how many documents each n-gram of an item occurs; in every window of ``run``
terms of an item the rarest n-gram becomes a seed, so no exact copy of that
length is missed, however common its words; n-grams that are rare in the corpus
are seeds everywhere, for edited copies. Every pair with a seed in common is
aligned, many pairs at a time.

Items are a stated set that does not grow with the corpus. They are sent to the
tasks in blocks of at most ``BLOCK`` terms, so their size is bounded however
many they are; the corpus is never shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from versloom.functions.words import terms
from versloom.tables import table

#: Terms of a seed, terms of an exact copy, and terms of the items of one block.
SEED, RUN, BLOCK = 4, 12, 2_000_000
#: An n-gram in at most this share of the documents, or in this many, is a seed wherever it stands.
RARE, FEW = 0.001, 16
#: Terms on either side of where an item would lie that an alignment looks at too.
MARGIN = 8
#: Share of the score of a full copy that an edited copy has at least.
LEAST = 0.5
#: Alignment: match, mismatch and gap; and the cells that are computed at once.
MATCH, MISMATCH, GAP = 2, -2, -2
CELLS = 1 << 15
_PRIME = np.uint64(0x100000001B3)


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` ids at each place."""
    codes = (ids.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(31)
    width = len(ids) - n + 1
    h = np.zeros(width, np.uint64)
    for k in range(n):
        h = h * _PRIME + codes[k : k + width]
    return h ^ (h >> np.uint64(33))


class ItemBlock:
    """Some items as arrays of term numbers, and the hashes of their n-grams."""

    def __init__(self, items: list[tuple], n: int = SEED, run: int = RUN):
        self.n, self.run, self.vocabulary = n, run, {}
        self.names = [i for i, _ in items]
        self.ids = [np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms(text)], np.int64) for _, text in items]
        grams = [(_windows(x, n), k) for k, x in enumerate(self.ids) if len(x) >= n]
        self.grams = np.unique(np.concatenate([h for h, _ in grams])) if grams else np.zeros(0, np.uint64)
        self.seeds = self.grams
        self.owners: dict[int, list[tuple[int, int]]] = {}

    def choose_seeds(self, frequency: np.ndarray, documents: int) -> None:
        """Keeps the rarest n-gram of every window and all that are rare; ``frequency`` goes with ``grams``."""
        chosen: set[int] = set()
        owners: dict[int, list[tuple[int, int]]] = {}
        for k, x in enumerate(self.ids):
            if len(x) < self.n:
                continue
            h = _windows(x, self.n)
            rank = frequency[np.searchsorted(self.grams, h)]
            span = max(1, min(self.run, len(x)) - self.n + 1)
            for lo in range(len(h) - span + 1):
                at = lo + int(np.argmin(rank[lo : lo + span]))
                chosen.add(int(h[at]))
            chosen.update(h[rank <= max(FEW, RARE * documents)].tolist())
            for at, g in enumerate(h.tolist()):
                owners.setdefault(g, []).append((k, at))
        self.owners = {g: owners[g] for g in chosen}
        self.seeds = np.array(sorted(chosen), np.uint64)

    def hits(self, docs: list[list[str]], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Term numbers of all ``docs`` in a row, where each begins, and places and ranks of the n-grams in ``wanted``."""
        get = self.vocabulary.get
        ids = np.array([get(t, -1) for d in docs for t in d], np.int64)
        ends = np.cumsum([len(d) for d in docs])
        starts = ends - np.fromiter((len(d) for d in docs), np.int64, len(docs))
        none = np.zeros(0, np.int64)
        if len(ids) < self.n or not len(wanted):
            return ids, starts, none, none
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        at = np.flatnonzero(known[self.n :] - known[: -self.n] == self.n)
        doc = np.searchsorted(ends, at, "right")
        at = at[at + self.n <= ends[doc]]
        h = _windows(ids, self.n)[at]
        k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        ok = wanted[k] == h
        return ids, starts, at[ok], k[ok]


def align(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each of ``docs`` with its item: score, start and end in the document, and the longest run of equal terms in a row.

    Smith and Waterman's recurrence for many pairs of like sizes at a time, one
    term of the items after the other; the gap along a document is a running
    maximum. Unknown terms (-1) match nothing.
    """
    out = np.zeros((4, len(docs)), np.int64)
    order = sorted(range(len(docs)), key=lambda k: (len(docs[k]), len(items[k])))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(docs[order[hi]]) <= CELLS:
            hi += 1
        part = order[lo:hi]
        m = max(1, max(len(docs[k]) for k in part))
        doc = np.full((len(part), m), -1, np.int32)
        item = np.full((len(part), max(len(items[k]) for k in part)), -2, np.int32)
        for r, k in enumerate(part):
            doc[r, : len(docs[k])], item[r, : len(items[k])] = docs[k], items[k]
        out[:, part] = _align_table(doc, item)
        lo = hi
    return out[0], out[1], out[2], out[3]


def _align_table(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    n, m = doc.shape
    place = np.arange(m + 1, dtype=np.int32)
    ramp = -GAP * place
    score, run = np.zeros((n, m + 1), np.int32), np.zeros((n, m + 1), np.int32)
    begin = np.broadcast_to(place, (n, m + 1)).copy()
    rows = np.arange(n)
    best, lo, hi, longest = (np.zeros(n, np.int64) for _ in range(4))
    for j in range(item.shape[1]):
        equal = doc == item[:, j : j + 1]
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        longest = np.maximum(longest, run.max(axis=1))
        diagonal = score[:, :-1] + np.where(equal, MATCH, MISMATCH).astype(np.int32)
        up = score[:, 1:] + GAP
        straight = diagonal >= up
        raw = np.zeros((n, m + 1), np.int32)
        np.maximum(np.where(straight, diagonal, up), 0, out=raw[:, 1:])
        came = np.broadcast_to(place, (n, m + 1)).copy()
        came[:, 1:] = np.where(raw[:, 1:] == 0, place[1:], np.where(straight, begin[:, :-1], begin[:, 1:]))
        lifted = raw + ramp
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == top, place, 0), axis=1)
        score = top - ramp
        begin = np.where(score > 0, np.take_along_axis(came, source, axis=1), place)
        k = score.argmax(axis=1)
        value = score[rows, k]
        better = value > best
        best, lo, hi = np.where(better, value, best), np.where(better, begin[rows, k], lo), np.where(better, k, hi)
    return np.stack((best, lo, hi, longest))


def stretches(seeds: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Where to align an item of ``length`` terms with seeds at (place in the document, place in the item): ranges of the document, apart where seeds lie further apart than the item is long."""
    seeds = sorted(seeds)
    out, first = [], 0
    for k in range(1, len(seeds) + 1):
        if k == len(seeds) or seeds[k][0] - seeds[k - 1][0] > length + 2 * MARGIN:
            at = [p - q for p, q in seeds[first:k]]
            out.append((min(at) - MARGIN, max(at) + length + MARGIN))
            first = k
    return out


_LEAKS = T.StructType().add("longest_run", "integer").add("score", "integer").add("item_terms", "integer").add("first_term", "integer").add("end_term", "integer")


def _texts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[list[str]]]]:
    column = batch.column(batch.schema.get_field_index("_text"))
    for lo in range(0, len(column), size):
        yield lo, [terms(v) for v in column.slice(lo, size).to_pylist()]


def find_leaks(df: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = SEED, run: int = RUN) -> DataFrame:
    """(doc, item, longest_run, score, item_terms, first_term, end_term) for every document that shares a seed with an item.

    ``longest_run`` is the exact number of consecutive terms in common where
    the two were aligned; ``score`` that of the best local alignment between
    the item and the parts of the document around its seeds (2 for a match, -2
    for a mismatch or gap), found in the document from ``first_term`` to
    ``end_term``. Every pair with ``run`` consecutive terms in common has a
    row; pairs with less have one if a seed of ``n`` terms survived. Items and
    documents with fewer than ``n`` terms, null or empty texts give no row.
    Rows with a null item are left out; repeated documents and items get rows
    each. An item column named like the document column or a measure comes out
    with ``_item`` behind its name.
    """
    sized = items.where(F.col(item).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    whole = sized.agg(F.sum(F.length("t")), F.count(F.lit(1))).first()
    blocks = max(1, -(-(whole[0] or 0) // (BLOCK * 4)))
    out = None
    for b in range(blocks):
        part = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        block = ItemBlock([(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()], n, run)  # at most about BLOCK terms
        found = _block_leaks(df, doc, text, block, items.schema[item].dataType, item)
        out = found if out is None else out.unionByName(found)
    return out


def _block_leaks(df: DataFrame, doc: str, text: str, block: ItemBlock, kind: T.DataType, item: str) -> DataFrame:
    spark = df.sparkSession
    first = spark.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first.value
        total = np.zeros(len(block.grams), np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for _, docs in _texts(batch, 500):
                _, starts, at, k = block.hits(docs, block.grams)
                where = np.searchsorted(starts, at, "right")
                if len(at):
                    pairs = np.unique(np.stack((where, k)), axis=1)
                    total += np.bincount(pairs[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["g", "n"])

    counts = df.select(F.col(text).alias("_text")).mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    frequency, documents = np.zeros(len(block.grams), np.int64), 0
    for r in counts.collect():  # at most one row for each n-gram of the items
        if r["g"] < 0:
            documents = r["n"]
        else:
            frequency[r["g"]] = r["n"]
    block.choose_seeds(frequency, documents)
    seeded = spark.sparkContext.broadcast(block)
    schema = T.StructType([T.StructField("_doc", df.schema[doc].dataType), T.StructField("_item", kind), *_LEAKS.fields])
    item_type = to_arrow_type(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = seeded.value
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("_doc"))
            for lo, docs in _texts(batch, 500):
                ids, starts, at, k = block.hits(docs, block.seeds)
                where = np.searchsorted(starts, at, "right") - 1
                met: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for p, d, g in zip(at.tolist(), where.tolist(), k.tolist(), strict=True):
                    for owner, place in block.owners[int(block.seeds[g])]:
                        met.setdefault((d, owner), []).append((p, place))
                pairs, parts = [], []
                for (d, owner), seeds in met.items():
                    begin = int(starts[d])
                    end = int(starts[d + 1]) if d + 1 < len(starts) else len(ids)
                    for low, high in stretches([(p - begin, q) for p, q in seeds], len(block.ids[owner])):
                        pairs.append((d, owner, max(0, low)))
                        parts.append(ids[begin + max(0, low) : min(end, begin + high)])
                if not pairs:
                    continue
                score, first, last, longest = align(parts, [block.ids[owner] for _, owner, _ in pairs])
                rows: dict[tuple[int, int], tuple] = {}
                for (d, owner, low), s, a, z, r in zip(pairs, score.tolist(), first.tolist(), last.tolist(), longest.tolist(), strict=True):
                    was = rows.get((d, owner), (0, 0, 0, 0))
                    best = (s, low + a, low + z) if s > was[1] else was[1:]
                    rows[d, owner] = (max(r, was[0]), *best)
                at, names_of = [lo + d for d, _ in rows], [block.names[o] for _, o in rows]
                runs, scores, firsts, lasts = zip(*rows.values(), strict=True)
                sizes = [len(block.ids[o]) for _, o in rows]
                out = [names.take(pa.array(at)), pa.array(names_of, item_type), *(pa.array(c, pa.int32()) for c in (runs, scores, sizes, firsts, lasts))]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    found = df.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).mapInArrow(scan, schema)
    taken = {doc, *_LEAKS.names}
    return found.select(F.col("_doc").alias(doc), F.col("_item").alias(f"{item}_item" if item in taken else item), *_LEAKS.names)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and edited copies: 12 terms in a row, or an alignment with at least half the score of a full copy."""
    return _leaks(spark, folder).where((F.col("longest_run") >= RUN) | (F.col("score") >= F.col("item_terms") * MATCH * LEAST))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose alignment scores what an exact copy of 12 terms must; then the exact check of the run."""
    scored = _leaks(spark, folder).where(F.col("score") >= RUN * MATCH)
    return scored.where(F.col("longest_run") >= RUN).select("doc_id", "item_id").distinct()


#: Shares of the terms that the planted copies of ``p8_recall`` have changed.
EDITS = (0.1, 0.15, 0.2, 0.25, 0.3)


def edited(ts: list[str], share: float, words: list[str], rng: random.Random) -> list[str]:
    """``ts`` with about ``share`` of the terms put out, replaced by one of ``words``, or one put before."""
    out = []
    for t in ts:
        if rng.random() >= share:
            out.append(t)
        elif (k := rng.random()) < 0.6:
            out.append(rng.choice(words))
        elif k < 0.8:
            out += [rng.choice(words), t]
    return out


def p8_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(edits, planted, copies, found): edited copies of every item, planted in documents and looked for among all documents.

    ``copies`` are those that still score half of a full copy when they are
    aligned directly, ``found`` those of them that ``p8_leaks`` would report.
    """
    items = table(spark, folder, "eval_items").where("item_id IS NOT NULL").orderBy("item_id")  # a stated set that does not grow
    known = [(r["item_id"], terms(r["text"])) for r in items.select("item_id", "text").collect()]
    words = sorted({t for _, ts in known for t in ts})
    rng, rows = random.Random(8), []
    for share in EDITS:
        for k, ts in known:
            rows.append((-1 - len(rows), k, share, ts, edited(ts, share, words, rng)))
    number = {t: i for i, t in enumerate(words)}
    full = [[np.array([number[t] for t in r[c]], np.int64) for r in rows] for c in (4, 3)]
    scores = align(*full)[0].tolist() if rows else []
    rows = [(d, k, share, " ".join(copy), bool(ts) and s >= len(ts) * MATCH * LEAST) for (d, k, share, ts, copy), s in zip(rows, scores, strict=True)]
    planted = spark.createDataFrame(rows, "doc_id long, item_id long, edits double, copy string, is_copy boolean")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    n = max(1, docs.count())
    hosts = docs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(n))).groupBy("h").agg(F.min_by("text", "doc_id").alias("host"))
    placed = planted.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(n))).join(hosts, "h", "left")
    both = docs.unionByName(placed.select("doc_id", F.concat_ws(" ", "host", "copy", "host").alias("text")))
    found = find_leaks(both, "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")
    hit = found.where((F.col("longest_run") >= RUN) | (F.col("score") >= F.col("item_terms") * MATCH * LEAST)).select("doc_id", "item_id", F.lit(True).alias("hit")).distinct()
    scored = planted.join(hit, ["doc_id", "item_id"], "left").groupBy("edits")
    return scored.agg(F.count(F.lit(1)).alias("planted"), F.count_if("is_copy").alias("copies"), F.count_if(F.col("is_copy") & F.col("hit")).alias("found"))


_L = "[\\p{L}]"
_TERMS = f"regexp_extract_all(replace(replace(lower(nfc_normalize(text)), '’', ''''), '‘', ''''), '{_L}+(?:''{_L}+)*')"
QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_recall": p8_recall}
ORACLE_SQL = {
    "p8_found": f"""
WITH i AS (SELECT item_id, {_TERMS} AS ts FROM eval_items), d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
gi AS (SELECT DISTINCT item_id, array_to_string(ts[k:k + 11], ' ') AS g FROM (SELECT item_id, ts, unnest(range(1, len(ts) - 10)) AS k FROM i WHERE len(ts) >= 12)),
gd AS (SELECT DISTINCT doc_id, array_to_string(ts[k:k + 11], ' ') AS g FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - 10)) AS k FROM d WHERE len(ts) >= 12))
SELECT DISTINCT doc_id, item_id FROM gi JOIN gd USING (g)
"""
}
