"""Problem 4: long exact spans shared between records.

Method: difference-cover anchors. The windows of a text are hashed only at
places whose remainder modulo a period lies in a difference cover: for any two
alignments there is a shift at which both texts are sampled, so every match of
at least ``length`` bytes has an anchor in common, wherever it lies in either
text. Texts with an anchor in common are compared and their matches extended.

Texts are told apart by their content: records with equal texts are one node
from the start, before any anchor is cut, and only what is asked for as pairs
of records is expanded. Anchors travel as packed arrays, about eight bytes
each, routed by bits of their hash. An anchor that many texts of one slice
share is hot: only one of its entries goes to its bucket, to make it known
there; the others go to buckets of their own, by slice. So no task loads all
entries of an anchor, however many texts hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.session import staged
from versloom.tables import latest_rows, table

# Perfect difference sets by their period.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
#: Bytes looked at in one go, anchors of a bucket, texts of an anchor that one task pairs, and nodes that are broadcast.
SLICE, BUCKET, HOT, SMALL = 3_000_000, 1 << 20, 64, 200_000
#: Texts of one slice that make an anchor hot, and entries that a bucket holds before its hot anchors are taken out.
LOCAL, HELD = 8, 4 << 20


def cover_for(length: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and window for matches of ``length`` bytes: the largest period that leaves a window of two fifths of it."""
    for v in sorted(COVERS, reverse=True):
        if length - v + 1 >= max(8, int(length * 0.4)):
            return v, COVERS[v], length - v + 1
    return 1, (0,), length


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors of the texts ``data[starts[i]:ends[i]]``, and the number i of each, in order of i."""
    period, cover, window = cover_for(length)
    longest = int((ends - starts).max(initial=0))
    pattern = (np.arange(-(-max(longest, 1) // period))[:, None] * period + np.array(cover)).ravel()
    counts = np.searchsorted(pattern, ends - starts - window, "right")
    counts[ends - starts < length] = 0
    owner = np.repeat(np.arange(len(starts)), counts)
    if not len(owner):
        return np.zeros(0, np.uint64), owner
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = pattern[inner] + starts[owner]
    words = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,), writeable=False)
    h = np.zeros(len(at), np.uint64)
    for k in [*range(0, window - 8, 8), window - 8]:
        h = (h ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), owner


_PACKED = T.StructType().add("bucket", "integer").add("hot", "boolean").add("hashes", "binary").add("nodes", "binary").add("counts", "binary")
_PACKED_ARROW = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
_PAIRS = T.StructType().add("a", "long").add("b", "long").add("hot", "boolean")


def _packed(bucket: int, hot: bool, h: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> tuple:
    """A row with the upper 56 bits of every hash; ``counts`` says how many of them belong to each node."""
    return bucket, hot, (h >> np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), nodes.tobytes(), counts.astype(np.uint32).tobytes()


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    for hot, x, who, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hot", "hashes", "nodes", "counts")), strict=True):
        wide = np.zeros((len(x) // 7, 8), np.uint8)
        wide[:, :7] = np.frombuffer(x, np.uint8).reshape(-1, 7)
        yield hot, wide.reshape(-1).view(np.uint64), np.repeat(np.frombuffer(who, np.int64), np.frombuffer(n, np.uint32))


def _hot_members(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries belong to anchors that more than ``LOCAL`` texts of the slice hold."""
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    sizes = np.diff(np.append(edge, len(h)))
    many = np.zeros(len(h), bool)
    many[order] = np.repeat(sizes > LOCAL, sizes)
    at = np.flatnonzero(many)
    if not len(at):
        return many
    # the same text may hold an anchor more than once
    pairs = np.unique(np.stack((h[at], owner[at].astype(np.uint64))), axis=1)
    values, n = np.unique(pairs[0], return_counts=True)
    many[at] = np.isin(h[at], values[n > LOCAL])
    return many


def _packed_anchors(length: int, buckets: int):
    period = cover_for(length)[0]
    segment = max(period, SLICE // period * period)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            # a text longer than a slice is looked at in segments that overlap by less than the length of a match
            cuts = [(i, lo, min(int(e), lo + segment + length)) for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) for lo in range(int(s), max(int(s) + 1, int(e)), segment)]
            lo = 0
            while lo < len(cuts):
                hi, size = lo + 1, cuts[lo][2] - cuts[lo][1]
                while hi < len(cuts) and size + cuts[hi][2] - cuts[hi][1] <= SLICE and hi - lo < 60_000:
                    size += cuts[hi][2] - cuts[hi][1]
                    hi += 1
                who, starts, ends = (np.array(x) for x in zip(*cuts[lo:hi], strict=True))
                h, owner = anchors(data, starts, ends, length)
                hot = _hot_members(h, owner) if len(h) else np.zeros(0, bool)
                rows = []
                for is_hot in (False, True):
                    at = np.flatnonzero(hot == is_hot)
                    if is_hot and len(at):
                        # one entry makes the anchor known in its bucket, all go to a bucket of this slice
                        known = at[np.unique(h[at], return_index=True)[1]]
                        for b in np.unique(h[known] & np.uint64(buckets - 1)).tolist():
                            part = known[h[known] & np.uint64(buckets - 1) == b]
                            rows.append(_packed(int(b), True, h[part], nodes[who[owner[part]]], np.ones(len(part))))
                            mine = at[h[at] & np.uint64(buckets - 1) == b]
                            own, n = np.unique(owner[mine], return_counts=True)
                            rows.append(_packed(-1 - int((nodes[who[0]] ^ b) % buckets), True, h[mine], nodes[who[own]], n))
                    elif len(at):
                        bucket = (h[at] & np.uint64(buckets - 1)).astype(np.int64)
                        order = at[np.argsort(bucket, kind="stable")]
                        edges = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
                        for b in range(buckets):
                            part = order[edges[b] : edges[b + 1]]
                            if len(part):
                                own, n = np.unique(owner[part], return_counts=True)
                                rows.append(_packed(b, False, h[part], nodes[who[own]], n))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKED_ARROW, strict=True)], names=_PACKED.names)
                lo = hi

    return emit


def _pairs_of(h: np.ndarray, node: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of nodes with a hash in common, and the members (hash, node) of hashes that are in ``known`` or that too many share."""
    h, node, hot = _split_hot(h, node, known)
    hot_h, hot_node = h[hot], node[hot]
    h, node = h[~hot], node[~hot]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, HOT):
        same = np.flatnonzero(h[k:] == h[:-k]) if len(h) > k else []
        if not len(same):
            break
        a.append(node[same])
        b.append(node[same + k])
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
    return pairs[0], pairs[1], hot_h, hot_node


def _split_hot(h: np.ndarray, node: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in order, and which belong to hot hashes."""
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    h, node = h[fresh], node[fresh]
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(edge, len(h)))
    return h, node, np.repeat(sizes > HOT, sizes) | np.isin(h, known)


def _join_bucket():
    """Pairs of a bucket's texts. Where more entries come than are held at a time, hot anchors are passed on at once, so memory follows the number of different anchors."""

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = key[0].as_py()

        def rows(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b), pa.array(np.full(len(a), hot))], names=_PAIRS.names)

        hashes, nodes, size, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, np.zeros(0, np.uint64)
        for batch in batches:
            for hot, h, who in _unpacked(batch):
                if number < 0:  # a bucket of hot anchors
                    yield rows(h, who, True)
                    continue
                if hot:
                    known = np.union1d(known, h)
                    continue
                hashes.append(h)
                nodes.append(who)
                size += len(h)
            if size > HELD:
                h, who, many = _split_hot(np.concatenate(hashes), np.concatenate(nodes), known)
                known = np.union1d(known, h[many])
                yield rows(h[many], who[many], True)
                hashes, nodes = [h[~many]], [who[~many]]
                size = len(hashes[0]) // 2  # what is left is looked through again when as much has come
        if number >= 0:
            a, b, hot_h, hot_node = _pairs_of(np.concatenate(hashes), np.concatenate(nodes), known)
            yield rows(a, b, False)
            yield rows(hot_h, hot_node, True)

    return join


def _hot_pairs(hot: DataFrame) -> DataFrame:
    """Pairs among the members (a: anchor, b: node) of hot anchors, in cells of two shares of a group each, so that no task holds a group."""
    sizes = hot.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    member = hot.join(sizes, "a").select("a", "b", F.greatest(F.lit(1), F.ceil(F.col("n") / (8 * HOT))).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")
    cells = member.withColumn("share", share).select("a", "b", "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("other"))
    cell = cells.select("a", "b", "share", F.least("share", "other").alias("lo"), F.greatest("share", "other").alias("hi"))

    def pair(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        node, share = t.column("b").to_numpy(), t.column("share").to_numpy()
        i, j = np.triu_indices(len(node), 1)
        ok = (share[i] != share[j]) | (key[1] == key[2])
        a, b = np.minimum(node[i[ok]], node[j[ok]]), np.maximum(node[i[ok]], node[j[ok]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cell.groupBy("a", "lo", "hi").applyInArrow(pair, "a long, b long")


def common_spans(x: str, y: str, length: int) -> list[tuple[int, int, int]]:
    """Every maximal stretch of at least ``length`` characters that ``x`` and ``y`` have in common: start in each, and length."""
    half = length // 2
    window = length - half + 1  # a stretch of that length holds a whole window that begins at a multiple of half
    found: set[tuple[int, int, int]] = set()
    reach: dict[int, int] = {}
    for p in range(0, len(x) - window + 1, half):
        piece, q = x[p : p + window], -1
        while (q := y.find(piece, q + 1)) >= 0:
            if reach.get(p - q, -1) >= p + window:
                continue
            left = 0
            while left < min(p, q) and x[p - left - 1] == y[q - left - 1]:
                left += 1
            end, other = p + window, q + window
            while end < len(x) and other < len(y) and x[end] == y[other]:
                end, other = end + 1, other + 1
            reach[p - q] = end
            if end - p + left >= length:
                found.add((p - left, q - left, end - p + left))
    return sorted(found)


_SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
_MATCHES = T.StructType().add("text_a", "string").add("text_b", "string").add("longest", "integer").add("spans_a", _SPANS).add("spans_b", _SPANS)


def _compare(length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for ka, kb, x, y in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("ka", "kb", "xa", "xb")), strict=True):
                if spans := common_spans(x.as_py(), y.as_py(), length):
                    rows.append((ka.as_py(), kb.as_py(), max(n for _, _, n in spans), [{"start": p, "end": p + n} for p, _, n in spans], [{"start": q, "end": q + n} for _, q, n in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), kind, kind), strict=True)], names=_MATCHES.names)

    return compare


def text_digests(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_digest`` (of the text), ``_node`` (the first 64 bits of it), ``_chars`` and ``_bytes`` instead of ``text``."""
    digest = F.md5(F.col(text).cast("binary"))
    node = F.conv(F.substring("_digest", 1, 16), 16, -10).cast("long")
    return df.withColumn("_digest", digest).withColumn("_node", node).withColumns({"_chars": F.length(text), "_bytes": F.octet_length(text)}).drop(text)


def shared_spans(texts: DataFrame, text: str, length: int, total_bytes: int, only: DataFrame | None = None) -> DataFrame:
    """(text_a, text_b, longest, spans_a, spans_b) for every two different texts with ``length`` characters in common.

    Texts are named by their MD5 digests, text_a below text_b. ``total_bytes``
    is the size of all texts and sets the number of buckets. Null texts and
    texts shorter than ``length`` match nothing. Equal texts are one text here.
    With ``only`` (``_digest``) no other texts take part.
    """
    spark = texts.sparkSession
    period, cover, _ = cover_for(length)
    expected = total_bytes * len(cover) // period
    buckets = 1 << max(6, (expected // BUCKET).bit_length())
    named = texts.where(F.length(text) >= length).select(F.col(text).alias("_text")).withColumn("_digest", F.md5(F.col("_text").cast("binary")))
    # each text once: what is equal within a task is combined before the exchange
    named = named.groupBy("_digest").agg(F.first("_text").alias("_text"))
    if only is not None:  # the texts lie by their digests already, so only the digests move
        named = named.join(only, "_digest", "left_semi")
    own = staged(named.withColumn("_node", F.conv(F.substring("_digest", 1, 16), 16, -10).cast("long")), "texts")
    packed = own.select("_node", "_text").mapInArrow(_packed_anchors(length, buckets), _PACKED)
    joined = staged(packed.groupBy("bucket").applyInArrow(_join_bucket(), _PAIRS), "pairs")
    pairs = joined.where("NOT hot").select("a", "b")
    hot = joined.where("hot")
    if hot.limit(1).count():
        pairs = pairs.unionByName(_hot_pairs(hot.select("a", "b").distinct()))
    pairs = staged(pairs.distinct(), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    # broadcast up to a checked number of nodes of 8 bytes, else joined by shuffle
    wanted = F.broadcast(wanted) if wanted.limit(SMALL + 1).count() <= SMALL else wanted
    own = own.join(wanted, "_node", "left_semi")
    sides = [own.select(F.col("_node").alias(s), F.col("_digest").alias(f"k{s}"), F.col("_text").alias(f"x{s}")) for s in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    low = F.col("ka") < F.col("kb")
    swapped = both.select(*[F.when(low, F.col(f"{c}a")).otherwise(F.col(f"{c}b")).alias(f"{c}a") for c in "kx"], *[F.when(low, F.col(f"{c}b")).otherwise(F.col(f"{c}a")).alias(f"{c}b") for c in "kx"])
    return swapped.mapInArrow(_compare(length), _MATCHES)


LENGTH = 160


def _current(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Current blocks as (block_id, _digest, _chars), and the bytes of all rows' texts."""
    rows = staged(text_digests(table(spark, folder, "voice_blocks").select("block_id", "ingested_at", "text"), "text"), "digests")
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    return staged(latest_rows(rows, "block_id", "ingested_at", ["_digest", "_chars"]), "current"), total


def _matches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Current blocks, and the matches between their texts; texts that only outdated rows hold are left out before."""
    current, total = _current(spark, folder)
    live = current.where(F.col("_chars") >= LENGTH).select("_digest").distinct()
    return current, staged(shared_spans(table(spark, folder, "voice_blocks").select("text"), "text", LENGTH, total, live), "matches")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of current blocks; a pair of texts stands for all pairs of their blocks, and equal texts for theirs."""
    current, matches = _matches(spark, folder)
    a = current.select(F.col("block_id").alias("x"), F.col("_digest").alias("text_a"))
    b = current.select(F.col("block_id").alias("y"), F.col("_digest").alias("text_b"))
    apart = matches.select("text_a", "text_b").join(a, "text_a").join(b, "text_b").select("x", "y")
    long = current.where(F.col("_chars") >= LENGTH)
    repeated = long.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_digest")
    copies = long.join(repeated, "_digest").select("_digest", "block_id")
    equal = copies.withColumnRenamed("block_id", "x").join(copies.withColumnRenamed("block_id", "y"), "_digest").where("x < y").select("x", "y")
    return apart.unionByName(equal).select(F.least("x", "y").alias("block_id_a"), F.greatest("x", "y").alias("block_id_b")).distinct()


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For every current block its class of equal texts, how many texts share a passage with it and how much of its text is found in other blocks."""
    from pyspark.sql import Window

    current, matches = _matches(spark, folder)
    live = current.groupBy("_digest").agg(F.count(F.lit(1)).alias("copies"), F.first("_chars").alias("_chars"))
    sides = matches.select(F.col("text_a").alias("_digest"), F.explode("spans_a").alias("s")).unionByName(matches.select(F.col("text_b").alias("_digest"), F.explode("spans_b").alias("s")))
    spans = sides.select("_digest", "s.start", "s.end").distinct()
    before = F.max("end").over(Window.partitionBy("_digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("_digest").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("covered"))
    links = matches.select(F.explode(F.array("text_a", "text_b")).alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("links"))
    whole = (F.col("copies") > 1) & (F.col("_chars") >= LENGTH)
    per = live.join(covered, "_digest", "left").join(links, "_digest", "left")
    shared = F.when(whole, F.col("_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    per = per.select("_digest", F.coalesce("links", F.lit(0)).alias("links"), "copies", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared, F.col("_chars")), F.lit(0.0)).alias("share"))
    return current.join(per, "_digest", "left").select(
        "block_id", F.col("_digest").alias("text_class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("share", F.lit(0.0)).alias("share")
    )


QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares}
_BLOCKS = "b AS (SELECT block_id, text FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) AS r FROM voice_blocks WHERE block_id IS NOT NULL) WHERE r = 1)"
_WINDOWS = f"""t AS (SELECT md5(text) AS d, any_value(text) AS text, count(*) AS copies, any_value(length(text)) AS chars FROM b GROUP BY 1),
w AS (SELECT d, i, hash(substr(text, i, {LENGTH})) AS h FROM (SELECT d, text, unnest(range(1, length(text) - {LENGTH} + 2)) AS i FROM t WHERE length(text) >= {LENGTH})),
k AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT d) > 1), s AS (SELECT w.* FROM w JOIN k USING (h))"""
ORACLE_SQL = {
    "p4_found": f"""
WITH {_BLOCKS}, {_WINDOWS}, p AS (SELECT DISTINCT x.d AS da, y.d AS db FROM s x JOIN s y ON x.h = y.h AND x.d <> y.d UNION SELECT d, d FROM t WHERE copies > 1 AND chars >= {LENGTH}),
n AS (SELECT block_id, md5(text) AS d FROM b)
SELECT x.block_id AS block_id_a, y.block_id AS block_id_b FROM p JOIN n x ON x.d = da JOIN n y ON y.d = db WHERE x.block_id < y.block_id
""",
    "p4_shares": f"""
WITH {_BLOCKS}, {_WINDOWS}, l AS (SELECT x.d, count(DISTINCT y.d) AS links FROM s x JOIN s y ON x.h = y.h AND x.d <> y.d GROUP BY x.d),
c AS (SELECT d, sum(least({LENGTH}, gap)) AS covered FROM (SELECT d, coalesce(lead(i) OVER (PARTITION BY d ORDER BY i) - i, {LENGTH}) AS gap FROM s) GROUP BY d),
v AS (SELECT d, coalesce(links, 0) AS links, copies, CASE WHEN copies > 1 AND chars >= {LENGTH} THEN chars ELSE coalesce(covered, 0) END AS shared, chars FROM t LEFT JOIN l USING (d) LEFT JOIN c USING (d) WHERE d IS NOT NULL)
SELECT block_id, d AS text_class, coalesce(links, 0) AS links, coalesce(copies, 1) AS copies, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CAST(coalesce(shared / nullif(chars, 0), 0) AS DOUBLE) AS share FROM (SELECT block_id, md5(text) AS d FROM b) LEFT JOIN v USING (d)
""",
}
