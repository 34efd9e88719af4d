"""Problem 3: frequency of every distinct value or term.

Method: burst tries. Each task counts into a trie whose leaves are small
containers of suffixes with an occurrence and a record counter; a container
that grows too large bursts into children by its next character. The containers
are written once. Prefixes that hold more than their share of all entries are
heavy, and terms are routed by the shortest prefix that is not heavy, so every
route carries a bounded part; subtrees of the same route are merged.

A term found in a third of the records costs each task one entry, so hot terms
need no care; a record is counted whole in one task, which makes both counters
additive.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.functions.words import terms
from versloom.llm.blocks import current_blocks
from versloom.session import staged
from versloom.tables import latest_rows, table

#: Entries of a container before it bursts, and entries of a task's trie before it is written out.
BURST, FLUSH = 256, 500_000
#: Longest prefix that routes look at, and how many prefixes of each length may be heavy.
DEPTH, HEAVY = 6, 512


class BurstTrie:
    """Terms with an occurrence and a record counter."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.entries = burst, {}, 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while True:
            char = term[depth : depth + 1]  # empty at the end of a term: a container of its own
            child = node.get(char)
            if child is None:
                node[char] = {term[depth + 1 :]: [occurrences, records]}
                self.entries += 1
                return
            if None in child:  # an inner node
                node, depth = child[None], depth + 1
                continue
            suffix = term[depth + 1 :]
            if (counts := child.get(suffix)) is not None:
                counts[0] += occurrences
                counts[1] += records
                return
            child[suffix] = [occurrences, records]
            self.entries += 1
            if len(child) > self.burst and char:
                inner: dict = {}
                for s, counts in child.items():
                    inner.setdefault(s[:1], {})[s[1:]] = counts
                node[char] = {None: inner}
            return

    def containers(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """Prefix, suffixes, occurrences and records of every container."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            for char, child in node.items():
                if None in child:
                    todo.append((prefix + char, child[None]))
                else:
                    suffixes = list(child)
                    yield prefix + char, suffixes, [child[s][0] for s in suffixes], [child[s][1] for s in suffixes]


_ENTRIES = T.StructType().add("prefix", "string").add("suffix", T.ArrayType(T.StringType())).add("occurrences", T.ArrayType(T.LongType())).add("records", T.ArrayType(T.LongType()))
_COUNTS = T.StructType().add("term", "string").add("occurrences", "long").add("records", "long")
_ARROW = pa.schema([("prefix", pa.string()), ("suffix", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])


def _subtrees(split: Callable[[str], list[str]] | None) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = list(trie.containers())
            for lo in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[lo : lo + 1000], strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                occurrences: Counter = Counter()
                records: Counter = Counter()
                for value in batch.column(0).slice(lo, 500):
                    if (v := value.as_py()) is None:
                        continue
                    found = split(v) if split else [v]
                    occurrences.update(found)
                    records.update(set(found))
                for term, n in occurrences.items():
                    trie.add(term, n, records[term])
                if trie.entries > FLUSH:
                    yield from flushed()
                    trie = BurstTrie()
        yield from flushed()

    return count


def _heavy_prefixes(subtrees: DataFrame, limit: int) -> set[str]:
    """Prefixes of at most ``DEPTH`` characters with more than ``limit`` entries; at most ``HEAVY`` of a length are collected."""
    words = subtrees.select(F.explode(F.transform("suffix", lambda s: F.substring(F.concat("prefix", s), 1, DEPTH))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    words = staged(words, "prefixes")
    heavy: set[str] = {""}
    for depth in range(1, DEPTH + 1):
        at = words.where(F.length("p") >= depth).groupBy(F.substring("p", 1, depth).alias("p")).agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        found = {r["p"] for r in at.orderBy(F.desc("n")).limit(HEAVY).collect()}
        if not found:
            break
        heavy |= found
    return heavy


def count_terms(df: DataFrame, column: str, split: Callable[[str], list[str]] | None = terms) -> DataFrame:
    """(term, occurrences, records) of every distinct term of ``column``.

    ``split`` makes the terms of a value; with None the value itself, as a
    string, is the term. Null values hold nothing, as do texts without a term;
    an empty value counts as a value when ``split`` is None. Repeated rows are
    records of their own. An empty table gives an empty table. Texts are read
    whole, and no count is sampled, capped or estimated.
    """
    spark = df.sparkSession
    subtrees = staged(df.select(F.col(column).cast("string").alias("v")).mapInArrow(_subtrees(split), _ENTRIES), "subtrees")
    total = subtrees.agg(F.sum(F.size("suffix"))).first()[0] or 0
    if not total:
        return spark.createDataFrame([], _COUNTS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = _heavy_prefixes(subtrees, max(1000, total // (8 * tasks)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {}
            for prefix, suffixes, occ, rec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s, o, r in zip(suffixes, occ, rec, strict=True):
                    term, k = prefix + s, 0
                    while k < len(term) and term[:k] in heavy:
                        k += 1
                    group = out.setdefault(term[:k], [[], [], []])
                    group[0].append(term[k:])
                    group[1].append(o)
                    group[2].append(r)
            if out:
                rows = [(p, *g) for p, g in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, prefix = BurstTrie(), key[0].as_py()
        for batch in batches:
            for suffixes, occ, rec in zip(*(batch.column(c).to_pylist() for c in ("suffix", "occurrences", "records")), strict=True):
                for s, o, r in zip(suffixes, occ, rec, strict=True):
                    trie.add(s, o, r)
        for inner, suffixes, occ, rec in trie.containers():
            yield pa.RecordBatch.from_arrays([pa.array([prefix + inner + s for s in suffixes]), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], names=_COUNTS.names)

    return subtrees.mapInArrow(route, _ENTRIES).groupBy("prefix").applyInArrow(merge, _COUNTS)


def mark_terms(counts: DataFrame, n_records: int, rare: int, common: float) -> DataFrame:
    """``counts`` with ``mark``: rare in at most ``rare`` records, common in more than that and more than the share ``common`` of ``n_records``, else null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * n_records, "common")
    return counts.withColumn("mark", mark)


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    blocks = current_blocks(spark, folder, ["text"])
    n_blocks = table(spark, folder, "voice_blocks").agg(F.count_distinct("block_id")).first()[0]
    by_text = mark_terms(count_terms(blocks, "text"), n_blocks, 2, 0.5)
    corpora = latest_rows(table(spark, folder, "control_corpora").select("name", "processed_at", "clean_words"), "name", "processed_at", ["clean_words"]).where("clean_words IS NOT NULL")
    values = count_terms(corpora, "clean_words", None)
    by_value = mark_terms(values, corpora.count(), 2, 0.1)
    return by_text.withColumn("field", F.lit("text")).unionByName(by_value.withColumn("field", F.lit("clean_words")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).where("mark IS NOT NULL").select("field", "term", "mark")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).select("field", "term", "occurrences", "records", "mark")


_L = "[\\p{L}]"
P3_SQL = f"""
WITH b AS (SELECT block_id, replace(replace(lower(nfc_normalize(text)), '’', ''''), '‘', '''') AS t FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) AS r FROM voice_blocks) WHERE r = 1),
w AS (SELECT block_id, unnest(regexp_extract_all(t, '{_L}+(?:''{_L}+)*')) AS term FROM b),
c AS (SELECT 'text' AS field, term, count(*) AS occurrences, count(DISTINCT block_id) AS records FROM w GROUP BY term),
k AS (SELECT name, clean_words FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY processed_at DESC) AS r FROM control_corpora WHERE name IS NOT NULL) WHERE r = 1 AND clean_words IS NOT NULL),
v AS (SELECT 'clean_words' AS field, CAST(clean_words AS VARCHAR) AS term, count(*) AS occurrences, count(*) AS records FROM k GROUP BY 2),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.5 * (SELECT count(*) FROM b) THEN 'common' END AS mark FROM c
      UNION ALL SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM k) THEN 'common' END AS mark FROM v)
"""
QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
ORACLE_SQL = {
    "p3_found": P3_SQL + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p3_counts": P3_SQL + "SELECT field, term, occurrences, records, mark FROM m",
}
