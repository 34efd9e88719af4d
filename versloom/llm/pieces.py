"""Problem 6: splitting oversized items at natural boundaries.

Method: offsets of all tokens with prefix sums of their sizes, and the sorted
array of boundaries; a binary search finds the last boundary under the limit,
the next piece steps back by the overlap, and where no boundary fits the cut is
a hard one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.functions.words import word_spans
from versloom.llm.blocks import current_blocks

_END = re.compile("[.!?][\"'”’»)\\]]*$")
_MARKS = re.compile(r"[.!?]")
MEASURES = ("words", "bytes")


def longest_stretch(text: str) -> int:
    """Most words in a stretch of ``text`` between two of the marks ``.``, ``!``, ``?`` or its ends."""
    return max(len(s.split()) for s in _MARKS.split(text))


def _tokens(text: str, limit: int, measure: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    spans = word_spans(text)
    if measure == "words":
        return spans, np.arange(len(spans) + 1)
    # a token reaches up to the next one, so that sizes add up to the size of the text
    starts = [0, *[a for a, _ in spans[1:]], len(text)]
    out, sizes = [], [0]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        while a < b:
            end, n = b, len(text[a:b].encode("utf-8", "surrogatepass"))
            if n > limit:  # a token that is too large alone is cut at a character
                end, n = a, 0
                while (c := len(text[end].encode("utf-8", "surrogatepass"))) + n <= limit or end == a:
                    n, end = n + c, end + 1
            out.append((a, end))
            sizes.append(n)
            a = end
    return out, np.cumsum(sizes)


def cut_points(prefix: np.ndarray, boundaries: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (first token, end token, kind of cut: end, sentence or hard).

    ``prefix`` has the size of all tokens before each; ``boundaries`` are the
    sorted token numbers before which a cut is natural.
    """
    n, start, done, out = len(prefix) - 1, 0, 0, []
    while True:
        if prefix[n] - prefix[start] <= limit:
            return [*out, (start, n, "end")]
        most = int(np.searchsorted(prefix, prefix[start] + limit, "right")) - 1
        if most <= done:  # the overlap leaves no room for the next token
            start = start + 1 if start < done else start
            if start == done and prefix[done + 1] - prefix[done] > limit:
                most = done + 1
            else:
                continue
        k = int(np.searchsorted(boundaries, most, "right")) - 1
        natural = k >= 0 and boundaries[k] > done
        end = int(boundaries[k]) if natural else most
        out.append((start, end, "sentence" if natural else "hard"))
        done = end
        start = max(start + 1, int(np.searchsorted(prefix, prefix[end] - overlap, "left")))


def pieces_of(text: str | None, limit: int, overlap: int, measure: str = "words") -> list[dict]:
    """The pieces of one text; one piece without words for a null, empty or blank text."""
    if not text:
        return [{"piece_no": 0, "first_word": 0, "n_words": 0, "cut": "end", "piece": text}]
    spans, prefix = _tokens(text, limit, measure)
    if not spans:
        return [{"piece_no": 0, "first_word": 0, "n_words": 0, "cut": "end", "piece": text}]
    marks = np.array([i + 1 for i, (a, b) in enumerate(spans) if _END.search(text[a:b].rstrip())], dtype=np.int64)
    out = []
    for k, (a, b, cut) in enumerate(cut_points(prefix, marks, limit, overlap)):
        lo = 0 if a == 0 else spans[a][0]
        hi = len(text) if b == len(spans) else spans[b][0]
        out.append({"piece_no": k, "first_word": a, "n_words": b - a, "cut": cut, "piece": text[lo:hi]})
    return out


def split_oversized(df: DataFrame, text: str, limit: int = 1200, overlap: int = 50, measure: str = "words", keep_small: bool = True) -> DataFrame:
    """Rows of ``df`` as pieces of at most ``limit``, each repeating the last ``overlap`` of the one before.

    ``measure`` is what is counted: words, or bytes in UTF-8. Pieces end at
    sentence ends where one lies beyond the end of the piece before, else at
    the last token that fits; in bytes, a token above the limit is cut between
    characters. The overlap shrinks where the next token would not fit beside
    it. Every piece holds the text as it is, with the white space that follows,
    so the pieces without their overlaps join to the text again.

    Added columns: ``piece_no``, ``first_word`` and ``n_words`` (tokens),
    ``cut`` (end, sentence or hard), ``longest_stretch`` (most words between
    two of ``.!?``; null for items under the limit) and ``piece``; a column of
    that name in ``df`` is replaced. Items under the limit come out whole with
    ``keep_small``, else not at all; they never reach Python. A null, empty or
    blank text is one piece without words. Repeated rows are cut each for
    itself; an empty table gives an empty table.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap below it")
    if measure not in MEASURES:
        raise ValueError(f"measure is one of {MEASURES}")
    added = T.StructType().add("piece_no", "integer").add("first_word", "integer").add("n_words", "integer").add("cut", "string").add("longest_stretch", "integer").add("piece", "string")
    names = [c for c in df.columns if c not in added.names and c != text]
    row = F.struct(*names).alias("_row") if names else F.struct(F.lit(1).alias("_none")).alias("_row")
    n = F.regexp_count(F.col(text), F.lit(r"(?U)\S+")) if measure == "words" else F.octet_length(text)
    source = df.select(row, F.col(text).cast("string").alias("_text"), F.coalesce(n > limit, F.lit(False)).alias("_large"))
    schema = T.StructType([source.schema["_row"], *added.fields])
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                at, rows = [], []
                for i, t in enumerate(part.column("_text").to_pylist()):
                    longest = longest_stretch(t)
                    for x in pieces_of(t, limit, overlap, measure):
                        at.append(i)
                        rows.append((x["piece_no"], x["first_word"], x["n_words"], x["cut"], longest, x["piece"]))
                if rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(at)), *columns], names=schema.names)

    out = source.where("_large").select("_row", "_text").mapInArrow(cut, schema)
    if keep_small:
        words = F.coalesce(F.regexp_count("_text", F.lit(r"(?U)\S+")), F.lit(0))
        small = source.where("NOT _large").select(
            "_row", F.lit(0).alias("piece_no"), F.lit(0).alias("first_word"), words.cast("int").alias("n_words"),
            F.lit("end").alias("cut"), F.lit(None).cast("int").alias("longest_stretch"), F.col("_text").alias("piece"),
        )
        out = out.unionByName(small)
    return out.select(*[F.col("_row")[c].alias(c) for c in names], *added.names)


def oversized_blocks(spark: SparkSession, folder: str, limit: int = 1200) -> DataFrame:
    """Current blocks above ``limit`` words. Texts under it are not moved: only their row competes for being current."""
    from versloom.tables import latest_rows, table

    n = F.regexp_count("text", F.lit(r"(?U)\S+"))
    rows = table(spark, folder, "voice_blocks").select("block_id", "ingested_at", F.when((F.length("text") > 2 * limit) & (n > limit), F.col("text")).alias("text"))
    return latest_rows(rows, "block_id", "ingested_at", ["text"]).where(F.col("text").isNotNull())


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the oversized current blocks."""
    return split_oversized(oversized_blocks(spark, folder), "text", 1200, 50, keep_small=False)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that had to be cut, by how: a stretch above the limit can't lie in one piece, so only a block with a hard cut can be unbroken; the stretch is then checked."""
    blocks = p6_pieces(spark, folder).groupBy("block_id").agg(F.count_if(F.col("cut") == "hard").alias("hard"), F.max("longest_stretch").alias("longest"))
    kind = F.when((F.col("hard") > 0) & (F.col("longest") > 1200), "unbroken").otherwise("plain")
    return blocks.select("block_id", kind.alias("kind"))


def p6_all_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every current block as pieces, measured instead of shown."""
    pieces = split_oversized(current_blocks(spark, folder, ["text"]), "text", 1200, 50)
    return pieces.select("block_id", "piece_no", "first_word", "n_words", "cut", F.length("piece").alias("n_chars"))


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_all_blocks": p6_all_blocks}
_WS = "[\\x{0009}-\\x{000D}\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
ORACLE_SQL = {
    "p6_found": f"""
WITH b AS (SELECT block_id, text FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) AS r FROM voice_blocks) WHERE r = 1),
n AS (SELECT block_id, text, len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '')) AS w FROM b),
s AS (SELECT block_id, list_max(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: len(list_filter(regexp_split_to_array(s, '{_WS}'), lambda x: x <> '')))) AS m FROM n WHERE w > 1200)
SELECT block_id, CASE WHEN m > 1200 THEN 'unbroken' ELSE 'plain' END AS kind FROM s
"""
}
