"""What does not belong to a text: headers, page numbers, licence blocks, title pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A running header is a title with a page number before or after it.
HEADER = r"(?i)^(?:\d+\s+)?(?:the )?(?:first )?(?:book|words|record) of [a-z]+[.,:]?(?:\s+\d+)?$"
NUMBERED = r"(?:^\d+\s)|(?:\s\d+$)"


def numbered_header(line: Column, damaged: list[str] | None = None, pattern: str = HEADER) -> Column:
    """Whether a line is a running header with its page number, or one of the ``damaged`` headers known by their exact form."""
    s = F.trim(line)
    known = s.isin(damaged) if damaged else F.lit(False)
    return F.coalesce((s.rlike(pattern) & s.rlike(NUMBERED)) | known, F.lit(False))


def without_headers(lines: DataFrame, line: str, header: Column, mode: str = "remove") -> DataFrame:
    """``lines`` with ``header``; header lines are removed, marked as comments or kept."""
    flagged = lines.withColumn("header", header)
    if mode == "remove":
        return flagged.where("NOT header")
    if mode == "mark":
        return flagged.withColumn(line, F.when(F.col("header"), F.concat(F.lit("<!-- PAGE_HEADER: "), F.trim(line), F.lit(" -->"))).otherwise(F.col(line)))
    if mode == "keep":
        return flagged
    raise ValueError("mode is remove, mark or keep")


def header_audit(lines: DataFrame, doc: str, number: str, line: str, header: Column, first: int = 10) -> DataFrame:
    """The first header lines of each text with their number in it and among the lines that count."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(number)
    at = lines.withColumn("header", header).withColumn("line_in_content", F.row_number().over(w))
    ranked = at.where("header").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= first).select(doc, F.col(number).alias("line_in_original"), "line_in_content", F.trim(line).alias("text"))


def between_markers(text: Column, starts: list[str], ends: list[str], line_rest: bool = True) -> Column:
    """``text`` after the first of ``starts`` that it holds and before the first of ``ends``, stripped.

    Markers are looked for in the order given. With ``line_rest`` the rest of
    the line of a start marker goes too. Without any marker the text stays.
    """
    out = text
    for m in reversed(starts):
        after = F.substr(text, F.instr(text, m) + len(m))
        if line_rest:
            after = F.when(F.instr(after, "\n") > 0, F.substr(after, F.instr(after, "\n") + 1)).otherwise(F.lit(""))
        out = F.when(F.instr(text, m) > 0, after).otherwise(out)
    if ends:
        body, out = out, out
        for m in reversed(ends):
            out = F.when(F.instr(body, m) > 0, F.substr(body, F.lit(1), F.instr(body, m) - 1)).otherwise(out)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def after_every_marker(text: Column, starts: list[str], ends: list[str]) -> Column:
    """The other profile: every start marker cuts in turn, up to the next blank line; every end marker cuts; white space is collapsed."""
    for m in starts:
        rest = F.substr(text, F.instr(text, m))
        blank = F.instr(rest, "\n\n")
        text = F.when(F.instr(text, m) > 0, F.when(blank > 0, F.substr(rest, blank + 2)).otherwise(rest)).otherwise(text)
    for m in ends:
        text = F.when(F.instr(text, m) > 0, F.substr(text, F.lit(1), F.instr(text, m) - 1)).otherwise(text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def after_metadata(lines: DataFrame, doc: str, number: str, line: str, labels: tuple[str, ...] = ("Title", "Creator", "Rights"), least: int = 10) -> DataFrame:
    """``lines`` from the first that is neither blank, ruled nor a metadata field, and lies beyond line ``least``."""
    field = F.trim(line).rlike("^(?:___|" + "|".join(labels) + ")") | (F.trim(line) == "")
    starts = lines.where(~field & (F.col(number) > least)).groupBy(doc).agg(F.min(number).alias("_start"))
    return lines.join(starts, doc).where(F.col(number) >= F.col("_start")).drop("_start")


def from_first_chapter(lines: DataFrame, doc: str, number: str, line: str, titles: list[str] | None = None) -> DataFrame:
    """``lines`` from the heading of chapter I on, without lines that hold a number only or one of the running ``titles``, and without spaces before commas, full stops and semicolons."""
    heading = F.col(line).rlike(r"(?i)^\s*chap(?:ter)?\.?\s*i\.?\s*$")
    starts = lines.groupBy(doc).agg(F.min(F.when(heading, F.col(number))).alias("_start"))
    kept = lines.join(starts, doc).where(F.col(number) >= F.col("_start")).drop("_start").where(~F.trim(line).rlike(r"^\d+$"))
    for t in titles or []:
        kept = kept.where(~F.col(line).rlike(rf"(?i)^\s*{t}\.?\s*\d*\s*$"))
    return kept.withColumn(line, F.regexp_replace(line, r"\s+([,.;])", "$1"))


def cut_ranges(lines: DataFrame, number: str, ranges: list[tuple[int, int, str]]) -> tuple[DataFrame, DataFrame]:
    """The lines outside of all ranges, and those inside with the name of their range: two complementary filters."""
    name = F.lit(None).cast("string")
    for lo, hi, label in reversed(ranges):
        name = F.when(F.col(number).between(lo, hi), label).otherwise(name)
    named = lines.withColumn("removed_as", name)
    return named.where("removed_as IS NULL").drop("removed_as"), named.where("removed_as IS NOT NULL")
