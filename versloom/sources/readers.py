"""Sources: documents, lines, keyed text, markup, archives of one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.sources.schemas import MANIFEST


def json_records(spark: SparkSession, path: str, field: str, schema: T.StructType) -> DataFrame:
    """The records of the array ``field`` of JSON documents, one document a file. The schema is given, never inferred."""
    document = T.StructType([T.StructField(field, T.ArrayType(schema))])
    return spark.read.schema(document).option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, with U+FFFD for bytes that are no UTF-8; never an error for bad bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): the lines of each text from 1 on; the number comes from the text, never from the order of rows."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def keyed(lines: DataFrame, line: str, pattern: str, names: list[str]) -> DataFrame:
    """``lines`` that match ``pattern`` with its groups as columns; other lines are left out."""
    found = lines.where(F.col(line).rlike(pattern))
    return found.select("*", *[F.regexp_extract(line, pattern, i).alias(n) for i, n in enumerate(names, 1)])


#: A verse: book, chapter, verse and text.
VERSE = r"(?U)^([\w\s]+?)\s+(\d+):(\d+)\s+(.+)$"


def verses(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` of the form "Book 1:2 text" with book, chapter, verse, text and reference."""
    k = keyed(lines, line, VERSE, ["book", "chapter", "verse", "text"])
    k = k.withColumns({"chapter": F.col("chapter").cast("int"), "verse": F.col("verse").cast("int")})
    return k.withColumn("reference", F.format_string("%s %d:%d", "book", "chapter", "verse"))


def grouped_verses(lines: DataFrame, number: str, line: str, authors: DataFrame) -> DataFrame:
    """(book, author, text): verses of the books in ``authors`` (book, author), joined in the order of the file."""
    k = keyed(lines, line, r"^(\d?\s*[A-Za-z]+)\s+\d+:\d+\s+(.+)$", ["book", "verse_text"]).withColumn("book", F.trim("book"))
    # the list of authors is as long as the books asked for
    named = k.join(F.broadcast(authors), "book")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number), F.col("verse_text"))))
    return named.groupBy("book", "author").agg(F.array_join(F.transform(ordered, lambda x: x["verse_text"]), " ").alias("text"))


def markup_text(texts: DataFrame, key: str, xml: str, node: str = "t") -> DataFrame:
    """(key, text): the text of all ``node`` elements of a document, whatever their prefix."""
    return texts.select(key, F.array_join(F.xpath(F.col(xml), F.lit(f"//*[local-name()='{node}']/text()")), "").alias("text"))


def bracketed_speech(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, speaker, speech, verse_key): passages "[Speaker[words]]" with the last "<n,Book,Chapter,Verse>" before each."""
    from versloom.operators.sequences import carried_forward

    marks = F.regexp_extract_all(F.col(text), F.lit(r"(<\d+,[^>]*>|\[[^\[\]]+\[[^\[\]]*\]\])"), F.lit(1))
    flat = texts.select(key, F.posexplode(marks).alias("at", "m"))
    flat = flat.withColumn("k", F.when(F.col("m").startswith("<"), F.regexp_extract("m", r"^<\d+,(.*)>$", 1)))
    filled = carried_forward(flat, [key], ["at"], "k", "verse_key").where("k IS NULL")
    parts = r"^\[([^\[\]]+)\[([^\[\]]*)\]\]$"
    return filled.select(key, "at", F.regexp_extract("m", parts, 1).alias("speaker"), F.regexp_extract("m", parts, 2).alias("speech"), "verse_key")


def speaker_script(lines: DataFrame, doc: str, number: str, line: str, longest: int = 100) -> DataFrame:
    """(doc, segment, speaker, chapter, text) of scripts with "Chapter N" lines and speakers in capitals on lines of their own.

    A segment ends at the next chapter or speaker. Text before the first
    speaker belongs to nobody and is left out, as are leading verse numbers and
    segments without text.
    """
    from pyspark.sql import Window

    from versloom.operators.sequences import carried_forward

    s = F.trim(line)
    chapter = F.regexp_extract(s, r"^Chapter\s+(\d+)$", 1)
    speaker = s.rlike(r"^[A-Z][A-Z₀-₉\s]+(?:\([^)]+\))?$") & (F.length(s) < longest)
    marked = lines.where(s != "").withColumns({"_c": F.when(chapter != "", chapter.cast("int")), "_s": F.when(speaker, s)})
    w = Window.partitionBy(doc).orderBy(number)
    marked = marked.withColumn("segment", F.sum(F.when(F.col("_c").isNotNull() | F.col("_s").isNotNull(), 1).otherwise(0)).over(w))
    filled = carried_forward(carried_forward(marked, [doc], [number], "_c", "chapter"), [doc], [number], "_s", "speaker")
    body = filled.where("_c IS NULL AND _s IS NULL AND speaker IS NOT NULL").withColumn("t", F.regexp_replace(F.trim(line), r"^\d+\s+", ""))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number), F.col("t"))))
    return body.groupBy(doc, "segment", "speaker", "chapter").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))


def corpus(spark: SparkSession, manifest_path: str, folder: str, genre: str | None = None, period: str | None = None, last_early: int = 1904) -> tuple[DataFrame, DataFrame]:
    """Works of a manifest with their texts, and the works whose file is missing.

    The filters on genre and period apply to the manifest, before any text is read.
    """
    from versloom.functions.text import period as period_of

    m = spark.read.schema(MANIFEST).option("multiLine", True).json(manifest_path)
    if genre:
        m = m.where(F.col("genre") == genre)
    if period:
        m = m.where(period_of(F.col("publication_year"), last_early) == period)
    texts = whole_texts(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "text")
    return m.join(texts, "filename"), m.join(texts, "filename", "left_anti")


def prompts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, prompt, version, purpose): the fenced block under "## Prompt Text" of Markdown files, and two labelled lines."""
    body = F.regexp_extract(text, r"(?s)## Prompt Text\s*```[a-z]*\n(.*?)```", 1)
    label = lambda name: F.regexp_extract(text, rf"\*\*{name}:?\*\*:?\s*([^\n]+)", 1)
    return texts.select(key, F.when(body != "", F.regexp_replace(body, r"^\s+|\s+$", "")).alias("prompt"), label("Version").alias("version"), label("Purpose").alias("purpose"))


def prompt_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(module, prompt) for each Markdown file below ``folder``; the texts are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("module"), F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("prompt"))


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A relational table."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
