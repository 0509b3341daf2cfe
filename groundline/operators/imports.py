"""From files to chunks: each file goes by its suffix to its reader, readers give segments, segments become chunks with their report.

Everything is lazy: what ``prepare`` returns is the dry run, and writing it is the import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import base_name, document_kind, squeeze
from groundline.operators import chunking, library, structure
from groundline.sources import files

SEGMENTS = ("document_id", "page", "segment", "heading", "text")


def plain_heading(text: Column) -> Column:
    """A heading without emphasis and code marks, in single spaces."""
    return squeeze(F.regexp_replace(text, r"[*_`]+", ""))


def with_sections(pages: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Segments with section_title, carried as ``chunking.heading_and_section`` does, from kind (named, plain or null; one for each page).

    A plain divider counts only in a document that has two of them or more.
    """
    plain = F.count_if(F.col("kind") == "plain").over(Window.partitionBy(doc))
    divider = F.coalesce((F.col("kind") == "named") | ((F.col("kind") == "plain") & (plain >= 2)), F.lit(False))
    return chunking.heading_and_section(pages.withColumn("divider", divider), doc, order).drop("divider")


def drafts(segments: DataFrame) -> DataFrame:
    """(document_id, page, chunk_position, section_title, text, id): the segments cut into chunks numbered through each document.

    A segment that is a heading alone is left out if its page has text elsewhere.
    """
    has_text = F.max(F.coalesce(F.col("text") != "", F.lit(False))).over(Window.partitionBy("document_id", "page"))
    rows = segments.withColumn("page_has_text", has_text).filter((F.coalesce("text", F.lit("")) != "") | ~F.col("page_has_text"))
    last = F.element_at(F.split("heading", " > "), -1)
    body = F.concat_ws("\n", last, F.nullif("text", F.lit("")))
    cut = chunking.page_chunks(rows.select("document_id", "page", "segment", "heading", body.alias("body")), ("document_id", "page", "segment", "heading"), "body")
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "segment", "position")) - 1
    placed = cut.withColumn("chunk_position", number)
    return placed.select("document_id", "page", "chunk_position", F.col("heading").alias("section_title"), F.col("chunk").alias("text"), library.chunk_id(F.col("document_id"), F.col("chunk_position"), F.col("page"), F.col("chunk")).alias("id"))


def segments_of(named: DataFrame) -> DataFrame:
    """SEGMENTS of all files (document_id, path, kind, content) that have a reader here: texts, Markdown and workbooks."""
    texts = named.filter(F.col("kind").isin("text", "markdown")).select("document_id", "kind", files.decoded(F.col("content")).alias("text"))
    lines = structure.numbered_lines(texts.filter("kind = 'markdown'"), "document_id")
    marked = structure.markdown_segments(lines, "document_id").select("document_id", F.lit(1).alias("page"), F.col("segment").cast("int").alias("segment"), plain_heading(F.col("path")).alias("heading"), "text")
    plain = texts.filter("kind = 'text'").select("document_id", F.lit(1).alias("page"), F.lit(0).alias("segment"), F.lit(None).cast("string").alias("heading"), "text")
    rows = files.sheet_rows(named.filter("kind = 'spreadsheet'")).filter("error is null").join(named.select("path", "document_id"), "path")
    kept = structure.sheet_rows(rows.withColumn("k", F.struct("document_id", "sheet", "sheet_name")), "k", "row", "cells")
    sheets = kept.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n").alias("text"))
    books = sheets.select("k.document_id", F.col("k.sheet").alias("page"), F.lit(0).alias("segment"), F.col("k.sheet_name").alias("heading"), "text")
    return marked.unionByName(plain).unionByName(books)


def prepare(raw: DataFrame, subject: str, course: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, report) of binary files (path, content).

    chunks: (document_id, source, checksum, page, chunk_position, section_title, text, id). report: (source, outcome, chunks), one row for each
    file: prepared, no text, no reader (a PDF needs a decoder, whose lines go through ``layout``), or unsupported.
    """
    supported = F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1)).isin(*files.SUFFIXES)
    named = raw.select("path", "content", base_name(F.col("path")).alias("source"), F.sha2("content", 256).alias("checksum"))
    named = named.withColumn("kind", F.when(supported, document_kind(F.col("source")))).withColumn("document_id", library.document_id(F.lit(subject), F.lit(course), F.col("source"), F.col("checksum")))
    made = drafts(segments_of(named))
    told = named.select("document_id", "source", "checksum", "kind")
    counted = made.groupBy("document_id").agg(F.count("*").alias("chunks"))
    outcome = F.when(F.col("kind").isNull(), "unsupported").when(F.col("kind") == "pdf", "no reader").when(F.col("chunks").isNull(), "no text").otherwise("prepared")
    report = told.join(counted, "document_id", "left").select("source", outcome.alias("outcome"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return made.join(told.drop("kind"), "document_id").select("document_id", "source", "checksum", "page", "chunk_position", "section_title", "text", "id"), report


def tallies(report: DataFrame) -> DataFrame:
    """(outcome, files, chunks) of a report."""
    return report.groupBy("outcome").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))


def chunks_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, chunks): the number of stored chunks of each document, none included."""
    counted = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    return documents.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("chunks"))
