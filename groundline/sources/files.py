"""Course files as tables: discovery, path safety, text and Markdown, workbooks, layout lines, question sets and event streams."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions.text import nfc

SUFFIXES = ("pdf", "md", "markdown", "txt", "xlsx")
DEFAULT_SUBJECT = "Général"
MAX_PATH = 512
#: What a PDF decoder has to deliver; everything behind it is Spark.
LAYOUT_LINES = "doc_id string, page int, idx int, text string, size double, top double, bottom double, block int, highlighted boolean, box array<double>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def safe_path(relative: str) -> bool:
    """Whether a path stays inside the course folder, is of a known kind and short enough."""
    path = PurePosixPath(relative)
    return bool(relative) and len(relative) <= MAX_PATH and not path.is_absolute() and ".." not in path.parts and path.suffix.lower().lstrip(".") in SUFFIXES


def course_files(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """(path, subject, course_id, source, reason) of every visible file under root; reason tells why a file is skipped, else null.

    A top folder with a visible file of its own is a course of the default subject; otherwise it is a subject and its folders are courses.
    """
    relative = F.regexp_replace(F.col(path), r"^\w+:/*", "/")
    rows = files.withColumn("rel", F.regexp_replace(relative, "^" + re.escape(root.rstrip("/")) + "/", "")).withColumn("parts", F.split("rel", "/"))
    visible = rows.filter(~F.exists("parts", lambda p: p.startswith(".")))
    depth = F.size("parts")
    tops = visible.groupBy(F.element_at("parts", 1).alias("head")).agg((F.count_if(depth == 2) > 0).alias("flat"))
    placed = visible.withColumn("head", F.element_at("parts", 1)).join(tops, "head")
    suffix = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    loose = (depth == 1) | (~F.col("flat") & (depth == 2))
    return placed.select(
        F.col(path).alias("path"),
        F.when(F.col("flat"), DEFAULT_SUBJECT).otherwise(F.col("head")).alias("subject"),
        F.when(F.col("flat"), F.col("head")).otherwise(F.try_element_at("parts", F.lit(2))).alias("course_id"),
        F.array_join(F.slice("parts", F.when(F.col("flat"), 2).otherwise(3), F.greatest(depth, F.lit(1))), "/").alias("source"),
        F.when(loose, "not in a course").when(~suffix.isin(*SUFFIXES), "unsupported kind").when(F.char_length("rel") > MAX_PATH, "path too long").alias("reason"),
    )


def courses_under_two_subjects(selected: DataFrame) -> DataFrame:
    return selected.filter("reason is null").groupBy("course_id").agg(F.countDistinct("subject").alias("subjects")).filter("subjects > 1")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def decoded(content: Column) -> Column:
    """UTF-8 without its mark where it is valid, else Latin-1; line feeds only; composed."""
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    text = F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return nfc(F.regexp_replace(text, r"\r\n?", "\n"))


def cell_text(value: object) -> str:
    """A cell as text: nothing for None, six significant digits for fractions, ISO for dates, single spaces elsewhere."""
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return " ".join(str(value).split())


def workbook_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet, name, row, cells) of a workbook's cached values."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), 1):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in root.iter(f"{_MAIN}row"):
                cells: list[str] = []
                for cell in row.iter(f"{_MAIN}c"):
                    place = 0
                    for c in cell.get("r", ""):
                        if c.isalpha():
                            place = place * 26 + ord(c.upper()) - 64
                    cells += [""] * (max(place, len(cells) + 1) - len(cells))
                    raw, kind = cell.findtext(f"{_MAIN}v"), cell.get("t")
                    if kind == "s" and raw is not None:
                        cells[-1] = cell_text(shared[int(raw)])
                    elif kind == "inlineStr":
                        cells[-1] = cell_text("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
                    elif kind == "b" and raw is not None:
                        cells[-1] = str(raw == "1")
                    elif raw is not None and kind in (None, "n"):
                        cells[-1] = raw if raw.lstrip("-").isdigit() else cell_text(float(raw))
                    else:
                        cells[-1] = cell_text(raw)
                while cells and not cells[-1]:
                    cells.pop()
                yield number, sheet.get("name", ""), int(row.get("r", 0)), cells


def sheet_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, sheet_name, row, cells, error) of all workbooks among binary files; an unreadable one gives a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(path, *row, None) for row in workbook_rows(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as why:
                    rows.append((path, None, None, None, None, type(why).__name__))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["path", "sheet", "sheet_name", "row", "cells", "error"])

    books = files.filter(F.lower("path").endswith(".xlsx")).select("path", "content")
    return books.mapInArrow(run, "path string, sheet int, sheet_name string, row int, cells array<string>, error string")


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, targets) of a JSON question set; off-topic questions have no target."""
    schema = "questions array<struct<question: string, targets: array<struct<source: string, match: string>>>>, off_topic array<string>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    asked = raw.select(F.explode("questions").alias("q")).select("q.question", "q.targets")
    other = raw.select(F.explode("off_topic").alias("question")).withColumn("targets", F.array().cast("array<struct<source: string, match: string>>"))
    return asked.unionByName(other)


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object for each line, null fields kept."""
    events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("e")).select("e.*")
