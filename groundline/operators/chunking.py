"""Pages to chunks: windows over one page, greedy packing of lines with carry and table headers, sections and embedding inputs."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.functions.text import clean_lines, nfc

SIZE, OVERLAP = 1000, 150
_SENTENCE = re.compile(r"[.!?][\"')\]]*\s+")
_ROW, _RULE = re.compile(r"^\s*\|"), re.compile(r"^\s*\|?\s*:?-{3,}")
# The body of a divider has at most so many characters, and its page less than this share of images; titles that open a section.
DIVIDER_BODY, IMAGE_SHARE = 60, 0.1
SECTION_TITLE = r"(?iu)^(chapitre|chapter|partie|part|section|module|s[ée]ance|le[çc]on|lesson|th[èe]me|unit[ée]?)\b|^[IVXLC]+[.)]\s|^\d+(\.\d+)*[.)]?\s"


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """One page cut into windows of at most size characters, each ending at the best boundary of its second half.

    A window ends before a blank line, a line feed or a space, and after a sentence with the white space behind it.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than size")
    out, start = [], 0
    while start < len(text):
        limit = end = min(start + size, len(text))
        if limit < len(text):
            low = start + max(1, size // 2)
            sentences = (m.end() for m in _SENTENCE.finditer(text, start, limit))
            ends = (text.rfind("\n\n", low, limit), text.rfind("\n", low, limit), max(sentences, default=-1), text.rfind(" ", low, limit))
            end = next((e for e in ends if e >= low), limit)
        if not text[start:end].isspace():
            out.append(text[start:end])
        start = len(text) if end == len(text) else max(start + 1, end - overlap)
    return out


def pack(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Cleaned lines packed greedily into chunks of at most size characters.

    A chunk that is full carries its last lines, as many as fit into overlap, into the next one; table rows are not carried, and a table
    that goes on has its two header rows repeated. A line longer than size is cut by ``windows`` first.
    """
    lines = [piece for line in text.split("\n") for piece in (windows(line, size, overlap) if len(line) > size else [line])]
    out: list[str] = []
    held: deque[str] = deque()
    length = 0  # of the held lines joined
    header: list[str] = []
    before = ""
    for line in lines:
        row = bool(_ROW.match(line))
        if row and _RULE.match(line) and _ROW.match(before):
            header = [before, line]
        elif not row and line.strip():
            header = []
        grown = length + len(line) + (1 if held else 0)
        if held and grown > size:
            out.append("\n".join(held))
            carry: deque[str] = deque()
            room = overlap
            while held and not _ROW.match(held[-1]) and len(held[-1]) + (1 if carry else 0) <= room:
                room -= len(held[-1]) + (1 if carry else 0)
                carry.appendleft(held.pop())
            held = carry
            if row and header and line not in header:
                held.extend(header)
            held.append(line)
            length = sum(map(len, held)) + len(held) - 1
        else:
            held.append(line)
            length = grown
        before = line
    out.append("\n".join(held))
    return [c for c in (x.strip() for x in out) if c]


@F.pandas_udf(T.ArrayType(T.StringType()))
def packed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else pack(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def cut(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else windows(t))


def page_windows(pages: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keys, position, chunk): every cleaned page cut into overlapping windows, without regard to lines. A narrow map."""
    return pages.select(*keys, F.posexplode(cut(clean_lines(nfc(F.col(text))))).alias("position", "chunk"))


def page_chunks(pages: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keys, position, chunk) of every page; pages without text have no chunk. A narrow map: no row leaves its partition."""
    return pages.select(*keys, F.posexplode(packed(clean_lines(nfc(F.col(text))))).alias("position", "chunk"))


def heading_and_section(segments: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Sections carried through a document in order: dividers open one, an empty heading path goes on with the one before.

    segments has (doc, order…, divider, title, heading_path); the result adds section_title: the section and the items of the path that
    it does not hold already, joined, or null.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    group = segments.withColumn("block", F.sum(F.col("divider").cast("int")).over(w))
    inside = Window.partitionBy(doc, "block").orderBy(*order)
    section = F.first(F.when(F.col("divider"), F.col("title")), ignorenulls=True).over(inside)
    path = F.last(F.when(~F.col("divider") & (F.size("heading_path") > 0), F.col("heading_path")), ignorenulls=True).over(inside)
    joined = F.array_join(F.array_union(F.array_compact(F.array(section)), F.coalesce(path, F.array().cast("array<string>"))), " > ")
    return group.withColumn("section_title", F.nullif(joined, F.lit(""))).drop("block")


def divider_kind(number: Column, titled: Column, segments: Column, title: Column, body: Column, image_share: Column) -> Column:
    """named, plain or null: whether a page only announces a section. Plain pages count if a document has two or more of them."""
    able = (number > 1) & titled & (segments == 1)
    named = title.rlike(SECTION_TITLE) & (F.char_length(body) <= DIVIDER_BODY) & ~F.contains(body, F.lit("- "))
    plain = (body == "") & (image_share < IMAGE_SHARE)
    return F.when(able & named, "named").when(able & plain, "plain")


def embedding_text(*parts: Column, text: Column) -> Column:
    """The context of a chunk, its non-empty parts joined, above its text."""
    return F.concat(F.concat_ws(" > ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit("\n\n"), text)


def model_input(text: Column, kind: Column, prefixes: dict[str, str]) -> Column:
    """The text as a model wants it: with the prefix of its kind (query or passage), where the model has one."""
    out = text
    for name, prefix in prefixes.items():
        out = F.when(kind == name, F.concat(F.lit(prefix), text)).otherwise(out)
    return out


def batches_of(rows: Iterator[pa.RecordBatch], most: int = 25) -> Iterator[pa.RecordBatch]:
    """Record batches cut to what an embedding provider takes in one request."""
    for batch in rows:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)
