"""Order-dependent structure as windows over numbered lines: headings, blocks, questions, margins, overlays, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(docs: DataFrame, key: str, text: str = "text", page_lines: int = 10) -> DataFrame:
    """(key, line, page, text): lines numbered from 1, with trailing white space removed; pages of page_lines lines."""
    plain = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    rows = docs.select(key, F.posexplode(F.split(plain, "\n")).alias("at", "raw"))
    return rows.select(key, (F.col("at") + 1).alias("line"), (F.floor(F.col("at") / page_lines) + 1).cast("int").alias("page"), F.regexp_replace("raw", r"[\s ]+$", "").alias("text"))


def blocks(lines: DataFrame, key: str) -> DataFrame:
    """(key, first, last, n): runs of consecutive lines that are not blank."""
    kept = lines.filter(F.col("text") != "")
    island = F.col("line") - F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return kept.withColumn("island", island).groupBy(key, "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_lines")).drop("island")


def marked_blocks(found: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """(key, first_line, last_line, first_marked) of the blocks of ``blocks`` that hold a line of marks (key, line): what a viewer highlights."""
    inside = found.join(marks.select(key, "line").distinct(), key).filter((F.col("line") >= F.col("first_line")) & (F.col("line") <= F.col("last_line")))
    return inside.groupBy(key, "first_line", "last_line").agg(F.min("line").alias("first_marked"))


def headings(lines: DataFrame, key: str) -> DataFrame:
    """(key, line, level, heading, path) of the Markdown headings outside code fences; path joins the open headings above and itself."""
    w = Window.partitionBy(key).orderBy("line")
    fence = F.sum(F.col("text").rlike(r"^\s*(```|~~~)").cast("int")).over(w) % 2
    found = lines.withColumn("fenced", fence).filter("fenced = 0").withColumn("marks", F.regexp_extract("text", r"^(#{1,6})[ \t]+\S", 1)).filter("marks <> ''")
    level = F.length("marks")
    found = found.select(key, "line", level.alias("level"), F.regexp_replace(F.regexp_replace("text", r"^#{1,6}[ \t]+", ""), r"[ \t]*#*[ \t]*$", "").alias("heading"))
    parts = []
    for n in range(1, 7):
        # the last heading of this level, unless a heading of a lower level has come since
        seen = F.last(F.when(F.col("level") == n, F.struct("line", "heading")), ignorenulls=True).over(w)
        reset = F.last(F.when(F.col("level") < n, F.col("line")), ignorenulls=True).over(w)
        open_ = (F.col("level") >= n) & (seen["line"] > F.coalesce(reset, F.lit(-1)))
        parts.append(F.when(open_, seen["heading"]))
    return found.withColumn("path", F.concat_ws(" > ", *parts))


def frequent_margins(lines: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """(key, margin, pages): what stands, digits aside, first or last on that share of a document's pages or more (two at least)."""
    w = Window.partitionBy(key, "page")
    kept = lines.filter(F.col("text") != "").withColumn("lo", F.min("line").over(w)).withColumn("hi", F.max("line").over(w))
    edge = kept.filter((F.col("line") == F.col("lo")) | (F.col("line") == F.col("hi")))
    margin = F.regexp_replace(F.lower("text"), r"[0-9]+", "#")
    counted = edge.groupBy(key, margin.alias("margin")).agg(F.countDistinct("page").alias("pages"))
    total = lines.groupBy(key).agg(F.countDistinct("page").alias("all_pages"))
    return counted.join(total, key).filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("all_pages") * share))).select(key, "margin", "pages")


def questions(lines: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, n_questions): numbered lines that a lettered option follows within three lines, of documents that have least or more."""
    w = Window.partitionBy(key).orderBy("line")
    option = F.col("text").rlike(r"^\s*[a-zA-Z][.)]\s")
    following = F.lit(False)
    marked = lines.withColumn("option", option)
    for n in (1, 2, 3):
        following = following | F.coalesce(F.lead("option", n).over(w), F.lit(False))
    asked = marked.withColumn("asked", F.col("text").rlike(r"^\s*[0-9]{1,3}[.)]\s") & following)
    return asked.groupBy(key).agg(F.count_if("asked").alias("n_questions")).filter(F.col("n_questions") >= least)


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The value that carries most weight for each key, the least among equals: dominant sizes of text."""
    summed = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    return summed.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("neg"), F.col(value).alias("v"))).alias("best")).select(*keys, F.col("best.v").alias(value), (-F.col("best.neg")).alias("weight"))


#: A page whose body has fewer letters and digits than this is a step of the page that follows it under the same title.
BARE_BODY = 20


def without_overlays(pages: DataFrame, doc: str) -> DataFrame:
    """Pages (doc, page, title, lines, letters) without overlay steps and without verbatim repeats of a page that stays.

    A step is a page whose next page has the same title, which is not null or empty, and holds all its lines, or has a body of BARE_BODY
    letters and digits or more where its own has fewer. lines are hashes of the lines in order, so that no text is shuffled.
    """
    w = Window.partitionBy(doc).orderBy("page")
    nxt = lambda c: F.lead(c).over(w)
    grows = F.size(F.array_except("lines", nxt("lines"))) == 0
    built = (nxt("page") == F.col("page") + 1) & (F.col("title") != "") & (nxt("title") == F.col("title")) & (grows | ((F.col("letters") < BARE_BODY) & (nxt("letters") >= BARE_BODY)))
    kept = pages.withColumn("built", F.coalesce(built, F.lit(False))).filter(~F.col("built")).drop("built")
    again = F.row_number().over(Window.partitionBy(doc, F.xxhash64("lines"), F.xxhash64(F.lit(1), "lines")).orderBy("page"))
    return kept.withColumn("again", again).filter("again = 1").drop("again")


def sheet_rows(rows: DataFrame, sheet: str, number: str, cells: str) -> DataFrame:
    """(sheet, number, text) of rows with a letter in a cell: non-blank cells joined; see also numeric_rows."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    return rows.filter(F.exists(filled, lambda c: c.rlike(r"\p{L}"))).select(sheet, number, F.array_join(filled, " | ").alias("text"))


def numeric_rows(rows: DataFrame, sheet: str, cells: str) -> DataFrame:
    """(sheet, numeric_rows): rows that hold something, but no letter."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    return rows.groupBy(sheet).agg(F.count_if((F.size(filled) > 0) & ~F.exists(filled, lambda c: c.rlike(r"\p{L}"))).alias("numeric_rows"))


def markdown_segments(lines: DataFrame, key: str) -> DataFrame:
    """(key, segment, path, text, lines) of Markdown lines: a segment for each heading, and one before the first.

    A single heading of level 1 that comes first is the document's title and opens no path. Horizontal rules are dropped, three line feeds
    or more become two; lines holds the numbers of the lines that are not blank, the heading's own included.
    """
    found = headings(lines, key)
    title = found.groupBy(key).agg(F.count_if(F.col("level") == 1).alias("ones"), F.min(F.struct("line", "level", "heading")).alias("first"))
    titled = title.filter("ones = 1 and first.level = 1").select(key, F.col("first.line").alias("title_line"), F.col("first.heading").alias("title"))
    marked = lines.join(found.select(key, "line", "heading", "path"), [key, "line"], "left").join(titled, key, "left")
    opens = F.col("heading").isNotNull() & ~F.col("line").eqNullSafe(F.col("title_line"))
    w = Window.partitionBy(key).orderBy("line")
    marked = marked.withColumn("segment", F.sum(opens.cast("int")).over(w)).withColumn("opens", opens)
    rule = F.rlike("text", F.lit(r"^\s*(-\s*){3,}$|^\s*(\*\s*){3,}$|^\s*(_\s*){3,}$"))
    kept = marked.filter(~rule)
    shown = F.when(F.col("heading").isNull(), F.struct("line", "text"))
    grouped = kept.groupBy(key, "segment").agg(
        F.max(F.when(F.col("opens"), F.col("path"))).alias("path"),
        F.max("title").alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["text"]), "\n").alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("text") != "", F.col("line")))).alias("lines"),
    )
    body = F.regexp_replace(F.regexp_replace("text", r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    above = F.concat(F.col("title"), F.lit(" > "))
    path = F.when(F.startswith("path", above), F.expr("substring(path, length(title) + 4)")).otherwise(F.col("path"))
    return grouped.select(key, "segment", path.alias("path"), body.alias("text"), "lines").filter((F.col("text") != "") | F.col("path").isNotNull())
