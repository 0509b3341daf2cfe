"""Pages from laid-out lines: body size, margins, titles, sections and items, over (doc_id, page, idx, text, size, top, bottom, block, highlighted).

The lines come from a decoder outside (``sources.files.LAYOUT_LINES`` is its contract); all that follows are windows, groups and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import nfc, squeeze

# Ligatures and what they stand for; shares of the page and of the body size that the rules compare with.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
MARGIN, HEADING, SAME_SIZE, TITLE_AREA, SMALL_SPAN, SHIFT = 0.12, 1.2, 0.5, 0.35, 0.85, 0.1
PAGE_NUMBER = r"^(page\s*)?\d{1,4}(\s*(/|sur|of)\s*\d{1,4})?$"
# Bullets (dashes need a space after them), beginnings of questions and of their options, and the marks of highlighted lines.
BULLET = r"^(?:[•‣⁃∙▪▫■□●○◦▶▷▸►◆♦➢➤➔✓✔☐\uf0a7\uf0a8\uf0b7\uf0d8\uf076\uf06c\uf0fc·]\s*|[*–—>-]\s+)"
QUESTION = r"^\d{1,3}\s*[.)]\s+\S"
OPTION = r"^[A-Ha-h]\s*[.)]\s+\S"
MARKED_OPTION, MARKED = " ✔ (réponse surlignée)", " [surligné]"
PAGE = ["doc_id", "page"]


def clean(text: Column) -> Column:
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return squeeze(F.replace(nfc(text), F.lit("\x00"), F.lit("")))


def span_text(spans: Column, size: Column, baseline: Column) -> Column:
    """The text of a line's spans {text, size, origin_y, flags}: small ones set high or low are marked as ^x and _x, glued to their base."""

    def add(held: Column, span: Column) -> Column:
        small = span["size"] < SMALL_SPAN * size
        raised = (span["flags"].bitwiseAND(F.lit(1)) == 1) | (small & (span["origin_y"] < baseline - SHIFT * size))
        lowered = ~raised & small & (span["origin_y"] > baseline + SHIFT * size)
        mark = F.when(raised, "^").when(lowered, "_")
        blank = F.trim(span["text"]) == ""
        marked = F.concat(F.rtrim(held), mark, F.ltrim(span["text"]))
        return F.when(mark.isNotNull() & ~blank, marked).otherwise(F.concat(held, span["text"]))

    return F.aggregate(spans, F.lit(""), add)


def image_share(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, image_share): the part of each page that the clipped rectangles (x0, y0, x1, y1) cover, overlaps counted twice, 1 at most."""
    clipped = images.join(pages, PAGE).withColumn("w", F.greatest(F.least("x1", "width") - F.greatest("x0", F.lit(0.0)), F.lit(0.0))).withColumn("h", F.greatest(F.least("y1", "height") - F.greatest("y0", F.lit(0.0)), F.lit(0.0)))
    area = clipped.groupBy(*PAGE).agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    return pages.join(area, PAGE, "left").select(*PAGE, F.least(F.lit(1.0), F.coalesce(F.col("area"), F.lit(0.0)) / (F.col("width") * F.col("height"))).alias("image_share"))


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the size of most characters, without the topmost line of each page unless nothing else is there."""
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "idx")) == 1
    sized = lines.withColumn("first", first).groupBy("doc_id", "size").agg(F.sum(F.char_length("text")).alias("all"), F.sum(F.when(~F.col("first"), F.char_length("text")).otherwise(0)).alias("inner"))
    best = lambda weight: F.max(F.struct(F.col(weight).alias("w"), (-F.col("size")).alias("s")))
    chosen = sized.groupBy("doc_id").agg(best("inner").alias("i"), best("all").alias("a"))
    return chosen.select("doc_id", (-F.when(F.col("i.w") > 0, F.col("i.s")).otherwise(F.col("a.s"))).alias("body"))


def without_boilerplate(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines without running heads, feet and page numbers, numbered anew; pages has (doc_id, page, height)."""
    total = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    rows = lines.join(body_size(lines), "doc_id").join(pages.select(*PAGE, "height"), PAGE).join(total, "doc_id")
    low = F.lower("text")
    margin = (F.col("top") >= F.col("height") * (1 - MARGIN)) | (F.col("bottom") <= F.col("height") * MARGIN)
    rows = rows.withColumn("margin_key", F.when(F.col("size") < F.col("body"), F.regexp_replace(low, r"\d+", "#")).otherwise(low)).withColumn("in_margin", margin & (F.col("size") <= F.col("body")))
    frequent = rows.filter("in_margin").groupBy("doc_id", "margin_key", "n_pages").agg(F.countDistinct("page").alias("on")).filter(F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * 0.5)))
    kept = rows.join(frequent.select("doc_id", "margin_key", F.lit(True).alias("frequent")), ["doc_id", "margin_key"], "left")
    kept = kept.filter(~(F.col("in_margin") & (F.coalesce("frequent", F.lit(False)) | low.rlike(PAGE_NUMBER))))
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy(*PAGE).orderBy("idx")) - 1).select(*lines.columns)


def slide_titles(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Lines with is_title: the first block of the largest size of a slide, if that is clearly above the body size."""
    w = Window.partitionBy(*PAGE)
    rows = lines.join(body, "doc_id").withColumn("largest", F.max(F.when(F.col("size") >= HEADING * F.col("body"), F.col("size"))).over(w))
    rows = rows.withColumn("large", F.coalesce(F.col("size") >= F.col("largest") - SAME_SIZE, F.lit(False)))
    block = F.first(F.when(F.col("large"), F.col("block")), ignorenulls=True).over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("is_title", F.coalesce(F.col("large") & (F.col("block") == block), F.lit(False))).select(*lines.columns, "is_title")


def sections(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Lines of upright pages with section (from 0, before any heading) and is_heading; the lines of a wrapped heading share a section."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    rows = lines.join(body, "doc_id").withColumn("is_heading", F.col("size") >= HEADING * F.col("body"))
    wrapped = F.col("is_heading") & F.lag("is_heading", default=False).over(w) & (F.col("block") == F.lag("block").over(w)) & (F.abs(F.col("size") - F.lag("size").over(w)) <= SAME_SIZE)
    opens = F.col("is_heading") & ~F.coalesce(wrapped, F.lit(False))
    return rows.withColumn("opens", opens.cast("int")).withColumn("section", F.sum("opens").over(w)).select(*lines.columns, "is_heading", "section")


def page_is_titled(sectioned: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, titled): whether the first group of a page has a heading that begins in its upper third."""
    first = sectioned.filter("is_heading").groupBy(*PAGE).agg(F.min("top").alias("heading_top"), F.min("section").alias("s"))
    lead = sectioned.groupBy(*PAGE).agg(F.min("section").alias("least"))
    return pages.join(first, PAGE, "left").join(lead, PAGE, "left").select(*PAGE, F.coalesce((F.col("least") > 0) & (F.col("heading_top") <= TITLE_AREA * F.col("height")), F.lit(False)).alias("titled"))


def highlighted(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Lines with highlighted: an annotation rectangle of the page covers half of the line's height and a third of its width or so."""
    on_page = notes.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("notes"))
    x0, y0, x1, y1 = (F.col("box")[i] for i in range(4))
    covers = lambda n: (F.least(n["y1"], y1) - F.greatest(n["y0"], y0) >= 0.5 * (y1 - y0)) & (F.least(n["x1"], x1) - F.greatest(n["x0"], x0) >= 0.3 * (x1 - x0))
    return lines.drop("highlighted").join(on_page, PAGE, "left").withColumn("highlighted", F.coalesce(F.exists("notes", covers), F.lit(False))).drop("notes")


def items(sectioned: DataFrame) -> DataFrame:
    """(doc_id, page, section, heading, items) of every group: wrapped lines joined to items, bullets in one form, hyphens undone, marks set.

    Flags are set by windows over the lines of a group, which is a part of one page: a line opens an item if it has a bullet, asks or offers
    something, stands in another block, or follows the end of a sentence or a highlighted line; all lines of a heading are one. A line that
    is a bullet alone takes the next line to it.
    """
    group = (*PAGE, "section", "is_heading")
    w = Window.partitionBy(*group).orderBy("idx")
    text = F.col("text")
    bare = F.ltrim(F.regexp_replace(text, BULLET, ""))
    option = text.rlike(OPTION)
    mark = F.when(F.col("highlighted"), F.when(option, MARKED_OPTION).otherwise(MARKED)).otherwise("")
    rows = sectioned.withColumn("bullet", ~F.col("is_heading") & text.rlike(BULLET))
    rows = rows.withColumn("said", F.when(F.col("is_heading"), text).otherwise(F.concat(F.when(F.col("bullet"), F.rtrim(F.concat(F.lit("- "), bare))).otherwise(text), mark)))
    rows = rows.withColumn("dash", ~F.col("is_heading") & (F.col("said") == "-"))
    rows = rows.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*group, "dash").orderBy("idx")))
    earlier = lambda c: F.lag(c).over(w)
    ended = earlier("said").rlike(r"[.!?:;]\s*$") | earlier("highlighted")
    able = earlier("idx").isNull() | (~F.col("is_heading") & ((F.col("block") != earlier("block")) | F.col("bullet") | text.rlike(QUESTION) | option | ended))
    rows = rows.withColumn("able", able)
    # of dashes in a row every other one waits for what follows
    rows = rows.withColumn("waits", F.col("dash") & F.col("able") & (F.row_number().over(Window.partitionBy(*group, "dash", "run").orderBy("idx")) % 2 == 1))
    opens = F.col("able") & ~F.coalesce(earlier("waits"), F.lit(False))
    rows = rows.withColumn("opens", opens).withColumn("mends", ~opens & earlier("said").rlike(r"\p{L}-$") & F.col("said").rlike(r"^\p{Ll}"))
    held = F.when(F.coalesce(F.lead("mends").over(w), F.lit(False)), F.expr("substring(said, 1, char_length(said) - 1)")).otherwise(F.col("said"))
    rows = rows.withColumn("item", F.sum(F.col("opens").cast("int")).over(w)).withColumn("piece", F.concat(F.when(F.col("opens") | F.col("mends"), "").otherwise(" "), held))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "piece"))), lambda x: x["piece"]), "")
    one = rows.groupBy(*group, "item").agg(joined.alias("t"))
    kept = F.when(~F.col("is_heading") & (F.regexp_replace("t", "[ -]", "") != ""), F.struct("item", "t"))
    return one.groupBy(*PAGE, "section").agg(
        F.nullif(squeeze(F.max(F.when(F.col("is_heading"), F.col("t")))), F.lit("")).alias("heading"),
        F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["t"]).alias("items"),
    )


def page_texts(groups: DataFrame, titled: DataFrame) -> DataFrame:
    """(doc_id, page, title, body, text, lines, letters) of the groups of ``items`` and ``page_is_titled``; lines and letters are what
    ``structure.without_overlays`` reads. The title is the heading of the first group of a titled page, and no part of the body."""
    part = F.concat(F.array_compact(F.array("heading")), "items")
    pages = groups.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("section", "heading", part.alias("parts")))).alias("g")).join(titled, PAGE, "left")
    flat = F.flatten(F.col("g.parts"))
    title = F.when(F.col("titled"), F.get("g", F.lit(0))["heading"])
    body = F.when(F.col("titled") & title.isNotNull(), F.slice(flat, F.lit(2), F.size(flat))).otherwise(flat)
    lines = F.filter(F.split(F.array_join(flat, "\n"), "\n"), lambda x: x != "")
    rows = pages.select(*PAGE, title.alias("title"), F.array_join(body, "\n").alias("body"), F.array_join(flat, "\n").alias("text"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"))
    return rows.withColumn("letters", F.char_length(F.regexp_replace("body", r"[^\p{L}\p{N}]", "")))


def document_titles(kept: DataFrame) -> DataFrame:
    """(doc_id, title): the title of page 1, if that page is still there."""
    return kept.groupBy("doc_id").agg(F.max(F.when(F.col("page") == 1, F.col("title"))).alias("title"))


def question_segments(groups: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, page, segment, heading, text): a segment for each group, or, on a page with least questions or more, for each question.

    A question is a numbered line that a lettered option follows within three lines; from the first one on, the questions take the place
    of the groups.
    """
    w = Window.partitionBy(*PAGE).orderBy("section", "at")
    lines = groups.select(*PAGE, "section", "heading", F.posexplode("items").alias("at", "line"))
    follows = F.lit(False)
    for n in (1, 2, 3):
        follows = follows | F.coalesce(F.lead(F.col("line").rlike(OPTION), n).over(w), F.lit(False))
    marked = lines.withColumn("asks", (F.col("line").rlike(QUESTION) & follows).cast("int"))
    marked = marked.withColumn("n", F.row_number().over(w)).withColumn("number", F.sum("asks").over(w)).withColumn("all", F.sum("asks").over(Window.partitionBy(*PAGE)))
    asked = (F.col("all") >= least) & (F.col("number") > 0)
    placed = marked.withColumn("question", F.when(asked, F.col("number")).otherwise(0)).withColumn("section", F.when(asked, F.lit(None)).otherwise(F.col("section")))
    label = F.concat(F.lit("Question "), F.regexp_extract(F.min(F.when(F.col("asks") == 1, F.struct("n", "line")))["line"], r"^(\d+)", 1))
    first = F.min(F.struct("heading"))["heading"]
    texts = placed.groupBy(*PAGE, "question", "section").agg(F.when(F.col("question") > 0, label).otherwise(first).alias("heading"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    owner = marked.filter((F.col("all") >= least) & (F.col("number") > 0)).groupBy(*PAGE).agg(F.min("section").alias("owner"))
    bare = groups.join(texts.filter("question = 0").select(*PAGE, "section"), [*PAGE, "section"], "left_anti").join(owner, PAGE, "left").filter("heading is not null and (owner is null or section <= owner)")
    rows = texts.unionByName(bare.select(*PAGE, F.lit(0).cast("long").alias("question"), "section", "heading", F.lit("").alias("text")))
    order = Window.partitionBy(*PAGE).orderBy("question", "section")
    return rows.select(*PAGE, (F.row_number().over(order) - 1).alias("segment"), "heading", "text")


def empty_pages(pages: DataFrame, lines: DataFrame) -> DataFrame:
    return pages.select(*PAGE).join(lines.select(*PAGE).distinct(), PAGE, "left_anti")
