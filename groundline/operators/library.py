"""The library: listings, identity, checks, and the maintenance of stored documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import URL_NAMESPACE, document_kind, title_from_filename, uuid5

PARSER_VERSION = 5


def once(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered twice count once."""
    return rows.dropDuplicates([key])


def courses(documents: DataFrame) -> DataFrame:
    """(subject, course_id, documents, pages) of every course."""
    return documents.groupBy("subject", "course_id").agg(F.count("id").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


def subjects(documents: DataFrame) -> DataFrame:
    """(subject, courses, first_seen) of every subject; shown in order of first_seen."""
    return documents.groupBy("subject").agg(F.countDistinct("course_id").alias("courses"), F.min("created_at").alias("first_seen"))


def one(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    """The row of an id, or none; the filter reaches the scan."""
    return rows.filter(F.col(key) == value).limit(1)


def listing(documents: DataFrame, course_id: str | None = None) -> DataFrame:
    """Documents with the title shown (the file's name where there is none) and the kind of viewer."""
    rows = documents if course_id is None else documents.filter(F.col("course_id") == course_id)
    return rows.select("id", "subject", "course_id", F.coalesce("title", title_from_filename(F.col("source_filename"))).alias("shown_title"), document_kind(F.col("source_filename")).alias("kind"), "page_count")


def document_id(subject: Column, course: Column, source: Column, checksum: Column) -> Column:
    name = F.concat(F.lit("subject="), subject, F.lit("\ncourse="), course, F.lit("\nsource="), source, F.lit("\nsha256="), checksum, F.lit(f"\nparser={PARSER_VERSION}"))
    return uuid5(URL_NAMESPACE, name)


def chunk_id(document: Column, position: Column, page: Column, text: Column) -> Column:
    name = F.concat(F.lit("document="), document, F.lit("\nposition="), position.cast("string"), F.lit("\npage="), page.cast("string"), F.lit("\ntext="), F.sha2(text, 256))
    return uuid5(URL_NAMESPACE, name)


def unchanged(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The incoming (id, embedding_provider) rows that need work: without those stored alike. A null provider equals a null one."""
    same = (F.col("i.id") == F.col("s.id")) & F.col("i.embedding_provider").eqNullSafe(F.col("s.embedding_provider"))
    return incoming.alias("i").join(stored.alias("s"), same, "left_anti")


def current_versions(documents: DataFrame) -> DataFrame:
    """The newest version of each (course_id, source_filename), ties by id; the older ones are superseded."""
    newest = documents.groupBy("course_id", "source_filename").agg(F.max(F.struct("created_at", "id")).alias("_"))
    return documents.join(newest.select("course_id", "source_filename", F.col("_.id").alias("id")), ["course_id", "source_filename", "id"], "left_semi")


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Children that a cascading delete removes: those without a parent."""
    return children.join(parents.select(*on).distinct(), on, "left_anti")


def reembedding(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(document_id, fits): whether the fresh chunks (document_id, chunk_position, id) match the stored ones in number, ids and places."""
    s, f = (x.select("document_id", "chunk_position", F.col("id").alias(n)) for x, n in ((stored, "old"), (fresh, "new")))
    both = s.join(f, ["document_id", "chunk_position"], "full_outer")
    return both.groupBy("document_id").agg(F.bool_and(F.col("old").eqNullSafe(F.col("new"))).alias("fits"))


def provider_mismatches(documents: DataFrame, provider: str) -> DataFrame:
    """One row: documents whose vectors are of another provider, or of none that is known."""
    return documents.agg(F.count_if(~F.col("embedding_provider").eqNullSafe(F.lit(provider))).alias("mismatches"), F.count("*").alias("documents"))


def violations(documents: DataFrame) -> DataFrame:
    """One row with the number of rows against each rule of the documents table."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return documents.agg(
        F.count_if(blank("subject")).alias("blank_subject"),
        F.count_if(blank("course_id")).alias("blank_course"),
        F.count_if(blank("source_filename")).alias("blank_filename"),
        F.count_if(~F.coalesce(F.col("checksum").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))).alias("bad_checksum"),
        F.count_if(~F.coalesce(F.col("page_count") > 0, F.lit(False))).alias("bad_pages"),
        F.count_if(F.char_length("subject") > 200).alias("long_subject"),
        F.count_if(F.trim("embedding_provider") == "").alias("blank_provider"),
    )


def first_chunks(chunks: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_position", "id"))
    return chunks.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")
