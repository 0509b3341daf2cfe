"""Stored documents, chunks and conversations as versioned Parquet snapshots: staged, checked, then made current by one small write.

One writer at a time; a reader opens the snapshot that the pointer names, so it never sees a half-written one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.functions.text import conversation_title
from groundline.operators import library, retrieval


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _versions(self) -> list[tuple[str, dict[str, str]]]:
        """The snapshots in order, each with the version of every table."""
        path = self._path("_pointer")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return sorted((number, json.loads(names)) for number, names in (r[0].split("\t") for r in self.spark.read.text(path.toString()).collect()))  # a line for each snapshot

    def read(self, table: str) -> DataFrame | None:
        known = self._versions()
        return self.spark.read.parquet(f"{self.folder}/{table}/{known[-1][1][table]}") if known and table in known[-1][1] else None

    def write(self, tables: dict[str, tuple[DataFrame, str | None]]) -> None:
        """Write the tables (rows, partition column) in full, then name them all current in one record, so that no reader sees half an import."""
        known = self._versions()
        current = dict(known[-1][1]) if known else {}
        for table, (rows, partition) in tables.items():
            current[table] = uuid.uuid4().hex
            writer = rows.write.partitionBy(partition) if partition else rows.write
            writer.parquet(f"{self.folder}/{table}/{current[table]}")
        self.spark.createDataFrame([(f"{len(known):012d}\t{json.dumps(current)}",)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/_pointer")


def import_documents(store: Store, documents: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Bring documents and their chunks into the store; returns (id, outcome): unchanged, imported, re-embedded or refused.

    Superseded versions of a file go with their chunks. A document whose provider changed keeps its chunks if the new ones fit them in number,
    ids and places, and only its vectors are swapped; otherwise it is refused and stays as it is. All checks come before any write.
    """
    bad = chunks.filter(~retrieval.usable(F.col("embedding"), width)).select(F.col("document_id").alias("id")).distinct()
    stored, held = store.read("documents"), store.read("chunks")
    if stored is None:
        stored, held = documents.limit(0), chunks.limit(0)
    known = stored.select("id", F.col("embedding_provider").alias("stored_provider"), F.lit(True).alias("known"))
    touched = held.join(chunks.select("document_id").distinct(), "document_id", "left_semi")  # of the store only what comes in again
    fits = library.reembedding(touched, chunks).withColumnRenamed("document_id", "id")
    judged = documents.join(known, "id", "left").join(fits, "id", "left").join(bad.withColumn("bad", F.lit(True)), "id", "left")
    outcome = (
        F.when(F.col("bad").isNotNull(), "refused")
        .when(F.col("known").isNull(), "imported")
        .when(F.col("stored_provider").eqNullSafe(F.col("embedding_provider")), "unchanged")
        .when(F.col("fits"), "re-embedded")
        .otherwise("refused")
    )
    report = judged.select("id", outcome.alias("outcome")).cache()
    fresh = documents.join(report.filter(F.col("outcome").isin("imported", "re-embedded")), "id", "left_semi")
    kept = stored.join(fresh.select("id"), "id", "left_anti").join(fresh.select("course_id", "source_filename").distinct(), ["course_id", "source_filename"], "left_anti")
    all_documents = kept.select(*documents.columns).unionByName(fresh)
    new_chunks = chunks.join(fresh.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    old_chunks = held.join(kept.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    if not fresh.isEmpty():
        store.write({"chunks": (old_chunks.select(*chunks.columns).unionByName(new_chunks), "course_id"), "documents": (all_documents, None)})
    return report


def start_or_continue(conversations: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked_id, id, is_new, title, scope) for each request (asked_id, question, scope): an unknown id opens a conversation with an id of its own."""
    known = conversations.select(F.col("id").alias("asked_id"), F.lit(True).alias("known"), F.col("title").alias("old_title"))
    rows = asked.join(known, "asked_id", "left")
    return rows.select("asked_id", F.when(F.col("known"), F.col("asked_id")).otherwise(F.uuid()).alias("id"), F.col("known").isNull().alias("is_new"), F.when(F.col("known"), F.col("old_title")).otherwise(conversation_title(F.col("question"))).alias("title"), "scope")


def renamed(conversations: DataFrame, names: DataFrame) -> DataFrame:
    """Conversations with new titles (id, title) where these are not blank; an id that does not exist changes nothing."""
    new = names.select("id", conversation_title(F.col("title")).alias("new_title")).filter("new_title <> ''")
    return conversations.join(new, "id", "left").withColumn("title", F.coalesce("new_title", "title")).select(*conversations.columns)


def removed(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations of ids and their messages."""
    return conversations.join(ids.select("id"), "id", "left_anti"), messages.join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")


def listed(conversations: DataFrame, n: int = 100) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "id").limit(n)


def citation_views(claims: DataFrame, citations: DataFrame, key: str) -> DataFrame:
    """Numbers cited by each claim with their citation; a number without one stays, without its fields."""
    return claims.join(citations, [key, "number"], "left")


def first_highlight_page(highlights: DataFrame, key: str) -> DataFrame:
    """(key, page): where a citation opens: the first page that is highlighted."""
    return highlights.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("page"))).filter("n = 1").select(key, "page")
