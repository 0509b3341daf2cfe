"""Incremental import: new files become chunks, each file once, with the id of its content deciding whether there is work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from groundline.operators import imports

BINARY = "path string, modificationTime timestamp, length long, content binary"


def store(batch: DataFrame, target: str, number: int) -> None:
    """The chunks of a batch in a folder of its number, so that a repeated batch writes the same."""
    batch.write.mode("overwrite").parquet(f"{target}/batch={number}")


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, subject: str, course: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Import what is in the folder and has not been imported; run again for what has come since. then gets the report of every file."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        chunks, report = imports.prepare(batch, subject, course)
        store(chunks, target, number)
        if then:
            then(report)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
