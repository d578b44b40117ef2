"""Streams of vectors into a versioned table: each micro-batch is one commit.

A batch that comes again after a failure finds its ids there already and adds nothing: ingestion is idempotent by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.table import VectorTable


def ingest(stream: DataFrame, root: str, checkpoint: str, branch: str = "main", trigger: dict | None = None):
    """Starts a query that appends (id, embedding[, metadata]) rows; ids that are there, or come again, are skipped."""
    spark = stream.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        table = VectorTable.load(spark, root, branch)
        kind = "string" if batch.schema["id"].dataType.simpleString() == "string" else "long"
        own = batch.where("id IS NOT NULL AND embedding IS NOT NULL").dropDuplicates(["id"])
        there = table.entries().where(F.col("id_type") == kind).select(F.col("id").alias("__id"))
        new = own.join(there, own["id"].cast("string") == there["__id"], "left_anti")
        table.insert_batch(new).sync(f"batch {number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
