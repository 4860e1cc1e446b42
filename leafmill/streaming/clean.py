"""Cleaning of a stream of documents.

The cleaner keeps a document in one row and needs no window or state, so the batch plan is the streaming plan; a query's
checkpoint makes its sink exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions.lines import CleanOptions
from leafmill.operators.clean import clean_text


def read_documents(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Documents (doc_id, text) from Parquet files as they arrive."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def clean_stream(docs: DataFrame, target: str, checkpoint: str, options: CleanOptions = CleanOptions(), once: bool = False) -> StreamingQuery:
    """Write cleaned documents as Parquet; once: what is there now, then stop."""
    writer = clean_text(docs, options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
