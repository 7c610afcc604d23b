"""Continuous ingestion: new document files become chunks, postings, vectors and registry rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dossierlake.functions import vectors as vx
from dossierlake.sources import corpus as cp


def document_stream(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """A stored table as a stream, whether it is one file or a folder of files.

    A stream takes a file only as a match of a pattern; a folder that matches is read with what is in it.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def start_ingest(docs: DataFrame, folder: str, checkpoint: str, model=vx.hashed_vectors, time: str | None = None, late: str = "7 days") -> StreamingQuery:
    """Adds streamed docs(doc_id, text, source, ...) to the corpus in `folder`: each micro-batch is one step of all its tables.

    A document that is sent again is dropped: within `late` behind the latest one by the timestamp column `time`, or for as
    long as the stream's state lives without one. A micro-batch that is replayed after a failure finds its step
    committed, or writes it anew.
    """
    named = docs.withColumnRenamed("source", "corpus_key")
    fresh = named.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id"]) if time else named.dropDuplicates(["doc_id"])

    def save(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            cp.add(batch.sparkSession, folder, kept, f"batch{batch_id}", model)
        finally:
            kept.unpersist()

    return fresh.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
