"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import vectors as vx
from dossierlake.operators import chunking as ck

# File extension by fenced-block language.
EXTENSIONS = {"python": ".py", "bash": ".sh", "shell": ".sh", "sql": ".sql", "json": ".json", "yaml": ".yaml", "yml": ".yaml"}
OTHER_EXTENSION = ".txt"


def write_chunk_tables(chunks: DataFrame, root: str, buckets: int = 16, files: int = 4, model=vx.hashed_vectors) -> None:
    """All chunks for keyword search, searchable ones with their vectors for vector search.

    Folders are buckets of the corpus key. Rows go to (bucket, salt) so that a corpus with
    most of the rows is written by several tasks and every folder gets few files.
    """
    bucket = F.pmod(F.xxhash64("corpus_key"), F.lit(buckets)).cast("int")
    salt = F.pmod(F.xxhash64("doc_id", "chunk_index"), F.lit(files))
    laid = chunks.withColumn("bucket", bucket).repartition("bucket", salt)
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/keyword")
    stored = chunks.sparkSession.read.parquet(f"{root}/keyword")
    with_vectors = ck.searchable(stored).withColumn("embedding", vx.embed(F.col("text"), model))
    with_vectors.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/vectors")


def append_registry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def result_json(rows: DataFrame, fields: list[str], out: str = "result") -> DataFrame:
    """One JSON object per document from its result columns."""
    return rows.select("doc_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(out))


def audit_rows(calls: DataFrame, agent: str) -> DataFrame:
    """Who, when, lengths and duration of calls(ts, message, response, seconds); never contents."""
    return calls.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(agent).alias("agent"),
        F.round("seconds", 2).alias("duration_seconds"), F.length("message").alias("message_length"),
        F.length("response").alias("response_length"))


def append_audit(calls: DataFrame, agent: str, path: str) -> None:
    audit_rows(calls, agent).write.mode("append").json(path)


def extension(language: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(known[language], F.lit(OTHER_EXTENSION))


def export_code(blocks: DataFrame, path: str) -> None:
    """Code of blocks(language, code, ...) as text files, one folder per extension."""
    blocks.select(extension(F.col("language")).alias("ext"), F.col("code").alias("value")).write.mode(
        "overwrite").partitionBy("ext").option("lineSep", "\n").text(path)
