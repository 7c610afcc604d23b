"""Vectors by content: a text that was embedded once is not sent to the model again, whatever chunk or document it comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierlake.functions import vectors as vx

STORED = "text_key binary, text string, embedding array<float>"


def keyed(rows: DataFrame) -> DataFrame:
    """Adds `text_key`, the SHA-256 of rows(text). It finds texts; they are compared themselves."""
    return rows.withColumn("text_key", F.unhex(F.sha2("text", 256)))


def unseen(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(text_key, text): the distinct texts of rows(text) that the store does not have. Null texts are none.

    The texts are grouped before they meet the store, so a text that a third of all rows have is one row.
    """
    texts = keyed(rows.select("text").filter("text IS NOT NULL")).groupBy("text_key", "text").agg(F.lit(1).alias("_one")).drop("_one")
    return texts if stored is None else texts.join(stored.select("text_key", "text"), ["text_key", "text"], "left_anti")


def embed_unseen(rows: DataFrame, stored: DataFrame | None, model=vx.hashed_vectors) -> DataFrame:
    """(text_key, text, embedding) of the texts that are new to the store; write it before reading it twice."""
    return unseen(rows, stored).withColumn("embedding", vx.embed(F.col("text"), model))


def with_vectors(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows(text, ...) with their `embedding` from a store that has all of their texts; null texts have none."""
    return keyed(rows).join(stored.select("text_key", F.col("text").alias("_text"), "embedding"), "text_key", "left").filter(
        F.col("text").isNull() | (F.col("text") == F.col("_text"))).drop("text_key", "_text")
