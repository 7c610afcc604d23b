"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dossierlake.session import scratch_folder


# Rows that a file should hold at least, where their number is known.
FILE_ROWS = 4096


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """`df` written as Parquet under `spark.checkpoint.dir` and read back.

    Cuts the lineage, survives the loss of executors, and fixes what would differ on a second evaluation. A table that is made
    of about `rows` rows is written by no more tasks than have `FILE_ROWS` of them each; large ones keep their partitions.
    """
    path = scratch_folder(df.sparkSession, label)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
