"""Session defaults, size-checked broadcasts and the shared scratch folder."""

from __future__ import annotations

import contextlib
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A side is broadcast only when it was counted and holds no more rows than this.
BROADCAST_MAX_ROWS = 200_000
# Spark's own setting for files of exchanges that no later action reads.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "dossierlake", **conf) -> SparkSession:
    """Session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app_name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Whether `df` holds at most `max_rows` rows. The count stops there, so a huge side costs no full pass."""
    with exchanges_freed(df.sparkSession):
        return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast when `df` is counted to be small; leave the join to AQE otherwise."""
    return broadcast_if(is_small(df, max_rows), df)


@contextlib.contextmanager
def exchanges_freed(spark: SparkSession) -> Iterator[None]:
    """An action in here takes the files of its exchanges away when it ends. Else they stay until the driver collects its garbage,
    so a plan of many actions keeps the exchanges of all of them on disk."""
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the scratch folder: like `materialise`, but compressed, and without the exchanges behind it."""
    path = scratch_folder(df.sparkSession, label)
    with exchanges_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_wanted(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def block_length(rows: int, queries: int, weight: float, most: int, tasks: int) -> int:
    """Rows of a block when every query meets every row, at most `most`.

    Each block gets a copy of the queries, and where there are fewer blocks than tasks, the queries are cut in pieces and each
    piece gets a copy of the rows. A row counts `weight` times a query; the blocks are chosen so that least is copied.
    """
    blocks = min(max(math.sqrt(tasks * max(rows, 1) * weight / max(queries, 1)), 1), tasks)
    return max(1, min(most, math.ceil(rows / blocks)))


def deal(df: DataFrame, parts: int, place: Column) -> DataFrame:
    """Rows of one `place` in one of `parts` partitions, places that follow each other in partitions that do."""
    return df.withColumn("_at", F.pmod(place, F.lit(parts)).cast("int")).repartitionById(parts, "_at").drop("_at")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    A local session may leave `spark.checkpoint.dir` unset and gets one; on a cluster it must be set.
    """
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = spark.conf.get("dossierlake.local.checkpoint.dir", None)
    if not root:
        root = os.path.join(tempfile.mkdtemp(prefix="dossierlake-"), "checkpoints")
        spark.conf.set("dossierlake.local.checkpoint.dir", root)
    return root


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input that arrives in fewer partitions than there are cores.

    Large inputs already have more partitions than cores and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
