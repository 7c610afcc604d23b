"""Conversation state that expires when idle, and running job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dossierlake.operators import conversations as cv

OUTPUT = "conv_id bigint, n_messages bigint, last_ts bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Activity(StatefulProcessor):
    """Counts the messages of each conversation; the state store forgets idle ones.

    Only two numbers are kept per conversation. Rows come in batches, so a very busy
    conversation is never held in memory.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint, last_ts bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get() if self.seen.exists() else (0, 0)
        for batch in rows:
            n += len(batch)
            last = max(last, int(batch["ts"].max()))
        self.seen.update((n, last))
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [n], "last_ts": [last]})

    def close(self) -> None:
        pass


def activity(turns: DataFrame, ttl_seconds: int = cv.TTL_SECONDS) -> DataFrame:
    """Streaming turns to an update row per touched conversation and batch.

    Needs the RocksDB state store. Runs that stop by themselves (availableNow) also need
    `spark.sql.streaming.noDataMicroBatches.enabled=false`.
    """
    return turns.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=Activity(ttl_seconds), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")


def start_activity(turns: DataFrame, out: str, checkpoint: str, ttl_seconds: int = cv.TTL_SECONDS) -> StreamingQuery:
    """Runs what is there and writes the updates as files, one folder per batch.

    A batch that is replayed after a failure replaces its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = activity(turns, ttl_seconds).writeStream.outputMode("update").foreachBatch(save)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_sessions(turns: DataFrame, out: str, checkpoint: str, idle: int = cv.TTL_SECONDS, late: str = "1 day") -> StreamingQuery:
    """Appends the sessions of streamed turns(conv_id, ts) once they are over: when the watermark, `late` behind the latest
    message, has passed their last message by `idle`. A message that comes in time joins or bridges sessions that are still
    open; one that comes later than that is left out by the watermark.
    """
    closed = cv.sessions(cv.timed(turns).withWatermark("at", late), idle)
    writer = closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(out)


def start_job_status(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the new status of every job that a batch touches, one folder per batch; `job_status` reads them.

    A batch that is replayed after a failure replaces its own folder, and no batch rewrites what others wrote.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = cv.latest_status(events).writeStream.outputMode("update").foreachBatch(save)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_status(spark: SparkSession, out: str) -> DataFrame:
    """The latest status of each job, from the batches that `start_job_status` wrote."""
    updates = spark.read.parquet(out)
    state = F.struct(*[c for c in updates.columns if c not in ("job_id", "batch")])
    return updates.groupBy("job_id").agg(F.max_by(state, "batch").alias("_s")).select("job_id", "_s.*")
