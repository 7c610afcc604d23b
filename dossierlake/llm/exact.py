"""Exact deduplication by Grace hashing: records are dealt to buckets by a hash of their content, buckets that do not
fit are dealt again by another hash, and each bucket is matched in an open-addressing table that compares whole contents.

Before anything moves, every task merges equal contents of its own input in such a table, so a text that makes up a
third of all rows reaches its bucket once per task and table. Bucket numbers are settled from byte counts alone; the
contents then move once, into the shuffle files of their final buckets, which take the place of the spill files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm import words as W
from dossierlake.llm.store import stored

# Content that one table may hold, before the exchange and in a bucket after it.
TABLE_BYTES = 32 << 20
BUCKET_BYTES = 64 << 20
# Buckets an oversized bucket is dealt into.
FAN_OUT = 16


class ContentTable:
    """Open addressing with linear probing: hash and whole content lead to an index, counted from 0."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def index(self, key: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = key & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == key and self.contents[found] == content:
                return found
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
            return len(self.hashes) - 1
        return self.slots[at]

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for number, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def _better(length: int, doc_id, best_length: int, best_id) -> bool:
    """Whether a row stays rather than the best so far: more code points, then the smaller id, null last."""
    if length != best_length:
        return length > best_length
    return doc_id is not None and (best_id is None or doc_id < best_id)


def _entries(docs: DataFrame, table_bytes: int) -> DataFrame:
    """One row per distinct content of a table: entry, key, content, size, the ids merged into it and the best of them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        table, ids, best = ContentTable(), [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, table, ids, best
            n = len(ids)
            out = pa.record_batch({
                "entry": pa.array(range(number, number + n), pa.int64()),
                "key": pa.array(np.array(table.hashes, np.uint64).view(np.int64)),
                "size": pa.array([len(x) for x in table.contents], pa.int64()),
                "content": pa.array(table.contents, pa.binary()),
                "sha": pa.array([hashlib.sha256(x).hexdigest() for x in table.contents]),
                "ids": pa.array(ids, pa.list_(id_type)), "best_at": pa.array([b[1] for b in best], pa.int32()),
                "best_length": pa.array([b[0] for b in best], pa.int64()), "best_id": pa.array([b[2] for b in best], id_type)})
            number += n
            table, ids, best = ContentTable(), [], []
            return out

        id_type, rows = None, 0
        for batch in W.pieces(batches):
            id_type = batch.column("doc_id").type
            data, offsets = W.utf8(batch.column("text"))
            keep = W.SPACED[data]
            bare = data[keep].tobytes()
            bounds = np.concatenate(([0], np.cumsum(keep)))[offsets].tolist()
            lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            for doc_id, length, a, b in zip(batch.column("doc_id").to_pylist(), lengths, bounds, bounds[1:]):
                content = bare[a:b]
                i = table.index(xxhash.xxh3_64_intdigest(content), content)
                if i == len(ids):
                    ids.append([doc_id])
                    best.append((length, 0, doc_id))
                else:
                    if _better(length, doc_id, best[i][0], best[i][2]):
                        best[i] = (length, len(ids[i]), doc_id)
                    ids[i].append(doc_id)
                rows += 1
                if table.bytes > table_bytes or rows >= 200_000:
                    yield flush()
                    rows = 0
        if ids:
            yield flush()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(merge, (
        f"entry long, key long, size long, content binary, sha string, ids array<{kind}>, best_at int, best_length long, best_id {kind}"))


def _bucketed(entries: DataFrame, bucket_bytes: int) -> DataFrame:
    """entries with a bucket: oversized buckets are dealt again, level by level, unless a single key fills them."""
    shares = stored(entries.groupBy("key").agg(F.max("size").alias("size")), "keys")
    total = shares.agg(F.sum("size")).first()[0] or 0
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = max(4 * parts, -(-16 * total // bucket_bytes))
    shares = shares.withColumn("bucket", F.pmod("key", F.lit(first)))
    level = 0
    while True:
        level += 1
        large = (shares.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("keys"))
                 .filter((F.col("bytes") > bucket_bytes) & (F.col("keys") > 1)).select("bucket", F.lit(True).alias("large")))
        if large.isEmpty():
            return entries.join(shares.select("key", "bucket"), "key") if level > 1 else entries.withColumn("bucket", F.pmod("key", F.lit(first)))
        again = F.xxhash64("bucket", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(FAN_OUT)))
        shares = stored(shares.join(large, "bucket", "left")
                        .select("key", "size", F.when(F.col("large"), again).otherwise(F.col("bucket")).alias("bucket")), "keys")


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text).

    Texts are equal when identical without the characters space and \\x09-\\x0D; null counts as empty, so null, empty and
    blank texts are one group. The row with the most code points stays, then the one with the smallest doc_id (null
    last), then any one: exactly one row of a group is kept, also among repeated rows. Other columns are ignored.
    """
    entries = stored(_entries(docs, table_bytes), "entries")
    kind = dict(docs.dtypes)["doc_id"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, members, best, sizes, bucket = ContentTable(), [], [], [], None

        def done() -> pa.RecordBatch:
            flat = [(e, i) for i, own in enumerate(members) for e in own]
            return pa.record_batch({
                "entry": pa.array([e for e, _ in flat], pa.int64()), "keep_id": pa.array([best[i][1] for _, i in flat], id_type),
                "group_size": pa.array([sizes[i] for _, i in flat], pa.int64()),
                "here": pa.array([best[i][2] == e for e, i in flat], pa.bool_())})

        id_type = None
        for batch in batches:
            id_type = batch.column("best_id").type
            for now, entry, key, content, length, best_id, n in zip(*(batch.column(c).to_pylist() for c in (
                    "bucket", "entry", "key", "content", "best_length", "best_id", "n"))):
                if now != bucket:
                    if members:
                        yield done()
                    table, members, best, sizes, bucket = ContentTable(), [], [], [], now
                i = table.index(key % 2**64, content)
                if i == len(members):
                    members.append([])
                    best.append((length, best_id, entry))
                    sizes.append(0)
                elif _better(length, best_id, *best[i][:2]):
                    best[i] = (length, best_id, entry)
                members[i].append(entry)
                sizes[i] += n
        if members:
            yield done()

    moved = _bucketed(entries.select("entry", "key", "size", "content", "best_length", "best_id", F.size("ids").alias("n")), bucket_bytes)
    groups = (moved.select("bucket", "entry", "key", "content", "best_length", "best_id", "n")
              .repartition("bucket").sortWithinPartitions("bucket")
              .mapInArrow(match, f"entry long, keep_id {kind}, group_size long, here boolean"))
    return (entries.select("entry", "ids", "best_at", "sha").join(groups, "entry")
            .select("keep_id", "group_size", "here", "best_at", F.col("sha").alias("text_sha256"), F.posexplode("ids").alias("at", "doc_id"))
            .select("doc_id", "keep_id", "group_size", (F.col("here") & (F.col("at") == F.col("best_at"))).alias("kept"), "text_sha256"))
