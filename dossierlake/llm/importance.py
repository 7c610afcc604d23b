"""Resampling towards a target distribution by importance weights of hashed word n-grams.

A document's features are its runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo a number of
buckets. The CRC of a longer run continues that of its beginning, so it follows from states of single words. A bounded
head vocabulary of frequent words (with their CRC states) and of frequent pairs (with their buckets) is broadcast; words
and pairs outside of it, and all longer runs, take their CRC directly. Both ways give the same value for the same feature,
so bucket totals are exact whatever the head holds: what is chosen for it decides on work alone.

Frequent words and pairs are found in one pass over all rows: each task keeps a summary of bounded size and drops its rarest
entries when it is full. Words are told apart by 64-bit hashes together with their CRC and length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.llm import words as W
from dossierlake.llm.store import stored
from dossierlake.operators.registry import number_rows

# Words of the head, words of it whose pairs are in a table, and pairs in that table at most: sizes of what is broadcast (1 MB and 2 MB).
HEAD_WORDS = 65_536
PAIR_WORDS = 1024
HEAD_PAIRS = 65_536
# Entries of a task's summary after it was cut; it is cut at four times that.
SUMMARY = 65_536
NO_HEAD = np.zeros(0, np.uint64)


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_TABLE = _crc_table()
_SHORT = 64


def _step(x: np.ndarray) -> np.ndarray:
    """The CRC register `x` after one byte of zero."""
    return _TABLE[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by its values for each byte: tables(..., 4, 256)."""
    b = np.uint32(255)
    return tables[0][x & b] ^ tables[1][(x >> np.uint32(8)) & b] ^ tables[2][(x >> np.uint32(16)) & b] ^ tables[3][x >> np.uint32(24)]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps for 0 to 63 bytes of zero, and for 64, 128, 256 ... 2**31 of them."""
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    short = [now]
    for _ in range(_SHORT):
        short.append(_step(short[-1]))
    powers = [short.pop()]
    while len(powers) < 26:
        powers.append(_applied(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


_NEAR, _FAR = _shift_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that text with these CRCs has in the CRC of a text that goes on for `n` bytes."""
    low = n & (_SHORT - 1)
    flat, at, b = _NEAR.reshape(-1), low * 1024, np.uint32(255)
    out = flat[at + (crc & b)] ^ flat[at + 256 + ((crc >> np.uint32(8)) & b)] ^ flat[at + 512 + ((crc >> np.uint32(16)) & b)] ^ flat[at + 768 + (crc >> np.uint32(24))]
    long = np.flatnonzero(n >= _SHORT)
    for k, tables in enumerate(_FAR if len(long) else ()):
        some = long[(n[long] >> (k + 6)) & 1 == 1]
        out[some] = _applied(tables, out[some])
    return out


def word_crcs(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the words at these spans of (lower-cased) bytes."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    begin, state = starts[order], np.full(len(starts), 0xFFFFFFFF, np.uint32)
    longer = len(starts) - np.searchsorted(np.sort(size), np.arange(min(int(size.max(initial=0)), _SHORT)), side="right")
    for k, n in enumerate(longer.tolist()):
        byte = lower[begin[:n] + k].astype(np.uint32)
        state[:n] = _TABLE[(state[:n] ^ byte) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(lower[starts[i]: ends[i]].tobytes())
    return out


@dataclass
class Head:
    """Frequent words in the order of their hashes, and buckets of frequent pairs by the pair numbers of their words."""

    words: np.ndarray  # uint64, sorted
    crcs: np.ndarray  # uint32
    sizes: np.ndarray  # int64
    numbers: np.ndarray  # pair number of a word, -1 for most
    pairs: np.ndarray  # (pair words, pair words): bucket, -1 where the pair is not frequent


EMPTY = Head(NO_HEAD, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.int32))


@dataclass
class _Text:
    """The words of a batch: the number of its distinct word for each, and hash, CRC and size of the distinct ones."""

    word: np.ndarray
    bounds: np.ndarray  # where the words of each text begin
    hashes: np.ndarray
    crcs: np.ndarray
    sizes: np.ndarray
    pair_number: np.ndarray


def _read(column: pa.Array, head: Head) -> _Text:
    data, offsets = W.utf8(column)
    starts, ends = W.spans(data, offsets, W.PLAIN)
    hashes, first, word = np.unique(W.hash_words(data, starts, ends), return_index=True, return_inverse=True)
    crcs, sizes, number = np.zeros(len(hashes), np.uint32), (ends - starts)[first], np.full(len(hashes), -1)
    tail = np.ones(len(hashes), bool)
    if len(head.words) and len(hashes):
        at = np.minimum(np.searchsorted(head.words, hashes), len(head.words) - 1)
        known = (head.words[at] == hashes) & (head.sizes[at] == sizes)
        crcs[known], number[known], tail = head.crcs[at[known]], head.numbers[at[known]], ~known
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    crcs[tail] = word_crcs(lower, starts[first[tail]], ends[first[tail]])
    return _Text(word.ravel(), np.searchsorted(starts, offsets), hashes, crcs, sizes, number)


def _buckets(text: _Text, head: Head, n_buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of the first word, bucket) of all runs of one, two and three words."""
    word, n = text.word, len(text.word)
    # What a space and the word itself have in the CRC of a run that they end.
    tail = shifted(np.full(len(text.sizes), zlib.crc32(b" "), np.uint32), text.sizes) ^ text.crcs
    one = (text.crcs % np.uint32(n_buckets)).astype(np.int64)[word]
    out = [(np.arange(n), one)]
    inside = np.ones(n, bool)
    inside[text.bounds[1:][text.bounds[1:] > 0] - 1] = False  # the last word of a text has no next one
    at = np.flatnonzero(inside[: n - 1]) if n else np.zeros(0, np.int64)
    pair = shifted(text.crcs[word[at]], text.sizes[word[at + 1]] + 1) ^ tail[word[at + 1]]
    bucket = (pair % np.uint32(n_buckets)).astype(np.int64)
    if len(head.pairs):
        a, b = text.pair_number[word[at]], text.pair_number[word[at + 1]]
        both = np.flatnonzero((a >= 0) & (b >= 0))
        listed = head.pairs[a[both], b[both]]
        bucket[both[listed >= 0]] = listed[listed >= 0]
    out.append((at, bucket))
    more = np.flatnonzero(inside[np.minimum(at + 1, n - 1)]) if len(at) else at
    last = word[at[more] + 2] if len(more) else at
    three = shifted(pair[more], text.sizes[last] + 1) ^ tail[last]
    out.append((at[more], (three % np.uint32(n_buckets)).astype(np.int64)))
    return out


class _Summary:
    """Counts of the most frequent keys of a task, in bounded memory."""

    def __init__(self, width: int):
        self.keys, self.counts = np.zeros((0, width), np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        number = keys[:, 0] if keys.shape[1] == 1 else W.mix(keys[:, 0].view(np.uint64)) + keys[:, 1].view(np.uint64) * np.uint64(3)
        _, first, same = np.unique(number, return_index=True, return_inverse=True)
        counts = np.bincount(same.ravel(), np.concatenate([self.counts, counts]), len(first)).astype(np.int64)
        keys = keys[first]
        if len(keys) > 4 * SUMMARY:
            keep = np.argpartition(-counts, SUMMARY)[:SUMMARY]
            keys, counts = keys[keep], counts[keep]
        self.keys, self.counts = keys, counts

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        keep = np.argsort(-self.counts, kind="stable")[:SUMMARY]
        return self.keys[keep], self.counts[keep]


def head_vocabulary(docs: DataFrame, n_buckets: int, head_words: int = HEAD_WORDS, pair_words: int = PAIR_WORDS, head_pairs: int = HEAD_PAIRS) -> Head:
    """The head vocabulary of docs(text). Null and empty texts have no words; without words it is empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, pair = _Summary(3), _Summary(2)
        for batch in W.pieces(batches):
            text = _read(batch.column("text"), EMPTY)
            if not len(text.word):
                continue
            word.add(np.stack([text.hashes.view(np.int64), text.crcs.astype(np.int64), text.sizes], axis=1), np.bincount(text.word, minlength=len(text.hashes)))
            inside = np.ones(len(text.word), bool)
            inside[text.bounds[1:][text.bounds[1:] > 0] - 1] = False
            at = np.flatnonzero(inside[:-1])
            both, n = np.unique(text.word[at] * len(text.hashes) + text.word[at + 1], return_counts=True)
            often = n > 1  # what a batch holds once is not frequent
            both, n = both[often], n[often]
            pair.add(np.stack([text.hashes[both // len(text.hashes)], text.hashes[both % len(text.hashes)]], axis=1).view(np.int64), n)
        (a, n), (b, m) = word.top(), pair.top()
        zero = np.zeros(len(b), np.int64)
        if len(a):
            yield pa.record_batch([pa.array(a[:, 0]), pa.array(np.zeros(len(a), np.int64)), pa.array(a[:, 1]), pa.array(a[:, 2]), pa.array(n)], _COUNTED)
        if len(b):
            yield pa.record_batch([pa.array(b[:, 0]), pa.array(b[:, 1]), pa.array(zero - 1), pa.array(zero), pa.array(m)], _COUNTED)

    counted = stored(docs.select("text").mapInArrow(count, ", ".join(f"{c} long" for c in _COUNTED))
                     .groupBy("a", "b", "crc", "size").agg(F.sum("n").alias("n")), "head")
    top = [tuple(r) for r in counted.filter("crc >= 0").orderBy(F.desc("n"), "a", "crc").limit(head_words).select("a", "crc", "size").collect()]
    if not top:
        return EMPTY
    spark = docs.sparkSession
    ranked = F.broadcast(spark.createDataFrame([(r[0], k) for k, r in enumerate(top[:pair_words])], "word long, k int").groupBy("word").agg(F.min("k").alias("k")))
    left, right = ranked.select(F.col("word").alias("a"), F.col("k").alias("i")), ranked.select(F.col("word").alias("b"), F.col("k").alias("j"))
    pairs = counted.filter("crc < 0").join(left, "a").join(right, "b").orderBy(F.desc("n"), "i", "j").limit(head_pairs).select("i", "j").collect()
    hashes, crcs, sizes = (np.array(c, np.int64) for c in zip(*top))
    order = np.argsort(hashes.view(np.uint64), kind="stable")
    number = np.where(np.arange(len(top)) < pair_words, np.arange(len(top)), -1)
    table = np.full((min(pair_words, len(top)),) * 2, -1, np.int32)
    if pairs:
        i, j = np.array([tuple(r) for r in pairs]).T
        crc = shifted(crcs[i].astype(np.uint32), sizes[j] + 1) ^ shifted(np.full(len(j), zlib.crc32(b" "), np.uint32), sizes[j]) ^ crcs[j].astype(np.uint32)
        table[i, j] = crc % np.uint32(n_buckets)
    return Head(hashes.view(np.uint64)[order], crcs[order].astype(np.uint32), sizes[order], number[order], table)


_COUNTED = ["a", "b", "crc", "size", "n"]


def bucket_totals(docs: DataFrame, head: Head, n_buckets: int) -> np.ndarray:
    """How many features of docs(text) fall into each bucket. Every task sends one row a bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in W.pieces(batches):
            for _, bucket in _buckets(_read(batch.column("text"), shared.value), shared.value, n_buckets):
                total += np.bincount(bucket, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    # One row a bucket, whatever the data.
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much commoner a bucket is in the target, smoothed by one, rounded down."""
    n = len(own)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (own.sum() + float(n)) / ((s + 1.0) * (target.sum() + float(n))))) for t, s in zip(target.tolist(), own.tolist())], np.int64)


def weighed(docs: DataFrame, head: Head, gain: np.ndarray) -> DataFrame:
    """(row, n_words, n_features, weight) for every row of docs(text, ...): `row` has all columns but the text, weight is the sum of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))
    shaped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = shared.value
        for batch in W.pieces(batches):
            text = _read(batch.column("text"), head)
            n = np.diff(text.bounds)
            weight = np.zeros(len(n))
            owner = np.repeat(np.arange(len(n)), n)
            for first, bucket in _buckets(text, head, len(gain)):
                weight += np.bincount(owner[first], gain[bucket], len(n))
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.record_batch([batch.column("row"), pa.array(n), pa.array(features), pa.array(weight.astype(np.int64))], ["row", "n_words", "n_features", "weight"])

    return shaped.mapInArrow(run, f"row {shaped.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number that the seed and the key decide, rounded down. Null keys have none."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, n_buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """(row, n_words, n_features, weight, score, rank) for every row of docs(doc_id, text, ...): `percent` of them are drawn, with a rank.

    Drawing the highest sums of weight and Gumbel noise is drawing without replacement by weight. Rows with fewer than
    `least_words` words or a null doc_id cannot be drawn and do not count; a null id has no score. Null and empty texts have
    no features and weight 0. Equal scores are ordered by doc_id, repeated rows then by weight and number of features. Ranks are
    given over sorted partitions, so no task holds all rows. Without a target text all buckets count as equally likely in it.
    """
    head = head_vocabulary(docs, n_buckets)
    gain = gains(bucket_totals(target, head, n_buckets), bucket_totals(docs, head, n_buckets))
    found = stored(weighed(docs, head, gain).withColumn("score", F.col("weight") + noise(F.col("row.doc_id"), seed)), "weighed")
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    drawn = found.filter(able).count() * percent // 100
    ranked = number_rows(found.filter(able).withColumn("_id", F.col("row.doc_id")), [F.desc("score"), F.asc("_id"), F.desc("weight"), F.desc("n_features")], "rank").drop("_id")
    kept = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return kept.unionByName(found.filter(~able).withColumn("rank", F.lit(None).cast("long")))
