"""Best keyword hits from postings in blocks, with blocks skipped that cannot hold one.

The postings of a word in a corpus are one block, or, where they are more than a block holds, they are dealt to levels by how
much they can add to a score, and a level to blocks of bounded size; each block states the largest part that any of its
postings can add. A search first reads the strongest
blocks of every query. The k-th best of these sums is a score that the k-th hit reaches at least. A chunk of a block
scores at most the block's part plus the largest parts of the query's other words in that corpus, so blocks for which this
stays below the threshold are not read. What is left are the same hits with the same scores. The postings that are read are
dealt to cells by their chunk; a task holds those of one cell and reads the queries in pieces, so no row is made for a query
and a posting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dossierlake.session import broadcast_if_small, scratch_folder

# Postings of a block, levels of strength, blocks of a query that are read first, and words of a batch of queries that become a filter of the scan.
BLOCK_ROWS, LEVELS, FIRST_BLOCKS, FILTERED = 4096, 16, 64, 1000
_KEY = ["corpus_key", "term", "block"]
_CHUNK = ["doc_id", "chunk_index"]
# Postings of a cell, about.
CELL_ROWS = 1 << 20
# Room for the rounding of scores.
_SLACK = 1e-5


@dataclass(frozen=True)
class KeywordIndex:
    """postings(corpus_key, term, block, doc_id, chunk_index, tf, dl) and blocks(corpus_key, term, block, n, largest, avgdl)."""

    postings: DataFrame
    blocks: DataFrame


def saturation(k1: float, b: float) -> Column:
    """What a posting adds to a score, before the weight of its word: at most k1 + 1."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def write(postings: DataFrame, sizes: DataFrame, folder: str, k1: float, b: float, block_rows: int = BLOCK_ROWS, counts: DataFrame | None = None) -> KeywordIndex:
    """Stores postings(corpus_key, doc_id, chunk_index, term, tf, dl) in blocks; sizes(corpus_key, n_chunks, avgdl).

    counts(corpus_key, term, df) are those of the postings, where they are at hand.
    """
    spark = postings.sparkSession
    means = broadcast_if_small(sizes.select("corpus_key", "avgdl"))
    part = postings.join(means, "corpus_key").withColumn("part", saturation(k1, b))
    if counts is None:
        counts = postings.groupBy("corpus_key", "term").agg(F.count("*").alias("df"))
    # No level of a word has more postings than the word itself.
    long = counts.filter(F.col("df") > block_rows).select("corpus_key", "term", F.ceil(F.col("df") / block_rows).alias("salts"))
    # The strongest level comes first.
    level = (LEVELS - 1) - F.least(F.floor(F.col("part") * LEVELS / (k1 + 1)), F.lit(LEVELS - 1))
    dealt = level.cast("int") * F.lit(1 << 32) + F.pmod(F.xxhash64(*_CHUNK), F.col("salts"))
    blocked = part.join(broadcast_if_small(long), ["corpus_key", "term"], "left").withColumn("block", F.coalesce(dealt, F.lit(0).cast("long")))
    # A block's postings lie together and words in order, so a search reads the row groups of its words.
    (blocked.select(*_KEY, *_CHUNK, "tf", "dl", "part").repartition(*_KEY)
     .sortWithinPartitions("term", "corpus_key", "block").write.mode("overwrite").parquet(f"{folder}/postings"))
    stored = spark.read.parquet(f"{folder}/postings")
    (stored.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("part").alias("largest")).join(means, "corpus_key")
     .sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/blocks"))
    return read(spark, folder)


def read(spark: SparkSession, folder: str) -> KeywordIndex:
    return KeywordIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/blocks"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _wanted(index: KeywordIndex, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, corpus_key, term, block, n, weight, avgdl, bound): the blocks of the words of each query, and what they add at most."""
    keys = ["corpus_key", "term"] if "corpus_key" in terms.columns else ["term"]
    asked = terms.join(stats.join(broadcast_if_small(terms.select(*keys).distinct()), keys, "left_semi").select("corpus_key", "term", "idf", "avgdl"), keys)
    # Written, as the statistics may be sums over all words.
    weighted = _stored(asked.select("query_id", "corpus_key", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl"), "weighted")
    # Lengths of chunks count in relation to their mean, which may have grown since the blocks were written.
    grown = F.greatest(F.lit(1.0), F.col("avgdl") / F.col("written"))
    blocks = index.blocks.withColumnRenamed("avgdl", "written")
    found = blocks.join(broadcast_if_small(weighted), ["corpus_key", "term"])
    return found.select("query_id", *_KEY, "n", "weight", "avgdl", F.greatest(F.col("weight") * F.col("largest") * grown, F.lit(0.0)).alias("bound"))


def _level(block: Column) -> Column:
    """The level of a block; the numbers above it tell apart blocks that were written at different times."""
    return F.pmod(F.shiftright(block, 32), F.lit(1 << 16))


class _Cell:
    """The postings of some chunks by word and corpus, for sums over all of them at once."""

    def __init__(self, rows: pa.Table):
        # Ids by number, as they may be null.
        doc, chunk = (rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64) for c in _CHUNK)
        _, first, at = np.unique(doc * (chunk.max() + 1) + chunk, return_index=True, return_inverse=True)
        self.docs, self.chunks = (rows.column(c).combine_chunks().take(pa.array(first)) for c in _CHUNK)
        self.n, pair, part = len(first), rows.column("pair").to_numpy(), rows.column("part").to_numpy()
        by_pair = np.argsort(pair, kind="stable")
        self.pair, self.part, self.at = pair[by_pair], part[by_pair], at[by_pair]

    def best(self, pairs: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the chunks that can be among the best `k`; scores are rounded before they are ranked."""
        start, end = np.searchsorted(self.pair, pairs), np.searchsorted(self.pair, pairs, side="right")
        size = end - start
        place = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        at = self.at[place]
        sums = np.bincount(at, np.repeat(weights, size) * self.part[place], self.n)
        found = np.flatnonzero(np.bincount(at, minlength=self.n))
        if len(found) > k:
            found = found[sums[found] >= np.partition(sums[found], -k)[-k] - _SLACK]
        return found, sums[found]


def _sums(index: KeywordIndex, blocks: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, chunk_index, bm25) over the postings of some blocks of each query: those that can be among its best `k`.

    A word is read down to the deepest level at which any query needs it. That may add to a sum more than the query's own blocks.
    """
    spark, query = blocks.sparkSession, dict(blocks.dtypes)["query_id"]
    words = [r["term"] for r in blocks.select("term").distinct().limit(FILTERED + 1).collect()]
    # A short list of words reaches the scan, which then skips the files and row groups without them.
    own = index.postings.filter(F.col("term").isin(words)) if len(words) <= FILTERED else index.postings
    # Numbers of the words of each corpus, written so that they stay the same.
    pairs = _stored(blocks.groupBy("corpus_key", "term").agg(F.max(_level(F.col("block"))).alias("deepest"), F.first("avgdl").alias("avgdl"))
                    .withColumn("pair", F.monotonically_increasing_id()), "pairs")
    read_ = blocks.select(*_KEY, "n").distinct().agg(F.sum("n")).first()[0] or 0
    cells = max(1, -(-read_ // CELL_ROWS), 2 * spark.sparkContext.defaultParallelism)
    small = broadcast_if_small(pairs)
    hits = own.drop("avgdl").join(small, ["corpus_key", "term"]).filter(_level(F.col("block")) <= F.col("deepest"))
    # Empty lists, as the way to Python goes over all null lists of a batch again with each row.
    left = hits.select(F.pmod(F.xxhash64(*_CHUNK), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("kind"), F.lit(None).cast(query).alias("query_id"), *_CHUNK,
                       "pair", saturation(k1, b).alias("part"), F.array().cast("array<bigint>").alias("pairs"), F.array().cast("array<double>").alias("weights"))
    weighed = blocks.select("query_id", "corpus_key", "term", "weight").distinct().join(small, ["corpus_key", "term"])
    lists = weighed.groupBy("query_id").agg(F.collect_list(F.struct("pair", "weight")).alias("_l"))
    kinds = dict(index.postings.dtypes)
    right = lists.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "query_id", *[F.lit(None).cast(kinds[c]).alias(c) for c in _CHUNK],
                         F.lit(None).cast("long").alias("pair"), F.lit(None).cast("double").alias("part"), F.col("_l.pair").alias("pairs"), F.col("_l.weight").alias("weights"))
    placed = left.unionByName(right).repartition(cells, "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("cell", "kind")]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                piece, now = batch.slice(i, j - i), keys[0][i]
                if now != at:
                    at, held, ready = now, [], None
                if keys[1][i] == 0:
                    held.append(piece.select([*_CHUNK, "pair", "part"]))
                    continue
                if ready is None and held:
                    ready, held = _Cell(pa.Table.from_batches(held)), []
                if ready is not None:
                    yield from _found(piece, ready, k)

    return placed.mapInArrow(run, f"query_id {query}, doc_id {kinds['doc_id']}, chunk_index {kinds['chunk_index']}, bm25 double")


def _found(queries: pa.RecordBatch, cell: _Cell, k: int) -> Iterator[pa.RecordBatch]:
    for row, (pairs, weights) in enumerate(zip(queries.column("pairs"), queries.column("weights"))):
        found, sums = cell.best(pairs.values.to_numpy(), weights.values.to_numpy(), k)
        if len(found):
            yield pa.record_batch([queries.column("query_id").take(pa.array(np.full(len(found), row))), cell.docs.take(pa.array(found)), cell.chunks.take(pa.array(found)), pa.array(sums)],
                                  ["query_id", *_CHUNK, "bm25"])


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), *_CHUNK)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def needed(index: KeywordIndex, stats: DataFrame, terms: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """The blocks of `terms`(query_id, [corpus_key,] term, qtf) with `needed`: whether they can hold one of the best `k`."""
    wanted = _stored(_wanted(index, stats, terms), "blocks")
    strongest = Window.partitionBy("query_id").orderBy(F.desc("bound"), *_KEY)
    first = wanted.withColumn("_r", F.row_number().over(strongest)).filter(F.col("_r") <= FIRST_BLOCKS).drop("_r")
    kth = _best(_sums(index, _stored(first, "first"), k, k1, b), k).filter(F.col("rank") == k).select("query_id", F.col("bm25").alias("floor"))
    # With a word of negative weight a sum over some blocks is no lower bound.
    certain = wanted.groupBy("query_id").agg(F.min("weight").alias("least")).filter("least >= 0").select("query_id")
    floors = kth.join(certain, "query_id", "left_semi")
    tops = wanted.groupBy("query_id", "corpus_key", "term").agg(F.max("bound").alias("top"))
    totals = tops.groupBy("query_id", "corpus_key").agg(F.sum("top").alias("total"))
    most = F.col("total") - F.col("top") + F.col("bound")
    return (wanted.join(tops, ["query_id", "corpus_key", "term"]).join(totals, ["query_id", "corpus_key"]).join(floors, "query_id", "left")
            .withColumn("needed", F.col("floor").isNull() | (most >= F.col("floor") - _SLACK))
            .select("query_id", *_KEY, "n", "weight", "avgdl", "bound", "needed"))


def top(index: KeywordIndex, stats: DataFrame, terms: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """The best `k` chunks of each query: (query_id, doc_id, chunk_index, bm25, rank).

    stats(corpus_key, term, idf, avgdl); terms(query_id, [corpus_key,] term, qtf). Scores are positive, rounded to 6 places; ties go
    to the lower document and chunk.
    """
    blocks = _stored(needed(index, stats, terms, k, k1, b).filter("needed"), "needed")
    scored = _sums(index, blocks, k, k1, b).filter(F.col("bm25") > 0)
    return _best(scored.withColumn("bm25", F.round("bm25", 6)), k)
