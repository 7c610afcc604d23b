"""Keyword search (Okapi BM25), vector search and their fusion, for batches of queries.

Tables: chunks(corpus_key, doc_id, chunk_index, text, word_count),
queries(query_id, text [, corpus_key]).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dossierlake.functions import text as tx, vectors as vx
from dossierlake.functions.arrays import rows_of
from dossierlake.operators import keyword_index as ki, keyword_scan as ks, vector_index as vi
from dossierlake.operators.keyword_index import KeywordIndex
from dossierlake.operators.vector_index import VectorIndex
from dossierlake.session import broadcast_if, broadcast_if_small, is_small, scratch_folder, stored

# Okapi constants, fusion weights, list lengths and score floors.
K1, B, IDF_FLOOR = 1.5, 0.75, 0.25
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.3, 0.7
TOP_K, CONVERSATION_TOP_K = 10, 5
MIN_SCORE, MIN_SCORE_ANALYSIS, MIN_SCORE_FALLBACK = 0.3, 0.2, 0.25
# Words asked of one corpus up to which they go along with each of its chunks as a list.
MOST_ASKED = 1024
NOTHING_FOUND = "Aucun document pertinent trouvé pour cette question."
SOURCE_SEPARATOR = "\n\n---\n\n"

CHUNK_ID = ["doc_id", "chunk_index"]


@dataclass(frozen=True)
class Index:
    """What searching needs of a corpus: postings, term statistics and chunk vectors, as stored tables."""

    postings: KeywordIndex
    stats: DataFrame
    vectors: VectorIndex


def tokenise(chunks: DataFrame) -> DataFrame:
    """Adds `tokens`: lower-cased whitespace words, punctuation kept."""
    return chunks.withColumn("tokens", tx.words(F.lower("text")))


def postings(chunks: DataFrame, corpus: str = "corpus_key", terms: DataFrame | None = None) -> DataFrame:
    """(corpus_key, doc_id, chunk_index, term, tf, dl), of given terms only where there are some.

    Over `placed` chunks the grouping needs no exchange: all words of a chunk are together.
    Words that nobody asks for are dropped before they are counted.
    """
    words = tokenise(chunks).select(F.col(corpus).alias("corpus_key"), *CHUNK_ID, F.col("word_count").alias("dl"),
                                    F.explode_outer("tokens").alias("term")).filter(F.col("term").isNotNull())
    if terms is not None:
        words = words.join(terms, "term", "left_semi")
    return words.groupBy("corpus_key", *CHUNK_ID, "dl", "term").agg(F.count("*").cast("int").alias("tf"))


def term_lists(chunks: DataFrame) -> DataFrame:
    """(corpus_key, doc_id, chunk_index, dl, terms): the words of each row of chunks with how often each is there, as one list."""
    return chunks.select("corpus_key", *CHUNK_ID, F.col("word_count").alias("dl"), tx.counted_words(F.lower("text")).alias("terms"))


def listed_postings(lists: DataFrame) -> DataFrame:
    """`postings` from stored `term_lists`. Rows that repeat a chunk add up; where none does, nothing is grouped."""
    keys = [c for c in lists.columns if c != "terms"]
    rows = lists.select(*keys, F.explode("terms").alias("_t")).select(*keys, F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf"))
    if lists.groupBy(*keys).count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy(*keys, "term").agg(F.sum("tf").cast("int").alias("tf"))


def own_postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """`postings` of the words that terms(corpus_key, term, ...) ask of a chunk's own corpus.

    The words asked of a corpus are a list that joins its chunks, and each is counted in the row, so the other words make no rows.
    """
    asked = terms.groupBy("corpus_key").agg(F.collect_set("term").alias("_asked"))
    counted = F.transform(F.array_intersect("tokens", "_asked"), lambda t: F.struct(
        t.alias("term"), (F.size("tokens") - F.size(F.array_remove("tokens", t))).alias("tf")))
    found = rows_of(tokenise(chunks).join(asked, "corpus_key"), counted, "_n", "_p", ("corpus_key", *CHUNK_ID, "word_count"))
    # Rows that repeat a chunk add up, as in `postings`.
    return found.groupBy("corpus_key", *CHUNK_ID, F.col("word_count").alias("dl"), F.col("_p.term").alias("term")).agg(F.sum("_p.tf").cast("int").alias("tf"))


def corpus_sizes(chunks: DataFrame, corpus: str = "corpus_key") -> DataFrame:
    return chunks.groupBy(F.col(corpus).alias("corpus_key")).agg(
        F.count("*").alias("n_chunks"), F.avg("word_count").alias("avgdl"))


def term_stats(chunks: DataFrame, corpus: str = "corpus_key") -> DataFrame:
    """(corpus_key, term, df, n_chunks, avgdl, idf) with the floor for common terms.

    Only counts are shuffled: the aggregations combine on the map side, so a common term
    or a large corpus costs one row per task. With few corpora the per-corpus numbers are
    broadcast, so the terms of a large corpus are never brought to one task either.
    """
    seen = tokenise(chunks).select(F.col(corpus).alias("corpus_key"), F.explode_outer(F.array_distinct("tokens")).alias("term"))
    # Read twice below, for the terms and for their mean.
    counts = stored(seen.filter(F.col("term").isNotNull()).groupBy("corpus_key", "term").agg(F.count("*").alias("df")), "counts")
    return with_idf(counts, corpus_sizes(chunks, corpus))


def with_idf(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Term statistics from counts(corpus_key, term, df) and sizes(corpus_key, n_chunks, avgdl)."""
    few = is_small(sizes)
    raw = counts.join(broadcast_if(few, sizes), "corpus_key").withColumn(
        "_idf", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = raw.groupBy("corpus_key").agg(F.avg("_idf").alias("_mean"))
    idf = F.when(F.col("_idf") < 0, IDF_FLOOR * F.col("_mean")).otherwise(F.col("_idf"))
    return raw.join(broadcast_if(few, means), "corpus_key").select(
        "corpus_key", "term", "df", "n_chunks", "avgdl", idf.alias("idf"))


def write_keywords(chunks: DataFrame, folder: str) -> tuple[KeywordIndex, DataFrame]:
    """Stores postings in blocks and term statistics of searchable chunks; the statistics come from the postings."""
    spark = chunks.sparkSession
    term_lists(chunks).write.mode("overwrite").parquet(f"{folder}/plain")
    plain = listed_postings(spark.read.parquet(f"{folder}/plain"))
    plain.groupBy("corpus_key", "term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    corpus_sizes(chunks).write.mode("overwrite").parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    with_idf(counts, sizes).write.mode("overwrite").parquet(f"{folder}/term_stats")
    ki.write(plain, sizes, f"{folder}/postings", K1, B, counts=counts)
    return read_keywords(spark, folder)


def read_keywords(spark: SparkSession, folder: str) -> tuple[KeywordIndex, DataFrame]:
    return ki.read(spark, f"{folder}/postings"), spark.read.parquet(f"{folder}/term_stats")


def write_tables(chunks: DataFrame, folder: str, model=vx.hashed_vectors) -> Index:
    """Stores postings, term statistics and vectors of searchable chunks, once at ingest."""
    write_keywords(chunks, folder)
    vi.write(chunk_vectors(chunks, model).select("corpus_key", *CHUNK_ID, "embedding"), f"{folder}/vectors")
    return read_tables(chunks.sparkSession, folder)


def read_tables(spark: SparkSession, folder: str) -> Index:
    return Index(*read_keywords(spark, folder), vi.read(spark, f"{folder}/vectors"))


def keyword_top(index: KeywordIndex, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best `k` of `bm25` over stored blocks, of which those that cannot hold a hit are not read: with `rank`."""
    return ki.top(index, stats, query_terms(queries), k, K1, B)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, [corpus_key,] term, qtf); a repeated word counts again."""
    keep = [c for c in ("query_id", "corpus_key") if c in queries.columns]
    rows = rows_of(queries, tx.words(F.lower("text")), "_n", "term", tuple(keep))
    return rows.groupBy(*keep, "term").agg(F.count("*").alias("qtf"))


def placed(chunks: DataFrame) -> DataFrame:
    """Chunks spread by their id.

    Scores are then summed where the chunk is, and only each task's best hits move.
    A table written by `write_index` has this placement already.
    """
    return chunks.repartition(*CHUNK_ID)


def _asked(stats: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(terms of the queries, the statistics of these terms, whether there are few terms)."""
    terms = stored(query_terms(queries), "terms")
    few = is_small(terms)
    keys = ["corpus_key", "term"] if "corpus_key" in queries.columns else ["term"]
    wanted = broadcast_if(few, terms.select(*keys).distinct())
    # At most the query terms of each corpus are left.
    return terms, stored(stats.join(wanted, keys, "left_semi").select("corpus_key", "term", "idf", "avgdl"), "asked_stats"), few


def bm25_best(chunks: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best `k` of `bm25` for each query, with `rank`: chunks are scanned in blocks, so no row is made for a word of a query in a chunk."""
    terms, used, _ = _asked(stats, queries)
    hits = ks.scores(chunks, terms, used, K1, B, k)
    return best(hits.select("query_id", *CHUNK_ID, F.round("bm25", 6).alias("bm25")).filter(F.col("bm25") > 0), "bm25", k)


def bm25(chunks: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """Every positive score of searchable chunks: (query_id, doc_id, chunk_index, bm25).

    Scores use the statistics of the chunk's own corpus and are compared across corpora.
    A `corpus_key` on the queries restricts each query to that corpus.
    """
    terms, used, few = _asked(stats, queries)
    keys = ["corpus_key", "term"] if "corpus_key" in queries.columns else ["term"]
    terms, used = broadcast_if(few, terms), broadcast_if_small(used)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    if "corpus_key" in keys and terms.groupBy("corpus_key").count().filter(F.col("count") > MOST_ASKED).isEmpty():
        found = own_postings(chunks, terms)
    else:
        found = postings(chunks, terms=broadcast_if(few, terms.select("term").distinct()))
    hits = found.join(terms, keys).join(used, ["corpus_key", "term"])
    scored = hits.groupBy("query_id", *CHUNK_ID).agg(F.sum(part).alias("_sum")).filter(F.col("_sum") > 0)
    # Rounded so that the order of summing never decides a rank.
    return scored.select("query_id", *CHUNK_ID, F.round("_sum", 6).alias("bm25"))


def best(hits: DataFrame, score: str, k: int) -> DataFrame:
    """The best `k` hits per query; ties by document and chunk.

    Spark cuts each task's list to `k` before the exchange (WindowGroupLimit).
    """
    w = Window.partitionBy("query_id").orderBy(F.desc(score), *CHUNK_ID)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def chunk_vectors(chunks: DataFrame, model=vx.hashed_vectors, text: str = "text") -> DataFrame:
    return chunks.withColumn("embedding", vx.embed(F.col(text), model))


def semantic(vectors: DataFrame | VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """Best `k` per query by similarity = 1 - cosine distance / 2, over an index or over vectors that are indexed for this search.

    With a `corpus_key` on the queries, each query reads the vectors of its corpus only.
    """
    if "corpus_key" in queries.columns:
        hits = vi.nearest_in_corpus(vectors.vectors if isinstance(vectors, VectorIndex) else vectors, queries, k)
    else:
        index = vectors if isinstance(vectors, VectorIndex) else vi.write(vectors, scratch_folder(queries.sparkSession, "vectors"))
        hits = vi.nearest(index, queries, k)
    return hits.select("query_id", *CHUNK_ID, ((1 + F.col("cosine")) / 2).alias("similarity"))


def pair_cosines(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of every vector with the queries of its corpus: an equi-join on the corpus key."""
    q = broadcast_if_small(queries.select("query_id", "corpus_key", F.col("embedding").alias("_q")))
    pairs = vectors.join(q, "corpus_key")
    return pairs.select("query_id", *CHUNK_ID, F.round(vx.cosine(F.col("embedding"), F.col("_q")), 9).alias("cosine"))


def minmax(hits: DataFrame, score: str, out: str) -> DataFrame:
    """Scores of one result list scaled to 0..1; all equal gives 1.

    Extremes are aggregated and joined back, so a long list is never held in one task.
    """
    ends = hits.groupBy("query_id").agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(
        (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return hits.join(ends, "query_id").withColumn(out, scaled).drop("_lo", "_hi")


def minmax_short(hits: DataFrame, score: str, out: str) -> DataFrame:
    """As `minmax`, for lists already cut to a fixed length."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(out, F.when(hi == lo, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def fuse(semantic_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Outer merge of two legs whose scores are in `semantic` and `keyword` already scaled."""
    merged = semantic_hits.select("query_id", *CHUNK_ID, "semantic").join(
        keyword_hits.select("query_id", *CHUNK_ID, "keyword"), ["query_id", *CHUNK_ID], "full")
    s, b = F.coalesce("semantic", F.lit(0.0)), F.coalesce("keyword", F.lit(0.0))
    source = (F.when(F.col("semantic").isNotNull() & F.col("keyword").isNotNull(), "hybrid")
              .when(F.col("semantic").isNotNull(), "semantic").otherwise("bm25"))
    return merged.select(
        "query_id", *CHUNK_ID, s.alias("semantic_score"), b.alias("bm25_score"),
        F.round(SEMANTIC_WEIGHT * s + KEYWORD_WEIGHT * b, 9).alias("hybrid_score"), source.alias("source"))


def min_score(hits: DataFrame, floor: float = MIN_SCORE, strict: bool = False) -> DataFrame:
    score = F.col("hybrid_score")
    return hits.filter(score > floor if strict else score >= floor)


def percent(score: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.bround(score * 100, 0)), F.lit("%"))


def context(hits: DataFrame, queries: DataFrame, floor: float = MIN_SCORE) -> DataFrame:
    """One prompt context per query from hits(query_id, rank, file_name, text, scores)."""
    kept = min_score(hits, floor)
    numbered = kept.withColumn(
        "n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    block = F.format_string(
        "[Source %d — %s, section %d, pertinence: %s (sémantique: %s, mots-clés: %s)]\n%s",
        F.col("n"), F.col("file_name"), F.col("chunk_index"), percent(F.col("hybrid_score")),
        percent(F.col("semantic_score")), percent(F.col("bm25_score")), F.col("text"))
    blocks = numbered.select("query_id", F.struct("n", block.alias("b")).alias("s"))
    joined = blocks.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), SOURCE_SEPARATOR).alias("context"))
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(NOTHING_FOUND)).alias("context"))


def first_section_wins(hits: DataFrame, group: list[str]) -> DataFrame:
    """Keeps a chunk only for the first section that found it: hits(*group, section_no, doc_id, ...)."""
    first = hits.groupBy(*group, *CHUNK_ID).agg(F.min("section_no").alias("section_no"))
    return hits.join(first, [*group, *CHUNK_ID, "section_no"], "left_semi")


def word_budget(parts: DataFrame, group: list[str], order: list[str], text: str = "part", limit: int = 4000) -> DataFrame:
    """The leading parts whose running word total stays within the limit."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (parts.withColumn("part_words", tx.word_count(F.col(text)))
            .withColumn("running_words", F.sum("part_words").over(w))
            .filter(F.col("running_words") <= limit))


def source_records(hits: DataFrame) -> DataFrame:
    return hits.withColumn("hybrid_score", F.round("hybrid_score", 3))


def write_index(chunks: DataFrame, table: str, buckets: int) -> None:
    """Stores placed chunks as a bucketed table, so searches start without an exchange."""
    (chunks.write.bucketBy(buckets, *CHUNK_ID).sortBy(*CHUNK_ID).mode("overwrite").saveAsTable(table))
