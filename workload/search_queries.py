"""Chunking and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import chunking as ck, search as se
from dossierlake.functions import vectors as vx
from dossierlake.plans import hybrid as hy
from dossierlake.session import scratch_folder
from dossierlake.sources import corpus as cp
from workload import fixtures as fx, sqltext as q
from workload.kit import query

CHUNKS = q.chunk_ctes()
POSTINGS = [*CHUNKS, *q.posting_ctes()]
ASKED = [*POSTINGS, *q.query_ctes(fx.BENCHMARK_QUERIES)]


@query("chk_sentences", q.with_([q.SENTENCES], """
SELECT doc_id, i - 1 AS sentence_no, sentence FROM
  (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS sentence FROM sents)"""))
def chk_sentences(spark, sf):
    out = ck.split_sentences(fx.documents(spark, sf))
    return out.select("doc_id", F.col("sentence_no").cast("long"), "sentence")


@query("chk_pack", q.with_(CHUNKS, "SELECT doc_id, chunk_index, text, word_count FROM chunks"))
def chk_pack(spark, sf):
    out = ck.retrieval_chunks(fx.documents(spark, sf))
    return out.select("doc_id", F.col("chunk_index").cast("long"), "text", F.col("word_count").cast("long"))


@query("chk_hard_split", q.with_(CHUNKS, """
SELECT doc_id, count(*) AS pieces, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest
FROM chunks WHERE doc_id IN (SELECT doc_id FROM packed WHERE length(text) > 6000) GROUP BY 1"""))
def chk_hard_split(spark, sf):
    """Documents holding a packed chunk over the length limit, and their pieces."""
    docs = fx.documents(spark, sf).select("doc_id", "text")
    uncut = ck.chunk_list(F.col("text"), limit=1 << 30)
    both = docs.select("doc_id", "text", F.exists(uncut, lambda c: F.length(c["text"]) > ck.HARD_LIMIT_CHARS).alias("long"))
    cut = ck.retrieval_chunks(both.filter("long"))
    return cut.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("text")).cast("long").alias("chars"),
                                     F.max(F.length("text")).cast("long").alias("longest"))


@query("chk_summary_windows", q.with_(q.chunk_ctes(2000, 0), "SELECT doc_id, chunk_index, text, word_count FROM chunks"))
def chk_summary_windows(spark, sf):
    out = ck.summary_chunks(fx.documents(spark, sf))
    return out.select("doc_id", F.col("chunk_index").cast("long"), "text", F.col("word_count").cast("long"))


@query("chk_min_words", q.with_(CHUNKS, "SELECT doc_id, chunk_index, word_count FROM chunks WHERE word_count >= 30"))
def chk_min_words(spark, sf):
    out = ck.searchable(fx.chunks(spark, sf))
    return out.select("doc_id", F.col("chunk_index").cast("long"), F.col("word_count").cast("long"))


@query("chk_stats", q.with_(CHUNKS, """
SELECT doc_id, count(*) AS chunk_count, sum(word_count)::BIGINT AS total_words,
  sum(CASE WHEN word_count >= 30 THEN word_count ELSE 0 END)::BIGINT AS kept_words,
  round_even(100 * (1 - sum(CASE WHEN word_count >= 30 THEN word_count ELSE 0 END) / greatest(sum(word_count), 1)), 0)::BIGINT
    AS reduction_pct
FROM chunks GROUP BY 1"""))
def chk_stats(spark, sf):
    return ck.chunk_stats(ck.retrieval_chunks(fx.documents(spark, sf)))


@query("sch_tokenise", q.with_([*CHUNKS, *q.posting_ctes()], """
SELECT doc_id, chunk_index, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM toks"""))
def sch_tokenise(spark, sf):
    out = se.tokenise(ck.searchable(fx.chunks(spark, sf)))
    return out.select("doc_id", F.col("chunk_index").cast("long"), F.size("tokens").cast("long").alias("n_tokens"),
                      F.array_join("tokens", " ").alias("tokens"))


@query("sch_postings", q.with_(POSTINGS, "SELECT corpus_key, doc_id, chunk_index, term, tf, dl FROM post"))
def sch_postings(spark, sf):
    out = se.postings(ck.searchable(fx.chunks(spark, sf)))
    return out.select("corpus_key", "doc_id", *[F.col(c).cast("long") for c in ("chunk_index", "tf", "dl")], "term")


@query("sch_term_stats", q.with_(POSTINGS, """
SELECT corpus_key, term, df, n_chunks, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM stats"""))
def sch_term_stats(spark, sf):
    out = se.term_stats(ck.searchable(fx.chunks(spark, sf)))
    return out.select("corpus_key", "term", "df", "n_chunks", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


def _keyword_hits(spark, sf):
    """Every positive score, for the scaling of whole lists."""
    chunks = se.placed(ck.searchable(fx.chunks(spark, sf)))
    return se.bm25(chunks, se.term_stats(chunks), fx.benchmark_queries(spark, sf))


@query("sch_bm25", q.with_([*ASKED, q.bm25_cte(), q.top("kw", "bm25", 20, "kw_top")], """
SELECT query_id, doc_id, chunk_index, bm25, rank FROM kw_top"""))
def sch_bm25(spark, sf):
    index, stats = se.write_keywords(ck.searchable(fx.chunks(spark, sf)), scratch_folder(spark, "keywords"))
    top = se.keyword_top(index, stats, fx.benchmark_queries(spark, sf), 2 * se.TOP_K)
    return top.select("query_id", "doc_id", F.col("chunk_index").cast("long"), "bm25",
                      F.col("rank").cast("long"))


_LEFT = q.posting_ctes("chunks WHERE word_count >= 30 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")


def _grown_corpus(spark, sf):
    """All documents added in three batches, and the toxic ones erased after the second."""
    folder = scratch_folder(spark, "corpus")
    docs = fx.documents(spark, sf).withColumnRenamed("source", "corpus_key")
    toxic = fx.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    third = F.pmod(F.col("doc_id"), F.lit(3))
    for k in (0, 1):
        cp.add(spark, folder, docs.filter(third == k), f"third{k}")
    cp.erase(spark, folder, toxic, "toxic")
    cp.add(spark, folder, docs.filter(third == 2).join(toxic, "doc_id", "left_anti"), "third2")
    return cp.opened(spark, folder)


@query("sch_stats_merged", q.with_([*CHUNKS, *_LEFT], """
SELECT corpus_key, term, df, n_chunks, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM stats"""))
def sch_stats_merged(spark, sf):
    """Term statistics as the sum of three batches and an erasure."""
    out = _grown_corpus(spark, sf).stats()
    return out.select("corpus_key", "term", "df", "n_chunks", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


@query("cat_erase_search", q.with_([*CHUNKS, *_LEFT, *q.query_ctes(fx.BENCHMARK_QUERIES), *q.hybrid_ctes()], """
SELECT query_id, doc_id, chunk_index, round(semantic_score, 6) AS semantic_score, round(bm25_score, 6) AS bm25_score, hybrid_score, source, rank FROM ranked"""))
def cat_erase_search(spark, sf):
    """Search after an erasure: postings, vectors and statistics have forgotten the toxic documents."""
    return _rounded(hy.over_tables(_grown_corpus(spark, sf).index(), fx.benchmark_queries(spark, sf)))


@query("sch_semantic", """
WITH q AS (SELECT label AS query_id, list(embedding) AS vs FROM embeddings GROUP BY 1),
qm AS (SELECT query_id, [list_avg([v[i] FOR v IN vs])::FLOAT FOR i IN range(1, 65)] AS qv FROM q),
s AS (SELECT query_id, vec_id AS doc_id, (1 + round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 9)) / 2 AS sim
  FROM embeddings, qm)
SELECT query_id::BIGINT AS query_id, doc_id, round(sim, 5) AS similarity, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def sch_semantic(spark, sf):
    """All vectors against one query vector per label (the label's mean)."""
    from dossierlake.operators import classify as cl
    vectors = fx.table(spark, sf, "embeddings")
    asked = cl.centroids(vectors, "label").select(F.col("label").cast("long").alias("query_id"),
                                                  F.col("centroid").cast("array<float>").alias("embedding"))
    chunked = vectors.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    hits = se.best(se.semantic(chunked, asked, 2 * se.TOP_K), "similarity", 2 * se.TOP_K)
    return hits.select("query_id", "doc_id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long"))


@query("sch_cosine", """
WITH c AS (SELECT label, [list_avg([v[i] FOR v IN vs]) FOR i IN range(1, 65)] AS cv
  FROM (SELECT label, list(embedding::DOUBLE[]) AS vs FROM embeddings GROUP BY 1))
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], cv), 6) AS cosine FROM embeddings JOIN c USING (label)""")
def sch_cosine(spark, sf):
    from dossierlake.operators import classify as cl
    vectors = fx.table(spark, sf, "embeddings")
    pairs = vectors.join(cl.centroids(vectors, "label"), "label")
    return pairs.select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("centroid")), 6).alias("cosine"))


@query("sch_minmax", q.with_([*ASKED, q.bm25_cte(), q.scaled("kw", "bm25", "keyword", "kw_s")], """
SELECT query_id, doc_id, chunk_index, round(keyword, 6) AS keyword FROM kw_s"""))
def sch_minmax(spark, sf):
    hits = _keyword_hits(spark, sf)
    out = se.minmax(hits, "bm25", "keyword")
    return out.select("query_id", "doc_id", F.col("chunk_index").cast("long"), F.round("keyword", 6).alias("keyword"))


def _rounded(df):
    return df.select("query_id", "doc_id", F.col("chunk_index").cast("long"), *[F.round(c, 6).alias(c) for c in ("semantic_score", "bm25_score")],
                     "hybrid_score", "source", F.col("rank").cast("long"))


_RANKED = """SELECT query_id, doc_id, chunk_index, round(semantic_score, 6) AS semantic_score,
  round(bm25_score, 6) AS bm25_score, hybrid_score, source, rank FROM ranked"""


@query("sch_hybrid", q.with_([*ASKED, *q.hybrid_ctes()], _RANKED))
def sch_hybrid(spark, sf):
    return _rounded(hy.over_tables(fx.index(spark, sf), fx.benchmark_queries(spark, sf)))
