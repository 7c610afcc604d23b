"""The wanted section of a document by heading, else by search inside the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierlake.functions import text as tx, vectors as vx, vocabulary as vo
from dossierlake.operators import chunking as ck, search as se, sections as sc
from dossierlake.plans import hybrid as hy
from dossierlake.session import materialise

FALLBACK_HITS = 3


def search_sections(docs: DataFrame, dictionary: dict, text: str = "text", hint: str | None = None, model=vx.hashed_vectors) -> DataFrame:
    """(doc_id, text): the best chunks for the section's category, in document order, if long enough."""
    named = docs.select("doc_id", F.col(text).alias("text"), (F.col(hint) if hint else F.lit(None).cast("string")).alias("_hint"))
    category = vo.category_of(F.col("_hint"), dictionary)
    asked = F.coalesce(*[F.when(category == c, t) for c, t in vo.FALLBACK_QUERIES.items()])
    queries = named.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("corpus_key"), asked.alias("text"))
    chunks = materialise(ck.retrieval_chunks(named.select("doc_id", "text")).withColumn("corpus_key", F.col("doc_id")))
    queries = materialise(queries)
    hits = se.min_score(hy.search_given_chunks(chunks, queries, FALLBACK_HITS, model), se.MIN_SCORE_FALLBACK)
    found = hy.with_text(hits, chunks.select("doc_id", "chunk_index", "text"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    joined = found.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\n\n").alias("text"))
    return joined.filter(tx.word_count(F.col("text")) >= sc.MIN_SECTION_WORDS)


def find_sections(docs: DataFrame, dictionary: dict, text: str = "text", hint: str | None = None, default: str | None = None,
                  model=vx.hashed_vectors) -> DataFrame:
    """(doc_id, source, heading, score, text) with source heading_match, rag_fallback or fallback_failed."""
    # Both stages end in a written table: the later plans stay small and nothing is matched or searched twice.
    matched = materialise(sc.good_enough(sc.match_sections(docs, dictionary, text=text, hint=hint, default=default)))
    keep = ["doc_id", text, *([hint] if hint else [])]
    left = docs.select(*keep).join(matched.select("doc_id"), "doc_id", "left_anti")
    searched = search_sections(left, dictionary, text, hint, model)
    none = F.lit(None)
    by_search = left.select("doc_id").join(searched, "doc_id", "left").select(
        "doc_id", F.when(F.col("text").isNull(), "fallback_failed").otherwise("rag_fallback").alias("source"),
        none.cast("string").alias("heading"), none.cast("double").alias("score"), "text")
    return matched.select("doc_id", F.lit("heading_match").alias("source"), "heading", "score", "text").unionByName(by_search)
