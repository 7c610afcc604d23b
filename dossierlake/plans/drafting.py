"""Filling the sections of outlines from earlier documents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from dossierlake.functions import models as md, vectors as vx
from dossierlake.functions.arrays import rows_of
from dossierlake.operators import classify as cl, markup as mk, prompts as pr, search as se
from dossierlake.plans import hybrid as hy
from dossierlake.session import materialise, stored

# Hits whose texts are moved to their queries at a time.
HITS_AT_A_TIME = 1_000_000


def lane_chunks(chunks: DataFrame, lane: str) -> DataFrame:
    """Chunks a lane may use: earlier documents of all projects, or one project's programme."""
    return chunks.filter(F.col("doc_type") == lane)


def lane_ranks(queries: DataFrame, chunks: DataFrame, k: int = se.TOP_K, model=vx.hashed_vectors) -> DataFrame:
    """Hybrid hits of queries(query_id, lane, project_id, text) within their lanes, with lane and without text."""
    free = queries.filter(F.col("lane") == cl.MEMOIRE).select("query_id", "text")
    bound = queries.filter(F.col("lane") == cl.PROGRAMME).select("query_id", F.col("project_id").alias("corpus_key"), "text")
    memoire = hy.hybrid(lane_chunks(chunks, cl.MEMOIRE), free, k, model).withColumn("lane", F.lit(cl.MEMOIRE))
    # Within a project the project is the corpus, so the lane filter is an equi-join.
    own = lane_chunks(chunks, cl.PROGRAMME).withColumn("corpus_key", F.col("project_id"))
    programme = hy.hybrid(own, bound, k, model).withColumn("lane", F.lit(cl.PROGRAMME))
    return memoire.unionByName(programme)


def with_files(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hy.with_text(hits, chunks.select("doc_id", "chunk_index", "text", "file_name"))


def lane_hits(queries: DataFrame, chunks: DataFrame, k: int = se.TOP_K, model=vx.hashed_vectors) -> DataFrame:
    """`lane_ranks` with text."""
    return with_files(lane_ranks(queries, chunks, k, model), chunks)


def draft_sections(sections: DataFrame, chunks: DataFrame, lanes: dict, boilerplate: list[str], model=md.digest,
                   embedder=vx.hashed_vectors, ask=None, steer: str = "", k: int = se.TOP_K,
                   max_tokens: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(filled, sources) for sections(section_id, project_id, title, content); a failed model call leaves its segment
    empty and its error in the row.

    Sections without guidance keep their text. The others are classified; each guidance
    segment is searched in its lane and written from what was found; segments come together
    again in order.
    """
    cut = stored(sections.select("section_id", "project_id", "title", "content", mk.guidance_segments(F.col("content")).alias("_s")), "cut")
    guided = F.exists("_s", lambda s: s["type"] == "guidance")
    kept = cut.filter(~guided).select("section_id", "content", F.lit(None).cast("string").alias("lane"), F.lit(None).cast("string").alias("method"),
                                        F.lit(None).cast("string").alias("error"))
    # Written tables between the stages keep the later plans small and each model call single.
    classified = materialise(cl.cascade(cut.filter(guided).select("section_id", "project_id", "title", "_s"), boilerplate, lanes, embedder, ask))
    segments = rows_of(classified, F.col("_s"), "seg_no", "_x", ("section_id", "project_id", "title", "lane", "method")).select(
        "section_id", "project_id", "title", "lane", "method", "seg_no", F.col("_x.type").alias("type"), F.col("_x.content").alias("seg"))
    query_id = F.concat_ws(":", F.col("section_id").cast("string"), F.col("seg_no").cast("string"))
    guidance = segments.filter(F.col("type") == "guidance").withColumn("query_id", query_id)
    queries = guidance.withColumn("text", F.concat("title", F.lit(". "), "seg"))
    # Hits are written without the texts. These meet them where they are read, for some queries at a time, as texts take most of the room.
    ranks = stored(lane_ranks(queries, chunks, k, embedder), "hits")
    pieces = -(-ranks.count() // HITS_AT_A_TIME) or 1
    written = []
    for i in range(pieces):
        own, found = (df.filter(F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == i) if pieces > 1 else df for df in (queries, ranks))
        contexts = se.context(with_files(found, chunks), own.filter(F.col("lane") != cl.BOILERPLATE))
        prompted = own.join(contexts, "query_id", "left")
        prompt = pr.section_prompt(F.col("title"), F.col("seg"), F.col("context"), F.lit(steer))
        written.append(stored(prompted.withColumn("_r", md.generate(prompt, model, 0.3, max_tokens)).select(
            "section_id", "lane", "method", "seg_no", F.coalesce(F.trim("_r.content"), F.lit("")).alias("seg"), F.col("_r.error").alias("error")), "written"))
    written = functools.reduce(DataFrame.unionByName, written)
    plain = segments.filter(F.col("type") == "text").select("section_id", "lane", "method", "seg_no", "seg", F.lit(None).cast("string").alias("error"))
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", "seg")))
    filled = written.unionByName(plain).groupBy("section_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["seg"]), "\n\n").alias("content"), F.first("lane").alias("lane"), F.first("method").alias("method"),
        F.min("error").alias("error"))
    sources = se.source_records(with_files(ranks, chunks)).join(queries.select("query_id", "section_id", "seg_no"), "query_id").select(
        "section_id", "seg_no", "rank", "doc_id", "chunk_index", "file_name", "lane", "hybrid_score")
    return kept.unionByName(filled.select("section_id", "content", "lane", "method", "error")), sources
