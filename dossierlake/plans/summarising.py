"""Map-reduce summaries of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import models as md
from dossierlake.operators import chunking as ck, prompts as pr

MAP_TOKENS, REDUCE_TOKENS = 600, 1800


def summarise(docs: DataFrame, model=md.digest, text: str = "text", emphasis: Column | None = None,
              budget: int = ck.SUMMARY_WORDS, map_tokens: int = MAP_TOKENS, reduce_tokens: int = REDUCE_TOKENS) -> DataFrame:
    """(doc_id, n_parts, summary, error).

    Documents of at most one window go straight to the reduce call. The windows of longer
    ones are spread over the cluster by window, not by document, and only their short
    partial results come together again.
    """
    wish = F.lit(None).cast("string") if emphasis is None else emphasis
    cut = docs.select("doc_id", F.col(text).alias("_t"), wish.alias("_w"), ck.chunk_list(F.col(text), budget, 0).alias("_c"))
    short = cut.filter(F.size("_c") <= 1).select("doc_id", F.size("_c").alias("n_parts"), F.array("_t").alias("_p"), "_w",
                                                 F.lit(None).cast("string").alias("_err"))
    windows = cut.filter(F.size("_c") > 1).select("doc_id", "_w", F.posexplode_outer("_c").alias("n", "c"))
    spread = windows.repartition("doc_id", "n")
    mapped = spread.withColumn("_r", md.generate(pr.map_message(F.col("c.text"), F.col("_w")), model, 0.2, map_tokens))
    parts = mapped.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("n_parts"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("_r.content", F.lit("")).alias("s")))), lambda x: x["s"]).alias("_p"),
        F.first("_w").alias("_w"), F.max("_r.error").alias("_err"))
    ready = short.unionByName(parts)
    done = ready.withColumn("_r", md.generate(pr.reduce_message(F.col("_p"), F.col("_w")), model, 0.2, reduce_tokens))
    return done.select("doc_id", "n_parts", F.col("_r.content").alias("summary"), F.coalesce("_err", "_r.error").alias("error"))
