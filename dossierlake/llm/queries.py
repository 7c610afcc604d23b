"""The registered queries of this package, each next to the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake.llm import boilerplate, bpe, exact, importance, interaction, langid, leaks, licences, minhash, mixing, repeats, ring, toxicity
from dossierlake.llm import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_minhash_near_dedup", sql.NEAR_DUPLICATES)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicate_classes(table(spark, sf_dir, "documents"), shingle_words=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op3_ring_sharding")
def ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.place(ring.sized(table(spark, sf_dir, "documents")), shards=16)
    return placed.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_benchmark_decontamination", sql.LEAKS)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda m: F.sequence(m["word"], m["word"] + m["n_words"] - 1)))))
    return found.select(
        "row.doc_id", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query("op10_exact_dedup", sql.EXACT)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(4, 2))
    return toxicity.score(docs, model).select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id", toxicity.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_temperature_mixing")
def temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = mixing.mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.col("source"), most_repeats=4.0)
    return used.select("row.doc_id", "row.source", "n_tokens", "epoch", "place", "weight")


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    away = toxicity.held_out(5, 0)
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs, ~away))
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", away.alias("held_out"), "lang_pred", "score")


@query("op6_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boilerplate.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op8_licence_scan", sql.licences())
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.licence", F.array_join("m.sentences", " ").alias("sentences"), F.col("m.first").cast("long").alias("first"), F.col("m.last").cast("long").alias("last"))


@query("op4_repeated_passages", sql.REPEATS)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated(table(spark, sf_dir, "documents"))
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["n_words"])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["first"], s["n_words"])), " ")
    return found.select("doc_id", listed("spans").alias("spans"), count("spans").alias("n_repeated"), listed("copies").alias("copies"), count("copies").alias("n_copied"))


@query("op11_filter_interaction", sql.INTERACTION)
def filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(interaction.stream(spark, f"{sf_dir}/documents.parquet"), table(spark, sf_dir, "labels"))


@query("op12_bpe")
def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    return both.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_importance_resampling", sql.IMPORTANCE)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")
