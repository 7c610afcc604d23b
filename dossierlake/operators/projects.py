"""Projects and their documents. Changes come as tables of requests and give the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.session import broadcast_if_small

DEFAULT_STATUS = "active"
PATCHABLE = ("name", "client_name", "status")


def nested_documents(docs: DataFrame, block: int, fields: tuple[str, ...] = ("doc_id", "doc_type")) -> DataFrame:
    """(project_id, block_no, n_documents, documents[]): nested rows in blocks of about `block`.

    For callers who want lists: a project of any size is spread over as many rows as it needs.
    """
    counts = docs.groupBy("project_id").agg(F.count("*").alias("n_documents"))
    sized = docs.join(counts, "project_id")
    n_blocks = F.ceil(F.col("n_documents") / block).cast("long")
    blocks = sized.withColumn("block_no", F.pmod(F.xxhash64("doc_id"), n_blocks))
    return blocks.groupBy("project_id", "block_no").agg(
        F.first("n_documents").alias("n_documents"),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("documents"))


def list_projects(projects: DataFrame, docs: DataFrame) -> DataFrame:
    """Projects, newest first, with one row per document (nulls where there are none) and their number."""
    counts = docs.groupBy("project_id").agg(F.count("*").alias("n_documents"))
    counted = projects.join(counts, "project_id", "left").join(docs.select("project_id", "doc_id", "doc_type"), "project_id", "left")
    return counted.select(*projects.columns, F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "doc_id", "doc_type").orderBy(
        F.desc("created_at"), "project_id", "doc_id")


def get_projects(projects: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The requested projects with their documents; the id filter goes below the joins."""
    wanted = broadcast_if_small(ids.select("project_id").distinct())
    return list_projects(projects.join(wanted, "project_id", "left_semi"), docs.join(wanted, "project_id", "left_semi"))


def create_projects(projects: DataFrame, requests: DataFrame, now: Column | None = None) -> DataFrame:
    """Appends requested projects with defaults."""
    now = F.current_timestamp() if now is None else now
    new = requests.select(F.expr("uuid()").alias("project_id"), "name", "client_name",
                          F.lit(DEFAULT_STATUS).alias("status"), now.alias("created_at"), now.alias("updated_at"))
    return projects.withColumn("project_id", F.col("project_id").cast("string")).unionByName(new)


def attach_documents(docs: DataFrame, requests: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return docs.unionByName(requests.select("project_id", "doc_id", F.coalesce("doc_type", F.lit("unspecified")).alias("doc_type"),
                                            now.alias("added_at")))


def update_projects(projects: DataFrame, patches: DataFrame) -> DataFrame:
    """Applies patches(project_id, seq, at, fields map): only supplied fields change, nulls included.

    Later patches of a project win field by field.
    """
    given = {f: F.map_contains_key("fields", F.lit(f)) for f in PATCHABLE}
    folded = patches.groupBy("project_id").agg(
        F.max("at").alias("_at"),
        *[F.max_by(F.when(given[f], F.struct(F.col("fields")[f].alias("v"))), F.when(given[f], F.col("seq"))).alias(f"_{f}")
          for f in PATCHABLE])
    joined = projects.join(folded, "project_id", "left")
    new = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f)) for f in PATCHABLE}
    new["updated_at"] = F.coalesce("_at", "updated_at")
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in projects.columns])


def detach_documents(docs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining pairs, requests naming no pair)."""
    keys = ["project_id", "doc_id"]
    asked = broadcast_if_small(requests.select(*keys).distinct())
    return docs.join(asked, keys, "left_anti"), requests.join(docs, keys, "left_anti")


def delete_projects(projects: DataFrame, docs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the projects; the documents themselves stay elsewhere."""
    gone = broadcast_if_small(requests.select("project_id").distinct())
    return projects.join(gone, "project_id", "left_anti"), docs.join(gone, "project_id", "left_anti")


def dangling(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference does not exist."""
    return rows.join(known.select(key).distinct(), key, "left_anti")
