"""The document registry: listing, lookup, filters, erasure, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.functions import text as tx
from dossierlake.session import broadcast_if_small, materialise

# The closed list of document types and the page sizes of the two lists.
DOC_TYPES = ("memoire", "programme", "rc", "unspecified")
DOCUMENT_PAGE, PROJECT_PAGE = 100, 50


def list_documents(registry: DataFrame) -> DataFrame:
    """All rows with their total number."""
    return registry.withColumn("total", F.lit(registry.count()).cast("long"))


def get_documents(registry: DataFrame, ids: DataFrame, order: str) -> DataFrame:
    """The first registered row of each requested id; nulls where there is none.

    min_by combines on the map side, so an id registered very often is no hot spot.
    """
    fields = [c for c in registry.columns if c not in ("doc_id", order)]
    wanted = ids.select("doc_id").distinct()
    some = registry.join(broadcast_if_small(wanted), "doc_id", "left_semi")
    first = some.groupBy("doc_id").agg(F.min_by(F.struct(*fields), order).alias("_row"))
    found = wanted.join(first, "doc_id", "left")
    return found.select("doc_id", F.col("_row").isNotNull().alias("found"), *[F.col(f"_row.{f}").alias(f) for f in fields])


def full_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored text of each requested id, null if it was never parsed."""
    wanted = ids.select("doc_id").distinct()
    return wanted.join(docs.select("doc_id", F.col("text").alias("full_text")), "doc_id", "left")


def erase(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """New versions of all tables without the requested documents."""
    gone = broadcast_if_small(requests.select("doc_id").distinct())
    return {name: df.join(gone, "doc_id", "left_anti") for name, df in tables.items()}


def where(condition: dict) -> Column:
    """A nested equality map as a predicate, which the scan can use for pushdown.

    A missing key never equals a value; a null value asks for the missing key.
    """
    if "$and" in condition:
        clauses = [where(c) for c in condition["$and"]]
    else:
        clauses = [F.col(k).isNull() if v is None else F.col(k).eqNullSafe(F.lit(v)) for k, v in condition.items()]
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def doc_scope(rows: DataFrame, ids: DataFrame, condition: dict | None = None) -> DataFrame:
    """Rows of the listed documents that also meet the condition; an empty list gives nothing."""
    kept = rows.filter(where(condition)) if condition else rows
    return kept.join(broadcast_if_small(ids.select("doc_id").distinct()), "doc_id", "left_semi")


def search_box(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring over several columns; an empty text keeps all."""
    needle = F.lower(tx.strip(F.lit(text)))
    tests = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), needle) for c in columns]
    return rows.filter(reduce(lambda a, b: a | b, tests))


# Rows up to which a page is cut from a top-n.
EARLY_ROWS = 10_000


def number_rows(rows: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Global 1-based positions in a total order, without a single-task window.

    Rows are range-partitioned and sorted once; each row's place is its place in its
    partition plus the sizes of the partitions before. The sorted rows are checkpointed,
    as sampled ranges must not be drawn twice.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33).alias("_task")
    sizes = sorted_rows.groupBy(task).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = sorted_rows.withColumn("_task", F.shiftright("_at", 33)).join(F.broadcast(starts), "_task")
    in_task = F.col("_at") - F.shiftleft(F.col("_task").cast("long"), 33)
    return placed.withColumn(out, F.col("_start") + in_task + 1).drop("_at", "_task", "_start")


def paginate(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Adds `position` and `page_no` (from 1) to every row."""
    return number_rows(rows, order).withColumn("page_no", F.ceil(F.col("position") / size).cast("long"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; the number is brought into 1..last page.

    A page that ends within the first `EARLY_ROWS` rows comes from a top-n of that length; later ones number all rows.
    """
    last = max(1, -(-rows.count() // size))
    number = min(max(number, 1), last)
    if number * size > EARLY_ROWS:
        return paginate(rows, order, size).filter(F.col("page_no") == number)
    top = rows.orderBy(*order).limit(number * size)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))  # EARLY_ROWS rows at most
    return placed.withColumn("page_no", F.ceil(F.col("position") / size).cast("long")).filter(F.col("page_no") == number)
