"""Structured rows out of whole documents: groups of text are asked, short answers are asked once more, rows become one result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import models as md
from dossierlake.operators import extraction as ex, markup as mk
from dossierlake.session import materialise

TRIES, ANSWER_TOKENS, HEADER_TOKENS, HEADER_WORDS = 2, 4000, 500, 1000
TEXT_MARK = "\n\nTEXTE :\n"
# A document's rows are in the order of groups and rows; a group has fewer rows than this.
_GROUP_ROWS = 1 << 32


def row_prompt(text: Column, mapping: dict[str, str]) -> Column:
    """Asks for one object per row, with the mapping's target fields, for columns that are named as its sources."""
    head = "Colonnes : " + ", ".join(mapping) + "\nChamps : " + ", ".join(mapping.values()) + "\nUn tableau JSON, un objet par ligne ; [] si rien."
    return F.concat(F.lit(head + TEXT_MARK), text)


def header_prompt(text: Column) -> Column:
    return F.concat(F.lit("Un objet JSON avec : " + ", ".join(ex.HEADER_FIELDS) + TEXT_MARK), text)


def ask_groups(groups: DataFrame, mapping: dict[str, str], model=md.digest, tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """(rows, attempts) of groups(doc_id, group_no, group_text).

    Every group is asked once; one whose answer has fewer rows than its text lets expect is asked again, up to `tries` times in
    all, and no other group is. attempts(doc_id, group_no, attempt, n_rows, expected, error) lists all calls;
    rows(doc_id, group_no, row_no, fields) are those of the attempt that counts: the first whole one, else the last. Each
    round of answers is stored before it is judged, so a call is made once. A failed call has no rows and an error.
    """
    targets = list(mapping.values())
    pending = groups.select("doc_id", "group_no", "group_text", ex.expected_rows(F.col("group_text")).alias("expected"))
    made, found = [], []
    for attempt in range(1, tries + 1):
        asked = materialise(pending.withColumn("_r", md.generate(row_prompt(F.col("group_text"), mapping), model, 0.0, ANSWER_TOKENS)))
        rows = ex.answer_rows(ex.repair_json(asked.select("doc_id", "group_no", F.coalesce("_r.content", F.lit("")).alias("response"))), targets, ("doc_id", "group_no"))
        rows = rows.select("doc_id", "group_no", F.lit(attempt).alias("attempt"), "row_no", "fields")
        counts = rows.groupBy("doc_id", "group_no").agg(F.count("*").alias("n_rows"))
        judged = materialise(asked.select("doc_id", "group_no", "group_text", "expected", F.col("_r.error").alias("error"))
                             .join(counts, ["doc_id", "group_no"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))))
        made.append(judged.select("doc_id", "group_no", F.lit(attempt).alias("attempt"), "n_rows", "expected", "error"))
        found.append(rows)
        pending = judged.filter("n_rows < expected").select("doc_id", "group_no", "group_text", "expected")
    attempts, rows = reduce(DataFrame.unionByName, made), reduce(DataFrame.unionByName, found)
    chosen = ex.keep_attempts(attempts).select("doc_id", "group_no", "attempt")
    return rows.join(chosen, ["doc_id", "group_no", "attempt"]).drop("attempt"), attempts


def whole_document(rows: DataFrame) -> DataFrame:
    """(doc_id, row_no, fields): the rows of all groups of a document in order, each once."""
    return ex.dedupe(rows.select("doc_id", (F.col("group_no").cast("long") * _GROUP_ROWS + F.col("row_no")).alias("row_no"), "fields"))


def headers(docs: DataFrame, model=md.digest) -> DataFrame:
    """The header fields of each of docs(doc_id, text), asked of its first words."""
    head = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, HEADER_WORDS), " ")
    answered = docs.select("doc_id", md.generate(header_prompt(head), model, 0.0, HEADER_TOKENS).alias("_r"))
    return ex.header_fields(ex.repair_json(answered.select("doc_id", F.coalesce("_r.content", F.lit("")).alias("response"))))


def extract(docs: DataFrame, mapping: dict[str, str], model=md.digest, tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """(results, attempts) of cleaned docs(doc_id, text): results(doc_id, header, rows, stats, result), result being all of it as JSON.

    A document without text or rows has an empty list and zero totals. mapping names the source column of each target field.
    """
    rows, attempts = ask_groups(mk.extraction_groups(docs), mapping, model, tries)
    kept = materialise(whole_document(rows))
    # A document's rows are a list in its row, as its text is.
    names, values = F.array(*map(F.lit, mapping.values())), F.array(*[F.col("fields")[t] for t in mapping.values()])
    listed = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", values.alias("values")))).alias("_r")).select(
        "doc_id", F.transform("_r", lambda r: F.map_from_arrays(names, r["values"])).alias("rows"))
    stats = ex.outcome_stats(kept)
    stats = stats.select("doc_id", F.struct("total", "presence", "absence", "unknown").alias("stats"))
    head = headers(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model).select("doc_id", F.struct(*ex.HEADER_FIELDS).alias("header"))
    none = F.struct(F.lit(0).cast("long").alias("total"), *[F.lit(None).cast("long").alias(k) for k in ("presence", "absence", "unknown")])
    whole = (docs.select("doc_id").join(head, "doc_id", "left").join(listed, "doc_id", "left").join(stats, "doc_id", "left")
             .select("doc_id", "header", F.coalesce("rows", F.array().cast("array<map<string,string>>")).alias("rows"), F.coalesce("stats", none).alias("stats")))
    return whole.withColumn("result", F.to_json(F.struct("header", "rows", "stats"), {"ignoreNullFields": "false"})), attempts
