"""Review issues of documents: parsing, filters, acceptance, applying corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions.arrays import rows_of

# The closed lists, and the issue types each kind of review looks for.
ISSUE_TYPES = ("ERREUR_REDACTION", "ERREUR_FACTUELLE", "REDONDANCE", "INCOHERENCE_INTERNE", "INCOHERENCE_EXTERNE", "SUGGESTION")
SEVERITIES = ("CRITIQUE", "MAJEUR", "MINEUR")
REVIEW_FOCUS = {
    "full": ISSUE_TYPES,
    "redaction": ("ERREUR_REDACTION", "REDONDANCE"),
    "coherence": ("INCOHERENCE_INTERNE", "INCOHERENCE_EXTERNE"),
    "factual": ("ERREUR_FACTUELLE",),
}
MAIN_DOCUMENT = "main"

_FIELDS = ("id", "type", "severity", "original_excerpt", "explanation", "suggestion")
_SCHEMA = "struct<summary:string,issues:array<struct<" + ",".join(f"{f}:string" for f in (*_FIELDS, "source_document")) + ">>>"


def issue_list(json: Column) -> Column:
    """Valid issues of one review as an array; null when the answer is no JSON object."""
    issues = F.from_json(json, _SCHEMA)["issues"]

    def valid(i):
        filled = F.lit(True)
        for f in _FIELDS:
            filled = filled & i[f].isNotNull()
        return filled & i["type"].isin(*ISSUE_TYPES) & i["severity"].isin(*SEVERITIES)

    return F.transform(F.filter(issues, valid), lambda i: F.struct(
        *[i[f].alias(f) for f in _FIELDS], F.coalesce(i["source_document"], F.lit(MAIN_DOCUMENT)).alias("source_document")))


def parse_issues(reviews: DataFrame, json: str = "response") -> DataFrame:
    """(doc_id, issue_no, id, type, severity, original_excerpt, explanation, suggestion, source_document)."""
    rows = rows_of(reviews, issue_list(F.col(json)), "issue_no", "_i", ("doc_id",))
    return rows.select("doc_id", "issue_no", "_i.*")


def in_focus(issues: DataFrame, review_type: Column) -> DataFrame:
    """Issues of the types the review asked for."""
    allowed = F.lit(False)
    for kind, types in REVIEW_FOCUS.items():
        allowed = allowed | ((review_type == kind) & F.col("type").isin(*types))
    return issues.filter(allowed)


def by_type(issues: DataFrame, wanted: str) -> DataFrame:
    return issues.filter(F.col("type") == wanted)


def by_severity(issues: DataFrame, wanted: str) -> DataFrame:
    return issues.filter(F.col("severity") == wanted)


def count_by_type(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id").pivot("type", list(ISSUE_TYPES)).count()


def count_by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id").pivot("severity", list(SEVERITIES)).count()


def critical_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "CRITIQUE").alias("critical"))


def accepted(issues: Column, accepted_ids: Column) -> Column:
    """Issues to apply: all for a null list, none for an empty one, else the listed ids."""
    return F.when(accepted_ids.isNull(), issues).otherwise(F.filter(issues, lambda i: F.array_contains(accepted_ids, i["id"])))


def apply_corrections(docs: DataFrame, issues: Column, text: str = "text") -> DataFrame:
    """(doc_id, corrected_text, applied_issue_ids, change_log) by literal replacement in id order.

    The log has the issues whose excerpt was there when their turn came.
    """
    ordered = F.array_sort(F.filter(issues, lambda i: i["original_excerpt"] != ""), lambda a, b: F.when(
        a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    log = "array<struct<id:string,original:string,correction:string>>"
    given = docs.select("doc_id", F.col(text).alias("_t"), ordered.alias("_i"))

    def step(acc, i):
        there = F.contains(acc["text"], i["original_excerpt"])
        entry = F.array(F.struct(i["id"].alias("id"), i["original_excerpt"].alias("original"), i["suggestion"].alias("correction")))
        return F.struct(F.replace(acc["text"], i["original_excerpt"], i["suggestion"]).alias("text"),
                        F.when(there, F.concat(acc["log"], entry)).otherwise(acc["log"]).alias("log"))

    start = F.struct(F.col("_t").alias("text"), F.array().cast(log).alias("log"))
    done = given.select("doc_id", F.transform("_i", lambda i: i["id"]).alias("applied_issue_ids"), F.aggregate("_i", start, step).alias("_r"))
    return done.select("doc_id", F.col("_r.text").alias("corrected_text"), "applied_issue_ids", F.col("_r.log").alias("change_log"))
