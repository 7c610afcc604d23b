"""Rows out of semi-structured answers: parsing, shapes, completeness, duplicates, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import text as tx
from dossierlake.functions.arrays import rows_of

# Fixed values.
HEADER_FIELDS = ("adresse_immeuble", "reference_dossier", "date_reperage", "operateur", "laboratoire")
OUTCOME_FIELD = "resultat"
MISSING_ANSWER = "Information non disponible"

_WORD = r"[\p{L}\p{N}_]"
_ROW_ID = rf"(?<!{_WORD})[A-Z]{{1,5}}-?\p{{Nd}}{{2,5}}(?!{_WORD})"
_PRESENT_CODE = rf"(?<!{_WORD})(?:ep|ac1|ac2)(?!{_WORD})"


def _kind(value: Column) -> Column:
    """list, object or scalar."""
    schema = F.schema_of_variant(value)
    return F.when(F.startswith(schema, F.lit("ARRAY")), "list").when(F.startswith(schema, F.lit("OBJECT")), "object").otherwise("scalar")


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def repair_json(answers: DataFrame, response: str = "response") -> DataFrame:
    """Adds json (usable text or null) and from_span (it was an object cut out of other text)."""
    bare = F.regexp_replace(F.regexp_replace(tx.strip(F.col(response)), f"```json{tx.WS}*", ""), f"```{tx.WS}*", "")
    cut = answers.withColumn("_c", tx.strip(bare)).withColumn(
        "_l", F.regexp_extract("_c", r"(?s)\[.*\]", 0)).withColumn("_o", F.regexp_extract("_c", r"(?s)\{.*\}", 0))

    def usable(name: str) -> Column:
        return (F.col(name) != "") & F.try_parse_json(F.col(name)).isNotNull()

    chosen = (F.when(usable("_c"), F.struct(F.col("_c").alias("json"), F.lit(False).alias("span")))
              .when(usable("_l"), F.struct(F.col("_l").alias("json"), F.lit(False).alias("span")))
              .when(usable("_o"), F.struct(F.col("_o").alias("json"), F.lit(True).alias("span"))))
    found = cut.withColumn("_x", chosen)
    return found.select(*answers.columns, F.col("_x.json").alias("json"), F.coalesce("_x.span", F.lit(False)).alias("from_span"))


def _row(value: Column) -> Column:
    return _as(value, "map<string,string>")


def answer_rows(answers: DataFrame, expected: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, row_no, fields map) from repaired answers of any accepted shape.

    A list of objects, one flat object, an object of equally long columns, or an object
    around a list. Order follows the text.
    """
    keys = F.array(*[F.lit(e) for e in expected])
    parsed = answers.select(*keep, "json", "from_span", F.try_parse_json("json").alias("_v"))
    opened = parsed.select(*keep, "from_span", _as(F.col("_v"), "array<variant>").alias("_list"),
                           _as(F.col("_v"), "map<string,variant>").alias("_map"), F.json_object_keys("json").alias("_keys"))
    values = opened.withColumn("_kv", F.transform("_keys", lambda k: F.struct(k.alias("k"), F.col("_map")[k].alias("v"))))
    typed = values.withColumn("_kinds", F.transform("_kv", lambda e: F.coalesce(_kind(e["v"]), F.lit("scalar"))))
    lists = typed.withColumn("_ls", F.filter(
        F.zip_with("_kv", "_kinds", lambda e, t: F.when(t == "list", F.struct(e["k"].alias("k"), _as(e["v"], "array<variant>").alias("v")))),
        lambda e: e.isNotNull()))

    def candidates(items: Column) -> Column:
        objects = F.filter(items, lambda i: F.coalesce(_kind(i) == "object", F.lit(False)))
        return F.filter(F.transform(objects, _row_of), lambda r: F.arrays_overlap(F.map_keys(r), keys))

    def _row_of(i):
        return _row(i)

    flat = ~F.exists("_kinds", lambda t: t != "scalar")
    plain = F.forall("_ls", lambda e: F.forall(e["v"], lambda i: F.coalesce(_kind(i), F.lit("scalar")) == "scalar"))
    sizes = F.transform("_ls", lambda e: F.size(e["v"]))
    n = F.array_max(sizes)
    even = F.size(F.array_distinct(sizes)) == 1
    columns = F.transform("_ls", lambda e: F.transform(e["v"], lambda i: i.cast("string")))
    index = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    transposed = F.transform(index, lambda i: F.map_from_arrays(
        F.transform("_ls", lambda e: e["k"]), F.transform(columns, lambda c: F.element_at(c, i))))
    wrapped = F.try_element_at(F.filter(F.transform("_ls", lambda e: candidates(e["v"])), lambda c: F.size(c) > 0), F.lit(1))
    rows = (F.when(F.col("_list").isNotNull(), candidates(F.col("_list")))
            .when(F.col("from_span") & (F.size("_ls") > 0), candidates(F.try_element_at(F.col("_ls"), F.lit(1))["v"]))
            .when(flat, F.array(F.transform_values("_map", lambda k, v: v.cast("string"))))
            .when((F.size("_ls") > 0) & plain, F.when(even, transposed))
            .otherwise(wrapped))
    return rows_of(lists.withColumn("_rows", rows), F.col("_rows"), "row_no", "fields", keep)


def project_mapping(rows: DataFrame, targets: list[str], keep: tuple[str, ...] = ("doc_id", "row_no")) -> DataFrame:
    """Only the mapped target fields, as columns; null where absent."""
    return rows.select(*keep, *[F.col("fields")[t].alias(t) for t in targets])


def expected_rows(col: Column) -> Column:
    """Number of distinct id-like tokens, at least 1."""
    return F.greatest(F.size(F.array_distinct(F.regexp_extract_all(col, F.lit(_ROW_ID), F.lit(0)))), F.lit(1))


def keep_attempts(attempts: DataFrame) -> DataFrame:
    """One attempt per group: the first that has the expected rows, else the last made.

    attempts(doc_id, group_no, attempt, n_rows, expected); the choice combines on the map side.
    """
    passed = F.col("n_rows") >= F.col("expected")
    state = F.struct("attempt", "n_rows", "expected", passed.alias("complete"))
    chosen = attempts.groupBy("doc_id", "group_no").agg(
        F.min_by(F.when(passed, state), F.when(passed, F.col("attempt"))).alias("_ok"), F.max_by(state, "attempt").alias("_last"))
    return chosen.select("doc_id", "group_no", F.explode(F.array(F.coalesce("_ok", "_last"))).alias("_x")).select(
        "doc_id", "group_no", "_x.attempt", "_x.n_rows", "_x.expected", "_x.complete")


def row_key(fields: Column) -> Column:
    """Comparable text of a row's filled fields; null for an empty row."""
    filled = F.map_filter(fields, lambda k, v: v.isNotNull() & (v != "") & (v != "null"))
    pairs = F.array_sort(F.transform(F.map_entries(filled), lambda e: F.struct(
        e["key"].alias("k"), F.lower(tx.strip(e["value"])).alias("v"))))
    return F.when(F.size(filled) > 0, F.to_json(pairs))


def dedupe(rows: DataFrame, group: str = "doc_id") -> DataFrame:
    """First occurrence of each row per document; its row_no keeps the order.

    min_by combines on the map side, so very many copies of one row are no hot spot.
    """
    keyed = rows.withColumn("_key", row_key(F.col("fields"))).filter(F.col("_key").isNotNull())
    first = keyed.groupBy(group, "_key").agg(F.min("row_no").alias("row_no"), F.min_by("fields", "row_no").alias("fields"))
    return first.select(group, "row_no", "fields")


def outcome(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    present = F.contains(low, F.lit("présence")) | F.contains(low, F.lit("presence")) | F.regexp_like(low, F.lit(_PRESENT_CODE))
    absent = F.contains(low, F.lit("absence")) | F.contains(low, F.lit("non détecté")) | F.contains(low, F.lit("non detecte"))
    return F.when(present, "presence").when(absent, "absence").otherwise("unknown")


def outcome_stats(rows: DataFrame) -> DataFrame:
    """Totals per document; outcome counts only where the first row has an outcome field."""
    has = F.min_by(F.map_contains_key("fields", F.lit(OUTCOME_FIELD)), "row_no")
    kind = outcome(F.col("fields")[OUTCOME_FIELD])
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("total"), has.alias("_has"),
                                        *[F.count_if(kind == k).alias(k) for k in ("presence", "absence", "unknown")])
    return counts.select("doc_id", "total", *[F.when(F.col("_has"), F.col(k)).alias(k) for k in ("presence", "absence", "unknown")])


def header_fields(answers: DataFrame) -> DataFrame:
    """The five named header fields of repaired answers; null where absent."""
    fields = F.from_json("json", "map<string,string>")
    return answers.withColumn("_f", fields).select("doc_id", *[F.col("_f")[f].alias(f) for f in HEADER_FIELDS])


def format_report(answers: DataFrame, template: dict, response: str = "response") -> DataFrame:
    """Answers as labelled blocks in template order; the raw text where it holds no JSON object."""
    found = answers.withColumn("_o", F.regexp_extract(response, r"(?s)\{.*\}", 0)).withColumn(
        "_ok", (F.col("_o") != "") & F.try_parse_json("_o").isNotNull()).withColumn("_f", F.from_json("_o", "map<string,string>"))

    def block(section):
        key = F.lit(section["key"])
        value = F.when(F.map_contains_key("_f", key), F.coalesce(F.col("_f")[key], F.lit("None"))).otherwise(MISSING_ANSWER)
        return F.concat(F.lit(f"## {section['label']}\n"), value, F.lit("\n"))

    report = F.concat_ws("\n", F.lit(f"# {template['name']}\n"), *[block(s) for s in template["sections"]])
    return found.select("doc_id", F.when(F.coalesce("_ok", F.lit(False)), report).otherwise(F.col(response)).alias("report"))
