"""From files and parsed documents to text.

A parsed document is one row: its pages or paragraphs are a list in that row, so
everything here is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlake.functions import text as tx
from dossierlake.functions.arrays import rows_of

# Readers by file suffix.
READERS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx"}
NOT_IMPLEMENTED = (".xlsx", ".xls")

# Labels of the page settings, after lower-casing and accent folding.
PAGE_LABELS = {
    "page debut": "page_start",
    "page de debut": "page_start",
    "debut": "page_start",
    "page start": "page_start",
    "premiere page": "page_start",
    "page fin": "page_end",
    "page de fin": "page_end",
    "fin": "page_end",
    "page end": "page_end",
    "derniere page": "page_end",
}
# Header cells of the mapping table.
SOURCE_HEADERS = ("colonne source", "source column", "colonne", "source")
TARGET_HEADERS = ("colonne normalisee", "champ normalise", "target field", "normalise")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """File listing without contents; column pruning keeps the bytes unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime", "length")


def route_by_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds suffix, reader, upload_allowed and error: an unreadable file is a row, not a failed job."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    reader = F.coalesce(*[F.when(suffix == s, r) for s, r in READERS.items()])
    error = (F.when(reader.isNotNull(), F.lit(None).cast("string"))
             .when(suffix.isin(*NOT_IMPLEMENTED), "not implemented")
             .otherwise("unsupported"))
    return files.select("*", suffix.alias("suffix"), reader.alias("reader"), reader.isNotNull().alias("upload_allowed"),
                        error.alias("error"))


def clean_page(col: Column) -> Column:
    """Without image comments and runs of blank lines."""
    no_images = F.regexp_replace(col, rf"<!--{tx.WS}*image{tx.WS}*-->", "")
    return tx.strip(F.regexp_replace(no_images, r"\n{3,}", "\n\n"))


def page_marker(page: Column) -> Column:
    return F.concat(F.lit("<!-- page "), page.cast("string"), F.lit(" -->"))


def assemble_pages(docs: DataFrame, pages: str = "pages") -> DataFrame:
    """Full text with page markers from pages array<struct<page, text>>, and its sizes."""
    in_order = F.array_sort(F.col(pages))
    marked = F.transform(in_order, lambda p: F.concat(page_marker(p["page"]), F.lit("\n"), clean_page(p["text"])))
    full = docs.select("doc_id", F.size(pages).alias("total_pages"), F.array_join(marked, "\n\n").alias("full_text"))
    return full.select("*", F.length("full_text").alias("char_count"), tx.word_count(F.col("full_text")).alias("word_count"))


def heading_level(style: Column) -> Column:
    """1-9 from a style named `Heading N` or `Titre N`; null for other styles."""
    level = F.coalesce(F.nullif(F.regexp_extract(style, r"^Heading (\d+)$", 1), F.lit("")),
                       F.nullif(F.regexp_extract(style, rf"(?i)^titre{tx.WS}*(\d+)$", 1), F.lit("")))
    # Very long numbers are only deep levels.
    return F.when(F.length(F.ltrim(level, F.lit("0"))) > 9, F.lit(999_999_999)).otherwise(level.try_cast("int"))


def flatten_paragraphs(docs: DataFrame, paragraphs: str = "paragraphs") -> DataFrame:
    """Markdown text from paragraphs array<struct<style, text>>; heading marks are not words."""
    trimmed = F.transform(paragraphs, lambda p: F.struct(heading_level(p["style"]).alias("level"), tx.strip(p["text"]).alias("text")))
    kept = docs.select("doc_id", F.filter(trimmed, lambda p: p["text"] != "").alias("_p"))
    line = F.transform("_p", lambda p: F.when(
        p["level"].isNotNull(), F.concat(F.repeat(F.lit("#"), F.least(p["level"], F.lit(6))), F.lit(" "), p["text"]),
    ).otherwise(p["text"]))
    body = F.array_join(F.transform("_p", lambda p: p["text"]), " ")
    return kept.select("doc_id", F.array_join(line, "\n\n").alias("full_text"), F.lit(1).alias("total_pages"),
                       tx.word_count(body).alias("word_count"))


def html_outline(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, line_no, level, text): headings and paragraphs of web pages in order."""
    tag = r"(?is)<(h[1-6]|p)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p)>"
    names = F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(1))
    inner = F.transform(F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(2)),
                        lambda t: tx.strip(F.regexp_replace(t, r"(?s)<[^>]+>", "")))
    found = F.zip_with(names, inner, lambda n, t: F.struct(
        F.regexp_extract(F.lower(n), r"^h(\d)", 1).try_cast("int").alias("level"), t.alias("text")))
    rows = rows_of(pages, F.filter(found, lambda x: x["text"] != ""), "line_no", "_x", ("page_id",))
    return rows.select("page_id", "line_no", "_x.level", "_x.text")


def outline_markdown(pages: DataFrame, html: str = "html") -> Column:
    """The same lines as one markdown text per page."""
    tag = r"(?is)<(h[1-6]|p)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p)>"
    names = F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(1))
    inner = F.transform(F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(2)),
                        lambda t: tx.collapse_spaces(tx.strip(F.regexp_replace(t, r"(?s)<[^>]+>", ""))))
    text = F.zip_with(names, inner, lambda n, t: F.when(t == "", F.lit("")).when(
        F.lower(n) == "p", t).otherwise(F.concat(F.repeat(F.lit("#"), F.substring(n, 2, 1).cast("int")), F.lit(" "), t)))
    return F.array_join(F.filter(text, lambda t: t != ""), "\n\n")


DICTIONARY_SCHEMA = "map<string,struct<label:string,variants:array<string>,retrieval_lanes:array<string>,needs_retrieval:boolean>>"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Section dictionaries from JSON files, one object per file."""
    return dictionary_variants(spark.read.text(path, wholetext=True), "value")


def dictionary_variants(rows: DataFrame, json: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, entry_no, category, label, needs_retrieval, variant_no, variant); the label is a variant too."""
    entries = F.map_entries(F.from_json(json, DICTIONARY_SCHEMA))
    cats = rows_of(rows, entries, "entry_no", "_e", keep).select(
        *keep, "entry_no", F.col("_e.key").alias("category"), F.col("_e.value.label").alias("label"),
        F.col("_e.value.needs_retrieval").alias("needs_retrieval"), F.col("_e.value.variants").alias("_v"))
    names = F.concat(F.array("label"), F.coalesce("_v", F.array().cast("array<string>")))
    return rows_of(cats, names, "variant_no", "variant", (*keep, "entry_no", "category", "label", "needs_retrieval"))


def config_pages(rows: DataFrame) -> DataFrame:
    """(doc_id, page_start, page_end) from two-column sheet rows(doc_id, ord, a, b).

    The last usable value of a label counts; both are dropped when they are in the wrong order.
    """
    label = F.coalesce(*[F.when(tx.strip(tx.fold_accents(F.col("a"))) == k, v) for k, v in PAGE_LABELS.items()])
    number = F.expr("try_cast(try_cast(trim(b) as double) as int)")
    usable = rows.select("doc_id", "ord", label.alias("label"), number.alias("n")).filter((F.col("n") >= 1) & F.col("label").isNotNull())
    ends = {e: F.max_by(F.when(F.col("label") == e, F.col("n")), F.when(F.col("label") == e, F.col("ord"))) for e in ("page_start", "page_end")}
    found = usable.groupBy("doc_id").agg(*[c.alias(e) for e, c in ends.items()])
    wrong = F.coalesce(F.col("page_start") > F.col("page_end"), F.lit(False))
    return found.select("doc_id", *[F.when(~wrong, F.col(e)).alias(e) for e in ends])


def config_mapping(rows: DataFrame) -> DataFrame:
    """(doc_id, source, target) from the rows below the first mapping header."""
    is_header = (tx.strip(tx.fold_accents(F.col("a"))).isin(*SOURCE_HEADERS)
                 & tx.strip(tx.fold_accents(F.col("b"))).isin(*TARGET_HEADERS))
    heads = rows.filter(is_header).groupBy("doc_id").agg(F.min("ord").alias("_head"))
    below = rows.join(heads, "doc_id").filter(F.col("ord") > F.col("_head"))
    cells = below.select("doc_id", "ord", tx.strip(F.col("a")).alias("source"), tx.strip(F.col("b")).alias("_t"))
    filled = cells.filter((F.col("source") != "") & (F.col("_t") != ""))
    return filled.groupBy("doc_id", "source").agg(F.max_by(tx.field_key(F.col("_t")), "ord").alias("target"))
