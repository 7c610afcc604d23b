"""Windows over text, fenced blocks, guidance marks, plans and outlines. All in-row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import text as tx
from dossierlake.functions.arrays import rows_of
from dossierlake.sources.intake import heading_level

# Window sizes, marks and fixed texts.
PAGE_WORDS, GROUP_PAGES = 300, 5
MAX_LEVEL = 9
CARRIED_HEADER = "[CONTEXTE — EN-TÊTE DE TABLEAU DE LA PAGE PRÉCÉDENTE] : "
ANNEX = "Annexes"
TOC_MARKERS = ("sommaire", "table des matières", "table de matieres", "table de matière", "contents")
TOC_MIN_TITLES, TOC_LONG_LINE = 3, 20

_PAGE_SPLIT = r"\f|<!-- page \d+ -->"
_TABLE_HEADER = r"(?dm)^(?:[^\n|]*\|){3,}[^\n]*$"
_LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def word_windows(docs: DataFrame, text: str = "text", size: int = PAGE_WORDS * GROUP_PAGES,
                 overlap: int = PAGE_WORDS) -> DataFrame:
    """(doc_id, group_no, group_text): sliding windows of words."""
    cut = docs.select("doc_id", tx.words(F.col(text)).alias("_w"))
    n = F.size("_w")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    groups = F.transform(starts, lambda i: F.array_join(F.slice(F.col("_w"), i + 1, size), " "))
    return rows_of(cut, groups, "group_no", "group_text", ("doc_id",))


def has_pages(col: Column) -> Column:
    return F.regexp_like(col, F.lit(_PAGE_SPLIT))


def page_groups(docs: DataFrame, text: str = "text", pages: int = GROUP_PAGES) -> DataFrame:
    """(doc_id, groups array): consecutive non-blank pages in groups, without overlap."""
    stripped = F.transform(F.split(text, _PAGE_SPLIT), lambda p: tx.strip(p))
    cut = docs.select("doc_id", F.filter(stripped, lambda p: p != "").alias("_p"))
    n = F.size("_p")
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(pages))).otherwise(F.array().cast("array<int>"))
    groups = F.transform(starts, lambda i: F.array_join(F.slice(F.col("_p"), i, pages), "\n\n"))
    return cut.select("doc_id", groups.alias("groups"))


def page_group_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    return rows_of(page_groups(docs, text), F.col("groups"), "group_no", "group_text", ("doc_id",))


def carry_headers(grouped: DataFrame) -> DataFrame:
    """Puts the latest table header seen, the group's own included, before each group."""
    def step(acc, group):
        own = tx.strip(F.regexp_extract(group, _TABLE_HEADER, 0))
        header = F.when(own != "", own).otherwise(acc["header"])
        prefix = F.when(header != "", F.concat(F.lit(CARRIED_HEADER), header, F.lit("\n\n"))).otherwise("")
        return F.struct(header.alias("header"), F.concat(acc["out"], F.array(F.concat(prefix, group))).alias("out"))

    start = F.struct(F.lit("").alias("header"), F.array().cast("array<string>").alias("out"))
    carried = grouped.select("doc_id", F.aggregate("groups", start, step, lambda acc: acc["out"]).alias("_g"))
    return rows_of(carried, F.col("_g"), "group_no", "group_text", ("doc_id",))


def extraction_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """Page groups with carried headers where there are page marks, word windows elsewhere."""
    paged = carry_headers(page_groups(docs.filter(has_pages(F.col(text))), text))
    return paged.unionByName(word_windows(docs.filter(~has_pages(F.col(text))), text))


def guidance_segments(col: Column) -> Column:
    """Ordered array<struct<type, content>> of `<<guidance>>` and plain text; blank text is dropped."""
    mark = r"(?s)<<(.*?)>>"
    plain = F.split(col, r"(?s)<<.*?>>")
    guides = F.regexp_extract_all(col, F.lit(mark), F.lit(1))

    def part(kind: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), tx.strip(content).alias("content"))

    pairs = F.zip_with(plain, guides, lambda t, g: F.array(part("text", t), part("guidance", g)))
    return F.filter(F.flatten(pairs), lambda s: s["content"].isNotNull() & ((s["type"] == "guidance") | (s["content"] != "")))


def split_guidance(docs: DataFrame, text: str = "text") -> DataFrame:
    rows = rows_of(docs, guidance_segments(F.col(text)), "seg_no", "_s", ("doc_id",))
    return rows.select("doc_id", "seg_no", "_s.type", "_s.content")


def code_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, block_no, language, code, is_primary) of fenced blocks."""
    fence = F.lit(r"(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```")
    blocks = F.zip_with(
        F.regexp_extract_all(F.col(text), fence, F.lit(1)), F.regexp_extract_all(F.col(text), fence, F.lit(2)),
        lambda lang, code: F.struct(F.when(lang == "", "text").otherwise(F.lower(lang)).alias("language"), tx.strip(code).alias("code")))
    rows = rows_of(docs, blocks, "block_no", "_b", ("doc_id",))
    return rows.select("doc_id", "block_no", "_b.language", "_b.code", (F.col("block_no") == 0).alias("is_primary"))


def markdown_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, kind, content): heading, bullet, numbered or plain; blank lines skipped."""
    rows = rows_of(docs, tx.lines(F.col(text)), "line_no", "_l", ("doc_id",))
    line = F.rtrim("_l", F.lit(tx.SPACE_CHARS))
    shaped = rows.select("doc_id", "line_no", line.alias("_l")).filter(F.col("_l") != "")
    heading, bullet = rf"(?s)^(#{{1,6}}){tx.WS}+(.+)$", rf"(?s)^{tx.WS}*[-*]{tx.WS}+(.+)$"
    numbered = rf"(?s)^{tx.WS}*(\p{{Nd}}+[.)]){tx.WS}+(.+)$"
    kind = (F.when(F.col("_l").rlike(heading), "heading").when(F.col("_l").rlike(bullet), "bullet")
            .when(F.col("_l").rlike(numbered), "numbered").otherwise("plain"))
    content = (F.when(F.col("kind") == "heading", F.regexp_extract("_l", heading, 2))
               .when(F.col("kind") == "bullet", F.concat(F.lit("•  "), F.regexp_extract("_l", bullet, 1)))
               .when(F.col("kind") == "numbered", F.concat(F.regexp_extract("_l", numbered, 1), F.lit("  "), F.regexp_extract("_l", numbered, 2)))
               .otherwise(F.col("_l")))
    return shaped.withColumn("kind", kind).select("doc_id", "line_no", "kind", content.alias("content"))


# Bold text, and the two ways of writing italics.
_BOLD = r"(?d)\*\*(.+?)\*\*"
_ITALICS = (r"\*([^*\n]+?)\*", r"_([^_\n]+?)_")
_RUNS = "array<struct<text:string,bold:boolean,italic:boolean>>"


def _run(text: Column, bold: bool = False, italic: bool = False) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(bold).alias("bold"), F.lit(italic).alias("italic")))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, match>>: every match and its 0-based place, from the lengths of what comes before it."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ahead = lambda i: F.length(F.array_join(F.slice(between, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(found, F.lit(1), i), ""))
    return F.transform(found, lambda m, i: F.struct(ahead(i).alias("start"), m.alias("match")))


def _emphasised(text: Column) -> Column:
    """Runs of a text without bold parts. Both ways of italics are found on their own; of two that overlap the first counts."""
    both = F.array_sort(F.concat(*[_places(text, p) for p in _ITALICS]))
    start = F.struct(F.lit(0).alias("done"), F.array().cast(_RUNS).alias("runs"))

    def take(state: Column, m: Column) -> Column:
        plain = _run(F.substring(text, state["done"] + 1, m["start"] - state["done"]))
        more = F.concat(state["runs"], plain, _run(F.substring(m["match"], F.lit(2), F.length(m["match"]) - 2), italic=True))
        taken = F.struct((m["start"] + F.length(m["match"])).alias("done"), more.alias("runs"))
        return F.when(m["start"] >= state["done"], taken).otherwise(state)

    return F.aggregate(both, start, take, lambda s: F.concat(s["runs"], _run(F.substring(text, s["done"] + 1, F.length(text)))))


def runs(line: Column) -> Column:
    """array<struct<text, bold, italic>> of a line: bold is cut out first, italics in what is left."""
    bold = F.transform(F.regexp_extract_all(line, F.lit(_BOLD), F.lit(0)), lambda m: _run(F.substring(m, F.lit(3), F.length(m) - 4), bold=True))
    rest = F.transform(F.split(line, _BOLD, -1), lambda t: _emphasised(t))
    woven = F.flatten(F.zip_with(rest, bold, lambda r, b: F.concat(r, F.coalesce(b, F.array().cast(_RUNS)))))
    return F.filter(woven, lambda r: r["text"] != "")


def inline_runs(blocks: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, line_no, run_no, text, bold, italic)."""
    rows = rows_of(blocks.select("doc_id", "line_no", runs(F.coalesce(content, F.lit(""))).alias("_r")), F.col("_r"), "run_no", "_x", ("doc_id", "line_no"))
    return rows.select("doc_id", "line_no", "run_no", "_x.text", "_x.bold", "_x.italic")


def plan_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, node_no, level, title) of numbered plan lines; the level is the number's depth."""
    line = rf"(?s)^(\p{{Nd}}+(?:\.\p{{Nd}}+)*)\.?{tx.WS}+(.+?)$"
    stripped = F.transform(F.split(text, _LINE_BREAKS), lambda x: tx.strip(x))
    matching = docs.select("doc_id", F.filter(stripped, lambda x: F.regexp_like(x, F.lit(line))).alias("_l"))
    rows = rows_of(matching, F.col("_l"), "node_no", "_x", ("doc_id",))
    depth = F.size(F.split(F.regexp_extract("_x", line, 1), r"\."))
    return rows.select("doc_id", "node_no", F.least(depth, F.lit(MAX_LEVEL)).alias("level"),
                       tx.strip(F.regexp_extract("_x", line, 2)).alias("title"))


def with_annex(col: Column) -> Column:
    """The plan with a closing annex chapter, unless a top-level title already names one."""
    top = F.lit(rf"(?dm)^{tx.WS}*(\p{{Nd}}+)\.{tx.WS}+(.+)$")
    numbers, titles = F.regexp_extract_all(col, top, F.lit(1)), F.regexp_extract_all(col, top, F.lit(2))
    # A number beyond 37 digits is followed by the number of chapters.
    last = tx.ascii_digits(F.try_element_at(numbers, F.lit(-1))).try_cast("decimal(37,0)")
    following = F.coalesce(last, F.size(numbers).cast("decimal(37,0)")) + 1
    added = F.concat(F.rtrim(col, F.lit(tx.SPACE_CHARS)), F.lit("\n"), following.cast("string"), F.lit(f". {ANNEX}\n"))
    return F.when(F.exists(titles, lambda t: F.contains(F.lower(t), F.lit("annexe"))), col).otherwise(added)


def _outline(docs: DataFrame, paragraphs: str) -> DataFrame:
    """Trimmed paragraphs `_p` and the positions of headings `_at` (1-based)."""
    trimmed = F.transform(paragraphs, lambda p: F.struct(heading_level(p["style"]).alias("level"), tx.strip(p["text"]).alias("text")))
    cut = docs.select("*", trimmed.alias("_p"))
    at = F.filter(F.transform("_p", lambda p, i: F.when(p["level"].isNotNull(), i + 1)), lambda i: i.isNotNull())
    return cut.withColumn("_at", at)


def outline_nodes(docs: DataFrame, paragraphs: str = "paragraphs") -> DataFrame:
    """(doc_id, node_no, level, title, content): text after each heading; earlier text is ignored."""
    cut = _outline(docs.select("doc_id", paragraphs), paragraphs)
    ends = F.concat(F.slice(F.col("_at"), 2, F.greatest(F.size("_at"), F.lit(1))), F.array(F.size("_p") + 1))

    def node(start, end):
        body = F.filter(F.slice(F.col("_p"), start + 1, end - start - 1), lambda p: p["text"] != "")
        return F.struct(F.element_at("_p", start)["level"].alias("level"), F.element_at("_p", start)["text"].alias("title"),
                        F.array_join(F.transform(body, lambda p: p["text"]), "\n").alias("content"))

    nodes = F.when(F.size("_at") > 0, F.zip_with("_at", ends, node))
    rows = rows_of(cut.withColumn("_nodes", nodes), F.col("_nodes"), "node_no", "_n", ("doc_id",))
    return rows.select("doc_id", "node_no", "_n.level", "_n.title", "_n.content")


def fill_outline(docs: DataFrame, contents: DataFrame, paragraphs: str = "paragraphs") -> DataFrame:
    """Bodies replaced by position: the i-th heading gets the i-th of contents(doc_id, contents array).

    Different counts give an error row instead of text.
    """
    cut = _outline(docs.select("doc_id", paragraphs), paragraphs).join(contents, "doc_id")
    front = F.transform(F.slice(F.col("_p"), 1, F.coalesce(F.try_element_at("_at", F.lit(1)) - 1, F.size("_p"))), lambda p: p["text"])
    filled = F.zip_with("_at", "contents", lambda at, c: F.array(F.element_at("_p", at)["text"], c))
    same = F.size("_at") == F.size("contents")
    return cut.select(
        "doc_id", F.size("_at").alias("n_headings"), F.when(~same, "structure mismatch").alias("error"),
        F.when(same, F.array_join(F.concat(front, F.flatten(filled)), "\n")).alias("full_text"))


def toc_titles(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, title_no, title): entries after the first contents marker.

    Reading stops at the first long line once more than three titles are held.
    """
    marker = "|".join(re.escape(m) for m in TOC_MARKERS)
    entry = rf"(?s)^(?:\p{{Nd}}+(?:\.\p{{Nd}}+)*{tx.WS}+)?(.+?){tx.WS}*\.{{2,}}{tx.WS}*\p{{Nd}}+{tx.WS}*$"
    stripped = F.filter(F.transform(tx.lines(F.col(text)), lambda x: tx.strip(x)), lambda x: x != "")
    cut = docs.filter(F.lower(text).rlike(marker)).select("doc_id", stripped.alias("_l"))
    flags = F.transform("_l", lambda x: F.regexp_like(F.lower(x), F.lit(marker)))
    after = cut.select("doc_id", "_l", F.array_position(flags, True).alias("_m")).filter(F.col("_m") > 0)
    rest = after.select("doc_id", F.slice("_l", F.col("_m").cast("int") + 1, F.size("_l")).alias("_l"))
    seen = rest.select("doc_id", F.transform("_l", lambda x: F.struct(
        F.when(F.regexp_like(x, F.lit(entry)), tx.strip(F.regexp_extract(x, entry, 1))).alias("title"),
        (tx.word_count(x) > TOC_LONG_LINE).alias("long"))).alias("_s"))
    titled = seen.select("doc_id", "_s", F.transform("_s", lambda s: s["title"]).alias("_t"))
    held = titled.withColumn("_d", F.array_distinct(F.filter("_t", lambda t: t.isNotNull())))
    enough = held.withColumn("_e", F.when(F.size("_d") > TOC_MIN_TITLES, F.array_position("_t", F.element_at("_d", TOC_MIN_TITLES + 1))))
    ends = F.transform("_s", lambda s, i: (i + 1 > F.col("_e")) & s["long"])
    stop = enough.withColumn("_stop", F.nullif(F.array_position(ends, True), F.lit(0)))
    read = F.slice(F.col("_t"), F.lit(1), F.coalesce(F.col("_stop") - 1, F.size("_t")).cast("int"))
    kept = F.array_distinct(F.filter(read, lambda t: t.isNotNull()))
    return rows_of(stop.select("doc_id", kept.alias("_k")), F.col("_k"), "title_no", "title", ("doc_id",))


def first_titles(items: DataFrame) -> DataFrame:
    """(doc_id, title): the first of items(doc_id, ord, label, text) labelled as a title."""
    return items.filter(F.col("label") == "title").groupBy("doc_id").agg(F.min_by(tx.strip(F.col("text")), "ord").alias("title"))
