"""Reducing a report to its cover and the section that matters. All in-row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import text as tx, vocabulary as vo
from dossierlake.functions.arrays import let, rows_of
from dossierlake.operators.sections import PAGE_MARKER

# Fixed values.
COVER_WORDS = 1000
CONTENTS_CHARS = 2000
SECTION_BREAK = "\n\n<!-- section-break -->\n\n"

_DASH = r".\-\x{2013}\x{2014}"
_CONTENTS = rf"(?dmi)^#{{1,4}}{tx.WS}*Sommaire(?![\p{{L}}\p{{N}}_])"
_CONTENTS_PLAIN = rf"(?i)(?:\A|\n)Sommaire{tx.WS}*\n"
_ENTRY = rf"(?dm)^[-{tx.SPACE}]*(\p{{Nd}}+)[{tx.SPACE}{_DASH}]+(.+)$"
_NUMBERED = rf"(?dm)(?=^#{{1,4}}{tx.WS}*\p{{Nd}}+[{tx.SPACE}{_DASH}])"
_ITS_NUMBER = rf"^#{{1,4}}{tx.WS}*(\p{{Nd}}+)"
_MATERIAL_ID = r"(?<![\p{L}\p{N}_])M\p{Nd}{3,4}(?![\p{L}\p{N}_])"
_PAGES = r"(?=" + PAGE_MARKER.replace("(?i)", "") + ")"


def _around_contents(col: Column) -> Column:
    """[text before, text after] the first contents heading; one item if there is none."""
    return let(F.split(col, _CONTENTS, 2), lambda marked: F.when(F.size(marked) == 2, marked).otherwise(F.split(col, _CONTENTS_PLAIN, 2)))


def cover(col: Column, limit: int = COVER_WORDS) -> Column:
    """Text before the contents heading, or all of it, capped in words."""
    return let(tx.strip(_around_contents(col)[0]), lambda front: F.when(tx.word_count(front) > limit, tx.first_words(front, limit)).otherwise(front))


def contents_entries(col: Column) -> Column:
    """array<struct<number, title>> of numbered entries after the contents heading, first title per number."""
    def block(after: Column) -> Column:
        return let(F.split(after, rf"(?dm)^#{{1,4}}{tx.WS}", 2),
                   lambda until: F.when(F.size(until) == 2, until[0]).otherwise(F.substring(after, 1, CONTENTS_CHARS)))

    def pairs(block: Column) -> Column:
        nums, titles = F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(1)), F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(2))
        return F.zip_with(nums, titles, lambda n, t: F.struct(n.alias("number"), tx.strip(t).alias("title")))

    def first(pairs: Column) -> Column:
        distinct = F.array_distinct(F.transform(pairs, lambda p: p["number"]))
        return F.transform(distinct, lambda n: F.element_at(F.filter(pairs, lambda p: p["number"] == n), 1))

    return let(let(let(F.try_element_at(_around_contents(col), F.lit(2)), block), pairs), first)


def contents_map(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, entry_no, number, title)."""
    rows = rows_of(docs, contents_entries(F.col(text)), "entry_no", "_e", ("doc_id",))
    return rows.select("doc_id", "entry_no", "_e.number", "_e.title")


def section_number(entries: Column, vocabulary=vo.MATERIALS_TITLES) -> Column:
    """Number of the first entry whose folded title holds a phrase of the vocabulary."""
    phrases = F.array(*[F.lit(v) for v in vocabulary])
    hits = F.filter(entries, lambda e: F.exists(phrases, lambda v: F.contains(tx.fold_accents(e["title"]), v)))
    return F.try_element_at(hits, F.lit(1))["number"]


def numbered_pieces(col: Column) -> Column:
    """array<struct<number, piece>>: the text cut before each numbered heading."""
    return F.transform(F.split(col, _NUMBERED), lambda p: F.struct(
        F.nullif(F.regexp_extract(p, _ITS_NUMBER, 1), F.lit("")).alias("number"), p.alias("piece")))


def section_by_number(pieces: Column, number: Column) -> Column:
    """From heading `number` to the next heading with a greater number; sub-numbers stay inside."""
    def section(own: Column) -> Column:
        beyond = F.transform(F.slice(pieces, own + 1, F.size(pieces)), lambda p: F.coalesce(
            tx.greater_number(p["number"], number) & ~F.startswith(p["number"], number), F.lit(False)))
        took = let(F.array_position(beyond, True).cast("int"), lambda n: F.slice(pieces, own, F.when(n > 0, n).otherwise(F.size(pieces))))
        return tx.strip(F.array_join(F.transform(took, lambda p: p["piece"]), ""))

    own = F.array_position(F.transform(pieces, lambda p: F.coalesce(p["number"], F.lit(""))), number).cast("int")
    return let(own, lambda own: F.when(own > 0, section(own)))


def fallback_section(pieces: Column) -> Column:
    """The first of sections 5, 4, 3, 2 that names a material id; null if none."""
    tries = [section_by_number(pieces, F.lit(n)) for n in vo.FALLBACK_NUMBERS]
    return F.coalesce(*[let(t, lambda t: F.when(F.regexp_like(t, F.lit(_MATERIAL_ID)), t)) for t in tries])


def page_range(col: Column, start: Column, end: Column) -> Column:
    """Pages start..end of a text with page markers, brought into the available range.

    The last of repeated page numbers counts. A start inside a gap moves to the next page;
    without a page after the end the rest of the text is taken. Empty when disjoint.
    """
    def inside(pieces: Column, nums: Column, first: Column, last: Column) -> Column:
        size, backwards = F.size(pieces), F.reverse(nums)
        at = size - F.array_position(backwards, first).cast("int") + 1
        following = F.array_position(backwards, last + 1).cast("int")
        stop = F.when(following > 0, size - following + 1).otherwise(size + 1)
        return tx.strip(F.array_join(let(at, lambda at: F.slice(pieces, at, F.greatest(stop - at, F.lit(0)))), ""))

    def ranged(pieces: Column, nums: Column, known: Column) -> Column:
        ends = F.struct(F.array_min(F.filter(known, lambda n: n >= start)).alias("first"), F.least(end, F.array_max(known)).alias("last"))
        return let(ends, lambda e: F.when(e["first"] <= e["last"], inside(pieces, nums, e["first"], e["last"])).otherwise(""))

    number = rf"(?i)^<!--{tx.WS}*page{tx.WS}+(\p{{Nd}}+)"
    return let(F.split(col, "(?i)" + _PAGES), lambda pieces: let(
        F.transform(pieces, lambda p: F.regexp_extract(p, number, 1).try_cast("int")), lambda nums: let(
            F.filter(nums, lambda n: n.isNotNull()), lambda known: ranged(pieces, nums, known))))


def page_rows(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of a page table within each document's (page_start, page_end)."""
    return pages.join(ranges, "doc_id").filter(F.col("page").between(F.col("page_start"), F.col("page_end")))


def reduce_documents(docs: DataFrame, text: str = "text", start: str | None = None, end: str | None = None) -> DataFrame:
    """(doc_id, cover, materials, cleaned): page range first, then detection by contents, then by ids."""
    given = docs.select("doc_id", F.col(text).alias("_t"),
                        (F.col(start) if start else F.lit(None).cast("int")).alias("_a"),
                        (F.col(end) if end else F.lit(None).cast("int")).alias("_b"))
    parsed = given.select("*", cover(F.col("_t")).alias("cover"), numbered_pieces(F.col("_t")).alias("_p"),
                          section_number(contents_entries(F.col("_t"))).alias("_n"))
    ranged = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), page_range(F.col("_t"), F.col("_a"), F.col("_b")))
    filled = lambda c: let(c, lambda v: F.when(v != "", v))
    found = F.coalesce(filled(ranged), filled(section_by_number(F.col("_p"), F.col("_n"))), filled(fallback_section(F.col("_p"))), F.lit(""))
    parts = parsed.select("doc_id", "_t", "cover", found.alias("materials"))
    joined = F.array_join(F.filter(F.array("cover", "materials"), lambda x: x != ""), SECTION_BREAK)
    return parts.select("doc_id", "cover", "materials",
                        let(joined, lambda j: F.when(j == "", F.col("_t")).otherwise(j)).alias("cleaned"))
