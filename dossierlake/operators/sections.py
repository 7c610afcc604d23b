"""Headings of long documents, the extent of their sections, and references between them.

A document is one row. Its lines and headings are lists in that row, so finding, bounding
and cross-referencing sections needs no shuffle and no join of a document with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import similarity as sim, text as tx, vocabulary as vo
from dossierlake.functions.arrays import rows_of

# Fixed values.
MATCH_THRESHOLD = 0.55
MIN_SECTION_WORDS = 30
CROSS_REFERENCE = "[Référence croisée — "

_HEADING = rf"(?s)^(#{{1,6}})[ \t]+(.+?){tx.WS}*$"
_WORD_END = r"(?![\p{L}\p{N}_])"
_MARKED = rf"(?iu)^\(?(?:article|titre|chapitre|section){_WORD_END}"
_LISTED = rf"^\(?\p{{Nd}}+\)|^\(?[a-zA-Z]\)|^[-•▪]{tx.WS}"
_CRITERION = rf"(?iu)^(?:sous[-{tx.SPACE}]?critère|critère){_WORD_END}"
_NUMBER = rf"(?iu)^\(?(?:article|titre|chapitre|section)?{tx.WS}*\.?{tx.WS}*(\p{{Nd}}+(?:\.\p{{Nd}}+)*)"
_REFERENCE = rf"\({tx.WS}*(\p{{Nd}}+(?:\.\p{{Nd}}+){{1,3}}){tx.WS}*\)"
PAGE_MARKER = rf"(?i)<!--{tx.WS}*page{tx.WS}+\p{{Nd}}+{tx.WS}*-->"


def numbers(dotted: Column) -> Column:
    """The parts of a dotted number; null where one does not fit 64 bits, as it is then compared with nothing."""
    parts = F.transform(F.split(tx.ascii_digits(dotted), r"\."), lambda p: p.try_cast("bigint"))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), parts)


def numeric_prefix(title: Column) -> Column:
    """Leading dotted number as an array, after an optional article/title/chapter/section word."""
    found = F.regexp_extract(title, _NUMBER, 1)
    return F.when(found != "", numbers(found))


def _heading(line: Column, at: Column) -> Column:
    title = tx.strip(F.regexp_extract(line, _HEADING, 2))
    return F.struct(
        at.alias("line"), F.length(F.regexp_extract(line, _HEADING, 1)).alias("level"), title.alias("title"),
        numeric_prefix(title).alias("number"), F.regexp_like(title, F.lit(_MARKED)).alias("marked"),
        (F.regexp_like(title, F.lit(_LISTED)) | F.regexp_like(title, F.lit(_CRITERION))).alias("inner"))


def with_headings(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lines, heads): heads are structs with the 0-based line they stand on."""
    cut = docs.select("doc_id", *keep, tx.lines(F.col(text)).alias("lines"))
    marked = F.transform("lines", lambda x, i: F.when(F.regexp_like(x, F.lit(_HEADING)), _heading(x, i)))
    return cut.select("doc_id", *keep, "lines", F.filter(marked, lambda h: h.isNotNull()).alias("heads"))


def headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, heading_no, line, level, title, title_key, number)."""
    rows = rows_of(with_headings(docs, text), F.col("heads"), "heading_no", "_h", ("doc_id",))
    return rows.select("doc_id", "heading_no", "_h.line", "_h.level", "_h.title",
                       tx.title_key(F.col("_h.title")).alias("title_key"), "_h.number")


def _ends(own: Column, later: Column) -> Column:
    """Whether a later heading ends the section of `own`."""
    both = own["number"].isNotNull() & later["number"].isNotNull()
    depth, later_depth = F.size(own["number"]), F.size(later["number"])
    nested = both & (later_depth > depth) & (F.slice(later["number"], 1, F.greatest(depth, F.lit(0))) == own["number"])
    restarted = both & (depth > 1) & (later_depth == 1) & (later["number"][0] < own["number"][0])
    return ((later["level"] <= own["level"]) & ~later["inner"] & ~F.coalesce(nested, F.lit(False))
            & ~F.coalesce(restarted, F.lit(False)) & (later["marked"] | ~own["marked"]))


def _end_line(own: Column, at: Column, heads: Column, n_lines: Column) -> Column:
    """Line of the first heading after position `at` (0-based) that ends the section.

    Looks at the next few headings first and farther only if needed (coalesce is lazy), so
    bounding every section of a document is close to linear.
    """
    n, looks = F.size(heads), []
    for skip, take in ((0, 8), (8, 56), (64, 448)):
        looks.append(F.filter(F.slice(heads, at + 2 + skip, F.lit(take)), lambda h: _ends(own, h)))
    looks.append(F.filter(F.slice(heads, at + 2 + 512, F.greatest(n, F.lit(1))), lambda h: _ends(own, h)))
    return F.coalesce(*[F.try_element_at(x, F.lit(1))["line"] for x in looks], n_lines)


def _body(lines: Column, own: Column, end: Column) -> Column:
    inside = F.array_join(F.slice(lines, own["line"] + 2, F.greatest(end - own["line"] - 1, F.lit(0))), "\n")
    return tx.strip(F.regexp_replace(inside, PAGE_MARKER, ""))


def all_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, heading_no, level, title, end_line, section) for every heading of every document."""
    parsed = with_headings(docs, text)
    heads, lines = F.col("heads"), F.col("lines")
    bounded = F.transform(heads, lambda h, i: F.struct(
        h.alias("head"), _end_line(h, i, heads, F.size(lines)).alias("end")))
    texts = F.transform("_b", lambda b: F.struct(
        b["head"]["level"].alias("level"), b["head"]["title"].alias("title"), b["end"].alias("end_line"),
        _body(lines, b["head"], b["end"]).alias("section")))
    full = parsed.select("doc_id", "lines", bounded.alias("_b")).select("doc_id", texts.alias("_s"))
    rows = rows_of(full, F.col("_s"), "heading_no", "_x", ("doc_id",))
    return rows.select("doc_id", "heading_no", "_x.level", "_x.title", "_x.end_line", "_x.section")


def _compared(docs: DataFrame, dictionary: dict, text: str = "text", hint: str | None = None,
              default: str | None = None) -> tuple[DataFrame, Column, Column]:
    """`with_headings`, and the keys of its headings and of its document's candidates."""
    hinted = docs.withColumn("_hint", F.col(hint) if hint else F.lit(None).cast("string"))
    parsed = with_headings(hinted, text, ("_hint",))
    pool = vo.candidate_pool(F.col("_hint"), dictionary, default, tx.title_key)
    keys = F.transform("heads", lambda h: tx.title_key(h["title"]))
    return parsed, keys, pool


def scored_headings(docs: DataFrame, dictionary: dict, **kw) -> DataFrame:
    """`with_headings` plus `scores`, the similarity of each heading to its document's candidates."""
    parsed, keys, pool = _compared(docs, dictionary, **kw)
    return parsed.select("doc_id", "lines", "heads", sim.heading_scores(keys, pool).alias("scores"))


def heading_score_rows(docs: DataFrame, dictionary: dict, **kw) -> DataFrame:
    """(doc_id, heading_no, title, score)."""
    scored = scored_headings(docs, dictionary, **kw)
    pairs = F.zip_with("heads", "scores", lambda h, s: F.struct(h["title"].alias("title"), s.alias("score")))
    rows = rows_of(scored.select("doc_id", pairs.alias("_p")), F.col("_p"), "heading_no", "_x", ("doc_id",))
    return rows.select("doc_id", "heading_no", "_x.title", "_x.score")


def _best(docs: DataFrame, dictionary: dict, threshold: float, **kw) -> DataFrame:
    """`with_headings` plus `score` and `at`, the 0-based position of the best heading; documents below the threshold go."""
    parsed, keys, pool = _compared(docs, dictionary, **kw)
    # The filter on the score would otherwise find the headings and compare them a second time.
    found = parsed.select("doc_id", "lines", "heads", _once(sim.best_heading(keys, pool, threshold)).alias("_b"))
    return found.select("doc_id", "lines", "heads", F.col("_b.score").alias("score"), F.col("_b.at").alias("at")).filter(F.col("score") >= threshold)


def best_headings(docs: DataFrame, dictionary: dict, threshold: float = MATCH_THRESHOLD, **kw) -> DataFrame:
    """(doc_id, heading_no, heading, level, score): the best heading per document, first on ties."""
    found = _best(docs, dictionary, threshold, **kw)
    head = F.element_at("heads", F.col("at") + 1)
    return found.select("doc_id", F.col("at").alias("heading_no"), head["title"].alias("heading"), head["level"].alias("level"),
                        F.round("score", 3).alias("score"))


def _with_references(section: Column, own: Column, heads: Column, lines: Column) -> Column:
    """Appends the sections of sibling numbers the text refers to, in order, each once."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(section, F.lit(_REFERENCE), F.lit(1)), lambda r: numbers(r)))
    depth = F.size(own["number"])
    siblings = F.filter(named, lambda r: (F.size(r) == depth) & (r != own["number"])
                        & (F.slice(r, 1, F.greatest(depth - 1, F.lit(0))) == F.slice(own["number"], 1, F.greatest(depth - 1, F.lit(0)))))
    places = F.filter(F.transform(siblings, lambda r: F.array_position(F.transform(heads, lambda h: h["number"]), r).cast("int")),
                      lambda p: p > 0)
    # Bound step by step: a heading looked up inside the extent rule would be looked up at each use.
    found = F.transform(places, lambda p: F.struct(F.element_at(heads, p).alias("head"), (p - 1).alias("at")))
    bounded = F.transform(found, lambda x: F.struct(x["head"].alias("head"), _end_line(x["head"], x["at"], heads, F.size(lines)).alias("end")))
    appended = F.transform(bounded, lambda b: F.concat(
        F.lit(f"\n\n{CROSS_REFERENCE}"), b["head"]["title"], F.lit("]\n"), _body(lines, b["head"], b["end"])))
    return F.when(own["number"].isNull(), section).otherwise(F.concat(section, F.array_join(appended, "")))


def _once(col: Column) -> Column:
    """Keeps Catalyst from copying an expensive expression into filters above it."""
    return F.explode_outer(F.array(col))


def match_sections(docs: DataFrame, dictionary: dict, threshold: float = MATCH_THRESHOLD, references: bool = True, **kw) -> DataFrame:
    """(doc_id, heading, level, score, text): the wanted section of each document that has one."""
    found = _best(docs, dictionary, threshold, **kw)
    heads, lines = F.col("heads"), F.col("lines")
    own = found.select("doc_id", "lines", "heads", "score", "at", F.element_at("heads", F.col("at") + 1).alias("own"))
    end = _end_line(F.col("own"), F.col("at"), heads, F.size(lines))
    bounded = own.withColumn("section", _body(lines, F.col("own"), end))
    text = _with_references(F.col("section"), F.col("own"), heads, lines) if references else F.col("section")
    return bounded.select("doc_id", F.col("own.title").alias("heading"), F.col("own.level").alias("level"),
                          F.round("score", 3).alias("score"), _once(text).alias("text"))


def section_of(docs: DataFrame, at: Column, text: str = "text", references: bool = True) -> DataFrame:
    """As `match_sections` for a heading position already known (0-based, over `heads`)."""
    parsed = with_headings(docs, text).withColumn("at", at).filter(F.col("at").isNotNull())
    heads, lines = F.col("heads"), F.col("lines")
    own = parsed.withColumn("own", F.element_at("heads", F.col("at") + 1))
    bounded = own.withColumn("section", _body(lines, F.col("own"), _end_line(F.col("own"), F.col("at"), heads, F.size(lines))))
    full = _with_references(F.col("section"), F.col("own"), heads, lines) if references else F.col("section")
    return bounded.select("doc_id", F.col("own.title").alias("heading"), _once(full).alias("text"))


def good_enough(sections: DataFrame, min_words: int = MIN_SECTION_WORDS) -> DataFrame:
    return sections.filter(tx.word_count(F.col("text")) >= min_words)
