"""Sections of long documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import text as tx, vocabulary as vo
from dossierlake.operators import cleaning as cl, sections as sc
from workload import fixtures as fx, sqltext as q
from workload.kit import query
from workload.text_queries import longs

HEAD_SPARK = """CASE WHEN i % 2 = 0 THEN concat(repeat('#', cast(1 + (doc_id + i) % 3 as int)), ' ',
  element_at(array('ARTICLE 7 ', '7.2 - ', '7.2.1 – ', '1) ', 'a) ', 'Critère 1 ', '3. ', '7.2.2 ', ''), cast(1 + (doc_id + i div 2) % 9 as int)),
  element_at(array('CRITERES DE JUGEMENT DES OFFRES', 'Structure du mémoire technique', 'SOMMAIRE', 'Mentions légales',
    substring_index(x, ' ', 3), 'Sous-critère prix'), cast(1 + (doc_id + i div 2 * 5) % 6 as int)))
  WHEN i % 3 = 1 THEN concat(x, ' (7.2.2) ( 7.2.1 )') ELSE x END"""
HEAD_SQL = """CASE WHEN {i} % 2 = 0 THEN repeat('#', 1 + (doc_id + {i}) % 3) || ' ' ||
  ['ARTICLE 7 ', '7.2 - ', '7.2.1 – ', '1) ', 'a) ', 'Critère 1 ', '3. ', '7.2.2 ', ''][1 + (doc_id + {i} // 2) % 9] ||
  ['CRITERES DE JUGEMENT DES OFFRES', 'Structure du mémoire technique', 'SOMMAIRE', 'Mentions légales',
    array_to_string(list_slice(string_split(x, ' '), 1, 3), ' '), 'Sous-critère prix'][1 + (doc_id + {i} // 2 * 5) % 6]
  WHEN {i} % 3 = 1 THEN x || ' (7.2.2) ( 7.2.1 )' ELSE x END"""

_HEADING = rf"(?s)^(#{{1,6}})[ \t]+(.+?){q.WS}*$"
_END = r"(?:[^\p{L}\p{N}_]|$)"
_NUM = rf"(?i)^\(?(?:article|titre|chapitre|section)?{q.WS}*\.?{q.WS}*(\p{{Nd}}+(?:\.\p{{Nd}}+)*)"
_INNER = rf"^\(?\p{{Nd}}+\)|^\(?[a-zA-Z]\)|^[-•▪]{q.WS}|(?i:^(?:sous[-{q.SPACE}]?critère|critère){_END})"
_PAGE = rf"(?i)<!--{q.WS}*page{q.WS}+\p{{Nd}}+{q.WS}*-->"
_REF = rf"\({q.WS}*(\p{{Nd}}+(?:\.\p{{Nd}}+){{1,3}}){q.WS}*\)"

HEADS = [
    fx.reshaped_sql(HEAD_SQL),
    "ls AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs)",
    f"""hs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS k,
    CASE WHEN num <> '' THEN string_split(num, '.')::BIGINT[] END AS number FROM (SELECT *, regexp_extract(title, '{_NUM}', 1) AS num,
    regexp_matches(title, '(?i)^\\(?(?:article|titre|chapitre|section){_END}') AS marked, regexp_matches(title, '{_INNER}') AS inner_item
  FROM (SELECT doc_id, i - 1 AS line, length(regexp_extract(x, '{_HEADING}', 1)) AS level, {q.strip(f"regexp_extract(x, '{_HEADING}', 2)")} AS title
    FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM ls) WHERE regexp_matches(x, '{_HEADING}'))))""",
]
BOUNDS = [*HEADS, f"""ends AS (SELECT a.doc_id, a.k, any_value(a.line) AS line, any_value(a.level) AS level, any_value(a.title) AS title,
    any_value(a.number) AS number, min(b.line) AS stop FROM hs a LEFT JOIN hs b ON a.doc_id = b.doc_id AND b.k > a.k AND b.level <= a.level
    AND NOT b.inner_item AND (b.marked OR NOT a.marked)
    AND NOT coalesce(len(b.number) > len(a.number) AND list_slice(b.number, 1, len(a.number)) = a.number, false)
    AND NOT coalesce(len(a.number) > 1 AND len(b.number) = 1 AND b.number[1] < a.number[1], false)
  GROUP BY 1, 2)""",
  f"""secs AS (SELECT doc_id, k, level, title, number, coalesce(stop, len(ls)) AS end_line, {q.strip(
      f"regexp_replace(array_to_string(list_slice(ls, line + 2, coalesce(stop, len(ls))), chr(10)), '{_PAGE}', '', 'g')")} AS section
  FROM ends JOIN ls USING (doc_id))"""]


def headed(spark, sf):
    return fx.reshaped(spark, sf, HEAD_SPARK)


@query("sec_headings", q.with_(HEADS, "SELECT doc_id, k AS heading_no, line, level, title FROM hs"))
def sec_headings(spark, sf):
    out = sc.headings(headed(spark, sf)).select("doc_id", "heading_no", "line", "level", "title")
    return longs(out, "heading_no", "line", "level")


@query("sec_normalise", q.with_(HEADS, f"SELECT doc_id, k AS heading_no, {q.title_key('title')} AS title_key FROM hs"))
def sec_normalise(spark, sf):
    return longs(sc.headings(headed(spark, sf)).select("doc_id", "heading_no", "title_key"), "heading_no")


@query("sec_num_prefix", q.with_(HEADS, "SELECT doc_id, k AS heading_no, array_to_string(number, '.') AS number FROM hs"))
def sec_num_prefix(spark, sf):
    out = sc.headings(headed(spark, sf))
    return longs(out.select("doc_id", "heading_no", F.array_join(F.col("number").cast("array<string>"), ".").alias("number")), "heading_no")


HINT_SPARK = """CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'critère de jugement' WHEN 2 THEN ' STRUCTURE du mémoire'
  WHEN 3 THEN substring_index(text, ' ', 2) WHEN 4 THEN '3.2) critères  de sélection' ELSE 'condition' END"""
HINT_SQL = """CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'critère de jugement' WHEN 2 THEN ' STRUCTURE du mémoire'
  WHEN 3 THEN array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') WHEN 4 THEN '3.2) critères  de sélection' ELSE 'condition' END"""
_DICT = "dict(entry_no, category, variant_no, name) AS (VALUES " + ", ".join(
    f"({e}, '{c}', {v}, {q.lit(n)})" for e, (c, entry) in enumerate(vo.CONSULTATION_SECTIONS.items())
    for v, n in enumerate(vo.names(entry))) + ")"
HINTS = [_DICT, f"hints AS (SELECT doc_id, {HINT_SQL} AS hint FROM documents)",
         f"""hit AS (SELECT doc_id, min(entry_no) AS entry_no FROM hints JOIN dict ON hint <> '' AND contains({q.title_key('name')}, {q.title_key('hint')}) GROUP BY 1)"""]


@query("sec_candidates", q.with_([*HINTS, "whole AS (SELECT string_agg(name, '|' ORDER BY entry_no, variant_no) AS names FROM dict)",
  "per AS (SELECT entry_no, string_agg(name, '|' ORDER BY variant_no) AS names FROM dict GROUP BY 1)"], """
SELECT doc_id, CASE WHEN coalesce(hint, '') = '' THEN (SELECT names FROM whole) ELSE coalesce(names, hint) END AS candidates
FROM hints LEFT JOIN hit USING (doc_id) LEFT JOIN per USING (entry_no)"""))
def sec_candidates(spark, sf):
    docs = fx.documents(spark, sf).selectExpr("doc_id", f"{HINT_SPARK} AS hint")
    return docs.select("doc_id", F.array_join(vo.candidate_pool(F.col("hint"), vo.CONSULTATION_SECTIONS), "|").alias("candidates"))


@query("cls_resolve_category", q.with_(HINTS, f"""
SELECT doc_id, coalesce(category, '{vo.DEFAULT_CATEGORY}') AS category FROM hints LEFT JOIN hit USING (doc_id)
LEFT JOIN (SELECT DISTINCT entry_no, category FROM dict) USING (entry_no)"""))
def cls_resolve_category(spark, sf):
    docs = fx.documents(spark, sf).selectExpr("doc_id", f"{HINT_SPARK} AS hint")
    return docs.select("doc_id", vo.category_of(F.col("hint"), vo.CONSULTATION_SECTIONS).alias("category"))


@query("sec_score")
def sec_score(spark, sf):
    out = sc.heading_score_rows(headed(spark, sf), vo.CONSULTATION_SECTIONS)
    return longs(out.withColumn("score", F.round("score", 9)), "heading_no")


@query("sec_best")
def sec_best(spark, sf):
    docs = headed(spark, sf).join(fx.documents(spark, sf).selectExpr("doc_id", f"{HINT_SPARK} AS hint"), "doc_id")
    return longs(sc.best_headings(docs, vo.CONSULTATION_SECTIONS, hint="hint"), "heading_no", "level")


# The chosen heading per document: the first with a number of two parts or more, else the first.
_CHOSEN = "chosen AS (SELECT doc_id, coalesce(min(CASE WHEN len(number) > 1 THEN k END), min(k)) AS k FROM hs GROUP BY 1)"


def _chosen():
    deep = F.array_position(F.transform("heads", lambda h: F.coalesce(F.size(h["number"]) > 1, F.lit(False))), True)
    return F.when(F.size("heads") > 0, F.when(deep > 0, deep - 1).otherwise(0)).cast("int")


@query("sec_boundary", q.with_([*BOUNDS, _CHOSEN], "SELECT doc_id, title AS heading, section AS text FROM secs JOIN chosen USING (doc_id, k)"))
def sec_boundary(spark, sf):
    return sc.section_of(headed(spark, sf), _chosen(), references=False)


@query("sec_all", q.with_(BOUNDS, "SELECT doc_id, k AS heading_no, level, title, end_line, section FROM secs"))
def sec_all(spark, sf):
    return longs(sc.all_sections(headed(spark, sf)), "heading_no", "level", "end_line")


@query("sec_crossref", q.with_([*BOUNDS, _CHOSEN,
  f"refs AS (SELECT doc_id, k, number, generate_subscripts(r, 1) AS o, unnest(r)::BIGINT[] AS ref FROM (SELECT doc_id, k, number, list_transform(regexp_extract_all(section, '{_REF}', 1), lambda r: string_split(r, '.')::BIGINT[]) AS r FROM secs JOIN chosen USING (doc_id, k)))",
  "sib AS (SELECT doc_id, ref, min(o) AS o FROM refs WHERE len(ref) = len(number) AND ref <> number AND list_slice(ref, 1, len(ref) - 1) = list_slice(number, 1, len(number) - 1) GROUP BY 1, 2)",
  "tgt AS (SELECT doc_id, ref, any_value(o) AS o, min(k) AS k FROM sib JOIN secs USING (doc_id) WHERE secs.number = sib.ref GROUP BY 1, 2)",
  f"app AS (SELECT doc_id, string_agg(chr(10) || chr(10) || {q.lit(sc.CROSS_REFERENCE)} || title || ']' || chr(10) || section, '' ORDER BY o) AS extra FROM tgt JOIN secs USING (doc_id, k) GROUP BY 1)"], """
SELECT doc_id, title AS heading, section || coalesce(extra, '') AS text FROM secs JOIN chosen USING (doc_id, k) LEFT JOIN app USING (doc_id)"""))
def sec_crossref(spark, sf):
    return sc.section_of(headed(spark, sf), _chosen())


@query("sec_good_enough", q.with_(BOUNDS, f"SELECT doc_id, k AS heading_no, {q.nwords('section')} AS n_words FROM secs WHERE {q.nwords('section')} >= 30"))
def sec_good_enough(spark, sf):
    kept = sc.good_enough(sc.all_sections(headed(spark, sf)).withColumnRenamed("section", "text"))
    return longs(kept.select("doc_id", "heading_no", tx.word_count(F.col("text")).alias("n_words")), "heading_no", "n_words")


CLEAN_SPARK = """concat(CASE WHEN i % 4 = 0 THEN concat('<!-- page ', i div 4 + 1 + CASE WHEN i > 8 THEN 2 ELSE 0 END, ' -->\\n') ELSE '' END,
  CASE WHEN i = 1 AND doc_id % 4 < 2 THEN '## SOMMAIRE' WHEN i = 1 AND doc_id % 4 = 2 THEN 'Sommaire '
  WHEN i IN (2, 3, 4) THEN concat(element_at(array('3. Résultats du Repérage ', '- 5 – Divers ', '4 '), cast(1 + (doc_id + i) % 3 as int)), x)
  WHEN i % 3 = 0 THEN concat(repeat('#', cast(1 + i % 4 as int)), ' ', 2 + (doc_id + i) % 6, CASE WHEN i % 2 = 0 THEN '. ' ELSE '.1 ' END, x)
  WHEN i % 7 = 5 THEN concat(x, ' M', 100 + doc_id % 900) ELSE x END)"""
CLEAN_SQL = """CASE WHEN {i} % 4 = 0 THEN '<!-- page ' || ({i} // 4 + 1 + CASE WHEN {i} > 8 THEN 2 ELSE 0 END) || ' -->' || chr(10) ELSE '' END ||
  CASE WHEN {i} = 1 AND doc_id % 4 < 2 THEN '## SOMMAIRE' WHEN {i} = 1 AND doc_id % 4 = 2 THEN 'Sommaire '
  WHEN {i} IN (2, 3, 4) THEN ['3. Résultats du Repérage ', '- 5 – Divers ', '4 '][1 + (doc_id + {i}) % 3] || x
  WHEN {i} % 3 = 0 THEN repeat('#', 1 + {i} % 4) || ' ' || (2 + (doc_id + {i}) % 6) || CASE WHEN {i} % 2 = 0 THEN '. ' ELSE '.1 ' END || x
  WHEN {i} % 7 = 5 THEN x || ' M' || (100 + doc_id % 900) ELSE x END"""
_D = r".\-\x{2013}\x{2014}"
_S1 = rf"^#{{1,4}}{q.WS}*Sommaire"
_S2 = rf"(?:\A|\n)Sommaire{q.WS}*\n"
_NUMBERED = rf"^#{{1,4}}{q.WS}*\p{{Nd}}+[{q.SPACE}{_D}]"
CLEAN = [
    fx.reshaped_sql(CLEAN_SQL),
    f"""toc0 AS (SELECT doc_id, text, regexp_matches(text, '(?im){_S1}{_END}') AS h1, regexp_matches(text, '(?i){_S2}') AS h2 FROM docs)""",
    rf"""toc AS (SELECT doc_id, text, CASE WHEN h1 THEN regexp_extract(text, '(?ims)\A(.*?){_S1}{_END}', 1)
    WHEN h2 THEN regexp_extract(text, '(?is)\A(.*?){_S2}', 1) ELSE text END AS before,
    CASE WHEN h1 THEN substr(text, length(regexp_extract(text, '(?ims)\A(.*?{_S1}){_END}', 1)) + 1)
    WHEN h2 THEN substr(text, length(regexp_extract(text, '(?is)\A(.*?{_S2})', 1)) + 1) END AS aft FROM toc0)""",
    f"""cov AS (SELECT doc_id, CASE WHEN {q.nwords('c')} > 1000 THEN array_to_string(list_slice({q.words('c')}, 1, 1000), ' ') ELSE c END AS cover
  FROM (SELECT doc_id, {q.strip('before')} AS c FROM toc))""",
    rf"""blk AS (SELECT doc_id, CASE WHEN regexp_matches(aft, '(?m)^#{{1,4}}{q.WS}') THEN regexp_extract(aft, '(?ms)\A(.*?)^#{{1,4}}{q.WS}', 1) ELSE left(aft, 2000) END AS b FROM toc)""",
    rf"""ent AS (SELECT doc_id, number, min_by(title, o) AS title, min(o) AS o FROM (SELECT doc_id, generate_subscripts(z, 1) AS o, unnest(z)[1] AS number, {q.strip('unnest(z)[2]')} AS title
  FROM (SELECT doc_id, list_zip(regexp_extract_all(b, '(?m)^[-{q.SPACE}]*(\p{{Nd}}+)[{q.SPACE}{_D}]+(.+)$', 1), regexp_extract_all(b, '(?m)^[-{q.SPACE}]*(\p{{Nd}}+)[{q.SPACE}{_D}]+(.+)$', 2)) AS z FROM blk)) GROUP BY 1, 2)""",
    "vocab(v) AS (VALUES " + ", ".join(f"('{v}')" for v in vo.MATERIALS_TITLES) + ")",
    f"fnd AS (SELECT doc_id, min_by(number, o) AS number FROM ent WHERE EXISTS (SELECT 1 FROM vocab WHERE contains({q.fold('title')}, v)) GROUP BY 1)",
    rf"""pcs AS (SELECT doc_id, generate_subscripts(p, 1) AS o, unnest(p) AS piece, nullif(regexp_extract(unnest(p), '^#{{1,4}}{q.WS}*(\p{{Nd}}+)', 1), '') AS number
  FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(?m)({_NUMBERED})', {q.SEP} || '\1', 'g'), {q.SEP}), lambda x: true) AS p FROM docs))""",
    """starts AS (SELECT doc_id, number, min(o) AS o FROM pcs WHERE number IS NOT NULL GROUP BY 1, 2)""",
    """stops AS (SELECT s.doc_id, s.number, any_value(s.o) AS o, min(e.o) AS stop FROM starts s LEFT JOIN pcs e ON e.doc_id = s.doc_id AND e.o > s.o
  AND e.number::HUGEINT > s.number::HUGEINT AND NOT starts_with(e.number, s.number) GROUP BY 1, 2)""",
    f"""bynum AS (SELECT s.doc_id, s.number, {q.strip("string_agg(piece, '' ORDER BY p.o)")} AS section FROM stops s JOIN pcs p ON p.doc_id = s.doc_id AND p.o >= s.o AND (s.stop IS NULL OR p.o < s.stop) GROUP BY 1, 2)""",
    r"""fb AS (SELECT doc_id, min_by(section, try) AS section FROM (SELECT doc_id, section, list_position(['5', '4', '3', '2'], number) AS try FROM bynum
  WHERE number IN ('5', '4', '3', '2') AND regexp_matches(section, '(?:^|[^\p{L}\p{N}_])M\p{Nd}{3,4}(?:[^\p{L}\p{N}_]|$)')) GROUP BY 1)""",
    "cfg AS (SELECT doc_id, doc_id % 5 AS a, doc_id % 5 + doc_id % 3 AS b FROM documents)",
    rf"""mk0 AS (SELECT doc_id, generate_subscripts(p, 1) AS o, unnest(p) AS piece FROM (SELECT doc_id, string_split(regexp_replace(text, '({_PAGE[4:]})', {q.SEP} || '\1', 'g'), {q.SEP}) AS p FROM docs))""",
    r"""mk AS (SELECT *, try_cast(regexp_extract(piece, '^<!-- page (\d+) -->', 1) AS BIGINT) AS n FROM mk0)""",
    """rng0 AS (SELECT m.doc_id, min(n) FILTER (n >= a) AS lo, least(any_value(b), max(n)) AS hi FROM mk m JOIN cfg USING (doc_id) GROUP BY 1)""",
    """rng AS (SELECT r.doc_id, lo, hi, max(o) FILTER (n = lo) AS f, max(o) FILTER (n = hi + 1) AS t FROM rng0 r JOIN mk USING (doc_id) GROUP BY 1, 2, 3)""",
    f"""pgr AS (SELECT r.doc_id, {q.strip("coalesce(string_agg(piece, '' ORDER BY o) FILTER (lo <= hi AND o >= f AND (t IS NULL OR o < t)), '')")} AS section FROM rng r JOIN mk USING (doc_id) GROUP BY 1)""",
]


def reports(spark, sf):
    docs = fx.documents(spark, sf).selectExpr(
        "doc_id", f"array_join(transform(split(text, '\\n'), (x, i) -> {CLEAN_SPARK}), '\\n') AS text",
        "cast(doc_id % 5 as int) AS page_start", "cast(doc_id % 5 + doc_id % 3 as int) AS page_end")
    return docs


@query("sec_cover", q.with_(CLEAN, "SELECT doc_id, cover FROM cov"))
def sec_cover(spark, sf):
    return reports(spark, sf).select("doc_id", cl.cover(F.col("text")).alias("cover"))


@query("sec_toc_map", q.with_(CLEAN, "SELECT doc_id, number, title FROM ent"))
def sec_toc_map(spark, sf):
    return cl.contents_map(reports(spark, sf)).drop("entry_no")


@query("sec_find_by_vocab", q.with_(CLEAN, "SELECT doc_id, number FROM docs LEFT JOIN fnd USING (doc_id)"))
def sec_find_by_vocab(spark, sf):
    return reports(spark, sf).select("doc_id", cl.section_number(cl.contents_entries(F.col("text"))).alias("number"))


@query("sec_by_number", q.with_(CLEAN, "SELECT doc_id, n.number, section FROM docs CROSS JOIN (VALUES ('2'), ('3'), ('7')) n(number) LEFT JOIN bynum b USING (doc_id, number)"))
def sec_by_number(spark, sf):
    cut = reports(spark, sf).select("doc_id", cl.numbered_pieces(F.col("text")).alias("p"))
    three = F.array(*[F.struct(F.lit(n).alias("number"), cl.section_by_number(F.col("p"), F.lit(n)).alias("section")) for n in ("2", "3", "7")])
    return cut.select("doc_id", F.inline(three))


@query("sec_fallback_ids", q.with_(CLEAN, "SELECT doc_id, section FROM docs LEFT JOIN fb USING (doc_id)"))
def sec_fallback_ids(spark, sf):
    cut = reports(spark, sf).select("doc_id", cl.numbered_pieces(F.col("text")).alias("p"))
    return cut.select("doc_id", cl.fallback_section(F.col("p")).alias("section"))


@query("sec_page_range", q.with_(CLEAN, "SELECT doc_id, section FROM pgr"))
def sec_page_range(spark, sf):
    return reports(spark, sf).select("doc_id", cl.page_range(F.col("text"), F.col("page_start"), F.col("page_end")).alias("section"))


@query("sec_clean_doc", q.with_([*CLEAN, """mat AS (SELECT d.doc_id, text, cover, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN nullif(p.section, '') END,
    nullif(b.section, ''), nullif(f.section, ''), '') AS materials FROM docs d JOIN cov USING (doc_id) LEFT JOIN pgr p USING (doc_id)
    LEFT JOIN fnd n USING (doc_id) LEFT JOIN bynum b ON b.doc_id = d.doc_id AND b.number = n.number LEFT JOIN fb f ON f.doc_id = d.doc_id)"""], """
SELECT doc_id, cover, materials, CASE WHEN cover = '' AND materials = '' THEN text WHEN cover = '' THEN materials WHEN materials = '' THEN cover
  ELSE cover || chr(10) || chr(10) || '<!-- section-break -->' || chr(10) || chr(10) || materials END AS cleaned FROM mat"""))
def sec_clean_doc(spark, sf):
    """Every second document has a configured page range."""
    docs = reports(spark, sf).withColumn("page_start", F.expr("CASE WHEN doc_id % 2 = 0 THEN page_start END"))
    return cl.reduce_documents(docs, start="page_start", end="page_end")
