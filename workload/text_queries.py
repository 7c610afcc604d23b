"""Sources, sinks, windows and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import text as tx
from dossierlake.operators import chunking as ck, markup as mk
from dossierlake.session import scratch_folder
from dossierlake.sources import intake as it, sinks as sk
from workload import fixtures as fx, sqltext as q
from workload.kit import query

PARAS = fx.STYLED.replace("{chars}", q._CHARS)
LINES = "lines AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


def longs(df, *names):
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


_FILES = "page_id, split_part(split_part(url, '#', 1), '?', 1) || ['.pdf', '.DOCX', '.doc', '.xlsx', '.html', ''][page_id % 6 + 1] AS path"


@query("src_route_by_suffix", f"""
WITH f AS (SELECT {_FILES} FROM pages), s AS (SELECT page_id,
  lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.](\\.[^.]+)$', 1)) AS suffix FROM f)
SELECT page_id, suffix, CASE WHEN suffix = '.pdf' THEN 'pdf' WHEN suffix IN ('.docx', '.doc') THEN 'docx' END AS reader,
  suffix IN ('.pdf', '.docx', '.doc') AS upload_allowed,
  CASE WHEN suffix IN ('.pdf', '.docx', '.doc') THEN NULL WHEN suffix IN ('.xlsx', '.xls') THEN 'not implemented' ELSE 'unsupported' END AS error
FROM s""")
def src_route_by_suffix(spark, sf):
    """Page addresses as file paths, with suffixes dealt out over them."""
    suffix = "element_at(array('.pdf', '.DOCX', '.doc', '.xlsx', '.html', ''), cast(page_id % 6 + 1 as int))"
    files = fx.table(spark, sf, "pages").selectExpr(
        "page_id", f"concat(substring_index(substring_index(url, '#', 1), '?', 1), {suffix}) AS path")
    return it.route_by_suffix(files).drop("path")


_PAGE_SQL = rf"trim(regexp_replace(regexp_replace(CASE WHEN (i - 1) % 3 = 0 THEN x || chr(10) || chr(10) || chr(10) || chr(10) || '<!-- image -->' ELSE x END, '<!--{q.WS}*image{q.WS}*-->', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {q._CHARS})"


@query("src_pages_assemble", q.with_([LINES], f"""
SELECT *, length(full_text) AS char_count, {q.nwords('full_text')} AS word_count FROM (SELECT doc_id, count(*) AS total_pages,
  string_agg('<!-- page ' || i || ' -->' || chr(10) || {_PAGE_SQL}, chr(10) || chr(10) ORDER BY i) AS full_text FROM lines GROUP BY 1)"""))
def src_pages_assemble(spark, sf):
    return longs(it.assemble_pages(fx.paged_documents(spark, sf)), "total_pages", "char_count", "word_count")


@query("src_page_clean", q.with_([LINES], f"SELECT doc_id, i AS page, {_PAGE_SQL} AS text FROM lines"))
def src_page_clean(spark, sf):
    pages = fx.paged_documents(spark, sf).selectExpr("doc_id", "inline_outer(pages)")
    return pages.select("doc_id", F.col("page").cast("long"), it.clean_page(F.col("text")).alias("text"))


@query("src_docx_flatten", q.with_([PARAS], f"""
SELECT doc_id, coalesce(string_agg(CASE WHEN level IS NULL THEN t ELSE repeat('#', least(level, 6)) || ' ' || t END,
    chr(10) || chr(10) ORDER BY i), '') AS full_text, 1::BIGINT AS total_pages,
  coalesce(sum({q.nwords('t')}), 0)::BIGINT AS word_count
FROM (SELECT d.doc_id, p.i, p.level, p.t FROM documents d LEFT JOIN (SELECT * FROM paras WHERE t <> '') p USING (doc_id)) GROUP BY 1"""))
def src_docx_flatten(spark, sf):
    return longs(it.flatten_paragraphs(fx.styled_documents(spark, sf)), "total_pages", "word_count")


_HTML = r"(?is)<(h[1-6]|p)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p)>"


@query("src_html_outline", f"""
WITH x AS (SELECT page_id, list_filter(list_zip(regexp_extract_all(html, '{_HTML}', 1),
  list_transform(regexp_extract_all(html, '{_HTML}', 2), lambda t: {q.strip("regexp_replace(t, '(?s)<[^>]+>', '', 'g')")})), lambda z: z[2] <> '') AS z
  FROM pages), r AS (SELECT page_id, generate_subscripts(z, 1) - 1 AS line_no, unnest(z) AS z FROM x)
SELECT page_id, line_no, try_cast(regexp_extract(lower(z[1]), '^h(\\d)', 1) AS BIGINT) AS level, z[2] AS text FROM r""")
def src_html_outline(spark, sf):
    return longs(it.html_outline(fx.table(spark, sf, "pages")), "line_no", "level")


@query("src_dict_load", f"""
WITH v AS (SELECT doc_id, source AS label, list_concat([source], string_split(text, chr(10))) AS vs, doc_id % 2 = 0 AS needs_retrieval FROM documents)
SELECT doc_id, 'k' || doc_id AS category, label, needs_retrieval, generate_subscripts(vs, 1) - 1 AS variant_no, unnest(vs) AS variant FROM v""")
def src_dict_load(spark, sf):
    """A dictionary per document (its source as label, its lines as variants), parsed from JSON."""
    entry = F.struct(F.col("source").alias("label"), F.split("text", "\n").alias("variants"), (F.col("doc_id") % 2 == 0).alias("needs_retrieval"))
    rows = fx.documents(spark, sf).select("doc_id", F.to_json(F.create_map(F.concat(F.lit("k"), "doc_id"), entry)).alias("json"))
    out = it.dictionary_variants(rows, "json", ("doc_id",))
    return longs(out.drop("entry_no"), "variant_no")


def _config_rows(spark, sf):
    cells = """stack(8, 0, ' Page Début ', cast(doc_id % 50 as string), 1, 'Dernière page', concat(20 + doc_id % 40, '.0'),
      2, 'Fin', 'n/a', 3, 'Colonne source', ' Colonne Normalisée', 4, concat(' Réf ', source), 'Référence Labo',
      5, null, 'orphan', 6, concat('Réf ', source), concat(lang, '-Été n° ', doc_id), 7, concat('Autre ', lang), ' __ ') AS (ord, a, b)"""
    return fx.table(spark, sf, "documents").selectExpr("doc_id", cells)


@query("src_config_normalise", """
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 50 >= 1 THEN doc_id % 50 END AS s, 20 + doc_id % 40 AS e FROM documents),
k AS (SELECT doc_id, CASE WHEN coalesce(s, 0) <= e THEN s END AS page_start, CASE WHEN coalesce(s, 0) <= e THEN e END AS page_end FROM p)
SELECT doc_id, 'Réf ' || source AS source, lang || '_ete_n_' || doc_id AS target, page_start, page_end FROM documents JOIN k USING (doc_id)
UNION ALL SELECT doc_id, 'Autre ' || lang, '__', page_start, page_end FROM documents JOIN k USING (doc_id)""")
def src_config_normalise(spark, sf):
    rows = _config_rows(spark, sf)
    out = it.config_mapping(rows).join(it.config_pages(rows), "doc_id", "left")
    return longs(out, "page_start", "page_end")


@query("src_field_sanitise", q.with_([LINES], rf"""
SELECT doc_id, i - 1 AS line_no, coalesce(nullif(regexp_replace(regexp_replace(
  regexp_replace({q.strip(q.fold('x'))}, '[ -]', '_', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g'), '^_+|_+$', '', 'g'), ''), x) AS field FROM lines"""))
def src_field_sanitise(spark, sf):
    rows = fx.documents(spark, sf).select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "x"))
    return rows.select("doc_id", F.col("line_no").cast("long"), tx.field_key(F.col("x")).alias("field"))


@query("snk_chunk_tables", q.with_(q.chunk_ctes(), """
SELECT 'keyword' AS store, doc_id, count(*) AS n_chunks, sum(word_count)::BIGINT AS n_words FROM chunks GROUP BY 2
UNION ALL SELECT 'vectors', doc_id, count(*), sum(word_count)::BIGINT FROM chunks WHERE word_count >= 30 GROUP BY 2"""))
def snk_chunk_tables(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text", F.col("source").alias("corpus_key"))
    root = scratch_folder(spark, "chunks")
    sk.write_chunk_tables(ck.retrieval_chunks(docs, keep=("corpus_key",)), root)
    parts = [spark.read.parquet(f"{root}/{store}").groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words")).select(F.lit(store).alias("store"), "*")
        for store in ("keyword", "vectors")]
    return parts[0].union(parts[1])


@query("snk_registry_append", q.with_([fx.DOC_META], """
SELECT doc_id, file_name, doc_type FROM doc_meta UNION ALL SELECT doc_id, 'again.pdf', 'rc' FROM labels"""))
def snk_registry_append(spark, sf):
    path = scratch_folder(spark, "registry")
    rows = fx.registrations(spark, sf)
    sk.append_registry(rows.filter("ord = 0").drop("ord"), path)
    sk.append_registry(rows.filter("ord = 1").drop("ord"), path)
    return spark.read.parquet(path)


@query("snk_audit_log", """
SELECT 'qa' AS agent, length(text) AS message_length, 2 * length(text) AS response_length,
  round(turn / 3.0, 2) AS duration_seconds FROM conversations""")
def snk_audit_log(spark, sf):
    calls = fx.table(spark, sf, "conversations").select(
        F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("text").alias("message"), F.concat("text", "text").alias("response"),
        (F.col("turn") / F.lit(3.0)).alias("seconds"))
    path = scratch_folder(spark, "audit")
    sk.append_audit(calls, "qa", path)
    stored = spark.read.schema(sk.audit_rows(calls, "qa").schema).json(path)
    return stored.select("agent", F.col("message_length").cast("long"), F.col("response_length").cast("long"), "duration_seconds")


FENCE_SPARK = "CASE WHEN i % 3 = 1 THEN concat('```', element_at(array('Python', 'sql', '', 'YML', 'shell', 'c++'), 1 + cast((doc_id + i) % 6 as int)), '\\n', x, ' \\n```') ELSE x END"
FENCE_SQL = "CASE WHEN {i} % 3 = 1 THEN '```' || ['Python', 'sql', '', 'YML', 'shell', 'c++'][1 + (doc_id + {i}) % 6] || chr(10) || x || ' ' || chr(10) || '```' ELSE x END"
_FENCE = r"(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```"
BLOCKS = [fx.reshaped_sql(FENCE_SQL), f"""blocks AS (SELECT doc_id, generate_subscripts(z, 1) - 1 AS block_no, unnest(z) AS z FROM
  (SELECT doc_id, list_zip(regexp_extract_all(text, '{_FENCE}', 1), regexp_extract_all(text, '{_FENCE}', 2)) AS z FROM docs))""",
  f"code AS (SELECT doc_id, block_no, coalesce(nullif(lower(z[1]), ''), 'text') AS language, {q.strip('z[2]')} AS code FROM blocks)"]


@query("txt_code_blocks", q.with_(BLOCKS, "SELECT doc_id, block_no, language, code, block_no = 0 AS is_primary FROM code"))
def txt_code_blocks(spark, sf):
    return longs(mk.code_blocks(fx.reshaped(spark, sf, FENCE_SPARK)), "block_no")


@query("snk_code_export", q.with_(BLOCKS, """
SELECT CASE language WHEN 'python' THEN '.py' WHEN 'sql' THEN '.sql' WHEN 'yml' THEN '.yaml' WHEN 'shell' THEN '.sh' ELSE '.txt' END AS ext,
  count(*) AS n_blocks, sum(length(code))::BIGINT AS n_chars FROM code GROUP BY 1"""))
def snk_code_export(spark, sf):
    path = scratch_folder(spark, "code")
    blocks = mk.code_blocks(fx.reshaped(spark, sf, FENCE_SPARK))
    sk.export_code(blocks, path)
    stored = spark.read.option("lineSep", "\n").text(path)
    return stored.groupBy("ext").agg(F.count("*").alias("n_blocks"), F.sum(F.length("value")).alias("n_chars"))


@query("win_word_windows", f"""
WITH w AS (SELECT doc_id, {q.words('text')} AS w FROM documents), g AS (SELECT doc_id, w, unnest(range(0, len(w), 1200)) AS i FROM w)
SELECT doc_id, i // 1200 AS group_no, array_to_string(list_slice(w, i + 1, i + 1500), ' ') AS group_text FROM g""")
def win_word_windows(spark, sf):
    return longs(mk.word_windows(fx.documents(spark, sf)), "group_no")


MARK_SPARK = ("concat('<!-- page ', i + 1, ' -->\\n', x, CASE WHEN i % 7 = 3 THEN concat('\\nPage ', i, ' | Local | Ref | Val') ELSE '' END)")
MARK_SQL = ("'<!-- page ' || ({i} + 1) || ' -->' || chr(10) || x || CASE WHEN {i} % 7 = 3 THEN chr(10) || 'Page ' || {i} || ' | Local | Ref | Val' ELSE '' END")
GROUPS = [fx.reshaped_sql(MARK_SQL), f"""pgs AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\f|<!-- page \\d+ -->'),
    lambda p: {q.strip('p')}), lambda p: p <> '') AS p FROM docs)""",
  "grp AS (SELECT doc_id, i // 5 AS group_no, array_to_string(list_slice(p, i + 1, i + 5), chr(10) || chr(10)) AS g FROM (SELECT doc_id, p, unnest(range(0, len(p), 5)) AS i FROM pgs))"]


@query("win_page_groups", q.with_(GROUPS, "SELECT doc_id, group_no, g AS group_text FROM grp"))
def win_page_groups(spark, sf):
    return longs(mk.page_group_rows(fx.reshaped(spark, sf, MARK_SPARK)), "group_no")


@query("win_header_carry", q.with_([*GROUPS, rf"""hdr AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY group_no) AS carried FROM
  (SELECT *, nullif(trim(regexp_extract(g, '(?m)^(?:[^\n|]*\|){{3,}}[^\n]*$'), {q._CHARS}), '') AS h FROM grp))"""], f"""
SELECT doc_id, group_no, CASE WHEN carried IS NULL THEN g ELSE {q.lit(mk.CARRIED_HEADER)} || carried || chr(10) || chr(10) || g END AS group_text FROM hdr"""))
def win_header_carry(spark, sf):
    return longs(mk.extraction_groups(fx.reshaped(spark, sf, MARK_SPARK)), "group_no")


@query("txt_first_words", f"SELECT doc_id, array_to_string(list_slice({q.words('text')}, 1, 1000), ' ') AS head FROM documents")
def txt_first_words(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.first_words(F.col("text")).alias("head"))


GUIDE_SPARK = "CASE WHEN i % 3 = 1 THEN concat('<<', x, '>>') WHEN i % 5 = 3 THEN concat('<<', x) WHEN i % 5 = 4 THEN concat(x, '>> .') ELSE x END"
GUIDE_SQL = "CASE WHEN {i} % 3 = 1 THEN '<<' || x || '>>' WHEN {i} % 5 = 3 THEN '<<' || x WHEN {i} % 5 = 4 THEN x || '>> .' ELSE x END"


@query("txt_guidance_split", q.with_([fx.reshaped_sql(GUIDE_SQL), f"""parts AS (SELECT doc_id, list_filter(flatten(list_transform(
    list_zip(string_split_regex(text, '(?s)<<.*?>>'), regexp_extract_all(text, '(?s)<<(.*?)>>', 1)),
    lambda z: [{{'type': 'text', 'content': {q.strip('z[1]')}}}, {{'type': 'guidance', 'content': {q.strip('z[2]')}}}])),
    lambda s: s.content IS NOT NULL AND (s.type = 'guidance' OR s.content <> '')) AS s FROM docs)"""], """
SELECT doc_id, seg_no, s.type AS type, s.content AS content FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS seg_no, unnest(s) AS s FROM parts)"""))
def txt_guidance_split(spark, sf):
    return longs(mk.split_guidance(fx.reshaped(spark, sf, GUIDE_SPARK)), "seg_no")


MD_SPARK = "concat(element_at(array('## ', '- ', '3) ', '', '  * ', '#', '1.'), 1 + i % 7), x, ' ')"
MD_SQL = "['## ', '- ', '3) ', '', '  * ', '#', '1.'][1 + {i} % 7] || x || ' '"
_H, _B, _N = rf"(?s)^(#{{1,6}}){q.WS}+(.+)$", rf"(?s)^{q.WS}*[-*]{q.WS}+(.+)$", rf"(?s)^{q.WS}*(\p{{Nd}}+[.)]){q.WS}+(.+)$"


def _md_ctes(line_sql):
    return [fx.reshaped_sql(line_sql), f"""ls AS (SELECT doc_id, i - 1 AS line_no, rtrim(x, {q._CHARS}) AS x FROM
  (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM docs)))""",
  f"kinds AS (SELECT *, CASE WHEN regexp_matches(x, '{_H}') THEN 'heading' WHEN regexp_matches(x, '{_B}') THEN 'bullet' WHEN regexp_matches(x, '{_N}') THEN 'numbered' ELSE 'plain' END AS kind FROM ls WHERE x <> '')",
  f"""md AS (SELECT doc_id, line_no, kind, CASE kind WHEN 'heading' THEN regexp_extract(x, '{_H}', 2) WHEN 'bullet' THEN '•  ' || regexp_extract(x, '{_B}', 1)
  WHEN 'numbered' THEN regexp_extract(x, '{_N}', 1) || '  ' || regexp_extract(x, '{_N}', 2) ELSE x END AS content FROM kinds)"""]


@query("txt_md_blocks", q.with_(_md_ctes(MD_SQL), "SELECT * FROM md"))
def txt_md_blocks(spark, sf):
    return longs(mk.markdown_blocks(fx.reshaped(spark, sf, MD_SPARK)), "line_no")


_MARKED = r"regexp_replace(x, '^([^\x09-\x0d\x20]+) ([^\x09-\x0d\x20]+) ([^\x09-\x0d\x20]+) ([^\x09-\x0d\x20]+)', '\1 **\2** *\3* _\4_')"
_BOLD, _ITALIC = r"\*\*(.+?)\*\*", r"\*([^*\n]+?)\*|_([^_\n]+?)_"


@query("txt_inline_spans", q.with_([*_md_ctes(_MARKED),
  f"o AS (SELECT doc_id, line_no, generate_subscripts(b, 1) AS i, unnest(b) AS p, m FROM (SELECT doc_id, line_no, string_split_regex(content, '{_BOLD}') AS b, regexp_extract_all(content, '{_BOLD}') AS m FROM md))",
  f"n AS (SELECT doc_id, line_no, i, generate_subscripts(b, 1) AS j, unnest(b) AS p, m FROM (SELECT doc_id, line_no, i, string_split_regex(p, '{_ITALIC}') AS b, regexp_extract_all(p, '{_ITALIC}') AS m FROM o))",
  """r AS (SELECT doc_id, line_no, i, j, 0 AS k, p AS text, false AS bold, false AS italic FROM n
  UNION ALL SELECT doc_id, line_no, i, j, 1, substr(m[j], 2, length(m[j]) - 2), false, true FROM n WHERE j <= len(m)
  UNION ALL SELECT doc_id, line_no, i, 1000000000, 2, substr(m[i], 3, length(m[i]) - 4), true, false FROM o WHERE i <= len(m))"""], """
SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i, j, k) - 1 AS run_no, text, bold, italic FROM r WHERE text <> ''"""))
def txt_inline_spans(spark, sf):
    """Every line with its second word bold, its third in italics and its fourth underscored."""
    marked = "regexp_replace(x, '^(\\\\S+) (\\\\S+) (\\\\S+) (\\\\S+)', '$1 **$2** *$3* _$4_')"
    return longs(mk.inline_runs(mk.markdown_blocks(fx.reshaped(spark, sf, marked))), "line_no", "run_no")


PLAN_SPARK = "CASE i % 4 WHEN 0 THEN concat(i div 4 + 1, '. ', x) WHEN 1 THEN concat('   ', i div 4 + 1, '.', i, '  ', x) WHEN 2 THEN concat(i, '.1.2.3.4.5.6.7.8.9.10 ', x) ELSE x END"
PLAN_SQL = "CASE {i} % 4 WHEN 0 THEN ({i} // 4 + 1) || '. ' || x WHEN 1 THEN '   ' || ({i} // 4 + 1) || '.' || {i} || '  ' || x WHEN 2 THEN {i} || '.1.2.3.4.5.6.7.8.9.10 ' || x ELSE x END"
_PLAN = rf"(?s)^(\p{{Nd}}+(?:\.\p{{Nd}}+)*)\.?{q.WS}+(.+?)$"


@query("txt_plan_parse", q.with_([fx.reshaped_sql(PLAN_SQL), f"""ls AS (SELECT doc_id, list_filter(list_transform(
    string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {q.strip('x')}), lambda x: regexp_matches(x, '{_PLAN}')) AS s FROM docs)"""], f"""
SELECT doc_id, node_no, least(len(string_split(regexp_extract(x, '{_PLAN}', 1), '.')), 9) AS level, {q.strip(f"regexp_extract(x, '{_PLAN}', 2)")} AS title
FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS node_no, unnest(s) AS x FROM ls)"""))
def txt_plan_parse(spark, sf):
    return longs(mk.plan_nodes(fx.reshaped(spark, sf, PLAN_SPARK)), "node_no", "level")


ANNEX_SPARK = "CASE WHEN i % 4 = 0 AND i < 40 THEN concat(i div 4 + 1, CASE WHEN doc_id % 3 = 0 AND i = 8 THEN '. Les ANNEXES ' ELSE '. ' END, x) ELSE x END"
ANNEX_SQL = "CASE WHEN {i} % 4 = 0 AND {i} < 40 THEN ({i} // 4 + 1) || CASE WHEN doc_id % 3 = 0 AND {i} = 8 THEN '. Les ANNEXES ' ELSE '. ' END || x ELSE x END"
_TOP = rf"(?m)^{q.WS}*(\p{{Nd}}+)\.{q.WS}+(.+)$"


@query("txt_plan_annex", q.with_([fx.reshaped_sql(ANNEX_SQL)], f"""
SELECT doc_id, CASE WHEN len(list_filter(regexp_extract_all(text, '{_TOP}', 2), lambda t: contains(lower(t), 'annexe'))) > 0 THEN text
  ELSE rtrim(text, {q._CHARS}) || chr(10) || coalesce(regexp_extract_all(text, '{_TOP}', 1)[-1]::BIGINT + 1, 1) || '. Annexes' || chr(10) END AS plan FROM docs"""))
def txt_plan_annex(spark, sf):
    docs = fx.reshaped(spark, sf, ANNEX_SPARK)
    return docs.select("doc_id", mk.with_annex(F.col("text")).alias("plan"))


@query("txt_outline_nodes", q.with_([PARAS, "grp AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM paras)"], """
SELECT doc_id, (n - 1)::BIGINT AS node_no, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN t END) AS title,
  coalesce(string_agg(CASE WHEN level IS NULL AND t <> '' THEN t END, chr(10) ORDER BY i), '') AS content FROM grp WHERE n > 0 GROUP BY 1, 2"""))
def txt_outline_nodes(spark, sf):
    return longs(mk.outline_nodes(fx.styled_documents(spark, sf)), "node_no", "level")


@query("txt_outline_fill", q.with_([PARAS, "grp AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM paras)",
  "cnt AS (SELECT doc_id, max(n)::BIGINT AS n_headings FROM grp GROUP BY 1)"], """
SELECT doc_id, n_headings, CASE WHEN doc_id % 10 = 7 THEN 'structure mismatch' END AS error,
  CASE WHEN doc_id % 10 <> 7 THEN string_agg(CASE WHEN level IS NULL THEN t ELSE t || chr(10) || 'new body ' || n::BIGINT END, chr(10) ORDER BY i)
    FILTER (level IS NOT NULL OR n = 0) END AS full_text
FROM grp JOIN cnt USING (doc_id) GROUP BY 1, 2"""))
def txt_outline_fill(spark, sf):
    """New bodies for every outline; each tenth document gets one body too many."""
    docs = fx.styled_documents(spark, sf)
    contents = mk.outline_nodes(docs).groupBy("doc_id").agg(F.count("*").alias("n")).selectExpr(
        "doc_id", "transform(sequence(1, n + CASE WHEN doc_id % 10 = 7 THEN 1 ELSE 0 END), k -> concat('new body ', k)) AS contents")
    return longs(mk.fill_outline(docs, contents), "n_headings")


TOC_SPARK = "CASE WHEN i = 0 AND doc_id % 2 = 0 THEN 'SOMMAIRE' WHEN i % 4 < 2 AND i < 24 THEN concat(i, '.1 ', substring_index(x, ' ', 2), ' ..... ', i) ELSE x END"
TOC_SQL = "CASE WHEN {i} = 0 AND doc_id % 2 = 0 THEN 'SOMMAIRE' WHEN {i} % 4 < 2 AND {i} < 24 THEN {i} || '.1 ' || array_to_string(list_slice(string_split(x, ' '), 1, 2), ' ') || ' ..... ' || {i} ELSE x END"
_TOC = rf"(?s)^(?:\p{{Nd}}+(?:\.\p{{Nd}}+)*{q.WS}+)?(.+?){q.WS}*\.{{2,}}{q.WS}*\p{{Nd}}+{q.WS}*$"


@query("txt_toc_titles", q.with_([fx.reshaped_sql(TOC_SQL),
  f"ls AS (SELECT doc_id, i, x, regexp_matches(lower(x), 'sommaire|table des matières|table de matieres|table de matière|contents') AS m FROM (SELECT doc_id, i, {q.strip('x')} AS x FROM (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM docs))) WHERE x <> '')",
  "st AS (SELECT doc_id, min(i) AS m FROM ls WHERE m GROUP BY 1)",
  f"aft AS (SELECT l.doc_id, i, {q.nwords('x')} AS w, CASE WHEN regexp_matches(x, '{_TOC}') THEN {q.strip(f'''regexp_extract(x, '{_TOC}', 1)''')} END AS title FROM ls l JOIN st ON st.doc_id = l.doc_id AND l.i > st.m)",
  "fst AS (SELECT *, CASE WHEN title IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, title ORDER BY i) = 1 THEN 1 ELSE 0 END AS f FROM aft)",
  "hld AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM fst)",
  "stp AS (SELECT doc_id, min(i) AS stop FROM hld WHERE held > 3 AND w > 20 GROUP BY 1)"], """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS title_no, title FROM hld LEFT JOIN stp USING (doc_id)
WHERE f = 1 AND (stop IS NULL OR i < stop)"""))
def txt_toc_titles(spark, sf):
    return longs(mk.toc_titles(fx.reshaped(spark, sf, TOC_SPARK)), "title_no")


@query("txt_first_title", q.with_([LINES], f"SELECT doc_id, {q.strip('min_by(x, i)')} AS title FROM lines WHERE (doc_id + i) % 3 = 0 GROUP BY 1"))
def txt_first_title(spark, sf):
    lines = fx.documents(spark, sf).select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("ord", "text"))
    items = lines.withColumn("label", F.when((F.col("doc_id") + F.col("ord") + 1) % 3 == 0, "title").otherwise("text"))
    return mk.first_titles(items)
