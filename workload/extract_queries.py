"""Row extraction and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import extraction as ex, markup as mk, review as rv
from dossierlake.plans import extracting as xt
from dossierlake.sources import sinks as sk
from workload import fixtures as fx, sqltext as q
from workload.kit import query
from workload.section_queries import CLEAN_SQL, reports
from workload.text_queries import longs

_RESULTS = ["Présence", "ABSENCE", "non détecté", "EP", "", "inconnu", "ac1 ", "presence"]


def _row_text(concat: str, i: str, result: str, x: str) -> str:
    """One row as JSON text; every third row repeats the row before in other letter case."""
    g = f"({i} {'//' if concat == '||' else 'div'} 3)"
    parts = ["'{\"localisation\": \"'", f"CASE WHEN {i} % 3 = 2 THEN upper(source) ELSE source END", "' '", f"CAST({g} % 5 AS {x})",
             "'\", \"reference\": '", f"CASE WHEN {g} % 4 = 0 THEN 'null' ELSE '\"M' || CAST(100 + {g} % 7 AS {x}) || '\"' END",
             "', \"resultat\": \"'", result, "'\"}'"]
    return " || ".join(parts) if concat == "||" else "concat(" + ", ".join(parts) + ")"


_SP = ", ".join(f"'{r}'" for r in _RESULTS)
_ROWS_SPARK = "concat('[', array_join(transform(split(text, '\\n'), (x, i) -> " + _row_text(
    "concat", "i", f"element_at(array({_SP}), cast(1 + (doc_id + i div 3) % 8 as int))", "string") + "), ', '), ']')"
_ROWS_SQL = "'[' || array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: " + _row_text(
    "||", "(j - 1)", f"[{_SP}][1 + (doc_id + (j - 1) // 3) % 8]", "VARCHAR") + "), ', ') || ']'"
_COL_SPARK = "concat('[', array_join(transform(split(text, '\\n'), (x, i) -> concat('\"', lang, i, '\"')), ', '), ']')"
_COL_SQL = "'[' || array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: '\"' || lang || (j - 1) || '\"'), ', ') || ']'"


def _responses(concat, rows, cols, nl):
    c = (lambda *p: "concat(" + ", ".join(p) + ")") if concat else (lambda *p: " || ".join(p))
    return f"""CASE doc_id % 9 WHEN 0 THEN {rows} WHEN 1 THEN {c("'```json'", nl, rows, nl, "'```'")}
      WHEN 2 THEN {c("'{\"note\": [\"a\", {\"b\": 1}], \"rows\": '", rows, "'}'")}
      WHEN 3 THEN {c("'{\"localisation\": '", cols, "', \"resultat\": '", cols, "', \"page\": 3}'")}
      WHEN 4 THEN {c("'{\"localisation\": '", cols, "', \"resultat\": [\"x\", \"y\", \"z\", null, \"v\", \"w\", \"t\"]}'")}
      WHEN 5 THEN {c("'{\"localisation\": \"'", "source", "'\", \"resultat\": null, \"autre\": '", f"CAST(doc_id AS {'string' if concat else 'VARCHAR'})", "'}'")}
      WHEN 6 THEN {c("'Voici : '", rows, "' merci'")}
      WHEN 7 THEN {c("'Objet '", "'{\"localisation\": \"'", "source", "'\"}'", "' fin'")}
      ELSE {c("'pas de JSON pour '", "source")} END"""


RESP_SPARK = _responses(True, _ROWS_SPARK, _COL_SPARK, "'\\n'")
RESP_SQL = _responses(False, _ROWS_SQL, _COL_SQL, "chr(10)")
TARGETS = ["localisation", "reference", "resultat"]

PARSED = [
    f"resp AS (SELECT doc_id, {RESP_SQL} AS response FROM documents)",
    f"""bare AS (SELECT doc_id, response, {q.strip(f"regexp_replace(regexp_replace({q.strip('response')}, '```json{q.WS}*', '', 'g'), '```{q.WS}*', '', 'g')")} AS c FROM resp)""",
    r"""opts AS (SELECT *, regexp_extract(c, '(?s)\[.*\]') AS l, regexp_extract(c, '(?s)\{.*\}') AS o FROM bare)""",
    """fixed AS (SELECT doc_id, response, CASE WHEN json_valid(c) THEN c WHEN l <> '' AND json_valid(l) THEN l WHEN o <> '' AND json_valid(o) THEN o END AS json,
    NOT json_valid(c) AND NOT (l <> '' AND json_valid(l)) AND o <> '' AND json_valid(o) AS from_span FROM opts)""",
    """obj AS (SELECT doc_id, json, from_span, json_type(json) AS t, CASE WHEN json_type(json) = 'OBJECT' THEN json_keys(json) END AS ks FROM fixed WHERE json IS NOT NULL)""",
    """vals AS (SELECT doc_id, o, k, json_extract(json, '$.' || k) AS v, json_type(json_extract(json, '$.' || k)) AS vt, from_span
  FROM (SELECT doc_id, json, from_span, generate_subscripts(ks, 1) AS o, unnest(ks) AS k FROM obj WHERE t = 'OBJECT'))""",
    """shape AS (SELECT doc_id, bool_and(vt NOT IN ('ARRAY', 'OBJECT')) AS flat, count(*) FILTER (vt = 'ARRAY') AS n_lists,
    bool_and(CASE WHEN vt = 'ARRAY' THEN len(list_filter(v::JSON[], lambda e: json_type(e) IN ('ARRAY', 'OBJECT'))) = 0 ELSE true END) AS plain,
    count(DISTINCT json_array_length(v)) FILTER (vt = 'ARRAY') AS n_lens FROM vals GROUP BY 1)""",
    """items AS (SELECT doc_id, 0 AS o, i, e FROM (SELECT doc_id, generate_subscripts(json::JSON[], 1) AS i, unnest(json::JSON[]) AS e FROM obj WHERE t = 'ARRAY')
  UNION ALL SELECT doc_id, o, i, e FROM (SELECT doc_id, o, generate_subscripts(v::JSON[], 1) AS i, unnest(v::JSON[]) AS e FROM vals WHERE vt = 'ARRAY'))""",
    """cands AS (SELECT * FROM items WHERE json_type(e) = 'OBJECT' AND list_has_any(json_keys(e), ['localisation', 'reference', 'resultat']))""",
    """firsts AS (SELECT doc_id, min(o) AS o FROM cands GROUP BY 1)""",
    """rows0 AS (SELECT c.doc_id, c.i, c.e::VARCHAR AS e FROM cands c JOIN firsts f USING (doc_id, o) LEFT JOIN shape s USING (doc_id) WHERE c.o = 0 OR NOT (s.flat OR s.plain)
  UNION ALL SELECT doc_id, 1, json FROM obj JOIN shape USING (doc_id) WHERE flat
  UNION ALL SELECT doc_id, i, '{' || string_agg(json_quote(k) || ': ' || coalesce(e::VARCHAR, 'null'), ', ' ORDER BY o) || '}' FROM items JOIN vals USING (doc_id, o) JOIN shape USING (doc_id)
    WHERE NOT flat AND plain AND n_lens = 1 GROUP BY 1, 2)""".replace("json_quote(k)", "to_json(k)"),
    """rws AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS row_no, e, e->>'localisation' AS localisation, e->>'reference' AS reference, e->>'resultat' AS resultat FROM rows0)""",
    f"""keyed AS (SELECT *, concat_ws('|', CASE WHEN localisation NOT IN ('', 'null') THEN 'l' || lower({q.strip('localisation')}) END,
    CASE WHEN reference NOT IN ('', 'null') THEN 'r' || lower({q.strip('reference')}) END, CASE WHEN resultat NOT IN ('', 'null') THEN 's' || lower({q.strip('resultat')}) END,
    CASE WHEN coalesce(e->>'autre', '') <> '' THEN 'a' || (e->>'autre') END) AS key FROM rws)""",
    "dedup AS (SELECT doc_id, min(row_no) AS row_no, min_by(localisation, row_no) AS localisation, min_by(reference, row_no) AS reference, min_by(resultat, row_no) AS resultat FROM keyed WHERE key <> '' GROUP BY doc_id, key)",
]


def answers(spark, sf):
    return ex.repair_json(fx.documents(spark, sf).selectExpr("doc_id", f"{RESP_SPARK} AS response"))


def rows(spark, sf):
    return ex.answer_rows(answers(spark, sf), TARGETS)


@query("ext_json_repair", q.with_(PARSED, "SELECT doc_id, json, coalesce(from_span, false) AS from_span FROM fixed"))
def ext_json_repair(spark, sf):
    return answers(spark, sf).select("doc_id", "json", "from_span")


@query("ext_row_shapes", q.with_(PARSED, "SELECT doc_id, row_no, len(json_keys(e)) AS n_fields, localisation, resultat FROM rws"))
def ext_row_shapes(spark, sf):
    out = rows(spark, sf)
    return longs(out.select("doc_id", "row_no", F.size("fields").alias("n_fields"), F.col("fields.localisation"), F.col("fields.resultat")), "row_no", "n_fields")


@query("ext_project_mapping", q.with_(PARSED, "SELECT doc_id, row_no, localisation, reference, resultat FROM rws"))
def ext_project_mapping(spark, sf):
    return longs(ex.project_mapping(rows(spark, sf), TARGETS), "row_no")


_W = r"[\p{L}\p{N}_]"
_ID_SQL = rf"greatest(len(list_distinct(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])([A-Z]{{1,5}}(?:--)?\p{{Nd}}{{2,5}})(?:[^\p{{L}}\p{{N}}_]|$)', 1))), 1)"


@query("ext_expected_rows", q.with_([fx.reshaped_sql(CLEAN_SQL)], f"SELECT doc_id, {_ID_SQL}::BIGINT AS expected FROM docs"))
def ext_expected_rows(spark, sf):
    return reports(spark, sf).select("doc_id", ex.expected_rows(F.col("text")).cast("long").alias("expected"))


@query("ext_completeness", """
WITH a AS (SELECT doc_id, i AS group_no, t AS attempt, (doc_id + i * t) % 4 AS n_rows, 2 AS expected FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
  (VALUES (1), (2)) v(t)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_no ORDER BY n_rows >= expected DESC, CASE WHEN n_rows >= expected THEN attempt ELSE -attempt END) AS r FROM a)
SELECT doc_id, group_no, attempt::BIGINT AS attempt, n_rows, n_rows >= expected AS complete FROM b WHERE r = 1""")
def ext_completeness(spark, sf):
    """Two attempts for every line of every document."""
    attempts = fx.documents(spark, sf).selectExpr("doc_id", "posexplode(split(text, '\\n')) AS (group_no, x)").selectExpr(
        "doc_id", "cast(group_no as bigint) AS group_no", "explode(array(1, 2)) AS attempt").selectExpr(
        "doc_id", "group_no", "attempt", "(doc_id + group_no * attempt) % 4 AS n_rows", "2 AS expected")
    return longs(ex.keep_attempts(attempts).drop("expected"), "attempt", "n_rows")


MAPPING = {"Repère": "reference", "Conclusion": "resultat"}


def read_ids(prompts, temperature, max_tokens, schema=None):
    """Stand-in for a model that reads: one row for each id-like word of the text, present where its number is even."""
    import json
    import re

    found = [re.findall(r"(?<!\w)[A-Z]{1,5}-?[0-9]{2,5}(?!\w)", p.split(xt.TEXT_MARK, 1)[1]) for p in prompts]
    return [json.dumps([{"reference": x, "resultat": "présence" if int(x[-1]) % 2 == 0 else "absence"} for x in ids], ensure_ascii=False) for ids in found]


_FOUND = [fx.reshaped_sql(CLEAN_SQL), f"w AS (SELECT doc_id, {q.words('text')} AS w FROM docs), g AS (SELECT doc_id, i // 1200 AS group_no, array_to_string(list_slice(w, i + 1, i + 1500), ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w), 1200)) AS i FROM w))",
  rf"""ids AS (SELECT doc_id, group_no, list_transform(regexp_extract_all(regexp_replace(t, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'),
    '(?:^|[^\p{{L}}\p{{N}}_])([A-Z]{{1,5}}(?:--)?\p{{Nd}}{{2,5}})(?:[^\p{{L}}\p{{N}}_]|$)', 1), lambda x: replace(x, '--', '-')) AS ids FROM g)"""]


@query("ext_retry", q.with_(_FOUND, """
SELECT doc_id, group_no, len(ids)::BIGINT AS n_rows, greatest(len(list_distinct(ids)), 1)::BIGINT AS expected, CASE WHEN len(ids) = 0 THEN 2 ELSE 1 END::BIGINT AS calls FROM ids"""))
def ext_retry(spark, sf):
    """Groups that give no row are asked once more, others are not."""
    _, attempts = xt.ask_groups(mk.word_windows(reports(spark, sf)), MAPPING, read_ids)
    out = attempts.groupBy("doc_id", "group_no").agg(F.max("n_rows").alias("n_rows"), F.max("expected").alias("expected"), F.count("*").alias("calls"))
    return longs(out, "group_no", "n_rows", "expected")


@query("ext_results", q.with_([*_FOUND, "one AS (SELECT doc_id, group_no, generate_subscripts(ids, 1) AS i, unnest(ids) AS x FROM ids)",
  "firsts AS (SELECT doc_id, min(group_no * 100000 + i) AS o, min_by(x, group_no * 100000 + i) AS x FROM one GROUP BY doc_id, lower(x))"], """
SELECT doc_id, string_agg(x, ' ' ORDER BY o) AS ids, count(*) AS total, count(*) FILTER (right(x, 1)::INT % 2 = 0) AS presence, count(*) FILTER (right(x, 1)::INT % 2 = 1) AS absence, 0::BIGINT AS unknown
FROM firsts GROUP BY 1"""))
def ext_results(spark, sf):
    """From groups to the rows and the statistics of whole documents."""
    rows, _ = xt.ask_groups(mk.word_windows(reports(spark, sf)), MAPPING, read_ids)
    kept = fx.stored(xt.whole_document(rows))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.col("fields.reference").alias("x")))), lambda r: r["x"]), " ")
    return kept.groupBy("doc_id").agg(ids.alias("ids")).join(ex.outcome_stats(kept), "doc_id")


@query("ext_dedupe", q.with_(PARSED, "SELECT doc_id, row_no, localisation, reference, resultat FROM dedup"))
def ext_dedupe(spark, sf):
    return longs(ex.project_mapping(ex.dedupe(rows(spark, sf)), TARGETS), "row_no")


_OUT = r"""CASE WHEN contains(r, 'présence') OR contains(r, 'presence') OR regexp_matches(r, '(?:^|[^\p{L}\p{N}_])(?:ep|ac1|ac2)(?:[^\p{L}\p{N}_]|$)') THEN 'presence'
  WHEN contains(r, 'absence') OR contains(r, 'non détecté') OR contains(r, 'non detecte') THEN 'absence' ELSE 'unknown' END"""


@query("ext_outcome", q.with_(PARSED, f"SELECT doc_id, row_no, {_OUT} AS outcome FROM (SELECT *, lower(coalesce(resultat, '')) AS r FROM rws)"))
def ext_outcome(spark, sf):
    return longs(rows(spark, sf).select("doc_id", "row_no", ex.outcome(F.col("fields.resultat")).alias("outcome")), "row_no")


@query("ext_stats", q.with_(PARSED, f"""
SELECT doc_id, count(*) AS total, CASE WHEN h THEN count(*) FILTER (k = 'presence') END AS presence, CASE WHEN h THEN count(*) FILTER (k = 'absence') END AS absence,
  CASE WHEN h THEN count(*) FILTER (k = 'unknown') END AS unknown
FROM (SELECT doc_id, {_OUT} AS k, first_value(list_contains(json_keys(e), 'resultat')) OVER (PARTITION BY doc_id ORDER BY row_no) AS h FROM (SELECT *, lower(coalesce(resultat, '')) AS r FROM rws)) GROUP BY doc_id, h"""))
def ext_stats(spark, sf):
    return ex.outcome_stats(rows(spark, sf))


@query("ext_header_fields", """
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source || ' rue' END AS adresse_immeuble, CASE WHEN doc_id % 3 > 0 THEN doc_id::VARCHAR END AS reference_dossier,
  NULL::VARCHAR AS date_reperage, CASE WHEN doc_id % 3 = 1 THEN lang END AS operateur, NULL::VARCHAR AS laboratoire FROM documents""")
def ext_header_fields(spark, sf):
    """Header answers: fenced with an operator, plain without one, or no JSON at all."""
    text = """CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN concat('```json\\n{"adresse_immeuble": "', source, ' rue", "reference_dossier": "', doc_id, '", "operateur": "', lang, '"}\\n```')
      ELSE concat('{"adresse_immeuble": "', source, ' rue", "reference_dossier": ', doc_id, ', "laboratoire": null}') END"""
    docs = fx.table(spark, sf, "documents").selectExpr("doc_id", f"{text} AS response")
    return ex.header_fields(ex.repair_json(docs))


REPORT_TEMPLATE = {"name": "Analyse du dossier", "sections": [
    {"key": "presentation", "label": "Présentation", "description": "Qui parle, de quoi"},
    {"key": "methodologie", "label": "Méthodologie", "description": "Comment le travail sera fait"},
    {"key": "note", "label": "Note", "description": "Points forts et faibles"},
]}


@query("ext_report_format", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN source ELSE '# Analyse du dossier' || chr(10) || chr(10) || '## Présentation' || chr(10) || source || chr(10) || chr(10) ||
  '## Méthodologie' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN lang ELSE 'Information non disponible' END || chr(10) || chr(10) || '## Note' || chr(10) ||
  CASE WHEN doc_id % 4 = 1 THEN 'None' ELSE doc_id::VARCHAR END || chr(10) END AS report FROM documents""")
def ext_report_format(spark, sf):
    text = """CASE WHEN doc_id % 4 = 3 THEN source ELSE concat('Bien sûr. {"note": ', CASE WHEN doc_id % 4 = 1 THEN 'null' ELSE string(doc_id) END,
      CASE WHEN doc_id % 4 = 0 THEN concat(', "methodologie": "', lang, '"') ELSE '' END, ', "presentation": "', source, '"} Voilà.') END"""
    docs = fx.table(spark, sf, "documents").selectExpr("doc_id", f"{text} AS response")
    return ex.format_report(docs, REPORT_TEMPLATE)


@query("snk_results_json", q.with_(PARSED, """
SELECT doc_id, '{"total":' || count(*) || ',"first":' || CASE WHEN min_by(coalesce(localisation, ''), row_no) = '' THEN 'null' ELSE '"' || min_by(localisation, row_no) || '"' END || '}' AS result FROM dedup GROUP BY 1"""))
def snk_results_json(spark, sf):
    unique = ex.dedupe(rows(spark, sf))
    totals = unique.groupBy("doc_id").agg(F.count("*").alias("total"), F.min_by(F.col("fields")["localisation"], "row_no").alias("first"))
    return sk.result_json(totals, ["total", "first"])


_ISSUES_SPARK = """transform(split(text, '\\n'), (x, i) -> named_struct('id', concat('issue_', lpad(string(i), 5, '0')),
  'type', element_at(array('ERREUR_REDACTION', 'ERREUR_FACTUELLE', 'REDONDANCE', 'INCOHERENCE_INTERNE', 'INCOHERENCE_EXTERNE', 'SUGGESTION', 'AUTRE'), cast(1 + (doc_id + i) % 7 as int)),
  'severity', element_at(array('CRITIQUE', 'MAJEUR', 'MINEUR', 'X', 'MINEUR'), cast(1 + i % 5 as int)), 'original_excerpt', substring_index(x, ' ', 2),
  'explanation', lang, 'suggestion', CASE WHEN i % 11 = 10 THEN NULL ELSE concat('[', i, ']') END, 'source_document', CASE WHEN i % 2 = 0 THEN source END))"""
ISSUES = ["""iss AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS issue_no, * EXCLUDE (doc_id) FROM (SELECT doc_id, i, 'issue_' || lpad(i::VARCHAR, 5, '0') AS id,
    ['ERREUR_REDACTION', 'ERREUR_FACTUELLE', 'REDONDANCE', 'INCOHERENCE_INTERNE', 'INCOHERENCE_EXTERNE', 'SUGGESTION', 'AUTRE'][1 + (doc_id + i) % 7] AS type,
    ['CRITIQUE', 'MAJEUR', 'MINEUR', 'X', 'MINEUR'][1 + i % 5] AS severity, array_to_string(list_slice(string_split(x, ' '), 1, 2), ' ') AS original_excerpt,
    lang AS explanation, CASE WHEN i % 11 <> 10 THEN '[' || i || ']' END AS suggestion, CASE WHEN i % 2 = 0 THEN source ELSE 'main' END AS source_document
  FROM (SELECT doc_id, lang, source, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS x FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS s FROM documents)))
  WHERE type <> 'AUTRE' AND severity <> 'X' AND suggestion IS NOT NULL)"""]


def reviews(spark, sf):
    return fx.documents(spark, sf).selectExpr("doc_id", "text", "lang", f"to_json(named_struct('summary', source, 'issues', {_ISSUES_SPARK})) AS response")


@query("rev_parse_issues", q.with_(ISSUES, "SELECT doc_id, issue_no, id, type, severity, original_excerpt, explanation, suggestion, source_document FROM iss"))
def rev_parse_issues(spark, sf):
    return longs(rv.parse_issues(reviews(spark, sf)), "issue_no")


@query("rev_focus_types", q.with_(ISSUES, """
SELECT doc_id, id, type FROM iss WHERE CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN type IN ('ERREUR_REDACTION', 'REDONDANCE')
  WHEN 2 THEN type IN ('INCOHERENCE_INTERNE', 'INCOHERENCE_EXTERNE') ELSE type = 'ERREUR_FACTUELLE' END"""))
def rev_focus_types(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in rv.REVIEW_FOCUS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return rv.in_focus(rv.parse_issues(reviews(spark, sf)), kind).select("doc_id", "id", "type")


@query("rev_by_type", q.with_(ISSUES, "SELECT doc_id, " + ", ".join(f"nullif(count(*) FILTER (type = '{t}'), 0) AS {t}" for t in rv.ISSUE_TYPES) + " FROM iss GROUP BY 1"))
def rev_by_type(spark, sf):
    return rv.count_by_type(rv.parse_issues(reviews(spark, sf)))


@query("rev_by_severity", q.with_(ISSUES, "SELECT doc_id, " + ", ".join(f"nullif(count(*) FILTER (severity = '{t}'), 0) AS {t}" for t in rv.SEVERITIES) + " FROM iss GROUP BY 1"))
def rev_by_severity(spark, sf):
    return rv.count_by_severity(rv.parse_issues(reviews(spark, sf)))


@query("rev_critical_count", q.with_(ISSUES, "SELECT doc_id, count(*) FILTER (severity = 'CRITIQUE') AS critical FROM iss GROUP BY 1"))
def rev_critical_count(spark, sf):
    return rv.critical_counts(rv.parse_issues(reviews(spark, sf)))


def _decided(spark, sf):
    """No decision list for a third of the documents, an empty one for a third, even ids for the rest."""
    parsed = reviews(spark, sf).select("doc_id", "text", rv.issue_list(F.col("response")).alias("issues"))
    even = F.filter(F.transform("issues", lambda i: i["id"]), lambda i: F.substring(i, -1, 1).cast("int") % 2 == 0)
    ids = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>")).otherwise(even)
    return parsed.select("doc_id", "text", F.col("issues"), ids.alias("accepted_ids"))


_ACCEPTED = "acc AS (SELECT * FROM iss WHERE doc_id % 3 = 0 OR (doc_id % 3 = 2 AND right(id, 1)::INT % 2 = 0))"


@query("rev_accept", q.with_([*ISSUES, _ACCEPTED], "SELECT doc_id, id FROM acc"))
def rev_accept(spark, sf):
    out = _decided(spark, sf).select("doc_id", F.explode(rv.accepted(F.col("issues"), F.col("accepted_ids"))).alias("i"))
    return out.select("doc_id", "i.id")


@query("rev_apply", q.with_([*ISSUES, _ACCEPTED, "ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS o FROM acc WHERE original_excerpt <> '')",
  """wrk AS (SELECT doc_id, 0::BIGINT AS o, text, '' AS log, 0::BIGINT AS applied FROM documents
  UNION ALL SELECT w.doc_id, w.o + 1, replace(w.text, s.original_excerpt, s.suggestion), w.log || CASE WHEN contains(w.text, s.original_excerpt) THEN s.id || ';' ELSE '' END, w.applied + 1
  FROM wrk w JOIN ord s ON s.doc_id = w.doc_id AND s.o = w.o + 1)"""], """
SELECT doc_id, max_by(text, o) AS corrected_text, max_by(applied, o) AS n_applied, max_by(log, o) AS logged FROM wrk GROUP BY 1"""))
def rev_apply(spark, sf):
    decided = _decided(spark, sf).select("doc_id", "text", rv.accepted(F.col("issues"), F.col("accepted_ids")).alias("issues"))
    out = rv.apply_corrections(decided, F.col("issues"))
    logged = F.array_join(F.transform("change_log", lambda c: F.concat(c["id"], F.lit(";"))), "")
    return out.select("doc_id", "corrected_text", F.size("applied_issue_ids").cast("long").alias("n_applied"), logged.alias("logged"))
