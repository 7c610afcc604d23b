"""SQL pieces for the checking side (DuckDB dialect)."""

from __future__ import annotations

from dossierlake.functions.text import SPACE, SPACE_CHARS

WS = f"[{SPACE}]"
NON_WS = f"[^{SPACE}]"
_CHARS = "(" + " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS) + ")"
SEP = "chr(57344)"


def strip(x: str) -> str:
    return f"trim({x}, {_CHARS})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NON_WS}+')"


def nwords(x: str) -> str:
    return f"len({words(x)})"


def title_key(x: str) -> str:
    cut = rf"regexp_replace({strip(f'lower({x})')}, '^\p{{Nd}}[.\p{{Nd}}]*[).{SPACE}-]*', '')"
    return f"regexp_replace({cut}, '{WS}+', ' ', 'g')"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def lit(text: str) -> str:
    """A SQL string literal, with line breaks spelled out."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def with_(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


SENTENCES = rf"""sents AS (
  SELECT doc_id, source AS corpus_key, list_filter(list_transform(string_split(
    regexp_replace(text, '([.!?]){WS}+([A-Z\x{{c0}}-\x{{178}}\[])', '\1' || {SEP} || '\2', 'g'), {SEP}),
    lambda s: {strip('s')}), lambda s: length(s) > 10) AS s
  FROM documents)"""


def chunk_ctes(budget: int = 512, overlap: int = 64) -> list[str]:
    """CTEs ending in chunks(corpus_key, doc_id, chunk_index, text, word_count)."""
    return [
        SENTENCES,
        "flat AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS sent FROM sents)",
        f"""sized AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM (SELECT doc_id, i, {nwords('sent')} AS w FROM flat))""",
        f"""walk AS (
  SELECT doc_id, i, w AS size, i AS s, 0::BIGINT AS carried, NULL::BIGINT AS f_first, NULL::BIGINT AS f_carried,
         NULL::BIGINT AS f_word FROM sized WHERE i = 1
  UNION ALL
  SELECT z.doc_id, z.i,
    CASE WHEN k.size + z.w > {budget} THEN least({overlap}, k.size) ELSE k.size END + z.w,
    CASE WHEN k.size + z.w > {budget} THEN z.i ELSE k.s END,
    CASE WHEN k.size + z.w > {budget} THEN least({overlap}, k.size) ELSE k.carried END,
    CASE WHEN k.size + z.w > {budget} THEN k.s END,
    CASE WHEN k.size + z.w > {budget} THEN k.carried END,
    CASE WHEN k.size + z.w > {budget} THEN z.upto - z.w - k.size END
  FROM walk k JOIN sized z ON z.doc_id = k.doc_id AND z.i = k.i + 1)""",
        """extents AS (
  SELECT doc_id, f_first AS first, i - 1 AS last, f_carried AS carried, f_word AS word FROM walk WHERE f_first IS NOT NULL
  UNION ALL
  SELECT k.doc_id, k.s, k.i, k.carried, z.upto - k.size FROM walk k JOIN sized z USING (doc_id, i)
  WHERE k.i = (SELECT len(s) FROM sents q WHERE q.doc_id = k.doc_id))""",
        f"""packed AS (
  SELECT corpus_key, e.doc_id, first, array_to_string(list_concat(
    list_slice({words("array_to_string(s, ' ')")}, word + 1, word + carried), list_slice(s, first, last)), ' ') AS text
  FROM extents e JOIN sents USING (doc_id))""",
        f"""cut AS (
  SELECT corpus_key, doc_id, first, 0 AS part, NULL::VARCHAR AS piece, text AS rest FROM packed
  UNION ALL
  SELECT corpus_key, doc_id, first, part + 1,
    CASE WHEN length(rest) <= 6000 THEN rest ELSE {strip('left(rest, upto)')} END,
    CASE WHEN length(rest) <= 6000 THEN '' ELSE {strip('substr(rest, upto + 1)')} END
  FROM (SELECT *, CASE WHEN regexp_matches(left(rest, 6000), ' ') THEN
      length(regexp_extract(left(rest, 6000), '(?s)^(.*) ', 1)) ELSE 6000 END AS upto FROM cut WHERE rest <> ''))""",
        f"""chunks AS (
  SELECT corpus_key, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, part) - 1 AS chunk_index,
    piece AS text, {nwords('piece')} AS word_count
  FROM cut WHERE part > 0)""",
    ]


def posting_ctes(source: str = "chunks WHERE word_count >= 30", corpus: str = "corpus_key") -> list[str]:
    return [
        f"toks AS (SELECT {corpus} AS corpus_key, doc_id, chunk_index, {words('lower(text)')} AS ts FROM {source})",
        """post AS (SELECT corpus_key, doc_id, chunk_index, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT corpus_key, doc_id, chunk_index, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY 1, 2, 3, 4)""",
        """sizes AS (SELECT corpus_key, count(*) AS n_chunks, avg(len(ts)) AS avgdl FROM toks GROUP BY 1)""",
        """raw_idf AS (SELECT corpus_key, term, df, n_chunks, avgdl, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS r
  FROM (SELECT corpus_key, term, count(*) AS df FROM post GROUP BY 1, 2) JOIN sizes USING (corpus_key))""",
        """stats AS (SELECT corpus_key, term, df, n_chunks, avgdl,
    CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY corpus_key) ELSE r END AS idf FROM raw_idf)""",
    ]


def query_ctes(queries: str, scoped: bool = False) -> list[str]:
    """q(query_id, text[, corpus_key]) given as SQL; adds its terms."""
    scope = ", corpus_key" if scoped else ""
    return [
        f"q AS ({queries})",
        f"""qterms AS (SELECT query_id{scope}, term, count(*) AS qtf FROM
  (SELECT query_id{scope}, unnest({words('lower(text)')}) AS term FROM q) GROUP BY ALL)""",
    ]


def bm25_cte(scoped: bool = False) -> str:
    on = "q.term = p.term" + (" AND q.corpus_key = p.corpus_key" if scoped else "")
    return f"""kw AS (SELECT query_id, doc_id, chunk_index, round(total, 6) AS bm25 FROM (SELECT query_id, doc_id, chunk_index,
    sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS total
  FROM post p JOIN qterms q ON {on}
  JOIN stats t ON t.corpus_key = p.corpus_key AND t.term = p.term
  GROUP BY 1, 2, 3) WHERE total > 0)"""


def _hashed(kind: str, ids: str, rows: str) -> str:
    h = "('0x' || substr(md5(term), 1, 8))::UBIGINT"
    return f"""{kind} AS (SELECT {ids}, slot, sum(sign * n) AS v FROM (
    SELECT {ids}, n, ({h} % 64)::INT AS slot, CASE WHEN ({h} // 64) % 2 = 0 THEN 1 ELSE -1 END AS sign
    FROM ({rows})) GROUP BY ALL)"""


def vector_ctes(chunks: str = "toks", scoped: bool = False) -> list[str]:
    """cosines(query_id, doc_id, chunk_index, cosine) of every allowed pair, hashed vectors."""
    on = "c.corpus_key = q.corpus_key" if scoped else "true"
    return [
        _hashed("cvec", "doc_id, chunk_index",
                f"SELECT doc_id, chunk_index, unnest(ts) AS term, 1 AS n FROM {chunks}"),
        _hashed("qvec", "query_id", f"SELECT query_id, unnest({words('lower(text)')}) AS term, 1 AS n FROM q"),
        "cnorm AS (SELECT doc_id, chunk_index, sqrt(sum(v * v)) AS cn FROM cvec GROUP BY 1, 2)",
        "qnorm AS (SELECT query_id, sqrt(sum(v * v)) AS qn FROM qvec GROUP BY 1)",
        """dots AS (SELECT query_id, doc_id, chunk_index, sum(a.v * b.v) AS d
  FROM cvec a JOIN qvec b USING (slot) GROUP BY 1, 2, 3)""",
        f"""cosines AS (SELECT q.query_id, c.doc_id, c.chunk_index,
    round(CASE WHEN coalesce(cn, 0) * coalesce(qn, 0) = 0 THEN 0 ELSE coalesce(d, 0) / (cn * qn) END, 9) AS cosine
  FROM {chunks} c JOIN q ON {on} LEFT JOIN dots USING (query_id, doc_id, chunk_index)
  LEFT JOIN cnorm USING (doc_id, chunk_index) LEFT JOIN qnorm USING (query_id))""",
    ]


def top(source: str, score: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY {score} DESC, doc_id, chunk_index) AS rank FROM {source}) WHERE rank <= {k})"""


def scaled(source: str, score: str, out: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, chunk_index, CASE WHEN hi = lo THEN 1.0
    ELSE ({score} - lo) / (hi - lo) END AS {out} FROM (SELECT *, min({score}) OVER (PARTITION BY query_id) AS lo,
    max({score}) OVER (PARTITION BY query_id) AS hi FROM {source}))"""


FUSED = """fused AS (SELECT query_id, doc_id, chunk_index, coalesce(semantic, 0) AS semantic_score,
    coalesce(keyword, 0) AS bm25_score, round(0.3 * coalesce(semantic, 0) + 0.7 * coalesce(keyword, 0), 9) AS hybrid_score,
    CASE WHEN semantic IS NULL THEN 'bm25' WHEN keyword IS NULL THEN 'semantic' ELSE 'hybrid' END AS source
  FROM sem_s FULL JOIN kw_s USING (query_id, doc_id, chunk_index))"""


def hybrid_ctes(k: int = 10, scoped: bool = False) -> list[str]:
    """From post, stats, q, qterms, toks to ranked(query_id, doc_id, chunk_index, scores, source, rank)."""
    return [
        bm25_cte(scoped),
        *vector_ctes(scoped=scoped),
        "sims AS (SELECT query_id, doc_id, chunk_index, (1 + cosine) / 2 AS similarity FROM cosines)",
        top("kw", "bm25", 2 * k, "kw_top"), top("sims", "similarity", 2 * k, "sem_top"),
        scaled("kw_top", "bm25", "keyword", "kw_s"), scaled("sem_top", "similarity", "semantic", "sem_s"),
        FUSED, top("fused", "hybrid_score", k, "ranked"),
    ]
