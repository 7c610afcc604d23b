"""Classification, conversations, jobs, streams, prompts and model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import models as md, text as tx, vectors as vx, vocabulary as vo
from dossierlake.operators import chunking as ck, classify as cl, conversations as cv, markup as mk, prompts as pr, search as se, sections as sc
from dossierlake.plans import answering as an, drafting as dr, fallback as fb, hybrid as hy, summarising as sm
from dossierlake.session import scratch_folder
from dossierlake.sources import intake as it
from dossierlake.sources import corpus as cp
from dossierlake.streaming import idle_state as st, ingest as si
from workload import fixtures as fx, sqltext as q
from workload.extract_queries import REPORT_TEMPLATE
from workload.kit import query
from workload.section_queries import HINT_SPARK, HINTS, headed
from workload.text_queries import GUIDE_SPARK, longs

# ---------------------------------------------------------------- classification

BOILERPLATE = [n for e in vo.BOILERPLATE_SECTIONS.values() for n in vo.names(e)]
_LANES = """lanes AS (SELECT *, CASE WHEN label % 2 = 0 THEN 'memoire' ELSE 'programme' END AS lane FROM embeddings)"""
_CENT = "cent AS (SELECT lane, [list_avg([v[i] FOR v IN vs]) FOR i IN range(1, 65)] AS c FROM (SELECT lane, list(embedding::DOUBLE[]) AS vs FROM lanes GROUP BY 1))"
_NEAR = """near AS (SELECT vec_id, l.lane AS label, round(list_cosine_similarity(embedding::DOUBLE[], m.c), 9) AS sm, round(list_cosine_similarity(embedding::DOUBLE[], p.c), 9) AS sp
  FROM lanes l, (SELECT c FROM cent WHERE lane = 'memoire') m, (SELECT c FROM cent WHERE lane = 'programme') p),
picked AS (SELECT vec_id, label, CASE WHEN abs(sm - sp) >= 0.05 THEN CASE WHEN sm > sp THEN 'memoire' ELSE 'programme' END END AS lane,
  CASE WHEN abs(sm - sp) >= 0.05 THEN round(abs(sm - sp), 3) END AS confidence FROM near)"""


def labelled_vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").withColumn("lane", F.when(F.col("label") % 2 == 0, cl.MEMOIRE).otherwise(cl.PROGRAMME))


@query("cls_dict")
def cls_dict(spark, sf):
    heads = sc.headings(headed(spark, sf)).select("doc_id", "heading_no", "title")
    return longs(heads.withColumn("boilerplate", cl.is_boilerplate(F.col("title"), BOILERPLATE)), "heading_no")


@query("cls_centroid", q.with_([_LANES, _CENT], "SELECT lane, i - 1 AS pos, round(v, 6) AS value FROM (SELECT lane, generate_subscripts(c, 1) AS i, unnest(c) AS v FROM cent)"))
def cls_centroid(spark, sf):
    out = cl.centroids(labelled_vectors(spark, sf), "lane")
    return out.select("lane", F.posexplode("centroid").alias("pos", "value")).select("lane", F.col("pos").cast("long"), F.round("value", 6).alias("value"))


def _picked(spark, sf):
    vectors = labelled_vectors(spark, sf)
    return cl.nearest_lane(vectors.select("vec_id", "embedding", F.col("lane").alias("label")), cl.lane_centroids(vectors))


@query("cls_nearest", q.with_([_LANES, _CENT, _NEAR], "SELECT vec_id, lane, confidence FROM picked"))
def cls_nearest(spark, sf):
    return _picked(spark, sf).select("vec_id", "lane", "confidence")


@query("cls_label_eval", q.with_([_LANES, _CENT, _NEAR], "SELECT label, lane, count(*) AS n FROM picked GROUP BY 1, 2"))
def cls_label_eval(spark, sf):
    return cl.label_counts(_picked(spark, sf))


@query("cls_cascade")
def cls_cascade(spark, sf):
    """All headings; the outside answer depends on the title's length only."""
    heads = sc.headings(headed(spark, sf)).select("doc_id", "heading_no", "title")

    def ask(titles):
        return ["Programme." if len(t) % 2 else "memoire" for t in titles]

    out = cl.cascade(heads, BOILERPLATE, cl.exemplar_centroids(), ask=ask)
    return longs(out, "heading_no")


# ---------------------------------------------------------------- conversations and jobs

@query("cnv_history", q.with_([fx.TURNS], """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ts, part, text) - 1 AS message_no, role, text FROM turns"""))
def cnv_history(spark, sf):
    return cv.history(fx.turns(spark, sf))


# Every fifth event of a user comes 5 to 9 days late, so that some conversations expire within the batch.
_LATE = "event_id * 120 + CASE WHEN event_id % 5 = 0 THEN (event_id % 9 + 1) * 86400 ELSE 0 END"
_EXCHANGES = f"exch AS (SELECT user_id AS conv_id, {fx.START} + {_LATE} AS at_ts, event_type AS question, props AS answer FROM events)"


@query("cnv_append_turn", q.with_([fx.TURNS, _EXCHANGES, "seen AS (SELECT conv_id, max(ts) AS last_ts FROM turns GROUP BY 1)",
  "steps AS (SELECT e.*, last_ts, at_ts - greatest(last_ts, lag(at_ts) OVER (PARTITION BY conv_id ORDER BY at_ts)) >= 604800 AS gap FROM exch e LEFT JOIN seen USING (conv_id))",
  "judged AS (SELECT *, last_ts IS NOT NULL AND coalesce(at_ts < min(at_ts) FILTER (gap) OVER (PARTITION BY conv_id), true) AS ok FROM steps)"], """
SELECT 'turn' AS kind, conv_id, ts, role AS detail, text FROM turns
UNION ALL SELECT 'turn', conv_id, at_ts, 'user', question FROM judged WHERE ok UNION ALL SELECT 'turn', conv_id, at_ts, 'assistant', answer FROM judged WHERE ok
UNION ALL SELECT 'refused', conv_id, at_ts, CASE WHEN last_ts IS NULL THEN 'unknown' ELSE 'expired' END, NULL FROM judged WHERE NOT ok"""))
def cnv_append_turn(spark, sf):
    exchanges = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("conv_id"), (F.lit(fx.START) + F.expr(_LATE)).alias("at"), F.col("event_type").alias("question"), F.col("props").alias("answer"))
    nxt, refused = cv.append_turns(fx.turns(spark, sf), exchanges)
    return nxt.select(F.lit("turn").alias("kind"), "conv_id", "ts", F.col("role").alias("detail"), "text").union(
        refused.select(F.lit("refused"), "conv_id", "at", "reason", F.lit(None).cast("string")))


# Gaps of over half an hour between the events of a user.
_SESSION_IDLE = 1800


@query("cnv_sessions", f"""
WITH t AS (SELECT user_id AS conv_id, {fx.START} + event_id * 120 AS ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts) < {_SESSION_IDLE} THEN 0 ELSE 1 END AS new FROM t),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY ts) AS run FROM g)
SELECT conv_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_messages FROM r GROUP BY conv_id, run""")
def cnv_sessions(spark, sf):
    events = fx.table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), (F.lit(fx.START) + F.col("event_id") * 120).alias("ts"))
    return cv.sessions(cv.timed(events), _SESSION_IDLE)


@query("cnv_last_n", q.with_([fx.TURNS, "r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, part DESC) AS r FROM turns)"], """
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Utilisateur' ELSE 'Assistant' END || ' : ' || text, chr(10) ORDER BY r DESC) AS history FROM r WHERE r <= 6 GROUP BY 1"""))
def cnv_last_n(spark, sf):
    return cv.last_messages(fx.turns(spark, sf))


_STANDALONE = """standing AS (SELECT query_id, a.conv_id, corpus_key, text AS question, CASE WHEN history IS NULL THEN text ELSE
    trim('Historique de la conversation :' || chr(10) || history || chr(10) || chr(10) || 'Nouvelle question : ' || text) END AS text
  FROM asked a LEFT JOIN hist USING (conv_id))"""


@query("cnv_first_turn", q.with_([*fx.QUESTIONS, _STANDALONE], "SELECT conv_id, question, text AS standalone FROM standing"))
def cnv_first_turn(spark, sf):
    asked, earlier = fx.questions(spark, sf)
    return an.standalone(asked, earlier).select("conv_id", F.col("text").alias("question"), "standalone")


@query("cnv_docs_index", """
WITH c AS (SELECT DISTINCT conv_id FROM conversations), p AS (SELECT conv_id, conv_id AS doc_id FROM c UNION SELECT conv_id, conv_id + 1 FROM c UNION SELECT conv_id, conv_id % 7 FROM c
  UNION SELECT conv_id, 7 FROM c WHERE conv_id % 2 = 0)
SELECT doc_id, conv_id FROM p WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def cnv_docs_index(spark, sf):
    convs = fx.table(spark, sf, "conversations").select("conv_id").distinct()
    index = cv.documents_index(convs.select("conv_id", F.array(F.col("conv_id"), F.col("conv_id") + 1, F.col("conv_id") % 7).alias("doc_ids")))
    grown = cv.add_documents(index, convs.filter("conv_id % 2 = 0").select(F.lit(7).cast("long").alias("doc_id"), "conv_id"))
    return cv.delete_conversations(grown, fx.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("conv_id")))


_AS_OF = fx.START + 9 * 24 * 3600


@query("cnv_expire", q.with_([fx.TURNS], f"SELECT conv_id, max(ts) AS last_ts FROM turns GROUP BY 1 HAVING {_AS_OF} - max(ts) < 604800"))
def cnv_expire(spark, sf):
    return cv.live(fx.turns(spark, sf), _AS_OF)


@query("cnv_state_ttl", q.with_([fx.TURNS], "SELECT conv_id, count(*) AS n_messages, max(ts) AS last_ts FROM turns GROUP BY 1"))
def cnv_state_ttl(spark, sf):
    """All turns through the stateful stream; the state is read from its last update rows."""
    settings = {"spark.sql.streaming.stateStore.providerClass": st.STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        schema = fx.table(spark, sf, "conversations").schema
        raw = si.table_stream(spark, f"{sf}/conversations.parquet", schema)
        live = raw.filter("role IN ('user', 'assistant')").select(
            "conv_id", (F.lit(fx.START) + F.col("conv_id") * 7200 + F.col("turn") * 60).alias("ts"))
        root = scratch_folder(spark, "activity")
        st.start_activity(live, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.parquet(f"{root}/out")
    return updates.groupBy("conv_id").agg(F.max_by("n_messages", "batch").alias("n_messages"), F.max("last_ts").alias("last_ts"))


@query("job_latest_status", q.with_([fx.JOB_EVENTS], """
SELECT job_id, status, current, total::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM job_events) WHERE r = 1"""))
def job_latest_status(spark, sf):
    return longs(cv.latest_status(fx.job_events(spark, sf)).drop("ts"), "total")


@query("job_ready", q.with_([fx.JOB_EVENTS], """
SELECT job_id, status = 'done' AS ready, CASE WHEN status <> 'done' THEN 'job is ' || status END AS conflict
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM job_events) WHERE r = 1"""))
def job_ready(spark, sf):
    return cv.ready(cv.latest_status(fx.job_events(spark, sf)))


@query("str_ingest", q.with_(q.chunk_ctes(), "SELECT corpus_key, doc_id, chunk_index, text, word_count FROM chunks"))
def str_ingest(spark, sf):
    schema = fx.table(spark, sf, "documents").schema
    root = scratch_folder(spark, "ingest")
    docs = si.table_stream(spark, f"{sf}/documents.parquet", schema)
    si.start_ingest(docs, f"{root}/corpus", f"{root}/checkpoint").awaitTermination()
    return longs(cp.opened(spark, f"{root}/corpus").chunks(), "chunk_index", "word_count")


# ---------------------------------------------------------------- search compositions

_CHUNKS = q.chunk_ctes()
_POST = [*_CHUNKS, *q.posting_ctes()]


@query("sch_ephemeral", q.with_([*_CHUNKS, *q.posting_ctes(corpus="doc_id"),
    *q.query_ctes(f"SELECT doc_id AS query_id, doc_id AS corpus_key, array_to_string(list_slice({q.words('text')}, 1, 12), ' ') AS text FROM documents", scoped=True),
    q.bm25_cte(scoped=True), f"alltoks AS (SELECT doc_id AS corpus_key, doc_id, chunk_index, {q.words('lower(text)')} AS ts FROM chunks)",
    *q.vector_ctes("alltoks", scoped=True), q.scaled("cosines", "cosine", "semantic", "sem_s"), q.scaled("kw", "bm25", "keyword", "kw_s"),
    q.FUSED, q.top("fused", "hybrid_score", 10, "ranked")], """
SELECT query_id, chunk_index, round(semantic_score, 5) AS semantic_score, round(bm25_score, 5) AS bm25_score, source, rank FROM ranked"""))
def sch_ephemeral(spark, sf):
    """Each document searched with its own first words, statistics per document."""
    docs = fx.documents(spark, sf)
    chunks = fx.stored(ck.retrieval_chunks(docs).withColumn("corpus_key", F.col("doc_id")))
    queries = docs.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("corpus_key"), tx.first_words(F.col("text"), 12).alias("text"))
    hits = hy.search_given_chunks(chunks, queries, se.TOP_K)
    return longs(hits.select("query_id", "chunk_index", F.round("semantic_score", 5).alias("semantic_score"),
                             F.round("bm25_score", 5).alias("bm25_score"), "source", "rank"), "chunk_index", "rank")


@query("sch_fuse", q.with_([*_POST, *q.query_ctes(fx.BENCHMARK_QUERIES), *q.hybrid_ctes()], """
SELECT query_id, doc_id, chunk_index, round(semantic_score, 6) AS semantic_score, round(bm25_score, 6) AS bm25_score, hybrid_score, source FROM fused"""))
def sch_fuse(spark, sf):
    index = fx.index(spark, sf)
    queries = fx.benchmark_queries(spark, sf)
    keyword = se.keyword_top(index.postings, index.stats, queries, 2 * se.TOP_K)
    meaning = se.semantic(index.vectors, queries.withColumn("embedding", vx.embed(F.col("text"))), 2 * se.TOP_K)
    out = se.fuse(se.minmax_short(meaning, "similarity", "semantic"), se.minmax_short(keyword, "bm25", "keyword"))
    return longs(out.select("query_id", "doc_id", "chunk_index", *[F.round(c, 6).alias(c) for c in ("semantic_score", "bm25_score")], "hybrid_score", "source"), "chunk_index")


_NAMED = "named AS (SELECT r.*, c.text, source_name AS file_name FROM ranked r JOIN chunks c USING (doc_id, chunk_index) JOIN (SELECT doc_id, source || '_' || doc_id || '.pdf' AS source_name FROM documents) USING (doc_id))"
_PCT = "format('{:.0f}%', round_even({} * 100, 0))"


def _pct(c):
    return f"(round_even({c} * 100, 0)::BIGINT || '%')"


_CONTEXT = f"""ctx AS (SELECT query_id, string_agg('[Source ' || n || ' — ' || file_name || ', section ' || chunk_index || ', pertinence: ' || {_pct('hybrid_score')} || ' (sémantique: ' || {_pct('semantic_score')}
    || ', mots-clés: ' || {_pct('bm25_score')} || ')]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM named WHERE hybrid_score >= 0.3) GROUP BY 1)"""


def _named_hits(spark, sf):
    chunks = fx.chunks(spark, sf)
    hits = hy.over_tables(se.write_tables(ck.searchable(chunks), scratch_folder(spark, "index")), fx.benchmark_queries(spark, sf))
    return hy.with_text(hits, chunks.select("doc_id", "chunk_index", "text")).join(fx.doc_meta(spark, sf).select("doc_id", "file_name"), "doc_id")


_FULL = [*_POST, *q.query_ctes(fx.BENCHMARK_QUERIES), *q.hybrid_ctes()]


@query("sch_context", q.with_([*_FULL, _NAMED, _CONTEXT], f"SELECT query_id, coalesce(context, {q.lit(se.NOTHING_FOUND)}) AS context FROM q LEFT JOIN ctx USING (query_id)"))
def sch_context(spark, sf):
    return se.context(_named_hits(spark, sf), fx.benchmark_queries(spark, sf))


@query("sch_min_score", q.with_(_FULL, """
SELECT query_id, doc_id, chunk_index, 'context' AS used_for FROM ranked WHERE hybrid_score >= 0.3
UNION ALL SELECT query_id, doc_id, chunk_index, 'analysis' FROM ranked WHERE hybrid_score > 0.2
UNION ALL SELECT query_id, doc_id, chunk_index, 'fallback' FROM ranked WHERE hybrid_score >= 0.25"""))
def sch_min_score(spark, sf):
    hits = fx.stored(hy.over_tables(fx.index(spark, sf), fx.benchmark_queries(spark, sf)))
    floors = (("context", se.MIN_SCORE, False), ("analysis", se.MIN_SCORE_ANALYSIS, True), ("fallback", se.MIN_SCORE_FALLBACK, False))
    parts = [longs(se.min_score(hits, floor, strict).select("query_id", "doc_id", "chunk_index", F.lit(use).alias("used_for")), "chunk_index")
             for use, floor, strict in floors]
    return parts[0].union(parts[1]).union(parts[2])


@query("sch_source_records", q.with_([*_FULL, _NAMED], "SELECT query_id, doc_id, file_name, chunk_index, round(hybrid_score, 3) AS hybrid_score FROM named"))
def sch_source_records(spark, sf):
    out = se.source_records(_named_hits(spark, sf))
    return longs(out.select("query_id", "doc_id", "file_name", "chunk_index", "hybrid_score"), "chunk_index")


# One query per (source, template section), answered within the source.
_SECTIONS = [(i, s["label"], s["description"]) for i, s in enumerate(REPORT_TEMPLATE["sections"])]
_TEMPLATE_SQL = "(VALUES " + ", ".join(f"({i}, {q.lit(a)}, {q.lit(b)})" for i, a, b in _SECTIONS) + ") s(section_no, label, description)"
_MULTI_Q = f"""SELECT CAST(substr(source, 4) AS BIGINT) * 10 + section_no AS query_id, source AS corpus_key, label || ' : ' || description || ' ' || word AS text
  FROM (SELECT source, min(regexp_extract(text, '[^ ]+')) AS word FROM documents GROUP BY 1), {_TEMPLATE_SQL}"""
_MULTI = [*_POST, *q.query_ctes(_MULTI_Q, scoped=True), *q.hybrid_ctes(3, scoped=True),
          """firsts AS (SELECT r.*, query_id // 10 AS src, query_id % 10 AS section_no FROM ranked r WHERE hybrid_score > 0.2),
   uniq AS (SELECT * FROM firsts f WHERE section_no = (SELECT min(section_no) FROM firsts g WHERE g.src = f.src AND g.doc_id = f.doc_id AND g.chunk_index = f.chunk_index))"""]


def _multi_hits(spark, sf):
    """hits of each template section in each source, each chunk for its first section only."""
    chunks = fx.chunks(spark, sf)
    src = F.expr("cast(substr(source, 4) as bigint)")
    words = fx.table(spark, sf, "documents").groupBy("source").agg(F.min(F.regexp_extract("text", "[^ ]+", 0)).alias("word"))
    template = F.array(*[F.struct(F.lit(i).alias("section_no"), F.lit(a).alias("label"), F.lit(b).alias("description")) for i, a, b in _SECTIONS])
    sections = pr.section_queries(words.select("source", "word", F.inline(template)))
    queries = sections.select((src * 10 + F.col("section_no")).alias("query_id"), F.col("source").alias("corpus_key"), F.concat("text", F.lit(" "), "word").alias("text"))
    hits = se.min_score(hy.hybrid(chunks, queries, 3), se.MIN_SCORE_ANALYSIS, strict=True)
    keyed = fx.stored(hits.withColumn("src", F.floor(F.col("query_id") / 10)).withColumn("section_no", F.col("query_id") % 10))
    return chunks, se.first_section_wins(keyed, ["src"])


@query("sch_multi_query", q.with_(_MULTI, "SELECT query_id, doc_id, chunk_index, hybrid_score FROM uniq"))
def sch_multi_query(spark, sf):
    _, hits = _multi_hits(spark, sf)
    return longs(hits.select("query_id", "doc_id", "chunk_index", "hybrid_score"), "chunk_index")


@query("sch_word_budget", q.with_([*_MULTI, f"parts AS (SELECT u.*, {q.nwords('text')} AS part_words FROM uniq u JOIN chunks c USING (doc_id, chunk_index))",
  "run AS (SELECT *, sum(part_words) OVER (PARTITION BY src ORDER BY section_no, rank) AS running_words FROM parts)"], """
SELECT src, doc_id, chunk_index, part_words, running_words::BIGINT AS running_words FROM run WHERE running_words <= 1000"""))
def sch_word_budget(spark, sf):
    chunks, hits = _multi_hits(spark, sf)
    parts = hy.with_text(hits, chunks.select("doc_id", "chunk_index", "text"))
    out = se.word_budget(parts, ["src"], ["section_no", "rank"], "text", 1000)
    return longs(out.select("src", "doc_id", "chunk_index", "part_words", "running_words"), "src", "chunk_index", "part_words")


_LANE_CHUNKS = "lanechunks AS (SELECT c.doc_id, c.chunk_index, c.text, c.word_count, m.doc_type, m.project_id, m.corpus_key FROM chunks c JOIN doc_meta m USING (doc_id))"
_LANE_Q = "SELECT item_id AS query_id, text, item_id % 10 AS corpus_key FROM benchmark"


def _lane_queries(spark, sf):
    base = fx.benchmark_queries(spark, sf)
    return base.withColumn("lane", F.lit("memoire")).withColumn("project_id", F.lit(None).cast("long")).union(
        base.select("query_id", "text", F.lit("programme"), F.col("query_id") % 10))


def _lane_fixture(spark, sf):
    meta = fx.doc_meta(spark, sf).select("doc_id", "doc_type", "project_id", "file_name", "corpus_key")
    return fx.stored(ck.retrieval_chunks(fx.documents(spark, sf)).join(meta, "doc_id"))


def _lane_sql(lane, corpus, queries, scoped):
    found = q.with_([*_CHUNKS, fx.DOC_META, _LANE_CHUNKS, *q.posting_ctes(f"lanechunks WHERE word_count >= 30 AND doc_type = '{lane}'", corpus),
                     *q.query_ctes(queries, scoped=scoped), *q.hybrid_ctes(10, scoped=scoped)], "SELECT query_id, doc_id, chunk_index, hybrid_score, rank FROM ranked")
    return f"SELECT '{lane}' AS lane, * FROM ({found})"


@query("sch_lane_filter", _lane_sql("programme", "project_id", _LANE_Q, True) + " UNION ALL " + _lane_sql("memoire", "corpus_key", "SELECT item_id AS query_id, text FROM benchmark", False))
def sch_lane_filter(spark, sf):
    """Every question in both lanes: bound to a project, and free over all earlier documents."""
    hits = dr.lane_hits(_lane_queries(spark, sf), _lane_fixture(spark, sf))
    return longs(hits.select("lane", "query_id", "doc_id", "chunk_index", "hybrid_score", "rank"), "chunk_index", "rank")


_FALLBACK_Q = "fq(category, text) AS (VALUES " + ", ".join(f"('{c}', {q.lit(t)})" for c, t in vo.FALLBACK_QUERIES.items()) + ")"


@query("sec_fallback_search", q.with_([*HINTS, *_CHUNKS, _FALLBACK_Q,
    f"catg AS (SELECT doc_id, coalesce(category, '{vo.DEFAULT_CATEGORY}') AS category FROM hints LEFT JOIN hit USING (doc_id) LEFT JOIN (SELECT DISTINCT entry_no, category FROM dict) USING (entry_no))",
    *q.posting_ctes(corpus="doc_id"), *q.query_ctes("SELECT doc_id AS query_id, doc_id AS corpus_key, fq.text FROM catg JOIN fq USING (category)", scoped=True),
    q.bm25_cte(scoped=True), f"alltoks AS (SELECT doc_id AS corpus_key, doc_id, chunk_index, {q.words('lower(text)')} AS ts FROM chunks)",
    *q.vector_ctes("alltoks", scoped=True), q.scaled("cosines", "cosine", "semantic", "sem_s"), q.scaled("kw", "bm25", "keyword", "kw_s"),
    q.FUSED, q.top("fused", "hybrid_score", 3, "ranked"),
    "found AS (SELECT r.doc_id, string_agg(c.text, chr(10) || chr(10) ORDER BY c.chunk_index) AS text FROM ranked r JOIN chunks c USING (doc_id, chunk_index) WHERE hybrid_score >= 0.25 GROUP BY 1)"], f"""
SELECT doc_id, CASE WHEN f.text IS NULL THEN 'fallback_failed' ELSE 'rag_fallback' END AS source, NULL::VARCHAR AS heading, NULL::DOUBLE AS score, f.text AS text
FROM documents d LEFT JOIN (SELECT * FROM found WHERE {q.nwords('text')} >= 30) f USING (doc_id)"""))
def sec_fallback_search(spark, sf):
    """Documents as they are have no headings, so all of them go through search."""
    docs = fx.documents(spark, sf).selectExpr("doc_id", "text", f"{HINT_SPARK} AS hint")
    return fb.find_sections(docs, vo.CONSULTATION_SECTIONS, hint="hint").select("doc_id", "source", "heading", "score", "text")


# ---------------------------------------------------------------- prompts and model calls

@query("udf_embed", q.with_([*_POST, q._hashed("cvec", "doc_id, chunk_index", "SELECT doc_id, chunk_index, unnest(ts) AS term, 1 AS n FROM toks")],
    "SELECT doc_id, chunk_index, slot::BIGINT AS slot, v::DOUBLE AS value FROM cvec WHERE v <> 0"))
def udf_embed(spark, sf):
    vectors = se.chunk_vectors(ck.searchable(ck.retrieval_chunks(fx.documents(spark, sf))))
    cells = vectors.select("doc_id", "chunk_index", F.posexplode("embedding").alias("slot", "value")).filter("value <> 0")
    return cells.select("doc_id", F.col("chunk_index").cast("long"), F.col("slot").cast("long"), F.col("value").cast("double"))


@query("udf_generate", "SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN md5(text) END AS content, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: empty prompt' END AS error FROM documents")
def udf_generate(spark, sf):
    """A model that refuses empty prompts: every tenth document has one."""
    def model(prompts, temperature, max_tokens, schema):
        if "" in prompts:
            raise ValueError("empty prompt")
        return md.digest(prompts, temperature, max_tokens)

    prompt = F.when(F.col("doc_id") % 10 > 0, F.col("text")).otherwise("")
    out = fx.documents(spark, sf).withColumn("r", md.generate(prompt, model, 0.0, 20))
    return out.select("doc_id", "r.content", "r.error")


@query("prm_build", f"""
SELECT doc_id, 'Section à rédiger : "' || source || '"' || chr(10) || chr(10) || 'Consigne spécifique de l''utilisateur pour cette section : ' || lang || chr(10) || chr(10) ||
  CASE WHEN doc_id % 2 = 0 THEN {q.lit(pr.PROJECT_STEER)} || 'sobre' || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN doc_id % 3 = 0 OR text = '' THEN {q.lit(pr.NO_REFERENCE)} ELSE 'Informations disponibles pour cette section :' || chr(10) || text END AS prompt FROM documents""")
def prm_build(spark, sf):
    docs = fx.documents(spark, sf)
    steer = F.when(F.col("doc_id") % 2 == 0, "sobre").otherwise("")
    context = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("text"))
    return docs.select("doc_id", pr.section_prompt(F.col("source"), F.col("lang"), context, steer).alias("prompt"))


@query("prm_messages", q.with_([fx.TURNS, "c AS (SELECT DISTINCT conv_id FROM conversations)", "n AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1)"], """
SELECT conv_id, 0 AS message_no, 'system' AS role, 'règles' AS content FROM c
UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ts, part, text), role, text FROM turns
UNION ALL SELECT conv_id, coalesce(n, 0) + 1, 'user', 'question ' || conv_id FROM c LEFT JOIN n USING (conv_id)"""))
def prm_messages(spark, sf):
    asked = fx.table(spark, sf, "conversations").select("conv_id").distinct().withColumn(
        "message", F.concat(F.lit("question "), F.col("conv_id").cast("string")))
    return pr.message_rows(cv.history(fx.turns(spark, sf)), asked, "règles")


@query("prm_comparison", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE chr(10) || chr(10) || 'DOCUMENTS DE RÉFÉRENCE POUR COMPARAISON :' || chr(10) || array_to_string(list_transform(
  string_split(text, chr(10)), lambda x, j: '--- DOCUMENT DE COMPARAISON : ' || source || (j - 1) || ' ---' || chr(10) || x || chr(10) || '---'), chr(10) || chr(10)) END AS block FROM documents""")
def prm_comparison(spark, sf):
    """All lines of a text are compared documents; every fourth document has none."""
    docs = fx.documents(spark, sf).selectExpr(
        "doc_id", "CASE WHEN doc_id % 4 > 0 THEN transform(split(text, '\\n'), (x, i) -> struct(concat(source, i) AS name, x AS text)) ELSE array() END AS comparisons")
    return docs.select("doc_id", pr.comparison_block(F.col("comparisons")).alias("block"))


@query("sum_map_reduce", q.with_([*q.chunk_ctes(2000, 0), "n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)",
  f"""mapped AS (SELECT doc_id, chunk_index, md5('Extrait du document :' || chr(10) || chr(10) || text || chr(10)) AS s FROM chunks JOIN n USING (doc_id) WHERE n > 1)""",
  "pts AS (SELECT doc_id, n, string_agg('Extrait ' || (chunk_index + 1) || ':' || chr(10) || s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) AS body FROM mapped JOIN n USING (doc_id) GROUP BY 1, 2 "
  "UNION ALL SELECT d.doc_id, coalesce(n, 0), 'Extrait 1:' || chr(10) || text FROM documents d LEFT JOIN n USING (doc_id) WHERE coalesce(n, 0) <= 1)"], f"""
SELECT doc_id, n AS n_parts, md5('Résumés partiels du document :' || chr(10) || chr(10) || body || chr(10) || {q.lit(pr.FINAL_SUMMARY)}) AS summary FROM pts"""))
def sum_map_reduce(spark, sf):
    out = sm.summarise(fx.documents(spark, sf))
    return longs(out.select("doc_id", "n_parts", "summary"), "n_parts")


_SYSTEM = "Réponds à partir des extraits seulement."


@query("ask_pipeline", q.with_([*_POST, *fx.QUESTIONS, _STANDALONE, *q.query_ctes("SELECT query_id, corpus_key, text FROM standing", scoped=True), *q.hybrid_ctes(5, scoped=True), _NAMED, _CONTEXT], f"""
SELECT query_id, s.text AS standalone, md5({q.lit(f"[system]{chr(10)}{_SYSTEM}{chr(10)}{chr(10)}")} || coalesce(said || chr(10) || chr(10), '') || '[user]' || chr(10) || 'Contexte extrait du document :' || chr(10) || chr(10) || coalesce(context, {q.lit(se.NOTHING_FOUND)}) || chr(10) || chr(10) || 'Question : ' || question) AS content
FROM standing s LEFT JOIN ctx USING (query_id)
LEFT JOIN (SELECT conv_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY ts, part, text) AS said FROM recent GROUP BY 1) USING (conv_id)"""))
def ask_pipeline(spark, sf):
    """The last question of every conversation, answered from the documents of its source."""
    asked, earlier = fx.questions(spark, sf)
    replies, _ = an.answer(asked, earlier, fx.chunks(spark, sf), fx.doc_meta(spark, sf), system=_SYSTEM)
    return replies.select("query_id", "standalone", "content")


@query("ask_documents", q.with_([*_CHUNKS, *fx.QUESTIONS, _STANDALONE, "scope AS (SELECT query_id, doc_id FROM asked JOIN documents ON doc_id % 25 = query_id % 25)",
  "scoped AS (SELECT query_id, c.* FROM chunks c JOIN scope USING (doc_id))", *q.posting_ctes("scoped WHERE word_count >= 30", "query_id"),
  *q.query_ctes("SELECT query_id, query_id AS corpus_key, text FROM standing", scoped=True), *q.hybrid_ctes(5, scoped=True), _NAMED], f"""
SELECT query_id, doc_id, chunk_index, file_name, round(hybrid_score, 3) AS hybrid_score FROM named WHERE hybrid_score >= 0.3"""))
def ask_documents(spark, sf):
    """Every question within a list of documents of its own; the sources of the answers."""
    asked, earlier = fx.questions(spark, sf)
    scope = asked.select("query_id").join(fx.documents(spark, sf).select("doc_id"), F.expr("doc_id % 25 = query_id % 25"))
    _, sources = an.answer(asked, earlier, fx.chunks(spark, sf), fx.doc_meta(spark, sf), scope=scope)
    return longs(sources.select("query_id", "doc_id", "chunk_index", "file_name", "hybrid_score"), "chunk_index")


@query("gen_sections")
def gen_sections(spark, sf):
    """Every web page is a section whose paragraphs are partly guidance; every document may be quoted."""
    pages = fx.table(spark, sf, "pages").withColumn("md", it.outline_markdown(fx.table(spark, sf, "pages")))
    text = f"array_join(transform(split(md, '\\n\\n'), (x, i) -> {GUIDE_SPARK}), '\\n')"
    sections = pages.selectExpr("page_id AS section_id", "page_id % 10 AS project_id", "split(md, '\\n')[0] AS title", f"{text} AS content")
    filled, _ = dr.draft_sections(sections, _lane_fixture(spark, sf), cl.exemplar_centroids(), BOILERPLATE)
    return filled
