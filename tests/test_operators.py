"""Operators against plain folds, and behaviour the tables do not show."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import models as md, text as tx, vectors as vx, vocabulary as vo
from dossierlake.operators import (chunking as ck, classify as cl, conversations as cv, extraction as ex, markup as mk,
                                   projects as pj, prompts as pr, registry as rg, search as se)
from dossierlake.plans import drafting as dr, fallback as fb, hybrid as hy, summarising as sm
from dossierlake.streaming import idle_state as st, ingest as si


def test_sentences_and_chunks_keep_every_word(spark):
    rng = random.Random(3)
    texts = ["", "Court.", "Un mot. Pas. " * 9]
    for _ in range(20):
        parts = []
        for _ in range(rng.randint(1, 120)):
            parts.append("Mot" + " mot" * rng.randint(1, 60) + rng.choice(".!?"))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts.append("x" * 14000 + " Fin. " + "y" * 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunks = {}
    for r in ck.pack_chunks(docs, budget=100, overlap=0).collect():
        chunks.setdefault(r.doc_id, {})[r.chunk_index] = r
    for i, text in enumerate(texts):
        own = [chunks[i][k] for k in range(len(chunks.get(i, {})))]
        kept = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-Ÿ\[])", text) if len(s.strip()) > 10]
        assert "".join("".join(c.text.split()) for c in own) == "".join("".join(s.split()) for s in kept)
        assert all(len(c.text) <= ck.HARD_LIMIT_CHARS and c.word_count == len(c.text.split()) for c in own)


def test_overlap_repeats_the_last_words(spark):
    text = " ".join(f"Phrase numero {i} avec quelques mots dedans." for i in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = ck.pack_chunks(docs, budget=50, overlap=10).orderBy("chunk_index").collect()
    for a, b in zip(rows, rows[1:]):
        assert b.text.split()[:10] == a.text.split()[-10:]


def _okapi(chunks, query):
    n, lens = len(chunks), [len(c) for c in chunks]
    avg = sum(lens) / n
    df = Counter(t for c in chunks for t in set(c))
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for c, size in zip(chunks, lens):
        tf = Counter(c)
        out.append(sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * size / avg)) for t in query if t in tf))
    return out


def test_bm25_with_one_corpus_holding_most_rows(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["le"] * 30
    rows = []
    for d in range(90):
        corpus = "grand" if d % 3 else f"c{d % 7}"
        rows.append((corpus, d, 0, " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 60)))))
    chunks = spark.createDataFrame([(*r, len(r[3].split())) for r in rows], "corpus_key string, doc_id long, chunk_index int, text string, word_count int")
    asked = [(0, "le w1 w1 w7"), (1, "w3 w99"), (2, "le")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.bm25 for r in se.bm25(se.placed(chunks), se.term_stats(chunks), queries).collect()}
    want = {}
    for corpus in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == corpus]
        for qid, text in asked:
            for r, s in zip(own, _okapi([x[3].split() for x in own], text.split())):
                if s > 0:
                    want[qid, r[1]] = s
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_scoring_moves_only_the_best_hits(spark):
    """No exchange between the placed chunks and each task's top list."""
    chunks = spark.range(500).select(F.lit("c").alias("corpus_key"), F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("chunk_index"),
                                     F.concat_ws(" ", F.lit("a b"), F.col("id").cast("string")).alias("text"), F.lit(40).alias("word_count"))
    queries = spark.createDataFrame([(1, "a 7")], "query_id long, text string")
    top = se.best(se.bm25(se.placed(chunks), se.term_stats(chunks), queries), "bm25", 3)
    plan = top._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
    executed = top._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(query_id#\d+L, \d+\)", executed)) == 1
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L, doc_id", executed)


def test_nested_documents_of_a_huge_project_are_whole(spark):
    docs = spark.range(1000).select((F.when(F.col("id") < 600, 1).otherwise(F.col("id") % 50)).alias("project_id"),
                                    F.col("id").alias("doc_id"), F.lit("rc").alias("doc_type"))
    rows = pj.nested_documents(docs, block=40).collect()
    assert sum(len(r.documents) for r in rows) == 1000
    big = [r for r in rows if r.project_id == 1]
    assert len(big) > 10 and {d.doc_id for r in big for d in r.documents} >= set(range(600))


def test_history_blocks_are_whole_and_ordered(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), (F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("part"),
                                     F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rows = cv.history(turns).orderBy("message_no").collect()
    assert [(r.message_no, int(r.text)) for r in rows] == [(i, i) for i in range(3000)]
    lists = cv.history_lists(cv.history(turns), 200).orderBy("block_no").collect()
    assert len(lists) == 15 and [int(m.text) for r in lists for m in r.messages] == list(range(3000))


def test_pages_number_all_rows_once(spark, monkeypatch):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11)).repartition(6)
    out = rg.paginate(rows, [F.desc("k"), F.col("id")], 100).orderBy("position").collect()
    want = sorted(((r.id, r.k) for r in rows.collect()), key=lambda x: (-x[1], x[0]))
    assert [(r.id, r.k) for r in out] == want and out[-1].page_no == 10
    assert {r.page_no for r in rg.page(rows, [F.col("id")], 99, 300).collect()} == {4}
    early = rg.page(rows, [F.desc("k"), F.col("id")], 3, 100).orderBy("position").collect()
    monkeypatch.setattr(rg, "EARLY_ROWS", 0)
    late = rg.page(rows, [F.desc("k"), F.col("id")], 3, 100).orderBy("position").collect()
    assert early == late == out[200:300]


def test_dedupe_of_many_copies(spark):
    rows = spark.range(2000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("row_no"), F.create_map(
        F.lit("a"), F.when(F.col("id") % 3 == 0, " Mur ").otherwise(F.concat(F.lit("mur"), (F.col("id") % 5).cast("string"))),
        F.lit("b"), F.when(F.col("id") % 2 == 0, F.lit("null")).otherwise(F.lit(""))).alias("fields"))
    kept = sorted((r.row_no, r.fields["a"]) for r in ex.dedupe(rows).collect())
    assert kept == [(0, " Mur "), (1, "mur1"), (2, "mur2"), (4, "mur4"), (5, "mur0"), (8, "mur3")]


def test_inline_runs(spark):
    lines = ["a **b _c_** d", "*i* et _j_", "*a_ b* c_ d_", "**x** *y*", "2 * 3 * 4", ""]
    blocks = spark.createDataFrame(list(enumerate(lines)), "line_no int, content string").withColumn("doc_id", F.lit(1))
    got = {}
    for r in mk.inline_runs(blocks).orderBy("line_no", "run_no").collect():
        got.setdefault(r.line_no, []).append((r.text, r.bold, r.italic))
    assert got[0] == [("a ", False, False), ("b _c_", True, False), (" d", False, False)]
    assert got[1] == [("i", False, True), (" et ", False, False), ("j", False, True)]
    assert got[2] == [("a_ b", False, True), (" c_ d_", False, False)]
    assert got[3] == [("x", True, False), (" ", False, False), ("y", False, True)]
    assert got[4] == [("2 ", False, False), (" 3 ", False, True), (" 4", False, False)]
    assert 5 not in got


def test_cascade_stages(spark):
    titles = ["Signature", "Mentions légales :", "Moyens humains", "Analyse du site", ""]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    seen = spark.sparkContext.accumulator(0)

    def ask(batch):
        seen.add(len(batch))
        return ["C'est le Programme"] * len(batch)

    rows = {r.title: r for r in cl.cascade(df, ["mentions légales", "signature"], cl.exemplar_centroids(), ask=ask).collect()}
    assert rows["Signature"].lane == rows["Mentions légales :"].lane == "boilerplate"
    assert rows["Moyens humains"].lane == "memoire" and rows["Analyse du site"].lane == "programme"
    assert rows[""].method == "llm_fallback" and rows[""].lane == "programme"
    assert seen.value == sum(r.method == "llm_fallback" for r in rows.values())


def test_generate_reports_bad_prompts_as_rows(spark):
    def model(prompts, temperature, max_tokens, schema):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1).select(md.generate(F.col("p"), model).alias("r")).collect()
    assert [(r.r.content, r.r.error) for r in rows] == [("A", None), (None, "RuntimeError: no"), ("C", None)]


def test_long_documents_are_summarised_in_order(spark):
    text = " ".join(f"Phrase {i} du document sans surprise." for i in range(300))
    out = sm.summarise(spark.createDataFrame([(1, text), (2, "Une seule phrase courte.")], "doc_id long, text string"),
                       lambda prompts, t, most, schema: [" ".join(p.split()[:most]) for p in prompts], budget=200, map_tokens=6, reduce_tokens=1000).collect()
    by = {r.doc_id: r for r in out}
    assert by[2].n_parts == 1 and "Une seule phrase courte." in by[2].summary
    assert by[1].n_parts > 5
    assert [int(x) for x in re.findall(r"Extrait (\d+):", by[1].summary)] == list(range(1, by[1].n_parts + 1))


LOREM = "Le candidat remet un mémoire technique dont la structure, le plan et le contenu attendu sont détaillés. " * 3


def test_sections_by_heading_then_by_search(spark):
    docs = spark.createDataFrame([
        (1, "## Structure du mémoire technique\n" + LOREM),
        (2, "## Structure du mémoire technique\ntrop court\n" + "## Autre\n" + LOREM),
        (3, "rien"),
    ], "doc_id long, text string")
    rows = {r.doc_id: r for r in fb.find_sections(docs, vo.CONSULTATION_SECTIONS).collect()}
    assert rows[1].source == "heading_match" and rows[1].score >= 0.9
    assert rows[3].source == "fallback_failed" and rows[3].text is None
    assert rows[2].source in ("rag_fallback", "fallback_failed")


def test_drafts_keep_order_and_lanes(spark):
    chunk = lambda d, kind, prj, text: (kind if kind == "memoire" else "p", d, 0, text, len(text.split()), kind, prj, f"{d}.pdf")
    words = " ".join(f"mot{i}" for i in range(40))
    chunks = spark.createDataFrame(
        [chunk(1, "memoire", None, "moyens humains " + words), chunk(2, "programme", 5, "analyse du site " + words),
         chunk(3, "programme", 6, "analyse du site " + words)],
        "corpus_key string, doc_id long, chunk_index int, text string, word_count int, doc_type string, project_id long, file_name string")
    sections = spark.createDataFrame(
        [(1, 5, "Moyens humains", "avant <<décris>> après"), (2, 5, "Analyse du site", "<<le site>>"), (3, 5, "Signature", "<<signe>>"), (4, 5, "Libre", "déjà écrit")],
        "section_id long, project_id long, title string, content string")
    filled, sources = dr.draft_sections(sections, chunks, cl.exemplar_centroids(), ["signature"],
                                        lambda prompts, *_: [" ".join(p.split()) for p in prompts])
    rows = {r.section_id: r for r in filled.collect()}
    assert rows[4].content == "déjà écrit" and rows[4].lane is None
    parts = rows[1].content.split("\n\n")
    assert parts[0] == "avant" and parts[-1] == "après" and rows[1].lane == "memoire"
    assert rows[3].lane == "boilerplate" and "Aucune information de référence" in rows[3].content
    assert {(r.section_id, r.seg_no, r.doc_id, r.file_name) for r in sources.collect()} == {(1, 1, 1, "1.pdf"), (2, 0, 2, "2.pdf")}
    assert all(r.error is None for r in rows.values())


def test_failed_drafts_keep_their_error_and_long_ids(spark):
    chunks = spark.createDataFrame([("memoire", 1, 0, "moyens humains " * 30, 60, "memoire", None, "1.pdf")],
                                   "corpus_key string, doc_id long, chunk_index int, text string, word_count int, doc_type string, project_id long, file_name string")
    sections = spark.createDataFrame([(9_000_000_000_000_000_000, 5, "Moyens humains", "avant <<décris>>")], "section_id long, project_id long, title string, content string")

    def broken(prompts, *_):
        raise RuntimeError("down")

    filled, sources = dr.draft_sections(sections, chunks, cl.exemplar_centroids(), [], broken)
    row = filled.collect()[0]
    assert row.error == "RuntimeError: down" and row.content.startswith("avant") and [r.section_id for r in sources.collect()] == [9_000_000_000_000_000_000]


def test_bad_numbers_are_rows_not_failures(spark):
    from dossierlake.operators import cleaning as cn, sections as sc
    from dossierlake.sources import intake as it
    long = "9" * 40
    lines = [f"# {long} x", "# \u0663 x", "# 2.1 y", "# Article 7 z"]
    heads = sc.headings(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).orderBy("heading_no").collect()
    assert [r.number for r in heads] == [None, [3], [2, 1], [7]]
    styles = spark.createDataFrame([("Heading 99999999999",), ("Titre 2",), ("Heading 007",), ("x",)], "s string")
    assert [r[0] for r in styles.select(it.heading_level(F.col("s"))).collect()] == [999_999_999, 2, 7, None]
    sheet = spark.createDataFrame([(1, 1, k, "1e12") for k in it.PAGE_LABELS], "doc_id long, ord int, a string, b string")
    assert it.config_pages(sheet).count() == 0
    plan = spark.createDataFrame([(f"{long}. a",), ("\u0664. a",), ("3. a",), ("x",)], "t string").select(mk.with_annex(F.col("t")).alias("p")).collect()
    assert [r.p.split("\n")[1].split(".")[0] for r in plan] == ["2", "5", "4", "1"]
    pieces = spark.createDataFrame([(f"\n# 5. a\n{'word ' * 3}\n# {long}. b\nc",)], "t string")
    assert pieces.select(cn.section_by_number(cn.numbered_pieces(F.col("t")), F.lit("5")).alias("s")).count() == 1


def test_cascade_judges_each_title_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def counted(texts):
        with open(calls, "a") as f:
            f.writelines(f"{len(t)}\n" for t in texts)
        return vx.hashed_vectors(texts)

    titles = spark.createDataFrame([(i, t) for i, t in enumerate(["Méthodologie", "Calendrier prévisionnel", None, "Signature"] * 5)], "id int, title string")
    out = cl.cascade(titles, ["signature"], cl.exemplar_centroids(), counted, lambda parts: ["programme"] * len(parts))
    rows = out.collect()
    assert len(rows) == 20 and all(r.lane for r in rows) and len({(r.title, r.lane, r.method) for r in rows}) == 4
    assert len(open(calls).read().split("\n")) - 1 == 3


def test_each_question_is_rewritten_once(spark, tmp_path):
    from dossierlake.plans import answering as an
    calls = str(tmp_path / "calls")

    def rewriter(prompts, *_):
        with open(calls, "a") as f:
            f.writelines("x\n" for _ in prompts)
        return [p.split(" : ")[-1] for p in prompts]

    words = " ".join(f"mot{i}" for i in range(40))
    chunks = spark.createDataFrame([("k", d, 0, f"sujet{d} {words}", 41) for d in range(3)], "corpus_key string, doc_id long, chunk_index int, text string, word_count int")
    files = spark.createDataFrame([(d, f"{d}.pdf") for d in range(3)], "doc_id long, file_name string")
    asked = spark.createDataFrame([(i, i, "k", f"sujet{i % 3}") for i in range(7)], "query_id long, conv_id long, corpus_key string, text string")
    turns = spark.createDataFrame([(i, 1, 0, "user", "avant") for i in range(5)], "conv_id long, ts long, part int, role string, text string")
    answers, sources = an.answer(asked, turns, chunks, files, rewriter=rewriter)
    assert answers.count() == 7 and sources.count() > 0 and answers.filter("error IS NOT NULL").count() == 0
    assert len(open(calls).read().split()) == 5


def test_the_model_reads_system_text_and_history(spark):
    from dossierlake.plans import answering as an
    words = " ".join(f"mot{i}" for i in range(40))
    chunks = spark.createDataFrame([("k", 1, 0, f"sujet {words}", 41)], "corpus_key string, doc_id long, chunk_index int, text string, word_count int")
    files = spark.createDataFrame([(1, "1.pdf")], "doc_id long, file_name string")
    asked = spark.createDataFrame([(i, i, "k", "sujet ?") for i in (1, 2)], "query_id long, conv_id long, corpus_key string, text string")
    turns = spark.createDataFrame([(1, 9, 1, "assistant", "deux"), (1, 9, 0, "user", "un"), (3, 1, 0, "user", "ailleurs")], "conv_id long, ts long, part int, role string, text string")
    echo = lambda prompts, *_: list(prompts)
    answers, _ = an.answer(asked, turns, chunks, files, model=echo, system="règles")
    said = {r.query_id: r.content for r in answers.collect()}
    assert said[1].startswith("[system]\nrègles\n\n[user]\nun\n\n[assistant]\ndeux\n\n[user]\nContexte extrait") and said[1].endswith("Question : sujet ?")
    assert said[2].startswith("[system]\nrègles\n\n[user]\nContexte extrait")


def test_where_treats_missing_keys(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", 3), (3, None, 3)], "id int, k string, p long")
    ids = lambda cond: sorted(r.id for r in rows.filter(rg.where(cond)).collect())
    assert ids({"k": "a"}) == [1, 2] and ids({"p": None}) == [1] and ids({}) == [1, 2, 3]
    assert ids({"$and": [{"k": "a"}, {"p": 3}]}) == [2]


def test_text_functions_equal_python(spark):
    texts = ["  a b c\x1cd\n", "", "Éléphant — ŒUVRE à ½ n°5", "3.2) Les   Titres", "_ - é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(
        tx.words(F.col("t")).alias("w"), tx.strip(F.col("t")).alias("s"), tx.title_key(F.col("t")).alias("k"), tx.field_key(F.col("t")).alias("f")).collect()
    for t, r in zip(texts, rows):
        assert r.w == t.split() and r.s == t.strip()
    assert rows[3].k == "les titres" and rows[4].f == "e"


def test_job_status_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "job_id long, event_id long, ts timestamp, status string, current long, total int"
    spark.sql("SELECT 1L job_id, 1L event_id, timestamp'2024-01-01 00:00:00' ts, 'running' status, 0L current, 2 total").write.mode("append").parquet(src)
    run = lambda: st.start_job_status(spark.readStream.schema(schema).parquet(src), out, check).awaitTermination()
    run()
    spark.sql("SELECT 1L job_id, 2L event_id, timestamp'2024-01-01 00:00:09' ts, 'done' status, 2L current, 2 total").write.mode("append").parquet(src)
    run()
    assert [(r.job_id, r.status, r.current) for r in st.job_status(spark, out).collect()] == [(1, "done", 2)]
    assert spark.read.parquet(out).count() == 2


def test_idle_conversations_are_forgotten(spark, tmp_path):
    """A turn after the idle time starts a new count; one within it goes on with the old."""
    settings = {"spark.sql.streaming.stateStore.providerClass": st.STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for ttl, want in ((1, 1), (600, 3)):
            src, out, check = (str(tmp_path / f"{x}{ttl}") for x in ("in", "out", "check"))
            for k, rows in enumerate(([(1, 10), (1, 20)], [(1, 30)])):
                if k:
                    time.sleep(2)
                spark.createDataFrame(rows, "conv_id long, ts long").coalesce(1).write.mode("append").parquet(src)
                stream = spark.readStream.schema("conv_id long, ts long").parquet(src)
                st.start_activity(stream, out, check, ttl).awaitTermination()
            last = spark.read.parquet(out).orderBy(F.desc("batch")).first()
            assert (last.n_messages, last.last_ts) == (want, 30)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_long_histories_stay_whole_in_prompts(spark):
    turns = spark.range(900).select(F.lit(1).alias("conv_id"), (F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("part"),
                                    F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    asked = spark.createDataFrame([(1, "et alors ?"), (2, "bonjour")], "conv_id int, message string")
    rows = pr.message_rows(cv.history(turns), asked, "règles").orderBy("conv_id", "message_no").collect()
    first = [r for r in rows if r.conv_id == 1]
    assert [r.content for r in first] == ["règles", *[str(i) for i in range(900)], "et alors ?"] and first[0].role == "system"
    assert [r.content for r in rows if r.conv_id == 2] == ["règles", "bonjour"]


def test_stored_index_is_searched_without_text_or_embedding(spark, tmp_path):
    words = [f"mot{i}" for i in range(60)]
    rng = random.Random(4)
    rows = [("k", d, 0, " ".join(rng.choices(words, k=40)), 40) for d in range(60)]
    chunks = spark.createDataFrame(rows, "corpus_key string, doc_id long, chunk_index int, text string, word_count int")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=5))) for i in range(9)], "query_id long, text string")
    index = se.write_tables(chunks, str(tmp_path / "index"))
    over = hy.over_tables(index, queries)
    plan = over._jdf.queryExecution().optimizedPlan().toString()
    assert "word_count" not in plan and "tokens" not in plan
    key = lambda r: (r.query_id, r["rank"], r.doc_id, round(r.hybrid_score, 6))
    assert sorted(map(key, over.collect())) == sorted(map(key, hy.hybrid(chunks, queries).collect()))
    many = spark.range(5000).select(F.col("id").alias("query_id"), F.concat(F.lit("mot"), (F.col("id") % 60).cast("string")).alias("text"))
    assert hy.over_tables(index, many, 2).select("query_id").distinct().count() == 5000


def test_an_exchange_refreshes_the_next_one_of_its_batch(spark):
    turns = spark.createDataFrame([("a", 0, 0, "user", "x"), ("b", 0, 0, "user", "x"), ("c", 0, 0, "user", "x")], "conv_id string, ts long, part int, role string, text string")
    at = {"a": [90, 180, 270], "b": [90, 190, 195, 280], "c": [250, 100, 10, 251], "d": [1]}
    exchanges = spark.createDataFrame([(c, t, "q", "a") for c, ts in at.items() for t in ts], "conv_id string, at long, question string, answer string")
    grown, refused = cv.append_turns(turns, exchanges, ttl=100)
    assert sorted((r.conv_id, r.ts) for r in grown.filter("text = 'q'").collect()) == [("a", 90), ("a", 180), ("a", 270), ("b", 90), ("c", 10), ("c", 100)]
    assert sorted((r.conv_id, r["at"], r.reason) for r in refused.collect()) == [
        ("b", 190, "expired"), ("b", 195, "expired"), ("b", 280, "expired"), ("c", 250, "expired"), ("c", 251, "expired"), ("d", 1, "unknown")]


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    files = [[("a", 0), ("a", 99), ("b", 5)], [("a", 199), ("b", 300)], [("b", 150), ("b", 80)], [("z", 10_000)], [("b", 81), ("z", 10_001)], [("z", 20_000)]]
    for rows in files:  # the third file is late but in time and bridges nothing closed; 81 comes after its session was over
        spark.createDataFrame(rows, "conv_id string, ts long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = st.start_sessions(spark.readStream.schema("conv_id string, ts long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), idle=100, late="500 seconds")
        query.awaitTermination()
    key = lambda df: sorted((r.conv_id, r.started, r.ended, r.n_messages) for r in df.collect())
    table = spark.createDataFrame([r for rows in files for r in rows if r != ("b", 81)], "conv_id string, ts long")
    whole = key(cv.sessions(cv.timed(table), 100))
    assert whole == [("a", 0, 99, 2), ("a", 199, 199, 1), ("b", 5, 150, 3), ("b", 300, 300, 1), ("z", 10_000, 10_001, 2), ("z", 20_000, 20_000, 1)]
    assert key(spark.read.parquet(str(tmp_path / "out"))) == whole[:-1]  # the last one is still open


def test_reports_are_cut_once_by_each_rule(spark):
    """Each use of a value in the row repeated its work: the contents rule stood in the plan dozens of times."""
    from dossierlake.operators import cleaning

    text = "avant\n## Sommaire\n3. Résultats du Repérage\n# 3. un\nM123\n# 4. deux\n"
    out = cleaning.reduce_documents(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].cover == "avant" and rows[1].materials == "# 3. un\nM123" and rows[2].materials == ""
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sommaire") <= 4


def test_search_in_given_chunks_embeds_each_text_once(spark):
    """Both legs were read twice, for their extremes and for their rows, so every text reached the model twice."""
    from dossierlake.functions import vectors
    from dossierlake.operators import search
    from dossierlake.plans import hybrid

    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return vectors.hashed_vectors(texts)

    text = " ".join(f"w{i % 20}" for i in range(40))
    chunks = spark.createDataFrame([(d, d, i, f"{text} d{d} c{i}", 42) for d in (1, 2) for i in (0, 1, 2)],
                                   "corpus_key long, doc_id long, chunk_index int, text string, word_count int")
    queries = spark.createDataFrame([(7, 1, "w1 c2 c2 nowhere"), (8, 2, "c0 d1"), (9, 3, "w1")], "query_id long, corpus_key long, text string")
    hits = hybrid.search_given_chunks(chunks, queries, 1, model).collect()
    assert [(h.query_id, h.doc_id, h.chunk_index) for h in sorted(hits)] == [(7, 1, 2), (8, 2, 0)]
    assert seen.value <= chunks.count() + queries.count()
    # The words of a corpus's own queries only, as `postings` counts them.
    terms = search.query_terms(queries).join(queries.select("corpus_key").distinct(), "corpus_key")
    every = search.postings(chunks.union(chunks.limit(1))).join(terms.select("corpus_key", "term").distinct(), ["corpus_key", "term"], "left_semi")
    own = search.own_postings(chunks.union(chunks.limit(1)), terms).select(*every.columns)
    assert sorted(own.collect()) == sorted(every.collect()) and own.count() == 5
