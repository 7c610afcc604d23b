"""What searches leave on disk, copy and ask of models."""

import glob
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dossierlake import session
from dossierlake.functions import vectors as vx
from dossierlake.operators import keyword_scan as ks, vector_index as vi
from dossierlake.plans import drafting as dr, hybrid as hy

CHUNKS = "doc_id long, chunk_index int, corpus_key string, text string, word_count int"


def exchanged(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    return sum(len(glob.glob(f"{d}/**/shuffle_*", recursive=True)) for d in map(str, (x.getPath() for x in manager.localDirs())))


def texts(n, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choices([f"mot{i}" for i in range(60)], weights=[60 / (i + 1) for i in range(60)], k=40)) for _ in range(n)]


def counting(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(parts):
        seen.add(len(parts))
        return vx.hashed_vectors(parts)

    return seen, model


def test_a_stored_table_leaves_no_exchange(spark):
    before = exchanged(spark)
    kept = session.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "table")
    assert exchanged(spark) <= before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_blocks_follow_tasks_and_memory_and_not_the_number_of_queries(spark):
    # A query went to each block of 4,096 chunks, so copies grew with the product of the two tables.
    assert -(-210_000 // session.block_length(210_000, 250_000, ks.COPY_WEIGHT, ks.BLOCK_ROWS, 12)) <= 7
    assert -(-210_000 // session.block_length(210_000, 250_000, vi.COPY_WEIGHT, vi.GROUP_ROWS, 12)) <= 2
    assert session.block_length(0, 0, 1.0, 10, 8) == 1 and session.block_length(100, 1, 1.0, 10, 8) == 10


def test_a_model_is_asked_once_for_each_text_of_a_search(spark):
    rows = [(i, 0, f"k{i % 3}", t, 40) for i, t in enumerate(texts(90))]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([(i, f"k{i % 3}", t) for i, t in enumerate(texts(12, 6))], "query_id long, corpus_key string, text string")
    for asked in (queries, queries.drop("corpus_key")):
        seen, model = counting(spark)
        assert hy.hybrid(chunks, asked, 5, model).count() == 60
        assert seen.value == 90 + 12


def test_groups_of_blocks_hold_the_same_hits(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = [(i, 0, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 8)).astype(np.float32))] + [(5000, 0, [0.0] * 8)]
    asked = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)).astype(np.float32))] + [(99, [0.0] * 8)]
    index = vi.write(spark.createDataFrame(vectors, "doc_id long, chunk_index int, embedding array<float>"), str(tmp_path), block_rows=50)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    hits = [sorted((r.query_id, r.doc_id, r.cosine) for r in vi.nearest(index, queries, 9, group_rows=n).collect()) for n in (1 << 17, 100)]
    assert hits[0] == hits[1] and len(hits[0]) == 61 * 9
    unit = vx.unit(np.array([v for _, _, v in vectors], np.float64))
    for q, v in asked[:60]:
        best = np.sort(np.round(unit @ vx.unit(np.array([v], np.float64))[0], 9))[::-1][:9]
        assert np.allclose(sorted((c for i, _, c in hits[0] if i == q), reverse=True), best, atol=2e-9)


def test_common_and_rare_words_of_a_block_add_up(monkeypatch):
    rows = texts(300)
    words = sorted({w for t in rows for w in t.split()})
    listed = pa.RecordBatch.from_pydict({"corpus": ["c"], "tokens": [words], "weights": [[1.0 + i / 7 for i in range(len(words))]], "ids": pa.array([range(len(words))], pa.list_(pa.int32()))})
    chunks = pa.RecordBatch.from_pydict({"doc_id": range(300), "chunk_index": pa.array([0] * 300, pa.int32()), "corpus": ["c"] * 300, "dl": [40.0] * 300, "avgdl": [40.0] * 300, "text": rows})
    sums = []
    for room in (0, 128 << 20):
        monkeypatch.setattr(ks, "_COMMON_BYTES", room)
        block = ks._Block([listed], 1.5, 0.75)
        block.add(chunks)
        block.close()
        assert bool(len(block.whole)) == bool(room)
        sums.append(block.sums(np.arange(len(words)), np.arange(len(words)) % 3 + 1))
    want = [sum((words.index(w) % 3 + 1) * (1 + words.index(w) / 7) * t.split().count(w) * 2.5 / (t.split().count(w) + 1.5) for w in set(t.split())) for t in rows]
    assert np.allclose(sums[0], sums[1]) and np.allclose(sums[0], want)


def test_drafts_do_not_depend_on_how_many_hits_are_written_at_a_time(spark, monkeypatch):
    rows = [(i, 0, f"k{i % 3}", t, 40, ("memoire", "programme")[i % 2], i % 2, f"f{i}") for i, t in enumerate(texts(60))]
    chunks = spark.createDataFrame(rows, f"{CHUNKS}, doc_type string, project_id long, file_name string")
    sections = spark.createDataFrame([(i, i % 2, f"Titre {i}", f"{t[:60]} <<{t}>> fin <<{t[:80]}>>") for i, t in enumerate(texts(8, 9))], "section_id long, project_id long, title string, content string")
    from dossierlake.operators import classify as cl
    results = []
    for room in (1_000_000, 30):
        monkeypatch.setattr(dr, "HITS_AT_A_TIME", room)
        filled, sources = dr.draft_sections(sections, chunks, cl.exemplar_centroids(), ["Sommaire"])
        results.append((sorted(map(tuple, filled.collect()), key=str), sources.count()))
    assert results[0] == results[1] and len(results[0][0]) == 8 and results[0][1] > 30
