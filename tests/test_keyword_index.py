"""Block-maximum postings against a full scan."""

import random

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import keyword_index as ki, search as se

CHUNKS = "corpus_key string, doc_id long, chunk_index int, text string, word_count int"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(f"c{d % 3}", d, c, " ".join(rng.choices(words, weights, k=rng.randint(5, 60))), 0) for d in range(900) for c in range(2)]
    rows = [(*r[:4], len(r[3].split())) for r in rows] + [("c0", 5000 + i, 0, "w7 w250 w250", 3) for i in range(40)]
    chunks = spark.createDataFrame(rows, CHUNKS).cache()
    folder = str(tmp_path_factory.mktemp("index"))
    stats = se.term_stats(chunks).cache()
    return chunks, stats, ki.write(se.postings(chunks), se.corpus_sizes(chunks), folder, se.K1, se.B, block_rows=50)


def queries(spark, scoped=False):
    rng = random.Random(5)
    asked = [(i, f"c{i % 4}", " ".join(f"w{min(299, int(rng.expovariate(0.02)))}" for _ in range(rng.randint(1, 4)))) for i in range(60)]
    asked += [(100, "c0", "w250 w250 w7"), (101, "c1", "unknown words"), (102, "c1", "")]
    rows = spark.createDataFrame(asked, "query_id long, corpus_key string, text string")
    return rows if scoped else rows.drop("corpus_key")


def hits(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.chunk_index, round(r.bm25, 5)) for r in df.collect())


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("k", [3, 20])
def test_same_hits_as_a_full_scan(spark, stored, k, scoped):
    chunks, stats, index = stored
    asked = queries(spark, scoped)
    want = se.best(se.bm25(se.placed(chunks), stats, asked), "bm25", k)
    assert hits(ki.top(index, stats, se.query_terms(asked), k, se.K1, se.B)) == hits(want)


def test_blocks_that_cannot_hold_a_hit_are_skipped(spark, stored):
    _, stats, index = stored
    assert index.blocks.agg(F.max("n")).first()[0] < 100
    asked = queries(spark).union(spark.createDataFrame([(200, "w0"), (201, "w2 w1")], "query_id long, text string"))
    found = ki.needed(index, stats, se.query_terms(asked), 3, se.K1, se.B)
    counts = {r.query_id: (r.read, r.skipped) for r in found.groupBy("query_id").agg(
        F.sum(F.when(F.col("needed"), F.col("n")).otherwise(0)).alias("read"), F.sum(F.when(F.col("needed"), 0).otherwise(F.col("n"))).alias("skipped")).collect()}
    assert sum(s for _, s in counts.values()) > 0.1 * sum(r for r, _ in counts.values())
    assert counts[200][1] > 3 * counts[200][0]


def test_only_row_groups_of_asked_words_are_read(spark, stored):
    _, stats, index = stored
    asked = spark.createDataFrame([(1, "w250")], "query_id long, text string")
    top = ki.top(index, stats, se.query_terms(asked), 3, se.K1, se.B)
    assert top.count() == 3
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w250)" in plan or "In(term, [w250])" in plan


def test_a_word_of_few_postings_is_one_block(stored):
    words = stored[2].blocks.groupBy("corpus_key", "term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()
    assert {r.blocks for r in words if r.n <= 50} == {1}
    assert min(r.blocks for r in words if r.n > 50) > 1


def test_no_row_is_made_for_a_query_and_a_posting(spark, stored):
    _, stats, index = stored
    asked = spark.createDataFrame([(i, "w0 w1 w2") for i in range(40)], "query_id long, text string")
    top = ki.top(index, stats, se.query_terms(asked), 3, se.K1, se.B)
    assert len({(r.doc_id, r.chunk_index, r["rank"]) for r in top.collect()}) == 3 and top.count() == 120
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sum(" not in plan


def test_word_lists_of_chunks_give_the_same_postings(spark):
    rows = [("a", 1, 0, "Un deux UN\u00a0un\x1cdeux  trois", 6), ("a", 2, 0, None, 0), ("a", 3, 0, " ", 0), (None, 4, 0, "\u0130l \u2003Été", 2), ("b", None, 0, "x x", 2)]
    again = [("b", None, 0, "x y", 2), ("a", 1, 0, "un deux", 2)]
    for some in (rows, rows + again, rows + rows):
        chunks = spark.createDataFrame(some, CHUNKS)
        columns = ["corpus_key", "doc_id", "chunk_index", "dl", "term", "tf"]
        got, want = (sorted(map(repr, df.select(*columns).collect())) for df in (se.listed_postings(se.term_lists(chunks)), se.postings(chunks)))
        assert got == want and len(got) > 0


def test_a_document_without_an_id_is_found(spark, tmp_path):
    chunks = spark.createDataFrame([("a", None, 0, "u v", 2), ("a", 2 ** 60 + 1, 0, "u w", 2), ("a", 7, 0, "w w", 2), ("a", 8, 0, "z", 1)], CHUNKS)
    index, stats = se.write_keywords(chunks, str(tmp_path))
    asked = spark.createDataFrame([(1, "u v")], "query_id long, text string")
    want = se.best(se.bm25(se.placed(chunks), stats, asked), "bm25", 3)
    assert hits(se.keyword_top(index, stats, asked, 3)) == hits(want)
