"""A corpus of batches and erasures against one that is built at once."""

import random

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import chunking as ck, search as se
from dossierlake.plans import hybrid as hy
from dossierlake.sources import corpus as cp
from dossierlake.streaming import ingest as si

DOCS = "doc_id long, corpus_key string, text string, lang string"


def documents(ids):
    rng = random.Random(6)
    words = [f"mot{i}" for i in range(80)]
    rows = {i: (i, f"k{i % 2}", "Phrase " + " ".join(rng.choices(words, k=45)) + ".", "fr") for i in range(40)}
    return [rows[i] for i in ids]


def stats(df):
    return sorted((r.corpus_key, r.term, r.df, r.n_chunks, round(r.avgdl, 9), round(r.idf, 9)) for r in df.collect())


def hits(index, spark):
    rng = random.Random(7)
    asked = spark.createDataFrame([(i, " ".join(f"mot{rng.randrange(80)}" for _ in range(4))) for i in range(8)], "query_id long, text string")
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.hybrid_score, 6)) for r in hy.over_tables(index, asked, 4).collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """The documents 10..39 but for 15 and 16, at once."""
    docs = spark.createDataFrame(documents([i for i in range(10, 40) if i not in (15, 16)]), DOCS)
    chunks = ck.searchable(ck.retrieval_chunks(docs.select("doc_id", "text", "corpus_key"), keep=("corpus_key",)))
    index = se.write_tables(chunks, str(tmp_path_factory.mktemp("built")))
    return stats(index.stats), hits(index, spark)


def test_batches_and_an_erasure_equal_a_corpus_built_at_once(spark, tmp_path, built):
    folder = str(tmp_path)
    add = lambda ids, tag: cp.add(spark, folder, spark.createDataFrame(documents(ids), DOCS), tag)
    add(range(0, 15), "one")
    add(range(15, 20), "two")
    before = cp.opened(spark, folder)
    seen = stats(before.stats())
    cp.erase(spark, folder, spark.createDataFrame([(i,) for i in [*range(10), 15, 16, 999, None]], "doc_id long"), "forget")
    add(range(20, 40), "three")
    cp.erase(spark, folder, spark.createDataFrame([(1,)], "doc_id long"), "forget")  # sent again
    after = cp.opened(spark, folder)
    assert [s.kind for s in after.steps] == ["add", "add", "erase", "add"]
    assert (stats(after.stats()), hits(after.index(), spark)) == built
    assert {r.doc_id for t in (after.chunks(), after.registry()) for r in t.collect()} == {*range(10, 40)} - {15, 16}
    # Who began before the erasure still sees one version of all tables.
    assert stats(before.stats()) == seen and before.registry().count() == before.chunks().select("doc_id").distinct().count() == 20
    plan = after.stats()._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "tf#" not in plan
    # What was erased can come back.
    add([15], "again")
    assert 15 in {r.doc_id for r in cp.opened(spark, folder).chunks().collect()}


def test_a_step_that_was_not_committed_is_not_seen_and_written_anew(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    docs = spark.createDataFrame(documents(range(4)), DOCS)
    with monkeypatch.context() as m:
        m.setattr(cp, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cp.add(spark, folder, docs, "one")
    assert cp.opened(spark, folder).steps == ()
    cp.add(spark, folder, docs, "one")
    cp.add(spark, folder, docs, "one")
    assert sorted(r.doc_id for r in cp.opened(spark, folder).registry().collect()) == [0, 1, 2, 3]
    cp.erase(spark, str(tmp_path / "none"), docs, "x")
    assert cp.opened(spark, str(tmp_path / "none")).live("chunks") is None


@pytest.mark.parametrize("time", [None, "at"])
def test_a_document_sent_again_and_a_replayed_batch_count_once(spark, tmp_path, time):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "doc_id long, text string, source string, at timestamp"
    put = lambda ids, day: spark.createDataFrame([(r[0], r[2], r[1]) for r in documents(ids)], "doc_id long, text string, source string").withColumn(
        "at", F.to_timestamp(F.lit(f"2024-01-0{day}"))).coalesce(1).write.mode("append").parquet(src)
    run = lambda: si.start_ingest(si.document_stream(spark, src, spark.createDataFrame([], schema).schema), out, check, time=time).awaitTermination()
    put([1, 2, 2], 1)
    run()
    put([2, 3], 2)
    run()
    replayed = spark.createDataFrame([(r[0], r[1], r[2]) for r in documents([3])], "doc_id long, corpus_key string, text string")
    cp.add(spark, out, replayed, cp.opened(spark, out).steps[-1].tag)
    corpus = cp.opened(spark, out)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    index = corpus.index()
    assert ids(corpus.registry()) == ids(corpus.chunks()) == ids(index.vectors.vectors) == [1, 2, 3]
    assert ids(index.postings.postings.select("doc_id").distinct()) == [1, 2, 3]


def test_a_text_is_embedded_once(spark, tmp_path):
    from dossierlake.functions import vectors as vx
    calls = str(tmp_path / "calls")

    def counted(texts):
        with open(calls, "a") as f:
            f.writelines("x\n" for _ in texts)
        return vx.hashed_vectors(texts)

    made = lambda: len(open(calls).read().split())
    folder = str(tmp_path / "corpus")
    rows = documents(range(6))
    copies = [(100 + r[0], "k9", r[2], "fr") for r in rows]
    cp.add(spark, folder, spark.createDataFrame(rows + copies, DOCS), "one", counted)
    assert made() == 6
    cp.erase(spark, folder, spark.createDataFrame([(r[0],) for r in rows], "doc_id long"), "gone")
    cp.add(spark, folder, spark.createDataFrame(rows, DOCS), "two", counted)
    assert made() == 6
    vectors = cp.opened(spark, folder).index().vectors.vectors
    assert sorted(r.doc_id for r in vectors.collect()) == sorted(r[0] for r in rows + copies)
    again = {r.doc_id: r.embedding for r in vectors.collect()}
    assert all(again[r[0]] == again[100 + r[0]] for r in rows)


@pytest.mark.parametrize("as_folder", [True, False])
def test_a_stored_table_streams_whether_it_is_a_file_or_a_folder(spark, tmp_path, as_folder):
    for name in ("documents", "others"):
        folder = str(tmp_path / "made" / name)
        spark.createDataFrame([(i,) for i in range(6)], "doc_id long").repartition(2 if as_folder else 1).write.parquet(folder)
        (tmp_path / "sf").mkdir(exist_ok=True)
        parts = sorted((tmp_path / "made" / name).glob("part-*.parquet"))
        target = tmp_path / "sf" / f"{name}.parquet"
        if as_folder:
            target.mkdir()
        for n, part in enumerate(parts):
            (target / f"part-{n}.parquet" if as_folder else target).write_bytes(part.read_bytes())
    stream = si.table_stream(spark, str(tmp_path / "sf" / "documents.parquet"), spark.createDataFrame([], "doc_id long").schema)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))
