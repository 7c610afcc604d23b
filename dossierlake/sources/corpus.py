"""A corpus that grows by batches and forgets documents: chunks, postings, vectors, statistics and registry as one version.

Every batch and every erasure is a numbered step that writes folders of its own and is committed by renaming one small file,
last. Readers take the steps that are committed when they begin, so they see all tables of one version or of the next.
Nothing that is stored is rewritten: an erasure adds tombstones, which hide earlier rows at query time, and statistics are
sums of what steps add and erasures take back. A step that fails is not committed and writes its folders anew; a step that
is sent again under the same tag does nothing. There is one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake.functions import vectors as vx
from dossierlake.operators import chunking as ck, embedding_store as es, keyword_index as ki, search as se, vector_index as vi
from dossierlake.session import broadcast_if_small

_ADD, _ERASE = "add", "erase"
# Blocks of different steps have different numbers.
_STEP_BLOCKS = 1 << 48


@dataclass(frozen=True)
class Step:
    number: int
    kind: str
    tag: str


class Corpus:
    """The stored corpus in a folder, at the version that was committed when it was opened."""

    def __init__(self, spark: SparkSession, folder: str, steps: tuple[Step, ...]):
        self.spark, self.folder, self.steps = spark, folder, steps

    def _paths(self, table: str, *kinds: str) -> list[tuple[int, str]]:
        return [(s.number, f"{self.folder}/{table}/step={s.number}") for s in self.steps if s.kind in kinds]

    def _union(self, table: str, *kinds: str, below: str = "") -> DataFrame | None:
        parts = [self.spark.read.parquet(p + below).withColumn("step", F.lit(n)) for n, p in self._paths(table, *kinds)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def live(self, table: str, below: str = "") -> DataFrame | None:
        """The rows of a table with a doc_id that no later step has erased, with their step; null where nothing was added yet."""
        rows, gone = self._union(table, _ADD, below=below), self._union("tombstones", _ERASE)
        if rows is None or gone is None:
            return rows
        gone = broadcast_if_small(gone.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("step").alias("_at")))
        return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("step") < F.col("_at")), "left_anti")

    def chunks(self) -> DataFrame:
        return self.live("chunks").drop("step")

    def registry(self) -> DataFrame:
        return self.live("registry").drop("step")

    def embeddings(self) -> DataFrame | None:
        """(text_key, text, embedding) of every text that was embedded, once each; erased documents' texts are among them until the
        corpus is written anew, but no reader of the corpus gets them."""
        rows = self._union("embeddings", _ADD)
        return None if rows is None else rows.drop("step")

    def sizes(self) -> DataFrame:
        """(corpus_key, n_chunks, avgdl), from the sums of the steps."""
        total = self._union("sizes", _ADD, _ERASE).groupBy("corpus_key").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_words").alias("n_words"))
        return total.filter("n_chunks > 0").select("corpus_key", "n_chunks", (F.col("n_words") / F.col("n_chunks")).alias("avgdl"))

    def stats(self) -> DataFrame:
        """The term statistics of the live chunks, from the sums of the steps: no text and no posting is read."""
        # Nulls are left out here, so the sums that the mean and the terms need are the same exchange.
        given = self._union("df", _ADD, _ERASE).filter("corpus_key IS NOT NULL AND term IS NOT NULL")
        counts = given.groupBy("corpus_key", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        return se.with_idf(counts, self.sizes())

    def centroids(self) -> np.ndarray:
        """The cells of the first step that has vectors with a length. All later steps use them, so one search goes over all steps."""
        every = (vi.read(self.spark, path).centroids for _, path in self._paths("vectors", _ADD))
        return next((c for c in every if len(c)), np.zeros((0, 0)))

    def index(self) -> se.Index:
        """What searching needs, of live documents only."""
        number = (F.col("block") + F.col("step") * F.lit(_STEP_BLOCKS)).alias("block")
        keep = lambda df: df.select(*[number if c == "block" else c for c in df.columns if c != "step"])
        keywords = ki.KeywordIndex(keep(self.live("keywords", "/postings")), keep(self._union("keywords", _ADD, below="/blocks")))
        vectors = vi.VectorIndex(keep(self.live("vectors", "/vectors")), keep(self._union("vectors", _ADD, below="/blocks")), self.centroids())
        return se.Index(keywords, self.stats(), vectors)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def opened(spark: SparkSession, folder: str) -> Corpus:
    """The corpus at its last committed version; an empty one where nothing was committed."""
    path, files = _files(spark, f"{folder}/commits")
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    found = (n.split("-", 2) for n in names if not n.startswith((".", "_")))
    return Corpus(spark, folder, tuple(sorted((Step(int(n), kind, tag) for n, kind, tag in found), key=lambda s: s.number)))


def _commit(spark: SparkSession, folder: str, step: Step) -> None:
    """Makes a step visible: a name either is there or not."""
    target, files = _files(spark, f"{folder}/commits/{step.number}-{step.kind}-{step.tag}")
    draft, _ = _files(spark, f"{folder}/commits/_{step.number}")
    files.mkdirs(target.getParent())
    files.create(draft, True).close()
    if not files.rename(draft, target):
        raise RuntimeError(f"step {step.number} of {folder} could not be committed")


def _next(corpus: Corpus, kind: str, tag: str) -> Step | None:
    """The step to write, or none where its tag was committed before."""
    if any((s.kind, s.tag) == (kind, tag) for s in corpus.steps):
        return None
    return Step(corpus.steps[-1].number + 1 if corpus.steps else 0, kind, tag)


def add(spark: SparkSession, folder: str, docs: DataFrame, tag: str, model=vx.hashed_vectors) -> None:
    """Adds docs(doc_id, corpus_key, text, ...), all of them or none. `tag` names the batch: a batch of that name is added once.

    Documents are expected to be new, or to have been erased by an earlier step.
    """
    corpus = opened(spark, folder)
    step = _next(corpus, _ADD, tag)
    if step is None:
        return
    at = lambda table: f"{folder}/{table}/step={step.number}"
    docs.drop("text").write.mode("overwrite").parquet(at("registry"))
    ck.retrieval_chunks(docs.select("doc_id", "text", "corpus_key"), keep=("corpus_key",)).write.mode("overwrite").parquet(at("chunks"))
    chunks = ck.searchable(spark.read.parquet(at("chunks")))
    se.term_lists(chunks).write.mode("overwrite").parquet(at("plain"))
    plain = se.listed_postings(spark.read.parquet(at("plain")))
    plain.groupBy("corpus_key", "term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(at("df"))
    _word_counts(chunks).write.mode("overwrite").parquet(at("sizes"))
    ki.write(plain, se.corpus_sizes(chunks), at("keywords"), se.K1, se.B, counts=spark.read.parquet(at("df")))
    # Only texts that no step has embedded reach the model.
    es.embed_unseen(chunks, corpus.embeddings(), model).write.mode("overwrite").parquet(at("embeddings"))
    fresh = spark.read.schema(es.STORED).parquet(at("embeddings"))
    known = fresh if corpus.embeddings() is None else corpus.embeddings().unionByName(fresh)
    vi.write(es.with_vectors(chunks, known).select("corpus_key", *se.CHUNK_ID, "embedding"), at("vectors"), centers=corpus.centroids())
    _commit(spark, folder, step)


def _word_counts(chunks: DataFrame, sign: int = 1) -> DataFrame:
    return chunks.groupBy("corpus_key").agg((F.count("*") * sign).alias("n_chunks"), (F.sum("word_count") * sign).cast("long").alias("n_words"))


def erase(spark: SparkSession, folder: str, requests: DataFrame, tag: str) -> None:
    """Erases the documents of requests(doc_id) from every table at once. Of the stored rows only theirs are read.

    Ids that are not there are no error. The bytes stay until the corpus is written anew.
    """
    corpus = opened(spark, folder)
    step = _next(corpus, _ERASE, tag)
    if step is None:
        return
    at = lambda table: f"{folder}/{table}/step={step.number}"
    requests.select("doc_id").filter("doc_id IS NOT NULL").distinct().write.mode("overwrite").parquet(at("tombstones"))
    gone = broadcast_if_small(spark.read.parquet(at("tombstones")))
    theirs = lambda table: corpus.live(table).join(gone, "doc_id", "left_semi")
    if corpus._paths("plain", _ADD):
        counts = se.listed_postings(theirs("plain")).groupBy("corpus_key", "term").agg((-F.count("*")).alias("df"))
        sizes = _word_counts(ck.searchable(theirs("chunks")), -1)
    else:
        counts, sizes = spark.createDataFrame([], "corpus_key string, term string, df long"), spark.createDataFrame([], "corpus_key string, n_chunks long, n_words long")
    counts.write.mode("overwrite").parquet(at("df"))
    sizes.write.mode("overwrite").parquet(at("sizes"))
    _commit(spark, folder, step)
