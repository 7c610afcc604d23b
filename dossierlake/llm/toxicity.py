"""Toxicity by a linear classifier that is held to ignore which group a text mentions.

Features of a text are its distinct words and the distinct beginnings of its words (3 to 6 bytes, so inflected forms of a
stem count together). The loss is the logistic loss plus a penalty on the squared change of the score's logit when the
identity terms of a labelled text are swapped for other terms of the same kind, so that group mentions alone carry no
weight. The vocabulary is chosen by Spark from counts; training itself is numpy on a bounded, documented sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.llm import words as W

# Terms that name groups of people, by kind and language; a term is swapped for another of its line.
IDENTITY_TERMS = """
women men girls boys
woman man girl boy
muslims christians jews hindus buddhists atheists catholics
muslim christian jewish hindu buddhist atheist catholic
africans asians europeans arabs americans
african asian european arab american
gay lesbian straight bisexual transgender
immigrants refugees foreigners locals
frauen männer mädchen jungen
muslime christen juden hindus atheisten
ausländer flüchtlinge einheimische
femmes hommes filles garçons
musulmans chrétiens juifs hindous athées
immigrés réfugiés étrangers
mujeres hombres niñas niños
musulmanes cristianos judíos hindúes ateos
inmigrantes refugiados extranjeros
"""

# Labelled texts that are learned from at most: those with the smallest hashes of their ids.
MOST_LABELLED = 20_000
# Features of the vocabulary at most: those whose counts differ most between the classes. A size of the model, not of the data.
MOST_FEATURES = 8192
# Labelled texts that a feature occurs in at least, and standard deviations by which its toxic ones differ from chance.
LEAST_TEXTS = 5
LEAST_SURPRISE = 5.0
_PREFIXES = (3, 4, 5, 6)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _partners() -> dict[str, str]:
    out: dict[str, str] = {}
    for line in IDENTITY_TERMS.split("\n"):
        terms = line.split()
        for term, other in zip(terms, terms[1:] + terms[:1]):
            out.setdefault(term, other)
    return out


_PARTNERS = _partners()
_TERM = re.compile(r"\b(" + "|".join(sorted(_PARTNERS, key=len, reverse=True)) + r")\b", re.I)


def swapped(text: str | None) -> str | None:
    """The text with every identity term replaced by the next one of its kind; null where it has none."""
    if not text or not _TERM.search(text):
        return None
    return _TERM.sub(lambda m: _PARTNERS[m[0].lower()], text)


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """(words, 1 + prefixes) feature hashes: the word itself and its first 3, 4, 5 and 6 bytes; 0 where a word is shorter."""
    out = np.zeros((len(starts), 1 + len(_PREFIXES)), np.uint64)
    out[:, 0] = whole
    value, base = np.zeros(len(starts), np.uint64), np.uint64(0x100000001B3)
    size = ends - starts
    lower = data.copy()
    capital = (lower >= 0x41) & (lower <= 0x5A)
    lower[capital] += 32
    for k in range(max(_PREFIXES)):
        byte = lower[np.minimum(starts + k, len(data) - 1)].astype(np.uint64)
        value = value * base + byte + np.uint64(1)
        if k + 1 in _PREFIXES:
            out[:, 1 + _PREFIXES.index(k + 1)] = np.where(size >= k + 1, W.mix(value + np.uint64(k << 56)), np.uint64(0))
    return out


def _found(column: pa.Array, features: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a column: feature hashes, or indexes into `features` for those it lists."""
    data, offsets = W.utf8(column)
    starts, ends = W.spans(data, offsets, W.PLAIN)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, side="right") - 1
    distinct, where, number = np.unique(W.hash_words(data, starts, ends), return_index=True, return_inverse=True)
    own = _word_features(data, starts[where], ends[where], distinct)
    if features is None:
        each = np.unique(np.stack([text, number.ravel()]), axis=1)
        flat = own[each[1]]
        pairs = np.unique(np.stack([np.repeat(each[0], flat.shape[1]).astype(np.uint64), flat.ravel()]), axis=1)
        pairs = pairs[:, pairs[1] != 0]
        return pairs[0].astype(np.int64), pairs[1].view(np.int64)
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.minimum(np.searchsorted(features, own), len(features) - 1)
    near[features[near] != own] = -1
    listed = np.flatnonzero((near >= 0).any(axis=1)[number.ravel()])
    flat = near[number.ravel()[listed]]
    text = np.repeat(text[listed], flat.shape[1])[flat.ravel() >= 0]
    pairs = np.unique(text * len(features) + flat.ravel()[flat.ravel() >= 0])
    return pairs // len(features), pairs % len(features)


def _term_features() -> np.ndarray:
    return _found(pa.array([" ".join(sorted(_PARTNERS))]), None)[1].view(np.uint64)


def _fit(rows: list, n_features: int, penalty: float, decay: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights by Adam over all rows (toxic, features, swapped features or null) at once."""
    y = np.array([r[0] for r in rows], float)
    where = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    index = np.concatenate([np.zeros(0, np.int64), *(np.asarray(r[1], np.int64) for r in rows)])
    pairs = [r for r in rows if r[2] is not None]
    # The change of the logit under the swap: features that appear minus features that go.
    change = np.repeat(np.arange(len(pairs)), [len(r[1]) + len(r[2]) for r in pairs])
    moved = np.concatenate([np.zeros(0, np.int64), *(np.asarray([*r[2], *r[1]], np.int64) for r in pairs)])
    sign = np.concatenate([np.zeros(0), *(np.repeat([1.0, -1.0], [len(r[2]), len(r[1])]) for r in pairs)])
    w, bias = np.zeros(n_features), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(where, w[index], len(rows)) + bias, -30, 30)))
        error = (p - y) / len(rows)
        g = np.bincount(index, error[where], n_features) + decay * w
        if len(pairs):
            delta = np.bincount(change, sign * w[moved], len(pairs))
            g += 2 * penalty / len(pairs) * np.bincount(moved, sign * delta[change], n_features)
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - t / rounds) + 0.002
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, learn: Column, most_labelled: int = MOST_LABELLED, penalty: float = 1.0,
          decay: float = 1e-4, rounds: int = 300) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), of the labels for which `learn` (over doc_id) holds.

    A doc_id that is labelled several times counts as toxic if one label says so; null ids, labels and texts teach nothing.
    Without labelled texts of both classes the model knows no features and scores the share of toxic labels (0 without any).
    """
    spark = docs.sparkSession
    sample = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(learn).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled))
    # The limit bounds what is broadcast and what is collected: two numbers a row.
    rows = [tuple(r) for r in sample.collect()]
    known = F.broadcast(spark.createDataFrame(rows, sample.schema))
    # Rows that repeat an id teach once, by the first text in the alphabet.
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(known, "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    toxic = sum(r[1] for r in rows)
    if not 0 < toxic < len(rows):
        share = toxic / len(rows) if rows else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, most_bytes=1 << 20):
            text, feature = _found(batch.column("text"), None)
            yield pa.record_batch([pa.array(feature), batch.column("toxic").take(pa.array(text))], ["feature", "toxic"])

    counts = texts.mapInArrow(listed, "feature long, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).filter(F.col("n") >= LEAST_TEXTS)
    share = toxic / len(rows)
    surprise = F.abs(F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = [r[0] for r in counts.filter(surprise >= LEAST_SURPRISE).orderBy(surprise.desc(), "feature").limit(MOST_FEATURES).select("feature").collect()]
    features = np.unique(np.concatenate([np.array(chosen, np.int64).view(np.uint64), _term_features()]))
    shared = spark.sparkContext.broadcast(features)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            own = _lists(*_found(batch.column("text"), shared.value), batch.num_rows)
            other = pa.array([swapped(x) for x in batch.column("text").to_pylist()], pa.string())
            swaps = _lists(*_found(other, shared.value), batch.num_rows)
            swaps = [x if ok else None for x, ok in zip(swaps, other.is_valid().to_pylist())]
            yield pa.record_batch([batch.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.int32()))], ["toxic", "own", "swaps"])

    # At most one row for each labelled text, of vocabulary indexes only.
    examples = texts.mapInArrow(indexed, "toxic int, own array<int>, swaps array<int>").collect()
    examples.sort(key=lambda r: (r[0], r[1]))
    if not examples or len({r[0] for r in examples}) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    weights, bias = _fit(examples, len(features), penalty, decay, rounds)
    return Model(features, weights, bias)


def _lists(text: np.ndarray, index: np.ndarray, n: int) -> list[list[int]]:
    bounds = np.searchsorted(text, np.arange(n + 1)).tolist()
    flat = index.tolist()
    return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) for every row of docs(text, ...): `row` is the row as a struct, score its probability of being toxic.

    Null and empty texts have no features and get the score of the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in W.pieces(batches):
            text, index = _found(batch.column("text"), model.features)
            logit = np.bincount(text, model.weights[index], batch.num_rows) + model.bias
            yield pa.record_batch([batch.column("row"), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], ["row", "score"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, score double")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a doc_id is kept from learning: the CRC-32 of its decimal digits leaves this remainder. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the texts that score `threshold` or more; all columns, in the same order."""
    return score(docs, train(docs, labels, ~held_out(4, 2))).filter(F.col("score") < threshold).select("row.*")
