"""Language identification by a small byte convolutional network, trained and applied in numpy.

A window of WINDOW bytes goes through filters of several widths; each filter keeps its largest response in the window
(max pooling), and a softmax over the pooled responses gives the languages' probabilities. A text is cut into windows
from its first to its last byte, the probabilities of its windows are averaged by their numbers of letters.

Bytes are reduced to classes (letters, the continuation and lead bytes of UTF-8, a blank for everything else), so a filter's
responses to all pairs of neighbouring bytes fit in a small table and a convolution is a sum of two or three look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.llm import words as W

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 8
# Labelled texts that are learned from at most, those with the smallest hashes of their ids, and windows of each.
MOST_LABELLED = 6_000
WINDOWS_EACH = 4

# Class of each byte: 0 is a blank; then a-z; then the bytes from 0x80 on, as they are.
CLASSES = 1 + 26 + 128
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = _CLASS[0x41:0x5B] = np.arange(1, 27)
_CLASS[0x80:] = np.arange(27, CLASSES)


@dataclass
class Network:
    names: list[str]
    filters: list[np.ndarray]  # of each width: (width, CLASSES, FILTERS)
    bias: np.ndarray  # of all filters
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) byte classes and the text of each window. The last window of a text is padded with blanks; texts
    with no bytes have none. Runs of blanks count as they are: every byte of a text is in one window."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    at = offsets[:-1][text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    index = at[:, None] + np.arange(WINDOW)
    inside = index < offsets[1:][text][:, None]
    return np.where(inside, _CLASS[data[np.minimum(index, len(data) - 1)]], 0) if len(text) else np.zeros((0, WINDOW), np.int64), text


def _pooled(net: Network, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest responses (windows, all filters) before the bias, and where they are."""
    most, where = [], []
    for filters in net.filters:
        width = len(filters)
        response = filters[0][windows[:, : WINDOW - width + 1]]
        for k in range(1, width):
            response = response + filters[k][windows[:, k: WINDOW - width + 1 + k]]
        at = response.argmax(axis=1)
        where.append(at)
        most.append(np.take_along_axis(response, at[:, None], axis=1)[:, 0])
    return np.concatenate(most, axis=1), where


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = 6, least_steps: int = 500, batch: int = 64, seed: int = 5) -> Network:
    """A network by Adam on the cross entropy of labelled windows; small samples are gone through more often."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    width = FILTERS * len(WIDTHS)
    net = Network(names, filters, np.zeros(width, np.float32), rng.normal(0, 0.2, (width, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    params = [*net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    each = max(1, -(-len(windows) // batch))
    epochs = max(epochs, -(-least_steps // each)) if len(windows) else 0
    total = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            rows = order[i: i + batch]
            x, y = windows[rows], labels[rows]
            raw, where = _pooled(net, x)
            hidden = np.maximum(raw + net.bias, 0)
            slope = _softmax(hidden @ net.out + net.out_bias)
            slope[np.arange(len(rows)), y] -= 1
            slope /= len(rows)
            back = (slope @ net.out.T) * (hidden > 0)
            grads = []
            for f, (filt, at) in enumerate(zip(net.filters, where)):
                own, g = back[:, f * FILTERS: (f + 1) * FILTERS], np.zeros_like(filt)
                for k in range(len(filt)):
                    np.add.at(g[k], (np.take_along_axis(x, at + k, axis=1), np.arange(FILTERS)[None]), own)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            step += 1
            rate = 0.01 * (1 - step / (total + 1))
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


class Tables:
    """The filters as look-ups: one table over pairs of byte classes for every two places of a filter."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.pairs = []
        for filters in net.filters:
            tables = []
            for k in range(0, len(filters), 2):
                if k + 1 < len(filters):
                    tables.append((k, True, np.ascontiguousarray((filters[k][:, None] + filters[k + 1][None]).reshape(-1, FILTERS))))
                else:
                    tables.append((k, False, np.ascontiguousarray(filters[k])))
            self.pairs.append(tables)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.net.names)), np.float32)
        for i in range(0, len(windows), 512):
            x = windows[i: i + 512]
            both = x[:, :-1] * CLASSES + x[:, 1:]
            pooled = []
            for width, tables in zip(WIDTHS, self.pairs):
                n = WINDOW - width + 1
                response = None
                for k, paired, table in tables:
                    part = table.take((both if paired else x)[:, k: k + n], axis=0)
                    response = part if response is None else np.add(response, part, out=response)
                pooled.append(response.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
            out[i: i + 512] = _softmax(hidden @ self.net.out + self.net.out_bias)
        return out


def train(docs: DataFrame, learn: Column, most_labelled: int = MOST_LABELLED) -> Network:
    """A network from docs(doc_id, text, lang), from rows with a text, a language and `learn` (over doc_id).

    The sample is `most_labelled` distinct ids, those with the smallest hashes, and at most `WINDOWS_EACH` windows of each text, so a
    language that fewer than one in `most_labelled` labelled texts has may not be learned. Languages are the distinct
    values of the sample; a corpus without labelled texts gives a network without languages.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            data, offsets = W.utf8(batch.column("text"))
            rows, text = cut(data, offsets)
            if not len(text):
                continue
            # Windows of a text in equal steps over its whole length.
            count = np.bincount(text, minlength=batch.num_rows)
            number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            step = np.maximum(1, count // WINDOWS_EACH)[text]
            letters = (rows > 0).sum(axis=1)
            # A text of one window teaches what it has; longer ones teach their fuller windows.
            enough = np.where(count[text] == 1, letters > 0, letters >= WINDOW // 3)
            keep = np.flatnonzero((number % step == 0) & (number // step < WINDOWS_EACH) & enough)
            yield pa.record_batch([batch.column("lang").take(pa.array(text[keep])), pa.array(list(map(bytes, rows[keep].astype(np.uint8))), pa.binary())], ["lang", "window"])

    usable = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sample = usable.filter(learn).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    chosen = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in sample.collect()], sample.schema))
    # Rows that repeat an id teach once, by the first language and text in the alphabet.
    labelled = usable.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.*")
    # A few windows of each sampled text: bounded by the sample.
    rows = sorted(tuple(r) for r in labelled.select("lang", "text").mapInArrow(windows, "lang string, window binary").collect())
    names = sorted({r[0] for r in rows})
    if not rows:
        return fit(np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64), names)
    x = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return fit(x, np.array([names.index(r[0]) for r in rows]), names)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(row, lang_pred, score) for every row of docs(text, ...): `row` is the row as a struct.

    Whole texts are read. lang_pred is `und` with score 0 if the text is null or has no letter, or nothing was learned;
    ties go to the language that comes first in the alphabet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    packed = docs.select(F.struct("*").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        names = tables.net.names
        for batch in W.pieces(batches, most_bytes=1 << 20):
            column = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            total = np.zeros((batch.num_rows, max(1, len(names))))
            weight = np.zeros(batch.num_rows)
            if names:
                windows, text = cut(*W.utf8(column))
                share = (windows > 0).sum(axis=1) + 1e-3
                odds = tables.probabilities(windows)
                for k in range(len(names)):
                    total[:, k] = np.bincount(text, odds[:, k] * share, batch.num_rows)
                weight = np.bincount(text, share, batch.num_rows)
            best = total.argmax(axis=1)
            known = lettered & (weight > 0)
            value = np.where(known, np.clip(total[np.arange(len(best)), best] / np.maximum(weight, 1e-9), 0, 1), 0.0)
            yield pa.record_batch([batch.column("row"), pa.array([names[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())], pa.string()), pa.array(value)],
                                  ["row", "lang_pred", "score"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double")
