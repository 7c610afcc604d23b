"""Benchmark decontamination with suffix arrays of the training texts.

Each task cuts its documents into shards, sorts the word suffixes of a shard by their first 16 words (or those of a wider window), and looks up every
test suffix in it by binary search. Matches of consecutive suffixes are joined, so each comes out with its full length
and its place in the item and in the document. Shards hold whole documents, so their results need no merging.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm import words as W

# Text of one shard: at most 2**21 words, so three ranks fit into 64 bits.
SHARD_BYTES = 4 << 20
# Benchmark text that a task looks up at a time; a larger benchmark takes one pass over the documents per block.
BLOCK_BYTES = 4 << 20
# Words by which suffixes are sorted, at least.
DEPTH = 16
# Benchmark places, items or matches that are held at a time while a shard's results are listed.
CHUNK = 1 << 18
HITS = "array<struct<word:int, n_words:int>>"
MATCHES = "array<struct<item:string, item_word:int, word:int, n_words:int>>"


@dataclass
class Windows:
    """Distinct windows of one block of the benchmark and the places they come from."""

    window: np.ndarray  # (n, width) word hashes
    length: np.ndarray  # (n,) words of each; shorter than width for items that are shorter than a window
    first: np.ndarray  # (n + 1,) where its places begin
    item: np.ndarray  # item number of each place
    at: np.ndarray  # first word of each place
    names: list[str]
    same: np.ndarray  # (n,) the first window with the same distinct items
    set_first: np.ndarray  # (n + 1,) where its distinct items begin
    set_item: np.ndarray  # distinct item numbers of each window


@dataclass
class Shard:
    """Where a shard has windows of the benchmark, in the order of its words."""

    n_words: np.ndarray  # words of each text
    starts: np.ndarray  # position of each text; one position after each text belongs to none
    text: np.ndarray
    position: np.ndarray
    window: np.ndarray


def windows(names: list[str], texts: list[str | None], width: int) -> Windows:
    hashes, bounds = W.words(pa.array(texts, pa.string()), W.PLAIN)
    rows, lengths, items, at = [], [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a >= width:
            rows.append(np.lib.stride_tricks.sliding_window_view(hashes[a:b], width))
            lengths.append(np.full(b - a - width + 1, width))
        elif b > a:
            rows.append(np.pad(hashes[a:b], (0, width - b + a))[None])
            lengths.append(np.array([b - a]))
        else:
            continue
        items.append(np.full(len(rows[-1]), i))
        at.append(np.arange(len(rows[-1])))
    if not rows:
        none = np.zeros(0, np.int64)
        return Windows(np.zeros((0, width), np.uint64), none, np.zeros(1, np.int64), none, none, names, none, np.zeros(1, np.int64), none)
    full = np.concatenate([np.concatenate(rows), np.concatenate(lengths)[:, None].astype(np.uint64)], axis=1)
    distinct, number = np.unique(full, axis=0, return_inverse=True)
    order = np.argsort(number.ravel(), kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(number.ravel(), minlength=len(distinct)))))
    item, owner = np.concatenate(items)[order], number.ravel()[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])))
    set_item, set_first = item[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(distinct)))))
    _, least, which = np.unique(np.add.reduceat(W.mix(set_item.astype(np.uint64) + np.uint64(1)), set_first[:-1]), return_index=True, return_inverse=True)
    return Windows(distinct[:, :width], distinct[:, width].astype(np.int64), first, item, np.concatenate(at)[order], names,
                   least[which.ravel()], set_first, set_item)


def blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[Windows]:
    """The benchmark, a bounded block of items at a time; rows without an id or text have no windows."""
    names, texts, size = [], [], 0
    for row in benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        names.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= block_bytes:
            yield windows(names, texts, width)
            names, texts, size = [], [], 0
    if names:
        yield windows(names, texts, width)


def suffix_array(ids: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions of `ids` (small whole numbers) in the order of the `depth` values that follow them, or of more."""
    n = len(ids)
    bits = int(max(n, int(ids.max(initial=0)))).bit_length()
    rank, order, reach = ids.astype(np.uint64), np.arange(n), 1
    at, b = np.arange(n, dtype=np.uint64), np.uint64(bits)
    while reach < depth:
        pair = rank << b
        pair[: max(0, n - reach)] |= rank[reach:]
        if 3 * bits <= 64:
            both = np.sort(pair << b | at)
            order, pair = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> b
        else:
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
        rank[order] = np.concatenate(([0], np.cumsum(pair[1:] != pair[:-1]))).astype(np.uint64)
        reach *= 2
    return order


def find(ids: np.ndarray, order: np.ndarray, sought: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in `order` the suffixes that begin with each sought window start and end."""
    width = sought.shape[1]
    padded = np.concatenate((ids, np.zeros(width, ids.dtype)))
    column = np.arange(width)
    unused = column >= length[:, None]

    def bound(past: bool) -> np.ndarray:
        low, high = np.zeros(len(sought), np.int64), np.full(len(sought), len(order))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            seen = padded[order[mid][:, None] + column]
            differ = (seen != sought[open_]) & ~unused[open_]
            k = differ.argmax(axis=1)
            row = np.arange(len(open_))
            less = np.where(differ[row, k], seen[row, k] < sought[open_][row, k], past)
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low

    return bound(False), bound(True)


def occurrences(column: pa.Array, block: Windows) -> Shard:
    """Every place of every window in these texts: at most one a word and window length, however many items have the window."""
    hashes, bounds = W.words(column, W.PLAIN)
    n_words = np.diff(bounds)
    starts = bounds[:-1] + np.arange(len(n_words))
    none = np.zeros(0, np.int64)
    nothing = Shard(n_words, starts, none, none, none)
    if not len(hashes) or not len(block.window):
        return nothing
    distinct, number = np.unique(hashes, return_inverse=True)
    # A word of the shard is its rank; 0 ends every text.
    ids = np.zeros(len(hashes) + len(n_words), np.int64)
    ids[np.arange(len(hashes)) + np.repeat(np.arange(len(n_words)), n_words)] = number.ravel() + 1
    near = np.minimum(np.searchsorted(distinct, block.window), len(distinct) - 1)
    used = np.arange(block.window.shape[1]) < block.length[:, None]
    known = np.flatnonzero(((distinct[near] == block.window) | ~used).all(axis=1))
    if not len(known):
        return nothing
    order = suffix_array(ids, max(DEPTH, block.window.shape[1]))
    low, high = find(ids, order, near[known] + 1, block.length[known])
    found = high - low
    window = np.repeat(known, found)
    position = order[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)]
    order = np.argsort(position, kind="stable")
    window, position = window[order], position[order]
    return Shard(n_words, starts, np.searchsorted(starts, position, side="right") - 1, position, window)


def hit_words(shard: Shard, block: Windows) -> Iterator[tuple[int, int, int]]:
    """(text, first word, words) of every run of words that windows cover."""
    if not len(shard.position):
        return
    size = int(shard.n_words.sum()) + len(shard.n_words) + 1
    deep = np.cumsum(np.bincount(shard.position, minlength=size) - np.bincount(shard.position + block.length[shard.window], minlength=size))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], deep > 0, [False])).astype(np.int8)))
    first, past = edges[::2], edges[1::2]
    text = np.searchsorted(shard.starts, first, side="right") - 1
    yield from zip(text.tolist(), (first - shard.starts[text]).tolist(), (past - first).tolist())


def hit_items(shard: Shard, block: Windows) -> Iterator[tuple[int, np.ndarray]]:
    """(text, item numbers) of every text with windows; windows with the same items are looked at once a text."""
    edges = np.flatnonzero(np.diff(shard.text, prepend=-1, append=-1))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        seen = np.zeros(len(block.names), bool)
        for w in np.unique(block.same[shard.window[i:j]]).tolist():
            seen[block.set_item[block.set_first[w]: block.set_first[w + 1]]] = True
        yield int(shard.text[i]), np.flatnonzero(seen)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Matches as columns (text, item, diagonal, first word in item, last window in item, its words), joined where one goes on in another."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0) | (rows[3, 1:] != rows[4, :-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [rows.shape[1]])) - 1 if len(first) else first
    return np.concatenate((rows[:4, first], rows[4:, last]))


def long_matches(shard: Shard, block: Windows) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, first word in item, first word in text, words) of every joined match, text by text.

    Places of the benchmark are expanded for a bounded run of occurrences at a time; only matches of the text that goes on are kept.
    """
    places = block.first[shard.window + 1] - block.first[shard.window]
    total, i, held = np.cumsum(places), 0, []
    while i < len(places):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CHUNK, side="right")))
        text, window, n = shard.text[i:j], shard.window[i:j], places[i:j]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.first[window], n)
        at = block.at[place]
        word = np.repeat(shard.position[i:j] - shard.starts[text], n)
        found = _joined([*held, np.stack((np.repeat(text, n), block.item[place], word - at, at, at, np.repeat(block.length[window], n)))])
        open_ = found[0] == text[-1] if j < len(places) and shard.text[j] == text[-1] else np.zeros(found.shape[1], bool)
        held = [found[:, open_]]
        t, item, diagonal, at, last, length = found[:, ~open_]
        yield from zip(t.tolist(), item.tolist(), at.tolist(), (diagonal + at).tolist(), (last - at + length).tolist())
        i = j


def _with_lists(batch: pa.RecordBatch, n_words: np.ndarray, name: str, found: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
    """The rows with their words and with `found`, (text, values) in the order of texts, added to the lists of column
    `name`; in batches that end once they hold CHUNK new values."""
    batch = batch.set_column(batch.schema.get_field_index("n_words"), "n_words", pa.array(n_words, pa.int32()))
    at, kind = batch.schema.get_field_index(name), batch.schema.field(name).type
    first, held, more = 0, 0, {}

    def until(end: int) -> pa.RecordBatch:
        part = batch.slice(first, end - first)
        lists = part.column(at).to_pylist()
        for text, values in more.items():
            lists[text - first].extend(values)
        return part.set_column(at, name, pa.array(lists, kind))

    for text, values in found:
        if held >= CHUNK and text not in more:
            yield until(text)
            first, held, more = text, 0, {}
        more.setdefault(text, []).extend(values)
        held += len(values)
    if first < batch.num_rows:
        yield until(batch.num_rows)


def _passes(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, columns: dict[str, str], search) -> DataFrame:
    """docs(text, ...) as (row, text, n_words, *columns) after search(batch, block) of every block of the benchmark."""
    sc = docs.sparkSession.sparkContext
    out = docs.select(F.struct("*").alias("row"), "text", F.lit(0).alias("n_words"), *(F.array().cast(kind).alias(c) for c, kind in columns.items()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)

    def searched(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.pieces(batches, most_bytes=SHARD_BYTES):
                yield from search(batch, shared.value)

        return run

    passes = list(blocks(benchmark, width, block_bytes)) or [windows([], [], width)]
    for block in passes:
        out = out.mapInArrow(searched(sc.broadcast(block)), kinds)
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, matches) for every row of docs(text, ...): `row` is the row as a struct.

    matches lists the verbatim matches of at least `width` words, or of whole items where they are shorter: item, its
    first matching word, the document's first matching word (both from 0), and the words they share from there on. They
    are as long as they can be. Null texts have no words; null or wordless items, or an empty benchmark, match nothing.
    """

    def search(batch: pa.RecordBatch, block: Windows) -> Iterator[pa.RecordBatch]:
        shard = occurrences(batch.column("text"), block)
        found = ((text, [{"item": block.names[item], "item_word": at, "word": word, "n_words": n}]) for text, item, at, word, n in long_matches(shard, block))
        return _with_lists(batch, shard.n_words, "matches", found)

    return _passes(docs, benchmark, width, block_bytes, {"matches": MATCHES}, search).select("row", "n_words", "matches")


def overlaps(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, hits, items) for every row of docs(text, ...): what `annotate` finds without the single matches.

    hits are the runs of words that matches cover; runs of different blocks of the benchmark may overlap. items are the
    matching items; an item_id that several benchmark rows have can be listed more than once.
    """

    def search(batch: pa.RecordBatch, block: Windows) -> Iterator[pa.RecordBatch]:
        shard = occurrences(batch.column("text"), block)
        hits = batch.column("hits").to_pylist()
        for text, word, n in hit_words(shard, block):
            hits[text].append({"word": word, "n_words": n})
        at = batch.schema.get_field_index("hits")
        batch = batch.set_column(at, "hits", pa.array(hits, batch.schema.field(at).type))
        found = ((text, [block.names[i] for i in items.tolist()]) for text, items in hit_items(shard, block))
        return _with_lists(batch, shard.n_words, "items", found)

    return _passes(docs, benchmark, width, block_bytes, {"hits": HITS, "items": "array<string>"}, search).select("row", "n_words", "hits", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without the documents that share a window with the benchmark; all columns, in the same order."""

    def search(batch: pa.RecordBatch, block: Windows) -> Iterator[pa.RecordBatch]:
        clean = np.ones(batch.num_rows, bool)
        clean[occurrences(batch.column("text"), block).text] = False
        yield batch.filter(pa.array(clean))

    return _passes(docs, benchmark, width, BLOCK_BYTES, {}, search).select("row.*")
