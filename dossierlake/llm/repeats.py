"""Repeated passages by sparse suffixes, grouped by hashes.

Of the suffixes of a text only those are retained that begin at a minimiser: the k-gram with the smallest hash among
those of some passage of `least` words. The choice depends on the passage alone, so wherever the passage stands, the same
of its suffixes are retained, and each passage of `least` words belongs to exactly one of them. No suffix
is sorted, compared with a neighbour or extended word by word: retained suffixes are grouped by 64-bit hashes instead, first
of their heads (the k-gram) and then of what surrounds them, and the groups tell which of them repeat:

* a suffix whose whole surroundings (all passages that belong to it) equal those of another repeats with all of them;
* of one whose head only repeats, all passages that belong to it are grouped by their hashes.

Grouping replaces the sort because neither step gathers the suffixes of a head: both are counts and minima that combine
before they are shuffled, where a sort by heads would bring a frequent head to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm import words as W
from dossierlake.llm.store import stored

LEAST = 50
HEAD = 20
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_DOWN = np.uint64(pow(int(_BASE), -1, 2**64))


class Spans:
    """Hashes of any word spans of a batch of texts, from one running sum."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        up = np.full(n + 1, _BASE, np.uint64)
        self.down = np.full(n + 1, _DOWN, np.uint64)
        up[0] = self.down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(self.down)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def minimisers(spans: Spans, bounds: np.ndarray, least: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, first, last): retained suffixes and the passages' first words that belong to each, all as word
    numbers of the batch. Of equal smallest hashes the leftmost counts."""
    n = int(bounds[-1])
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none
    gram = spans.of(np.arange(n - head + 1), np.arange(head, n + 1))
    width = least - head + 1
    best, reach = np.arange(len(gram)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        best, reach = np.where(gram[right] < gram[left], right, left), reach + step
    size = np.diff(bounds)
    starts = np.maximum(size - least + 1, 0)
    text = np.repeat(np.arange(len(size)), starts)
    passage = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts)
    position = best[passage]
    new = np.ones(len(text), bool)
    new[1:] = (position[1:] != position[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(text)])) - 1 if len(first) else first
    return text[first], position[first], passage[first], passage[last]


def suffixes(docs: DataFrame, least: int = LEAST, head: int = HEAD) -> DataFrame:
    """(doc_id, word, head, around, first, last): the retained suffixes of docs(doc_id, text), their place, the hash of
    their head and of all that their passages cover, and the first words of those passages."""

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, most_bytes=4 << 20):
            hashes, bounds = W.words(batch.column("text"), W.SPACED)
            spans = Spans(hashes)
            text, at, first, last = minimisers(spans, bounds, least, head)
            # What the passages of a suffix cover, seen from the suffix.
            around = W.mix(spans.of(first, last + least) ^ W.mix((at - first).astype(np.uint64)))
            base = bounds[:-1][text]
            yield pa.record_batch([
                batch.column("doc_id").take(pa.array(text)), pa.array((at - base).astype(np.int32)), pa.array(spans.of(at, at + head).view(np.int64)),
                pa.array(around.view(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
                ["doc_id", "word", "head", "around", "first", "last"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(
        retain, f"doc_id {kind}, word int, head long, around long, first int, last int")


def _passages(chosen: DataFrame, docs: DataFrame, least: int, head: int) -> DataFrame:
    """(head, around, back, passage, doc_id, first): every passage of the chosen suffixes, `back` words before the suffix.

    chosen(doc_id, word, head, around, first, last) holds one suffix for each head and surroundings.
    """
    wanted = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("word", "head", "around", "first", "last")).alias("own"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, most_bytes=4 << 20):
            hashes, bounds = W.words(batch.column("text"), W.SPACED)
            spans = Spans(hashes)
            own = batch.column("own")
            text = np.repeat(np.arange(batch.num_rows), pc_lengths(own))
            flat = own.flatten()
            word, first, last, heads, around = (np.array(flat.field(c)) for c in ("word", "first", "last", "head", "around"))
            base, end = bounds[:-1][text], bounds[1:][text]
            # Rows that repeat a doc_id with another text are not where the suffix was found.
            ok = (base + word + head <= end) & (base + last + least <= end)
            text, word, first, last, heads, around, base = (x[ok] for x in (text, word, first, last, heads, around, base))
            same = spans.of(base + word, base + word + head).view(np.int64) == heads
            text, word, first, last, heads, around, base = (x[same] for x in (text, word, first, last, heads, around, base))
            count = last - first + 1
            each = np.repeat(np.arange(len(word)), count)
            start = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            where = base[each] + start
            back = (word[each] - start).astype(np.int32)
            passage = W.mix(spans.of(where, where + least) ^ back.astype(np.uint64))
            yield pa.record_batch([pa.array(heads[each]), pa.array(around[each]), pa.array(back), pa.array(passage.view(np.int64)),
                                   batch.column("doc_id").take(pa.array(text[each])), pa.array(start.astype(np.int32))],
                                  ["head", "around", "back", "passage", "doc_id", "first"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(
        extend, f"head long, around long, back int, passage long, doc_id {kind}, first int")


def pc_lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(np.array(lists.offsets))


def _spans(starts, least: int):
    """Runs of sorted first words as structs (first, n_words); passages that overlap or touch are one run."""
    kind = "array<struct<first:int, n_words:int>>"

    def add(runs, start):
        last = F.element_at(runs, -1)
        reaches = (F.size(runs) > 0) & (start <= F.try_element_at(runs, F.lit(-1))["first"] + F.try_element_at(runs, F.lit(-1))["n_words"])
        longer = F.struct(last["first"].alias("first"), (start + least - last["first"]).cast("int").alias("n_words"))
        return F.when(reaches, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(
            F.concat(runs, F.array(F.struct(start.alias("first"), F.lit(least).alias("n_words")))))

    return F.aggregate(starts, F.array().cast(kind), add)


def repeated(docs: DataFrame, least: int = LEAST, head: int = HEAD) -> DataFrame:
    """(doc_id, spans, copies) for every doc_id of docs(doc_id, text) with a passage of `least` words or more that occurs
    elsewhere too, in another document or again in its own.

    `spans` are the repeated stretches as (first word from 0, number of words), at full length, in order; `copies` those
    parts of them of which an earlier occurrence exists (in a smaller doc_id or further left), which a cleaner would
    cut. Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased. Rows with a null doc_id, a null text or
    fewer words have none. Rows that repeat a doc_id with the same text count as one occurrence each and report it once.
    """
    made = stored(suffixes(docs, least, head), "suffixes")
    place = F.struct("doc_id", "word", "first", "last")
    kinds = stored(made.groupBy("head", "around").agg(F.count("*").alias("n"), F.min(place).alias("source")), "kinds")
    heads = kinds.groupBy("head").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).filter("total > 1").select("head", "kinds")
    live = stored(kinds.join(heads, "head"), "live")
    found = stored(_passages(live.filter("kinds > 1").select("source.doc_id", "source.word", "head", "around", "source.first", "source.last"), docs, least, head), "passages")
    earliest = found.groupBy("passage").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "first")).alias("origin")).filter("n > 1").select("passage", "origin")
    extended = (found.select("passage", "head", "around", "back").join(earliest, "passage").groupBy("head", "around")
                .agg(F.collect_list(F.struct("back", "origin")).alias("extended")))
    # One row per head and surroundings: how its passages repeat. At most `least` entries each.
    known = (live.join(extended, ["head", "around"], "left").filter("n > 1 OR extended IS NOT NULL")
             .select("head", "around", (F.col("n") > 1).alias("whole"), "source", F.coalesce("extended", F.array()).alias("extended")))
    backs = F.sequence(F.col("word") - F.col("last"), F.col("word") - F.col("first"))
    own = F.struct(F.col("source.doc_id").alias("doc_id"), F.lit(0).alias("first"))
    other = F.map_from_entries("extended")
    passages = F.when(F.col("whole"), backs).otherwise(F.map_keys(other))
    # The first occurrence of a passage: over all heads alike if extended, else that of the same surroundings.
    origin = lambda b: F.coalesce(F.try_element_at(other, b), F.struct(own["doc_id"].alias("doc_id"), (F.col("source.word") - b).alias("first")))
    later = lambda b: (origin(b)["doc_id"] < F.col("doc_id")) | ((origin(b)["doc_id"] == F.col("doc_id")) & (origin(b)["first"] < F.col("word") - b))
    starts = (made.join(known, ["head", "around"]).select("doc_id", F.transform(passages, lambda b: (F.col("word") - b).cast("int")).alias("all"),
                                                          F.transform(F.filter(passages, later), lambda b: (F.col("word") - b).cast("int")).alias("later")))
    gathered = starts.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("all")))).alias("all"),
                                            F.array_sort(F.array_distinct(F.flatten(F.collect_list("later")))).alias("later"))
    return gathered.select("doc_id", _spans(F.col("all"), least).alias("spans"), _spans(F.col("later"), least).alias("copies"))


def without_copies(docs: DataFrame, least: int = LEAST, head: int = HEAD) -> DataFrame:
    """docs with all but the first occurrence of every repeated passage cut out of `text`; other texts stay as they are.

    A cut goes from the first byte of its first word to the first byte of the word after it.
    """
    cuts = repeated(docs, least, head).filter("size(copies) > 0").select("doc_id", F.col("copies").alias("cuts"))
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text").join(cuts, "doc_id", "left").select("row", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            data, offsets = W.utf8(batch.column("text"))
            starts, _ = W.spans(data, offsets, W.SPACED)
            bounds = np.searchsorted(starts, offsets)
            texts, whole = batch.column("text").to_pylist(), data.tobytes()
            for i, own in enumerate(batch.column("cuts").to_pylist()):
                for span in reversed(own or []):
                    base, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
                    a, b = span["first"], span["first"] + span["n_words"]
                    if b <= n:
                        begin = int(starts[base + a] - offsets[i])
                        end = int(starts[base + b] - offsets[i]) if b < n else int(offsets[i + 1] - offsets[i])
                        raw = texts[i].encode()
                        texts[i] = (raw[:begin] + raw[end:]).decode()
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    done = packed.mapInArrow(cut, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
