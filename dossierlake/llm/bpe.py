"""Byte-pair encoding and decoding of whole texts.

A word's merges are found by a segment tree over the ranks of its adjacent pairs: the root holds the lowest rank, the way
down that prefers the left child leads to its leftmost pair, and a merge changes three leaves, each with logarithmic work.
The merge loop ends when the root says that no pair is left that can be merged.

The kind of vocabulary is the one of `word_bpe_49k.json`: texts are composed (NFC) and lower-cased, white space is dropped,
words are cut by one pattern, their bytes are written in a byte alphabet, and the last symbol of a word carries an end mark.
The strings of added tokens are looked for in the raw text and become their ids. The vocabulary is read on the driver from
a path given by the caller and broadcast; its size is that of the file, whatever the data.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm import words as W

# The normalisation and the cutting of words that this encoder is written for, as the vocabulary file states them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: the white space of Unicode, which has no U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"

_GAP = re.compile(f"[{SPACE}]")
_SEPARATOR = re.compile("[\x1c-\x1f]")
# Characters of a text that are cut at a time, and runs whose tokens a task remembers.
STRETCH = 1 << 20
REMEMBERED = 1 << 19
# Leaves of the largest tree that is grown for many words at once; longer words have a tree of their own.
MANY = 64


@dataclass
class Vocabulary:
    tokens: list[str | None]  # by id; null where no token has the id
    ranks: dict[int, int]  # left id * len(tokens) + right id -> rank of the pair
    merged: list[int]  # rank -> id of the joined token
    inner: list[int]  # byte -> id inside a word
    last: list[int]  # byte -> id at the end of a word
    added: dict[str, int]  # tokens that are looked for in raw texts
    words: str  # pattern of a word
    low: dict[int, str]  # small letters that str.lower does not know


def _unicode() -> tuple[str, dict[int, str]]:
    """The word pattern with its classes written out, and small letters that Python's own tables lack.

    Both follow the Unicode version of the library that defines such files, as the versions differ in recent letters.
    """
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    pattern = PATTERN.replace(r"\s", SPACE)
    for name in (r"\p{L}", r"\p{N}"):
        runs: list[list[int]] = []
        for c in sorted(ord(c) for run, _ in Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str("".join(every)) for c in run):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        pattern = pattern.replace(name, "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs))
    small = Lowercase().normalize_str("\n".join(c for c in every if c != "\n")).split("\n")
    return pattern, {ord(c): s for c, s in zip((c for c in every if c != "\n"), small) if c.lower() != s}


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file. Raises ValueError for files that describe another kind of encoding."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    fits = (model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS and [p["type"] for p in cut] == ["Split", "ByteLevel"]
            and cut[0]["pattern"] == {"Regex": PATTERN} and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and not cut[1]["add_prefix_space"]
            and not cut[1].get("use_regex", True) and not spec["decoder"] and not spec["post_processor"]
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
    if not fits:
        raise ValueError(f"{path} describes another kind of encoding")
    vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens: list[str | None] = [None] * (1 + max([*vocab.values(), *added.values()]))
    for token, i in [*vocab.items(), *added.items()]:
        tokens[i] = token
    ranks, merged = {}, []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks.setdefault(vocab[left] * len(tokens) + vocab[right], rank)
        merged.append(vocab[left + right])
    alphabet = _byte_alphabet()
    return Vocabulary(tokens, ranks, merged, [vocab[c] for c in alphabet], [vocab[c + end] for c in alphabet], added, *_unicode())


def merge(ids: list[int], v: Vocabulary) -> list[int]:
    """`ids` after all merges: always the pair of lowest rank, of equal ones the leftmost. For one word of any length."""
    n, ranks, width = len(ids), v.ranks, len(v.tokens)
    if n < 2:
        return list(ids)
    none, leaves = len(v.merged), 1 << (n - 2).bit_length()
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    # tree[leaves + i] is the rank of the pair that begins at i; every inner node has the lower one of its children.
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        tree[leaves + i] = ranks.get(ids[i] * width + ids[i + 1], none)
    for at in range(leaves - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def put(i: int, rank: int) -> None:
        at = leaves + i
        tree[at] = rank
        while at > 1:
            at >>= 1
            low = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == low:
                break
            tree[at] = low

    while (rank := tree[1]) < none:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] != rank:
                at += 1
        i = at - leaves
        gone = after[i]
        ids[i], after[i] = v.merged[rank], after[gone]
        if gone < n - 1:
            put(gone, none)
        if after[i] < n:
            before[after[i]] = i
            put(i, ranks.get(ids[i] * width + ids[after[i]], none))
        else:
            put(i, none)
        if before[i] >= 0:
            put(before[i], ranks.get(ids[before[i]] * width + ids[i], none))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class _Arrays:
    """The vocabulary as arrays: pairs in the order of their keys."""

    def __init__(self, v: Vocabulary):
        self.width, self.merged = len(v.tokens), np.array(v.merged, np.int64)
        self.pairs = np.array(sorted(v.ranks), np.int64)
        self.ranks = np.array([v.ranks[k] for k in sorted(v.ranks)], np.int64)
        self.inner, self.last = np.array(v.inner), np.array(v.last)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        if not len(self.pairs):
            return np.full(key.shape, len(self.merged))
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], len(self.merged))


def merge_many(ids: np.ndarray, size: np.ndarray, leaves: int, v: _Arrays) -> np.ndarray:
    """The same for many words at once, a tree for each: ids(words, leaves + 1), of which the first `size` of a word count.

    What was merged away is -1 in the result.
    """
    m, n, none = len(ids), leaves + 1, len(v.merged)
    ids = np.where(np.arange(n) < size[:, None], ids, -1)
    tree = np.full((m, 2 * leaves), none, np.int64)
    tree[:, leaves:] = np.where(np.arange(1, n) < size[:, None], v.rank(ids[:, :-1], ids[:, 1:]), none)
    level = leaves
    while level > 1:
        tree[:, level // 2: level] = np.minimum(tree[:, level: 2 * level: 2], tree[:, level + 1: 2 * level: 2])
        level //= 2
    after, before = np.tile(np.arange(1, n + 1), (m, 1)).ravel(), np.tile(np.arange(-1, n - 1), (m, 1)).ravel()
    ids, tree = ids.ravel(), tree.ravel()
    row = np.flatnonzero(tree[1:: 2 * leaves] < none)
    while len(row):
        trunk, base, end = row * (2 * leaves), row * n, size[row]
        rank, at = tree[trunk + 1], np.ones(len(row), np.int64)
        for _ in range(leaves.bit_length() - 1):
            at *= 2
            at += tree[trunk + at] != rank
        i = at - leaves
        gone, new = after[base + i], v.merged[rank]
        right, left = after[base + gone], before[base + i]
        ids[base + i], ids[base + gone], after[base + i] = new, -1, right
        more, some = right < end, left >= 0
        before[(base + right)[more]] = i[more]
        tree[trunk + at] = np.where(more, v.rank(new, ids[base + np.where(more, right, 0)]), none)
        low = gone < leaves
        tree[(trunk + leaves + gone)[low]] = none
        tree[(trunk + leaves + left)[some]] = v.rank(ids[base + left], new)[some]
        changed = [at, leaves + np.where(low, gone, i), leaves + np.where(some, left, i)]
        for _ in range(leaves.bit_length() - 1):
            changed = [x >> 1 for x in changed]
            for x in changed:
                tree[trunk + x] = np.minimum(tree[trunk + 2 * x], tree[trunk + 2 * x + 1])
        row = row[tree[trunk + 1] < none]
    return ids.reshape(m, n)


class _Packed(dict):
    """Run without white space -> its ids as little-endian 32-bit integers, for the runs that a task met last.

    No word crosses white space and nothing composes with it, so runs can be normalised and cut one by one.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.arrays, self.cut = vocabulary, _Arrays(vocabulary), re.compile(vocabulary.words).findall

    def learn(self, runs: set[str]) -> None:
        if len(self) >= REMEMBERED:
            self.clear()
        cut, low, parts = self.cut, self.v.low, {}
        words: dict[str, bytes] = {}  # in the order in which they are met
        for run in runs:
            if run in self:
                continue
            # Lower-cased character by character: a capital sigma has one small form wherever it stands.
            plain = run.lower() if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ").translate(low).lower()
            if plain.isascii() and plain.isalpha():
                parts[run] = plain
                words[plain] = b""
            else:
                parts[run] = each = tuple(cut(plain))
                words.update(dict.fromkeys(each, b""))
        words = dict(zip(words, self.packed(list(words))))
        for run, each in parts.items():
            self[run] = words[each] if isinstance(each, str) else b"".join([words[w] for w in each])

    def packed(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words. Words whose trees have the same size are merged together, but for very long ones."""
        out: list[bytes] = [b""] * len(words)
        data, offsets = W.utf8(pa.array(words, pa.large_string()))
        size = np.diff(offsets)
        for leaves in [1 << k for k in range(MANY.bit_length())]:
            fit = np.flatnonzero((size > (leaves // 2 + 1 if leaves > 1 else 0)) & (size <= leaves + 1))
            if not len(fit):
                continue
            at = np.minimum(offsets[fit][:, None] + np.arange(leaves + 1), len(data) - 1)
            ids = np.where(np.arange(leaves + 1) == size[fit][:, None] - 1, self.arrays.last[data[at]], self.arrays.inner[data[at]])
            ids = merge_many(ids, size[fit], leaves, self.arrays)
            flat, ends = ids[ids >= 0].astype("<u4").tobytes(), 4 * np.cumsum((ids >= 0).sum(axis=1))
            for k, a, b in zip(fit.tolist(), [0, *ends.tolist()], ends.tolist()):
                out[k] = flat[a:b]
        for k in np.flatnonzero(size > MANY + 1).tolist():
            own = data[offsets[k]: offsets[k + 1]].tolist()
            out[k] = np.array(merge([*(self.v.inner[b] for b in own[:-1]), self.v.last[own[-1]]], self.v), "<u4").tobytes()
        return out


def _stretches(text: str) -> Iterator[str]:
    """The text in parts of about `STRETCH` characters that end at white space."""
    at = 0
    while len(text) - at > STRETCH and (gap := _GAP.search(text, at + STRETCH)):
        yield text[at: gap.end()]
        at = gap.end()
    yield text[at:]


def encode_texts(texts: list[str | None], packed: _Packed) -> list[bytes]:
    """The ids of each text; null and empty ones have none."""
    out: list[list[bytes]] = [[] for _ in texts]
    added, waiting, held = _added(tuple(packed.v.added)), [], 0

    def flush() -> None:
        packed.learn(set().union(*(runs for _, runs in waiting)) if waiting else set())
        for k, runs in waiting:
            out[k].append(b"".join(map(packed.__getitem__, runs)))
        waiting.clear()

    for k, text in enumerate(texts):
        for j, part in enumerate(added.split(text or "") if added else [text or ""]):
            if j % 2:
                flush()
                out[k].append(packed.v.added[part].to_bytes(4, "little"))
                continue
            for stretch in _stretches(part):
                # str.split also cuts at U+001C to U+001F.
                waiting.append((k, list(filter(None, _GAP.split(stretch))) if _SEPARATOR.search(stretch) else stretch.split()))
                held += len(stretch)
                if held >= STRETCH:
                    flush()
                    held = 0
    flush()
    return [b"".join(x) for x in out]


@functools.cache
def _added(tokens: tuple[str, ...]) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")") if tokens else None


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, ids, n_tokens) for every row of docs(text, and at least one more): `row` has all columns but the text, ids are little-endian 32-bit integers in a row.

    No special token is added. Null and empty texts and texts of white space alone have no tokens. Rows that repeat come
    out as often; other columns, whatever their names, are carried along in `row`. A text must fit in a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    shaped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _Packed(shared.value)
        for batch in W.pieces(batches):
            found = encode_texts(batch.column("text").to_pylist(), packed)
            yield pa.record_batch([batch.column("row"), pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())], ["row", "ids", "n_tokens"])

    return shaped.mapInArrow(run, f"row {shaped.schema['row'].dataType.simpleString()}, ids binary, n_tokens long")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`encoded`(ids, ...) with a column `decoded`: the tokens with one space between them, added tokens included.

    Such vocabularies name no decoder, so end marks and the byte alphabet stay as they are. Ids without a token say nothing;
    null ids count as none.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in W.pieces(batches, "ids"):
            texts = []
            for ids in batch.column("ids").to_pylist():
                known = np.frombuffer(ids or b"", "<u4")
                texts.append(" ".join([t for t in map(tokens.__getitem__, known[known < len(tokens)].tolist()) if t is not None]))
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")
