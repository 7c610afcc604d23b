"""Words of whole texts as 64-bit hashes, computed for a whole Arrow batch at once.

Texts are read as UTF-8 bytes. A-Z is lower-cased, word bytes are given by a mask of 256 flags, and every
word gets the value of a keyed polynomial over its bytes modulo 2**64, mixed. Two different words share a
value with a probability of about 2**-64, which is taken as equality throughout this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words are runs of bytes other than space and \x09-\x0D (non-ASCII characters consist of such bytes).
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
# Words are runs of digits, letters and non-ASCII characters; A-Z counts as it is lower-cased first.
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x41:0x5B] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = 1 << 21


class _Made(dict):
    """What a process has made for itself. It is empty wherever it is sent, so no task takes the tables of the driver along."""

    def __reduce__(self):
        return _Made, ()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = _Made()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _STEP if n <= _STEP else n
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > _STEP:  # a single word of over 2 MB
            return tables
        _powers[size] = tables
    return _powers[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


def spans(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word; words end where their text ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = mask[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | first[:-1])), np.flatnonzero(inside & (~after | first[1:])) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit values of the words at these byte spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _STEP, side="right")))
        up, down = _power_tables(int(ends[j - 1] - base))
        piece = data[base: ends[j - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUES[piece] * up[: len(piece)], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * down[a])
        i = j
    return out


def words(column: pa.Array, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the column and, for each text, where its words begin (one more entry at the end)."""
    data, offsets = utf8(column)
    starts, ends = spans(data, offsets, mask)
    return hash_words(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text; the whole sequence where it has fewer words, none without words."""
    key = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        step = np.uint64(pow(_BASE, k + 1, 2**64))
        key[: len(hashes) - k] += hashes[k:] * step
    key = mix(key)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(key[a: b - n + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = mix(short * np.uint64(_BASE) + hashes[i: i + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most_bytes` of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            past = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, past + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end
