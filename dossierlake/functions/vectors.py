"""Vector expressions and batch scoring."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import text as tx

HASH_DIM = 64


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Plain cosine; 0 when either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


# Word places already worked out by this worker.
_SLOTS: dict[tuple[str, int], tuple[int, int]] = {}
_SLOTS_MAX = 1 << 18


def hashed_vectors(texts: list[str], dim: int = HASH_DIM) -> list[list[float]]:
    """Deterministic stand-in for an embedding model: signed hashed word counts."""
    if len(_SLOTS) > _SLOTS_MAX:
        _SLOTS.clear()
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in enumerate(texts):
        sums = [0] * dim
        for term, n in Counter(text.lower().split()).items():
            place = _SLOTS.get((term, dim))
            if place is None:
                h = int.from_bytes(hashlib.md5(term.encode("utf-8")).digest()[:4], "big")
                place = _SLOTS[term, dim] = (h % dim, 1 if (h // dim) % 2 == 0 else -1)
            sums[place[0]] += place[1] * n
        out[row] = sums
    return list(out)


def embed(col: Column, model: Callable[[list[str]], list] = hashed_vectors, batch: int = 256) -> Column:
    """Text to vector with an injected batch model; a failing model fails the job.

    `model` may be a callable object that loads its weights on first use: it lives as
    long as the Python worker does.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            texts = series.fillna("").tolist()
            vectors: list = []
            for i in range(0, len(texts), batch):
                vectors.extend(model(texts[i:i + batch]))
            yield pd.Series(vectors)

    return run(col)


def unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
