"""Vector expressions and vectorised distance kernels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two arrays, in built-in functions; for a few rows."""
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a float64 matrix; NULL vectors and other lengths become NaN rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), width)
    out = np.full((len(sizes), width), np.nan)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width:
            out[i] = v
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows become NaN, they are at no distance from anything."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


class HashingEmbedder:
    """Deterministic feature hashing of words and word pairs to unit vectors; not semantic."""

    pattern = re.compile(r"\w+")

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def vector(self, text: str | None) -> np.ndarray:
        v = np.zeros(self.width, np.float32)
        words = self.pattern.findall((text or "").lower())
        for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            v[h % self.width] += 1.0 if h & 0x80000000 else -1.0
        norm = float(np.linalg.norm(v))
        return v / norm if norm else v

    def embed(self, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The shape of an iterator UDF: any embedder with this method can be plugged in."""
        for texts in batches:
            yield pd.Series([self.vector(t) for t in texts])


def embedded(text: Column, embedder: HashingEmbedder) -> Column:
    """Embedding of a text column; the embedder is made ready once for each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from embedder.embed(batches)

    return run(text)
