"""Vector expressions and a deterministic text embedder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity in double precision; null if either vector is null or zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def embed(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed hashing of words and their letter triples into unit vectors, whole texts of any length; a blank text is the zero vector."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            padded = f"^{word}$"
            for gram in [word, *(padded[k : k + 3] for k in range(len(padded) - 2))]:
                h = zlib.crc32(gram.encode())
                out[i, h % dimensions] += 1.0 if h >> 31 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size == 0, 1, size)


def embed_column(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, embedding): Arrow-batched embedding of a text column."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = embed(b.column(1).to_pylist(), dimensions)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dimensions), pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["key", "embedding"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)
