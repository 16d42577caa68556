"""Vectors of texts. Any model fits behind ``embed``; the one here hashes tokens and needs no download.

A model is a function from a list of texts to a matrix. It is made once in each task, gets batches of bounded size, and
its result is checked for shape and finite values.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS, BATCH = 384, 64
Model = Callable[[list[str]], np.ndarray]
_words = regex.compile(r"[\p{L}\p{N}]+")


def hashing_model(dimensions: int = DIMENSIONS) -> Model:
    """Signed counts of hashed tokens and their first five letters, at unit length; a text without tokens is the zero vector."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, text in enumerate(texts):
            for word in _words.findall(text.lower()):
                for part, weight in ((word, 1.0), (word[:5] + "*", 0.5)):
                    h = zlib.crc32(part.encode())
                    out[i, (h >> 1) % dimensions] += weight if h & 1 else -weight
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return run


def checked(vectors: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    if vectors.shape != (n, dimensions) or not np.isfinite(vectors).all():
        raise ValueError(f"the model gave {vectors.shape} or values that are not finite, not ({n}, {dimensions})")
    return vectors


def embed(rows: DataFrame, key: str, text: str, make: Callable[[int], Model] = hashing_model, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector) of each row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make(dimensions)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                vectors = checked(model([t or "" for t in part.column(1).to_pylist()]), part.num_rows, dimensions)
                values = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dimensions), pa.array(vectors.astype(np.float32).ravel()))
                yield pa.record_batch([part.column(0), values], [key, "vector"])

    return rows.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} long, vector array<float>")
