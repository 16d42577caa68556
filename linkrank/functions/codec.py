"""Vectors as text: little-endian float32 in base64, as a log stores them."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


def encode_py(vector) -> str | None:
    return None if vector is None else base64.b64encode(np.asarray(vector, "<f4").tobytes()).decode()


def decode_py(text: str | None) -> list[float] | None:
    """The numbers of a text; an error if it holds no whole ones."""
    if text is None:
        return None
    raw = base64.b64decode(text, validate=True)
    if len(raw) % 4:
        raise ValueError(f"{len(raw)} bytes are no whole float32 numbers")
    return np.frombuffer(raw, "<f4").tolist()


def encode_vector(vector: Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield vectors.map(encode_py)

    return F.pandas_udf(run, StringType())(vector.cast("array<float>"))


def decode_vector(text: Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(decode_py)

    return F.pandas_udf(run, ArrayType(FloatType()))(text)


def sound(text: Column) -> Column:
    """True for a text that decodes to whole numbers."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.coalesce(F.octet_length(raw) % 4 == 0, F.lit(False))


def finite_sample(vector: Column, points: int = 32) -> Column:
    """True if every one of ``points`` evenly spaced values is finite: the first, the last and those between; all of a short vector."""
    n = F.size(vector)
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * (n - 1) / (points - 1)).cast("int"))
    places = F.when(n <= points, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(at)
    return (n == 0) | F.forall(places, lambda i: ~F.isnan(F.get(vector, i)) & (F.abs(F.get(vector, i)) < float("inf")))
