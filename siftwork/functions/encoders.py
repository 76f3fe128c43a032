"""Encoders: the seam where a model turns text or image bytes into vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 128


class Encoder(Protocol):
    """Batches in, one unit vector per row out."""

    def encode_texts(self, texts: list[str]) -> np.ndarray: ...

    def encode_images(self, images: list[bytes]) -> np.ndarray: ...


class HashingEncoder:
    """Signed feature hashing of words or of byte runs; deterministic, no model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _vector(self, parts: list[bytes]) -> np.ndarray:
        v = np.zeros(self.dim)
        for p in parts:
            h = zlib.crc32(p)
            v[h % self.dim] += 1.0 if (h >> 16) & 1 else -1.0
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32)

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        return np.stack([self._vector([w.encode() for w in t.split()]) for t in texts])

    def encode_images(self, images: list[bytes]) -> np.ndarray:
        return np.stack([self._vector([i[k:k + 16] for k in range(0, len(i), 16)]) for i in images])


def encode_column(make: Callable[[], Encoder], column: Column, kind: str = "texts") -> Column:
    """Vectors of a column.  ``make`` runs once per Python worker, so a model
    is loaded there and not per batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = getattr(make(), f"encode_{kind}")
        for series in batches:
            values = series.tolist()
            out = [v for lo in range(0, len(values), BATCH)
                   for v in encode(values[lo:lo + BATCH])]
            yield pd.Series(out, index=series.index, dtype=object)

    return run(column)


def encode_table(make: Callable[[], Encoder], df: DataFrame, text: Column,
                 id_col: str = "id") -> DataFrame:
    """``id, embedding`` of the distinct rows of a table."""
    return df.select(F.col(id_col).alias("id"), encode_column(make, text).alias("embedding"))
