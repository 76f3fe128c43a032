"""Image measures over ``spark.read.format("image")`` rows, as Arrow UDFs.

The source decodes to height, width, channels and BGR bytes; the UDFs only do
array arithmetic on one row at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Luma weights in B, G, R order, and the hash grid.
LUMA_BGR = (0.114, 0.587, 0.299)
HASH_SIDE = 8

_MEASURES = T.StructType([T.StructField("blur", T.DoubleType()), T.StructField("luma", T.DoubleType()),
                          T.StructField("dhash", T.LongType())])
_MASK_FACTS = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h", "area_fraction")]
    + [T.StructField("pixels", T.LongType())])


def grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Grey levels 0..255, None for bytes that are not the stated size."""
    flat = np.frombuffer(data, dtype=np.uint8)
    if channels not in (1, 3, 4) or flat.size != height * width * channels:
        return None
    pixels = flat.reshape(height, width, channels).astype(np.float64)
    return pixels[:, :, 0] if channels == 1 else pixels[:, :, :3] @ np.array(LUMA_BGR)


def focus_and_luma(g: np.ndarray) -> tuple[float, float] | None:
    """Variance of the 4-neighbour Laplacian and mean level, on 0..1."""
    if min(g.shape) < 3:
        return None
    g = g / 255.0
    core = g[1:-1, 1:-1]
    around = sum(np.roll(g, step, axis)[1:-1, 1:-1] for step in (1, -1) for axis in (0, 1))
    return float(np.var(around - 4.0 * core)), float(g.mean())


def _area_weights(n: int, cells: int) -> np.ndarray:
    """Share of each of ``n`` pixels in each of ``cells`` equal stretches."""
    edges = np.linspace(0, n, cells + 1)
    left = np.arange(n)[None, :]
    overlap = np.minimum(left + 1, edges[1:, None]) - np.maximum(left, edges[:-1, None])
    return np.clip(overlap, 0, None) * (cells / n)


def difference_hash(g: np.ndarray, side: int = HASH_SIDE) -> int:
    """64 bits: is a cell brighter than its left neighbour, on area means."""
    rows, cols = _area_weights(g.shape[0], side), _area_weights(g.shape[1], side + 1)
    cells = np.rint(rows @ g @ cols.T)
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    return int(np.packbits(bits).view(">u8")[0].astype(np.int64))


@F.pandas_udf(_MEASURES)
def _measure(height: pd.Series, width: pd.Series, channels: pd.Series,
             data: pd.Series) -> pd.DataFrame:
    rows = []
    for h, w, c, d in zip(height, width, channels, data):
        g = grey(h, w, c, d)
        both = focus_and_luma(g) if g is not None else None
        rows.append((*(both or (None, None)), difference_hash(g) if g is not None else None))
    out = pd.DataFrame(rows, columns=["blur", "luma", "dhash"])
    return out.astype({"dhash": "Int64"})


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files by name; a file that does not decode is skipped."""
    files = spark.read.format("image").option("dropInvalid", True).load(folder)
    name = F.element_at(F.split("image.origin", "/"), -1)
    return files.select(name.alias("filename"), "image")


def image_measures(images: DataFrame) -> DataFrame:
    """``filename, blur, luma, dhash``; tiny images carry a hash only."""
    i = F.col("image")
    m = _measure(i["height"], i["width"], i["nChannels"], i["data"])
    return images.select("filename", m.alias("m")).select("filename", "m.*")


@F.pandas_udf(_MASK_FACTS)
def _mask(raster: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    rows = []
    for data, w, h in zip(raster, width, height):
        flat = np.frombuffer(data, dtype=np.uint8)
        if flat.size != w * h or not flat.any():
            rows.append((None,) * 5 + (int(np.count_nonzero(flat)),))
            continue
        on = flat.reshape(h, w) > 0
        ys, xs = np.flatnonzero(on.any(axis=1)), np.flatnonzero(on.any(axis=0))
        rows.append((xs[0] / w, ys[0] / h, (xs[-1] + 1 - xs[0]) / w, (ys[-1] + 1 - ys[0]) / h,
                     float(on.mean()), int(on.sum())))
    return pd.DataFrame(rows, columns=["x", "y", "w", "h", "area_fraction", "pixels"])


def mask_statistics(masks: DataFrame) -> DataFrame:
    """Box and area of each raster (``annotation_id, raster, width, height``,
    one byte a pixel).  Empty masks and wrong dimensions are rejected."""
    m = masks.select("annotation_id", _mask("raster", "width", "height").alias("m"))
    return m.where(F.col("m.x").isNotNull()).select(
        "annotation_id", *[F.bround(F.col(f"m.{c}"), 6).alias(c) for c in "xywh"],
        F.col("m.area_fraction").alias("area_fraction"))
