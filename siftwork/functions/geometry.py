"""Region geometry: validity tests and detector clean-up, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slack on the right and lower edge, smallest query region,
# polygon size, boxes kept per sample.
EDGE_SLACK = 1.0001
MIN_REGION = 0.02
POLYGON_POINTS = (3, 100)
MAX_BOXES = 12


def _in_unit(v: Column) -> Column:
    return F.coalesce(v.between(0.0, 1.0) & ~F.isnan(v), F.lit(False))


def valid_rect(g: Column) -> Column:
    inside = None
    for name in ("x", "y", "w", "h"):
        inside = _in_unit(g[name]) if inside is None else inside & _in_unit(g[name])
    return (inside & g["points"].isNull() & (g["w"] > 0) & (g["h"] > 0)
            & (g["x"] + g["w"] <= EDGE_SLACK) & (g["y"] + g["h"] <= EDGE_SLACK))


def valid_polygon(g: Column) -> Column:
    low, high = POLYGON_POINTS
    no_rect = g["x"].isNull() & g["y"].isNull() & g["w"].isNull() & g["h"].isNull()
    point = lambda p: (F.size(p) == 2) & F.forall(p, _in_unit)
    return no_rect & F.coalesce(
        F.size(g["points"]).between(low, high) & F.forall(g["points"], point), F.lit(False))


def valid_geometry(kind: Column, g: Column) -> Column:
    return F.when(kind == "rect", valid_rect(g)).when(kind == "polygon", valid_polygon(g)).otherwise(
        F.lit(False))


def valid_query_region(g: Column) -> Column:
    """A region large enough to embed."""
    return valid_rect(g) & (g["w"] >= MIN_REGION) & (g["h"] >= MIN_REGION)


def split_valid(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid annotations and the quarantined rest."""
    ok = F.coalesce(valid_geometry(F.col("kind"), F.col("geometry")), F.lit(False))
    return annotations.where(ok), annotations.where(~ok)


def clean_detections(detections: DataFrame, keep: int = MAX_BOXES) -> DataFrame:
    """Detector boxes ``(sample_id, x0, y0, x1, y1, label, score, width,
    height)`` clipped, normalized, the best ``keep`` per sample."""
    def finite(c: str) -> Column:
        v = F.col(c)
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    ok = finite("x0") & finite("y0") & finite("x1") & finite("y1") & finite("score")

    def clip(c: str, edge: str) -> Column:
        return F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(edge).cast("double"))

    clipped = detections.where(ok).select(
        "sample_id", "label", "score", "width", "height",
        clip("x0", "width").alias("a"), clip("y0", "height").alias("b"),
        clip("x1", "width").alias("c"), clip("y1", "height").alias("d"))
    boxes = clipped.where((F.col("c") > F.col("a")) & (F.col("d") > F.col("b"))).select(
        "sample_id", (F.col("a") / F.col("width")).alias("x"),
        (F.col("b") / F.col("height")).alias("y"),
        ((F.col("c") - F.col("a")) / F.col("width")).alias("w"),
        ((F.col("d") - F.col("b")) / F.col("height")).alias("h"),
        "label", F.bround("score", 3).alias("score"))
    order = Window.partitionBy("sample_id").orderBy(F.col("score").desc(), "label", "x", "y", "w", "h")
    return boxes.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= keep)
