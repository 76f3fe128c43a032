"""The 2-D map and its clusters, with MLlib."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Most clusters, rows wanted per cluster, seed.
MAX_CLUSTERS = 12
ROWS_PER_CLUSTER = 10
SEED = 42


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))


def project_2d(vectors: DataFrame) -> DataFrame:
    """``id, x, y``: two principal components scaled to [0, 1] per axis."""
    rows = _features(vectors)
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    flat = model.transform(rows).select("id", vector_to_array("p").alias("p")).select(
        "id", F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))
    edges = flat.agg(F.struct(
        F.min("px").alias("x0"), F.max("px").alias("x1"),
        F.min("py").alias("y0"), F.max("py").alias("y1")).alias("e"))
    out = flat.withColumn("_e", edges.scalar())

    def unit_range(value, lo, hi):
        span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        return (value - lo) / span

    e = F.col("_e")
    return out.select("id", unit_range(F.col("px"), e["x0"], e["x1"]).alias("x"),
                      unit_range(F.col("py"), e["y0"], e["y1"]).alias("y"))


def cluster(vectors: DataFrame, most: int = MAX_CLUSTERS) -> DataFrame:
    """``id, cluster``: k-means with k grown to the corpus, fixed seed."""
    n = vectors.count()
    k = max(2, min(most, n // ROWS_PER_CLUSTER or 2))
    rows = _features(vectors)
    model = KMeans(k=k, seed=SEED, featuresCol="v", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("id", "cluster")
