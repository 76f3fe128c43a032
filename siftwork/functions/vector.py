"""Vector columns.  Sums run in double, whatever the stored width."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """L2-normalized; a zero vector stays zero.

    The norm is spread into an array first: inside the lambda it would be
    computed again for every element."""
    norms = F.array_repeat(norm(v), F.size(v))
    return F.zip_with(v, norms, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def dimension(df: DataFrame, vec: str = "embedding") -> int:
    """Vector length, read from one row."""
    row = df.select(F.size(vec).alias("d")).where("d > 0").first()
    return row["d"] if row else 0


def group_vector_sum(df: DataFrame, keys: list[str], vec: str = "embedding") -> DataFrame:
    """Element-wise sum and count per group: ``keys, n, total``, at any width.

    One vector aggregate, which combines on the map side: a group of any size
    costs one row per map task.  The vectors of a table have one width."""
    values = array_to_vector(F.col(vec).cast("array<double>"))
    grouped = df.where(F.col(vec).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(values).alias("total"))
    return grouped.withColumn("total", vector_to_array("total"))


def group_vector_mean(df: DataFrame, keys: list[str], vec: str = "embedding") -> DataFrame:
    sums = group_vector_sum(df, keys, vec)
    return sums.select(*keys, "n", scale(F.col("total"), F.lit(1.0) / F.col("n")).alias("mean"))


def mean_pairwise_cosine(total: Column, n: Column) -> Column:
    """Mean cosine over all pairs of unit vectors, from their sum alone."""
    return F.when(n >= 2, (dot(total, total) - n) / (n * (n - 1)))
