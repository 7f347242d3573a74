"""Vector functions over ARRAY<FLOAT|DOUBLE> columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a scaled to length 1; a vector of length under 1e-9 is divided by 1e-9."""
    n = F.greatest(norm(a), F.lit(1e-9))
    return F.transform(doubles(a), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def labelled(label: str) -> Column:
    """Whether a cluster label, of any type, is neither null nor noise (-1)."""
    return F.coalesce(F.col(label).cast("string") != "-1", F.lit(False))


def mean_vector(df: DataFrame, by: list[str], vector: str, dims: int, weight: str | None = None, name: str = "centroid") -> DataFrame:
    """by..., n, <name>: the (weighted) mean vector of each group, place by place; one aggregate with map-side combine.

    Null vectors are left out; a group whose weights sum to 0 has a null vector.
    """
    rows = df.filter(F.col(vector).isNotNull())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = [F.sum(F.col(vector)[i].cast("double") * w).alias(f"_s{i}") for i in range(dims)]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("_w"), *sums)
    return out.select(*by, "n", F.when(F.col("_w") != 0, F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(dims)])).alias(name))
