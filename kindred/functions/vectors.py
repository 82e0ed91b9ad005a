"""Vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """length; the other scalar functions are Spark's own."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column, eps: float = 1e-9) -> Column:
    """V5: divided by the length + eps."""
    n = norm(a)
    return F.transform(a, lambda x: x / (n + eps))


def zscore(c: Column, *by: str) -> Column:
    """V9 over all rows of a query: population deviation + 1e-9."""
    w = Window.partitionBy(*by)
    return (c - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-9)


def minmax(c: Column, *by: str) -> Column:
    """V10."""
    w = Window.partitionBy(*by)
    return (c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-9)


def mean_vector(vec: str, *by: str):
    """(df) -> one mean vector per group, by position, summed where the rows are."""

    def run(df):
        flat = df.select(*by, F.posexplode(vec).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
        return flat.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec))

    return run
