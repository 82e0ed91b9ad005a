"""Standardisation, whitening, column statistics (V1, V3, V6, V7, A1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import matrix


def standardized(df: DataFrame, features: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """V1, PF1: (x - mean) / population deviation (1 where constant), times the root of the weight; as column v."""
    stats = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    w = weights or {}
    scaled = [(F.col(f) - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}")) * float(np.sqrt(max(w.get(f, 1.0), 0))) for f in features]
    return df.join(F.broadcast(stats)).withColumn("v", F.array(*scaled)).drop(*stats.columns)  # one row of statistics


def feature_stats(df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """A1: least, mean, largest, sample deviation and the first row of the largest value, per feature."""
    flat = df.unpivot([id_col], features, "feature", "x")
    return flat.groupBy("feature").agg(
        F.min("x").alias("low"), F.avg("x").alias("mean"), F.max("x").alias("high"), F.stddev_samp("x").alias("dev"),
        F.max_by(id_col, F.struct("x", -F.col(id_col))).alias("top_id"),
    )


def covariance(library: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, sample covariance, rows): per-task sums of vectors and outer products, summed by Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        flat = np.concatenate(([n], s, ss.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "x"])

    rows = library.select("v").mapInArrow(sums, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()  # 1 + d + d * d numbers
    flat = np.array([r.x for r in rows])
    n = int(flat[0])
    mean = flat[1 : d + 1] / max(n, 1)
    return mean, (flat[d + 1 :].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1), n


def whitener(cov: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """V6: E diag(1 / sqrt(max(eigenvalue, least))) E'."""
    values, vectors = np.linalg.eigh(cov)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, least))) @ vectors.T


def whitened(library: DataFrame, d: int, fit: DataFrame | None = None) -> DataFrame:
    """V7: centred, whitened, unit vectors in column v; fitted on all rows, or on those of fit."""
    mean, cov, _ = covariance(library if fit is None else fit, d)
    shared = library.sparkSession.sparkContext.broadcast((mean, whitener(cov)))
    at = library.columns.index("v")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = shared.value
        for b in batches:
            x = (matrix(b.column(at)) - m) @ w if b.num_rows else np.zeros((0, d))
            x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
            v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, d, dtype=np.int32) if len(x) else np.zeros(1, np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], v, *b.columns[at + 1 :]], b.schema.names)

    return library.mapInArrow(apply, library.schema)


def projected(library: DataFrame, d: int, k: int = 2) -> DataFrame:
    """(id, c0, c1, ...): the rows on their first k principal components; of each the largest weight is positive."""
    mean, cov, _ = covariance(library, d)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    shared = library.sparkSession.sparkContext.broadcast((mean, axes))
    names = ["id", *(f"c{i}" for i in range(k))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, a = shared.value
        for b in batches:
            x = (matrix(b.column(1)) - m) @ a if b.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, i]) for i in range(k))], names)

    return library.select("id", "v").mapInArrow(apply, ", ".join(["id long", *(f"{n} double" for n in names[1:])]))
