"""Guards, unions, re-ranking of ranked lists (T1-T6, U1, U2, U4, V13-V17, PF4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def ranked(df: DataFrame, *order, by: str = "query_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def first_of(df: DataFrame, key: str, *order, by: str = "query_id") -> DataFrame:
    """First row of each (query, key) in order: first-wins deduplication."""
    w = Window.partitionBy(by, key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def capped(df: DataFrame, group: str, cap: int, *order, by: str = "query_id") -> DataFrame:
    """At most cap rows of a group, counted among the rows that are left."""
    w = Window.partitionBy(by, group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def guarded(df: DataFrame, n: int, *, key: str | None = None, group: str | None = None, cap: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """Excluded ids go, then duplicates of a key, then rows over the cap; the n best stay."""
    order = (F.desc("score"), "id")
    if exclude is not None:
        df = df.join(exclude, ["query_id", "id"], "left_anti")
    if key:
        df = first_of(df, key, *order)
    if group and cap:
        df = capped(df, group, cap, *order)
    return ranked(df, *order).where(F.col("rank") <= n)


def staged_union(parts: list[DataFrame], n: int, also: str | None = None) -> DataFrame:
    """Lists one after the other, first occurrence of an id wins; with `also`, later
    stages lose rows whose group an earlier row has."""
    rows = None
    for stage, p in enumerate(parts):
        p = p.select("query_id", "id", "label", F.lit(stage).cast("long").alias("stage"), F.col("rank").alias("pos"))
        rows = p if rows is None else rows.unionByName(p)
    rows = first_of(rows, "id", "stage", "pos")
    if also:
        w = Window.partitionBy("query_id", also).orderBy("stage", "pos")
        rows = rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | (F.col("stage") == 0)).drop("_n")
    return ranked(rows, "stage", "pos").where(F.col("rank") <= n)


def head_resort(df: DataFrame, score: str, head: int = 20) -> DataFrame:
    """The first `head` rows by another score, the tail frozen."""
    return _resorted(df, score, F.col("rank") <= head)


def _resorted(df: DataFrame, score: str, inside) -> DataFrame:
    order = [F.when(inside, 0).otherwise(1), F.desc(F.when(inside, F.col(score))), F.col("rank")]
    return df.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def centroids(library: DataFrame, min_rows: int = 1) -> DataFrame:
    """(label, v, n) unit mean vectors of labels with enough rows."""
    many = library.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    means = V.mean_vector("v", "label")(library.select("label", "v"))
    return many.join(means, "label").withColumn("v", V.unit(F.col("v"), 0.0))


def mmr(pool: DataFrame, vectors: DataFrame, n: int, diversity: float = 0.15) -> DataFrame:
    """Greedy maximal marginal relevance inside each query's bounded pool."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        x = np.array(pdf["v"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        rel = pdf["score"].to_numpy()
        rel = (rel - rel.min()) / (rel.max() - rel.min() + 1e-9)
        chosen, near = [], np.full(len(pdf), -np.inf)
        left = np.ones(len(pdf), bool)
        while len(chosen) < min(n, len(pdf)):
            gain = (1 - diversity) * rel - diversity * np.where(np.isfinite(near), near, 0)
            gain[~left] = -np.inf
            i = int(gain.argmax())
            chosen.append(i)
            left[i] = False
            near = np.maximum(near, x @ x[i])
        out = pdf.iloc[chosen][["query_id", "id", "score"]].copy()
        out["rank"] = np.arange(1, len(chosen) + 1)
        return out

    rows = pool.select("query_id", "id", "score").join(vectors.select("id", "v"), "id")
    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, id long, score double, rank long")


def genre_similarity(pool: DataFrame, vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Pool with `genre`: cosine of centre to centre, where a row without one stands for itself; 0 without either.

    pool (query_id, query_label, id, label, ...), vectors (id, v), centres (label, v).  Centres and vectors
    are joined to the bounded pool, not to the library.
    """
    c = centres.select("label", F.col("v").alias("_c"))
    rows = pool.join(c, "label", "left").join(vectors.select("id", F.col("v").alias("_v")), "id", "left")
    rows = rows.join(c.select(F.col("label").alias("query_label"), F.col("_c").alias("_qc")), "query_label", "left")
    rows = rows.join(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("_qv")), "query_id", "left")
    a, b = F.coalesce("_c", "_v"), F.coalesce("_qc", "_qv")
    return rows.withColumn("genre", F.coalesce(V.cosine(a, b), F.lit(0.0))).drop("_c", "_v", "_qc", "_qv")


def blended(score, other, gamma: float, by: str = "query_id"):
    """Both brought to 0..1 inside a query and mixed."""
    return (1 - gamma) * V.minmax(score, by) + gamma * other


def sonic_tail(pool: DataFrame, vectors: DataFrame, centres: DataFrame, n: int, *, gamma: float = 0.25, diversity: float = 0.15, head: int = 20) -> DataFrame:
    """MMR over a pool that has one row per label, then the head by the blend with the genre, tail frozen.

    pool (query_id, query_label, id, label, score, rank), already cut to its cap; -> query_id, id, score, rank.
    """
    chosen = mmr(pool, vectors, n, diversity).withColumnRenamed("rank", "old")
    genre = genre_similarity(pool, vectors, centres)
    blend = F.round(blended(F.col("score"), V.minmax(F.col("genre"), "query_id"), gamma), 6)
    rows = chosen.join(genre.withColumn("blend", blend).select("query_id", "id", "blend"), ["query_id", "id"]).withColumnRenamed("old", "rank")
    return _resorted(rows, "blend", F.col("rank") <= head).select("query_id", "id", "score", F.col("new_rank").alias("rank"))


def related_blend(pool: DataFrame, related: DataFrame, gamma: float = 0.2) -> DataFrame:
    """Pool with `blend`: (1 - gamma) * score in 0..1 + gamma if the row's label is related; queries without relations keep the first part.

    related (query_label, label).
    """
    known = related.select("query_label").distinct().withColumn("_some", F.lit(True))
    rows = pool.join(related.select("query_label", "label", F.lit(1.0).alias("_rel")), ["query_label", "label"], "left").join(known, "query_label", "left")
    base = V.minmax(F.col("score"), "query_id")
    return rows.withColumn("blend", F.when(F.col("_some").isNull(), base).otherwise((1 - gamma) * base + gamma * F.coalesce("_rel", F.lit(0.0)))).drop("_rel", "_some")


def keyed_union(parts: list[DataFrame], key: str) -> DataFrame:
    """U4: tables one after the other, the first row of each key."""
    rows = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k)).withColumn("_at", F.monotonically_increasing_id())
        rows = p if rows is None else rows.unionByName(p)
    return first_of(rows.withColumn("_all", F.lit(0)), key, "_part", "_at", by="_all").drop("_part", "_at", "_all") if rows is not None else rows
