"""Splits, batches, quotas and samples by arithmetic order (A30, A31, T11, T12, TR3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_split(df: DataFrame, stratum: str, id_col: str, share: float, key=None) -> DataFrame:
    """The first `share` of each stratum in key order is `train`; rows without a stratum are train."""
    w = Window.partitionBy(stratum)
    k = F.row_number().over(w.orderBy(key if key is not None else F.xxhash64(id_col), id_col))
    n = F.count("*").over(w)
    return df.withColumn("split", F.when(F.col(stratum).isNull() | (k <= F.floor(n * share)), "train").otherwise("test"))


def pk_batches(df: DataFrame, group: str, id_col: str, p: int, k: int) -> DataFrame:
    """Batches of p groups with k rows each, in order; short groups repeat their rows."""
    from ..sources.ingest import numbered

    sizes = numbered(df.groupBy(group).agg(F.count("*").alias("n")), group, "_k").withColumn("batch", F.expr(f"_k div {p}")).drop("_k")
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(id_col)) - 1)
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_i", (F.col("slot") % F.col("n")).cast("int"))
    return slots.join(rows.select(group, "_i", id_col), [group, "_i"]).select("batch", group, F.col("slot").cast("long").alias("slot"), id_col)


def quota(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    """TR3: the first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def batched(df: DataFrame, size: int, key: str) -> DataFrame:
    """Batch numbers of a fixed size in the order of a unique key; rows are numbered in sorted parts."""
    from ..sources.ingest import numbered

    return numbered(df, key, "_k").withColumn("batch", F.expr(f"_k div {size}")).drop("_k")


def sampled(df: DataFrame, group: str, n: int, id_col: str, seed: int) -> DataFrame:
    """The first n rows of each group in the order of a seeded hash."""
    return quota(df, group, n, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)
