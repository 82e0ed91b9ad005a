"""Functions for SQL, and plug-in seams (UD1, UD2, UD5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text


@F.udtf(returnType="ord int, title string, artist string")
class SplitSeeds:
    """split_seeds(text): the seeds of a text, as ingest.seeds reads them."""

    def eval(self, said: str):
        import re

        from ..sources.ingest import SEPARATORS

        parts = [p.strip() for p in re.split("[;\n\r]", said or "")]
        for k, p in enumerate(p for p in parts if p and not p.startswith("#")):
            sep = next((s for s in SEPARATORS if s in p), None)
            title, artist = p.split(sep, 1) if sep else (p, None)
            yield k, title.strip(), artist.strip() if artist is not None else None


def register(spark: SparkSession) -> list[str]:
    """UD5: makes the functions known to SQL; returns their names."""

    @F.pandas_udf(T.DoubleType())
    def mean_reciprocal(rank: pd.Series) -> float:
        """Grouped aggregate: mean of 1 / rank, a rank of 0 is a miss."""
        r = rank.fillna(0).astype(float)
        return float((1 / r.where(r > 0)).fillna(0).mean()) if len(r) else 0.0

    named = {"ascii_fold": text.ascii_fold, "full_casefold": text.casefold, "title_ratio": text.ratio, "mean_reciprocal": mean_reciprocal}
    for name, f in named.items():
        spark.udf.register(name, f)
    spark.udtf.register("split_seeds", SplitSeeds)
    return [*named, "split_seeds"]


def analysed(rows: DataFrame, analyse: Callable[[pd.Series], pd.DataFrame], column: str, schema: str) -> DataFrame:
    """UD1: rows with the analyser's columns in place of `column`; it gets a batch of values and returns as many rows.

    A value that it fails on (an exception, for one value alone) gives nulls; the batch goes on.
    """
    made = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    keep = rows.drop(column)
    out = T.StructType([*keep.schema.fields, *made.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = analyse(b[column])
            except Exception:  # then value by value: a bad one spoils only itself
                parts = []
                for k in range(len(b)):
                    try:
                        parts.append(analyse(b[column].iloc[k : k + 1]))
                    except Exception:
                        parts.append(pd.DataFrame([dict.fromkeys(made.names)]))
                got = pd.concat(parts) if parts else pd.DataFrame(columns=made.names)
            yield pd.concat([b.drop(columns=column).reset_index(drop=True), got[made.names].reset_index(drop=True)], axis=1)

    return rows.select(*keep.columns, column).mapInPandas(run, out)


def encoded(rows: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]], column: str, name: str = "v") -> DataFrame:
    """UD2: rows with a vector from an encoder that every worker loads once, batch by batch."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for b in batches:
            yield encode(b)

    return rows.withColumn(name, run(column))
