"""Mixing sources to target weights by entropy balancing.

Each document d of source s gets a rate r(d) between 0 and `most` that is closest to 1 in (bounded)
relative entropy under the token constraints sum(size * r) = target(s).  With the documents' weights
size / ln(1 + size) in the entropy, the dual
    sum_d weight(d) * most * ln(1 + exp(lambda_s * ln(1 + size(d))) / (most - 1)) - sum_s lambda_s * target(s)
is convex, and its rates are exponential tilts of the documents' lengths, bounded by `most`:
    r(d) = most / (1 + (most - 1) * exp(-lambda_s * ln(1 + size(d)))).
Newton steps, held inside a bracket, solve for lambda; their gradient and Hessian are distributed
sums over a table of (source, size, number of documents).

Rates are rounded into whole copies so that a source's taken words follow its target.  Documents of
more than a GIANT-th of their source's words are few by definition (at most GIANT): they are rounded
first, one after the other, each up or down so that the running sum stays next to the running target.
What they leave over or take too much is shared by the other documents, whose rates are scaled.  These
are dealt into chunks and rounded likewise, the largest first.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
a source without words gets target 0; documents of size 0 have rate 0; repeated rows count each, and
the copies of rows of equal id and size may change places; an empty table gives an empty result.
Copies never exceed `most`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import shuffle_parts, table, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Documents of a source that are rounded together, about; a source of more has several chunks.
CHUNK = 2_000
#: A document with more than this share of its source's words is rounded before all others.
GIANT = 1_000
#: lambda is looked for between these bounds.
BRACKET = 64.0


def word_counts(texts: pa.Array) -> np.ndarray:
    """Runs of bytes that are no white space, per text."""
    data, offsets = B.buffers(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in B.slices(offsets):
        _, _, at = B.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], B.NOT_SPACE)
        out[i:j] = np.diff(at)
    return out


def sized(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns and `size`, the number of words of the whole text."""
    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("size", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(word_counts(b.column(b.num_columns - 1)), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "size"])

    return rows.mapInArrow(count, schema)


def _ranked(totals: DataFrame) -> DataFrame:
    """totals with `place`, the sources' number in the order of their names, null last; no task sees all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    sorted_ = totals.repartitionByRange(shuffle_parts(totals.sparkSession), *order).sortWithinPartitions(*order)
    rows = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "sources")
    rows = rows.withColumn("_p", F.shiftright("_at", 33))
    first, n = [], 0
    for p, many in sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect()):  # a row per partition
        first.append((p, n))
        n += many
    starts = F.broadcast(totals.sparkSession.createDataFrame(first, "_p long, _first long"))  # a row per partition
    return rows.join(starts, "_p").withColumn("place", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_first")


def targets(totals: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target): shares by weight, filled up like water to `most` times a size.

    The level is found by rounds over the table of sources: sources that are full at the level give
    their rest to the others, which raises it, until no other one is full.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = written(_ranked(totals).withColumn("weight", weight).withColumn("room", F.col("source_size") * float(most)).drop("place"), "weights")
    level, before = 0.0, -1
    while True:
        full = F.col("room") <= F.col("weight") * level
        r = t.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("room"))), F.lit(0.0)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if r.n == before or r.open is None:
            break
        before, level = r.n, (float(r.total) - r.held) / r.open
    target = F.when(F.lit(r.open is None) | (F.col("room") <= F.col("weight") * level), F.col("room")).otherwise(F.col("weight") * level)
    return t.select("source", "source_size", "n_docs", target.alias("target"))


def rate_of(lam: F.Column, size: F.Column, most: float) -> F.Column:
    return most / (1 + (most - 1) * F.exp(-lam * F.log1p(size.cast("double"))))


def balance(cells: DataFrame, wanted: DataFrame, most: float = MOST_COPIES, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """wanted (source, source_size, n_docs, target) with `lam`; cells: (source, size, n).

    lam is null where the target is `most` times the size (every rate is `most`) or there is nothing to take.
    """
    some = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most) * (1 - 1e-12))
    state = wanted.withColumn("lam", F.when(some, F.lit(0.0))).withColumn("low", F.lit(-BRACKET)).withColumn("high", F.lit(BRACKET))
    state = written(state, "balance")
    gap = state.where(F.col("lam").isNotNull()).isEmpty()
    for _ in range(0 if gap else rounds):
        r, x = rate_of(F.col("lam"), F.col("size"), most), F.log1p(F.col("size").cast("double"))
        moments = cells.join(state.where(F.col("lam").isNotNull()).select(F.col("source").alias("_s"), "lam"), F.col("source").eqNullSafe(F.col("_s")))
        moments = moments.groupBy(F.col("_s").alias("source")).agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * x * r * (most - r) / most).alias("slope"))
        found = state.join(moments.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        over = F.col("got") > F.col("target")
        found = found.withColumn("high", F.when(over, F.col("lam")).otherwise(F.col("high"))).withColumn("low", F.when(over, F.col("low")).otherwise(F.coalesce("lam", "low")))
        newton = F.col("lam") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        found = found.withColumn("off", F.abs(F.try_divide(F.col("got"), F.col("target")) - 1)).withColumn("lam", F.when(F.col("off") <= tolerance, F.col("lam")).otherwise(F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)))
        state = written(found.select(*state.columns, "off"), "balance")
        worst = state.agg(F.max("off")).first()[0]  # all that the driver sees
        state = state.drop("off")
        if worst is None or worst <= tolerance:
            break
    return state.drop("low", "high")


def follow(size: np.ndarray, rate: np.ndarray, order: np.ndarray, most: int, lead: float = 0.0) -> np.ndarray:
    """Whole copies, floor or ceiling of the rate, taken in order so that the running sum follows that of size * rate, less `lead`."""
    down, up = np.floor(rate + 1e-9).astype(np.int64), np.minimum(np.ceil(rate - 1e-9), most).astype(np.int64)
    out = np.zeros(len(size), np.int64)
    for i in order.tolist():
        low, high = lead + size[i] * (down[i] - rate[i]), lead + size[i] * (up[i] - rate[i])
        out[i], lead = (up[i], high) if abs(high) < abs(low) else (down[i], low)
    return out


def _evened(size: np.ndarray, copies: np.ndarray, target: float, order: np.ndarray, most: int) -> np.ndarray:
    """copies, changed by whole documents while that brings the sum nearer to the target."""
    lead = float((size * copies).sum()) - target
    for i in order.tolist():
        n = size[i]
        while n and copies[i] < most and abs(lead + n) < abs(lead):
            copies[i], lead = copies[i] + 1, lead + n
        while n and copies[i] > 0 and abs(lead - n) < abs(lead):
            copies[i], lead = copies[i] - 1, lead - n
    return copies


def _order(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.assign(_n=-pdf["size"]).reset_index(drop=True).sort_values(["_n", "doc_id"], kind="stable", na_position="last").index.to_numpy()


def mixed(rows: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """rows (doc_id, source, size, ...), a stored table, with source_size, target, rate and copies."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    cells = written(rows.where(F.col("size") > 0).groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    solved = balance(cells, targets(totals, weights, most), most).withColumnRenamed("source", "_s")
    # rounded, since sums of another order differ in the last digits: reruns agree
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("lam").isNotNull(), F.round(rate_of(F.col("lam"), F.col("size"), most), 9)).when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    chunk = F.pmod(F.xxhash64("doc_id", "size"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / CHUNK)))
    giant = F.col("size") * GIANT > F.col("source_size")
    named = rows.join(solved, F.col("source").eqNullSafe(F.col("_s"))).select(*rows.columns, "source_size", "target", rate.alias("rate"), F.when(giant, F.lit(-1)).otherwise(chunk).alias("_chunk"))
    schema = named.drop("_chunk").schema.add("copies", "long")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        order, n, due = _order(pdf), pdf["size"].to_numpy(), pdf["rate"].to_numpy()
        copies = _evened(n, follow(n, due, order, most), float((n * due).sum()), order, most)
        return pdf.drop(columns="_chunk").assign(copies=copies)

    giants = written(named.where(F.col("_chunk") == -1).groupBy("source").applyInPandas(first, schema), "giants")
    # what the giants took, and what is left for the others: copies of the giants that the others cannot make up for change
    size, r = F.col("size").cast("double"), F.col("rate")
    got = giants.groupBy(F.col("source").alias("_g")).agg(F.sum(size * F.col("copies")).alias("taken"))
    small = named.where(F.col("_chunk") >= 0)
    rest = small.groupBy(F.col("source").alias("_r")).agg(F.sum(size * r).alias("due"), F.sum(size * (most - r)).alias("more"))
    shift = totals.select("source").join(solved.select("_s", "target"), F.col("source").eqNullSafe(F.col("_s"))).join(got, F.col("source").eqNullSafe(F.col("_g")), "left").join(rest, F.col("source").eqNullSafe(F.col("_r")), "left")
    need = F.col("target") - F.coalesce("taken", F.lit(0.0)) - F.col("due")  # words the others take besides their due
    # below: all rates times (1 + part); above: all rates go the same part of their way to `most`
    part = F.when(need <= 0, F.try_divide(need, F.col("due"))).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(need, F.col("more")), F.lit(0.0))))
    shift = shift.select("_s", F.round(F.greatest(F.lit(-1.0), F.coalesce(part, F.lit(0.0))), 9).alias("part"))
    even = small.join(shift, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    even = even.withColumn("_due", F.when(F.col("part") < 0, r * (1 + F.col("part"))).otherwise(r + (most - r) * F.col("part"))).drop("part")

    def chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        order, n, due = _order(pdf), pdf["size"].to_numpy(), pdf["_due"].to_numpy()
        # chunks end up to half a document off; each aims at another place in that span, so that their errors don't add up
        aim = (float(pdf["_chunk"].iloc[0]) * 0.6180339887498949 % 1 - 0.5) * float(n[n > 0].min(initial=n.max(initial=0)))
        copies = _evened(n, follow(n, due, order, most, -aim), float((n * due).sum()) + aim, order, most)
        return pdf.drop(columns=["_chunk", "_due"]).assign(copies=copies)

    return giants.unionByName(even.groupBy("source", "_chunk").applyInPandas(chunks, schema))


def mix_copies(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, most: int = MOST_COPIES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, *carry, size, source_size, target, rate, copies) per document; carry: other names than these."""
    keep = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *[F.col(c) for c in carry]]
    return mixed(written(sized(docs.select(*keep, F.col(text_col).alias("_t")), ["doc_id", "source", *carry], "_t"), "sizes"), weights, most)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
