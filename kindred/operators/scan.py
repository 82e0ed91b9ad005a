"""Scoring a library against a table of queries.

Queries are read in blocks of a fixed number of rows; a block is broadcast and every library
batch is one matrix product with it.  Statistics over the whole library (z-scores) are a first
pass whose partial sums meet per query; the second pass ranks with them.  A task keeps the k best
rows of each query over all its batches, guards included, so a query's final order has k rows per task
to sort.  The result of a block is written and its broadcast released before the next block is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

BLOCK = 2048


@dataclass(frozen=True)
class View:
    """A score of (query, row): a vector column, its slice, a kind and a weight in the blend."""

    kind: str = "cosine"  # cosine | dot | euclid (1 / (1 + distance)) | prior (a number of the row)
    start: int = 0
    stop: int | None = None
    weight: float = 1.0
    column: str = "v"


@dataclass(frozen=True)
class Guard:
    """Of rows of one key the first, then at most `cap` rows of a label.

    A key must lie inside one label (title and artist do); then guards within a task lose nothing.
    """

    key: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None  # (ids, labels) -> keys
    cap: int = 0

    def keep(self, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Places that stay of rows in order, best first."""
        at = np.arange(len(ids))
        if self.key is not None and len(at):
            at = np.sort(np.unique(self.key(ids, labels), return_index=True)[1])
        if self.cap and len(at):
            by = np.argsort(labels[at], kind="stable")
            of = labels[at][by]
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            number = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
            at = at[np.sort(by[number < self.cap])]
        return at


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scores(view: View, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """[rows, queries]"""
    if view.kind == "prior":
        return np.repeat(rows[:, :1], len(query), axis=1)
    a, b = rows[:, view.start : view.stop], query[:, view.start : view.stop]
    if view.kind == "dot":
        return a @ b.T
    if view.kind == "cosine":
        return (a @ b.T) / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :], 1e-300)
    gap = np.empty((len(a), len(b)))
    for k in range(len(b)):  # differences, not squares: no cancellation
        gap[:, k] = np.sqrt(((a - b[k]) ** 2).sum(axis=1))
    return 1 / (1 + gap)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held = []
    for r in queries.select("query_id", "label", "v").orderBy("query_id").toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield _arrays(held)
            held = []
    if held:
        yield _arrays(held)


def cluster_blocks(clusters: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, sizes, sums) of clusters (label, n, s), a block of rows at a time."""
    held = []
    for r in clusters.select("label", "n", "s").orderBy("label").toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield np.array([x.label for x in held]), np.array([x.n for x in held]), np.array([x.s for x in held], float)
            held = []
    if held:
        yield np.array([x.label for x in held]), np.array([x.n for x in held]), np.array([x.s for x in held], float)


def _arrays(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r.query_id for r in rows]), np.array([-1 if r.label is None else r.label for r in rows]), np.array([r.v for r in rows], float)


def _columns(views: list[View]) -> list[str]:
    return list(dict.fromkeys(v.column for v in views))


def _inputs(b: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    out = {}
    for name in names:
        c = b.column(b.schema.get_field_index(name))
        out[name] = matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False).astype(float)[:, None]
    return out


def top(
    library: DataFrame,
    queries: DataFrame,
    k: int,
    views: list[View] | None = None,
    *,
    standard: bool = False,
    not_self: bool = True,
    not_label: bool = False,
    digits: int = 6,
    guard: Guard | None = None,
    adjust: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """J9, V8, V9, V11, T1, T8, PF4, PF5: library (id, label, v, ...), queries (query_id, label, v) -> query_id, query_label, rank, id, label, score.

    standard: views are blended as z-scores over the whole library (also over rows that the
    exclusions drop later).  adjust(scores[rows, queries], ids, labels, query labels) changes rounded
    scores, which are rounded again.  Order: rounded score, then id.
    """
    views = views or [View()]
    names = _columns(views)
    rows = library.where(F.col("id").isNotNull()).select("id", F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"), *names)
    spark, parts = library.sparkSession, []
    schema = "query_id long, query_label long, id long, label long, score double"
    blocks = _query_blocks(queries)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(block)
        stats = _moments(rows, shared, views, names) if standard else None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, stats=stats) -> Iterator[pa.RecordBatch]:
            ids_q, label_q, q = shared.value
            none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            best = [none] * len(q)
            for b in batches:
                if not b.num_rows:
                    continue
                x, ids, label = _inputs(b, names), b.column(0).to_numpy(), b.column(1).to_numpy()
                total = np.zeros((len(ids), len(q)))
                for n, view in enumerate(views):
                    s = scores(view, x[view.column], q)
                    total += view.weight * ((s - stats[n][0]) / (stats[n][1] + 1e-9) if stats else s)
                total = np.round(total, digits) + 0.0
                if adjust is not None:
                    total = np.round(adjust(total, ids, label, label_q), digits) + 0.0
                drop = np.zeros(total.shape, bool)
                if not_self:
                    drop |= ids[:, None] == ids_q[None, :]
                if not_label:
                    drop |= label[:, None] == label_q[None, :]
                total[drop] = -np.inf
                for j in range(len(q)):
                    own = total[:, j]
                    floor = best[j][2][-1] if len(best[j][2]) == k else -np.inf
                    some = np.flatnonzero((own >= floor) & (own > -np.inf))
                    if guard is None and len(some) > k:
                        some = some[own[some] >= np.partition(own[some], len(some) - k)[len(some) - k]]
                    if len(some):
                        best[j] = _merged(best[j], (ids[some], label[some], own[some]), k, guard)
            j = np.repeat(np.arange(len(q)), [len(x[0]) for x in best])
            cat = lambda n: np.concatenate([x[n] for x in best]) if best else none[n]
            yield pa.RecordBatch.from_arrays([pa.array(ids_q[j]), pa.array(label_q[j]), *(pa.array(cat(n)) for n in range(3))], ["query_id", "query_label", "id", "label", "score"])

        found = rows.mapInArrow(run, schema)
        if after is not None or parts:  # one block at a time
            found = written(found, "scan")
            shared.unpersist()
        parts.append(found)
        block = after
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for found in parts[1:]:
        out = out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    if guard is not None:
        out = _guarded(out, guard)
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _merged(one: tuple, two: tuple, k: int, guard: Guard | None) -> tuple:
    ids, label, score = (np.concatenate(x) for x in zip(one, two, strict=True))
    order = np.lexsort((ids, -score))
    if guard is not None:
        order = order[guard.keep(ids[order], label[order])]
    order = order[:k]
    return ids[order], label[order], score[order]


def _guarded(rows: DataFrame, guard: Guard) -> DataFrame:
    """The guards over what all tasks kept of a query: at most k rows of each."""

    def run(pdf):
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        return pdf.iloc[guard.keep(pdf["id"].to_numpy(), pdf["label"].to_numpy())]

    return rows.groupBy("query_id").applyInPandas(run, rows.schema)


def density(library: DataFrame, references: DataFrame, temperature: float = 8.0) -> DataFrame:
    """(id, density): log-mean-exp of each row's similarities to the references, over blocks of them."""
    rows, parts = library.select("id", "v"), []
    for block in _query_blocks(references.select("query_id", "label", "v")):
        shared = library.sparkSession.sparkContext.broadcast(block[2])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = temperature * scores(View(), matrix(b.column(1)), shared.value) if b.num_rows else np.zeros((0, 1))
                top = s.max(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top), pa.array(np.exp(s - top[:, None]).sum(axis=1)), pa.array(np.full(len(s), s.shape[1]))], ["id", "top", "sum", "n"])

        part = written(rows.mapInArrow(run, "id long, top double, sum double, n long"), "density")
        shared.unpersist()
        parts.append(part)
    if not parts:
        return library.select("id", F.lit(None).cast("double").alias("density"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        peak = out.groupBy("id").agg(F.max("top").alias("peak"))
        out = out.join(peak, "id").groupBy("id", F.col("peak").alias("top")).agg(F.sum(F.col("sum") * F.exp(F.col("top") - F.col("peak"))).alias("sum"), F.sum("n").alias("n"))
    return out.select("id", ((F.col("top") + F.log(F.col("sum") / F.col("n"))) / temperature).alias("density"))


def _moments(rows: DataFrame, shared, views: list[View], names: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, population deviation) of every view and query of the block, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value[2]
        total = np.zeros((len(views), len(q), 3))
        for b in batches:
            if b.num_rows:
                x = _inputs(b, names)
                for n, view in enumerate(views):
                    s = scores(view, x[view.column], q)
                    total[n] += np.stack((np.full(len(q), len(s)), s.sum(axis=0), (s * s).sum(axis=0)), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(views)), len(q))), pa.array(np.tile(np.arange(len(q)), len(views))), *(pa.array(total[:, :, k].ravel()) for k in range(3))], ["view", "q", "n", "s", "ss"])

    sums = rows.mapInArrow(run, "view long, q long, n double, s double, ss double").groupBy("view", "q").agg(F.sum("n"), F.sum("s"), F.sum("ss"))
    out = np.zeros((len(views), len(shared.value[2]), 2))
    for view, q, n, s, ss in sums.toLocalIterator():  # as many rows as the block has queries and views
        out[view, q] = s / max(n, 1), np.sqrt(max(ss / max(n, 1) - (s / max(n, 1)) ** 2, 0))
    return [(m[:, 0], m[:, 1]) for m in out]
