"""Exact top-k search by BM25: an inverted index per shard with block-max dynamic pruning.

Documents are dealt into shards, indexed piece by piece; a query's k-th best score of earlier
pieces prunes the later ones.  A piece's index holds the postings of rare terms in document
order, the term frequencies of common ones (a twentieth of its documents or more) as columns,
and for each block of BLOCK documents and common term the largest weight of the block.  A
block's bound for a query is the sum of the block's maxima plus the best sum of rare postings
in it; the bounds of many queries are one matrix product.  The blocks of the highest bounds
are scored first and give a k-th best score to start from.  Then blocks follow in document order: the
pivot is the next one whose bound reaches the k-th best score so far, all before it are skipped, and
what a stretch of blocks finds raises that score for the next.  Products are in single precision with a proven margin; documents
that may be among the k best are scored again in double precision, so the result is exact.
Document counts, lengths and term frequencies are global, which makes scores of all shards
comparable: the shards' k best merge into the k best.

Queries are a table; they are broadcast in blocks of about `block_terms` terms, and each block
meets every shard; its result is written and the broadcast released before the next.  Scores are rounded to 6 decimals, ties go to the smaller id.

score = sum over the query's distinct terms of
        qtf * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avglen))

Defined results: null or wordless documents score nothing; null or wordless queries return
nothing; only scores above 0 are returned; repeated rows each count as a document; rows of a
repeated query id count as one query; null ids are left out; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table, written

K1, BETA, BLOCK = 1.2, 0.75, 32
#: Documents of a shard, and terms of the queries in one broadcast block (16 bytes each).
SHARD, BLOCK_TERMS = 8_000, 2_000_000
#: Documents indexed, queries looked up and common terms held as columns at a time: bound a task's memory.
PIECE, GROUP, COLUMNS = 10_000, 256, 1_024
#: Blocks between two looks at the k-th best scores.
STRIDE = 32
#: Relative error of a single-precision sum of COLUMNS products at most, with room; half a unit of the rounding, with room.
SLACK, HALF = 1e-4, 2e-6


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf, words per text), sorted by text and term."""
    data, offsets = B.buffers(texts)
    data = B.LOWER[data]
    rows, terms, tfs, sizes = [], [], [], []
    for i, j in B.slices(offsets):
        part = data[offsets[i] : offsets[j]]
        start, end, at = B.words(part, offsets[i : j + 1] - offsets[i], B.ALNUM)
        h, owner = B.span_hashes(B.prefix_hashes(part), start, end), B.run_ids(np.diff(at))
        order = np.argsort(h)
        few = len(at) <= 1 << 16  # then owners are sorted by radix
        order = order[np.argsort(owner[order].astype(np.uint16 if few else np.int64), kind="stable")]
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        rows.append(owner[first] + i), terms.append(h[first]), tfs.append(np.diff(np.append(first, len(h)))), sizes.append(np.diff(at))
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return cat(rows, np.int64), cat(terms, np.uint64), cat(tfs, np.int64), cat(sizes, np.int64)


class Index:
    """One piece's postings of the terms that some query has."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, wanted: np.ndarray, average: float) -> None:
        row, h, tf, size = term_counts(texts)
        k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        keep = wanted[k] == h
        row, term, tf, n = row[keep], k[keep], tf[keep], len(ids)
        common = np.bincount(term, minlength=len(wanted))
        # alike documents next to each other make block maxima tight: order by rarest shared word, then length
        lead = np.full(n, 1 << 30, np.int64)
        top = np.empty(len(wanted), np.int64)
        top[np.argsort(-common, kind="stable")] = np.arange(len(wanted))
        np.minimum.at(lead, row, top[term])
        order = np.lexsort((ids, size, lead))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, row = ids[order], place[row]
        self.blocks = -(-n // BLOCK)
        self.rows = self.blocks * BLOCK
        self.norm = np.full(self.rows, K1)
        self.norm[:n] = K1 * (1 - BETA + BETA * size[order] / average)
        columns = np.flatnonzero(common * 20 >= n)
        columns = columns[np.argsort(-common[columns], kind="stable")[:COLUMNS]]
        self.column = np.full(len(wanted), -1, np.int32)
        self.column[columns] = np.arange(len(columns))
        at = self.column[term]
        dense = at >= 0
        self.tf = np.zeros((self.rows, len(columns)), np.float32)
        self.tf[row[dense], at[dense]] = tf[dense]
        self.dense = self.tf * np.float32(K1 + 1) / (self.tf + self.norm[:, None].astype(np.float32))
        self.most = np.ascontiguousarray(self.dense.reshape(self.blocks, BLOCK, -1).max(1).T)
        row, term, tf = row[~dense], term[~dense], tf[~dense]
        by_term = np.argsort(term, kind="stable")
        self.doc, term, tf = row[by_term].astype(np.int32), term[by_term], tf[by_term]
        self.weight = tf * (K1 + 1) / (tf + self.norm[self.doc])
        self.at = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(wanted)))))

    def top(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Renews best, (ids, rounded scores) of the k best of each query, by this piece's documents.

        asked: (terms, factors) of each query.
        """
        n = len(asked)
        rare, q = np.empty((n, self.rows)), np.empty((n, self.tf.shape[1]), np.float32)
        for i, (terms, factor) in enumerate(asked):
            c = self.column[terms]
            q[i] = np.bincount(c[c >= 0], factor[c >= 0], minlength=q.shape[1])
            terms, factor = terms[c < 0], factor[c < 0]
            many = self.at[terms + 1] - self.at[terms]
            p = B.ranges(self.at[terms], many)
            rare[i] = np.bincount(self.doc[p], self.weight[p] * np.repeat(factor, many), minlength=self.rows)
        bound = (q @ self.most) * (1 + SLACK) + rare.reshape(n, self.blocks, BLOCK).max(2) + HALF
        floor = np.array([s[k - 1] if len(s) >= k else 0.0 for _, s in best])
        first = min(self.blocks, 1 + -(-k // BLOCK))
        for i in np.flatnonzero(floor == 0):  # the best blocks by bound give a k-th best score to start from
            some = np.argpartition(-bound[i], first - 1)[:first]
            some = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            if len(some) >= k:
                low = (self.dense[some] @ q[i]) * (1 - SLACK) + rare[i, some] - HALF
                floor[i] = max(0.0, np.partition(low, -k)[-k])
        for a in range(0, self.blocks, STRIDE):  # pivots, in document order: the blocks that can still reach a query's k-th best score
            z = min(a + STRIDE, self.blocks)
            live = (bound[:, a:z] >= floor[:, None]) & (bound[:, a:z] > HALF)
            found = []
            for b in np.flatnonzero(live.any(0)) + a:
                i, here = np.flatnonzero(live[:, b - a]), slice(b * BLOCK, (b + 1) * BLOCK)
                high = (q[i] @ self.dense[here].T) * (1 + SLACK) + rare[i, here] + HALF
                x, y = np.nonzero((high >= floor[i, None]) & (high > HALF))
                found.append((i[x], y + b * BLOCK, high[x, y]))
            if found:
                self._taken(asked, rare, found, k, best, floor)

    def _taken(self, asked: list, rare: np.ndarray, found: list, k: int, best: list, floor: np.ndarray) -> None:
        """Scores what was found exactly, and raises the k-th best scores that later blocks have to reach."""
        who, doc, high = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(who, kind="stable")
        doc, high, at = doc[order], high[order], np.searchsorted(who[order], np.arange(len(asked) + 1))
        for i in np.flatnonzero(np.diff(at)):
            d, u = doc[at[i] : at[i + 1]], high[at[i] : at[i + 1]]
            low = np.concatenate((u * (1 - 2.1 * SLACK) - 2.1 * HALF, best[i][1]))
            if len(low) >= k:
                d = d[u >= np.partition(low, -k)[-k]]
            best[i] = self._exact(asked[i], rare[i], d, k, *best[i])
            if len(best[i][1]) >= k:
                floor[i] = max(floor[i], best[i][1][k - 1])

    def _exact(self, asked: tuple[np.ndarray, np.ndarray], rare: np.ndarray, doc: np.ndarray, k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.column[asked[0]]
        c, factor = c[c >= 0], asked[1][c >= 0]
        for j in range(0, len(doc), 1 << 12):
            d = doc[j : j + (1 << 12)]
            tf = self.tf[d[:, None], c].astype(np.float64)
            total = np.round(rare[d] + (tf * (K1 + 1) / (tf + self.norm[d, None])) @ factor, 6)
            d, total = d[total > 0], total[total > 0]
            ids, scores = np.concatenate((ids, self.ids[d])), np.concatenate((scores, total))
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
        return ids, scores


def _terms_of(rows: DataFrame) -> DataFrame:
    """(query_id, terms, qtf), a row for each row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, h, f, _ = term_counts(b.column(1))
            has, first = np.unique(r, return_index=True)
            at = pa.array(np.append(first, len(r)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (h.view(np.int64), f)]
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[has]), *lists], ["query_id", "terms", "qtf"])

    return rows.mapInArrow(run, "query_id long, terms array<long>, qtf array<long>")


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, shard: int = SHARD, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """docs (doc_id, text), queries (query_id, text) -> query_id, rank, doc_id, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    told = _terms_of(queries.select(F.col("query_id").cast("long"), "text").where(F.col("query_id").isNotNull()))
    out = None
    for block in _blocks(told, block_terms):
        lazy, shared = _one_block(rows, block, k, shard)
        found = written(lazy, "search")
        for x in shared:
            x.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _blocks(told: DataFrame, most: int) -> Iterator[np.ndarray]:
    """Whole queries in blocks of about `most` terms: (query, term, qtf) rows, one block on the driver at a time."""
    held, n, last = [], 0, None
    for r in told.orderBy("query_id").toLocalIterator():
        if n >= most and r.query_id != last:
            yield np.concatenate(held)
            held, n = [], 0
        terms = np.array(r.terms, np.int64)
        held.append(np.stack((np.full(len(terms), r.query_id), terms, np.array(r.qtf, np.int64)), axis=1))
        n, last = n + len(terms), r.query_id
    if held:
        yield np.concatenate(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to PIECE rows or more; the last one may be smaller."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= PIECE:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _one_block(rows: DataFrame, block: np.ndarray, k: int, shard: int) -> tuple[DataFrame, list[Broadcast]]:
    spark = rows.sparkSession
    wanted, place = np.unique(np.ascontiguousarray(block[:, 1]).view(np.uint64), return_inverse=True)
    shared = spark.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(len(shared.value), np.int64), 0, 0
        for b in batches:
            _, h, _, size = term_counts(b.column(0))
            x = np.minimum(np.searchsorted(shared.value, h), len(df) - 1)
            df += np.bincount(x[shared.value[x] == h], minlength=len(df))
            n, words = n + len(size), words + int(size.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, words]))], ["t", "df"])

    df = np.zeros(len(wanted) + 2)  # as many as the block has terms; at the end, words and documents
    for t in rows.select("text").mapInArrow(count, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toLocalIterator():
        df[t.t] = t.df
    df, words, n = df[:-2], df[-2], df[-1]
    average = max(words, 1.0) / max(n, 1.0)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    order = np.argsort(block[:, 0], kind="stable")
    query, first = np.unique(block[order, 0], return_index=True)
    part = spark.sparkContext.broadcast((query, np.append(first, len(block)), place[order].astype(np.int64), idf[place[order]] * block[order, 2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, at, terms, factors = part.value
        best = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        for b in _pieces(batches):
            step = -(-b.num_rows // max(1, -(-b.num_rows // PIECE)))
            for i in range(0, b.num_rows, max(1, step)):  # one piece's index at a time, alike in size
                piece = b.slice(i, step)
                index = Index(piece.column(0).to_numpy(), piece.column(1), shared.value, average)
                for g in range(0, len(queries), GROUP):
                    some = best[g : g + GROUP]
                    index.top([(terms[at[q] : at[q + 1]], factors[at[q] : at[q + 1]]) for q in range(g, g + len(some))], k, some)
                    best[g : g + GROUP] = some
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(queries, [len(x[0]) for x in best])), pa.array(np.concatenate([x[0] for x in best])), pa.array(np.concatenate([x[1] for x in best]))],
            ["query_id", "doc_id", "score"],
        )

    shards = max(1, -(-int(n) // shard))
    return rows.repartition(shards, F.xxhash64("doc_id", F.lit(3))).mapInArrow(run, "query_id long, doc_id long, score double"), [shared, part]


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"))
