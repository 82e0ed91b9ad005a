"""Benchmark decontamination by a prefix-filtered set join with exact containment.

The shingles of a window are its words with their places.  Words are ordered by rarity over
all documents; a window is contained in a document only if its rarest word is there, so that
word is the window's prefix (a containment of 1 needs a prefix of one).  Document words are
joined with the prefixes; a length bound and a place bound drop windows that would reach over
the document's ends; the remaining candidates are verified word by word, and found windows
once more byte by byte, over item-sized windows.

The benchmark is read in blocks of at most `block_words` words; each block is broadcast and
joined with all documents, its result is written, and the broadcast is released before the next
block is read, so that driver and executors hold one block whatever the benchmark's size.

Defined results: a null text or item has no words; an item without words matches nothing; a null
item id is the empty text; items that repeat an id count as one; repeated rows and rows of any id
each get a row; empty tables give empty results (an empty benchmark: no hits); carried columns may
have any name but doc_id, text, n_words, hit_starts, hit_lengths and items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .common import table, written

WINDOW = 10
#: Words of benchmark items in one broadcast block (about 50 bytes a word).
BLOCK_WORDS = 1_000_000


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = B.buffers(texts)
    return B.LOWER[data], offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind=B.ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each text) of lower-cased bytes."""
    start, end, at = B.words(data, offsets, kind)
    return B.span_hashes(B.prefix_hashes(data), start, end), start, end, at


class Windows:
    """The windows of one benchmark block, keyed by their rarest word."""

    def __init__(self, ids: list[str], texts: list[str], count_of, width: int) -> None:
        data, offsets = lowered(pa.array(texts, pa.string()))
        self.ids, self.words, self.data = ids, *word_hashes(data, offsets)[:1], data
        _, self.start, self.end, at = word_hashes(data, offsets)
        n = np.diff(at)
        made = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        self.item = B.run_ids(made)
        self.first = B.ranges(at[:-1], made)
        self.length = np.minimum(n, width)[self.item]
        rarity = count_of(self.words)
        prefix, place = np.empty(len(self.item), np.uint64), np.empty(len(self.item), np.int64)
        for w in np.unique(self.length):
            rows = np.flatnonzero(self.length == w)
            grid = self.first[rows, None] + np.arange(w)
            order = np.lexsort((self.words[grid], rarity[grid]))[:, 0]
            prefix[rows], place[rows] = self.words[grid[np.arange(len(rows)), order]], order
        sort = np.argsort(prefix, kind="stable")
        self.item, self.first, self.length, self.place = self.item[sort], self.first[sort], self.length[sort], place[sort]
        self.keys, self.begin, self.many = np.unique(prefix[sort], return_index=True, return_counts=True)
        bits = 1 << 20
        self.low = np.uint64(bits - 1)
        self.sieve = np.zeros(bits, bool)
        self.sieve[(self.keys & self.low).astype(np.int64)] = True

    def find(self, data, words, start, end, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, item) of every occurrence in the texts of a slice."""
        none = np.empty(0, np.int64)
        if not len(self.keys) or not len(words):
            return none, none, none
        near = np.flatnonzero(self.sieve[(words & self.low).astype(np.int64)])
        key = np.searchsorted(self.keys, words[near])
        same = self.keys[np.minimum(key, len(self.keys) - 1)] == words[near]
        near, key = near[same], key[same]
        found = [[], [], []]
        # blocks bound what a very common prefix word makes at a time
        for i in range(0, len(near), 4096):
            p, k = near[i : i + 4096], key[i : i + 4096]
            many = self.many[k]
            p, w = np.repeat(p, many), B.ranges(self.begin[k], many)
            head = p - self.place[w]
            text = np.searchsorted(at, p, "right") - 1
            inside = (head >= at[text]) & (head + self.length[w] <= at[text + 1])
            head, w = head[inside], w[inside]
            for step in range(int(self.length.max())):
                longer = self.length[w] > step
                ok = ~longer
                ok[longer] = words[head[longer] + step] == self.words[self.first[w[longer]] + step]
                head, w = head[ok], w[ok]
                if not len(w):
                    break
            ok = np.array([self._bytes(data, start, end, h, x) for h, x in zip(head.tolist(), w.tolist(), strict=True)], bool)
            if len(w):
                found[0].append(head[ok]), found[1].append(self.length[w[ok]]), found[2].append(self.item[w[ok]])
        return tuple(np.concatenate(x) if x else none for x in found)

    def _bytes(self, data, start, end, head: int, w: int) -> bool:
        a = self.first[w]
        return all(
            np.array_equal(data[start[head + q] : end[head + q]], self.data[self.start[a + q] : self.end[a + q]])
            for q in range(self.length[w])
        )


def _count_words(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often each hash of `known` (sorted, of a bounded block) is a word of any document."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        total = np.zeros(len(keys), np.int64)
        for b in batches:
            data, offsets = lowered(b.column(0))
            for i, j in B.slices(offsets):
                h = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total += np.bincount(k[keys[k] == h], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    out = np.zeros(len(known), np.int64)
    if len(known):
        for r in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r.k] = r.n
    shared.unpersist()
    return out


def blocks(items: DataFrame, most_words: int) -> Iterator[tuple[list[str], list[str]]]:
    """Items in order, in lists of at most so many words (a longer item alone)."""
    ids, texts, n = [], [], 0
    for r in items.toLocalIterator():
        k = len(r.text or "") // 2 + 1
        if ids and n + k > most_words:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(r.item_id), texts.append(r.text or "")
        n += k
    yield ids, texts


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, *carry, n_words, hits (runs as start, length), item_ids found."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("text"))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").alias("text"))

    def one(rows: DataFrame, ids: list[str], texts: list[str]) -> tuple[DataFrame, Broadcast]:
        schema = rows.drop("text").schema.add("n_words", "long").add("hit_starts", T.ArrayType(T.LongType())).add("hit_lengths", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.StringType()))
        known = np.unique(word_hashes(*lowered(pa.array(texts, pa.string())))[0])
        counts = _count_words(rows, known)
        block = Windows(ids, texts, lambda h: counts[np.searchsorted(known, h)], window)
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                data, offsets = lowered(b.column(b.num_columns - 1))
                n_words, starts, lengths, found = [], [], [], []
                for i, j in B.slices(offsets):
                    part = data[offsets[i] : offsets[j]]
                    h, s, e, at = word_hashes(part, offsets[i : j + 1] - offsets[i])
                    head, size, item = index.find(part, h, s, e, at)
                    text = np.searchsorted(at, head, "right") - 1
                    n_words.append(np.diff(at))
                    order = np.lexsort((head, text))
                    head, size, item, text = head[order], size[order], item[order], text[order]
                    cut = np.searchsorted(text, np.arange(j - i + 1))
                    for d in range(j - i):
                        a, z = cut[d], cut[d + 1]
                        starts.append((head[a:z] - at[d]).tolist()), lengths.append(size[a:z].tolist())
                        found.append(sorted({index.ids[x] for x in item[a:z].tolist()}) if z > a else [])
                new = [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], schema.names)

        return rows.mapInArrow(search, schema), shared

    told = blocks(items, block_words)
    head, more = next(told), next(told, None)
    if more is None:
        return one(rows, *head)[0]
    # several blocks: every row has a key of its own, written once, by which its results of all blocks meet again
    keyed = written(rows.withColumn("_row", F.monotonically_increasing_id()), "decontam")
    joined = None
    for block in chain((head, more), told):
        lazy, shared = one(keyed.select("_row", "text"), *block)
        part = written(lazy, "decontam-block")
        shared.unpersist()
        joined = part if joined is None else joined.unionByName(part)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = joined.groupBy("_row").agg(F.first("n_words").alias("n_words"), flat("hit_starts"), flat("hit_lengths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return keyed.drop("text").join(found, "_row").drop("_row")


def covered(starts: np.ndarray, lengths: np.ndarray) -> int:
    """Size of the union of runs."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], starts[order] + lengths[order]
    reach = np.concatenate(([0], np.maximum.accumulate(e)[:-1])) if len(e) else e
    return int(np.maximum(0, e - np.maximum(s, reach)).sum())


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return digest_columns(found)


def digest_columns(found: DataFrame) -> DataFrame:
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            ids, n, starts, lengths, items = b.columns
            some = set(np.flatnonzero(np.diff(starts.offsets.to_numpy())).tolist())
            hit, count, sha = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [empty] * len(ids)
            for i in some:
                hit[i] = covered(np.array(starts[i].as_py()), np.array(lengths[i].as_py()))
                names = items[i].as_py()
                count[i], sha[i] = len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([ids, n, pa.array(hit), pa.array(count), pa.array(sha), pa.array(hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.select("doc_id", "n_words", "hit_starts", "hit_lengths", "items").mapInArrow(digest, schema)
