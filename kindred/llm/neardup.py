"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, and exact confirmation.

A document's set holds its distinct word shingles.  Its signature has K symbols of b bits
(MinHash).  The join finds all pairs whose signatures differ in at most LIMIT symbols: the
signature is split into m = (LIMIT + 1) / 2 chunks, so by the pigeonhole principle one chunk
has at most one error; the allowed errors are enumerated by leaving out each symbol of a chunk
in turn, which gives a key for every (chunk, left-out symbol).  Rows of one key are compared by
their whole signatures; only a spanning forest of the near pairs is kept, since connected
documents stay connected.  The candidate groups that result are then searched exactly, on the
full sets of the whole texts: pairs of equal or larger similarity than asked are links, and the
components of the links are returned.

Texts with equal sets are one node from the start.  Keys and candidate groups of more than CELL
rows are dealt into blocks, and every pair of blocks is a task of its own, so that no task holds
more than 2 * CELL rows of a group and no pair is lost.  A pair of similarity 0.8 has
Binomial(80, 0.2) different symbols: more than 31 with a probability of 3e-5.

Defined results: null or wordless texts have an empty set and are linked with nothing; fewer
words than a shingle make one shingle of the whole sequence; ids are expected to be unique:
rows that share one are a single node when links are confirmed and each gets its text's
component; a row without id is no node (it gets its text's component if other rows have that
text, else null, and is kept); an empty table gives an empty result.
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
from .components import components

SYMBOLS, CHUNKS, LIMIT = 80, 16, 31
WIDTH = SYMBOLS // CHUNKS
#: Rows of one key or candidate group in a block.
CELL = 2048
_rng = np.random.Generator(np.random.PCG64(20))
FACTORS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, offsets); data is lower-cased."""
    start, end, at = B.words(data, offsets, B.NOT_SPACE)
    word = B.span_hashes(B.prefix_hashes(data), start, end)
    n = np.diff(at)
    made = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first, owner = B.ranges(at[:-1], made), B.run_ids(made)
    length = np.minimum(n, size)[owner]
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            rows = length > k
            h[rows] = B.mix(h[rows] * np.uint64(0xD1342543DE82EF95) + word[first[rows] + k] + np.uint64(k + 1))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.searchsorted(owner[keep], np.arange(len(offsets)))


def sliced_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """shingles() of slices of bounded bytes, so that a worker's memory doesn't follow a batch or a cell."""
    for i, j in B.slices(offsets):
        yield shingles(B.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], size)


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """uint8[texts, SYMBOLS]: low bits of the minimum of each permuted hash; zeros for empty sets."""
    out = np.zeros((len(off) - 1, SYMBOLS), np.uint8)
    some = np.flatnonzero(np.diff(off) > 0)
    if not len(some):
        return out
    begin = off[some]
    with np.errstate(over="ignore"):
        for k in range(SYMBOLS):
            low = np.minimum.reduceat(h * FACTORS[k], begin)
            out[some, k] = (B.mix(low) & np.uint64(255)).astype(np.uint8)
    return out


def profiles(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set1, set2, signature): the set's size and 128-bit digest."""
    schema = "doc_id long, n_shingles long, set1 long, set2 long, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = B.buffers(b.column(1))
            count, one, two, sig = [], [], [], []
            for h, off in sliced_shingles(data, offsets, size):
                with np.errstate(over="ignore"):
                    for into, salt in ((one, 1), (two, 2)):
                        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(B.mix(h + np.uint64(salt * 0x632BE59BD9B4E019 & B.MASK)))))
                        into.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
                count.append(np.diff(off))
                sig.append(signatures(h, off))
            sig = np.concatenate(sig) if sig else np.zeros((0, SYMBOLS), np.uint8)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SYMBOLS), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
            cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), cat(count), cat(one), cat(two), fixed], ["doc_id", "n_shingles", "set1", "set2", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, slot) for each chunk and left-out symbol; slot is the place of that symbol."""
    for b in batches:
        node = b.column(0).to_numpy()
        n = len(node)
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n, CHUNKS, WIDTH).astype(np.uint64)
        keys = np.empty((n, CHUNKS, WIDTH), np.uint64)
        weight = np.uint64(256) ** np.arange(WIDTH, dtype=np.uint64)
        whole = (sig * weight).sum(axis=2, dtype=np.uint64)
        for c in range(CHUNKS):
            for k in range(WIDTH):
                keys[:, c, k] = B.mix(whole[:, c] - sig[:, c, k] * weight[k] + np.uint64((c * WIDTH + k + 1) << 44))
        slot = np.tile(np.arange(SYMBOLS, dtype=np.int32), n)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(node, SYMBOLS)), pa.array(slot)], ["key", "node", "slot"])


def in_blocks(rows: DataFrame, group: str, sizes: DataFrame, most: int = CELL) -> DataFrame:
    """rows with `cell`, an id of (group, pair of blocks); groups above `most` rows have several blocks.

    sizes: (group, n).  Groups of one row are dropped.
    """
    n_blocks = F.ceil(F.col("n") / most).cast("int")
    dealt = rows.join(sizes.where(F.col("n") > 1).select(group, n_blocks.alias("_k")), group)
    mine = F.pmod(F.xxhash64("node", F.lit(11)), F.col("_k")).cast("int")
    with_each = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.xxhash64(group, F.least(o, mine), F.greatest(o, mine)))
    return dealt.withColumn("cell", F.explode(F.when(F.col("_k") == 1, F.array(F.xxhash64(group, F.lit(0), F.lit(0)))).otherwise(with_each))).drop("_k")


def by_cell(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "cell").sortWithinPartitions("cell", "node")


def groups_of(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups (equal, adjacent values of a column), several small groups together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held)
            key = t.column(column).to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if last:
                yield t.slice(0, last)
                held, n = t.slice(last).to_batches(), t.num_rows - last
    if held:
        yield pa.Table.from_batches(held)
    B.trim()


def _forest(near, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of the component, parent, child) of a spanning forest of the graph near(i, rows) -> bool over n nodes."""
    left, out = np.arange(n), []
    while len(left) > 1:
        root = int(left[0])
        queue, left = [root], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                out.append((np.full(len(found), root), np.full(len(found), i), found))
                queue += found.tolist()
                left = left[~hit]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _near_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, node, slot, signature, sorted by cell and node -> links that connect the nodes whose signatures differ in at most LIMIT symbols.

    Nodes of a cell that agree in the left-out symbol too are in all WIDTH cells of the chunk.  They are
    linked, to the smallest they are connected with, in the chunk's first cell alone; in the others only
    nodes that differ there are.
    """
    for t in groups_of(batches):
        cell, node, slot = (t.column(k).to_numpy() for k in range(3))
        sig = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, SYMBOLS)
        said = sig[np.arange(len(slot)), slot]
        cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        size = np.diff(cut)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for m in np.unique(size[(size > 1) & (size <= 8)]).tolist():  # small cells: all their pairs at once
            base = cut[:-1][size == m]
            i, j = np.triu_indices(m, 1)
            x, y = (base[:, None] + i).ravel(), (base[:, None] + j).ravel()
            new = (slot[x] % WIDTH == 0) | (said[x] != said[y])
            x, y = x[new], y[new]
            for s in range(0, len(x), 1 << 17):
                p, q = x[s : s + (1 << 17)], y[s : s + (1 << 17)]
                ok = (sig[p] != sig[q]).sum(axis=1) <= LIMIT
                out.append((p[ok], q[ok]))
        for g in np.flatnonzero(size > 8).tolist():
            a, z = int(cut[g]), int(cut[g + 1])
            own, symbol = sig[a:z], said[a:z]
            first, i, j = _forest(lambda i, rows, own=own: (own[rows] != own[i]).sum(axis=1) <= LIMIT, z - a)
            if slot[a] % WIDTH:
                new = symbol[i] != symbol[j]
                out.append((i[new] + a, j[new] + a))
            else:
                out.append((first + a, j + a))
        if out:
            p, q = node[np.concatenate([x[0] for x in out])], node[np.concatenate([x[1] for x in out])]
            pair = np.unique(np.stack((np.minimum(p, q), np.maximum(p, q)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def _confirm(size: int, percent: int):
    """cell, node, text -> links of every node to the smallest it is connected with in the cell, by similarities >= percent / 100 on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, most=1024):
            cell, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                data, offsets = B.buffers(t.column(2).slice(a, z - a))
                parts = list(sliced_shingles(data, offsets, size))
                many = np.concatenate([np.diff(off) for _, off in parts])
                off = np.concatenate(([0], np.cumsum(many)))
                _, term = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                n = z - a
                # the inverted index of the cell: for each shingle, the texts that hold it
                order = np.argsort(term, kind="stable")
                owner = B.run_ids(many)[order]
                at = np.searchsorted(term[order], np.arange(int(term.max(initial=-1)) + 2))

                def near(i: int, rows: np.ndarray, term=term, off=off, at=at, owner=owner, many=many, n=n) -> np.ndarray:
                    mine = term[off[i] : off[i + 1]]
                    shared = np.bincount(owner[B.ranges(at[mine], at[mine + 1] - at[mine])], minlength=n)[rows]
                    union = many[i] + many[rows] - shared
                    return (union > 0) & (100 * shared >= percent * union)

                first, _, j = _forest(near, n)
                x, y = node[a:z][first], node[a:z][j]
                ok = x != y
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], ["a", "b"])

    return run


#: Bits of the sieve of candidate ids: a fixed size, whatever the number of ids.
SIEVE_BITS = 1 << 23


def _sieve_places(ids: np.ndarray) -> list[np.ndarray]:
    h = B.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
    low = np.uint64(SIEVE_BITS - 1)
    return [(h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)]


def _sieved(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of texts whose node may be among the groups' nodes, before texts are shuffled.

    A Bloom filter of a fixed megabyte: where it fills up, more rows pass, none is lost.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE_BITS, bool)
        for b in batches:
            for at in _sieve_places(b.column(0).to_numpy()):
                bits[at] = True
        words = np.packbits(bits).view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], ["at", "word"])

    words = np.zeros(SIEVE_BITS // 64, np.int64)
    merged = groups.select("node").mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    for r in merged.toLocalIterator():  # at most SIEVE_BITS / 64 rows
        words[r.at] = r.word
    shared = texts.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may(node: pd.Series) -> pd.Series:
        ids, bits = node.fillna(0).to_numpy(np.int64), shared.value.view(np.uint8)
        ok = node.notna().to_numpy()
        for at in _sieve_places(ids):
            ok &= (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return pd.Series(ok)

    return texts.where(may("node"))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    prof = written(profiles(docs, size, id_col, text_col), "profiles")
    sets = prof.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = ["set1", "set2", "n_shingles"]
    nodes = sets.groupBy(*same).agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"))
    nodes = written(nodes, "nodes")
    # 1. candidate links: the multi-index join of signatures
    keys = nodes.select("node", "signature").mapInArrow(_keys, "key long, node long, slot int")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = in_blocks(keys, "key", counts, cell).select("cell", "node", "slot")
    rows = rows.join(nodes.select("node", "signature"), "node").select("cell", "node", "slot", "signature")
    maybe = by_cell(rows, parts).mapInArrow(_near_signatures, "a long, b long")
    groups = components(maybe)
    # 2. exact links: the candidate groups on their full sets
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    cells = in_blocks(groups, "component", sizes, cell).select("node", "cell")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    found = by_cell(_sieved(texts, groups).join(cells, "node").select("cell", "node", "text"), parts).mapInArrow(_confirm(size, percent), "a long, b long")
    exact = components(found)
    # 3. every row gets its set's component
    label = nodes.join(exact, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    out = prof.join(label, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
