"""Exact substring deduplication by a hash-compared suffix sort.

A byte is removed if a string of `size` bytes over it also starts earlier (in a document of a
smaller id, or earlier in the same one).

Every `size`-byte string has one anchor: its K-byte gram of the least hash (the first of equals).
Equal strings have equal anchors at equal places in them, so strings are compared only where
anchors are equal, which leaves a fortieth of all suffixes.
  1. anchors of all documents meet by their gram's hash.  Of anchors whose whole context (all
     strings of that anchor) is equal by 128 bits of hash, all but the first are repeats.
  2. anchors that share a gram but not the context ask for their context's bytes.  Their
     extensions to the right and to the left are suffix-sorted: a mergesort whose comparisons
     find the common extension by binary search over prefix polynomial hashes.  Neighbours'
     common extensions are verified byte by byte (and sorted by the bytes themselves should a
     hash have collided).  Two strings at offset o before their anchors are equal if the left
     extensions agree in o bytes and the right ones in size - o; of equal ones all but the first
     are repeats.
  3. each document's repeats are joined to its text, and what is left is returned.

Texts are shuffled once, by id, which the second and third step share; anchors are found where the
texts are read.  Anchors of one partition that have equal contexts are combined before they are shuffled.

Defined results: null is empty; texts shorter than `size` keep all bytes; rows that share an id and
have different texts are documents of their own, one after the other in the order of a hash of the
text (more than 32,768 of one id raise); rows that repeat id and text are one document, whose result
each of them gets; rows without id are compared with nothing and stay whole; an empty table gives an
empty result; columns besides id and text are not read.  Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import shuffle_parts, table, written

SIZE, GRAM = 100, 24
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """(row, begin, x, last, hash, context): for each anchor x the strings that start at begin..last have it."""
    none = np.empty(0, np.int64)
    n, many = len(data), np.diff(offsets)
    if n < size or not (many >= size).any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix, inv = B.prefix_hashes(data), B.powers(n)[1]
    with np.errstate(over="ignore"):
        raw = (prefix[gram:] - prefix[:-gram]) * inv[: n - gram + 1]
        low = ((raw * _ODD) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - gram + 1, dtype=np.uint64)
    w, step = size - gram + 1, 1
    while step * 2 <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < w:
        low = np.minimum(low[: -(w - step)], low[w - step :])
    x = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # for every start 0..n-size
    first = offsets[:-1][many >= size]
    begins = np.zeros(len(x), bool)
    begins[1:] = x[1:] != x[:-1]
    begins[first] = True
    inside = np.zeros(len(x) + 1, np.int8)
    inside[first] += 1
    np.add.at(inside, (first + many[many >= size] - size + 1), -1)
    valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
    begin = np.flatnonzero(begins & valid)
    ends = np.zeros(len(x), bool)
    ends[:-1] = begins[1:] | ~valid[1:]
    ends[-1] = True
    last = np.flatnonzero(ends & valid)
    at = x[begin]
    with np.errstate(over="ignore"):
        context = B.mix(B.span_hashes(prefix, begin, last + size) + (at - begin).astype(np.uint64) * _ODD)
    return np.searchsorted(offsets, begin, "right") - 1, begin, at, last, B.mix(raw[at]), context


#: Bits of a packed place below the number of the text among those of its id: 31 for the begin, 16 for two short lengths.
PLACE = 47
INSIDE = (1 << PLACE) - 1


def pack(sub, begin, x, last):
    return (sub.astype(np.int64) << PLACE) | (begin << 16) | ((x - begin) << 8) | (last - begin)


def unpack(at: np.ndarray):
    begin = (at & INSIDE) >> 16
    return begin, begin + ((at >> 8) & 255), begin + (at & 255)


ROWS = "key long, context long, doc long, at long"


#: Bytes of texts whose anchors are looked for at a time.
STRETCH = 1 << 19


def _stretches(offsets: np.ndarray, size: int, stretch: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, first byte, offsets from there) of bounded bytes: several whole texts, or a stretch of a long one.

    The stretches of a text overlap by size - 1 bytes, so that every string is in one of them.
    """
    for i, j in B.slices(offsets, stretch):
        if j > i + 1 or offsets[j] - offsets[i] <= 2 * stretch:
            yield i, int(offsets[i]), offsets[i : j + 1] - offsets[i]
        else:
            for a in range(int(offsets[i]), int(offsets[j]) - size + 1, stretch):
                yield i, a, np.array([0, min(stretch + size - 1, int(offsets[j]) - a)])


def _anchor_rows(size: int, gram: int, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(0).null_count:
                b = b.filter(b.column(0).is_valid())
            ids, sub = b.column(0).to_numpy(), b.column(2).to_numpy()
            if int(sub.max(initial=0)) >> (63 - PLACE):
                raise ValueError("too many different texts of one id")
            data, offsets = B.buffers(b.column(1))
            for i, a, off in _stretches(offsets, size, stretch):
                row, begin, x, last, h, c = anchors(data[a : a + off[-1]], off, size, gram)
                doc, base = ids[i + row], offsets[i + row] - a
                at = pack(sub[i + row], begin - base, x - base, last - base)
                # equal anchors of a slice: the first goes on, the others are repeats already (context 0, own key)
                order = np.lexsort((at, doc, c, h))
                h, c, doc, at = h[order], c[order], doc[order], at[order]
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                key = np.where(again, B.mix(doc.astype(np.uint64)), h)
                c = np.where(again, 0, np.maximum(c, np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(at)], ["key", "context", "doc", "at"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    B.trim()
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


#: What is known of an anchor: key 0, begin and end of a removed run; or the gram's hash and the packed place.
FOUND = "doc long, key long, a long, b long"


def _first_contexts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        key, context, doc, at = (t.column(k).to_numpy() for k in range(4))
        done = context == 0
        yield from _removed(doc[done], at[done], size)
        key, context, doc, at = key[~done], context[~done], doc[~done], at[~done]
        order = np.argsort(key, kind="stable")
        key = key[order]
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        order, key = order[shared], key[shared]  # most grams are there once
        context, doc, at = context[order], doc[order], at[order]
        order = np.lexsort((at, doc, context, key))
        key, context, doc, at = key[order], context[order], doc[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
        yield from _removed(doc[~new], at[~new], size)
        key, doc, at = key[new], doc[new], at[new]
        several = np.zeros(len(key), bool)
        several[1:] = key[1:] == key[:-1]
        several[:-1] |= several[1:]
        yield _found(doc[several], key[several], at[several], np.zeros(int(several.sum()), np.int64))

    return run


def _found(doc, key, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, key, a, b)], ["doc", "key", "a", "b"])


def _removed(doc: np.ndarray, at: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Whole anchors as removed runs, runs of a document that touch made one."""
    begin, _, last = unpack(at)
    high = at & ~INSIDE  # texts of one id stay apart
    order = np.lexsort((begin, high, doc))
    doc, begin, end = doc[order], (high | begin)[order], (high | (last + size))[order]
    if len(doc):
        yield _found(*_merged(doc, begin, end))


def _merged(doc, begin, end):
    """Unions of runs sorted by (doc, begin), as columns doc, 0, begin, end; high bits of both ends tell texts of one id apart."""
    text = begin >> PLACE
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])))
    rank = np.cumsum(first) - 1  # of the text
    low, high = begin & INSIDE, end & INSIDE
    big = int(high.max()) + 1
    reach = np.maximum.accumulate(high + rank * big)
    new = first.copy()
    new[1:] |= low[1:] + rank[1:] * big > reach[:-1]
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(doc)) - 1
    return doc[at], np.zeros(len(at), np.int64), begin[at], (reach[stop] - rank[stop] * big) | (text[at] << PLACE)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: removed runs and wanted anchors, as packed int64."""
    t = _whole(batches)
    if t is None:
        return
    doc, key, a, b = (t.column(k).to_numpy() for k in range(4))
    order = np.argsort(doc, kind="stable")
    doc, key, a, b = doc[order], key[order], a[order], b[order]
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
    for s in range(0, len(cut) - 1, 4096):
        part = cut[s : s + 4097]
        removed, wanted = [], []
        for i, j in zip(part[:-1].tolist(), part[1:].tolist(), strict=True):
            gone = key[i:j] == 0
            removed.append(np.stack((a[i:j][gone], b[i:j][gone]), axis=1).tobytes())
            wanted.append(np.stack((key[i:j][~gone], a[i:j][~gone]), axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(doc[part[:-1]]), pa.array(removed, pa.binary()), pa.array(wanted, pa.binary())], ["doc", "removed", "wanted"])


PACKED = "doc long, removed binary, wanted binary"
CONTEXTS = "key long, doc long, at long, bytes binary"


def _context_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(3).is_valid())
            data, offsets = B.buffers(b.column(1))
            ids, sub, asked = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3)
            keys, docs, ats, starts, ends = [], [], [], [], []
            for i in range(b.num_rows):
                rows = np.frombuffer(asked[i].as_buffer(), np.int64).reshape(-1, 2)
                rows = rows[rows[:, 1] >> PLACE == sub[i]]  # the others are of another text of the id
                begin, _, last = unpack(rows[:, 1])
                keys.append(rows[:, 0]), ats.append(rows[:, 1]), docs.append(np.full(len(rows), ids[i]))
                starts.append(begin + offsets[i]), ends.append(last + size + offsets[i])
            if not keys:
                continue
            start, end = np.concatenate(starts), np.concatenate(ends)
            keys, docs, ats = np.concatenate(keys), np.concatenate(docs), np.concatenate(ats)
            for s in range(0, len(start), 1 << 14):
                p, q = start[s : s + (1 << 14)], end[s : s + (1 << 14)]
                off = np.concatenate(([0], np.cumsum(q - p))).astype(np.int64)
                raw = data[B.ranges(p, q - p)]
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer(off), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + len(p)]), pa.array(docs[s : s + len(p)]), pa.array(ats[s : s + len(p)]), held], ["key", "doc", "at", "bytes"])

    return run


class Extensions:
    """Strings data[start:start+length] that are compared by prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        self.data, self.start, self.length = data, start.astype(np.int64), length.astype(np.int64)
        self.prefix, self.inv = B.prefix_hashes(data), B.powers(len(data))[1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by binary search over equal hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        with np.errstate(over="ignore"):
            while (open_ := low < high).any():
                mid = (low + high + 1) >> 1
                same = (self.prefix[a + mid] - self.prefix[a]) * self.inv[a] == (self.prefix[b + mid] - self.prefix[b]) * self.inv[b]
                low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """String i before string j; equal ones by their numbers."""
        d = self.common(i, j)
        end = len(self.data) - 1
        x = np.where(d < self.length[i], self.data[np.minimum(self.start[i] + d, end)].astype(np.int64), -1)
        y = np.where(d < self.length[j], self.data[np.minimum(self.start[j] + d, end)].astype(np.int64), -1)
        return np.where(x == y, i < j, x < y)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common with the one before or -1) inside each group (equal adjacent values): a bottom-up mergesort.

        All merges of a width go together: each element's place in the other run of its merge is
        found by binary search.
        """
        n = len(group)
        order = np.arange(n)
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        size = np.diff(cut)
        begin, many = np.repeat(cut[:-1], size), np.repeat(size, size)
        place = np.arange(n) - begin
        width = 1
        while width < int(size.max(initial=0)):
            run = place // width
            other = run ^ 1
            low = begin + np.minimum(other * width, many)
            high = begin + np.minimum((other + 1) * width, many)
            base = low.copy()
            while (open_ := low < high).any():
                at = np.flatnonzero(open_)
                mid = (low[at] + high[at]) >> 1
                before = self.less(order[mid], order[at])
                low[at] = np.where(before, mid + 1, low[at])
                high[at] = np.where(before, high[at], mid)
            to = begin + (run & ~1) * width + (place - run * width) + (low - base)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, width * 2
        common = np.full(n, -1)
        inner = np.flatnonzero(place > 0)
        common[inner] = self.common(order[inner - 1], order[inner])
        return (order, common) if self.verified(order, common, inner) else self.sorted_by_bytes(group)

    def verified(self, order: np.ndarray, common: np.ndarray, inner: np.ndarray) -> bool:
        """Neighbours agree in so many bytes and in no more."""
        i, j, d = order[inner - 1], order[inner], common[inner]
        for s in range(0, len(inner), 1 << 16):
            a, b, n = self.start[i[s : s + (1 << 16)]], self.start[j[s : s + (1 << 16)]], d[s : s + (1 << 16)]
            if not np.array_equal(self.data[B.ranges(a, n)], self.data[B.ranges(b, n)]):
                return False
        more = (d < self.length[i]) & (d < self.length[j])
        return bool((self.data[self.start[i][more] + d[more]] != self.data[self.start[j][more] + d[more]]).all())

    def sorted_by_bytes(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self.data.tobytes()
        text = [raw[s : s + n] for s, n in zip(self.start.tolist(), self.length.tolist(), strict=True)]
        order = sorted(range(len(group)), key=lambda i: (group[i], text[i], i))
        common = np.full(len(group), -1)
        for k in range(1, len(order)):
            a, b = text[order[k - 1]], text[order[k]]
            if group[order[k - 1]] == group[order[k]]:
                common[k] = next((q for q in range(min(len(a), len(b))) if a[q] != b[q]), min(len(a), len(b)))
        return np.array(order), common


def repeated(key, doc, at, data, offsets, size: int) -> Iterator[pa.RecordBatch]:
    """Removed runs of contexts that share a gram."""
    order = np.lexsort((at, doc, key))
    key, doc, at, start, many = key[order], doc[order], at[order], offsets[:-1][order], np.diff(offsets)[order]
    begin, x, last = unpack(at)
    left, right = x - begin, last + size - x
    middle = start + left
    turned = data[::-1]
    by_right, common_right = Extensions(data, middle, right).sort(key)
    by_left, common_left = Extensions(np.ascontiguousarray(turned), len(data) - middle, left).sort(key)
    nearest, widest = x - last, left  # offsets of the strings before their anchor
    n = len(key)
    gone = np.zeros((n, int(widest.max(initial=0)) + 1), bool)
    block = np.empty((2, n), np.int64)
    for o in range(gone.shape[1]):
        mine = np.flatnonzero((nearest <= o) & (o <= widest))
        if not len(mine):
            continue
        block[0, by_left] = np.cumsum(common_left < o)
        block[1, by_right] = np.cumsum(common_right < size - o)
        _, first = np.unique(block[0, mine] * np.int64(n + 1) + block[1, mine], return_index=True)
        gone[mine, o] = True
        gone[mine[first], o] = False  # rows are in order of document and place
    edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    text = at[row] & ~INSIDE
    a, b = text | (x[row] - (high - 1)), text | (x[row] - low + size)
    order = np.lexsort((a, doc[row]))
    if len(order):
        yield _found(*_merged(doc[row][order], a[order], b[order]))


def _resolve(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        data, offsets = B.buffers(t.column(3))
        yield from repeated(*(t.column(k).to_numpy() for k in range(3)), data, offsets, size)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, sub, removed as packed numbers, removed as structs -> doc, text, removed begins and ends."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        spans = []
        for sub, one, two in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            runs = np.frombuffer(one or b"", np.int64).reshape(-1, 2)
            if two:
                runs = np.concatenate((runs, [(r["a"], r["b"]) for r in two]))
            runs = runs[runs[:, 0] >> PLACE == sub] & INSIDE
            if len(runs):
                runs = runs[np.argsort(runs[:, 0], kind="stable")]
                _, _, a, z = _merged(np.zeros(len(runs), np.int64), runs[:, 0], runs[:, 1])
                spans.append([{"start": s, "end": e} for s, e in zip(a.tolist(), z.tolist(), strict=True)])
            else:
                spans.append([])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kind)], ["doc_id", "text", "removed"])


def _with_runs(docs: DataFrame, size: int, gram: int, stretch: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, sub, one, two): every row with the runs that both steps found.  A stage has one Python pass, so that a core has one worker."""
    n = shuffle_parts(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    # ids with different texts: their hashes in order, which number the texts; a table of its own, empty where ids are unique
    said = rows.where(F.col("doc").isNotNull()).select("doc", F.xxhash64("text").alias("h"))
    several = said.groupBy("doc").agg(F.array_sort(F.collect_set("h")).alias("hashes")).where(F.size("hashes") > 1)
    several = written(several, "several")
    place = F.coalesce(F.array_position("hashes", F.xxhash64("text")) - 1, F.lit(0).cast("long")).cast("int")
    numbered = lambda t: t.join(several, "doc", "left").select("doc", "text", F.greatest(place, F.lit(0)).alias("sub"))
    # 1. anchors, where the texts are read
    found = numbered(rows).mapInArrow(_anchor_rows(size, gram, stretch), ROWS).repartition(n, "key").mapInArrow(_first_contexts(size), FOUND)
    packed = written(found.repartition(n, "doc").mapInArrow(_by_document, PACKED), "anchors")
    # 2. contexts that are asked for; filters on requests are left to the function: pushed below it, they would make another shuffle of texts
    texts = numbered(rows.repartition(n, "doc"))
    asked = packed.where(F.octet_length("wanted") > 0).select("doc", "wanted").hint("shuffle_hash")
    contexts = texts.join(asked, "doc", "left").select("doc", "text", "sub", "wanted").mapInArrow(_context_rows(size), CONTEXTS)
    more = contexts.repartition(n, "key").mapInArrow(_resolve(size), FOUND).repartition(n, "doc")
    # 3. the runs of both steps
    one = packed.select("doc", F.col("removed").alias("one")).hint("shuffle_hash")
    two = more.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("two")).hint("shuffle_hash")
    return texts.join(one, "doc", "left").join(two, "doc", "left").select("doc", "text", "sub", "one", "two")


def repeated_spans(docs: DataFrame, *, size: int = SIZE, gram: int = GRAM, stretch: int = STRETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as bytes, removed: byte ranges start..end to leave out) per row."""
    return _with_runs(docs, size, gram, stretch, id_col, text_col).mapInArrow(_kept, "doc_id long, text binary, removed array<struct<start:long,end:long>>")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The contract's columns of repeated_spans, in its last pass."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _kept(batches):
            n, gone, spans, sha = [], [], [], []
            for raw, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, at = hashlib.sha256(), 0
                for s in cut:
                    h.update(raw[at : s["start"]])
                    at = s["end"]
                h.update(raw[at:])
                n.append(len(raw)), spans.append(len(cut)), sha.append(h.hexdigest())
                gone.append(sum(s["end"] - s["start"] for s in cut))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], [x.split()[0] for x in RESULT.split(", ")])

    return _with_runs(docs, SIZE, GRAM, stretch, "doc_id", "text").mapInArrow(digest, RESULT)
