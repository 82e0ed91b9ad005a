"""Quality classifier by co-training.

Two logistic classifiers see the same documents differently: one the text's content (byte and
word statistics, hashed words), one the page's metadata (source, language, stated length).
Over rounds each gives its most confident documents, out of all unlabelled ones, as pseudo-labels to
the other.  Both are calibrated (Platt, with a weak prior on no change), and their log odds combined, on
all labelled rows of a quarter of the ids that neither was fitted on; all documents are scored over
their whole texts.

What comes to the driver are features, not texts: of about `fit_rows` labelled rows outside that
quarter (chosen by a hash of id and text) and of at most `give` pseudo-labelled documents a round and
view.  Calibration sums, the threshold and the choice of pseudo-labels run over all rows in Spark.
The threshold of rejection is the largest, up to 0.5, that keeps at least `keep` of the good rows of
the calibration quarter.

Defined results: a null text is empty; null metadata are a value of their own; null labels count
as none; of several labels of an id the largest holds; without labels of both kinds outside the
calibration quarter every score is 0.5 and nothing is rejected; without good rows in the quarter
nothing is rejected; rows that repeat id and text are learned from once, and each get a row; an empty
table gives an empty result; columns besides id, text, metadata and the carried ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table, written

FIT_ROWS, GIVE, KEEP, ROUNDS = 2500, 100, 0.995, 2
BUCKETS, META = 1 << 11, 1 << 9
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".,;:'\"-()", "loud": b"!?", "mark": b"#$%&*|<>{}[]=+_~^@/\\"}


def text_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, dense[n, d], row, bucket, share) for slices of texts: statistics, and the shares of hashed words."""
    data, offsets = B.buffers(texts)
    kinds = np.zeros(256, np.uint8)
    for k, chars in enumerate(CLASSES.values(), 1):
        kinds[list(chars)] = k
    for i, j in B.slices(offsets):
        dense = np.zeros((j - i, len(CLASSES) + 9))
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.diff(off).astype(float)
        per = np.maximum(size, 1)
        owner = B.run_ids(np.diff(off))
        counts = np.bincount(owner * 16 + kinds[part], minlength=(j - i) * 16).reshape(-1, 16)[:, : len(CLASSES) + 1]
        low = B.LOWER[part]
        start, end, at = B.words(low, off, B.NOT_SPACE)
        h = B.span_hashes(B.prefix_hashes(low), start, end)
        word_owner = B.run_ids(np.diff(at))
        many = np.maximum(np.diff(at), 1)
        order = np.lexsort((h, word_owner))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (word_owner[order][1:] != word_owner[order][:-1])
        distinct = np.bincount(word_owner[order][new], minlength=j - i)
        length = np.bincount(word_owner, end - start, minlength=j - i) / many
        square = np.bincount(word_owner, (end - start).astype(float) ** 2, minlength=j - i) / many
        decorated = np.bincount(word_owner, kinds[part[end - 1]] >= 7, minlength=j - i) / many if len(end) else np.zeros(j - i)
        single = np.bincount(word_owner, (end - start) == 1, minlength=j - i) / many
        shouted = np.bincount(word_owner, (kinds[part[start]] == 1) & (kinds[part[np.minimum(start + 1, len(part) - 1)]] == 1), minlength=j - i) / many if len(start) else np.zeros(j - i)
        dense[:, : len(CLASSES)] = counts[:, 1:] / per[:, None]
        dense[:, len(CLASSES) :] = np.stack((counts[:, 0] / per, np.log1p(size) / 10, distinct / many, length / 10, np.sqrt(np.maximum(square - length**2, 0)) / 10, decorated, single, shouted, np.log1p(counts[:, 5]) / 5), axis=1)
        key = word_owner * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        got, times = np.unique(key, return_counts=True)
        yield i, j, dense, got // BUCKETS, got % BUCKETS, times / many[got // BUCKETS]


def meta_features(columns: list[pa.Array]) -> np.ndarray:
    """int64[n, k]: a hashed value of every metadata column; numbers by the power of two below them."""
    out = []
    for k, c in enumerate(columns):
        if pa.types.is_integer(c.type) or pa.types.is_floating(c.type):
            x = c.to_numpy(zero_copy_only=False).astype(float)
            raw = np.where(np.isnan(x), 99, np.floor(2 * np.log2(np.maximum(np.nan_to_num(x), 0) + 1))).astype(np.uint64)
        else:
            data, offsets = B.buffers(c.cast(pa.string()))
            raw = B.span_hashes(B.prefix_hashes(data), offsets[:-1], offsets[1:]) if len(c) else np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            out.append((B.mix(raw + np.uint64((k + 1) * 7919)) & np.uint64(META - 1)).astype(np.int64))
    return np.stack(out, axis=1) if out else np.zeros((0, 0), np.int64)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 80) -> np.ndarray:
    """Weights (last: intercept) by full-batch gradient steps scaled per feature."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    w = np.zeros(x.shape[1])
    seen = np.full(x.shape[1], 1e-8)
    total = weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30)))
        g = (x.T @ ((p - y) * weight).astype(x.dtype)).astype(float) / total + ridge * np.append(w[:-1], 0)
        seen += g**2
        w -= 0.5 * g / np.sqrt(seen)
    return w


class Model:
    def __init__(self, mean, scale, text, meta, calibrate, threshold) -> None:
        self.mean, self.scale, self.text, self.meta, self.calibrate, self.threshold = mean, scale, text, meta, calibrate, threshold

    def views(self, texts: pa.Array, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of both views."""
        d, one = len(self.mean), np.zeros(len(texts))
        for i, j, dense, row, bucket, share in text_features(texts):
            one[i:j] = ((dense - self.mean) / self.scale).clip(-6, 6) @ self.text[:d] + self.text[-1]
            one[i:j] += np.bincount(row, np.sqrt(share) * self.text[d:-1][bucket], minlength=j - i)
        return one, self.meta[meta_features(columns)].sum(axis=1) + self.meta[-1]

    def score(self, texts: pa.Array, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p_text, p_meta, p): calibrated views and their combination."""
        if self.text is None:
            half = np.full(len(texts), 0.5)
            return half, half, half
        one, two = self.views(texts, columns)
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        (a, b), (c, d), (e, f, g) = self.calibrate
        return p(a * one + b), p(c * two + d), p(e * one + f * two + g)


def _features(rows: DataFrame, meta: int) -> pa.Table:
    """Features of (row, y, text, *metadata), one of equal rows: row, y, dense, buckets, shares, meta as packed numbers, by row."""
    schema = "row long, y long, dense binary, buckets binary, shares binary, meta binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = meta_features(b.columns[3 : 3 + meta])
            for i, j, dense, row, bucket, share in text_features(b.column(2)):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                packed = lambda x, t: pa.array([r.astype(t).tobytes() for r in x], pa.binary())
                parts = lambda x, t, cut=cut: pa.array([x[p:q].astype(t).tobytes() for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), packed(dense, np.float64), parts(bucket, np.int16), parts(share, np.float32), packed(m[i:j], np.int32)], ["row", "y", "dense", "buckets", "shares", "meta"])

    once = rows.mapInArrow(run, schema).groupBy("row").agg(*[F.first(c).alias(c) for c in ("y", "dense", "buckets", "shares", "meta")])
    return once.toArrow().sort_by("row")


def _matrices(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense, hashed words, one-hot metadata) of _features rows."""
    n = t.num_rows
    of = lambda c, k: np.frombuffer(b"".join(t.column(c).to_pylist()), k)
    dense = of("dense", np.float64).reshape(n, -1) if n else np.zeros((0, len(CLASSES) + 9))
    hashed, meta = np.zeros((n, BUCKETS), np.float32), np.zeros((n, META), np.float32)
    for i, (b, s, m) in enumerate(zip(t.column("buckets").to_pylist(), t.column("shares").to_pylist(), t.column("meta").to_pylist(), strict=True)):
        hashed[i, np.frombuffer(b, np.int16)] = np.sqrt(np.frombuffer(s, np.float32))
        np.add.at(meta[i], np.frombuffer(m, np.int32), 1)
    return dense, hashed, meta


def _views(docs: DataFrame, model: Model, meta: tuple[str, ...], what: str) -> DataFrame:
    """(doc_id, row, z1, z2) of every document, written: log odds of both views."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = shared.value.views(b.column(2), b.columns[3:])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(one), pa.array(two)], ["doc_id", "row", "z1", "z2"])

    rows = docs.select("doc_id", _row(), F.col("text").alias("_text"), *[F.col(c).alias(f"_view_{c}") for c in meta])
    return written(rows.mapInArrow(run, docs.select("doc_id").schema.add("row", "long").add("z1", "double").add("z2", "double")), what)


def _row() -> F.Column:
    return F.xxhash64("doc_id", "text").alias("row")


def _calibrated(rows: DataFrame, rounds: int = 40) -> list[tuple[float, ...]]:
    """Weights of (z1, 1), (z2, 1) and (z1, z2, 1) by Newton steps whose sums run over all rows (z1, z2, y)."""
    inputs, prior = [(0, 2), (1, 2), (0, 1, 2)], [np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([0.5, 0.5, 0.0])]
    best, least, step = [p.copy() for p in prior], [np.inf] * 3, [np.zeros(len(p)) for p in prior]
    for _ in range(rounds):
        tried, moved = [w - d for w, d in zip(best, step, strict=True)], 0.0
        for k, (w, (loss, g, h)) in enumerate(zip(tried, _moments(rows, inputs, tried), strict=True)):
            off = w - prior[k]
            loss += 0.5 * float(off @ off)
            if loss <= least[k] + 1e-12:
                best[k], least[k] = w, loss
                step[k] = np.linalg.solve(h + np.eye(len(w)), g + off)
            else:  # too far: half the step, from where it was best
                step[k] = step[k] / 2
            moved = max(moved, float(np.abs(step[k]).max()))
        if moved < 1e-9:
            break
    return [tuple(float(v) for v in w) for w in best]


def _moments(rows: DataFrame, inputs: list[tuple[int, ...]], weights: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, Hessian) of each logistic model over the columns it has of (z1, z2, 1), summed where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(1 + len(w) + len(w) ** 2 for w in weights))
        for b in batches:
            z = np.stack((b.column(0).to_numpy(), b.column(1).to_numpy(), np.ones(b.num_rows)), axis=1)
            y, parts = b.column(2).to_numpy(), []
            for at, w in zip(inputs, weights, strict=True):
                x = z[:, list(at)]
                odds = x @ w
                p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
                parts += [[(np.logaddexp(0, odds) - odds * y).sum()], (p - y) @ x, ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
            total += np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "x"])

    flat = np.zeros(sum(1 + len(w) + len(w) ** 2 for w in weights))
    for r in rows.select("z1", "z2", "y").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # a few numbers
        flat[r.k] = r.x
    out, at = [], 0
    for w in weights:
        d = len(w)
        out.append((float(flat[at]), flat[at + 1 : at + 1 + d], flat[at + 1 + d : at + 1 + d + d * d].reshape(d, d)))
        at += 1 + d + d * d
    return out


def fitted(docs: DataFrame, labels: DataFrame, *, meta=("source", "lang", "n_chars"), target: str = "quality", fit_rows: int = FIT_ROWS, give: int = GIVE, rounds: int = ROUNDS, keep: float = KEEP) -> tuple[Model, DataFrame | None]:
    """The model, and (doc_id, row, z1, z2) of all documents, None where nothing could be learned."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("long").alias("_y"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 3
    known = docs.select("doc_id", "text", *meta).join(told, "doc_id")
    n = docs.select("doc_id").join(told.where(~held), "doc_id").count()
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30))
    some = known.where(~held & (place < int(min(1.0, fit_rows / max(n, 1)) * (1 << 30))))
    sample = _features(some.select(_row(), F.col("_y"), "text", *meta), len(meta))
    y = sample.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, None, None, 0.0), None
    dense, hashed, m = _matrices(sample)
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
    joined = lambda dense, hashed: np.hstack((((dense - mean) / scale).clip(-6, 6).astype(np.float32), hashed))
    x, share = joined(dense, hashed), y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    none = (np.zeros((0, x.shape[1]), np.float32), np.zeros((0, META), np.float32), np.empty(0))
    taught = [none, none]  # what each view learns from the other: text features, metadata, pseudo-labels
    for r in range(rounds + 1):
        ws = []
        for known_, which, (more, ridge) in zip((x, m), (0, 1), zip(taught, (1e-3, 1e-2), strict=True), strict=True):
            ws.append(logistic(np.vstack((known_, more[which])), np.append(y, more[2]), np.append(weight, np.full(len(more[2]), 0.3)), ridge))
        model = Model(mean, scale, *ws, None, 0.0)
        z = _views(docs, model, meta, f"views{r}")
        if r < rounds:
            taught = _pseudo_labels(docs, z, told, meta, give * (r + 1), share, joined)
    quarter = written(z.where(held).join(told, "doc_id").select("z1", "z2", F.col("_y").alias("y")), "quarter")
    model.calibrate = _calibrated(quarter)
    e, f, g = model.calibrate[2]
    p = 1 / (1 + F.exp(-(F.col("z1") * e + F.col("z2") * f + F.lit(g))))
    low = quarter.where("y = 1").agg(F.percentile_approx(p, 1 - keep, 100_000)).first()[0]
    model.threshold = 0.0 if low is None else min(0.5, float(low))
    return model, z


def _pseudo_labels(docs: DataFrame, z: DataFrame, told: DataFrame, meta: tuple[str, ...], n: int, share: float, joined) -> list:
    """For each view the features and labels of the other's most confident unlabelled documents: at most n."""
    rows = z.join(told.select("doc_id"), "doc_id", "left_anti").groupBy("row").agg(F.first("z1").alias("z1"), F.first("z2").alias("z2"))
    rows, sure = written(rows, "unlabelled"), float(np.log(9))
    out = []
    for view in ("z2", "z1"):  # the view that teaches
        low = rows.where(F.col(view) < -sure).orderBy(view, "row").limit(max(1, int(n * (1 - share)))).select("row", F.lit(0).cast("long").alias("_y"))
        high = rows.where(F.col(view) > sure).orderBy(F.desc(view), "row").limit(max(1, int(n * share))).select("row", F.lit(1).cast("long").alias("_y"))
        out.append(low.unionByName(high).toPandas())
    chosen = {int(k) for t in out for k in t.row}
    if not chosen:
        empty = _matrices(_features(docs.where("false").select(_row(), F.lit(0).cast("long").alias("_y"), "text", *meta), len(meta)))
        return [(joined(*empty[:2]), empty[2], np.empty(0))] * 2
    picked = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted(chosen)], "row long"))  # at most 2 n rows
    t = _features(docs.withColumn("row", _row()).join(picked, "row").select("row", F.lit(0).cast("long").alias("_y"), "text", *meta), len(meta))
    dense, hashed, m = _matrices(t)
    x, at = joined(dense, hashed), {k: i for i, k in enumerate(t.column("row").to_pylist())}
    return [(x[i], m[i], table._y.to_numpy(float)) for table in out for i in [[at[int(k)] for k in table.row]]]


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return fitted(docs, labels, **options)[0]


def score(docs: DataFrame, model: Model, *, meta=("source", "lang", "n_chars"), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """*carry, _p_text, _p_meta, _p (0 to 1, of good quality), _rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # columns that are carried anyway are not sent twice
    wanted = {c: c if c in carry else f"_view_{c}" for c in ("text", *meta)}
    rows = docs.select(*carry, *[F.col(c).alias(name) for c, name in wanted.items() if c not in carry])
    schema = docs.select(*carry).schema.add("_p_text", "double").add("_p_meta", "double").add("_p", "double").add("_rejected", "boolean")
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, *columns = (b.column(b.schema.get_field_index(name)) for name in wanted.values())
            one, two, both = shared.value.score(text, columns)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(one), pa.array(two), pa.array(both), pa.array(both < shared.value.threshold)], schema.names)

    return rows.mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, z = fitted(docs, table(spark, sf_dir, "labels"))
    if z is None:
        half = F.lit(0.5)
        return docs.select("doc_id", half.alias("score"), half.alias("score_text"), half.alias("score_meta"), F.lit(False).alias("rejected"))
    p = lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))
    (a, b), (c, d), (e, f, g) = model.calibrate
    both = p(F.col("z1") * e + F.col("z2") * f + F.lit(g))
    return z.select("doc_id", both.alias("score"), p(F.col("z1") * a + F.lit(b)).alias("score_text"), p(F.col("z2") * c + F.lit(d)).alias("score_meta"), (both < model.threshold).alias("rejected"))
