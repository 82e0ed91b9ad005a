"""Token counts with a digest cache.

Normalised content and the tokenizer's version are digested; the digests are joined to a
stored table of counts; one text of each digest without a count is encoded and appended to
the store.  The normalisation is the tokenizer's own: it reads U+2581 as a space.  The rows of a
frequent digest are dealt to many tasks where counts join them.

Defined results: null counts as the empty text (0 tokens, 0 bytes); repeated rows and rows without id
each get a row; an empty table gives an empty result; only the id and text columns are read.  A store
may be appended to by several runs at once: equal digests have equal counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import salted_join, shared_dir, table

MODEL = "piece_bpe_32k.model"
_loaded: dict = {}


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another vocabulary never meets these counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _model(path: str):
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        # merges stay inside `spaces + word` if no piece has a space after another character
        split = not any(re.search("[^▁]▁", p) for p in pieces) and sp.encode(" a", out_type=str)[0][:1] == "▁"
        _loaded[path] = sp, split, B.Memo(1, 20, np.int64)
    return _loaded[path]


def count_tokens(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of every whole text.

    Where no piece of the vocabulary crosses from a word to a following space, a text is the
    sum of its `spaces + word` segments, and a segment seen before is not encoded again.
    """
    sp, split, memo = _model(path)
    if not split:
        return np.array([len(x) for x in sp.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)
    data, offsets = B.buffers(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in B.slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(part):
            continue
        space = part == 32
        begins = np.zeros(len(part), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(part))
        head = np.isin(start, off[:-1])  # the library puts one space before a text
        plain = np.where(~head & space[start], start + 1, start)
        hashes = B.span_hashes(B.prefix_hashes(part), plain, end)
        raw = part.tobytes()

        def encode(at: np.ndarray, raw=raw, plain=plain, end=end) -> np.ndarray:
            found = sp.encode([raw[a:b].decode() for a, b in zip(plain[at].tolist(), end[at].tolist(), strict=True)], num_threads=1)
            return np.array([[len(x)] for x in found], np.int64)

        alone = (plain == end) & ~head  # one space at a text's end

        counts = np.where(alone, 1, memo.get(hashes, encode)[:, 0])
        total = np.concatenate(([0], np.cumsum(counts)))
        at = np.searchsorted(start, off)
        out[i:j] = total[at[1:]] - total[at[:-1]]
    return out


def digests(docs: DataFrame, id_col: str, text_col: str, version: str) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "▁", " ")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(F.concat(F.lit(version), F.lit(":"), text), 256).alias("digest"),
        text.alias("content"),
    )


def token_counts(
    docs: DataFrame, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row; counts of new contents are appended to cache_path (Parquet)."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    version = tokenizer_version(path)
    told = digests(docs, id_col, text_col, version)
    schema = "digest string, version string, n_tokens long"
    known = _stored(spark, cache_path, schema)
    misses = told.select("digest", "content")
    if known is not None:
        misses = misses.join(known.where(F.col("version") == version).select("digest"), "digest", "left_anti")
    misses = misses.groupBy("digest").agg(F.first("content").alias("content"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_tokens(b.column(1), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n), pa.string()), pa.array(n)], ["digest", "version", "n_tokens"])

    misses.mapInArrow(encode, schema).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(schema).parquet(cache_path).where(F.col("version") == version)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return salted_join(told.drop("content"), counts, "digest", "doc_id", "left").select("doc_id", "n_bytes", "n_tokens")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else None


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application keeps a store for each data folder: a second call encodes only what the first has not seen."""
    store = f"token-counts-{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"
    counts = token_counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/{store}")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
