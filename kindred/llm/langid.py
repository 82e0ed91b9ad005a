"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary.  Each language has a probability for every piece;
a word's probability is the sum over all its segmentations into pieces, found by a forward
pass; a text's is the product over its words.  Piece probabilities are fitted by expectation
maximisation (forward-backward) on word counts of labelled texts.  The prediction is the
language of the largest posterior, the score that posterior.

Words of any length are summed over whole: probabilities are rescaled on the way, and long
words are worked off in stretches of bounded memory.  All letter pieces of the vocabulary count.

Fitting reads whole texts of at most about `fit_docs` labelled documents of each language
(chosen by a hash of the id, whatever the input's size) and all their words; the word counts stay
in a table, and a round of expectation maximisation is a pass over it, whose expected piece
counts (a row per language and piece) come to the driver.  Scoring reads every whole text.

Defined results: a null text or one without a letter is `und` with score 0; rows without a
language are not learned from but predicted; without any labelled text all is `und`, score 0;
repeated rows each get a row; ties go to the language first in order; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import held_out, table, written
from .token_counts import tokenizer_path

FIT_DOCS = 1500
#: Rounds of expectation maximisation.
ROUNDS = 4
#: Bytes of words, padding included, that are worked off at a time: bounds memory, not words.
CELLS = 1 << 16
#: Probability of a character that no piece covers, the same in every language.
FLOOR = 1e-7
#: Not part of words: ASCII but letters, and the marker byte of a word's begin.
LETTERS = B.class_table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
MARK = b"\x01"
_pieces: dict = {}
_memos: dict = {}


def pieces(path: str) -> tuple[np.ndarray, int]:
    """(sorted hashes, bytes of the longest) of the vocabulary's letter pieces; a begin-of-word sign becomes MARK."""
    if path not in _pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = set()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            letters = p.removeprefix("▁")
            if letters and letters.isalpha() and p == p.lower():
                found.add((MARK if p[0] == "▁" else b"") + letters.encode())
        found.add(MARK)
        flat = sorted(found)
        ends = np.cumsum([len(x) for x in flat])
        data = np.frombuffer(b"".join(flat), np.uint8)
        keys = np.unique(B.span_hashes(B.prefix_hashes(data), np.concatenate(([0], ends[:-1])), ends))
        _pieces[path] = keys, max(map(len, flat))
    return _pieces[path]


class Words:
    """Words of alike length, padded to the longest: which pieces end where."""

    def __init__(self, words: list[bytes], keys: np.ndarray, longest: int) -> None:
        self.size = np.array([len(w) for w in words])
        self.m, self.n = len(words), int(self.size.max(initial=0))
        raw = np.frombuffer(b"".join(w.ljust(self.n, b"\0") for w in words), np.uint8)
        self.keys, self.longest, self.raw, self.prefix = keys, longest, raw.reshape(self.m, self.n), B.prefix_hashes(raw)

    def stretch(self, a: int, z: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """([(l, piece[m, z - a])], char[m, z - a]) for the bytes a..z.

        piece[w, j - a] is the number of the piece of the l bytes that end with byte j, or -1; char the
        length of the character that ends there, or 0 inside a character.  l without any piece are left out.
        """
        at, row = np.arange(a, z), np.arange(self.m)[:, None]
        inside = at < self.size[:, None]
        found = []
        for k in range(1, min(z, self.longest) + 1):
            j = at[at >= k - 1]
            if len(j):
                end = (row * self.n + j + 1).ravel()
                h = B.span_hashes(self.prefix, end - k, end)
                x = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                here = np.full((self.m, z - a), -1, np.int32)
                here[:, z - a - len(j) :] = np.where(self.keys[x] == h, x, -1).reshape(self.m, -1)
                here[~inside] = -1
                if (here >= 0).any():
                    found.append((k, here))
        low = max(0, a - 3)
        part = self.raw[:, low : z + 1]
        starts = (part & 0xC0) != 0x80
        head = np.maximum.accumulate(np.where(starts, np.arange(low, low + part.shape[1]), 0), axis=1)[:, a - low : z - low]
        last = np.ones((self.m, z - a), bool)
        after = starts[:, a - low + 1 :][:, : z - a]
        last[:, : after.shape[1]] = after
        last |= at + 1 == self.size[:, None]
        return found, np.where(last & inside, at + 1 - head, 0)

    def stretches(self) -> list[tuple[int, int]]:
        step = max(64, CELLS // max(1, self.m))
        return [(a, min(a + step, self.n)) for a in range(0, self.n, step)]


def batches_of(words: list[bytes], keys: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, Words]]:
    """(places, Words) of about CELLS bytes, words of alike length together."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        first = size[order[i]]
        same = int(np.searchsorted(size[order], max(first, first * 5 // 4), "right"))
        j = min(same, i + max(1, int(CELLS // max(1, size[order[same - 1]]))))
        yield order[i:j], Words([words[x] for x in order[i:j].tolist()], keys, longest)
        i = j


def log_sums(words: Words, p: np.ndarray) -> np.ndarray:
    """[m, L]: natural logs of the words' probabilities, over all segmentations. p[V + 1, L], last row 0.

    Only the last begins that a piece can reach back to are held, rescaled as they go.
    """
    ring = max(words.longest, 4) + 1
    alpha, scale = np.zeros((ring, words.m, p.shape[1])), np.zeros((words.m, p.shape[1]))
    alpha[0] = 1
    out = np.full((words.m, p.shape[1]), -np.inf)
    rows = np.arange(words.m)
    for a, z in words.stretches():
        found, char = words.stretch(a, z)
        for j in range(a, z):
            total = np.zeros_like(scale)
            for k, piece in found:
                x = piece[:, j - a]
                if (x >= 0).any():
                    total += alpha[(j + 1 - k) % ring] * p[x]
            c = char[:, j - a]
            total += np.where(c > 0, FLOOR, 0.0)[:, None] * alpha[(j + 1 - c) % ring, rows]
            alpha[(j + 1) % ring] = total
            if j % 8 == 7:
                most = alpha.max(axis=0)
                most[most == 0] = 1
                alpha /= most
                scale += np.log(most)
            done = words.size == j + 1
            if done.any():
                with np.errstate(divide="ignore"):
                    out[done] = np.log(alpha[(j + 1) % ring, done]) + scale[done]
    return out


def expected_pieces(words: Words, counts: np.ndarray, logp: np.ndarray, into: np.ndarray) -> None:
    """Adds the expected uses of every piece in `counts` times the words; forward-backward in logs. logp[V + 1]."""
    n = words.n
    fore, back = np.full((n + 1, words.m), -np.inf), np.full((n + 1, words.m), -np.inf)
    fore[0], floor = 0, np.log(FLOOR)
    rows = np.arange(words.m)
    back[words.size, rows] = 0

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        x = np.stack(parts)
        most = np.where(np.isinf(x.max(axis=0)), 0, x.max(axis=0))
        with np.errstate(divide="ignore"):
            return most + np.log(np.exp(x - most).sum(axis=0))

    for a, z in words.stretches():
        found, char = words.stretch(a, z)
        for j in range(a, z):
            c = char[:, j - a]
            parts = [np.where(c > 0, floor + fore[j + 1 - c, rows], -np.inf)]
            parts += [fore[j + 1 - k] + logp[piece[:, j - a]] for k, piece in found if k <= j + 1]
            fore[j + 1] = joined(parts)
    whole = fore[words.size, rows]
    for a, z in reversed(words.stretches()):
        found, char = words.stretch(a, z)
        for j in range(z - 1, a - 1, -1):
            c = char[:, j - a]
            for k, piece in found:
                if k <= j + 1:
                    x = piece[:, j - a]
                    use = np.flatnonzero(x >= 0)
                    if len(use):
                        step = logp[x[use]] + back[j + 1, use]
                        np.add.at(into, x[use], counts[use] * np.exp(fore[j + 1 - k, use] + step - whole[use]))
                        back[j + 1 - k, use] = np.logaddexp(back[j + 1 - k, use], step)
            some = np.flatnonzero(c)
            back[j + 1 - c[some], some] = np.logaddexp(back[j + 1 - c[some], some], floor + back[j + 1, some])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last, bytes, starts, ends, first word of each text, hashes) of the words of lower-cased texts."""
    data, offsets = B.buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    for i, j in B.slices(offsets):
        part = data[offsets[i] : offsets[j]]
        start, end, at = B.words(part, offsets[i : j + 1] - offsets[i], LETTERS)
        yield i, j, part, start, end, at, B.span_hashes(B.prefix_hashes(part), start, end)


class Model:
    def __init__(self, langs: list[str], prior: np.ndarray, p: np.ndarray, path: str, version: str) -> None:
        self.langs, self.prior, self.p, self.path, self.version = langs, prior, p, path, version

    def log_likelihoods(self, texts: pa.Array) -> np.ndarray:
        """float[texts, langs], natural logs of the texts' probabilities."""
        keys, longest = pieces(self.path)
        if self.version not in _memos:
            _memos.clear()
            _memos[self.version] = B.Memo(len(self.langs), 20)
        memo, out = _memos[self.version], np.zeros((len(texts), len(self.langs)))
        for i, j, part, start, end, at, hashes in _slices(texts):
            raw = part.tobytes()

            def score(which: np.ndarray, raw=raw, start=start, end=end) -> np.ndarray:
                found = [MARK + raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]
                rows = np.empty((len(found), len(self.langs)))
                for places, some in batches_of(found, keys, longest):
                    rows[places] = log_sums(some, self.p)
                return rows

            total = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(memo.get(hashes, score), axis=0)))
            out[i:j] = total[at[1:]] - total[at[:-1]]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        post = self.log_likelihoods(texts) + self.prior
        best = post.argmax(axis=1)
        share = 1 / np.exp(np.minimum(post - post.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, share, 0.0)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, path: str | None = None) -> Model:
    """Learn from (doc_id, text, lang) rows."""
    path = path or tokenizer_path()
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy(lang_col).count().collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0), np.zeros((1, 0)), path, "none")
    rate = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, fit_docs / sizes[k])))]), F.col(lang_col))
    sample = named.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) < rate * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, part, start, end, at, hashes in _slices(b.column(0)):
                raw, lang = part.tobytes(), b.column(1).slice(i, j - i).to_pylist()
                owner = np.searchsorted(at, np.arange(len(start)), "right") - 1
                for name in set(lang):
                    mine = np.flatnonzero(np.array([x == name for x in lang])[owner]) if len(start) else np.empty(0, np.int64)
                    _, first, n = np.unique(hashes[mine], return_index=True, return_counts=True)
                    w = [raw[start[x] : end[x]] for x in mine[first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(w), pa.string()), pa.array(w, pa.binary()), pa.array(n)], ["lang", "word", "n"])

    counted = sample.select(F.col(text_col), F.col(lang_col)).mapInArrow(count, "lang string, word binary, n long")
    counted = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    keys, _ = pieces(path)
    p = np.full((len(keys) + 1, len(langs)), 1 / len(keys))
    for _ in range(ROUNDS):
        p[-1] = 0
        found = _expectations(counted, langs, p, path)
        found[-1] = 0
        p = found / found.sum(axis=0)
    prior = np.log(np.array([sizes[k] for k in langs], float) / sum(sizes.values()))
    return Model(langs, prior, p, path, str(hash((path, p.tobytes()))))


def _expectations(counted: DataFrame, langs: list[str], p: np.ndarray, path: str) -> np.ndarray:
    """[V + 1, L]: expected uses of every piece and language over the counted words, and a little for each."""
    shared = counted.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, longest = pieces(path)
        total = np.zeros(shared.value.shape)
        with np.errstate(divide="ignore"):
            logp = np.log(shared.value)
        for b in batches:
            lang, n = np.array([langs.index(x) for x in b.column(0).to_pylist()], np.int64), b.column(2).to_numpy().astype(float)
            words = [MARK + w for w in b.column(1).to_pylist()]
            for k in np.unique(lang).tolist():
                mine = np.flatnonzero(lang == k)
                into = np.zeros(len(total))
                for places, some in batches_of([words[i] for i in mine.tolist()], keys, longest):
                    expected_pieces(some, n[mine[places]], logp[:, k], into)
                total[:, k] += into
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], ["piece", "lang", "n"])

    out = np.full(p.shape, 0.02)
    sums = counted.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # a row per piece and language
    np.add.at(out, (rows.column(0).to_numpy(), rows.column(1).to_numpy()), rows.column(2).to_numpy())
    shared.unpersist()
    return out


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """*carry, lang_pred, score."""
    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, share = shared.value.predict(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(share, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, carry=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
