import base64
import collections
import functools
import hashlib
import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import bytesops, components, decontam, langid, mixing, neardup, pii, quality, search, substrings, token_counts, warc
from kindred.llm.common import held_out, salted_join, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(5)
    words = [w + x for w in "ab cd ef gh ij kl mn op qr st uv wx yz".split() for x in ("", "a", "é", "o")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out, base, shared = [], say(60), say(40)
    for i in range(60):
        kind = i % 10
        t = say(rng.randint(1, 120))
        if kind == 1:
            t = base
        elif kind == 2:
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = say(20) + " " + shared + " " + say(rng.randint(0, 9))
        elif kind == 4:
            t = None if i % 20 == 4 else ""
        elif kind == 5:
            t = "aa " * rng.randint(1, 200)
        elif kind == 6:
            t = say(5) + f"\nmail x{i}@mail.example.com tel +1 (206) 555-01{i:02d} ab 4111 1111 1111 1111, 10.0.0.{i} 300.1.1.1\t" + say(3)
        out.append((i, t, None if i == 7 else ["en", "fr"][i % 2], None if i == 8 else f"s{i % 4}", None if i == 9 else len(t or "")))
    out.append((60, "x" * 5000 + " " + say(3000), "en", "s0", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with clashing names
    return spark.createDataFrame(rows(), SCHEMA).withColumn("score", F.lit(1)).withColumn("size", F.lit("x")).withColumn("digest", F.lit(0)).repartition(5)


def pairs():
    return [(r[0], r[1]) for r in rows()]


def test_words_and_hashes_equal_plain_ones():
    texts = [r[1] for r in rows()]
    data, offsets = bytesops.buffers(pa.array(texts, pa.string()))
    start, end, at = bytesops.words(bytesops.LOWER[data], offsets, bytesops.NOT_SPACE)
    raw = bytesops.LOWER[data].tobytes()
    for k, t in enumerate(texts):
        assert [raw[a:b] for a, b in zip(start[at[k] : at[k + 1]], end[at[k] : at[k + 1]])] == brute.spaced(t)
    h = bytesops.span_hashes(bytesops.prefix_hashes(data), start, end)
    assert len(set(h.tolist())) == len({bytes(data[a:b]) for a, b in zip(start, end)})


def test_langid(spark, docs):
    got = langid.predict(docs, langid.fit(docs.where(~held_out(F.col("doc_id")))), carry=("doc_id",)).collect()
    assert len(got) == 61 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {i for i, t in pairs() if not t}
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_langid_sums_all_segmentations(monkeypatch):
    words = [langid.MARK + w for w in (b"the", b"th", "é".encode(), b"zzz", b"internationalisierungsgesellschaften", "日本語の文章".encode(), "ééàà".encode(), b"")]
    keys, longest = langid.pieces(token_counts.tokenizer_path())
    p = np.append(np.linspace(1, 2, len(keys)) / len(keys), 0)[:, None]

    def piece(x):
        h = bytesops.span_hashes(bytesops.prefix_hashes(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0]
        k = min(int(np.searchsorted(keys, h)), len(keys) - 1)
        return (k, p[k, 0]) if keys[k] == h else (-1, 0.0)

    @functools.cache
    def total(w):  # (probability, expected uses of each piece times the probability)
        if not w:
            return 1.0, {}
        s, uses = 0.0, collections.Counter()
        first = len(w[: 1 + next((k for k in range(1, len(w)) if w[k] & 0xC0 != 0x80), len(w)) - 1])
        for n in range(1, len(w) + 1):
            k, q = piece(w[:n])
            for rate, use in ((q, k), (langid.FLOOR if n == first else 0.0, None)):
                if rate:
                    rest, inner = total(w[n:])
                    s += rate * rest
                    uses.update({x: rate * y for x, y in inner.items()})
                    if use is not None:
                        uses[use] += rate * rest
        return s, uses

    for cells in (1 << 16, 8):  # one stretch, and many
        monkeypatch.setattr(langid, "CELLS", cells)
        seen, expected = set(), np.zeros(len(keys) + 1)
        with np.errstate(divide="ignore"):
            logp = np.log(p[:, 0])
        for at, some in langid.batches_of(words, keys, longest):
            assert np.allclose(langid.log_sums(some, p)[:, 0], [np.log(total(words[i])[0]) for i in at], rtol=1e-9)
            langid.expected_pieces(some, np.ones(len(at)), logp, expected)
            seen |= set(at.tolist())
        assert seen == set(range(len(words)))
        want = np.zeros(len(keys) + 1)
        for w in words:
            s, uses = total(w)
            for k, n in uses.items():
                want[k] += n / s
        assert np.allclose(expected, want, rtol=1e-7)


def test_langid_takes_words_whole(spark):
    """A word far beyond any stretch is scored as the sum over all its segmentations, without underflow."""
    keys, longest = langid.pieces(token_counts.tokenizer_path())
    p = np.append(np.linspace(1, 2, len(keys)) / len(keys), 0)[:, None] * np.ones((1, 2))
    one, two = (langid.log_sums(langid.Words([langid.MARK + b"ab" * n], keys, longest), p)[0, 0] for n in (2000, 4000))
    assert np.isfinite([one, two]).all() and abs(two / one - 2) < 0.01
    texts = [("the and of with " * 30, "en"), ("der die das und " * 30, "de")]
    docs = spark.createDataFrame([(i, *texts[i % 2]) for i in range(8)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = [("the" * 5000, "en"), ("derunddas" * 3000, "de"), (None, "und"), ("", "und"), ("12 . 3", "und")] + [("und die der", "de")] * 2
    got = langid.predict(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(odd)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: w for i, (_, w) in enumerate(odd)}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_op1_rows(spark, tmp_path):
    """The registered query: every row once, repeats and nulls too, held out by the id alone, good on what it has not seen."""
    import zlib

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(3, None, "en"), (None, "12 34", None), (None, "", "fr")], "doc_id long, text string, lang string")
    both = d.union(d.where("doc_id < 5")).union(more).withColumn("score", F.lit("x"))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op1_langid(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in both.collect())
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    said = {r.doc_id: r.lang for r in d.collect()}
    seen = [(said[r.doc_id], r.lang_pred) for r in got if r.held_out and said.get(r.doc_id) and r.lang_pred != "und"]
    assert len(seen) > 20 and sum(a == b for a, b in seen) >= 0.98 * len(seen)
    assert {r.lang_pred for r in got if r.doc_id is None} == {"und"}


def test_langid_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.predict(d, langid.fit(d.where(~held_out(F.col("doc_id")))), carry=("doc_id", "lang")).where(held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_token_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path())
    odd = ["", " ", "a  b \n c▁d <s> x", "   ", "a ", None, "\t\n x  ", "▁▁a", "\0 b", "🙂 🙂"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more).union(more)
    cache = scratch(spark, "cache")
    got = token_counts.token_counts(both, cache).collect()
    want = dict(pairs()) | {100 + k: t for k, t in enumerate(odd)}
    assert len(got) == 61 + 2 * len(odd)
    assert all((r.n_bytes, r.n_tokens) == (len((want[r.doc_id] or "").encode()), len(sp.encode(want[r.doc_id] or ""))) for r in got)
    n = spark.read.parquet(cache).count()
    assert n == len({(t or "").replace("▁", " ") for t in want.values()})
    token_counts.token_counts(both, cache).collect()
    assert spark.read.parquet(cache).count() == n  # nothing is encoded twice
    assert token_counts.token_counts(both.where("false"), scratch(spark, "cache")).count() == 0


def test_op6_rows(spark, tmp_path, docs):
    """The registered query, whose second call finds all counts in the store; one text on most rows."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path())
    more = spark.createDataFrame([(200 + k, "the hot text") for k in range(2000)] + [(None, "no id"), (7, "word " * 6000)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "digest").unionByName(more, allowMissingColumns=True)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in both.collect()), key=repr)
    for _ in range(2):
        got = token_counts.op6_token_counts(spark, str(tmp_path)).collect()
        assert sorted((tuple(r)[:3] for r in got), key=repr) == want and all(r.over_limit == (r.n_tokens > 4096) for r in got)
        assert any(r.over_limit for r in got)


def test_substrings(spark, docs):
    got = {r.doc_id: r for r in substrings.repeated_spans(docs).collect()}
    want = brute.substrings(pairs())
    for i, r in got.items():
        cut = [(s.start, s.end) for s in r.removed]
        keep, at = b"", 0
        for s, e in cut:
            keep, at = keep + bytes(r.text)[at:s], e
        assert (len(r.text), sum(e - s for s, e in cut), len(cut), hashlib.sha256(keep + bytes(r.text)[at:]).hexdigest()) == want[i]


def test_op5_rows(spark, tmp_path):
    """The registered query, and the operator with long texts in many stretches: ids shared by different texts, repeated rows, no id, nulls, very long texts, an empty table."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    shared, long = say(60), say(40_000)
    rows = [(1, shared + say(30)), (1, say(9) + shared), (2, say(50)), (3, shared), (3, shared), (4, None), (5, ""), (None, shared), (None, shared + "x"), (6, long), (7, "x" + long[5000:90_000] + "y"), (8, "ab" * 400), (8, "ab" * 401), (8, say(40))]
    spark.createDataFrame([(i, t, 1, 0) for i, t in rows], "doc_id long, text string, sub int, key int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in substrings.op5_substrings(spark, str(tmp_path)).collect()), key=repr)
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "text string").select("text", F.xxhash64(F.col("text").cast("binary")).alias("h")).collect()}
    order = sorted({(i, hashes[t or ""], t or "") for i, t in rows if i is not None})
    told = brute.substrings([(k, t) for k, (_, _, t) in enumerate(order)])
    at = {(i, t): told[k] for k, (i, _, t) in enumerate(order)}
    whole = lambda t: (len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest())
    assert got == sorted(((i, *(whole(t or "") if i is None else at[i, t or ""])) for i, t in rows), key=repr)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    many = substrings.digests(docs, stretch=300)
    assert sorted((tuple(r) for r in many.collect()), key=repr) == got
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert substrings.op5_substrings(spark, f"{tmp_path}/none").count() == 0


def test_suffix_sort_with_forced_collisions():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    start = rng.integers(0, 350, 50)
    x = substrings.Extensions(data, start, np.full(50, 40))
    group = np.repeat([1, 2], 25)
    order, common = x.sort(group)
    assert (order == x.sorted_by_bytes(group)[0]).all() and (common == x.sorted_by_bytes(group)[1]).all()
    x.prefix[:] = 0  # every comparison is a collision
    order2, common2 = x.sort(group)
    assert (order2 == order).all() and (common2 == common).all()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, size):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size=size).collect()}
    assert got == brute.groups(pairs(), size)


def test_near_duplicates_in_blocks(spark, docs):
    """Groups above three rows are dealt into blocks."""
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size=2, cell=3).collect()}
    assert got == brute.groups(pairs(), 2)


def test_near_duplicates_of_a_chain(spark):
    """A chain of texts of which only neighbours are links, in many blocks; repeated rows, no ids."""
    words = [f"w{i}" for i in range(400)]
    chain = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(80)]
    rows = chain + [chain[5], (None, chain[6][1]), (None, None), (500, "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (2048, 7):
        got = collections.Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(df, size=2, cell=cell).collect())
        want = collections.Counter((i, 0) for i, _ in chain) + collections.Counter({(5, 0): 1, (None, 0): 1, (None, None): 1, (500, 500): 1})
        assert got == want
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_salted_join_is_a_plain_join(spark):
    """One key on most rows, null keys, keys without a partner."""
    rows = [(k, "hot" if k % 4 else None if k % 8 == 0 else f"c{k}") for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, key string")
    small = spark.createDataFrame([("hot", 1), ("c4", 2), ("none", 3)], "key string, x int")
    for how in ("inner", "left"):
        got, want = (sorted(map(tuple, t.select("id", "key", "x").collect()), key=repr) for t in (salted_join(df, small, "key", "id", how), df.join(small, "key", how)))
        assert got == want
    assert salted_join(df.where("false"), small, "key", "id", "left").count() == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (7, 7), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components.components(links).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_decontamination(spark, docs):
    items = [("q1", "ab cd ef"), ("q2", None), ("q3", ""), ("q4", dict(pairs())[3]), ("q5", "aa " * 12), ("q5b", "aa " * 12), ("q6", "ab"), (None, "cd")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.contamination(pairs(), [(i or "", t) for i, t in items])
    for block in (1_000_000, 20):  # one block, and many
        got = decontam.digest_columns(decontam.contamination(docs, bench, block_words=block)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert decontam.digest_columns(decontam.contamination(docs, bench.where("false"))).where("contaminated").count() == 0
    assert decontam.contamination(docs.where("false"), bench).count() == 0 == decontam.contamination(docs.where("false"), bench, block_words=5).count()


def test_search(spark, docs):
    q = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = {tuple(r) for r in search.search(docs, q, shard=20).collect()}
    assert got == brute.bm25(pairs(), [p for p in pairs() if p[0] % 7 == 0])
    assert {tuple(r) for r in search.search(docs, q, shard=20, block_terms=50).collect()} == got


def test_search_ties_repeats_and_empty(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = ["one two three four"] * 70 + [" ".join(rng.choice(words[: 1 + i]) for _ in range(rng.randint(0, 60))) for i in range(200)]
    texts += [None, "", "word " * 20_000 + "one", "ÄÖ one, TWO!"]
    rng.shuffle(texts)
    rows = [(i, t, 1.0, 1, 5) for i, t in enumerate(texts)] + [(3, texts[3], 1.0, 1, 5)] * 2  # a repeated row
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, rank int, term long")
    plain = [(r[0], r[1] or "") for r in rows]
    ask = frame.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text", "score", "rank")
    for k in (1, 10, 40):
        found = [tuple(r) for r in search.search(frame, ask, k=k, shard=90).collect()]
        assert sorted(found) == brute.bm25_rows(plain, [p for p in plain if p[0] % 5 == 0], k)
    none = frame.where("doc_id < 0")
    assert search.search(none, ask).count() == 0
    assert search.search(frame, none.select(F.col("doc_id").alias("query_id"), "text")).count() == 0
    lost = spark.createDataFrame([(None, "one"), (1, None)], "doc_id long, text string")
    assert search.search(lost, ask).count() == 0 == search.search(frame, lost.withColumnRenamed("doc_id", "query_id")).count()


def test_pii_base_is_the_patterns(spark, docs):
    rng = random.Random(1)
    texts = [t or "" for _, t in pairs()] + ["".join(rng.choice("a.@@b-+1 20()é\n") for _ in range(60)) for _ in range(3000)]
    assert all(sorted(pii.base_spans(t)) == brute.base_spans(t) for t in texts)


def _tags(model, rows):
    """Labels of each row of words, by the batch decoder."""
    at = np.concatenate(([0], np.cumsum([len(w) for w in rows])))
    words = [w for r in rows for w in r]
    telling = np.array([k for k, w in enumerate(words) if pii._TELLING.search(w)], np.int64)
    place, found = model.decode(telling, at, lambda which: model.vectors([words[k] for k in which.tolist()]))
    tags = np.zeros(len(words), np.int64)
    tags[place] = found
    return [tags[a:b] for a, b in zip(at[:-1], at[1:])]


def test_pii_decoder_is_plain_viterbi():
    """On every chain of telling words and their neighbours, between two O."""
    model = pii.trained()
    rows = [w for w, _ in pii.labelled_rows(60, seed=3)] + [["plain", "words"] * 30 + ["call", "(206)", "555-0134"] + ["more"] * 20 + ["7"], ["x"], []]
    for words, got in zip(rows, _tags(model, rows), strict=True):
        near = [any(abs(i - k) <= pii.CONTEXT and pii._TELLING.search(w) for k, w in enumerate(words)) for i in range(len(words))]
        grid = [model._sum(f) + (0 if ok else np.where(np.arange(len(pii.LABELS)), -1e6, 0)) for f, ok in zip(pii.windowed(words), near, strict=True)]
        if not words:
            continue
        best, back = grid[0] + pii.START, []
        for e in grid[1:]:
            step = best[:, None] + model.move + pii.LEGAL
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + e
        path = [int(best.argmax())]
        for x in reversed(back):
            path.append(int(x[path[-1]]))
        assert got.tolist() == path[::-1]


def test_pii_crf(spark):
    model = pii.trained()
    held = pii.labelled_rows(200, seed=99)
    tags = _tags(model, [w for w, _ in held])
    assert sum([pii.LABELS[k] for k in t] == want for t, (_, want) in zip(tags, held)) >= 0.9 * len(held)
    texts = ['see token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" there', "nothing here", "", "in 1999 it was 25% more", None, "é 中 " * 9 + "mail me: joe [at] example [dot] org now"]
    found = pii.crf_spans(pa.array(texts), model)
    assert [k for _, _, k in found[0]] == ["secret"] and found[1] == found[2] == found[3] == found[4] == []
    assert [texts[5][a:b] for a, b, _ in found[5]] == ["joe [at] example [dot] org"]


def test_pii_long_runs_of_digits():
    """Very long digit runs neither break nor take long."""
    far = "1.2.3." + "0" * 5000 + "1"
    assert pii.base_spans(far) == [(0, len(far), "ip")]
    t = "7" * 300_000 + " " + "1." * 100_000 + " +1" + "(" * 100_000
    assert [k for _, _, k in pii.base_spans(t)] == ["ip"] * 25_000 and pii.base_spans("9" * 5000 + ".1.1.1") == []
    assert pii.apart([(0, 3, "x"), (3, 5, "x"), (9, 12, "x")], [(4, 9, "ip")]) == [(0, 3, "x"), (9, 12, "x")]


def test_op3_rows(spark, tmp_path):
    """The registered query's rows: nulls, empty and long texts, repeated rows, an empty table, clashing columns."""
    texts = [(i, t) for i, t in pairs()] + [(6, dict(pairs())[6]), (None, "a@b.org"), (70, "é 1.2.3.4 x@y.zz " * 4000), (71, "1.2.3." + "0" * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, base int, spans string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(pii.op3_pii(spark, str(tmp_path)).collect(), key=repr)
    want = []
    for i, t in texts:
        base = sorted(pii.base_spans(t or ""), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        want.append((i, *(sum(k == s[2] for s in base) for k in pii.BASE_KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        said = [x.split(":") for x in r.spans.split(",") if x]
        assert [int(x[1]) for x in said] == sorted(int(x[1]) for x in said) and len(said) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op3_pii(spark, f"{tmp_path}/none").count() == 0


def test_pii_masks(spark, docs):
    got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert got[6].count("[email]") == got[6].count("[card]") == got[6].count("[ip]") == 1 and "@" not in got[6]
    assert {i for i, t in got.items() if t is None} == {i for i, t in pairs() if t is None}


def test_warc(spark):
    pages = [(1, "http://a", "x" * 500), (2, "http://b", "x" * 500), (3, None, None), (4, "u", ""), (5, "http://c\r\nX: y", "é" * 9), (6, "d", "x" * 500), (6, "d", "other"), (None, "n", "x" * 500), (None, "n", "alone"), (8, "long", "long é " * 300_000)] + [(100 + k, "hot", "hot") for k in range(3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    for least in (0, 100):
        folder = scratch(spark, "warc")
        index = warc.write_archive(df, folder, least=least)
        got = {(r.page_id, r.digest): r for r in warc.read_records(index).collect()}
        assert len(got) == len(pages)
        for i, _, html in pages:
            raw = (html or "").encode()
            r = got[i, base64.b32encode(hashlib.sha1(raw).digest()).decode()]
            last = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
            revisit = last is not None and i != last and len(raw) >= least
            assert (r.payload_bytes, r.record_type, r.refers_to) == (len(raw), "revisit" if revisit else "response", last if revisit else None)
            assert revisit or bytes(r.payload) == raw
        assert warc.read_records(index.where("page_id = 5")).count() == 1
    assert warc.read_records(warc.write_archive(df.where("false"), scratch(spark, "warc"))).count() == 0


def test_warc_records_are_valid():
    """Ids are told apart by payload, a revisit names its response's id, every record has a date."""
    one = dict(warc.parse(warc.record(1, "u", b"a", warc.base32_sha1(b"a"), None))[0])
    two = dict(warc.parse(warc.record(1, "u", b"b", warc.base32_sha1(b"b"), None))[0])
    again = dict(warc.parse(warc.record(3, "u", b"a", warc.base32_sha1(b"a"), 1, "f:0"))[0])
    assert len({x["WARC-Record-ID"] for x in (one, two, again)}) == 3 and again["WARC-Refers-To"] == one["WARC-Record-ID"]
    assert all(x["WARC-Date"].endswith("Z") and x["WARC-Record-ID"].startswith("<urn:uuid:") for x in (one, two, again))


def test_byte_ranges_are_joined():
    assert warc.ranges([(0, 10), (10, 10), (100, 5), (105, 5)], gap=20, most=1000) == [(0, 20), (100, 110)]


def _targets(size):
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        rest = sum(size.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        target |= {s: 3 * size[s] for s in full} if full else {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    return target


def test_mixing(spark, docs):
    got = mixing.mix_copies(docs).collect()
    assert len(got) == 61
    size = collections.Counter()
    for r in got:
        assert r.size == len(brute.spaced(dict(pairs())[r.doc_id])) and 0 <= r.copies <= 3
        size[r.source] += r.size
        assert r.size or not r.copies
    target = _targets(size)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
    for s in size:
        assert abs(sum(r.size * r.rate for r in got if r.source == s) - target[s]) < 1e-6 * target[s]
        # rates are tilts of the length: the odds of 3 grow by one power of it
        tilts = {round(math.log(2 * r.rate / (3 - r.rate)) / math.log1p(r.size), 6) for r in got if r.source == s and r.size and r.rate < 3}
        assert len(tilts) <= 1
        taken = sum(r.size * r.copies for r in got if r.source == s)
        huge = max(r.size for r in got if r.source == s)  # a source of one huge document cannot come nearer
        assert abs(taken - target[s]) <= 0.02 * target[s] + (huge / 2 if huge > 1000 else 20)
    assert any(len({round(r.rate, 6) for r in got if r.source == s and r.size}) > 5 for s in size)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_copies(docs.repartition(3)).collect()), key=repr)
    assert mixing.mix_copies(docs.where("false")).count() == 0


def test_mixing_targets_of_many_sources(spark):
    rng = random.Random(2)
    size = {(None if k == 7 else f"s{k:03}é" if k % 2 else f"S{k}"): 0 if k == 9 else int(10 ** rng.uniform(0, 5)) for k in range(200)}
    rows = spark.createDataFrame([(s, n, 1) for s, n in size.items()], "source string, source_size long, n_docs long").repartition(4)
    want = _targets(size)
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(size.values()))


def test_mixing_follows_targets_beside_huge_documents(spark, monkeypatch):
    """Huge texts, many chunks, repeated rows, text ids: the taken words stay next to the target."""
    monkeypatch.setattr(mixing, "CHUNK", 40)
    rows = [("a", 20_000)] * 50 + [("a", 20)] * 1000 + [("b", 400_000)] + [("b", 300)] * 2000 + [("c", n) for n in range(1, 900)] + [(None, 5)] * 300 + [("d", 0)] * 3 + [("b", 0)]
    df = spark.createDataFrame([(f"x{k % 3000}", s, n) for k, (s, n) in enumerate(rows)], "doc_id string, source string, size long")
    got = mixing.mixed(mixing.written(df, "test-mix")).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for s, n in rows:
        size[s] += n
    target = _targets(size)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(0 <= r.copies <= 3 and r.target == pytest.approx(target[s]) for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - target[s]) <= max(0.002 * target[s], 10)


def test_op10_rows(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op10_mixing(spark, str(tmp_path)).collect()
    copies = {r.doc_id: r for r in mixing.mix_copies(docs).collect()}
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in got} == {i: (r.size, r.source_size, r.target, r.size * r.copies) for i, r in copies.items()}


def test_quality(spark):
    """On rows of the quarter that no classifier was fitted on."""
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    y = y.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality is not null")
    got = quality.op8_quality(spark, "/root/testdata/sf0.1").join(y, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 3).collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(good) > 100 and len(bad) > 20
    assert sum(r.rejected for r in good) <= 0.01 * len(good) and sum(r.rejected for r in bad) >= 0.8 * len(bad)
    assert sum(r.score > 0.5 for r in good) >= 0.95 * len(good)


def test_quality_odd_inputs(spark):
    """Few labels, one kind of label, nulls, repeated rows, long texts, an empty table, clashing columns."""
    rng = random.Random(4)
    say = lambda n, bad: " ".join(rng.choice(["###", "!!", "$$", "%%"] if bad else ["tea", "house", "river", "walk"]) for _ in range(n))
    texts = [(i, None if i == 1 else "" if i == 2 else say(30_000 if i == 3 else 40, i % 3 == 0), None if i == 5 else "en", f"s{i % 3}", None if i == 6 else i) for i in range(40)]
    docs = spark.createDataFrame([*texts, texts[9], texts[9]], SCHEMA).withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).withColumn("_y", F.lit(7))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(6, 18)] + [(7, None, None), (None, 1, 1), (9, 0, 0)], "doc_id long, quality long, toxic long")
    model, z = quality.fitted(docs, labels)
    got = quality.score(docs, model, carry=("doc_id", "score", "row")).collect()
    assert len(got) == 42 and all(0 <= r._p <= 1 for r in got)
    seen = {r.doc_id: r._p for r in got}
    assert len({r._p for r in got if r.doc_id == 9}) == 1
    assert np.mean([seen[i] for i in range(18, 40) if i % 3]) > np.mean([seen[i] for i in range(18, 40) if not i % 3]) + 0.2
    again = {r.doc_id: r._p for r in quality.score(docs.repartition(3), quality.fit(docs.repartition(3), labels)).collect()}
    assert again == pytest.approx(seen)
    for few in (labels.where("quality = 1"), labels.where("false")):
        flat = quality.score(docs, quality.fit(docs, few)).collect()
        assert {r._p for r in flat} == {0.5} and not any(r._rejected for r in flat)
    assert quality.score(docs.where("false"), model).count() == 0 == quality.score(docs.where("false"), quality.fit(docs.where("false"), labels)).count()


def test_quality_calibration_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=(300, 2)) * 2, rng.integers(0, 2, 300)
    rows = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(z, y)], "z1 double, z2 double, y long")
    found = quality._calibrated(rows)
    for x, w, prior in ((z[:, :1], found[0], [1, 0]), (z[:, 1:], found[1], [1, 0]), (z, found[2], [0.5, 0.5, 0])):
        x = np.hstack((x, np.ones((300, 1))))
        p = 1 / (1 + np.exp(-x @ np.array(w)))
        assert np.abs(x.T @ (p - y) + np.array(w) - prior).max() < 1e-6


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    states = [d]
    for name, stage in P.STAGES:
        d = P.written(stage(spark, d, sf), "test-stage")
        states.append(d)
    told = [[(r.doc_id, r.text) for r in s.collect()] for s in states]
    assert all(s.columns == states[0].columns for s in states[1:-1])
    assert {i for i, _ in told[2]} == {c for _, c in brute.groups(told[1], 5).values()}
    assert {i for i, _ in told[3]} == {i for i, x in brute.contamination(told[2], items).items() if not x[4]}
    assert not any(brute.base_spans(t or "") for _, t in told[4])
    assert {i for i, _ in told[5]} <= {i for i, _ in told[4]}


def test_decontamination_rows_with_many_blocks(spark):
    rows = [(1, "ab cd ef gh"), (1, "ab cd ef gh"), (None, "ab cd ef gh"), (None, "ij kl mn op"), (None, "no hit at all"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("q1", "ab cd ef"), ("q2", "kl mn"), ("q3", "zz zz zz")], "item_id string, text string")
    one, many = (decontam.contamination(docs, bench, block_words=n) for n in (1_000_000, 3))
    assert one.columns == many.columns
    plain = lambda df: sorted((repr(tuple(r)) for r in decontam.digest_columns(df).collect()))
    assert len(plain(many)) == len(rows) and plain(many) == plain(one)


def test_pipeline_keeps_texts_that_share_an_id(spark):
    import corpus_pipeline as P

    say = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, say("a")), (1, say("b")), (None, say("c")), (None, say("c")), (5, say("c")), (6, say("c")), (None, say("d")), (None, say("d")), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.neardup_stage(spark, docs, "")
    assert sorted((repr((r.doc_id, r.text)) for r in got.collect())) == sorted(map(repr, [(1, say("a")), (1, say("b")), (5, say("c")), (None, say("d")), (None, None)]))
    two = spark.createDataFrame([(1, "one"), (1, "two two two two two " * 9)], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    sizes = {r.text: r["size"] for r in P.mixing_stage(spark, two, "").collect()}
    assert len(sizes) == len(set(sizes.values())) == 2  # a row of its own each, not the larger of both


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Every stage: nulls in all columns, empty and long texts, repeated rows, shared ids, an empty table."""
    import corpus_pipeline as P

    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice("tea house river walk stone light paper green".split()) + str(rng.randint(0, 99)) for _ in range(n))
    rows = [(i, say(60), "en", "s0", 300) for i in range(30)] + [(None, None, None, None, None), (None, "", None, None, 0), (3, say(50), None, "s1", 9), (3, say(50), None, "s1", 9), (40, say(30_000), "en", None, 1)]
    rows += [rows[0]] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("copies", F.lit(1)).withColumn("_item", F.lit(2))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(12)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", rows[5][1]), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = [tuple(r)[:5] for r in stage(spark, docs, str(tmp_path)).collect()]
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    plain = collections.Counter(rows)
    assert not collections.Counter(seen["quality classifier"]) - plain
    assert collections.Counter(seen["MinHash near-dedup"]) == collections.Counter(set(rows))
    assert collections.Counter(seen["benchmark decontamination"]) == plain - collections.Counter([rows[5]])
    assert len(seen["PII"]) == len(rows)
    taken = collections.Counter(seen["mixing sources to target weights"])
    assert not taken - plain and all(taken[r] in (0, plain[r]) for r in rows) and not any(taken[r] for r in rows if not r[1])
