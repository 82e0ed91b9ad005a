"""Findings of the second round: queries on many copies of their rows, and odd inputs."""

import hashlib
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions import digests
from kindred.llm import pii
from kindred.operators import resolve
from kindred.plans import catalogue
from oracle import connect, differences


def copies(spark, folder, n):
    """n copies of 2,000 parts with shifted numbers."""
    p = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    many = p.crossJoin(spark.range(n).withColumnRenamed("id", "_n")).withColumn("p_partkey", F.col("p_partkey") + F.col("_n") * 2000).drop("_n")
    many.repartition(8).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def connect_part(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    return con


def nodes(df):
    """(kind, node) of the plan of the query, which is run."""
    q = df._jdf.queryExecution()
    q.toRdd().count()
    left = [q.executedPlan()]
    while left:
        at = left.pop()
        kind = at.getClass().getSimpleName()
        yield kind, at
        inner = [at.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [at.plan()] if kind.endswith("QueryStageExec") else []
        left += inner + [at.children().apply(k) for k in range(at.children().size())]


def most_joined(df):
    """The most rows that a join of the query has put out."""
    return max((n.metrics().apply("numOutputRows").value() for kind, n in nodes(df) if "Join" in kind and n.metrics().contains("numOutputRows")), default=0)


def loops(df):
    """Columns that joins without a key put out."""
    return {n.output().apply(k).name() for kind, n in nodes(df) if "NestedLoop" in kind or "Cartesian" in kind for k in range(n.output().size())}


def test_holders_are_all_pairs(spark):
    wholes = ["large ring", "large", "ring", "a", "ab", "", "ring ring", "x large ringlet", "ünï ring"]
    parts = ["ring", "large ring", "no such 7", "a", "", "ri", "ï r", "ringx"]
    got = sorted(tuple(r) for r in resolve.holders(spark.createDataFrame([(x,) for x in parts], "t string"), spark.createDataFrame([(x,) for x in wholes], "title_key string")).collect())
    assert got == sorted((p, w) for p in parts for w in wholes if p in w)


@pytest.mark.parametrize("name", ["eval_lookup", "row_cascade", "song_lookup", "profile_rows"])
def test_look_ups_join_classes_of_rows(spark, tmp_path, name):
    """160,000 parts: 4,000 seeds would meet 6 million rows of their titles."""
    assert 0 < most_joined(catalogue.QUERIES[name](spark, copies(spark, tmp_path, 80))) < 600_000


def test_profile_keys_are_made_once(spark, tmp_path, monkeypatch):
    """20,000 parts of a few hundred titles and artists: keys are made for these and the 500 seeds, and songs are looked up once."""
    seen, find = [], resolve.find_songs
    monkeypatch.setattr(resolve, "find_songs", lambda s, c: seen.append((s.count(), c.count())) or find(s, c))
    d = copies(spark, tmp_path, 10)
    df = catalogue.QUERIES["profile_rows"](spark, d)
    kinds = catalogue.QUERIES["profile_rows"].__globals__["songs"](spark, d).select("title", "artist").distinct().count()
    assert kinds < 10_000 and seen == [(500, kinds)]
    assert not any("Python" in kind for kind, _ in nodes(df))
    assert differences(df, connect_part(d), catalogue.ORACLE["profile_rows"]) == ""


@pytest.mark.parametrize("name", ["mashups", "title_variants"])
def test_titles_are_compared_once(spark, tmp_path, name):
    """160,000 parts and 320 seeds: 51 million pairs of rows, of a few hundred titles."""
    t = catalogue.QUERIES[name].__globals__
    d = copies(spark, tmp_path, 80)
    df = catalogue.QUERIES[name](spark, d)
    assert "row" not in loops(df)
    key = (lambda c: t["text"].bench_key(t["text"].ascii_fold(c))) if name == "title_variants" else (lambda c: t["text"].collapsed(t["text"].ascii_fold(c)))
    rows = t["songs"](spark, d).select("row", key("title").alias("t")).collect()
    seeds = {r.t for r in rows if r.row % 500 == 0}
    same = {(s, x): s in x or x in s or (name == "title_variants" and min(len(s), len(x)) >= 8 and SequenceMatcher(None, s, x).ratio() >= 0.9) for s in seeds for x in {r.t for r in rows}}
    assert df.count() == sum(same[s, r.t] for r in rows for s in seeds)


@pytest.mark.parametrize("name", ["graded_ndcg", "graded_report", "tag_jaccard"])
def test_tag_sets_are_compared_once(spark, tmp_path, name):
    """20,000 parts: 200 queries share a tag with 1.4 million rows, and two with 200,000, which tag_jaccard returns."""
    df = catalogue.QUERIES[name](spark, copies(spark, tmp_path, 10))
    assert 0 < most_joined(df) <= (df.count() if name == "tag_jaccard" else 100_000)


def test_similar_rows_meet_as_lists(spark, tmp_path):
    """20,000 parts: a query is joined with lists of a set's and artist's rows, not with each of the 200,000 rows returned."""
    df = catalogue.QUERIES["tag_jaccard"](spark, copies(spark, tmp_path, 10))
    assert 0 < most_joined(df) * 5 < df.count()


@pytest.mark.parametrize("name", ["tag_jaccard", "graded_report"])
def test_parts_of_a_set_are_whole(spark, monkeypatch, name):
    """Sets of 2,000 parts dealt over many lists give the rows of the SQL."""
    monkeypatch.setattr(catalogue, "CHUNK", 4)
    d = "/root/testdata/sf0.01"
    rows = catalogue._tags(spark, d).withColumn("tags", F.array_sort("tags"))
    assert catalogue._parts(rows).count() > 10
    assert differences(catalogue.QUERIES[name](spark, d), connect(d), catalogue.ORACLE[name]) == ""


def test_md5_heads_are_those_of_the_library():
    left = np.array([0, 7, 100, -100, 1_200_000, 12_345_678_901, 2**63 - 1, -(2**63)])
    right = np.array([3, 42, -5, 999, 1_000_000, 98_765_432_109, 2**63 - 1, -(2**63), 0])
    head = {(a, b): int(hashlib.md5(f"{x}/{y}".encode()).hexdigest()[:8], 16) for a, x in enumerate(left) for b, y in enumerate(right)}
    for most in (np.full(8, 2**32 - 1, np.uint32), np.array([head[a, a] for a in range(8)], np.uint32)):
        got = [p for x, y in digests.md5_heads(left, right, most) for p in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(got) == sorted(p for p, h in head.items() if h <= most[p[0]])


@pytest.mark.parametrize("short", [False, True])
def test_hashes_of_pairs_are_not_made_row_by_row(spark, tmp_path, monkeypatch, short):
    """20,000 parts: similar pairs are listed for no query, or for those of which too few hashes were kept (here all); the rows are the SQL's."""
    t, listed = catalogue.QUERIES["graded_report"].__globals__, []
    whole, some = t["_jaccard"], t["_hashed"]
    monkeypatch.setitem(t, "_jaccard", lambda rows, q, near, *c: listed.append(q.count()) or whole(rows, q, near, *c))
    if short:
        monkeypatch.setitem(t, "_hashed", lambda rows, q, near: some(rows, q, near).where("id % 100 = 1"))
    d = copies(spark, tmp_path, 10)
    assert differences(catalogue.QUERIES["graded_report"](spark, d), connect_part(d), catalogue.ORACLE["graded_report"]) == ""
    assert listed == ([200] if short else [])


def plain_viterbi(model, words):
    grid = [model._sum(f) for f in pii.windowed(words)]
    best, back = grid[0] + pii.START, []
    for e in grid[1:]:
        step = best[:, None] + model.move + pii.LEGAL
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + e
    path = [int(best.argmax())]
    for x in reversed(back):
        path.append(int(x[path[-1]]))
    return path[::-1]


def test_pii_decodes_every_word():
    """The labels of one Viterbi pass over whole texts, of the trained and of a random model."""
    rng = np.random.default_rng(5)
    rows = [w for w, _ in pii.labelled_rows(80, seed=4, bare=40)] + [["plain", "words"] * 40 + ["call", "(206)", "555-0134"] + ["more"] * 30 + ["7"], ["x"], [], ["Word"]]
    at = np.concatenate(([0], np.cumsum([len(w) for w in rows])))
    words, told = [w for r in rows for w in r], pii.trained()
    for model in (told, pii.Crf(told.vocab, rng.normal(0, 1.5, told.emit.shape), rng.normal(0, 1.5, told.move.shape))):
        place, found = model.decode_all(at, model.vectors(words))
        tags = np.zeros(len(words), np.int64)
        tags[place] = found
        for r, a, b in zip(rows, at[:-1], at[1:], strict=True):
            assert not r or tags[a:b].tolist() == plain_viterbi(model, r)


def test_pii_marks_words_far_from_digits():
    emit = np.zeros((1, len(pii.LABELS)))
    emit[0, pii.LABELS.index("B-secret")] = 5
    model = pii.Crf({"shape=Aa": 0}, emit, np.zeros((len(pii.LABELS),) * 2))
    assert pii.crf_spans(pa.array(["some plain Word here", "none", None, ""]), model) == [[(11, 15, "secret")], [], [], []]
