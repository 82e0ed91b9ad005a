"""Queries over whole tables, against results that do not share their code or their registered SQL."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from kindred.operators import evaluate, graph
from kindred.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges():
    """Distinct (customer, -1 - supplier) of all orders."""
    return duckdb.sql(f"SELECT DISTINCT o_custkey, -1 - l_suppkey FROM '{DATA}/orders.parquet' JOIN '{DATA}/lineitem.parquet' ON l_orderkey = o_orderkey").fetchall()


def test_components_of_the_whole_graph(spark, edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.node: r.component for r in catalogue.QUERIES["components"](spark, DATA).collect()} == {n: find(n) for n in root}


def test_hops_in_the_whole_graph(spark, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = front = {n: 0 for n in near if n >= 0 and n % 100 == 0}
    for hop in (1, 2):
        front = {m: hop for n in front for m in near[n] if m not in want}
        want = want | front
    assert {r.node: r.hop for r in catalogue.QUERIES["bfs_two_hop"](spark, DATA).collect()} == want


def test_components_of_a_path_with_shuffled_ids(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    assert {r.component for r in graph.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=2)


def test_size_sweep_reaches_the_whole_table(spark):
    ids, labels, x = (np.array(c) for c in zip(*duckdb.sql(f"SELECT vec_id, label, embedding::DOUBLE[] FROM '{DATA}/embeddings.parquet' ORDER BY 1").fetchall()))
    part = np.array([zlib.crc32(str(i).encode()) % 8 for i in ids])
    core = [np.flatnonzero((part < 1) & (labels == k)) for k in np.unique(labels)]
    pairs = [(c[0], c[1]) for c in core if len(c) > 1]
    assert pairs
    want = []
    for share in (1, 2, 4, 8):
        sub = np.flatnonzero(part < share)
        values, vectors = np.linalg.eigh(np.cov(x[sub].T))
        w = (x - x[sub].mean(axis=0)) @ (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-5))) @ vectors.T)
        w /= np.linalg.norm(w, axis=1, keepdims=True) + 1e-9

        def best(q, sub=sub, w=w):
            s = np.round(w[sub] @ w[q] / np.linalg.norm(w[q]) / np.linalg.norm(w[sub], axis=1), 5)
            s[sub == q] = -np.inf
            order = np.lexsort((ids[sub], -s))
            return s[order[0]], sub[order[:10]]

        probes = np.flatnonzero(ids % 100 == 0)
        found = [best(q) for q in probes]
        want.append((len(sub), np.mean([s for s, _ in found]), np.mean([labels[n[0]] == labels[q] for q, (_, n) in zip(probes, found)]), len(pairs), np.mean([t in best(q)[1] for q, t in pairs])))
    got = catalogue.QUERIES["size_sweep"](spark, DATA).orderBy("size").select("size", "coverage", "top1", "n_pairs", "pair_precision").collect()
    assert got[-1].size == len(ids)
    assert np.allclose(np.array(got, float), np.array(want), atol=2e-5), (got, want)


def test_bootstrap_draws_as_many_values_as_there_are(spark):
    x = [r[0] for r in duckdb.sql("SELECT embedding[1]::DOUBLE FROM '/root/testdata/sf0.1/embeddings.parquet'").fetchall()]
    got = catalogue.QUERIES["bootstrap_ci"](spark, "/root/testdata/sf0.1").first()
    assert 0.7 < (got.high - got.low) / (2 * 1.96 * np.std(x) / len(x) ** 0.5) < 1.3
    assert got.low < np.mean(x) < got.high
    few = spark.createDataFrame([(i % 50, float(i)) for i in range(300)] + [(7, None)], "id long, x double")
    draws = evaluate.bootstrap(few, "x", 20, "id").collect()
    assert [r.n for r in draws] == [300] * 20 and len({r.mean for r in draws}) == 20
    assert abs(np.mean([r.mean for r in draws]) - 149.5) < 5
    assert evaluate.bootstrap(few.where("x < 0"), "x", 20, "id").count() == 0


def test_junk_filter_has_the_look_ahead_pattern(spark, tmp_path):
    spark.createDataFrame([(1, "Money Trees x Blinding Lights\nmore"), (2, "Pola (The Geek x VRV Remix)"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.junk for r in catalogue.QUERIES["junk_filter"](spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: False}
