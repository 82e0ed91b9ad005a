import numpy as np
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import graph, late, linear, rank
from kindred.operators.scan import View, top
from kindred.sources import ingest, store
from kindred.streaming import ratings


def vectors(spark, x, labels=None):
    return spark.createDataFrame([(i, int(labels[i]) if labels is not None else 0, [float(v) for v in r]) for i, r in enumerate(x)], "id long, label long, v array<double>")


def test_statistics_come_before_exclusions(spark):
    x = np.random.default_rng(1).normal(size=(40, 6))
    lib = vectors(spark, x, np.arange(40) % 4)
    got = top(lib, lib.where("id = 0").select(F.col("id").alias("query_id"), "label", "v"), 5, [View("cosine", 0, 3, 0.8), View("euclid", 3, 6, 0.2)], standard=True, not_label=True).orderBy("rank").collect()
    cos = x[:, :3] @ x[0, :3] / np.linalg.norm(x[:, :3], axis=1) / np.linalg.norm(x[0, :3])
    euc = 1 / (1 + np.linalg.norm(x[:, 3:] - x[0, 3:], axis=1))
    z = lambda s: (s - s.mean()) / (s.std() + 1e-9)
    b = np.round(0.8 * z(cos) + 0.2 * z(euc), 6)
    want = sorted((i for i in range(40) if i % 4), key=lambda i: (-b[i], i))[:5]
    assert [r.id for r in got] == want


def test_whitening_clips_small_eigenvalues(spark):
    x = np.random.default_rng(2).normal(size=(200, 5))
    x[:, 4] = x[:, 0]  # a zero eigenvalue
    mean, cov, n = linear.covariance(vectors(spark, x), 5)
    assert n == 200 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    w = linear.whitener(cov)
    got = np.array([r.v for r in linear.whitened(vectors(spark, x), 5).orderBy("id").collect()])
    want = (x - x.mean(axis=0)) @ w
    assert np.allclose(got, want / (np.linalg.norm(want, axis=1, keepdims=True) + 1e-9), atol=1e-6)


def test_mmr_is_the_greedy_choice(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4))
    s = np.round(rng.random(30), 6)
    pool = spark.createDataFrame([(0, i, float(s[i])) for i in range(30)], "query_id long, id long, score double")
    got = [r.id for r in rank.mmr(pool, vectors(spark, x), 6, 0.4).orderBy("rank").collect()]
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    rel, chosen = (s - s.min()) / (s.max() - s.min() + 1e-9), []
    while len(chosen) < 6:
        gain = {i: 0.6 * rel[i] - 0.4 * max((u[i] @ u[j] for j in chosen), default=0) for i in range(30) if i not in chosen}
        chosen.append(max(gain, key=gain.get))
    assert got == chosen


def test_diverse_top_fills_up(spark):
    rows = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.7)], "id long, i long, score double")
    assert [r.i for r in late.diverse_top(rows, "id", "i", 3, 2).orderBy("rank").collect()] == [0, 2, 1]


def test_guards_on_titles(spark):
    rows = [("River Stone [slowed]", "", True), ("Paper Lantern (Karaoke Version)", "", True), ("x", "Tribute to Nobody", True), ("Red Kite x Blue Kite x Green Kite", "", True), ("Cold Tea x Warm Rain", "", True), ("Harbour (Cover of Quay)", "", True), ("y", "In the Style of No One", True), ("Run for Cover", "", False), ("Tributes", "", False), ("Dot X Dash", "", False), ("C x D", "", False), ("Mill (The Wheel x ABC Remix)", "", False), ("A Tribute for You", "", False), ("Lamps at Noon (Remastered 1999)", "", False), (None, None, False)]
    df = spark.createDataFrame(rows, "title string, artist string, junk boolean")
    assert df.where(text.is_junk(F.col("title"), F.col("artist")) != F.col("junk")).count() == 0
    pair = spark.createDataFrame([("lighthouse", "lighthuose", True), ("cold tea", "harbour", False), ("", "a", False), ("tea", "cold tea", True), (None, "a", False), ("abcdefgh", "abcdefghijklmnopqrst", True)], "a string, b string, same boolean")
    assert pair.where(text.same_title("a", "b") != F.col("same")).count() == 0


def test_text_keys(spark):
    df = spark.createDataFrame([("Fußweg (Live) - 2011 Remaster", ), ("Blüte feat. X", ), (None,)], "t string").select(text.match_key(text.ascii_fold("t")).alias("k"), text.song_key(F.col("t")).alias("s"))
    assert [tuple(r) for r in df.collect()] == [("fuweg", "fussweg (live) - 2011 remaster"), ("blute", "blüte feat. x"), (None, None)]


def test_catalogue_dedup_keys(spark):
    rows = [(1, "Lamps"), (2, "Lamps - Sped Up"), (3, "Lamps (Remastered 1999)"), (4, "Lamps (feat. A Guest)"), (5, "Another Lamp")]
    df = spark.createDataFrame(rows, "id long, t string").select(text.catalogue_key(F.col("t"), F.lit("Someone")).alias("k"))
    assert df.distinct().count() == 2


def test_seed_parser(spark):
    df = spark.createDataFrame([("Cold Tea - The Kettles; Lamps\nQuay | X; # no",)], "value string")
    assert [(r.title, r.artist) for r in ingest.seeds(df).orderBy("ord").collect()] == [("Cold Tea", "The Kettles"), ("Lamps", None), ("Quay", "X")]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_store_generations_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = vectors(spark, np.eye(4), range(4))
    store.publish(rows, path, 2, 1)
    store.publish(rows.where("id < 2").withColumn("v", F.transform("v", lambda x: x * 2)), path, 2, 2)
    got = {r.id: max(r.v) for r in store.read(spark, path).collect()}
    assert got == {0: 2.0, 1: 2.0, 2: 1.0, 3: 1.0}
    assert store.damage(spark, path).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a", 1, "d1", "2024-01-01 00:00:00"), (1, "a", 1, "d1", "2024-01-01 00:00:00"), (1, "a", 2, "d2", "2024-01-01 00:01:00"), (2, "b", 5, "d3", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "session long, key string, value long, digest string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ratings.stream_merge(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted(tuple(r) for r in ratings.merged(spark, f"{tmp_path}/out").collect())
    assert got == sorted(tuple(r) for r in ratings.merge_sessions(df).collect())
    assert (1, "a", None, 2) in got


def test_empty_library(spark):
    lib = vectors(spark, np.zeros((0, 3)))
    assert top(lib, lib.select(F.col("id").alias("query_id"), "label", "v"), 3).count() == 0


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a": 1}', True), ('{"a": 1, "a": 2}', False), ('{"a": NaN}', False), (None, False)], "s string, ok boolean")
    assert df.where(ingest.strict_json("s") != F.col("ok")).count() == 0
