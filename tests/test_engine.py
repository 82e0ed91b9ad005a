"""The content engine, the command line, readers, stores, streams and plug-in seams."""

import json
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred import cli, config
from kindred.engine import Songs
from kindred.functions import register, text
from kindred.operators import evaluate, late, linear, rank, resolve
from kindred.operators.scan import Guard, top
from kindred.plans import catalogue
from kindred.sources import ingest, npz, store
from kindred.streaming import ratings

DATA = "/root/testdata/sf0.001"
SONGS = [("Still A", "X", 70, 20, 20, 15, 90, 0, 10, 3), ("Still B", "Y", 72, 25, 25, 18, 88, 0, 12, 4), ("Loud A", "Z", 170, 90, 80, 95, 2, 0, 20, 8), ("Loud B", "W", 165, 88, 78, 92, 5, 0, 18, 7), ("Half A", "Q", 120, 55, 50, 55, 40, 0, 15, 5)]


@pytest.fixture
def songs_csv(tmp_path):
    path = tmp_path / "songs.csv"
    head = ["Track", "Artist(s)", "BPM", *(f"{f}_%" for f in config.FEATURES[1:])]
    body = [",".join(map(str, r)) for r in (*SONGS, ("Broken", "V", "n/a", 1, 1, 1, 1, 1, 1, 1))]
    path.write_text("\n".join([",".join(head), *body]) + "\n")
    return str(path)


def test_similar_songs(spark, songs_csv):
    s = Songs.from_csv(spark, songs_csv)
    assert s.rows.count() == 5
    assert [r.title for r in s.similar([("still a", None)], 4).orderBy("rank").collect()][0] == "Still B"
    both = [("Still A", None), ("Loud A", "Z"), ("no such song", None)]
    assert s.similar(both, 1).first().title == "Half A" and s.unmatched(both) == [2]
    cosine = Songs.from_csv(spark, songs_csv, config.Scoring(metric="cosine", weights={"bpm": 2.0}))
    assert cosine.similar([("Loud A", None)], 1).first().title == "Loud B"
    assert s.similar([("no such song", None)], 3).count() == 0
    assert {r.feature: r.top_id for r in s.stats().collect()}["bpm"] == s.rows.where("title = 'Loud A'").first().row
    assert "Still A" not in {r.title for r in s.similar([("Still B", None)], 9, same_artist=False).collect()} - {"Still A"}


def test_configuration():
    assert config.feature(" Tempo ") == "bpm" and config.weights("dance=2, live=0.5") == {"danceability": 2.0, "liveness": 0.5}
    assert config.Scoring(weights={"bpm": 3}).vector() == [3, 1, 1, 1, 1, 1, 1, 1]
    for wrong in ({"features": ()}, {"features": ("x",)}, {"metric": "dot"}, {"weights": {"bpm": -1}}):
        with pytest.raises(ValueError):
            config.Scoring(**wrong)
    with pytest.raises(ValueError):
        config.feature("colour")
    with pytest.raises(ValueError):
        config.weights(["bpm"])


def test_command_line(spark, songs_csv, tmp_path, capsys):
    assert cli.main(["similar", songs_csv, "Still A - X", "-n", "2", "--weight", "tempo=2"], spark) == 0
    assert "Still B" in capsys.readouterr().out
    (tmp_path / "seeds.csv").write_text("name,artist\nLoud A,Z\n,\nnan,\n")
    assert cli.main(["profile", songs_csv, str(tmp_path / "seeds.csv"), "nothing here"], spark) == 0
    out = capsys.readouterr()
    assert "Loud B" in out.out and "not found: nothing here" in out.err
    assert cli.main(["search", songs_csv, "loud"], spark) == 0 and "loud a" in capsys.readouterr().out
    assert cli.main(["stats", songs_csv], spark) == 0 and "bpm" in capsys.readouterr().out
    assert cli.main(["queries"]) == 0 and "knn_cosine" in capsys.readouterr().out
    assert cli.main(["run", "chance_accuracy", DATA, "--out", str(tmp_path / "out")], spark) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert cli.main(["run", "nothing", DATA], spark) == 2


def test_readers_of_small_documents(spark, tmp_path):
    f = tmp_path / "fma.csv"
    f.write_text(',set,track,track,artist\n,subset,genre_top,title,name\ntrack_id,,,,\n2,small,Rock,"One, two",A\n3,medium,,Three,B\n5,large,Pop,Five,C\n7,small,,Seven,D\n9,small,Folk,Nine,E\n')
    there = spark.createDataFrame([(k,) for k in (2, 3, 5, 7)], "track_id long")
    tracks = lambda *a: sorted((r.track_id, r.title, r.genre) for r in ingest.fma_tracks(spark, str(f), there, *a).collect())
    assert tracks() == [(2, "One, two", "Rock")] and tracks("medium", True) == [(2, "One, two", "Rock"), (3, "Three", "unlabeled"), (7, "Seven", "unlabeled")]
    assert tracks("large") == [(2, "One, two", "Rock"), (5, "Five", "Pop")]
    pairs = [{"id": str(k), "split": "held_out" if k % 2 else "development", "scene": "s", "query": {"title": "a", "artist": "b"}, "target": {"title": "c", "artist": "d"}, "evidence_category": "pure_sonic", "deciding_primary": True} for k in range(50)]
    doc = {"benchmark_id": "b", "schema_version": 2, "category_definitions": {"pure_sonic": "x", "scene": "y"}, "pairs": pairs}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    got = ingest.benchmark_pairs(spark, str(tmp_path / "b.json"))
    assert got.count() == 50 and ingest.selected_pairs(got, "held_out", "pure_sonic").count() == 25
    for change in ({"evidence_category": "other"}, {"deciding_primary": False}):
        (tmp_path / "c.json").write_text(json.dumps(doc | {"pairs": [pairs[0] | change, *pairs[1:]]}))
        with pytest.raises(ValueError):
            ingest.benchmark_pairs(spark, str(tmp_path / "c.json"))
    (tmp_path / "d.json").write_text(json.dumps(doc | {"pairs": pairs[:9]}))
    with pytest.raises(ValueError):
        ingest.benchmark_pairs(spark, str(tmp_path / "d.json"))


def test_readers_of_folders(spark, tmp_path):
    cache = tmp_path / "cache" / "deep"
    cache.mkdir(parents=True)
    for name, body in (("dz_a b.json", '{"names": ["c", ""]}'), ("dz_broken.json", "{"), ("other.json", '{"names": ["no"]}')):
        (tmp_path / "cache" / name).write_text(body)
    assert [tuple(r) for r in ingest.related_cache(spark, str(tmp_path / "cache")).collect()] == [("a b", "c")]
    (cache / "x.json").write_text("[]")
    assert ingest.json_files(spark, str(tmp_path / "cache")).count() == 4
    replay = tmp_path / "replay.json"
    replay.write_text('{"version": "v6", "scope": "s", "track_id": 1, "score": 0.5}\n{"version": "v5", "scope": "s", "track_id": 2}\n')
    assert ingest.labelled_replay(spark, str(replay), "v6", "s").first().track_id == 1
    for args in (("v7", "s"), ("v6", "t"), ("v6", "s", 10)):
        with pytest.raises(ValueError):
            ingest.labelled_replay(spark, str(replay), *args)
    assert ingest.first_existing(spark, str(tmp_path / "none"), str(replay)) == str(replay)
    with pytest.raises(FileNotFoundError):
        ingest.first_existing(spark, str(tmp_path / "none"))
    split = tmp_path / "split-0"
    split.mkdir()
    (split / "autotagging-train.tsv").write_text("TRACK_ID\tARTIST_ID\ntrack_0000001\tartist_1\ntrack_0000002\tartist_2\n")
    (split / "autotagging-test.tsv").write_text('TRACK_ID\tARTIST_ID\ntrack_0000003\tartist_2\n')
    parts = ingest.split_parts(spark, str(tmp_path))
    assert sorted((r.fold, r.part, r.track_id) for r in parts.collect()) == [(0, "test", 3), (0, "train", 1), (0, "train", 2)]
    assert [r.artist for r in ingest.fold_violations(parts).collect()] == ["artist_2"]
    markers = spark.createDataFrame([(2, 30, ["a", "b"])], "files long, bytes long, paths array<string>")
    files = spark.createDataFrame([("a", 10), ("c", 10)], "path string, size long")
    assert sorted(tuple(r) for r in ingest.marker_problems(markers, files).collect()) == [("b", "yes", "no"), ("bytes", "30", "20"), ("c", "no", "yes")]


def test_collection_problems(spark, tmp_path):
    """Every check of the strict tables names the row that fails it."""
    good = "track_0000001\tartist_000011\talbum_000021\t01/1.mp3\t31.5\tgenre---rock"
    bad = [good.replace("0000001", "0000002").replace("01/1", "../1"), good.replace("0000001", "0000003").replace("31.5", "-1"), good.replace("0000001", "0000004").replace("01/1", "01/4").replace("genre", "style"), good.replace("0000001", "x"), "track_0000006\tartist_1\talbum_1\t01/6.mp3\t9"]
    (tmp_path / "raw.tsv").write_text("\n".join(["\t".join(ingest.TRACK_HEADER), good, *bad]) + "\n")
    got = ingest.collection_tracks(spark, str(tmp_path / "raw.tsv"))
    assert sorted((r.problem or "") for r in got.collect()) == sorted(["colliding path", "unsafe path", "impossible duration", "malformed tags", "malformed id", "short row"])
    (tmp_path / "odd.tsv").write_text("A\tB\n")
    with pytest.raises(ValueError):
        ingest.collection_tracks(spark, str(tmp_path / "odd.tsv"))
    line = 'track_0000001\tartist_1\talbum_2\tA "title\t\tName\tAlbum\t2000-01-01\thttp://www.jamendo.com/track/1'
    (tmp_path / "meta.tsv").write_text("\n".join(["\t".join(ingest.DESCRIPTIVE_HEADER), line, line.replace("0000001", "0000002")]) + "\n")
    rows = {r.track_id: r for r in ingest.collection_titles(spark, str(tmp_path / "meta.tsv")).collect()}
    assert (rows[1].title, rows[1].artist, rows[1].problem) == ('A "title', "Name", None) and rows[2].problem == "other URL"


def test_npz_archives(spark, tmp_path):
    path = f"{tmp_path}/a.npz"
    np.savez(path, ids=np.arange(10), name=np.array([f"n{k}é" for k in range(10)]), v=np.arange(20).reshape(10, 2).astype(np.float16), cube=np.arange(60).reshape(10, 2, 3))
    spark.dataSource.register(npz.NpzSource)
    df = spark.read.format("npz").schema("ids long, name string, v array<float>, cube array<array<long>>, gone double").option("path", path).option("rows_per_part", 3).load()
    rows = df.orderBy("ids").collect()
    assert [r.name for r in rows] == [f"n{k}é" for k in range(10)] and rows[4].v == [8.0, 9.0] and rows[1].cube == [[6, 7, 8], [9, 10, 11]] and rows[0].gone is None
    assert df.rdd.getNumPartitions() == 4
    np.savez(path, ids=np.arange(3), v=np.arange(2))
    with pytest.raises(Exception, match="unequal length"):
        npz.load(spark, path, "ids long, v long").count()


def vectors(spark, n=40, d=4, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, i % 4, [float(y) for y in r]) for i, r in enumerate(x)], "id long, label long, v array<double>")


def test_store_finds_damage(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    x, rows = vectors(spark)
    planned = store.plan(rows, 10)
    store.publish(rows.where("id < 20"), path, 10, 1, planned)
    with pytest.raises(ValueError):
        store.publish(rows.where("id >= 30"), path, 10, 2, planned)  # not the next
    with pytest.raises(ValueError):
        store.publish(rows.where("id < 10"), path, 10, 2, planned)  # done already
    store.publish(rows.where("id >= 20"), path, 10, 2, planned)
    assert store.read(spark, path).count() == 40 and [r.id for r in store.read(spark, path, [13], 10).collect()] == [13]
    read = store.read(spark, path, [13], 10)
    assert all("shard_start=10" in f for f in read.inputFiles())
    assert store.damage(spark, path).count() == store.lost(spark, path).count() == store.orphans(spark, path).count() == 0
    shard = f"{tmp_path}/store/generation=1/shard_start=0"
    pdf = pd.read_parquet(shard)
    pdf["v"] = [[*v[:-1], v[-1] + 1] if k == 0 else v for k, v in enumerate(pdf["v"])]
    for f in (tmp_path / "store/generation=1/shard_start=0").iterdir():
        f.unlink()
    for f in (tmp_path / "store/generation=1/shard_start=0").iterdir():
        f.unlink()
    pdf.iloc[:-1].to_parquet(f"{shard}/x.parquet")
    assert [r.id for r in store.damage(spark, path).collect()] == [int(pdf.iloc[0].id)]
    assert [tuple(r) for r in store.lost(spark, path).collect()] == [(0, 10, 9)]
    rows.where("id < 5").withColumn("sha256", F.lit("")).withColumn("shard_start", F.lit(70)).write.partitionBy("shard_start").parquet(f"{path}/generation=3")
    assert [tuple(r) for r in store.orphans(spark, path).collect()] == [(3, 70)]
    odd = spark.createDataFrame([(1, [1.0]), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, 2.0])], "id long, v array<double>")
    assert {r.id: r.problem for r in store.vector_problems(odd, 2).collect()} == {1: "other width", 2: "zero", 3: "not finite"}


def test_guards_inside_the_pass(spark):
    """Many batches and tasks, keys and caps: as a plain loop."""
    x, lib = vectors(spark, 300, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = top(lib.repartition(5), lib.where("id < 2").select(F.col("id").alias("query_id"), "label", "v"), 6, guard=Guard(lambda i, l: l * 1000 + i // 8, 2)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in (0, 1):
        s = np.round(x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q]), 6)
        seen, labels, want = set(), {}, []
        for i in sorted(range(300), key=lambda i: (-s[i], i)):
            key = (i % 4, i // 8)
            if i == q or key in seen or labels.get(i % 4, 0) == 2:
                continue
            seen.add(key)
            labels[i % 4] = labels.get(i % 4, 0) + 1
            want.append(i)
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want[:6]


def test_projection_is_principal_components(spark):
    x, lib = vectors(spark, 60, 5)
    got = np.array([[r.c0, r.c1] for r in linear.projected(lib, 5).orderBy("id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0))
    want = (x - x.mean(axis=0)) @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want))


def test_title_variants(spark):
    rows = {r.row: r.t for r in catalogue.QUERIES["title_variants"].__globals__["songs"](spark, DATA).select("row", text.bench_key(text.ascii_fold("title")).alias("t")).collect()}
    seeds = {t for k, t in rows.items() if k % 500 == 0}

    def same(a, b):
        return bool(a and b) and (a in b or b in a or (min(len(a), len(b)) >= 8 and SequenceMatcher(None, a, b).ratio() >= 0.9))

    got = {(r.row, r.seed) for r in catalogue.QUERIES["title_variants"](spark, DATA).collect()}
    assert got == {(k, s) for k, t in rows.items() for s in seeds if same(s, t)}


def test_short_and_wrong_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0, 5.0],)], "v array<double>")
    assert [r[0] for r in df.select(late.fit_frames(F.col("v"), 3)).collect()] == [[1.0, 2.0, 0.0], [2.0, 3.0, 4.0]]
    assert [len(r[0]) for r in df.select(late.window_values(F.col("v"), 4, 2)).collect()] == [1, 2]
    for policy, rows in (("reject", df), ("repeat", spark.createDataFrame([([],)], "v array<double>"))):
        with pytest.raises(Exception, match="array is"):
            rows.select(late.window_values(F.col("v"), 4, 2, policy)).collect()
    with pytest.raises(ValueError):
        late.padded(F.col("v"), 3, "mirror")
    t = np.arange(4000) / 8000
    tone = late.signal_features(pd.Series([np.sin(2 * np.pi * 440 * t), []]), 8000)
    assert abs(tone.rms[0] - 2**-0.5) < 1e-3 and abs(tone.centroid[0] - 440) < 5 and np.argmax(tone.bands[0]) == 2 and tone.rms.isna()[1]


def test_functions_in_sql_and_seams(spark):
    register.register(spark)
    assert spark.sql("SELECT ascii_fold('É') a, full_casefold('ß') b, round(title_ratio('abcd', 'abce'), 2) c").first()[:] == ("e", "ss", 0.75)
    spark.createDataFrame([(1, 2), (1, 0), (2, 1)], "g int, r int").createOrReplaceTempView("_ranks")
    assert {r.g: r.m for r in spark.sql("SELECT g, mean_reciprocal(r) m FROM _ranks GROUP BY g").collect()} == {1: 0.25, 2: 1.0}

    def analyse(s):
        return pd.DataFrame({"n": [len(x) for x in s], "first": [x[0] for x in s]})

    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, "c")], "id long, s string")
    assert sorted(tuple(r) for r in register.analysed(df, analyse, "s", "n long, first string").collect()) == [(1, 2, "a"), (2, None, None), (3, 1, "c")]
    assert [r.v for r in register.encoded(df, lambda: lambda b: b.map(lambda x: [float(len(x))]), "s").orderBy("id").collect()] == [[2.0], [0.0], [1.0]]


def test_windows_on_a_stream(spark, tmp_path):
    """Rows out of order inside the delay count; rows behind the watermark do not."""
    def rows(*xs):
        return spark.createDataFrame(xs, "t string, kind string, value double, rater long").select(F.col("t").cast("timestamp").alias("ts"), "kind", "value", "rater")

    files = [rows(("2024-01-01 10:05:00", "a", 1.0, 1)), rows(("2024-01-01 12:30:00", "a", 2.0, 1)), rows(("2024-01-01 10:50:00", "a", 4.0, 1), ("2024-01-01 12:01:00", "a", 8.0, 1)), rows(("2024-01-01 20:00:00", "a", 16.0, 1))]
    src, out = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()

    def run():
        s = spark.readStream.schema(files[0].schema).parquet(str(src))
        q = ratings.activity(s, "1 hour", delay="30 minutes").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination()

    for f in files:
        f.coalesce(1).write.mode("append").parquet(str(src))
        run()
    got = sorted((str(r.start), r.n, r.value) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 10:00:00", 1, 1.0), ("2024-01-01 12:00:00", 2, 10.0)]  # 10:50 came behind 12:30 less 30 minutes


def test_stateful_sessions_and_harvest(spark, tmp_path):
    rows = [(1, "a", 1), (1, "b", 2), (2, "a", 5), (1, "a", 1), (1, "a", 9)]
    src = tmp_path / "in"
    for r in rows:
        spark.createDataFrame([r], "session long, key string, value long").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("session long, key string, value long").option("maxFilesPerTrigger", 1).parquet(str(src))
    seen = []
    q = ratings.stream_sessions(stream).writeStream.outputMode("update").foreachBatch(lambda b, e: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp1").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {s: (k, c) for s, k, c in seen}
    assert last == {1: (2, 1), 2: (1, 0)}
    out = f"{tmp_path}/harvest"
    for _ in range(2):  # resumed, and nothing is new
        ratings.harvest(stream.select("key"), out, f"{tmp_path}/cp2", "key").awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b"]
    spark.createDataFrame([(3, "c", 1), (3, "a", 1)], "session long, key string, value long").write.mode("append").parquet(str(src))
    ratings.harvest(stream.select("key"), out, f"{tmp_path}/cp2", "key").awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_late_and_repeated_snapshots_change_nothing(spark, tmp_path):
    """A redelivery long after the watermark is appended again, and counted once."""
    def put(*xs):
        spark.createDataFrame(xs, "session long, key string, value long, digest string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    schema = "session long, key string, value long, digest string, ts timestamp"
    for xs in ([(1, "a", 1, "d1", "2024-01-01 00:00:00")], [(2, "b", 2, "d2", "2024-01-09 00:00:00")], [(1, "a", 1, "d1", "2024-01-01 00:00:00"), (2, "b", 2, "d2", "2024-01-09 00:00:00")]):
        put(*xs)
        ratings.stream_merge(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(tuple(r) for r in ratings.merged(spark, f"{tmp_path}/out").collect()) == [(1, "a", 1, 1), (2, "b", 2, 1)]


def test_judgments_need_the_same_pairs(spark):
    a = spark.createDataFrame([(1, "s", 0.5), (2, "s", 1.0)], "pair_id long, scene string, contribution double")
    j = spark.createDataFrame([(1, True, False)], "pair_id long, baseline_pass boolean, winner_pass boolean")
    with pytest.raises(ValueError):
        evaluate.judged(a, a, j)
    got = evaluate.judged(a.where("pair_id = 1"), a.where("pair_id = 1"), j).first()
    assert (got.base, got.test) == (0.75, 0.25)


def test_artists_that_match(spark):
    rows = [(["a b"], ["a b"], "x", "y", True), ([], [], "lamp", "lampost", True), ([], [], "lam", "lampost", False), ([], [], "lamps", "lampo", False), ([], [], "lampsy", "lamps z", True), ([], [], "", "x", False)]
    df = spark.createDataFrame(rows, "t array<string>, u array<string>, p string, q string, ok boolean")
    assert df.where(resolve.artists_match(F.col("t"), F.col("u"), F.col("p"), F.col("q")) != F.col("ok")).count() == 0


def test_pool_union_keeps_the_first(spark):
    parts = [spark.createDataFrame([(1, "a"), (2, "a")], "id long, x string"), spark.createDataFrame([(2, "b"), (3, "b")], "id long, x string")]
    assert sorted(tuple(r) for r in rank.keyed_union(parts, "id").collect()) == [(1, "a"), (2, "a"), (3, "b")]


def test_answers_of_services(spark, tmp_path):
    from kindred.sources import services

    def put(folder, **files):
        (tmp_path / folder).mkdir(exist_ok=True)
        for name, body in files.items():
            (tmp_path / folder / f"{name.replace('_', '-')}.json").write_text(body if isinstance(body, str) else json.dumps(body))
        return str(tmp_path / folder)

    song = {"id": 1, "title": "Lamp", "preview": "", "artist": {"id": 9, "name": "A"}}
    at = put("cat", a={"data": [song, {"id": None, "title": "x"}]}, b={"data": [song | {"title": "Late"}, {"id": 2, "title": "Quay"}]}, c={"error": {"code": 4, "message": "quota"}}, d="{", artist_7={"data": [{"id": 8, "name": "n"}]})
    assert sorted(tuple(r) for r in services.catalogue_tracks(spark, at).collect()) == [(1, "Lamp", "A", 9, None), (2, "Quay", "", None, None)]
    assert sorted((r.path[-6:], r.again) for r in services.refused(spark, at).collect()) == [("c.json", True), ("d.json", False)] or sorted((r.path.rsplit("/", 1)[1], r.again) for r in services.refused(spark, at).collect()) == [("c.json", True), ("d.json", False)]
    assert [tuple(r) for r in services.related_artists(spark, at).collect()] == [(7, 8)]
    t = {"id": "x", "name": "S", "uri": "u", "artists": [{"id": "1", "name": "A"}, {"id": "2", "name": None}, {"id": "3", "name": "B"}]}
    pages = {"0": {"items": [{"track": t}], "next": "http://h/?offset=50"}, "50": {"items": [t, {"id": None}], "next": "http://h/?offset=100"}}
    (tmp_path / "lib").mkdir()
    for name, body in pages.items():
        (tmp_path / "lib" / f"{name}.json").write_text(json.dumps(body))
    assert [tuple(r) for r in services.library_tracks(spark, str(tmp_path / "lib")).collect()] == [("x", "S", "A, B", "A")]
    assert [r.next for r in services.open_pages(spark, str(tmp_path / "lib")).collect()] == ["http://h/?offset=100"]
    at = put("sim", a={"similartracks": {"track": [{"name": "T", "match": "0.5", "artist": {"name": "A"}}, {"name": "U", "match": "?"}, {"name": ""}]}}, b={"error": 6, "message": "none"})
    assert sorted(tuple(r)[1:] for r in services.similar_tracks(spark, at).collect()) == [("T", "A", 0.5), ("U", "", 0.0)]
    at = put("truth", t={"rows": [{"title": "T", "artist": "A", "listenbrainz": ["B", "C"], "deezer": []}]})
    assert sorted((r.source, r.query_id, r.artist) for r in services.truth(spark, f"{at}/t.json").collect()) == [("listenbrainz", 0, "B"), ("listenbrainz", 0, "C")]


def test_files_and_figures(spark, tmp_path):
    import base64
    import hashlib
    import wave

    from kindred.sources import services

    x = (np.sin(np.arange(800) / 5) * 30000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.stack((x, x), axis=1).tobytes())
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    rows = {r.path[-5:]: r for r in services.waveforms(spark, str(tmp_path), 0.05).collect()}
    assert rows["a.wav"].rate == 8000 and np.allclose(rows["a.wav"].samples, x[:400] / 32768) and rows["b.wav"].samples is None and rows["b.wav"].problem
    tracks = spark.createDataFrame([(k, f"u{k}") for k in range(1, 251)], "position long, uri string")
    assert [(r.batch, len(r.uris), r.uris[0]) for r in services.playlist_requests(tracks).orderBy("batch").collect()] == [(0, 100, "u1"), (1, 100, "u101"), (2, 50, "u201")]
    pts = spark.createDataFrame([(float(k), 2.0 * k, "s") for k in range(100)] + [(None, 1.0, "s")], "x double, y double, s string")
    got = services.figure_points(pts, "x", "y", "s", 10).collect()
    assert len(got) == 10 and sum(r.n for r in got) == 100 and all(abs(r.y - 2 * r.x) < 1e-9 for r in got)
    files = spark.createDataFrame([("a", "hello\n"), ("b", "x"), ("c", "y")], "path string, content string")
    blob = lambda b: hashlib.sha1(f"blob {len(b)}\0".encode() + b).hexdigest()
    index = spark.createDataFrame([("a", blob(b"hello\n")), ("b", blob(b"other")), ("d", "0")], "path string, blob string")
    assert sorted(tuple(r) for r in services.provenance_problems(files, index).collect()) == [("b", "changed"), ("c", "not in the index"), ("d", "missing")]
    want = base64.urlsafe_b64encode(hashlib.sha256(b"verifier").digest()).rstrip(b"=").decode()
    assert spark.range(1).select(services.challenge(F.lit("verifier"))).first()[0] == want
    flat = late.mel_target(pd.Series([np.zeros((32, 9)).tolist()]))[0]
    assert len(flat) == 10 and abs(sum(flat[:7]) - 1) < 1e-6 and flat[7] == flat[8] == 0


def test_rows_are_numbered_in_order(spark):
    ids = list(np.random.default_rng(3).permutation(5000))
    df = spark.createDataFrame([(int(i), "x") for i in ids], "k long, n string").repartition(7)
    got = {r.k: r.at for r in ingest.numbered(df, "k", "at").collect()}
    assert got == {k: k for k in range(5000)}
    assert ingest.numbered(df.where("false"), "k", "at").count() == 0
