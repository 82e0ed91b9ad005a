"""Readers and validators (SC1-SC7, SC12-SC20, SC23-SC26, SC34, SC35, SK2, SK4, PF17, PF18, PF20, PF21, CN1, J13-J15)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators between title and artist, in the order they are tried.
SEPARATORS = (" - ", " – ", " — ", "|", "\t")


def read_songs(spark: SparkSession, path: str, aliases: dict[str, str], features: list[str]) -> DataFrame:
    """SC1: CSV with header aliases; features become doubles, rows without one are dropped."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumnsRenamed({c: aliases[c.strip().lower()] for c in raw.columns if c.strip().lower() in aliases})
    missing = [c for c in ["title", *features] if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if "artist" not in raw.columns:
        raw = raw.withColumn("artist", F.lit(""))
    typed = raw.withColumns({f: F.expr(f"try_cast(`{f}` as double)") for f in features})
    return typed.dropna(subset=features).fillna({"artist": ""})


def seeds(lines: DataFrame, column: str = "value") -> DataFrame:
    """SC3: `;` or newline separated seeds, # comments; title and artist split at the first separator kind found."""
    parts = lines.select(F.posexplode(F.split(column, "[;\n\r]")).alias("ord", "seed"))
    parts = parts.select("ord", F.trim("seed").alias("seed")).where((F.length("seed") > 0) & ~F.startswith("seed", F.lit("#")))
    return parts.select("ord", *split_pair(F.col("seed")))


def split_pair(c: Column) -> tuple[Column, Column]:
    title, artist = c, F.lit(None).cast("string")
    for sep in reversed(SEPARATORS):
        has = F.instr(c, sep) > 0
        title = F.when(has, F.trim(F.substring_index(c, sep, 1))).otherwise(title)
        artist = F.when(has, F.trim(F.substring(c, F.instr(c, sep) + len(sep), F.length(c)))).otherwise(artist)
    return title.alias("title"), artist.alias("artist")


def tracks_of(df: DataFrame) -> DataFrame:
    """CN1: id, title, artists joined, first artist; rows without id are dropped."""
    names = F.filter(F.transform("artists", lambda a: a["name"]), lambda n: n.isNotNull())
    return df.where(F.col("id").isNotNull()).select("id", F.col("name").alias("title"), F.array_join(names, ", ").alias("artist"), F.try_element_at(names, F.lit(1)).alias("primary_artist"))


def licenses(spark: SparkSession, path: str) -> DataFrame:
    """SC16: blank-line separated blocks of three lines: name, URL, id; flags from the URL."""
    block = spark.read.option("lineSep", "\n\n").text(path)
    line = F.split(F.trim("value"), "\n")
    url = F.get(line, F.lit(1))
    return block.where(F.length(F.trim("value")) > 0).select(F.get(line, F.lit(0)).alias("name"), url.alias("url"), F.get(line, F.lit(2)).alias("track"), (~F.contains(url, F.lit("/by-nc"))).alias("commercial"), (~F.contains(url, F.lit("-nd"))).alias("derivatives"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SC17: `sha256  path` lines."""
    v = F.col("value")
    return spark.read.text(path).where(v.rlike(r"^[0-9a-f]{64}\s+\S")).select(F.regexp_extract(v, r"^([0-9a-f]{64})", 1).alias("sha256"), F.regexp_extract(v, r"^[0-9a-f]{64}\s+\*?(.+)$", 1).alias("path"))


def case_collisions(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(F.lower("path").alias("folded")).agg(F.countDistinct("path").alias("n")).where(F.col("n") > 1)


def missing_and_extra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """J14 / SC18: keys that one side lacks."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full").where(F.col("_a").isNull() | F.col("_b").isNull()).select(key, F.when(F.col("_a").isNull(), "extra").otherwise("missing").alias("state"))


def fold_violations(folds: DataFrame) -> DataFrame:
    """SC19: artists in several parts of a fold."""
    return folds.groupBy("fold", "artist").agg(F.countDistinct("part").alias("parts")).where(F.col("parts") > 1)


def assert_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {found}")


def unique_json_keys(pairs: list) -> dict:
    """SC25: object hook that refuses repeated keys."""
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"repeated key {k}")
        out[k] = v
    return out


@F.pandas_udf(T.BooleanType())
def strict_json(s: pd.Series) -> pd.Series:
    """SC25: parses with unique keys and finite numbers; null does not."""
    import json

    def refuse(x):
        raise ValueError(x)

    def ok(x) -> bool:
        try:
            json.loads(x or "", object_pairs_hook=unique_json_keys, parse_constant=refuse)
        except ValueError:
            return False
        return True

    return s.map(ok).astype(bool)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """SC2, SC33: the first of the paths that is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def with_keys(songs: DataFrame) -> DataFrame:
    """SC1: primary artist (before ` . `), title and artist keys, and the key that tells repeats."""
    from ..functions.text import song_key

    first = F.trim(F.substring_index("artist", " . ", 1))
    rows = songs.withColumn("primary_artist", first).withColumn("title_key", song_key(F.col("title"))).withColumn("artist_key", song_key(F.col("primary_artist")))
    return rows.withColumn("dedup_key", F.concat_ws(" :: ", "title_key", "artist_key"))


def seed_table(spark: SparkSession, path: str) -> DataFrame:
    """SC4: (title, artist) of a CSV whose header calls them title / track / name and artist(s); rows without title are skipped."""
    raw = spark.read.option("header", True).csv(path)
    named = {c.strip().lower(): c for c in reversed(raw.columns)}
    pick = lambda *names: next((F.trim(F.col(f"`{named[n]}`")) for n in names if n in named), None)
    title, artist = pick("title", "track", "name"), pick("artist", "artist(s)", "artists")
    if title is None:
        raise ValueError("a seed table has a column title, track or name")
    rows = raw.select(title.alias("title"), (F.lit(None).cast("string") if artist is None else F.nullif(artist, F.lit(""))).alias("artist"))
    return rows.where((F.length("title") > 0) & (F.lower("title") != "nan"))


#: SC5: what stands between title and artist in a query, in the order it is tried.
QUERY_SEPARATORS = (" — ", " – ", " :: ", " - ", " by ")


def text_query(q: Column) -> tuple[Column, Column]:
    """SC5: (title, artist); the artist is empty where nothing separates."""
    q = F.trim(F.coalesce(q, F.lit("")))
    title, artist = q, F.lit("")
    for sep in reversed(QUERY_SEPARATORS):
        at = F.instr(q, sep)
        title = F.when(at > 0, F.trim(F.substring(q, F.lit(1), at - 1))).otherwise(title)
        artist = F.when(at > 0, F.trim(F.substring(q, at + len(sep), F.length(q)))).otherwise(artist)
    return title.alias("title"), artist.alias("artist")


#: SC6: where links and URIs of two services hold a track's id.
LINKS = {"spotify": (r"open\.spotify\.com/track/([A-Za-z0-9]+)", r"spotify:track:([A-Za-z0-9]+)"), "deezer": (r"deezer\.com/(?:[a-z]{2}/)?track/(\d+)",)}


def share_link(q: Column) -> tuple[Column, Column]:
    """SC6: (service, track id) of a link, else ("text", null)."""
    service, track = F.lit("text"), F.lit(None).cast("string")
    for name, patterns in reversed(LINKS.items()):
        for p in reversed(patterns):
            found = F.regexp_extract(q, p, 1)
            service, track = F.when(found != "", name).otherwise(service), F.when(found != "", found).otherwise(track)
    return service.alias("service"), track.alias("track")


def json_library(spark: SparkSession, path: str) -> DataFrame:
    """SC7: the entries of one JSON document {feature_names, entries: [{track_id, title, artist, features}]}."""
    schema = "feature_names array<string>, entries array<struct<track_id:bigint,title:string,artist:string,features:array<double>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("entries"))


def write_json_library(rows: DataFrame, names: list[str], path: str) -> None:
    """SK2: rows (track_id, title, artist, features) as JSON lines of libraries, one per part, which json_library reads back."""
    part = rows.groupBy(F.spark_partition_id().alias("_p")).agg(F.collect_list(F.struct("track_id", "title", "artist", "features")).alias("entries"))
    part.select(F.array(*[F.lit(n) for n in names]).alias("feature_names"), "entries").write.json(path)


#: SC12: columns of a track manifest.
MANIFEST = "track_id bigint, title string, artist string, genre string, preview_url string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SC12."""
    return spark.read.schema(MANIFEST).option("header", True).option("escape", '"').csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """SK4: CSV with a header, quotes doubled."""
    rows.write.option("header", True).option("escape", '"').csv(path)


def fma_tracks(spark: SparkSession, path: str, files: DataFrame, subset: str = "small", unlabelled: bool = False) -> DataFrame:
    """SC13: tracks of a CSV with two header lines (group, name), of a subset and all smaller ones, whose file is there.

    files (track_id); tracks without genre are left out or get `unlabeled`.
    """
    lines = spark.read.text(path).limit(3).collect()  # two header lines and the name of the id
    top, names = (x.value.split(",") for x in lines[:2])
    raw = spark.read.schema(", ".join(f"c{k} string" for k in range(len(top)))).option("escape", '"').csv(path).where(F.col("c0").rlike(r"^\d+$"))
    col = {(g.strip(), n.strip()): F.col(f"c{k}") for k, (g, n) in enumerate(zip(top, names, strict=True))}
    # The subsets, each with all before it.
    order = F.array(F.lit("small"), F.lit("medium"), F.lit("large"))
    rank = F.array_position(order, col["set", "subset"])
    genre = F.nullif(col["track", "genre_top"], F.lit(""))
    keep = (rank > 0) & (rank <= F.array_position(order, F.lit(subset)))
    rows = raw.where(keep & (F.lit(unlabelled) | genre.isNotNull()))
    rows = rows.select(F.col("c0").cast("long").alias("track_id"), col["track", "title"].alias("title"), col["artist", "name"].alias("artist"), F.coalesce(genre, F.lit("unlabeled")).alias("genre"))
    return rows.join(files.select("track_id").distinct(), "track_id", "left_semi")


def repaired(line: Column) -> Column:
    """SC15: fields of a descriptive line; of nine with an empty fifth, that one is dropped."""
    f = F.split(line, "\t")
    return F.when((F.size(f) == 9) & (F.get(f, F.lit(4)) == ""), F.concat(F.slice(f, 1, 4), F.slice(f, 6, 4))).otherwise(f)


def _body(spark: SparkSession, path: str, header: tuple[str, ...]) -> DataFrame:
    """Lines of a TSV file without its header, which must be as told."""
    lines = spark.read.text(path)
    if lines.where(F.col("value") == "\t".join(header)).isEmpty():
        raise ValueError(f"{path}: another header than {', '.join(header)}")
    return lines.where(F.col("value") != "\t".join(header))


#: SC14, SC15, PF20: headers and shapes of a collection's tables.
TRACK_HEADER = ("TRACK_ID", "ARTIST_ID", "ALBUM_ID", "PATH", "DURATION", "TAGS")
DESCRIPTIVE_HEADER = ("TRACK_ID", "ARTIST_ID", "ALBUM_ID", "TRACK_NAME", "ARTIST_NAME", "ALBUM_NAME", "RELEASEDATE", "URL")
TAG = r"^(?:genre|instrument|mood/theme)---\S.*$"


def _id(c: Column, kind: str) -> Column:
    return F.regexp_extract(c, rf"^{kind}_(\d+)$", 1).try_cast("bigint")


def collection_tracks(spark: SparkSession, path: str) -> DataFrame:
    """SC14: (track_id, artist_id, album_id, path, duration, tags, problem) of a TSV whose tags fill all columns from the sixth on.

    problem names the first check that a row fails, null if none: it is the table of violations as well.
    """
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    rows = _body(spark, path, TRACK_HEADER).select(
        _id(at(0), "track").alias("track_id"), _id(at(1), "artist").alias("artist_id"), _id(at(2), "album").alias("album_id"), at(3).alias("path"),
        at(4).try_cast("double").alias("duration"), F.array_sort(F.slice(f, 6, F.greatest(F.size(f) - 5, F.lit(0)))).alias("tags"), F.size(f).alias("_n"),
    )
    one = Window.partitionBy("track_id")
    same = Window.partitionBy(F.lower("path"))
    checks = [
        (F.col("_n") < 6, "short row"), (F.col("track_id").isNull() | F.col("artist_id").isNull() | F.col("album_id").isNull(), "malformed id"),
        (~safe_path(F.col("path")) | (F.size(F.split("path", "/")) != 2) | ~F.lower("path").endswith(".mp3"), "unsafe path"),
        (F.coalesce(F.isnan("duration") | (F.col("duration") <= 0) | (F.col("duration") > 86_400), F.lit(True)), "impossible duration"),
        (~valid_tags(F.col("tags")), "malformed tags"), (F.count("*").over(one) > 1, "repeated track"), (F.count("*").over(same) > 1, "colliding path"),
    ]
    return rows.withColumn("problem", _first_problem(checks)).drop("_n")


def _first_problem(checks: list) -> Column:
    out = F.lit(None).cast("string")
    for wrong, name in reversed(checks):
        out = F.when(wrong, name).otherwise(out)
    return out


def collection_titles(spark: SparkSession, path: str) -> DataFrame:
    """SC15: (track_id, artist_id, album_id, title, artist, album, released, url, problem); tabs separate, quotes mean nothing."""
    f = repaired(F.col("value"))
    at = lambda k: F.get(f, F.lit(k))
    rows = _body(spark, path, DESCRIPTIVE_HEADER).select(
        _id(at(0), "track").alias("track_id"), _id(at(1), "artist").alias("artist_id"), _id(at(2), "album").alias("album_id"),
        at(3).alias("title"), at(4).alias("artist"), at(5).alias("album"), at(6).alias("released"), at(7).alias("url"), F.size(f).alias("_n"),
    )
    url = F.concat(F.lit(r"^https?://(?:www\.)?jamendo\.com/track/"), F.col("track_id").cast("string"), F.lit("/*$"))
    checks = [
        (F.col("_n") != 8, "other columns"), (F.col("track_id").isNull() | F.col("artist_id").isNull() | F.col("album_id").isNull(), "malformed id"),
        ((F.col("title") == "") | (F.col("artist") == ""), "no title or artist"), (~F.regexp_like(F.col("url"), url), "other URL"), (F.count("*").over(Window.partitionBy("track_id")) > 1, "repeated track"),
    ]
    return rows.withColumn("problem", _first_problem(checks)).drop("_n")


def safe_path(c: Column) -> Column:
    """PF18: relative, no empty, `.` or `..` parts, no backslash, drive or control character."""
    parts = F.split(c, "/")
    return F.coalesce((F.length(c) > 0) & ~c.rlike(r"[\\:\x00-\x1F]") & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def valid_tags(tags: Column) -> Column:
    """PF20: some tags, none twice, each a scene and a name."""
    return F.coalesce((F.size(tags) > 0) & (F.size(tags) == F.size(F.array_distinct(tags))) & F.forall(tags, lambda t: t.rlike(TAG)), F.lit(False))


def scene_of_tag(tag: Column) -> Column:
    """PF20: what stands before `---`."""
    return F.when(tag.rlike(TAG), F.substring_index(tag, "---", 1))


def split_parts(spark: SparkSession, folder: str) -> DataFrame:
    """SC19: (fold, part, track_id, artist) of split-<fold>/<name>-<part>.tsv files."""
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tsv").csv(folder)
    at = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(at, r"split-(\d+)/", 1).cast("int").alias("fold"), F.regexp_extract(at, r"-([a-z]+)\.tsv$", 1).alias("part"), _id(F.col("TRACK_ID"), "track").alias("track_id"), F.col("ARTIST_ID").alias("artist"))


def marker_problems(markers: DataFrame, files: DataFrame) -> DataFrame:
    """SC18: (what, told, found) where a completion marker (files, bytes, paths) and the files (path, size) differ."""
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    sums = markers.select("files", "bytes").crossJoin(found)  # one row each
    sums = sums.select(F.inline(F.array(F.struct(F.lit("files").alias("what"), F.col("files").cast("string").alias("told"), F.col("n").cast("string").alias("found")), F.struct(F.lit("bytes").alias("what"), F.col("bytes").cast("string").alias("told"), F.col("size").cast("string").alias("found")))))
    told = markers.select(F.explode("paths").alias("path")).distinct().withColumn("_t", F.lit("yes"))
    there = files.select("path").distinct().withColumn("_f", F.lit("yes"))
    paths = told.join(there, "path", "full").select(F.col("path").alias("what"), F.coalesce("_t", F.lit("no")).alias("told"), F.coalesce("_f", F.lit("no")).alias("found"))
    return sums.unionByName(paths).where(F.col("told") != F.col("found"))


def whole_collection(tracks: DataFrame, titles: DataFrame, licences: DataFrame, sums: DataFrame, folds: DataFrame) -> DataFrame:
    """SC20, J15: one row per track of five tables that must hold the same tracks, with its row number in the order of ids.

    Raises where a table has a problem, a track lacks a part, or an artist stands in several parts of a fold.
    """
    for name, t in (("tracks", tracks), ("titles", titles)):
        assert_empty(t.where(F.col("problem").isNotNull()).select("track_id", "problem"), name)
    for name, t in (("titles", titles), ("licences", licences), ("folds", folds)):
        assert_empty(missing_and_extra(tracks, t, "track_id"), f"tracks and {name}")
    assert_empty(missing_and_extra(tracks, sums, "path"), "tracks and checksums")
    assert_empty(fold_violations(folds), "artists in several parts")
    parts = folds.groupBy("track_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("fold", "part")))).alias("parts"))
    rows = tracks.drop("problem").join(titles.select("track_id", "title", "artist", "album", "released", "url"), "track_id").join(licences.select("track_id", "commercial", "derivatives"), "track_id").join(sums, "path").join(parts, "track_id")
    return numbered(rows, "track_id", "row_index")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Row numbers from 0 in the order of a unique key: sorted in parts, which are counted; no task sees all rows."""
    from .storage import written

    parts = written(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    parts = parts.withColumn("_p", F.shiftright("_at", 33))
    first, n = [], 0
    for p, many in sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()):  # a row per part
        first.append((p, n))
        n += many
    starts = rows.sparkSession.createDataFrame(first, "_p long, _first long")
    return parts.join(F.broadcast(starts), "_p").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_first")


#: SC23, D13: a benchmark document.
BENCHMARK = "benchmark_id string, schema_version int, category_definitions map<string,string>, pairs array<struct<id:string,split:string,scene:string,query:struct<title:string,artist:string>,target:struct<title:string,artist:string>,evidence_category:string,deciding_primary:boolean>>"


def benchmark_pairs(spark: SparkSession, path: str, least: int = 50, primary: str = "pure_sonic") -> DataFrame:
    """SC23: the pairs; raises with fewer than `least`, an unknown category, or a flag that contradicts its category (from version 2 on)."""
    doc = spark.read.schema(BENCHMARK).option("multiLine", True).json(path)
    rows = doc.select("schema_version", F.map_keys("category_definitions").alias("_known"), F.inline("pairs"))
    if rows.count() < least:
        raise ValueError(f"a benchmark has {least} pairs or more")
    versioned = F.coalesce("schema_version", F.lit(1)) >= 2
    wrong = ~F.coalesce(F.array_contains("_known", F.col("evidence_category")), F.lit(False)) | (F.coalesce("deciding_primary", F.lit(False)) != (F.col("evidence_category") == primary))
    assert_empty(rows.where(versioned & wrong).select("id", "evidence_category"), "evidence categories")
    return rows.drop("_known", "schema_version")


def selected_pairs(pairs: DataFrame, split: str | None = None, category: str | None = None) -> DataFrame:
    """PF17."""
    for c, value in (("split", split), ("evidence_category", category)):
        pairs = pairs if value is None else pairs.where(F.col(c) == value)
    return pairs


def related_cache(spark: SparkSession, folder: str) -> DataFrame:
    """SC24: (src, dst) of files dz_<artist>.json with {"names": [...]}; files that are no such JSON are skipped."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "dz_*.json").text(folder)
    names = F.from_json("value", "names array<string>")["names"]
    src = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^dz_(.*)\.json$", 1)
    return raw.select(src.alias("src"), F.explode(names).alias("dst")).where(F.length("dst") > 0)


def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """SC26: (path, value) of all *.json files below a folder."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), "value")


def labelled_replay(spark: SparkSession, path: str, label: str, scope: str, most: int = 100 << 20) -> DataFrame:
    """SC35: rows of a JSON lines file that carry the version label and scope; a larger file raises."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size is None or size > most:
        raise ValueError(f"{path} is missing or larger than {most} bytes")
    rows = spark.read.schema("version string, scope string, track_id bigint, score double").json(path)
    kept = rows.where((F.col("version") == label) & (F.col("scope") == scope))
    if kept.isEmpty():
        raise ValueError(f"no rows of version {label} and scope {scope}")
    return kept


def served_list_problems(lists: DataFrame, results: DataFrame, size: int = 5) -> DataFrame:
    """PF21: (list_id, problem): repeated ids, another number than `size`, positions with gaps, results that their seed has not.

    lists (list_id, seed, ranking: array of result ids), results (result_id, seed, position).
    """
    flat = lists.select("list_id", "seed", F.posexplode("ranking").alias("pos", "result_id"))
    strange = flat.join(results.select("result_id", "seed"), ["result_id", "seed"], "left_anti").select("list_id", F.lit("foreign result").alias("problem"))
    own = lists.withColumn("_n", F.count("*").over(Window.partitionBy("list_id")))
    problems = F.filter(F.array(F.when(F.col("_n") > 1, "repeated list"), F.when(F.size("ranking") != size, "other size"), F.when(F.size(F.array_distinct("ranking")) != F.size("ranking"), "repeated result")), lambda p: p.isNotNull())
    gaps = results.groupBy("seed").agg(F.max("position").alias("_last"), F.count_distinct("position").alias("_all"), F.count("*").alias("_rows")).where((F.col("_last") != F.col("_all")) | (F.col("_all") != F.col("_rows")))
    gaps = lists.join(gaps.select("seed"), "seed", "left_semi").select("list_id", F.lit("positions with gaps").alias("problem"))
    return own.select("list_id", F.explode(problems).alias("problem")).unionByName(strange).unionByName(gaps).distinct()


def year_span(rows: DataFrame, year: str, title: str) -> DataFrame:
    """SC34: one row (first, last, span, oldest): the oldest title, the first of equals."""
    y = F.col(year)
    return rows.agg(F.min(y).alias("first"), F.max(y).alias("last"), (F.max(y) - F.min(y)).alias("span"), F.min_by(title, F.struct(y, F.col(title))).alias("oldest"))


def not_yet(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates whose key the known table has not, the first of each key."""
    fresh = candidates.join(known.select(key).distinct(), key, "left_anti")
    return fresh.dropDuplicates([key])
