"""Answers of remote services, read from files that a fetcher left (SC21, SC27, SC28, SC30-SC32, SK11, SK12, CN1, F16).

There is no network in a job: a fetcher stores every answer as one JSON file, and these readers make tables of
them.  An answer that says `error` gives no rows here and is listed by `refused`.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest

#: An answer of the catalogue service; its code 4 asks to come again later.
CATALOGUE = "data array<struct<id:bigint,title:string,preview:string,name:string,artist:struct<id:bigint,name:string>>>, error struct<code:int,message:string>"
#: A page of a library, and an answer about similar songs.
PAGE = "items array<struct<track:struct<id:string,name:string,uri:string,artists:array<struct<id:string,name:string>>>,id:string,name:string,uri:string,artists:array<struct<id:string,name:string>>>>, next string, error struct<status:int,message:string>"
SIMILAR = "similartracks struct<track:array<struct<name:string,match:string,artist:struct<name:string>>>>, similarartists struct<artist:array<struct<name:string>>>, toptags struct<tag:array<struct<name:string,count:bigint>>>, error int, message string"


def answers(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(path, a): parsed answers of all JSON files of a folder."""
    return ingest.json_files(spark, folder).select("path", F.from_json("value", schema).alias("a"))


def refused(spark: SparkSession, folder: str, schema: str = CATALOGUE, again: int = 4) -> DataFrame:
    """SC27: (path, message, again): answers that are errors or no JSON, and whether asking again may help."""
    rows = answers(spark, folder, schema)
    error = F.col("a.error")
    code = error if dict(rows.select(error.alias("e")).dtypes)["e"] == "int" else error[rows.select(error.alias("e")).schema["e"].dataType.names[0]]
    wrong = F.col("a").isNull() | error.isNotNull() | F.forall(F.array(*[F.col(f"a.{n}").isNull() for n in rows.schema["a"].dataType.names]), lambda x: x)
    return rows.where(wrong).select("path", F.coalesce(error.cast("string"), F.lit("not readable")).alias("message"), F.coalesce(code == again, F.lit(False)).alias("again"))


def catalogue_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """SC27, CN1: (id, title, artist, artist_id, preview) of search and top lists, the first of each id by path and place."""
    flat = answers(spark, folder, CATALOGUE).where(F.col("a.error").isNull()).select("path", F.posexplode("a.data").alias("pos", "t")).where(F.col("t.id").isNotNull() & F.col("t.title").isNotNull())
    first = F.min_by(F.col("t"), F.struct("path", "pos")).alias("t")
    rows = flat.groupBy(F.col("t.id").alias("id")).agg(first)
    return rows.select("id", "t.title", F.coalesce("t.artist.name", F.lit("")).alias("artist"), F.col("t.artist.id").alias("artist_id"), F.nullif("t.preview", F.lit("")).alias("preview"))


def related_artists(spark: SparkSession, folder: str) -> DataFrame:
    """SC27: (src, dst) of answers artist-<id>.json."""
    rows = answers(spark, folder, CATALOGUE).where(F.col("a.error").isNull())
    return rows.select(F.regexp_extract("path", r"artist-(\d+)\.json$", 1).try_cast("bigint").alias("src"), F.explode("a.data").alias("t")).select("src", F.col("t.id").alias("dst")).where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def library_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """SC28, CN1: songs of library pages (items with or without a `track` of their own)."""
    item = answers(spark, folder, PAGE).select(F.explode("a.items").alias("i"))
    own = F.struct("i.id", "i.name", "i.uri", "i.artists")
    track = F.coalesce(F.col("i.track"), own)
    return ingest.tracks_of(item.select(track.alias("t")).select("t.*")).dropDuplicates(["id"])


def open_pages(spark: SparkSession, folder: str) -> DataFrame:
    """SC28: (next) links of pages that no page of the folder answers yet: what a resumed fetch asks for.  Pages are stored as <offset>.json."""
    rows = answers(spark, folder, PAGE)
    there = rows.select(F.regexp_extract("path", r"(\d+)\.json$", 1).alias("offset"))
    asked = rows.select(F.col("a.next").alias("next")).where(F.col("next").isNotNull()).withColumn("offset", F.regexp_extract("next", r"offset=(\d+)", 1))
    return asked.join(there, "offset", "left_anti").select("next")


def similar_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """SC30: (path, title, artist, match): a match that is no number is 0."""
    flat = answers(spark, folder, SIMILAR).where(F.col("a.error").isNull()).select("path", F.explode("a.similartracks.track").alias("t"))
    return flat.where(F.length("t.name") > 0).select("path", F.col("t.name").alias("title"), F.coalesce("t.artist.name", F.lit("")).alias("artist"), F.coalesce(F.col("t.match").try_cast("double"), F.lit(0.0)).alias("match"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """SC31: (source, query_id, title, artist_of_query, artist) of a stored truth document {rows: [{title, artist, listenbrainz, deezer}]}."""
    doc = spark.read.schema("rows array<struct<title:string,artist:string,listenbrainz:array<string>,deezer:array<string>>>").option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("rows").alias("query_id", "r"))
    sides = F.explode(F.map_from_arrays(F.array(F.lit("listenbrainz"), F.lit("deezer")), F.array("r.listenbrainz", "r.deezer"))).alias("source", "names")
    return rows.select(F.col("query_id").cast("long"), "r", sides).select("source", "query_id", F.col("r.title").alias("title"), F.col("r.artist").alias("artist_of_query"), F.explode("names").alias("artist"))


def waveforms(spark: SparkSession, folder: str, seconds: float | None = None) -> DataFrame:
    """SC32: (path, rate, samples, problem) of PCM WAV files below a folder: channels averaged, -1..1, at most so many seconds.

    Compressed formats need a decoder from outside; register.encoded and register.analysed take one.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
                        raw = w.readframes(w.getnframes() if seconds is None else int(seconds * rate))
                    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
                    x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
                    rows.append((path, rate, x.reshape(-1, channels).mean(axis=1), None))
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    rows.append((path, None, None, str(e) or "not readable"))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    return files.select("path", "content").mapInPandas(decode, "path string, rate int, samples array<double>, problem string")


def playlist_requests(tracks: DataFrame, size: int = 100) -> DataFrame:
    """SK11: (batch, uris) of a playlist (position, uri), in order, in requests of at most `size`."""
    rows = tracks.groupBy(F.floor((F.col("position") - 1) / size).alias("batch"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "uri"))), lambda x: x["uri"]).alias("uris"))


def figure_points(rows: DataFrame, x: str, y: str, series: str, bins: int = 50) -> DataFrame:
    """SK12: (series, bin, x, y, n): means in equal bins of x, which is what a chart of any number of rows needs."""
    span = rows.agg(F.min(x).alias("_a"), F.max(x).alias("_z"))
    width = (F.col("_z") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(x) - F.col("_a")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("long")
    j = rows.where(F.col(x).isNotNull()).crossJoin(F.broadcast(span))  # one row
    return j.groupBy(F.col(series).alias("series"), at.alias("bin")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def blob_id(content: Column) -> Column:
    """SC21: the id that a Git repository gives to a file's content."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def provenance_problems(files: DataFrame, index: DataFrame) -> DataFrame:
    """SC21: (path, problem) where files (path, content) and an index of blobs (path, blob) differ."""
    j = files.select("path", blob_id(F.col("content")).alias("_now")).join(index.select("path", "blob"), "path", "full")
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("blob").isNull(), "not in the index").when(F.col("_now") != F.col("blob"), "changed")
    return j.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def challenge(verifier: Column) -> Column:
    """F16: base64url of the SHA-256, without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(verifier, 256))), "+/", "-_"), F.lit("="))
