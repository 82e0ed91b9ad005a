"""Registered queries of files, requests and signals (SC12, SC21, SC25, SK11, SK12, V29, V31, F16, UD1, PF17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import register
from ..operators import late
from ..sources import ingest, services
from ..sources.storage import scratch
from .catalogue import query, r6, read


@query("SELECT p_partkey track_id, p_name || ', \"live\"' title, p_type genre FROM part")
def manifest_csv(spark: SparkSession, d: str) -> DataFrame:
    """SC12, SK4: a manifest with commas and quotes to CSV and back."""
    path = scratch(spark, "manifest")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("track_id"), F.concat("p_name", F.lit(', "live"')).alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"), F.lit("u").alias("preview_url"))
    ingest.write_csv(rows, path)
    return ingest.read_manifest(spark, path).select("track_id", "title", "genre")


@query("SELECT event_id, event_id % 4 = 0 ok FROM events")
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    """SC25: repeated keys, numbers that are none and damaged text are refused."""
    k, p = F.col("event_id"), F.col("props")
    said = F.when(k % 4 == 0, p).when(k % 4 == 1, F.replace(p, F.lit("}"), F.lit(', "k": 1}'))).when(k % 4 == 2, F.lit('{"k": NaN}')).otherwise(F.lit("{"))
    return read(spark, d, "events").select("event_id", ingest.strict_json(said).alias("ok"))


@query("SELECT doc_id, sha1(('blob ' || strlen(coalesce(text, ''))) || chr(0) || coalesce(text, '')) blob FROM documents")
def blob_ids(spark: SparkSession, d: str) -> DataFrame:
    """SC21: content ids of whole texts."""
    return read(spark, d, "documents").select("doc_id", services.blob_id(F.coalesce("text", F.lit(""))).alias("blob"))


@query("SELECT user_id, (k - 1) // 100 batch, count(*) n, arg_min(event_id, k) AS \"first\" FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) k FROM events WHERE user_id = 8) GROUP BY ALL")
def playlist_requests(spark: SparkSession, d: str) -> DataFrame:
    """SK11: one listener's songs in requests of a hundred (the one listener is the feature)."""
    from pyspark.sql import Window

    e = read(spark, d, "events").where("user_id = 8").select("event_id", F.row_number().over(Window.orderBy("event_id")).alias("position"))
    r = services.playlist_requests(e.select("position", F.col("event_id").cast("string").alias("uri")))
    return r.select(F.lit(8).cast("long").alias("user_id"), F.col("batch").cast("long").alias("batch"), F.size("uris").cast("long").alias("n"), F.get("uris", F.lit(0)).cast("long").alias("first"))


@query("WITH s AS (SELECT min(l_quantity) a, max(l_quantity) z FROM lineitem), b AS (SELECT l_returnflag series, least(floor((l_quantity - a) / ((z - a) / 20)), 19)::BIGINT bin, l_quantity x, l_extendedprice y FROM lineitem, s) SELECT series, bin, round(avg(x), 6) x, round(avg(y), 4) y, count(*) n FROM b GROUP BY 1, 2")
def figure_points(spark: SparkSession, d: str) -> DataFrame:
    """SK12: what a chart of all rows needs."""
    p = services.figure_points(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", 20)
    return p.select("series", "bin", r6(F.col("x")).alias("x"), F.round("y", 4).alias("y"), "n")


@query("SELECT doc_id, rtrim(translate(base64(unhex(sha256(coalesce(text, '')))), '+/', '-_'), '=') challenge FROM documents")
def challenges(spark: SparkSession, d: str) -> DataFrame:
    """F16."""
    return read(spark, d, "documents").select("doc_id", services.challenge(F.coalesce("text", F.lit(""))).alias("challenge"))


@query("WITH s AS (SELECT user_id, list(value - 50 ORDER BY event_id) v FROM events GROUP BY 1), c AS (SELECT user_id, sqrt(list_avg(list_transform(v, lambda x: x * x))) rms, list_max(list_transform(v, lambda x: abs(x))) top, CASE WHEN len(v) > 1 THEN list_avg(list_transform(range(1, len(v)), lambda i: ((v[i] < 0) <> (v[i + 1] < 0))::INT)) ELSE 0 END z FROM s) SELECT user_id, round(rms, 6) rms, round(z, 6) zero_crossings, round(top / (rms + 1e-12), 6) crest FROM c")
def signal_profile(spark: SparkSession, d: str) -> DataFrame:
    """V29, UD1: each listener's values as a signal, through the analyser seam; bands and centroid are in the tests."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") - 50).alias("x")))), lambda s: s["x"])
    signals = read(spark, d, "events").groupBy("user_id").agg(v.alias("samples"))
    out = register.analysed(signals, lambda s: late.signal_features(s, 8000.0), "samples", "rms double, zero_crossings double, crest double, centroid double, bands array<double>")
    return out.select("user_id", *[r6(F.col(c)).alias(c) for c in ("rms", "zero_crossings", "crest")])


@query("WITH s AS (SELECT user_id, list(value ORDER BY event_id) v FROM events GROUP BY 1) SELECT user_id, round(list_sum(CASE WHEN len(v) >= 40 THEN v[(floor((len(v) - 40) / 2) + 1)::BIGINT : (floor((len(v) - 40) / 2) + 40)::BIGINT] ELSE v END), 4) total FROM s")
def middle_frames(spark: SparkSession, d: str) -> DataFrame:
    """The middle forty values; fewer are followed by zeros."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"])
    s = read(spark, d, "events").groupBy("user_id").agg(v.alias("v")).select("user_id", late.fit_frames(F.col("v"), 40).alias("v"))
    return s.select("user_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT o_orderkey id, o_orderpriority evidence_category FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def selected_pairs(spark: SparkSession, d: str) -> DataFrame:
    """PF17."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("evidence_category"))
    return ingest.selected_pairs(o, "F", "1-URGENT").select("id", "evidence_category")
