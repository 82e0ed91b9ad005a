"""Versioned, checksummed vector store and result tables (SK1, SK3, SK5-SK10, SK13, SC22, U9)."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ingest


def with_checksum(rows: DataFrame) -> DataFrame:
    """SK6: sha256 over the id and the vector's canonical text."""
    return rows.withColumn("sha256", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.array_join(F.transform("v", lambda x: x.cast("double").cast("string")), ",")), 256))


def plan(rows: DataFrame, shard_size: int) -> DataFrame:
    """SK5: (shard_start, n): the shards that a store of these rows has, in order."""
    return rows.groupBy((F.floor(F.col("id") / shard_size) * shard_size).cast("long").alias("shard_start")).agg(F.count("*").alias("n"))


def publish(rows: DataFrame, path: str, shard_size: int, generation: int, planned: DataFrame | None = None) -> None:
    """SK5: rows (id, label, v) of a generation, one folder per shard of the id range; written whole, then named in the manifest.

    With a plan the shards must be the plan's next ones that no generation has, in order and with as many rows.
    """
    spark = rows.sparkSession
    if planned is not None:
        _assert_next(spark, path, plan(rows, shard_size), planned)
    out = with_checksum(rows).withColumn("shard_start", (F.floor(F.col("id") / shard_size) * shard_size).cast("long"))
    folder = f"{path}/generation={generation}"
    out.repartition("shard_start").write.mode("errorifexists").partitionBy("shard_start").parquet(folder)
    sums = spark.read.parquet(folder).groupBy("shard_start").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))
    sums.withColumn("generation", F.lit(generation)).write.mode("append").parquet(f"{path}/manifest")


def _assert_next(spark: SparkSession, path: str, mine: DataFrame, planned: DataFrame) -> None:
    done = manifest(spark, path).select("shard_start") if exists(spark, f"{path}/manifest") else planned.where("false").select("shard_start")
    left = planned.join(done, "shard_start", "left_anti")
    j = left.join(mine.select("shard_start", F.col("n").alias("_mine")), "shard_start", "full")
    last = mine.agg(F.max("shard_start")).first()[0]
    ingest.assert_empty(j.where(F.col("n").isNull() | (F.col("_mine").isNotNull() & (F.col("_mine") != F.col("n"))) | (F.col("_mine").isNull() & (F.col("shard_start") < F.lit(last)))), "shards that are not the plan's next")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        ingest.first_existing(spark, path)
    except FileNotFoundError:
        return False
    return True


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation of each shard."""
    m = spark.read.parquet(f"{path}/manifest")
    return m.groupBy("shard_start").agg(F.max_by(F.struct("generation", "n", "sha256"), "generation").alias("m")).select("shard_start", "m.*")


def read(spark: SparkSession, path: str, ids: list[int] | None = None, shard_size: int | None = None) -> DataFrame:
    """SC22: rows of each shard's newest published generation.  Only folders that the manifest names are listed and read;
    with ids and the shard size only the folders of their shards."""
    named = manifest(spark, path)
    if ids is not None and shard_size:
        named = named.where(F.col("shard_start").isin(sorted({i // shard_size * shard_size for i in ids})))
    folders = [f"{path}/generation={r.generation}/shard_start={r.shard_start}" for r in named.select("generation", "shard_start").toLocalIterator()]  # a row per shard
    if not folders:
        return spark.createDataFrame([], "id long, label long, v array<double>, sha256 string, generation int, shard_start int")
    rows = spark.read.option("basePath", path).parquet(*folders)
    return rows if ids is None else rows.where(F.col("id").isin(list(ids)))


def damage(spark: SparkSession, path: str) -> DataFrame:
    """SK6: rows whose checksum is not their content's."""
    return with_checksum(read(spark, path).withColumnRenamed("sha256", "told")).where(F.col("told") != F.col("sha256")).select("id", "shard_start")


def lost(spark: SparkSession, path: str) -> DataFrame:
    """SK6: shards of the manifest with fewer or more rows than it says."""
    found = read(spark, path).groupBy(F.col("shard_start").cast("long").alias("shard_start")).agg(F.count("*").alias("_n"))
    return manifest(spark, path).join(found, "shard_start", "left").where(F.coalesce("_n", F.lit(0)) != F.col("n")).select("shard_start", "n", F.coalesce("_n", F.lit(0)).alias("found"))


def orphans(spark: SparkSession, path: str) -> DataFrame:
    """SK6: (generation, shard_start) of folders that no manifest row names: what a publisher left that did not end."""
    there = spark.read.option("basePath", path).parquet(f"{path}/generation=*").select(F.col("generation").cast("int"), F.col("shard_start").cast("long")).distinct()
    named = spark.read.parquet(f"{path}/manifest").select(F.col("generation").cast("int"), F.col("shard_start").cast("long")).distinct()
    return there.join(named, ["generation", "shard_start"], "left_anti")


def vector_problems(rows: DataFrame, width: int) -> DataFrame:
    """SK6: (id, problem): vectors of another width, with numbers that are none, or of length zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = F.when(F.size(v) != width, "other width").when(~finite, "not finite").when(F.forall(v, lambda x: x == 0), "zero")
    return rows.select("id", problem.alias("problem")).where(F.col("problem").isNotNull())


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """U9, SK2: appends the rows whose key the table at path has not, first of each key; returns their number."""
    spark = rows.sparkSession
    fresh = ingest.not_yet(rows, spark.read.parquet(path), key) if exists(spark, path) else rows.dropDuplicates([key])
    from .storage import written

    fresh = written(fresh, "append")  # read before it is appended to
    n = fresh.count()
    if n or not exists(spark, path):
        fresh.write.mode("append").parquet(path)
    return n


# --- fingerprints ---------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """SK7, F12: JSON with sorted keys and no spaces; null for null or malformed text."""

    def one(x):
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return s.map(one)


def json_fingerprint(c: Column) -> Column:
    """SK7: sha256 of the canonical JSON, whatever the order of keys."""
    return F.sha2(canonical_json(c), 256)


def plan_fingerprint(rows: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """SK7: one row (sha256) of all (id, hash) pairs in the order of ids: pairs in parts of the id range, then the parts' digests.

    Nothing but the parts' digests, of 4,096 ids each, meets in one task.
    """
    part = F.floor(F.col(id_col) / 4096)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(hash_col).alias("h"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["i"].cast("string"), p["h"])), ",")
    parts = rows.groupBy(part.alias("_p")).agg(F.sha2(text, 256).alias("s"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "s"))), lambda x: x["s"]), ""), 256).alias("sha256"))


def hmac_sha256(key: bytes):
    """keyed digest of a text column, null for null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key, x.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return run


# --- files and results ----------------------------------------------------------------------


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """SK13, SK9: (path, size, sha256) of all files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def inbox_state(remote: DataFrame, local: DataFrame) -> DataFrame:
    """SK9: (path, state) of both sides' file_hashes: fetch what is missing, keep what is equal, conflict where bytes differ, extra."""
    a, b = remote.select("path", F.col("sha256").alias("_a")), local.select("path", F.col("sha256").alias("_b"))
    state = F.when(F.col("_b").isNull(), "fetch").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "keep").otherwise("conflict")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def save_results(rows: DataFrame, path: str, keys: list[str]) -> None:
    """SK10: appends result rows, each with the digest of its keys and values."""
    rows.withColumn("sha256", _result_digest(rows)).write.mode("append").parquet(path)


def _result_digest(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)


def open_slots(spark: SparkSession, wanted: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """SK10: the wanted slots that have no result whose digest is its content's: what a resumed run has to do."""
    if not exists(spark, path):
        return wanted
    rows = spark.read.parquet(path)
    plain = rows.drop("sha256")
    valid = rows.withColumn("_now", _result_digest(plain)).where(F.col("_now") == F.col("sha256"))
    return wanted.join(valid.select(*keys).distinct(), keys, "left_anti")
