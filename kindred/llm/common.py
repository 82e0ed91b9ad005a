"""Shared folder, scratch tables and small helpers of the pipeline operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the session is a single process (tests) a local folder is made
    and set; on a cluster executors would write to different disks, so that raises.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kindred-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Rows of an Arrow batch, at most: texts of some kilobytes each, so this bounds what a Python worker and the JVM hold of them.
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless they are smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(doc_id) -> F.Column:
    """crc32 of the id's text leaves 2 when divided by 4; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4) == 2


#: A key with more than this share of all rows is frequent; so there are at most as many frequent keys.
FREQUENT = 1024


def salted_join(rows: DataFrame, small: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """rows joined with small (a row per key), where the rows of a frequent key are dealt to many tasks by `salt`.

    Frequent keys are found by a count that is combined before its shuffle; at most FREQUENT of them
    come to the driver, and only their rows of `small` are repeated.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") * FREQUENT > total) & F.col(key).isNotNull())
    found = hot.select(key, F.ceil(F.col("_n") * FREQUENT / F.lit(max(total, 1))).cast("int").alias("_k")).collect()
    if not found:
        return rows.join(small, key, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, rows.select(key).schema.add("_k", "integer")))
    many = F.coalesce(F.col("_k"), F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt, F.lit(17)), many).cast("int")).drop("_k")
    each = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_k")
    return dealt.join(each, [key, "_salt"], how).drop("_salt")
