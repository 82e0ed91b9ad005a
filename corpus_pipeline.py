"""The corpus pipeline: documents in, a mixed training set out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontam, mixing, neardup, pii, quality
from kindred.llm.common import salted_join, table, written

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Null texts are empty; repeated rows share their fate; without labels of both kinds all rows stay;
    an empty table gives an empty one.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.score(docs, model, carry=DOCUMENTS)
    return found.where(~F.col("_rejected")).select(*DOCUMENTS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the row of the smallest id; rows without id come last.

    Rows are told apart by a key of their own, so rows that share an id or have none are compared by their
    texts alone; of repeated rows one stays; rows without words all stay.
    """
    rows = written(docs.select(*DOCUMENTS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(rows, size=5, percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*DOCUMENTS)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; null and empty texts have none and stay, as do all rows beside an empty benchmark."""
    marked = decontam.contamination(docs.withColumn("_body", F.col("text")), table(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars", "_body"))
    return marked.where(F.size("hit_starts") == 0).select("doc_id", F.col("_body").alias("text"), "lang", "source", "n_chars")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; n_chars follows, and is null for a null text, which stays null."""
    return pii.masked(docs, carry=("doc_id", "lang", "source")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their words (`size`) and number of copies.

    Rows are told apart by a digest of all their columns, whatever their ids.  Rows that are equal in
    every column are one item of the mix, of all their words together, and get the same copies; rows
    without words are not taken; a null source is a source.
    """
    item = F.sha2(F.to_json(F.struct(*DOCUMENTS), {"ignoreNullFields": "false"}), 256)
    sizes = mixing.sized(docs.select(item.alias("doc_id"), "source", "text"), ["doc_id", "source"])
    items = sizes.groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    taken = mixing.mixed(written(items, "items")).where(F.col("copies") > 0)
    taken = taken.select(F.col("doc_id").alias("_item"), F.expr("size div rows").alias("size"), "copies")
    return salted_join(docs.select(*DOCUMENTS).withColumn("_item", item), taken, "_item", "doc_id").select(*DOCUMENTS, "size", "copies")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontam_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The stages are no SQL (trained models, signatures, Newton steps); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
