"""From raw documents to packed token sequences: five stages, each one of the corpus operators.

A stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last keep the columns
of ``documents``.  Tables a stage needs besides (labels, benchmark) are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm import leaks, near, personal, quality
from shotspark.llm.queries import held_out, packed, table
from shotspark.session import durable


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "quality")
    return quality.keep_preferred(docs, labels, key="doc_id", text="text")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: that with the smallest id, null first.

    A document is named by its id and its content, so that null and repeated ids do no harm;
    rows that repeat both are copies, of which one stays.
    """
    content = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    named = docs.withColumn("_name", F.struct("doc_id", content.alias("content")))
    found = near.find_near_duplicates(named, key="_name", text="text")
    short = F.xxhash64("_name.doc_id", "_name.content")
    kept = found.filter("kept").select(short.alias("_short"), F.col("_name.content").alias("_content"))
    return (
        named.select(*docs.columns, short.alias("_short"), F.col("_name.content").alias("_content"))
        .join(kept, ["_short", "_content"], "left_semi")
        .dropDuplicates(["_short", "_content"])
        .select(*docs.columns)
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"), text="text")


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; ``n_chars`` follows."""
    masked = personal.mask_personal_data(docs, text="text")
    size = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in sequences of equal length."""
    return packed(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", mask_private),
    ("packing", pack),
]

#: Classification, edit distance and differencing have no SQL form; tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs)
    return docs
