"""Pipeline stages: each applies one operator and makes its decision effective.

All stages keep every column of their input (extra columns included) except
the last, which returns the packed pieces. An empty input stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.llm import packing, secret_scan, simhash_dedup, toxicity
from horizonkit.llm.common import read_table, text_key, unused_column


def _same_text(docs: DataFrame, rows: DataFrame):
    """Condition that ``docs`` and ``rows(id, key)`` have the same id, nulls included, and the same text."""
    return docs["doc_id"].eqNullSafe(rows["id"]) & (text_key(docs["text"]) == rows["key"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go.

    The decision is made per text; other texts of the same id, or of a null id, stay.
    """
    verdicts = toxicity.classify(spark, docs, read_table(spark, sf_dir, "labels"), keyed=True)
    rejected = (
        verdicts.where("predicted = 1").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    )
    return docs.join(rejected, _same_text(docs, rejected), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id.

    Among texts of one id the smallest text key stays; a row with a null id is
    kept only if its group has no id at all. Rows of equal id and text are one.
    """
    groups = simhash_dedup.near_groups(docs, keyed=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = groups.groupBy("root").agg(F.min(order).alias("k")).select(
        F.col("k.doc_id").alias("id"), F.col("k.text_key").alias("key")
    )
    key = unused_column(docs, "text_key")
    once = docs.join(kept, _same_text(docs, kept), "left_semi").withColumn(key, text_key(F.col("text")))
    return once.dropDuplicates(["doc_id", key]).drop(key)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in their texts become a marker."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents, packed."""
    return packing.pack(docs)
