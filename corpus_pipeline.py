"""The corpus pipeline: toxicity filter, near-dedup, secret redaction, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
and its result is written as Parquet and read back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from horizonkit.llm.common import materialise, read_table
from horizonkit.llm.stages import drop_near_copies, drop_toxic, pack_sequences, redact_secrets

STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The trained toxicity model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
