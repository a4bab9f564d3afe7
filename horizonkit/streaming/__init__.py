"""Incremental ingestion of visit exports with Structured Streaming.

The analytics themselves are batch (cohort definitions, pairing and
validation need complete subject histories). What arrives over time are
export files; ``ingest_exports`` applies the same source operators (SRC1
CSV as text, SRC2 header gate, SRC3 lenient normalisation) to each new file
and appends the result to a parquet table, with exactly-once file tracking
in the query's checkpoint folder (``checkpointLocation`` under the shared
``spark.checkpoint.dir``). No windowing, watermark or state is involved.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from horizonkit.session import checkpoint_dir
from horizonkit.sources.files import normalise_visits, validate_schema


def export_stream(spark: SparkSession, folder: str, columns: list[str]):
    """Streaming DataFrame of normalised visits from CSV files in ``folder``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.readStream.schema(schema).option("header", "true").csv(folder)
    validate_schema(raw)
    return normalise_visits(raw)


def ingest_exports(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    table_path: str,
    query_name: str = "visit_exports",
    available_now: bool = True,
) -> StreamingQuery:
    """Append newly arrived export files to ``table_path`` (parquet)."""
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{query_name}"
    writer = (
        export_stream(spark, folder, columns)
        .writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", ckpt)
        .outputMode("append")
        .queryName(query_name)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
