"""Driver tables and the canonical views derived from them.

The longitudinal test view maps an order to a subject visit:

    PATNO             <- o_custkey
    EVENT_ID          <- 'BL' for 1-URGENT orders, else 'V' + priority digit
    VISIT_DATE        <- o_orderdate
    SCORE             <- o_totalprice
    DIAGNOSTIC_GROUP  <- c_mktsegment
    MEDICATION_STATE  <- raw label from o_orderstatus (F/O/other)
    ROW_ID            <- o_orderkey (explicit tie-break; Spark has no row order)
    features          <- c_acctbal and per-order lineitem aggregates

Joins are ordered so that the last exchange is on the subject key:
orders + per-order lineitem aggregates join on the order key first, then the
customer join hashes on ``o_custkey`` - the very key every per-subject
operator groups on, so the pairing stage reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VISIT_FEATURES = ("ACCTBAL", "N_LINES", "SUM_QTY", "MAX_DISC")
# Feature domains of the visit view (other domains have no column here).
VISIT_FEATURE_BLOCKS = {
    "demographics_disease_history": ("ACCTBAL",),
    "baseline_motor": ("N_LINES", "SUM_QTY"),
    "olfaction_sleep_autonomic": ("MAX_DISC",),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table (pruning/pushdown left to Catalyst)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order aggregates of ``lineitem`` (partial aggregation map-side)."""
    return (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("ROW_ID"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("N_LINES"),
            F.sum("l_quantity").alias("SUM_QTY"),
            F.max("l_discount").alias("MAX_DISC"),
        )
    )


def visit_table(spark: SparkSession, sf_dir: str, features: bool = True, groups: bool = True) -> DataFrame:
    """Canonical long visit table built from ``orders`` and ``customer``.

    Without ``groups`` (and ``features``) no column of ``customer`` is needed,
    so the table is a plain scan of ``orders``.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ROW_ID"),
        F.col("o_custkey").alias("PATNO"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("BL"))
        .otherwise(F.concat(F.lit("V"), F.substring("o_orderpriority", 1, 1)))
        .alias("EVENT_ID"),
        F.col("o_orderdate").alias("VISIT_DATE"),
        F.col("o_totalprice").alias("SCORE"),
        F.when(F.col("o_orderstatus") == "F", F.lit("off medication"))
        .when(F.col("o_orderstatus") == "O", F.lit("ON"))
        .otherwise(F.lit("1"))
        .alias("MEDICATION_STATE"),
    )
    if features:
        orders = orders.join(order_line_features(spark, sf_dir), "ROW_ID", "left")
    if not (features or groups):
        return orders.select("PATNO", "EVENT_ID", "VISIT_DATE", "SCORE", "MEDICATION_STATE", "ROW_ID")
    customer = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("PATNO"),
        F.col("c_mktsegment").alias("DIAGNOSTIC_GROUP"),
        *([F.col("c_acctbal").alias("ACCTBAL")] if features else []),
    )
    visits = orders.join(customer, "PATNO", "inner")
    core = ["PATNO", "EVENT_ID", "VISIT_DATE", "SCORE", "DIAGNOSTIC_GROUP",
            "MEDICATION_STATE", "ROW_ID"]
    return visits.select(*core, *(VISIT_FEATURES if features else ()))


def event_visit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday visit view over ``events`` (signup = baseline)."""
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("PATNO"),
        F.when(F.col("event_type") == "signup", F.lit("BL"))
        .otherwise(F.upper("event_type"))
        .alias("EVENT_ID"),
        F.col("ts").alias("VISIT_DATE"),
        F.col("value").alias("SCORE"),
        F.col("event_id").alias("ROW_ID"),
    )


# Continuous prediction pair: truth l_extendedprice vs l_quantity * this factor.
CONTINUOUS_PRICE_FACTOR = 1500.0


def lineitem_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-like view over ``lineitem`` for the metric operators.

    ``group_id`` = supplier, subject = order, binary truth = returned line,
    probability = discount x 10 rounded to one digit (many ties).
    """
    li = read_table(spark, sf_dir, "lineitem")
    prob = F.round(F.col("l_discount") * 10, 1)
    return li.select(
        F.col("l_suppkey").alias("group_id"),
        F.col("l_orderkey").alias("patient_id"),
        F.col("l_linenumber").alias("line_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        prob.alias("y_probability"),
        F.when(prob >= 0.5, 1).otherwise(0).alias("y_pred"),
        F.col("l_extendedprice").alias("y_value"),
        (F.col("l_quantity") * F.lit(CONTINUOUS_PRICE_FACTOR)).alias("y_estimate"),
    )


def visits_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit table with deterministic gaps, so ledgers see every exclusion.

    Every row is kept; some values are blanked or re-spelled by a rule on the
    order key: subject id missing (key % 23 = 0), score missing (% 17 = 0),
    group label in lower case with padding (% 29 = 0).
    """
    v = visit_table(spark, sf_dir)
    rid = F.col("ROW_ID")
    return v.withColumns(
        {
            "PATNO": F.when(rid % 23 == 0, F.lit(None).cast("bigint")).otherwise(F.col("PATNO")),
            "SCORE": F.when(rid % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("SCORE")),
            "DIAGNOSTIC_GROUP": F.when(
                rid % 29 == 0, F.concat(F.lit(" "), F.lower("DIAGNOSTIC_GROUP"), F.lit(" "))
            ).otherwise(F.col("DIAGNOSTIC_GROUP")),
        }
    )


def visit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export-style column names (as a clinical visit export would carry)."""
    v = visit_table(spark, sf_dir)
    return v.select(
        "PATNO", "EVENT_ID",
        F.col("VISIT_DATE").alias("visit_date"),
        F.col("SCORE").alias("updrs3_score"),
        F.col("DIAGNOSTIC_GROUP").alias("dx_group"),
        F.col("MEDICATION_STATE").alias("med_state_raw"),
        F.col("ACCTBAL").alias("moca"),
        "ROW_ID", "N_LINES", "SUM_QTY", "MAX_DISC",
    )


def visit_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text export with mixed date layouts and junk values (for SRC3).

    Rules on the order key: id 'unknown' (% 31), id written '123.0' (% 37),
    event missing (% 41), date layouts by key % 3 (ISO, MM/dd/yyyy,
    'MMM d, yyyy'), unparseable date (% 43), score 'n/a' (% 19).
    """
    v = visit_table(spark, sf_dir, features=False, groups=False)
    rid = F.col("ROW_ID")
    d = F.col("VISIT_DATE")
    date_text = (
        F.when(rid % 43 == 0, F.lit("not a date"))
        .when(rid % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(rid % 3 == 1, F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "MMM d, yyyy"))
    )
    pat = F.col("PATNO").cast("string")
    return v.select(
        F.when(rid % 31 == 0, F.lit("unknown"))
        .when(rid % 37 == 0, F.concat(pat, F.lit(".0")))
        .otherwise(pat)
        .alias("PATNO"),
        F.when(rid % 41 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("EVENT_ID"), F.lit(" ")))
        .alias("EVENT_ID"),
        date_text.alias("visit_date"),
        F.when(rid % 19 == 0, F.lit("n/a")).otherwise(F.col("SCORE").cast("string")).alias("updrs3_score"),
        rid.cast("string").alias("ROW_ID"),
    )
