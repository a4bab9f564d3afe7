"""Registered queries: bootstrap, calibration, stability, summaries, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.operators import bootstrap as B
from horizonkit.plans.catalog import register
from horizonkit.sources.tables import CONTINUOUS_PRICE_FACTOR, read_table

N_RESAMPLES, POISSON_RESAMPLES, LEVEL, SEED = 50, 1000, 0.95, 42


def bootstrap_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows keyed by (configuration = line status, subject = order)."""
    li = read_table(spark, sf_dir, "lineitem")
    prob = F.round(F.col("l_discount") * 10, 1)
    return li.select(
        F.col("l_linestatus").alias("configuration_id"),
        F.col("l_orderkey").alias("patient_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        prob.alias("y_probability"),
        F.when(prob >= 0.5, 1).otherwise(0).alias("y_pred"),
        F.col("l_extendedprice").alias("y_value"),
        (F.col("l_quantity") * F.lit(CONTINUOUS_PRICE_FACTOR)).alias("y_estimate"),
    )


@register("agg12_bootstrap_regression")
def agg12_bootstrap_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bootstrap_regression(
        bootstrap_input(spark, sf_dir), ["configuration_id"], "patient_id", "y_value", "y_estimate",
        N_RESAMPLES, LEVEL, SEED,
    )


@register("agg12_bootstrap_classification")
def agg12_bootstrap_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bootstrap_classification(
        bootstrap_input(spark, sf_dir), ["configuration_id"], "patient_id",
        n_resamples=N_RESAMPLES, confidence_level=LEVEL, seed=SEED,
    )


@register("agg12_bootstrap_poisson")
def agg12_bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale variant: Poisson weights drawn where the rows lie, so only (configuration, resample) sums move."""
    return B.bootstrap_regression(
        bootstrap_input(spark, sf_dir), ["configuration_id"], "patient_id", "y_value", "y_estimate",
        POISSON_RESAMPLES, LEVEL, SEED, method="poisson",
    )
