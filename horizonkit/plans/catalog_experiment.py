"""Registered queries: the experiment-grid chain and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.operators import audit as A
from horizonkit.operators import summary as SM
from horizonkit.plans import tasks as T
from horizonkit.plans.catalog import register
from horizonkit.plans.experiment import ExperimentTables, run_grid_experiment
from horizonkit.plans.grid import expand_grid
from horizonkit.sources.tables import VISIT_FEATURE_BLOCKS, read_table, visit_table

EXP_SPLITS, EXP_REPEATS, EXP_RESAMPLES = 5, 2, 50


def experiment(spark: SparkSession, sf_dir: str) -> ExperimentTables:
    return run_grid_experiment(
        visit_table(spark, sf_dir), T.grid_tasks(), VISIT_FEATURE_BLOCKS,
        EXP_SPLITS, EXP_REPEATS, EXP_RESAMPLES,
    )


@register("val21_experiment_summary")
def val21_experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment(spark, sf_dir).summary


@register("prj19_choice_grid")
def prj19_choice_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SM.choice_grid(experiment(spark, sf_dir).summary)


@register("win6_specification_curve")
def win6_specification_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SM.specification_curve(experiment(spark, sf_dir).summary, "mae")


@register("val22_integrity_audit")
def val22_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = experiment(spark, sf_dir)
    return A.integrity_checks(e.assignments, e.oof, e.manifest, EXP_SPLITS, EXP_REPEATS)


@register("val22_audit_tampered")
def val22_audit_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit on spoilt output: subjects divisible by 7 lose their OOF rows, by 11 have
    them twice, by 13 also train where they are tested; one configuration is not in the manifest."""
    e = experiment(spark, sf_dir)
    pid = F.col("patient_id")
    oof = e.oof.filter(pid % 7 != 0)
    oof = oof.unionByName(oof.filter(pid % 11 == 0))
    leak = e.assignments.filter((pid % 13 == 0) & (F.col("partition") == "test"))
    assignments = e.assignments.unionByName(leak.withColumn("partition", F.lit("train")))
    first = e.manifest.agg(F.min("configuration_id")).scalar()
    manifest = e.manifest.filter(F.col("configuration_id") != first)
    return A.integrity_checks(assignments, oof, manifest, EXP_SPLITS, EXP_REPEATS)


@register("agg23_audit_totals")
def agg23_audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = experiment(spark, sf_dir)
    return A.audit_totals(e.assignments, e.oof, e.manifest, EXP_SPLITS, EXP_REPEATS)


@register("agg6_duplicate_visit_keys")
def agg6_duplicate_visit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SM.duplicate_keys(visit_table(spark, sf_dir, features=False, groups=False), ["PATNO", "VISIT_DATE"])


@register("prj16_row_fingerprint")
def prj16_row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from horizonkit.functions.expressions import row_fingerprint

    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"),
        "c_custkey", "c_mktsegment", "c_name", "c_nationkey")
    return cust.select("c_custkey", row_fingerprint(cust.columns, 16).alias("row_id"))


@register("jn9_parameter_grid")
def jn9_parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment grid for every nation (study) and market segment (endpoint)."""
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                                        F.col("n_name").alias("study"))
    endpoints = (
        read_table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment")
        .agg(F.count(F.lit(1)).alias("subjects")).join(nation, "c_nationkey")
        .select("study", F.col("c_mktsegment").alias("endpoint"), F.lit("OFF").alias("medication_state"), "subjects")
    )
    return expand_grid(endpoints, T.GRID_CONFIG)


@register("set1_ledger_union")
def set1_ledger_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from horizonkit.operators import horizon
    from horizonkit.plans.catalog import _cohort, _endpoint

    _, grid_ledger = horizon.multi_task_result(
        visit_table(spark, sf_dir, features=False, groups=False), T.grid_tasks(), read_once=False
    )
    return A.union_ledgers(_cohort(spark, sf_dir).flow, _endpoint(spark, sf_dir).flow, grid_ledger)
