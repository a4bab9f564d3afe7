"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables of ``sf_dir`` (whole tables; no id
subsets, caps or samples) and returns a lazy DataFrame. Names follow
``<inventory id>_<short name>``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.operators import horizon
from horizonkit.plans import tasks as T
from horizonkit.sources.tables import VISIT_FEATURES, event_visit_table, visit_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


# ------------------------------------------------------------- pairing (JN*)

@register("jn3_nearest_pairing")
def jn3_nearest_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.flagship_task()
    return horizon.fixed_horizon_pairs(
        visit_table(spark, sf_dir, features=False, groups=False), t.horizon_days, t.tolerance_days,
        read_once=False,
    )


@register("jn4_feature_pairing")
def jn4_feature_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return horizon.fixed_horizon_features(
        visit_table(spark, sf_dir), T.feature_task(), list(VISIT_FEATURES)
    )


@register("jn5_multi_task_pairing")
def jn5_multi_task_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = horizon.multi_task_result(visit_table(spark, sf_dir), T.grid_tasks(), VISIT_FEATURES)
    return pairs


@register("agg4_horizon_ledger")
def agg4_horizon_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.flagship_task()
    res = horizon.fixed_horizon_result(
        visit_table(spark, sf_dir, features=False, groups=False), t.horizon_days, t.tolerance_days,
        read_once=False,
    )
    return res.summary()


@register("agg4_grid_ledger")
def agg4_grid_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger = horizon.multi_task_result(
        visit_table(spark, sf_dir, features=False, groups=False), T.grid_tasks(), read_once=False
    )
    return ledger


@register("agg16_retained_cohort")
def agg16_retained_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger = horizon.multi_task_result(
        visit_table(spark, sf_dir, features=False, groups=False), T.grid_tasks(), read_once=False
    )
    return (
        ledger.filter((F.col("flow_component") == "fixed_horizon") & (F.col("stage") == "fixed_horizon_follow_up"))
        .groupBy("task_id")
        .agg(F.first("patients_retained").cast("bigint").alias("retained_patients"))
    )


@register("win1_earliest_baseline")
def win1_earliest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = horizon.prepare_visits(visit_table(spark, sf_dir), VISIT_FEATURES)
    return horizon.baseline_table(prepared, ("BL",), VISIT_FEATURES)


@register("prj12_progression_label")
def prj12_progression_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.flagship_task()
    pairs = horizon.fixed_horizon_pairs(
        visit_table(spark, sf_dir, features=False, groups=False), t.horizon_days, t.tolerance_days,
        read_once=False,
    )
    return horizon.create_progression_label(pairs, T.PROGRESSION_THRESHOLD, check=False)


@register("prj13_intraday_pairing")
def prj13_intraday_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-day arithmetic on intraday stamps: events, horizon 7 +/- 2 days."""
    res = horizon.fixed_horizon_result(event_visit_table(spark, sf_dir), 7, 2, read_once=False)
    return res.feature_pairs.withColumn("Delta_Score", F.col("Target_Score") - F.col("Baseline_Score"))


@register("val18_endpoint_delta")
def val18_endpoint_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return horizon.endpoint_delta_dataset(
        visit_table(spark, sf_dir), "SCORE", ["ACCTBAL", "SUM_QTY"], ("BL", "V2")
    )


# ------------------------------------------------------ cohort and endpoint

from horizonkit.operators import cohort as C  # noqa: E402
from horizonkit.operators import harmonize as H  # noqa: E402
from horizonkit.sources import files as SRC  # noqa: E402
from horizonkit.sources import sinks as SNK  # noqa: E402
from horizonkit.sources.tables import (  # noqa: E402
    visit_export,
    visit_text_export,
    visits_with_gaps,
)

ELIGIBLE_GROUPS = ("BUILDING", "MACHINERY")
SCORE_BOUNDS = (1000.0, 400000.0)


def _cohort(spark: SparkSession, sf_dir: str) -> C.StagedResult:
    return C.select_cohort(visits_with_gaps(spark, sf_dir), ELIGIBLE_GROUPS, ("BL",))


def _endpoint(spark: SparkSession, sf_dir: str) -> C.StagedResult:
    return C.apply_endpoint(
        _cohort(spark, sf_dir).data, "score", "SCORE", "OFF",
        minimum_score=SCORE_BOUNDS[0], maximum_score=SCORE_BOUNDS[1],
    )


@register("agg2_cohort_ledger")
def agg2_cohort_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohort(spark, sf_dir).flow


@register("jn6_cohort_records")
def jn6_cohort_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohort(spark, sf_dir).data


@register("agg3_endpoint_ledger")
def agg3_endpoint_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endpoint(spark, sf_dir).flow


@register("prj7_endpoint_records")
def prj7_endpoint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endpoint(spark, sf_dir).data


@register("agg5_cohort_counts")
def agg5_cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.flagship_task()
    visits = visit_table(spark, sf_dir, features=False)
    res = horizon.fixed_horizon_result(visits, t.horizon_days, t.tolerance_days)
    return horizon.cohort_counts(visits, res)


@register("prj1_harmonize")
def prj1_harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.harmonize_schema(visit_export(spark, sf_dir), "updrs3_score")


# Column map and feature blocks of the export view (canonical -> source).
EXPORT_COLUMN_MAP = {
    "PATNO": "PATNO",
    "EVENT_ID": "EVENT_ID",
    "VISIT_DATE": "visit_date",
    "DIAGNOSTIC_GROUP": "dx_group",
    "SCORE": "updrs3_score",
    "MEDICATION_STATE": "med_state_raw",
}
EXPORT_FEATURE_BLOCKS = {
    "demographics_disease_history": ["moca"],
    "baseline_motor": ["SUM_QTY"],
    "cognition_neuropsychology": ["moca", "N_LINES"],
    "olfaction_sleep_autonomic": ["MAX_DISC"],
    "biofluid_biomarkers": [],
    "imaging_dat_spect": [],
    "genetic_variables": ["N_LINES"],
}


@register("prj2_harmonize_features")
def prj2_harmonize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.harmonize_canonical(
        visit_export(spark, sf_dir), EXPORT_COLUMN_MAP, EXPORT_FEATURE_BLOCKS,
        {"MEDICATION_STATE": "OFF"}, row_id="ROW_ID",
    )


TEXT_CONTRACT = {"PATNO": "double", "EVENT_ID": "string", "visit_date": "date", "updrs3_score": "double"}


@register("src2_contract_report")
def src2_contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SRC.contract_report(visit_text_export(spark, sf_dir), TEXT_CONTRACT)


@register("src3_normalise_visits")
def src3_normalise_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SRC.normalise_visits(visit_text_export(spark, sf_dir))


@register("src4_split_genetics")
def src4_split_genetics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = SRC.split_wide_table(
        visit_table(spark, sf_dir),
        {"clinical": ["SCORE", "MEDICATION_STATE"], "genetics": ["DIAGNOSTIC_GROUP", "ACCTBAL", "ROW_ID"]},
    )
    return parts["genetics"]


@register("src4_split_tables")
def src4_split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four narrow tables of the split, told apart by ``block``."""
    parts = SRC.split_wide_table(
        visit_table(spark, sf_dir),
        {"clinical": ["SCORE", "MEDICATION_STATE"], "biofluid": ["SUM_QTY"], "imaging": ["N_LINES", "MAX_DISC"],
         "genetics": ["DIAGNOSTIC_GROUP", "ACCTBAL", "ROW_ID"]},
    )
    tagged = [df.withColumn("block", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


@register("snk3_table_fingerprint")
def snk3_table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from horizonkit.sources.tables import read_table

    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(20,8)").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("o_orderdate"),
        "o_orderpriority",
    )
    return SNK.table_fingerprint(orders)


# --------------------------------------------------------------- folds (VAL)

from horizonkit.operators import folds as FO  # noqa: E402
from horizonkit.operators import metrics as M  # noqa: E402
from horizonkit.sources.tables import lineitem_predictions  # noqa: E402

OUTER_SPLITS, REPEATS, INNER_SPLITS, SEED = 5, 2, 3, 42


def fold_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject of the 24-month binary task, id as ``patient_id``."""
    fp = horizon.fixed_horizon_features(visit_table(spark, sf_dir), T.feature_task(), list(VISIT_FEATURES))
    return fp.withColumnRenamed("PATNO", "patient_id")


def _strat_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.patient_folds(
        fold_dataset(spark, sf_dir), OUTER_SPLITS, REPEATS, SEED, stratify_col="progression_label"
    )


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.fold_assignments(_strat_folds(spark, sf_dir), OUTER_SPLITS, T.feature_task().task_id)


@register("val1_patient_folds")
def val1_patient_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.patient_folds(fold_dataset(spark, sf_dir), OUTER_SPLITS, 1, shuffle=False)


@register("val2_repeated_folds")
def val2_repeated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.patient_folds(fold_dataset(spark, sf_dir), OUTER_SPLITS, REPEATS, SEED)


@register("val3_stratified_folds")
def val3_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strat_folds(spark, sf_dir)


@register("val4_shuffle_split")
def val4_shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.grouped_shuffle_split(fold_dataset(spark, sf_dir), 0.2, SEED)


@register("val5_inner_folds")
def val5_inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.inner_folds(
        _strat_folds(spark, sf_dir), OUTER_SPLITS, INNER_SPLITS, SEED, stratify_col="progression_label"
    )


@register("val6_fold_assignments")
def val6_fold_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assignments(spark, sf_dir)


@register("jn8_overlap_report")
def jn8_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.overlap_report(_assignments(spark, sf_dir))


@register("agg17_fold_audit")
def agg17_fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.fold_audit(_assignments(spark, sf_dir))


@register("agg7_class_feasibility")
def agg7_class_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.class_feasibility(fold_dataset(spark, sf_dir), "progression_label", OUTER_SPLITS, INNER_SPLITS)


# ------------------------------------------------------------ metrics (AGG)

@register("agg9_regression_metrics")
def agg9_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.regression_metrics(lineitem_predictions(spark, sf_dir), ["group_id"], "y_value", "y_estimate")


@register("agg10_classification_metrics")
def agg10_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classification_metrics(lineitem_predictions(spark, sf_dir), ["group_id"])


@register("win5_roc_points")
def win5_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_points(lineitem_predictions(spark, sf_dir), ["group_id"])


@register("val13_threshold_youden")
def val13_threshold_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select_threshold(lineitem_predictions(spark, sf_dir), ["group_id"], method="youden")


@register("val13_threshold_f1")
def val13_threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select_threshold(lineitem_predictions(spark, sf_dir), ["group_id"], method="f1")


@register("agg20_residual_histogram")
def agg20_residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lineitem_predictions(spark, sf_dir)
    return M.residual_histogram(p.select((F.col("y_value") - F.col("y_estimate")).alias("residual")))
