"""Registered queries: model layer (rows-only checks; fits are not SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from horizonkit.operators import horizon
from horizonkit.operators.models import calibration_parameters
from horizonkit.plans.catalog import register
from horizonkit.plans.catalog_prep import MODEL_FEATURES, gapped_dataset
from horizonkit.plans.nested import NestedResult, NestedSettings, run_harness, run_legacy_endpoint, run_nested
from horizonkit.sources.tables import lineitem_predictions, visit_table

#: Grids of the elastic-net family (fixed values); folds are the settings' own: 5 outer x 5 repeats x 5 inner.
BINARY_GRID = {"C": [0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.5, 0.9]}
CONTINUOUS_GRID = {"alpha": [0.001, 0.01, 0.1, 1.0], "l1_ratio": [0.1, 0.5, 0.9]}
#: A forest is fitted by ``pyspark.ml`` one fit at a time, so its query has two folds of each kind.
FOREST_GRID = {"n_estimators": [300], "max_depth": [8], "min_samples_leaf": [2]}
FOREST_FOLDS = {"outer_splits": 2, "outer_repeats": 2, "inner_splits": 2}


@register("agg11_calibration")
def agg11_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_parameters(lineitem_predictions(spark, sf_dir), ["group_id"])


def binary_run(spark: SparkSession, sf_dir: str) -> NestedResult:
    s = NestedSettings("binary", "progression_label", MODEL_FEATURES, "elasticnet", BINARY_GRID,
                       configuration_id="binary_enet")
    return run_nested(gapped_dataset(spark, sf_dir), s)


@register("val17_nested_binary")
def val17_nested_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_run(spark, sf_dir).oof_predictions


@register("val17_oof_keys")
def val17_oof_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the out-of-fold rows does not depend on the solver: keys, outcome, and how often each fit trained."""
    run = binary_run(spark, sf_dir)
    keys = run.oof_predictions.select("configuration_id", "fit_id", "repeat", "outer_fold", "patient_id", "y_true")
    sizes = run.fold_metrics.select("fit_id", "train_patients", "test_patients")
    return keys.join(sizes, "fit_id").select(*keys.columns, "train_patients", "test_patients")


@register("val7_tuning_results")
def val7_tuning_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best grid point of each of the 25 outer fits, out of nine points over five inner folds."""
    return binary_run(spark, sf_dir).tuning_results


@register("val17_nested_continuous")
def val17_nested_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = NestedSettings("continuous", "Delta_Score", MODEL_FEATURES, "elasticnet", CONTINUOUS_GRID,
                       configuration_id="continuous_enet")
    return run_nested(gapped_dataset(spark, sf_dir), s).oof_predictions


@register("val11_forest_records")
def val11_forest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native importances of the random forests of a nested run."""
    s = NestedSettings("continuous", "Delta_Score", MODEL_FEATURES, "random_forest", FOREST_GRID,
                       configuration_id="continuous_forest", **FOREST_FOLDS)
    return run_nested(gapped_dataset(spark, sf_dir), s).feature_records


@register("val16_harness_fold_metrics")
def val16_harness_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_harness(gapped_dataset(spark, sf_dir), "progression_label", MODEL_FEATURES, 5).fold_metrics


@register("val19_legacy_endpoint_model")
def val19_legacy_endpoint_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = horizon.endpoint_delta_dataset(visit_table(spark, sf_dir), "SCORE", ["ACCTBAL", "SUM_QTY"], ("BL", "V2"))
    feats = ["SCORE_baseline", "ACCTBAL_baseline", "SUM_QTY_baseline", "time_from_baseline_days"]
    return run_legacy_endpoint(ds, feats, "SCORE_delta", "SCORE")
