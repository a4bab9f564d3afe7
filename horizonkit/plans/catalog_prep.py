"""Registered queries: fold-local preprocessing and feature stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.operators import folds as FO
from horizonkit.operators import metrics as M
from horizonkit.operators import preprocess as P
from horizonkit.operators import stability as S
from horizonkit.plans import tasks as T
from horizonkit.plans.catalog import (
    OUTER_SPLITS,
    REPEATS,
    SEED,
    fold_dataset,
    register,
)
from horizonkit.sources.tables import lineitem_predictions

MODEL_FEATURES = ["Baseline_Score", "ACCTBAL", "N_LINES", "SUM_QTY", "MAX_DISC"]


def gapped_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold dataset with deterministic missing predictors (rule on the id):
    ACCTBAL missing when id % 7 = 0, MAX_DISC missing when id % 11 = 0."""
    ds = fold_dataset(spark, sf_dir)
    pid = F.col("patient_id")
    return ds.withColumns(
        {
            "ACCTBAL": F.when(pid % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("ACCTBAL")),
            "MAX_DISC": F.when(pid % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("MAX_DISC")),
        }
    )


def _folds(ds: DataFrame) -> DataFrame:
    return FO.patient_folds(ds, OUTER_SPLITS, REPEATS, SEED, stratify_col="progression_label")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = gapped_dataset(spark, sf_dir)
    return P.fold_long(ds, _folds(ds), MODEL_FEATURES)


@register("agg8_feature_coverage")
def agg8_feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.feature_coverage(gapped_dataset(spark, sf_dir), MODEL_FEATURES)


@register("agg21_impute_median")
def agg21_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.imputation_values(_long(spark, sf_dir), OUTER_SPLITS, "median")


@register("agg21_impute_most_frequent")
def agg21_impute_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.imputation_values(_long(spark, sf_dir), OUTER_SPLITS, "most_frequent")


@register("agg22_fold_scaling")
def agg22_fold_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    return P.scaling_stats(long, P.imputation_values(long, OUTER_SPLITS, "median"), OUTER_SPLITS)


@register("agg24_domain_guards")
def agg24_domain_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.domain_guards(gapped_dataset(spark, sf_dir), "progression_label")


@register("agg24_training_classes")
def agg24_training_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = gapped_dataset(spark, sf_dir)
    return P.training_class_check(_folds(ds), ds, "progression_label", OUTER_SPLITS)


def feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = gapped_dataset(spark, sf_dir)
    return S.univariate_feature_records(
        ds, _folds(ds), MODEL_FEATURES, "Delta_Score", OUTER_SPLITS, T.feature_task().task_id
    )


@register("win3_feature_records")
def win3_feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_records(spark, sf_dir)


@register("agg13_feature_stability")
def agg13_feature_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feature_stability(feature_records(spark, sf_dir))


@register("agg15_stability_summary")
def agg15_stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stability_summary(S.feature_stability(feature_records(spark, sf_dir)))


def fold_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harness view: unshuffled k folds, one repeat, per-fold coefficients."""
    ds = gapped_dataset(spark, sf_dir)
    folds = FO.patient_folds(ds, OUTER_SPLITS, 1, shuffle=False)
    rec = S.univariate_feature_records(ds, folds, MODEL_FEATURES, "Delta_Score", OUTER_SPLITS, "harness")
    return rec.select(
        F.col("outer_fold").alias("fold"), "feature", F.col("signed_value").alias("coefficient"),
        F.col("importance").alias("absolute_importance"), "normalized_importance",
    )


def _harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.harness_stability(fold_coefficients(spark, sf_dir), OUTER_SPLITS)


@register("agg14_harness_stability")
def agg14_harness_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harness(spark, sf_dir)


@register("agg18_coefficient_matrix")
def agg18_coefficient_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coefficient_matrix(fold_coefficients(spark, sf_dir), list(range(1, OUTER_SPLITS + 1)))


@register("jn10_stability_labels")
def jn10_stability_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stability_labels(fold_coefficients(spark, sf_dir), _harness(spark, sf_dir))


@register("win7_top_features")
def win7_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_features(_harness(spark, sf_dir), "mean_normalized_importance", "stability_rate", 5)


@register("win8_point_sizes")
def win8_point_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.point_sizes(_harness(spark, sf_dir), "importance_standard_deviation", 80.0, 270.0, 150.0)


@register("agg19_fold_score_quartiles")
def agg19_fold_score_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = M.classification_metrics(lineitem_predictions(spark, sf_dir), ["group_id"]).select(
        F.col("group_id").alias("fold"), F.col("auroc").alias("auc_roc"), "f1_score", "precision"
    )
    return S.fold_score_quartiles(fm)

