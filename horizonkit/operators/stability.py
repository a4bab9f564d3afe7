"""Feature records and stability summaries (VAL15 data part, WIN3, WIN4,
AGG13, AGG14, AGG15, AGG18, AGG19, JN10, WIN7, WIN8).

Per-fit windows (rank, share of total) are partitioned by fit: a fit holds
one row per feature, so each window partition is configuration-sized.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIT_KEYS = ("configuration_id", "fit_id", "repeat", "outer_fold")


def rank_and_share(records: DataFrame, fit_keys: Sequence[str] = ("fit_id",)) -> DataFrame:
    """WIN3 + WIN4: average-method descending rank and normalised importance.

    rank = (rows with larger importance) + (ties + 1) / 2; share = importance /
    total within the fit, 0 when the total is 0.
    """
    by_fit = Window.partitionBy(*fit_keys)
    ties = Window.partitionBy(*fit_keys, "importance")
    rk = F.rank().over(by_fit.orderBy(F.desc("importance")))
    total = F.sum("importance").over(by_fit)
    return records.withColumns(
        {
            "rank": (rk + (F.count(F.lit(1)).over(ties) - 1) / 2.0).cast("double"),
            "normalized_importance": F.when(total > 0, F.col("importance") / total).otherwise(F.lit(0.0)),
        }
    )


def univariate_feature_records(
    dataset: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    target: str,
    n_splits: int,
    configuration_id: str | None,
    id_col: str = "patient_id",
    configuration_col: str | None = None,
) -> DataFrame:
    """Fold-local univariate association of each feature with the target.

    signed_value = Pearson correlation over the training part of the fit
    (complete pairs), importance = |signed_value|. Training sums are built
    from per-test-fold sums combined over the K-1 training folds, so no
    subject row is copied per fold. With ``configuration_col`` the folds and
    the dataset carry a configuration column and every configuration gets
    its own records in the same pass.
    """
    g = [configuration_col] if configuration_col else []
    wide = folds.select(*g, id_col, "repeat", "fold").join(
        dataset.select(*g, id_col, F.col(target).cast("double").alias("_y"),
                       *[F.col(f).cast("double").alias(f) for f in features]),
        [*g, id_col], "inner",
    )
    long = wide.unpivot([*g, id_col, "repeat", "fold", "_y"], list(features), "feature", "x").filter(
        F.col("x").isNotNull() & F.col("_y").isNotNull()
    )
    x, y = F.col("x"), F.col("_y")
    per = long.groupBy(*g, "repeat", "fold", "feature").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    parts = per.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(int(n_splits))))).filter(
        F.col("fold") != F.col("outer_fold")
    )
    s = parts.groupBy(*g, "repeat", "outer_fold", "feature").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    corr = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0))
    cfg = F.col(configuration_col) if configuration_col else F.lit(configuration_id)
    rec = s.select(
        cfg.alias("configuration_id"),
        F.concat(cfg, F.lit("-r"), F.col("repeat").cast("string"),
                 F.lit("-f"), F.col("outer_fold").cast("string")).alias("fit_id"),
        F.col("repeat").cast("int").alias("repeat"),
        F.col("outer_fold").cast("int").alias("outer_fold"),
        F.lit("univariate").alias("model_family"),
        F.lit("coefficient").alias("importance_type"),
        "feature",
        F.round(corr, 12).alias("signed_value"),
    ).withColumn("importance", F.abs("signed_value"))
    return rank_and_share(rec)


def feature_stability(records: DataFrame, group_cols: Sequence[str] = ("configuration_id",)) -> DataFrame:
    """AGG13: per (configuration, feature) stability summary.

    inclusion = fits with importance > 0 / all fits of the configuration;
    sign consistency = max(positive, negative) / included (null if none);
    rank SD is the population SD; rank stability = max(0, 1 - SD / max(1,
    largest rank of the configuration)). The per-configuration totals are a
    window over the configuration's features, whose rows and fit lists are
    bounded by the settings, so the records are read once and nothing is joined.
    """
    g = list(group_cols)
    inc = F.col("importance") > 0
    per = records.groupBy(*g, "feature").agg(
        F.avg("normalized_importance").alias("mean_importance"),
        F.count_if(inc).alias("_inc"),
        F.count_if(inc & (F.col("signed_value") > 0)).alias("_pos"),
        F.count_if(inc & (F.col("signed_value") < 0)).alias("_neg"),
        F.avg("rank").alias("mean_rank"),
        F.stddev_pop("rank").alias("rank_standard_deviation"),
        F.max("rank").cast("double").alias("_rank"),
        F.collect_set("fit_id").alias("_ids"),
    )
    whole = Window.partitionBy(*g)
    out = per.withColumns({
        "_fits": F.size(F.array_distinct(F.flatten(F.collect_list("_ids").over(whole)))),
        "_max_rank": F.greatest(F.max("_rank").over(whole), F.lit(1.0)),
    })
    return out.select(
        *g, "feature", "mean_importance",
        (F.col("_inc") / F.col("_fits")).alias("inclusion_frequency"),
        F.when(F.col("_inc") > 0, F.greatest("_pos", "_neg") / F.col("_inc")).alias("sign_consistency"),
        "mean_rank", "rank_standard_deviation",
        F.greatest(F.lit(0.0), 1 - F.col("rank_standard_deviation") / F.col("_max_rank")).alias("rank_stability"),
        F.size("_ids").cast("bigint").alias("n_fits"),
    )


def harness_stability(fold_coefficients: DataFrame, n_splits: int) -> DataFrame:
    """AGG14: mean / SD (ddof 1) of normalised importance, mean coefficient,
    non-zero folds and their rate over ``n_splits``."""
    return fold_coefficients.groupBy("feature").agg(
        F.avg("normalized_importance").alias("mean_normalized_importance"),
        F.stddev_samp("normalized_importance").alias("importance_standard_deviation"),
        F.avg("coefficient").alias("mean_coefficient"),
        F.count_if(F.col("coefficient") != 0).cast("bigint").alias("nonzero_folds"),
    ).withColumn("stability_rate", F.col("nonzero_folds") / F.lit(float(n_splits)))


def stability_summary(stability: DataFrame, top_k: int = 5) -> DataFrame:
    """AGG15: per configuration, counts / means and the top-k stable features.

    Top features order: rank_stability desc, mean_importance desc, then the
    stability table's own order (mean_rank, feature). The per-configuration
    list has one entry per feature (configuration-sized).
    """
    key = F.struct(
        (-F.col("rank_stability")).alias("a"), (-F.col("mean_importance")).alias("b"),
        F.col("mean_rank").alias("c"), F.col("feature").alias("d"),
    )
    return stability.groupBy("configuration_id").agg(
        F.count_distinct("feature").cast("bigint").alias("feature_count"),
        F.avg("sign_consistency").alias("mean_sign_consistency"),
        F.avg("inclusion_frequency").alias("mean_inclusion_frequency"),
        F.avg("rank_stability").alias("mean_rank_stability"),
        F.array_join(
            F.transform(F.slice(F.array_sort(F.collect_list(key)), 1, top_k), lambda s: s["d"]), ";"
        ).alias("top_stable_features"),
    )


def top_features(stability: DataFrame, importance: str, score: str, k: int = 5,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """WIN7: top-k features by importance x score (ties: score, importance).

    ``max_by``-style top-k per group via a bounded ``row_number``; with no
    group the table is the per-feature stability table (feature-sized).
    """
    rank_key = F.col(importance) * F.col(score)
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    ordered = w.orderBy(F.desc(rank_key), F.desc(score), F.desc(importance), F.asc("feature"))
    return stability.withColumn("position", F.row_number().over(ordered)).filter(F.col("position") <= k).select(
        *group_cols, "position", "feature", F.col(importance), F.col(score)
    )


def point_sizes(stability: DataFrame, sd_col: str, low: float = 70.0, span: float = 260.0,
                constant: float = 130.0) -> DataFrame:
    """WIN8: min-max scaled inverse SD (constant size when all equal)."""
    inv = 1.0 / (F.coalesce(F.col(sd_col), F.lit(0.0)) + F.lit(1e-9))
    w = Window.partitionBy(F.lit(0))  # one row per feature: feature-sized
    lo, hi = F.min(inv).over(w), F.max(inv).over(w)
    return stability.select(
        "feature",
        F.when(hi - lo == 0, F.lit(constant)).otherwise(low + (inv - lo) / (hi - lo) * span).alias("size"),
    )


def coefficient_matrix(fold_coefficients: DataFrame, folds: Sequence[int], value: str = "coefficient") -> DataFrame:
    """AGG18: feature x fold mean coefficient (pivot with explicit fold list)."""
    return fold_coefficients.groupBy("feature").pivot("fold", list(folds)).agg(F.avg(value))


def stability_labels(fold_coefficients: DataFrame, stability: DataFrame) -> DataFrame:
    """JN10: ``feature (stability=0.67)`` label; ``nan`` when not found."""
    rates = stability.select("feature", "stability_rate")
    j = fold_coefficients.select("feature").distinct().join(rates, "feature", "left")
    return j.select(
        "feature",
        F.concat(
            F.col("feature"), F.lit(" (stability="),
            F.coalesce(F.format_number(F.col("stability_rate"), 2), F.lit("nan")), F.lit(")"),
        ).alias("label"),
    )


def fold_score_quartiles(fold_metrics: DataFrame, metrics: Sequence[str] = ("auc_roc", "f1_score", "precision"),
                         labels: dict[str, str] | None = None) -> DataFrame:
    """AGG19: long form of fold scores and their five-number summary."""
    labels = labels or {"auc_roc": "AUC-ROC", "f1_score": "F1-score", "precision": "Precision"}
    long = fold_metrics.unpivot(["fold"], list(metrics), "metric", "score").filter(F.col("score").isNotNull())
    label = F.coalesce(
        F.element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), F.col("metric")),
        F.col("metric"),
    )
    return long.groupBy(label.alias("metric")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min("score").alias("q0"),
        F.percentile("score", F.lit(0.25)).alias("q1"),
        F.percentile("score", F.lit(0.5)).alias("q2"),
        F.percentile("score", F.lit(0.75)).alias("q3"),
        F.max("score").alias("q4"),
    )
