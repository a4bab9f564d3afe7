"""Prediction metrics computed for many groups (fits) at once.

AGG9 regression metrics, AGG10 classification metrics, AGG11 calibration,
WIN5 cumulative counts / ROC points, VAL13 threshold choice, AGG20 residual
histogram.

Rank metrics are exact and tie-aware. Predictions are first pre-aggregated
to one row per (group, score) with positive / negative counts - partial
aggregation map-side - and only those rows meet the cumulative window
(ordered by score inside each group). Tied scores form one step, as in the
trapezoid ROC area and in average precision.

``BinaryClassificationEvaluator`` is not used on purpose: its PR area is a
different estimator than average precision and its ROC curve is binned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from horizonkit.operators.quantiles import running_totals


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _guard_finite(cols: Sequence[str]) -> Column:
    bad = None
    for c in cols:
        cond = ~_finite(F.col(c))
        bad = cond if bad is None else (bad | cond)
    return bad


def regression_metrics(
    df: DataFrame, group_cols: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """AGG9: MAE, RMSE, R^2, residual mean and residual SD (ddof 1) per group.

    R^2 = 1 - SSE / SST with SST = n * var_pop(y) (Spark's numerically stable
    moments); constant truth gives 1.0 when SSE is 0, else 0.0. Non-finite
    inputs raise when the aggregate runs (``raise_error``), so no extra pass.
    """
    r = F.col(y_true) - F.col(y_pred)
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_guard_finite([y_true, y_pred])).alias("_bad"),
        F.avg(F.abs(r)).alias("mae"),
        F.avg(r * r).alias("_mse"),
        F.sum(r * r).alias("_sse"),
        F.var_pop(y_true).alias("_var"),
        F.avg(r).alias("residual_mean"),
        F.stddev_samp(r).alias("residual_standard_deviation"),
    )
    sst = F.col("_var") * F.col("n")
    r2 = (
        F.when(sst > 0, 1 - F.col("_sse") / sst)
        .when(F.col("_sse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return agg.select(
        *group_cols,
        F.when(F.col("_bad") > 0, F.raise_error(F.lit("Metric inputs must contain only finite values.")))
        .otherwise(F.col("n")).cast("bigint").alias("n"),
        "mae",
        F.sqrt("_mse").alias("rmse"),
        r2.alias("r2"),
        "residual_mean",
        "residual_standard_deviation",
    )


def score_counts(
    df: DataFrame, group_cols: Sequence[str], y_true: str, score: str, weight: str | None = None
) -> DataFrame:
    """(group, score) -> pos, neg (weighted when ``weight`` is given)."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*group_cols, score).agg(
        F.sum(F.when(F.col(y_true) == 1, w).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col(y_true) == 1, 0).otherwise(w)).cast("double").alias("neg"),
    )


def cumulative_counts(counts: DataFrame, group_cols: Sequence[str], score: str,
                      n_buckets: int = 256) -> DataFrame:
    """WIN5: running TP / FP over descending score (ties are one step).

    Adds tp, fp (counts with score >= this score), neg_below (negatives with a
    strictly lower score), n_pos, n_neg. ``counts`` has one row per (group,
    distinct score); no task holds a whole group (``operators.quantiles``).
    """
    run = running_totals(counts, group_cols, score, ["pos", "neg"], descending=True, n_buckets=n_buckets)
    return run.select(
        *group_cols, score, "pos", "neg",
        F.col("_upto_pos").alias("tp"), F.col("_upto_neg").alias("fp"),
        F.col("_total_pos").alias("n_pos"), F.col("_total_neg").alias("n_neg"),
    ).withColumn("neg_below", F.col("n_neg") - F.col("fp"))


def roc_points(
    df: DataFrame, group_cols: Sequence[str], y_true: str = "y_true", score: str = "y_probability"
) -> DataFrame:
    """WIN5 output: one ROC/PR point per (group, distinct score)."""
    cum = cumulative_counts(score_counts(df, group_cols, y_true, score), group_cols, score)
    return cum.select(
        *group_cols,
        F.col(score).alias("threshold"),
        F.col("tp").cast("bigint").alias("tp"),
        F.col("fp").cast("bigint").alias("fp"),
        (F.col("tp") / F.col("n_pos")).alias("tpr"),
        (F.col("fp") / F.col("n_neg")).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def rank_metrics(counts: DataFrame, group_cols: Sequence[str], score: str) -> DataFrame:
    """AUROC (Mann-Whitney with mid-ranks) and average precision per group."""
    cum = cumulative_counts(counts, group_cols, score)
    return cum.groupBy(*group_cols).agg(
        F.first("n_pos").alias("n_pos"),
        F.first("n_neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
    ).select(
        *group_cols,
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
        .alias("auroc"),
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_ap") / F.col("n_pos")).alias("auprc"),
    )


#: Newton steps of a calibration fit; a group still moving by more than the tolerance then has no result.
CALIBRATION_STEPS = 24
CALIBRATION_TOLERANCE = 1e-6
#: Inverse penalty of the slope (nearly none), and the clip of probabilities before their logit.
CALIBRATION_C, CALIBRATION_CLIP = 1e6, 1e-6


#: A group of at most so many distinct scores is fitted where its rows lie; the others are fitted by joins.
CALIBRATION_ROWS = 50_000


def _newton_fits(x: np.ndarray, pos: np.ndarray, w: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, ...]:
    """Intercept, slope and whether the fit rests, of the groups that begin at the rows ``start``."""
    size = np.diff(np.append(start, len(x)))
    total = lambda v: np.add.reduceat(v, start)
    ones = total(pos)
    fits = (ones > 0) & (ones < total(w)) & (np.minimum.reduceat(x, start) < np.maximum.reduceat(x, start))
    a, b, step = (np.zeros(len(start)) for _ in range(3))
    with np.errstate(all="ignore"):
        for _ in range(steps):
            s = 1 / (1 + np.exp(-(np.repeat(a, size) + np.repeat(b, size) * x)))
            r, h = w * s - pos, w * s * (1 - s)
            g0, g1, h0, h1 = total(r), total(r * x) + b / CALIBRATION_C, total(h), total(h * x)
            h2 = total(h * x * x) + 1 / CALIBRATION_C
            det = h0 * h2 - h1 * h1
            fits &= det > 0
            da, db = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
            a, b, step = np.where(fits, a - da, 0), np.where(fits, b - db, 0), np.maximum(np.abs(da), np.abs(db))
    return a, b, fits & (step < CALIBRATION_TOLERANCE)


def _fit_small_groups(data: DataFrame, g: list[str], steps: int) -> DataFrame:
    """All steps of every group in one pass over the rows sorted by group; a task holds a batch and one group."""
    schema = StructType([*[data.schema[c] for c in g], StructField("_a", DoubleType()), StructField("_b", DoubleType())])

    def fitted(rows: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        a, b, rests = _newton_fits(*(rows[c].to_numpy() for c in ("_x", "pos", "_w")), start, steps)
        keys = rows.select(g).take(pa.array(start)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*[keys[c].combine_chunks() for c in g], pa.array(a, mask=~rests), pa.array(b, mask=~rests)], names=[*g, "_a", "_b"])

    def fit(batches):
        rest = None  # the last group's rows so far
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            for c in g:
                new[1:] |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, len(rows) - 1)).to_numpy()
            new[0] = True
            start = np.flatnonzero(new)
            rest = rows.slice(start[-1])
            if len(start) > 1:
                yield fitted(rows.slice(0, start[-1]), start[:-1])
        if rest is not None:
            yield fitted(rest, np.zeros(1, np.int64))

    return data.select(*g, "_x", "pos", "_w").repartition(*g).sortWithinPartitions(*g).mapInArrow(fit, schema)


def _fit_large_groups(data: DataFrame, first: DataFrame, g: list[str], steps: int) -> DataFrame:
    """Unrolled Newton steps: the groups' parameters meet their rows, gradient and Hessian are summed by group.

    A large group's rows are spread. The parameters, one row per large group, are
    broadcast, so each step is a stage of its own and no task runs several.
    """
    data = data.repartition(*g, "_x")
    x, a, b = F.col("_x"), F.col("_a"), F.col("_b")
    fit = first.select(*g, "_fits", F.lit(0.0).alias("_a"), F.lit(0.0).alias("_b"), F.lit(0.0).alias("_step"))
    for _ in range(steps):
        s = 1 / (1 + F.exp(-(a + b * x)))
        r, h = F.col("_w") * s - F.col("pos"), F.col("_w") * s * (1 - s)
        sums = data.join(F.broadcast(fit), g).groupBy(*g).agg(
            *[F.first(c).alias(c) for c in ("_fits", "_a", "_b")], F.sum(r).alias("_g0"), F.sum(r * x).alias("_g1"),
            F.sum(h).alias("_h0"), F.sum(h * x).alias("_h1"), F.sum(h * x * x).alias("_h2"))
        g1, h2 = F.col("_g1") + b / CALIBRATION_C, F.col("_h2") + 1 / CALIBRATION_C
        det = F.col("_h0") * h2 - F.col("_h1") * F.col("_h1")
        da = (h2 * F.col("_g0") - F.col("_h1") * g1) / det
        db = (F.col("_h0") * g1 - F.col("_h1") * F.col("_g0")) / det
        open_ = F.col("_fits") & (det > 0)
        fit = sums.select(*g, open_.alias("_fits"), F.when(open_, a - da).alias("_a"), F.when(open_, b - db).alias("_b"),
                          F.when(open_, F.greatest(F.abs(da), F.abs(db))).alias("_step"))
    rests = F.col("_fits") & (F.col("_step") < CALIBRATION_TOLERANCE)
    return fit.select(*g, F.when(rests, a).alias("_a"), F.when(rests, b).alias("_b"))


def calibration_from_counts(counts: DataFrame, group_cols: Sequence[str], score: str,
                            steps: int = CALIBRATION_STEPS, small: int = CALIBRATION_ROWS) -> DataFrame:
    """AGG11: intercept and slope of label ~ logit(clipped score) per group, from a (group, score, pos, neg) table.

    A fixed number of Newton steps from zero in one lazy plan. Groups of at most
    ``small`` scores take all their steps in one pass; larger ones, whose number
    is below rows / ``small``, take each step by a join and a grouped sum with
    their rows spread. The slope has an L2 penalty of 1 / C, which gives classes
    that a threshold separates a finite fit too, after about 20 steps. Null for a
    group with one class, with one logit, or whose fit has not come to rest.
    """
    g = list(group_cols)
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(CALIBRATION_CLIP)), F.lit(1 - CALIBRATION_CLIP))
    data = counts.select(*g, F.log(p / (1 - p)).alias("_x"), "pos", (F.col("pos") + F.col("neg")).alias("_w"))
    data = data.dropna(subset=g)
    large = data.groupBy(*g).agg(
        F.count(F.lit(1)).alias("_rows"), (F.sum("pos") > 0).alias("_has1"), (F.sum("pos") < F.sum("_w")).alias("_has0"),
        (F.min("_x") < F.max("_x")).alias("_varies"),
    ).filter(F.col("_rows") > small).select(*g, (F.col("_has1") & F.col("_has0") & F.col("_varies")).alias("_fits"))
    keys = F.broadcast(large.select(*g))
    fit = _fit_small_groups(data.join(keys, g, "left_anti"), g, steps).unionByName(
        _fit_large_groups(data.join(keys, g, "left_semi"), large, g, steps))
    return fit.select(*g, F.col("_a").alias("calibration_intercept"), F.col("_b").alias("calibration_slope"))


def classification_metrics(
    df: DataFrame,
    group_cols: Sequence[str],
    y_true: str = "y_true",
    probability: str = "y_probability",
    prediction: str = "y_pred",
    calibration: bool = True,
) -> DataFrame:
    """AGG10: AUROC, AUPRC, Brier, calibration intercept and slope, precision, recall, F1 per group.

    AUROC / AUPRC and calibration are null when a group has one class;
    precision, recall and F1 are 0 on an empty denominator. Labels outside {0,1}
    or probabilities outside [0,1] raise when the aggregate runs. The rows are
    reduced once to (group, score) counts, which serve every metric.
    """
    y, p, yh = F.col(y_true), F.col(probability), F.col(prediction)
    bad = ~y.isin(0, 1) | ~_finite(p) | (p < 0) | (p > 1) | ~yh.isin(0, 1)
    counts = df.groupBy(*group_cols, probability).agg(
        F.count_if(y == 1).cast("double").alias("pos"),
        F.count_if((y != 1) | y.isNull()).cast("double").alias("neg"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("_bad"),
        F.count_if((y == 1) & (yh == 1)).alias("_tp"),
        F.count_if((y == 0) & (yh == 1)).alias("_fp"),
        F.count_if((y == 1) & (yh == 0)).alias("_fn"),
    )
    off = F.col(probability)
    simple = counts.groupBy(*group_cols).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("_bad").alias("_bad"),
        (F.sum(F.col("pos") * (1 - off) * (1 - off) + F.col("neg") * off * off) / F.sum(F.col("pos") + F.col("neg")))
        .alias("brier_score"),
        *[F.sum(c).alias(c) for c in ("_tp", "_fp", "_fn")],
    )
    scored = counts.select(*group_cols, probability, "pos", "neg")
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    out = simple.join(rank_metrics(scored, group_cols, probability), list(group_cols), "inner")
    if calibration:
        out = out.join(calibration_from_counts(scored, group_cols, probability), list(group_cols), "left")
    return out.select(
        *group_cols,
        F.when(F.col("_bad") > 0, F.raise_error(F.lit("Classification inputs are invalid.")))
        .otherwise(F.col("n")).cast("bigint").alias("n"),
        "auroc",
        "auprc",
        "brier_score",
        *(["calibration_intercept", "calibration_slope"] if calibration else []),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1_score"),
    )


def select_threshold(
    df: DataFrame,
    group_cols: Sequence[str],
    y_true: str = "y_true",
    probability: str = "y_probability",
    method: str = "youden",
    extra_candidates: Sequence[float] = (0.01, 0.99),
) -> DataFrame:
    """VAL13: best threshold per group among distinct probabilities + extras.

    Predicted positive = probability >= threshold. Youden J = TPR - FPR, or
    F1; ties go to the lowest threshold. One cumulative window over the
    (group, candidate) table, then ``max_by`` per group.
    """
    if method not in ("youden", "f1"):
        raise ValueError("threshold_selection must be youden or f1 here (fixed needs no data).")
    counts = score_counts(df, group_cols, y_true, probability).withColumnRenamed(probability, "threshold")
    groups = counts.select(*group_cols).distinct()
    extras = groups.withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(x)) for x in extra_candidates]))
    ).withColumns({"pos": F.lit(0.0), "neg": F.lit(0.0)})
    cand = counts.unionByName(extras).groupBy(*group_cols, "threshold").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    cum = cumulative_counts(cand, group_cols, "threshold")
    if method == "youden":
        score = F.col("tp") / F.col("n_pos") - F.col("fp") / F.col("n_neg")
    else:
        fn = F.col("n_pos") - F.col("tp")
        denom = 2 * F.col("tp") + F.col("fp") + fn
        score = F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(0.0)
    scored = cum.withColumn("score", score).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    best = scored.groupBy(*group_cols).agg(
        F.max_by(F.struct("threshold", "score"), F.struct(F.col("score"), -F.col("threshold"))).alias("b")
    )
    return best.select(*group_cols, F.col("b.threshold").alias("threshold"), F.col("b.score").alias("score"))


def residual_histogram(df: DataFrame, residual: str = "residual", bins: int = 30) -> DataFrame:
    """AGG20: equal-width bins over [min, max] of the residuals.

    min / max enter as scalar subqueries (one tiny job each), the binning is
    a plain grouped count.
    """
    bounds = df.agg(F.struct(F.min(residual).alias("lo"), F.max(residual).alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col(residual) - lo) / width), F.lit(bins - 1))
    ).cast("int")
    out = df.filter(F.col(residual).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count")
    )
    return out.select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "count",
    )
