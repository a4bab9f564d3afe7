"""Model layer properties and the driver contract."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from horizonkit.operators.models import ElasticNetRegressor, FoldPreprocessor
from horizonkit.plans.nested import NestedSettings, run_harness, run_nested
from tests.conftest import SF_SMOKE


def _dataset(spark, n=40):
    rows = []
    for i in range(n):
        x = (i % 10) / 10.0
        label = 1 if (i * 37) % 100 < 30 + 40 * x else 0
        rows.append((i + 1, label, float(label * 2 + x), x if i % 7 else None, float((i * 13) % 11)))
    return spark.createDataFrame(rows, "patient_id long, y int, delta double, x1 double, x2 double")


def test_nested_binary_is_isolated_and_complete(spark):
    s = NestedSettings("binary", "y", ["x1", "x2"], "elasticnet", {"C": [1.0]},
                       outer_splits=2, outer_repeats=2, inner_splits=2, configuration_id="t")
    res = run_nested(_dataset(spark), s)
    oof = res.oof_predictions
    assert oof.count() == 80
    assert oof.groupBy("repeat", "patient_id").count().filter("count != 1").count() == 0
    fits = res.fold_assignments.select("fit_id").distinct().count()
    assert fits == 4 and res.fold_metrics.count() == 4
    sums = res.feature_records.groupBy("fit_id").agg(F.sum("normalized_importance").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) or r["s"] == 0.0 for r in sums)
    assert res.tuning_results.count() == 4


def test_nested_continuous_has_null_probabilities(spark):
    s = NestedSettings("continuous", "delta", ["x1", "x2"], "elasticnet", {"alpha": [0.1]},
                       outer_splits=2, outer_repeats=2, inner_splits=2, configuration_id="c")
    oof = run_nested(_dataset(spark), s).oof_predictions
    assert oof.filter(F.col("y_probability").isNotNull()).count() == 0
    assert oof.count() == 80


def test_settings_are_validated():
    with pytest.raises(ValueError):
        NestedSettings("binary", "y", ["x"], outer_splits=1).validate()
    with pytest.raises(ValueError):
        NestedSettings("binary", "y", [], ).validate()


def test_preprocessor_uses_fit_part_only(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (None,), (10.0,)], "x double")
    model = FoldPreprocessor(inputCols=["x"]).fit(train)
    assert model.fill["x"] == 2.0
    filled = np.array([1.0, 2.0, 2.0, 10.0])
    assert model.means["x"] == pytest.approx(filled.mean())
    assert model.scales["x"] == pytest.approx(filled.std())


def test_linear_penalty_mapping_matches_objective(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(scale=0.5, size=200)
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)],
                               ["features", "label"])
    alpha, rho = 0.3, 0.5
    m = ElasticNetRegressor(alpha=alpha, l1Ratio=rho).fit(df)
    w, b0 = m.coefficients.toArray(), m.intercept

    def obj(w, b0):
        r = y - x @ w - b0
        return (r @ r) / (2 * len(y)) + alpha * rho * np.abs(w).sum() + alpha * (1 - rho) / 2 * (w @ w)

    base = obj(w, b0)
    for d in ([1e-3, 0], [0, 1e-3], [-1e-3, 0], [0, -1e-3]):
        assert obj(w + np.array(d), b0) >= base - 1e-9


def test_harness_reports_folds(spark):
    res = run_harness(_dataset(spark, 60), "y", ["x1", "x2"], 3)
    assert res.fold_metrics.count() == 3
    assert res.feature_stability.count() == 2


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["PATNO", "Baseline_Score", "Target_Score", "Delta_Score"]
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql).issubset(qs)
    assert len(qs) >= 60


def test_smoke_queries_run_on_sf0001(spark):
    for name in ("agg2_cohort_ledger", "agg10_classification_metrics", "val3_stratified_folds",
                 "agg13_feature_stability"):
        assert E.queries()[name](spark, SF_SMOKE).count() > 0
