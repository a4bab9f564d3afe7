"""The distributed forest against ``pyspark.ml``: split points and trees without draws, then drawn forests."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from horizonkit.operators import forest as FR
from horizonkit.plans import nested

FEATURES = ["a", "b", "c", "still"]


def _rows(spark, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.gauss(0, 1), rng.choice([0.0, 0.0, 0.0, 1.0, rng.random() * 9]), float(rng.randrange(12))
        rows.append((k, a, b, c, 2.0, 1000 + 3 * a * a + (b > 2) * c + rng.gauss(0, 0.3), k % 5 != 0))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, still double, y double, train boolean")


def _by_id(df):
    return {r["id"]: r["prediction"] for r in df.select("id", "prediction").collect()}


def test_a_tree_without_draws_is_that_of_pyspark_ml(spark):
    rows = _rows(spark, 3000).cache()
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    for leaf, ties in ((20, 0), (2, 6)):  # among few rows two features may split alike, and either may be taken
        want = DecisionTreeRegressor(labelCol="y", minInstancesPerNode=leaf, maxDepth=30).fit(table.filter("train"))
        own = _by_id(FR.forest_predictions(rows, FEATURES, "y", "train", 1, leaf, bootstrap=False))
        theirs = _by_id(want.transform(table.filter("not train")))
        assert own.keys() == theirs.keys() and len(own) == 600
        assert sum(abs(own[k] - theirs[k]) > 1e-6 for k in own) <= ties


def test_a_drawn_forest_is_as_good_and_repeatable_and_no_model_is_gathered(spark, monkeypatch):
    monkeypatch.setattr(FR, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(FR, "NODES_AT_ONCE", 7)
    rows = _rows(spark, 3000).cache()
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    theirs = _by_id(RandomForestRegressor(labelCol="y", minInstancesPerNode=2, maxDepth=30, numTrees=30, seed=1,
                                          featureSubsetStrategy="all").fit(table.filter("train")).transform(table.filter("not train")))
    own = _by_id(FR.forest_predictions(rows, FEATURES, "y", "train", 30))
    again = _by_id(FR.forest_predictions(rows.repartition(3), FEATURES, "y", "train", 30))
    y = {r["id"]: r["y"] for r in rows.collect()}
    error = lambda p: np.mean([abs(y[k] - v) for k, v in p.items()])
    assert own.keys() == again.keys() == theirs.keys()
    assert np.allclose([own[k] for k in own], [again[k] for k in own], rtol=1e-9)
    assert abs(error(own) - error(theirs)) < 0.1 * error(theirs)


def test_cells_do_not_outgrow_bins_and_odd_values_are_kept(spark):
    few = spark.createDataFrame([(float(k % 3), 1.0, float(k), True) for k in range(9)] + [(9.0, 5.0, None, False)],
                                "x double, still double, y double, train boolean")
    found = FR.forest_predictions(few, ["x", "still"], "y", "train", 1, 2, bootstrap=False).collect()
    assert [r.prediction for r in found] == [pytest.approx(5.0)]  # rows with x = 2: 2, 5, 8
    heavy = spark.createDataFrame([(0.0,)] * 500 + [(float(k),) for k in range(1, 501)], "x double")
    points = FR.split_points(heavy, ["x"])["x"]
    assert len(points) == 31 and points[:3] == [0.5, 1.5, 2.5]
    bad = few.withColumn("y", F.when(F.col("y") == 4, float("nan")).otherwise(F.col("y")))
    with pytest.raises(Exception, match="Targets must not be null or NaN"):
        FR.forest_predictions(bad, ["x", "still"], "y", "train", 1).collect()


def test_legacy_endpoint_fits_without_a_model_on_the_driver(spark, monkeypatch):
    import pyspark.ml.regression as R

    def refuse(*_, **__):
        raise AssertionError("a whole forest would be gathered")

    monkeypatch.setattr(R, "RandomForestRegressor", refuse)
    ds = _rows(spark, 400).withColumnRenamed("id", "PATNO").withColumn("a", F.when(F.col("PATNO") % 7 > 0, F.col("a")))
    row = nested.run_legacy_endpoint(ds.withColumn("PATNO", F.floor(F.col("PATNO") / 4)), FEATURES, "y", "E",
                                     n_estimators=10).first()
    assert (row.endpoint, row.n_observations, row.n_patients) == ("E", 400, 100) and row.r2 > 0.3
