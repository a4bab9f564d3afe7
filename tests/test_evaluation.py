"""Folds, metrics, bootstrap, stability, preprocessing and quantiles."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from horizonkit.errors import PatientLeakageError
from horizonkit.operators import bootstrap as B
from horizonkit.operators import folds as FO
from horizonkit.operators import metrics as M
from horizonkit.operators import preprocess as P
from horizonkit.operators import stability as S
from horizonkit.operators.models import calibration_parameters
from horizonkit.operators.quantiles import exact_quantile


def _patients(spark, n=24):
    return spark.createDataFrame([(i, i % 2) for i in range(1, n + 1)], "patient_id long, label int")


def test_folds_disjoint_and_complete(spark):
    folds = FO.patient_folds(_patients(spark), 3, 2, seed=42)
    rows = folds.collect()
    assert len(rows) == 48
    for r in (1, 2):
        per = [x["fold"] for x in rows if x["repeat"] == r]
        assert sorted(per.count(k) for k in (1, 2, 3)) == [8, 8, 8]
    asg = FO.fold_assignments(folds, 3, "cfg")
    assert asg.count() == 24 * 3 * 2
    assert FO.overlap_report(asg).count() == 0
    FO.verify_no_overlap(asg)
    audit = FO.fold_audit(asg).collect()
    assert all(a["train_patients"] + a["test_patients"] == 24 and a["overlapping_patients"] == 0 for a in audit)


def test_stratified_folds_balance_each_class(spark):
    folds = FO.patient_folds(_patients(spark, 30), 3, 1, stratify_col="label").collect()
    for cls in (0, 1):
        per = [r["fold"] for r in folds if r["label"] == cls]
        assert sorted(per.count(k) for k in (1, 2, 3)) == [5, 5, 5]


def test_overlap_is_detected(spark):
    asg = spark.createDataFrame(
        [("c", "f", 1, 1, "train", 1), ("c", "f", 1, 1, "train", 2), ("c", "f", 1, 1, "test", 2),
         ("c", "f", 1, 1, "test", 3)],
        "configuration_id string, fit_id string, repeat int, outer_fold int, partition string, patient_id long",
    )
    with pytest.raises(PatientLeakageError, match=r"\[2\]"):
        FO.verify_no_overlap(asg)


def test_dense_index_is_exact_rank(spark):
    df = spark.range(0, 5000).withColumn("g", F.col("id") % 3).withColumn("_h", FO.subject_hash(7, "id"))
    got = FO.dense_index(df, "_h", "id", ["g"], bucket_bits=6).select("id", "g", "_h", "_pos").toPandas()
    for _, part in got.groupby("g"):
        exp = part.sort_values(["_h", "id"]).reset_index(drop=True)
        assert list(exp["_pos"]) == list(range(len(exp)))


def test_inner_folds_stay_inside_outer_training(spark):
    folds = FO.patient_folds(_patients(spark, 40), 4, 2, seed=1)
    inner = FO.inner_folds(folds, 4, 3, seed=1)
    leak = inner.join(folds.withColumnRenamed("fold", "outer_fold"), ["patient_id", "repeat", "outer_fold"])
    assert leak.count() == 0
    assert inner.count() == 40 * 2 * 3


def test_shuffle_split_takes_ceil_fifth(spark):
    split = FO.grouped_shuffle_split(_patients(spark, 11), 0.2, 42).collect()
    assert sum(r["partition"] == "test" for r in split) == 3


def test_classification_metrics_match_hand_values(spark):
    df = spark.createDataFrame(
        [(0, 0.1, 0), (0, 0.4, 0), (1, 0.35, 0), (1, 0.8, 1)], "y_true int, y_probability double, y_pred int"
    ).withColumn("g", F.lit(1))
    m = M.classification_metrics(df, ["g"]).first()
    assert m["auroc"] == pytest.approx(0.75)
    assert m["auprc"] == pytest.approx((1 / 1 + 2 / 3) / 2)
    assert m["precision"] == 1.0 and m["recall"] == 0.5 and m["f1_score"] == pytest.approx(2 / 3)
    ties = spark.createDataFrame([(0, 0.5, 0), (1, 0.5, 1), (1, 0.9, 1), (0, 0.1, 0)],
                                 "y_true int, y_probability double, y_pred int").withColumn("g", F.lit(1))
    assert M.classification_metrics(ties, ["g"]).first()["auroc"] == pytest.approx(0.875)
    one = df.withColumn("y_true", F.lit(1))
    r = M.classification_metrics(one, ["g"]).first()
    assert r["auroc"] is None and r["auprc"] is None


def test_regression_metrics_match_numpy(spark):
    y, p = [1.0, 2.0, 3.0, 7.0], [1.0, 2.5, 2.5, 5.0]
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "y_true double, y_pred double").withColumn("g", F.lit(0))
    m = M.regression_metrics(df, ["g"]).first()
    r = np.array(y) - np.array(p)
    assert m["mae"] == pytest.approx(np.mean(np.abs(r)))
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean(r * r)))
    assert m["r2"] == pytest.approx(1 - np.sum(r * r) / np.sum((np.array(y) - np.mean(y)) ** 2))
    assert m["residual_standard_deviation"] == pytest.approx(np.std(r, ddof=1))
    bad = spark.createDataFrame([(1.0, float("nan"))], "y_true double, y_pred double").withColumn("g", F.lit(0))
    with pytest.raises(Exception, match="finite"):
        M.regression_metrics(bad, ["g"]).collect()


def test_threshold_prefers_lowest_on_ties(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.3), (1, 0.6), (1, 0.7)], "y_true int, y_probability double") \
        .withColumn("g", F.lit(0))
    r = M.select_threshold(df, ["g"], method="youden").first()
    assert r["threshold"] == pytest.approx(0.6) and r["score"] == pytest.approx(1.0)


def test_bootstrap_reproducible_and_reported(spark):
    pred = spark.createDataFrame(
        [(i, [0, 1][i % 2], [0.1, 0.8, 0.2, 0.7, 0.3, 0.9, 0.4, 0.6][i], [0, 1][i % 2]) for i in range(8)],
        "patient_id long, y_true int, y_probability double, y_pred int",
    ).withColumn("configuration_id", F.lit("c"))
    a = B.bootstrap_classification(pred, n_resamples=20, seed=3).orderBy("metric").collect()
    b = B.bootstrap_classification(pred, n_resamples=20, seed=3).orderBy("metric").collect()
    assert a == b
    got = {r["metric"]: r for r in a}
    assert "auroc" in got and all(r["valid_resamples"] > 0 for r in a)
    assert got["auroc"]["estimate"] == pytest.approx(1.0)


def test_bootstrap_keeps_resample_size(spark):
    pred = spark.createDataFrame([(i % 10, float(i), float(i) + 1.0) for i in range(40)],
                                 "patient_id long, y_true double, y_pred double").withColumn("configuration_id", F.lit("c"))
    stats = pred.groupBy("configuration_id", "patient_id").count()
    w = B.resample_weights(stats, ["configuration_id"], "patient_id", 5, 42)
    sizes = {r["b"]: r["s"] for r in w.groupBy("b").agg(F.sum("w").alias("s")).collect()}
    assert sizes == {b: 10 for b in range(6)}
    out = {r["metric"]: r for r in B.bootstrap_regression(pred, n_resamples=5).collect()}
    assert out["mae"]["estimate"] == pytest.approx(1.0) and out["mae"]["ci_lower"] == pytest.approx(1.0)


def test_stability_reports_sign_inclusion_and_rank(spark):
    rec = spark.createDataFrame(
        [("a", "x", 1.0, 1.0, 1.0, 1.0), ("b", "x", 2.0, 0.67, 2.0, 1.0),
         ("a", "y", 0.0, 0.0, 0.0, 2.0), ("b", "y", 1.0, 0.33, -1.0, 2.0)],
        "fit_id string, feature string, importance double, normalized_importance double, signed_value double, "
        "rank double",
    ).withColumn("configuration_id", F.lit("c"))
    st = {r["feature"]: r for r in S.feature_stability(rec).collect()}
    assert st["x"]["sign_consistency"] == 1.0
    assert st["y"]["inclusion_frequency"] == 0.5
    assert st["x"]["rank_stability"] == 1.0


def test_rank_is_average_method_and_share_sums_to_one(spark):
    rec = spark.createDataFrame([("f", "a", 3.0), ("f", "b", 1.0), ("f", "c", 1.0), ("f", "d", 0.0)],
                                "fit_id string, feature string, importance double")
    out = {r["feature"]: r for r in S.rank_and_share(rec).collect()}
    assert [out[k]["rank"] for k in "abcd"] == [1.0, 2.5, 2.5, 4.0]
    assert sum(r["normalized_importance"] for r in out.values()) == pytest.approx(1.0)


def test_fold_imputation_and_scaling_match_numpy(spark):
    rows = [(i, (i % 3) + 1, 1, float(i) if i % 4 else None) for i in range(1, 31)]
    long = spark.createDataFrame(rows, "patient_id long, fold int, repeat int, value double").withColumn(
        "feature", F.lit("x"))
    imp = {r["outer_fold"]: r["impute_value"] for r in P.imputation_values(long, 3, "median").collect()}
    sc = {r["outer_fold"]: r for r in P.scaling_stats(long, P.imputation_values(long, 3, "median"), 3).collect()}
    for f in (1, 2, 3):
        vals = [v for (_, fold, _, v) in rows if fold != f]
        present = [v for v in vals if v is not None]
        m = float(np.median(present))
        assert imp[f] == pytest.approx(m)
        filled = np.array([v if v is not None else m for v in vals])
        assert sc[f]["mean"] == pytest.approx(filled.mean())
        assert sc[f]["sd"] == pytest.approx(filled.std())
    mf = P.imputation_values(spark.createDataFrame([(1, 1, 1, 2.0), (2, 2, 1, 1.0), (3, 2, 1, 2.0), (4, 2, 1, 1.0)],
                                                   "patient_id long, fold int, repeat int, value double")
                             .withColumn("feature", F.lit("x")), 2, "most_frequent")
    assert {r["outer_fold"]: r["impute_value"] for r in mf.collect()}[1] == 1.0


def test_exact_quantile_bucketed_path_equals_percentile(spark):
    df = spark.range(0, 2001).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1013).cast("double").alias("v"))
    fast = {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "v", 0.5).collect()}
    slow = {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "v", 0.5, n_buckets=16).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        assert fast[g] == pytest.approx(float(np.quantile(part["v"], 0.5)))
        assert slow[g] == pytest.approx(fast[g])


def test_calibration_matches_newton_in_numpy(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 400)
    y = (rng.uniform(size=400) < p).astype(int)
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, p, strict=True)],
                               "g int, y_true int, y_probability double")
    r = calibration_parameters(df, ["g"]).first()
    x = np.log(p / (1 - p))
    a = b = 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-(a + b * x)))
        g0, g1 = np.sum(s - y), np.sum((s - y) * x) + b / 1e6
        w = s * (1 - s)
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1 / 1e6]])
        d = np.linalg.solve(h, [g0, g1])
        a, b = a - d[0], b - d[1]
    assert r["calibration_intercept"] == pytest.approx(a, abs=1e-6)
    assert r["calibration_slope"] == pytest.approx(b, abs=1e-6)
    one = df.withColumn("y_true", F.lit(1))
    assert calibration_parameters(one, ["g"]).first()["calibration_slope"] is None
    assert not math.isnan(r["calibration_slope"])


def test_weighted_median_bucketed_path_is_exact(spark):
    from horizonkit.operators.quantiles import weighted_median

    rows = [(g, float((i * 37) % 101), 1 + (i % 3)) for g in range(3) for i in range(400 + g)]
    df = spark.createDataFrame(rows, "g int, value double, c long")
    fast = {r["g"]: r["median"] for r in weighted_median(df, ["g"]).collect()}
    slow = {r["g"]: r["median"] for r in weighted_median(df, ["g"], n_buckets=8).collect()}
    for g in range(3):
        expanded = [v for (gg, v, c) in rows if gg == g for _ in range(c)]
        assert fast[g] == pytest.approx(float(np.median(expanded)))
        assert slow[g] == pytest.approx(fast[g])


def test_bucketed_running_counts_equal_window(spark):
    rows = [(g, float((i * 7919) % 997) / 997.0, i % 3, 1 + i % 2) for g in range(2) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, s double, a int, b int") \
        .groupBy("g", "s").agg(F.sum("a").cast("double").alias("pos"), F.sum("b").cast("double").alias("neg"))
    fast = {(r["g"], r["s"]): (r["tp"], r["fp"], r["n_pos"]) for r in M.cumulative_counts(df, ["g"], "s").collect()}
    slow = {(r["g"], r["s"]): (r["tp"], r["fp"], r["n_pos"])
            for r in M.cumulative_counts(df, ["g"], "s", n_buckets=16).collect()}
    assert fast == slow


def test_exact_quantile_without_groups_bucketed(spark):
    df = spark.range(0, 1001).select(((F.col("id") * 7919) % 1009).cast("double").alias("v"))
    got = exact_quantile(df, [], "v", 0.5, n_buckets=16).collect()
    assert len(got) == 1 and got[0]["quantile"] == pytest.approx(float(np.quantile(df.toPandas()["v"], 0.5)))
    assert "_g" not in exact_quantile(df, [], "v", 0.25, n_buckets=16).columns


def test_poisson_bootstrap_is_reproducible(spark):
    pred = spark.createDataFrame([(i % 50, float(i), float(i) + (i % 3)) for i in range(200)],
                                 "patient_id long, y_true double, y_pred double").withColumn("configuration_id", F.lit("c"))
    a = B.bootstrap_regression(pred, n_resamples=40, seed=5, method="poisson").orderBy("metric").collect()
    b = B.bootstrap_regression(pred, n_resamples=40, seed=5, method="poisson").orderBy("metric").collect()
    assert a == b
    stats = pred.groupBy("configuration_id", "patient_id").count()
    w = B.resample_weights(stats, ["configuration_id"], "patient_id", 40, 5, method="poisson")
    sizes = [r["s"] for r in w.filter("b > 0").groupBy("b").agg(F.sum("w").alias("s")).collect()]
    assert 40 <= np.mean(sizes) <= 60


def test_bootstrap_refuses_rows_without_subject(spark):
    rows = [("c", 1, 1.0, 0.5), ("c", None, 2.0, 1.0), ("c", 2, 3.0, 2.5)]
    df = spark.createDataFrame(rows, "configuration_id string, patient_id long, y_true double, y_pred double")
    from horizonkit.operators.bootstrap import bootstrap_regression

    with pytest.raises(Exception, match="need a subject id"):
        bootstrap_regression(df, n_resamples=5).collect()


def test_strip_takes_all_white_space(spark):
    from horizonkit.functions.expressions import label_norm

    df = spark.createDataFrame([("\tbl\n",), (" V1 \r",)], "e string")
    assert [r[0] for r in df.select(label_norm("e")).collect()] == ["BL", "V1"]


def test_null_depth_is_unlimited(spark):
    from horizonkit.operators.models import build_model
    from horizonkit.plans.nested import UNLIMITED_DEPTH, _param_maps

    model = build_model("random_forest", True, seed=1)
    maps = _param_maps(model, {"max_depth": [3, None]})
    assert sorted(v for m in maps for v in m.values()) == [3, UNLIMITED_DEPTH]


def test_unshuffled_folds_rank_by_id_whatever_the_outlier(spark):
    from horizonkit.operators.quantiles import with_buckets

    ids = spark.range(2000).select(F.col("id").alias("patient_id")).union(
        spark.createDataFrame([(10**15,)], "patient_id long"))
    folds = FO.patient_folds(ids, 5, 1, shuffle=False).orderBy("patient_id").collect()
    assert [r["fold"] for r in folds] == [i % 5 + 1 for i in range(2001)]
    sizes = with_buckets(ids.withColumn("g", F.lit(0)), ["g"], "patient_id").groupBy("_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50


def test_training_medians_equal_plain_medians(spark):
    import random
    import statistics

    rng = random.Random(7)
    rows = [(1, f, x, rng.randrange(1, 5), float(rng.choice([0, 1, 2, rng.random() * 50])))
            for x in ("a", "b") for f in range(1, 6) for _ in range(60)]
    df = spark.createDataFrame(rows, "repeat int, fold int, feature string, c long, value double")
    from horizonkit.operators.quantiles import training_medians

    got = {(r.feature, r.outer_fold): r.median
           for r in training_medians(df, ["repeat", "feature"], 5, n_buckets=16).collect()}
    assert len(got) == 10
    for x in ("a", "b"):
        for k in range(1, 6):
            part = [v for _, f, y, c, v in rows if y == x and f != k for _ in range(c)]
            assert abs(got[x, k] - statistics.median(part)) < 1e-12


def test_calibration_of_small_and_large_groups_agrees_without_chained_joins(spark):
    from horizonkit.operators.metrics import calibration_from_counts

    rows = [(g, k / 40, float((7 * k * (g + 1)) % 5), float((3 * k + g) % 4 + 1)) for g in range(30) for k in range(1, 40)]
    rows += [(30, k / 40, 1.0, 0.0) for k in range(1, 40)] + [(None, 0.5, 1.0, 1.0)]
    counts = spark.createDataFrame(rows, "g int, s double, pos double, neg double")
    whole = {r["g"]: tuple(r)[1:] for r in calibration_from_counts(counts, ["g"], "s").collect()}
    spread = {r["g"]: tuple(r)[1:] for r in calibration_from_counts(counts, ["g"], "s", small=10).collect()}
    assert set(whole) == set(spread) == set(range(31)) and whole[30] == spread[30] == (None, None)
    for g in range(30):
        assert whole[g] == pytest.approx(spread[g], abs=1e-9)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # joins that share one partitioning all run in one task, each with memory of its own
        plan = calibration_from_counts(counts, ["g"], "s")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("SortMergeJoin") <= 1


def test_poisson_sums_equal_row_by_row_draws(spark):
    from pyspark.sql import functions as F

    from horizonkit.operators import bootstrap as B

    rows = [(("a", "b", None)[k % 3], k if k % 5 else 10**14 + k, float(k), None if k % 3 == 1 else k / 7) for k in range(200)]
    stats = spark.createDataFrame(rows, "g string, patient_id long, n double, v double")
    slow = B.expand_resamples(stats, None, None, ["g"], "patient_id", 12, 42, "poisson").groupBy("g", "b").agg(
        F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("v")).alias("v"))
    want = {(r["g"], r["b"]): (r["n"], r["v"]) for r in slow.collect()}
    got = {(r["g"], r["b"]): (r["n"], r["v"]) for r in
           B.poisson_sums(stats, ["g"], "patient_id", ["n", "v"], 12, 42).collect()}
    assert got.keys() == want.keys() and len(got) == 39
    for key, (n, v) in want.items():
        assert got[key][0] == n and (got[key][1] is None if v is None else got[key][1] == pytest.approx(v))


def test_md5_draws_match_hashlib():
    import hashlib

    from horizonkit.functions.digests import md5_draws

    texts = [b"", b"7", b"-12", b"123456789", "é".encode(), b"x" * 49, b"y" * 50, b"z" * 90]
    prefixes = [f"42:{b}:".encode() for b in (1, 20, 300, 1000)]
    for prefix, draws in zip(prefixes, md5_draws(prefixes, texts), strict=True):
        assert draws.tolist() == [int(hashlib.md5(prefix + t).hexdigest()[:8], 16) for t in texts]


def test_md5_draws_of_many_texts_and_many_prefixes_match_hashlib(monkeypatch):
    import hashlib

    from horizonkit.functions import digests

    monkeypatch.setattr(digests, "LANES", 64)
    prefixes = [f"42:{b}:".encode() for b in range(1, 130)]
    for texts in ([], [b"5"], [b"5", b"5"], [b"1234567", b"1234568"], [str(k * 7919).encode() for k in range(500)],
                  [b"a" * k for k in range(64)], [b"z" * 60] * 3, [b"x\0", b"x", b"\0"]):
        drawn = list(digests.md5_draws(prefixes, texts))
        assert len(drawn) == len(prefixes)
        for prefix, draws in zip(prefixes, drawn):
            assert draws.tolist() == [int(hashlib.md5(prefix + t).hexdigest()[:8], 16) for t in texts]


def test_poisson_weights_are_those_of_the_bounds(monkeypatch):
    bounds = [int(x, 16) for x in B._poisson_bounds()]
    draws = np.array([0, 2**32 - 1, *[b + k for b in bounds for k in (-1, 0, 1) if b + k < 2**32]], np.uint32)
    monkeypatch.setattr(B, "md5_draws", lambda prefixes, texts: [draws for _ in prefixes])
    got = B._poisson_weights([b""], [b""] * len(draws), np.array(bounds, np.uint32))
    assert got.tolist() == [[sum(int(d) > b for b in bounds) for d in draws]]


def test_poisson_draws_are_shared_by_a_subjects_groups(spark, monkeypatch):
    import pyarrow as pa

    # subjects in two large groups, every ninth in a small one and some rows twice
    rows = [(g, k, float(k), None if k % 4 == 1 or g == "c" else k / 7)
            for k in range(300) for g in "abc" for _ in range(1 + (k % 50 == 0)) if g != "c" or k % 9 == 0]
    stats = spark.createDataFrame(rows, "g string, patient_id long, n double, v double")
    slow = B.expand_resamples(stats, None, None, ["g"], "patient_id", 40, 42, "poisson").groupBy("g", "b").agg(
        F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("v")).alias("v"))
    want = {(r["g"], r["b"]): (r["n"], r["v"]) for r in slow.collect()}
    tasks, frame, map_in_arrow = [], type(stats), type(stats).mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: tasks.append(f) or map_in_arrow(self, f, schema))
    sums = B.poisson_sums(stats, ["g"], "patient_id", ["n", "v"], 40, 42)
    got = {(r["g"], r["b"]): (r["n"], r["v"]) for r in sums.collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 41
    for key, (n, v) in want.items():
        assert got[key][0] == n and (got[key][1] is None if v is None else got[key][1] == pytest.approx(v))

    drawn, draws = [], B.md5_draws  # a subject is drawn once for all its groups
    monkeypatch.setattr(B, "md5_draws", lambda prefixes, texts: drawn.extend(texts) or draws(prefixes, texts))
    table = pa.table({"g": [r[0] for r in rows], "_id": [str(r[1]) for r in rows], "n": [r[2] for r in rows],
                      "v": pa.array([r[3] for r in rows], pa.float64())})
    out = pa.Table.from_batches(tasks[0](iter(table.to_batches(max_chunksize=100)))).to_pylist()
    assert sorted(drawn) == sorted(str(k).encode() for k in range(300))
    for r in out:
        assert (r["n"], r["v"]) == pytest.approx(want[r["g"], r["b"]])
    # so that its rows meet, they are dealt by subject
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and plan.count("hashpartitioning(patient_id") >= 1


def test_bucket_of_a_value_keeps_the_plan_short(spark):
    from horizonkit.operators.quantiles import running_totals, with_buckets

    rows = [(g, None if k % 90 == 7 else float((k * 37) % 500), 1.0) for g in (1, 2) for k in range(450)] + [(3, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    for descending in (False, True):
        got = with_buckets(df, ["g"], "v", 16, descending).collect()
        assert len(got) == len(rows) and len({r["_bucket"] for r in got if r["g"] == 1 and r["v"] is not None}) > 8
        assert all(r["_bucket"] is None for r in got if r["g"] == 3)
        ordered = sorted((r for r in got if r["g"] == 1 and r["v"] is not None), key=lambda r: r["v"], reverse=descending)
        assert [r["_bucket"] for r in ordered] == sorted(r["_bucket"] for r in ordered)
        plan = running_totals(df, ["g"], "v", ["w"], descending)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 50_000  # a filter pushed below the steps named each of them three times
