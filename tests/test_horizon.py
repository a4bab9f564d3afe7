"""Pairing, ledgers and labels on tiny inline tables (same cases as the
reference's own unit tests), plus properties of the one-pass grid."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from horizonkit.errors import ConfigurationError
from horizonkit.functions.expressions import whole_days
from horizonkit.operators import horizon
from horizonkit.plans.grid import TaskSpec


def _visits(spark, rows, extra=""):
    cols = "PATNO long, EVENT_ID string, SCORE double, VISIT_DATE string, ROW_ID long" + extra
    return spark.createDataFrame(rows, cols)


def test_selects_closest_follow_up_and_tracks_missing_patients(spark):
    df = _visits(spark, [
        (1, "BL", 10.0, "2020-01-01", 0), (1, "V03", 14.0, "2020-12-20", 1), (1, "V04", 15.0, "2021-01-20", 2),
        (2, "BL", 20.0, "2020-01-01", 3), (2, "V03", 25.0, "2021-06-01", 4), (3, "BL", 30.0, "2020-01-01", 5),
    ])
    res = horizon.fixed_horizon_result(df, 365, 30)
    assert [tuple(r) for r in res.pairs.collect()] == [(1, 10.0, 14.0, 4.0)]
    s = res.summary().first()
    assert s["baseline_patients"] == 3
    assert s["retained_patients"] == 1
    assert s["excluded_missing_follow_up"] == 2
    assert s["excluded_invalid_baseline"] == 0


def test_ties_go_to_earlier_date_then_event_then_row(spark):
    # two candidates at the same distance (355 and 375 days): earlier date wins
    df = _visits(spark, [
        (1, "BL", 1.0, "2020-01-01", 0), (1, "V2", 2.0, "2020-12-21", 1), (1, "V1", 3.0, "2021-01-10", 2),
        (2, "BL", 1.0, "2020-01-01", 3), (2, "V2", 5.0, "2020-12-31", 4), (2, "V1", 6.0, "2020-12-31", 5),
    ])
    got = {r["PATNO"]: r["Target_Score"] for r in horizon.fixed_horizon_pairs(df, 365, 30).collect()}
    assert got == {1: 2.0, 2: 6.0}


def test_baseline_needs_date_and_score_and_earliest_wins(spark):
    df = _visits(spark, [
        (1, "BL", None, "2019-06-01", 0), (1, " bl ", 10.0, "2020-01-01", 1), (1, "V1", 20.0, "2021-01-01", 2),
        (2, "BL", 5.0, "not a date", 3),
    ])
    res = horizon.fixed_horizon_result(df, 365, 30)
    assert [tuple(r) for r in res.pairs.collect()] == [(1, 10.0, 20.0, 10.0)]
    s = res.summary().first()
    assert (s["baseline_patients"], s["usable_baseline_patients"]) == (2, 1)


def test_whole_days_floor_the_duration(spark):
    df = spark.createDataFrame(
        [("2024-01-01 23:00:00", "2024-01-02 01:00:00"), ("2024-01-02 01:00:00", "2024-01-01 23:00:00"),
         ("2024-01-01 00:00:00", "2024-01-03 00:00:00")],
        "a string, b string",
    ).select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = [r[0] for r in df.select(whole_days("b", "a")).collect()]
    assert got == [0, -1, 2]
    # calendar difference would say 1 for the first row
    assert df.select(F.datediff(F.col("b").cast("date"), F.col("a").cast("date"))).first()[0] == 1


def test_follow_up_covariates_cannot_enter_predictor_matrix(spark):
    df = spark.createDataFrame(
        [(1, "BL", "2020-01-01", 20.0, 60.0, 27.0, 0), (1, "V01", "2020-12-31", 28.0, 99.0, 5.0, 1),
         (2, "BL", "2020-01-01", 30.0, 70.0, 24.0, 2), (2, "V01", "2020-12-31", 31.0, 101.0, 4.0, 3)],
        "PATNO long, EVENT_ID string, VISIT_DATE string, SCORE double, age double, moca double, ROW_ID long",
    )
    task = TaskSpec("test_12m_binary", "mds_updrs_iii", "binary", 12, 5, progression_threshold=5,
                    medication_state="OFF")
    out = horizon.fixed_horizon_features(df, task, ["age", "moca"]).orderBy("PATNO").collect()
    assert [r["age"] for r in out] == [60.0, 70.0]
    assert [r["moca"] for r in out] == [27.0, 24.0]
    assert [r["progression_label"] for r in out] == [1, 0]
    assert {r["task_id"] for r in out} == {task.task_id}


def test_progression_label_threshold_and_single_class_error(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 8.0)], "PATNO long, Delta_Score double")
    labels = [r["progression_label"] for r in
              horizon.create_progression_label(df, 5.0).orderBy("PATNO").collect()]
    assert labels == [0, 1, 1]
    one = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "PATNO long, Delta_Score double")
    with pytest.raises(ValueError):
        horizon.create_progression_label(one, 10.0)


def test_one_pass_grid_equals_single_task_runs(spark):
    rows = []
    rid = 0
    for p in range(1, 9):
        for k, day in enumerate([0, 340, 365 + p, 700 + 3 * p, 760, 1090]):
            rows.append((p, "BL" if k == 0 else f"V{k}", float(p * 10 + k), f"2020-01-01", rid, day))
            rid += 1
    df = spark.createDataFrame(rows, "PATNO long, EVENT_ID string, SCORE double, d string, ROW_ID long, day int") \
        .select("PATNO", "EVENT_ID", "SCORE", F.date_add(F.col("d").cast("date"), F.col("day"))
                .cast("timestamp_ntz").alias("VISIT_DATE"), "ROW_ID")
    tasks = [TaskSpec("t", "e", "continuous", m, tol) for m in (12, 24, 36) for tol in (10, 60)]
    pairs, ledger = horizon.multi_task_result(df, tasks)
    for t in tasks:
        one = {tuple(r) for r in horizon.fixed_horizon_pairs(df, t.horizon_days, t.tolerance_days).collect()}
        many = {tuple(r) for r in pairs.filter(F.col("task_id") == t.task_id)
                .select("PATNO", "Baseline_Score", "Target_Score", "Delta_Score").collect()}
        assert one == many
    # ledger arithmetic: retained + excluded = previous stage
    for r in ledger.collect():
        if r["stage"] == "fixed_horizon_follow_up":
            assert r["patients_retained"] + r["patients_excluded_at_stage"] == 8


def test_task_contract_guards():
    with pytest.raises(ConfigurationError):
        TaskSpec("x", "e", "continuous", 18, 30)
    with pytest.raises(ConfigurationError):
        TaskSpec("x", "e", "binary", 12, 30)
    with pytest.raises(ConfigurationError):
        TaskSpec("x", "e", "continuous", 12, 30, progression_threshold=1.0)
    t = TaskSpec("x", "e", "binary", 24, 30, progression_threshold=5)
    assert t.horizon_days == 730 and len(t.task_id) == 16


def test_legacy_endpoint_delta(spark):
    df = spark.createDataFrame(
        [(101, "BL", "2020-01-01", 28.0, 0), (101, "V01", "2020-07-01", 26.0, 1),
         (202, "BL", "2020-01-01", 27.0, 2), (202, "V01", "2020-07-01", 28.0, 3)],
        "PATNO long, EVENT_ID string, VISIT_DATE string, moca double, ROW_ID long",
    ).withColumn("VISIT_DATE", F.col("VISIT_DATE").cast("timestamp_ntz"))
    out = horizon.endpoint_delta_dataset(df, "moca", (), ("BL", "V01"))
    assert {r["PATNO"]: r["moca_delta"] for r in out.collect()} == {101: -2.0, 202: 1.0}


def test_column_and_parameter_guards(spark):
    from horizonkit.errors import MissingColumnError

    df = spark.createDataFrame([(1, "BL", 1.0)], "PATNO long, EVENT_ID string, SCORE double")
    with pytest.raises(MissingColumnError, match="ROW_ID, VISIT_DATE"):
        horizon.fixed_horizon_result(df, 365, 30)
    with pytest.raises(MissingColumnError):
        horizon.endpoint_delta_dataset(df, "moca")
    full = df.withColumns({"VISIT_DATE": F.lit("2020-01-01"), "ROW_ID": F.lit(0)})
    with pytest.raises(ValueError):
        horizon.fixed_horizon_result(full, 0, 30)
    with pytest.raises(ValueError):
        horizon.fixed_horizon_result(full, 365, -1)


def test_staged_and_direct_pairings_agree_and_staged_ones_read_no_source(spark):
    df = _visits(spark, [
        # two baseline rows on one date: the lower ROW_ID gives score and feature
        (1, "BL", 9.0, "2020-01-01", 4, 90.0), (1, "BL", 8.0, "2020-01-01", 2, 80.0),
        (1, "BL", 7.0, "2020-06-01", 1, 70.0), (1, "V1", 3.0, "2020-12-31", 5, None),
        (2, "BL", None, "2020-01-01", 6, 1.0), (2, "V1", 5.0, "2020-12-31", 7, 2.0),
        (None, "BL", 1.0, "2020-01-01", 8, 3.0), (3, "BL", 1.0, "2020-01-01", 9, 4.0),
    ], ", F double")
    runs = [horizon.fixed_horizon_result(df, 365, 30, feature_columns=["F"], read_once=r) for r in (True, False)]
    for res in runs:
        rows = [r.asDict() for r in res.feature_pairs.collect()]
        assert [(r["PATNO"], r["Baseline_Score"], r["F"], r["Target_Score"]) for r in rows] == [(1, 8.0, 80.0, 3.0)]
        s = res.summary().first()
        assert (s["baseline_patients"], s["usable_baseline_patients"], s["retained_patients"]) == (3, 2, 1)
    files = runs[0].feature_pairs.inputFiles()
    assert files and all("/staged-visits-" in f for f in files)
