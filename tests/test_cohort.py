"""Cohort / endpoint ledgers, harmonisation and sources."""

from __future__ import annotations

import pytest

from horizonkit.errors import ConfigurationError, MissingColumnError
from horizonkit.operators import cohort as C
from horizonkit.operators import harmonize as H
from horizonkit.plans.grid import FEATURE_BLOCKS
from horizonkit.sources import files as SRC


def test_cohort_keeps_pd_with_baseline_and_ledger_adds_up(spark):
    df = spark.createDataFrame(
        [(1, "PD", "BL"), (1, "PD", "V01"), (2, "HC", "BL"), (3, "PD", "V01"), (None, "PD", "BL")],
        "PATNO long, DIAGNOSTIC_GROUP string, EVENT_ID string",
    )
    res = C.select_cohort(df)
    assert {r["PATNO"] for r in res.data.collect()} == {1}
    flow = {r["stage"]: r for r in res.flow.collect()}
    assert flow["input"]["records_retained"] == 5 and flow["input"]["patients_retained"] == 3
    assert flow["valid_patient_identifier"]["records_excluded_at_stage"] == 1
    assert flow["eligible_diagnostic_group"]["patients_excluded_at_stage"] == 1
    assert flow["baseline_eligible"]["patients_excluded_at_stage"] == 1
    rows = sorted(res.flow.collect(), key=lambda r: r["stage_order"])
    for prev, cur in zip(rows, rows[1:]):
        assert cur["records_retained"] + cur["records_excluded_at_stage"] == prev["records_retained"]


def test_endpoint_requires_state_and_normalises_aliases(spark):
    df = spark.createDataFrame(
        [(1, 10.0, "OFF"), (1, 12.0, "ON"), (2, 11.0, " off medication ")],
        "PATNO long, SCORE double, MEDICATION_STATE string",
    )
    res = C.apply_endpoint(df, "mds_updrs_iii", "SCORE", "OFF")
    rows = res.data.collect()
    assert len(rows) == 2 and {r["MEDICATION_STATE"] for r in rows} == {"OFF"}
    stages = [r["stage"] for r in res.flow.orderBy("stage_order").collect()]
    assert stages == ["endpoint_input", "valid_endpoint_score", "medication_state_off"]


def test_unknown_medication_label_raises_only_for_valid_scores(spark):
    bad = spark.createDataFrame([(1, 10.0, "sometimes"), (2, 1.0, "never"), (3, 1.0, "ON"), (4, 1.0, None)],
                                "PATNO long, SCORE double, MEDICATION_STATE string")
    for table in ("data", "flow"):  # the whole list, sorted
        with pytest.raises(Exception, match="Unrecognized medication-state labels: missing values, never, sometimes"):
            getattr(C.apply_endpoint(bad, "x", "SCORE", "OFF"), table).collect()
    skipped = spark.createDataFrame([(1, None, "sometimes"), (2, 3.0, "0")],
                                    "PATNO long, SCORE double, MEDICATION_STATE string")
    assert C.apply_endpoint(skipped, "x", "SCORE", "OFF").data.count() == 1


def test_not_applicable_state_and_updrs_guard(spark):
    df = spark.createDataFrame([(1, 10.0)], "PATNO long, SCORE double")
    out = C.apply_endpoint(df, "moca", "SCORE", "NOT_APPLICABLE").data.first()
    assert out["MEDICATION_STATE"] == "NOT_APPLICABLE"
    with pytest.raises(Exception):
        C.apply_endpoint(df, "updrs_part3", "SCORE", "NOT_APPLICABLE")


def _blocks(**over):
    blocks = {b: [] for b in FEATURE_BLOCKS}
    blocks.update(over)
    return blocks


def test_harmonise_drops_undeclared_and_constant_wins(spark):
    df = spark.createDataFrame(
        [(1, "BL", "2020-01-01", "PD", 20.0, 65.0, 1.0, "ON")],
        "pid long, ev string, dt string, dx string, s double, age double, secret double, med string",
    )
    out = H.harmonize_canonical(
        df, {"PATNO": "pid", "EVENT_ID": "ev", "VISIT_DATE": "dt", "DIAGNOSTIC_GROUP": "dx", "SCORE": "s",
             "MEDICATION_STATE": "med"},
        _blocks(demographics_disease_history=["age"]), {"MEDICATION_STATE": "OFF"},
    )
    assert "secret" not in out.columns and out.first()["MEDICATION_STATE"] == "OFF"
    with pytest.raises(ConfigurationError):
        H.harmonize_canonical(df, {"PATNO": "pid"}, _blocks())
    with pytest.raises(MissingColumnError):
        H.harmonize_canonical(
            df, {"PATNO": "pid", "EVENT_ID": "ev", "VISIT_DATE": "dt", "DIAGNOSTIC_GROUP": "dx", "SCORE": "s"},
            _blocks(genetic_variables=["missing_col"]))


def test_patient_id_alias_guard_is_lazy(spark):
    df = spark.createDataFrame([(1, 1), (2, 3)], "PATNO long, patient_id long")
    checked = H.with_patient_id(df)
    with pytest.raises(Exception, match="must match"):
        checked.collect()


def test_normalise_text_export(spark):
    df = spark.createDataFrame(
        [("12", " BL ", "2020-01-09", "3.5"), ("12.0", "V01", "01/09/2021", "n/a"),
         ("x", "V02", "2021-01-01", "1"), ("13", None, "2021-01-01", "1"), ("14", "BL", "Jan 9, 2020", "2")],
        "PATNO string, EVENT_ID string, visit_date string, moca string",
    )
    out = SRC.normalise_visits(df).orderBy("PATNO", "visit_date").collect()
    assert [(r["PATNO"], r["EVENT_ID"], r["moca"]) for r in out] == [(12, "BL", 3.5), (12, "V01", None), (14, "BL", 2.0)]
    assert str(out[1]["visit_date"]).startswith("2021-01-09")
    assert str(out[2]["visit_date"]).startswith("2020-01-09")


def test_schema_gate_lists_missing_sorted(spark):
    df = spark.createDataFrame([(1,)], "PATNO long")
    with pytest.raises(MissingColumnError, match="EVENT_ID, moca, updrs3_score, visit_date"):
        SRC.validate_schema(df)


def test_read_source_by_suffix(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text("PATNO,MOCA,moca\n1,99,27\n")
    swapped = SRC.read_source(spark, str(p), case_sensitive=True)
    assert [r.asDict() for r in swapped.collect()] == [{"PATNO": "1", "MOCA_1": "99", "moca": "27"}]
    p = tmp_path / "w.csv"
    p.write_text("PATNO,moca,MOCA\n1,27,99\n")
    df = SRC.read_source(spark, str(p), case_sensitive=True)
    assert df.columns == ["PATNO", "moca", "MOCA_2"] and dict(df.dtypes)["moca"] == "string"
    assert spark.conf.get("spark.sql.caseSensitive") == "false"  # the session's own setting is back
    assert [tuple(r) for r in df.collect()] == [("1", "27", "99")]
    with pytest.raises(ValueError):
        SRC.read_source(spark, str(tmp_path / "v.xlsx"))
    with pytest.raises(FileNotFoundError):
        SRC.read_source(spark, str(tmp_path / "none.parquet"))


def test_split_keeps_first_row_per_subject(spark):
    df = spark.createDataFrame(
        [(1, "BL", "d1", 5.0, "A", 2), (1, "V1", "d2", 6.0, "B", 1), (2, "BL", "d1", 7.0, "C", 3)],
        "PATNO long, EVENT_ID string, VISIT_DATE string, SCORE double, gene string, ROW_ID long",
    )
    parts = SRC.split_wide_table(df, {"clinical": ["SCORE"], "genetics": ["gene"]})
    assert {r["PATNO"]: r["gene"] for r in parts["genetics"].collect()} == {1: "B", 2: "C"}
    assert parts["clinical"].count() == 3


def test_fingerprint_is_order_free(spark):
    from horizonkit.sources.sinks import table_fingerprint

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "k long, v string").repartition(3)
    assert table_fingerprint(a).first() == table_fingerprint(b).first()
    c = spark.createDataFrame([(1, "x"), (2, "z")], "k long, v string")
    assert table_fingerprint(a).first() != table_fingerprint(c).first()


def test_contract_report_counts_nulls_and_failed_casts(spark):
    df = spark.createDataFrame([("1", "2020-01-01"), ("x", None), (None, "01/02/2020"), ("2", "soon")], "PATNO string, visit_date string")
    rep = {r["column_name"]: r for r in SRC.contract_report(df, {"PATNO": "double", "visit_date": "date"}).collect()}
    assert (rep["PATNO"]["rows"], rep["PATNO"]["nulls"], rep["PATNO"]["failed_casts"]) == (4, 1, 1)
    assert (rep["visit_date"]["nulls"], rep["visit_date"]["failed_casts"]) == (1, 1)


def test_fingerprint_keeps_nulls_and_metric_direction(spark):
    from pyspark.sql import functions as F

    from horizonkit.functions.expressions import metric_direction, row_fingerprint

    df = spark.createDataFrame([(1, None), (1, "x")], "a long, b string")
    fp = [r[0] for r in df.select(row_fingerprint(["b", "a"], 16)).collect()]
    assert len(set(fp)) == 2 and all(len(x) == 16 for x in fp)
    m = spark.createDataFrame([("mae",), ("auroc",)], "metric string").select(metric_direction(F.col("metric")))
    assert [r[0] for r in m.collect()] == ["lower_is_better", "higher_is_better"]


def test_lenient_timestamp_layouts(spark):
    from horizonkit.functions.expressions import lenient_double, lenient_timestamp

    df = spark.createDataFrame([("2020-01-09",), ("2020/01/09",), ("9 Jan 2020",), ("Jan 9, 2020",), ("01/09/2020",),
                                ("2020-01-09 10:30:00",), ("junk",)], "t string")
    got = [r[0] for r in df.select(lenient_timestamp("t").cast("string")).collect()]
    assert got[:5] == ["2020-01-09 00:00:00"] * 5 and got[5] == "2020-01-09 10:30:00" and got[6] is None
    nums = spark.createDataFrame([("1.5",), ("NaN",), ("x",)], "s string").select(lenient_double("s"))
    assert [r[0] for r in nums.collect()] == [1.5, None, None]
