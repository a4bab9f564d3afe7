"""A hot subject (a third of all visits) with AQE skew splitting forced:
pairing and ledgers must equal a brute-force evaluation."""

from __future__ import annotations

import datetime as dt

import pandas as pd

from horizonkit.operators import horizon

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


def _rows():
    rows, rid = [], 0
    base = dt.datetime(2020, 1, 1)
    for i in range(3000):  # hot subject 1
        rows.append((1, "BL" if i % 500 == 0 else f"V{i % 7}", float(i % 97), base + dt.timedelta(days=i // 3), rid))
        rid += 1
    for p in range(2, 602):
        for k in range(10):
            ev = "BL" if k == 0 else f"V{k}"
            rows.append((p, ev, float(p + k), base + dt.timedelta(days=p % 30 + 40 * k), rid))
            rid += 1
    return rows


def _brute(df: pd.DataFrame, h: int, t: int) -> dict[int, tuple]:
    out = {}
    for pat, g in df.groupby("PATNO"):
        bl = g[g.EVENT_ID == "BL"].sort_values(["VISIT_DATE", "ROW_ID"])
        if bl.empty:
            continue
        b = bl.iloc[0]
        c = g.assign(days=(g.VISIT_DATE - b.VISIT_DATE).dt.days)
        c = c[(c.days > 0) & (c.days >= h - t) & (c.days <= h + t)]
        if c.empty:
            continue
        c = c.assign(dist=(c.days - h).abs()).sort_values(["dist", "VISIT_DATE", "EVENT_ID", "ROW_ID"])
        out[pat] = (b.SCORE, c.iloc[0].SCORE)
    return out


def test_pairing_with_hot_subject_matches_brute_force(spark):
    from horizonkit.operators import skew

    hot = skew.hot_from_counts(spark.createDataFrame([(1, 3000), (2, 10)], "PATNO long, n long"), "PATNO", "n",
                               partitions=8)
    assert list(hot) == [1] and hot[1] >= 2
    rows = _rows()
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "PATNO long, EVENT_ID string, SCORE double, VISIT_DATE timestamp_ntz, "
                                         "ROW_ID long").repartition(8)
        res = horizon.fixed_horizon_result(df, 365, 90)
        got = {r["PATNO"]: (r["Baseline_Score"], r["Target_Score"]) for r in res.pairs.collect()}
        summary = res.summary().first()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    pdf = pd.DataFrame(rows, columns=["PATNO", "EVENT_ID", "SCORE", "VISIT_DATE", "ROW_ID"])
    exp = _brute(pdf, 365, 90)
    assert got == exp
    assert summary["retained_patients"] == len(exp)
    assert summary["baseline_patients"] == 601


def test_cohort_semi_join_with_hot_subject(spark):
    from horizonkit.operators import cohort, skew

    rows = [(1, "PD", "BL" if i == 0 else "V1") for i in range(3000)] + \
           [(p, "PD" if p % 2 else "HC", "BL") for p in range(2, 400)]
    df = spark.createDataFrame(rows, "PATNO long, DIAGNOSTIC_GROUP string, EVENT_ID string")
    res = cohort.select_cohort(df)
    assert res.data.count() == 3000 + len([p for p in range(2, 400) if p % 2])


def test_endpoint_delta_with_hot_subject(spark):
    from pyspark.sql import functions as F

    from horizonkit.operators import skew

    base = dt.datetime(2020, 1, 1)
    rows = [(1, "BL" if i == 0 else "V1", base + dt.timedelta(days=i), float(i), i) for i in range(2000)]
    rows += [(p, "BL" if k == 0 else "V1", base + dt.timedelta(days=k * 30), float(p + k), 10_000 + p * 10 + k)
             for p in range(2, 200) for k in range(3)]
    df = spark.createDataFrame(rows, "PATNO long, EVENT_ID string, VISIT_DATE timestamp_ntz, moca double, ROW_ID long")
    out = horizon.endpoint_delta_dataset(df, "moca", (), ("BL",))
    assert out.count() == 1999 + 198 * 2
    assert out.filter(F.col("PATNO") == 1).agg(F.sum("moca_delta")).first()[0] == sum(range(1, 2000))


def test_rows_without_a_subject_are_never_hot(spark):
    from horizonkit.operators import cohort as C
    from horizonkit.operators import skew

    # most rows have no subject, and one subject is hot among the rest
    rows = [(None, "PD", "BL", i) for i in range(900)] + [(1, "PD", "BL", i) for i in range(300)]
    rows += [(p, "PD", "BL" if p % 2 else "V01", p) for p in range(2, 60)]
    df = spark.createDataFrame(rows, "PATNO long, DIAGNOSTIC_GROUP string, EVENT_ID string, SCORE long")
    counts = df.groupBy("PATNO").count()
    assert list(skew.hot_from_counts(counts, "PATNO", "count", partitions=8)) == [1]
    res = C.select_cohort(df)
    kept = res.data.collect()
    assert len(kept) == 300 + 29 and {r["PATNO"] for r in kept} == {1, *range(3, 60, 2)}
    assert {r["stage"]: r["records_retained"] for r in res.flow.collect()} == {
        "input": 1258, "valid_patient_identifier": 358, "eligible_diagnostic_group": 358, "baseline_eligible": 329}
