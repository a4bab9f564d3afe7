"""Baseline-to-fixed-horizon pairing (WIN1, WIN2, JN1-JN5, AGG4, PRJ12, PRJ15).

Plan shape (single task):

    visits --hash aggregate per PATNO--> earliest usable baseline date, visit count
    visits --filter(id,date,score), 5 cols + baseline payload--> join dates ON PATNO
           --> Follow_Up_Days = floor(duration / 1 day), baseline rows and rows in range
           --> partial min_by of baseline (ROW_ID) and of target
               (distance, date, event nulls last, ROW_ID)
           --> final min_by per PATNO

* Top-1 per subject is ``min_by`` over a struct key, which aggregates
  partially before the exchange: the shuffle carries at most one row per
  subject per map task, whatever the number of visits of a hot subject.
* The features move on baseline rows only; predictors can only come from the
  baseline row.
* The range condition is a residual predicate of the equi-join on PATNO.
* The multi-task variant matches the candidates once with the distinct
  windows of the task list (a literal array) and groups by (window, PATNO);
  the chosen rows then join the task list on its window.
* Hot subjects (more visits than an average partition) are split over salts
  in the visits x baseline join (``operators.skew``); the per-subject table
  that counts visits is materialised once and reused.
* Visits that come from joins are staged as Parquet (``read_once``), so that
  both passes read the columns they need and the sources are read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonkit.errors import ConfigurationError, MissingColumnError, require_columns
from horizonkit.functions.expressions import (
    label_norm,
    lenient_double,
    lenient_timestamp,
    whole_days,
)
from horizonkit.operators.skew import hot_from_counts, salt_big_side, salt_small_side, split_hot_keys
from horizonkit.plans.grid import TaskSpec, task_grid_frame
from horizonkit.session import checkpoint_dir, staged_rows

CORE = ("PATNO", "EVENT_ID", "VISIT_DATE", "SCORE")


def prepare_visits(visits: DataFrame, feature_columns: Sequence[str] = ()) -> DataFrame:
    """Coerce the core columns leniently (schema-driven; no-op when typed).

    EVENT_ID -> trimmed upper text, VISIT_DATE -> TIMESTAMP_NTZ (mixed
    formats), SCORE -> double (bad text -> null). ``ROW_ID`` must exist: it
    is the explicit tie-break that replaces input row order.
    """
    require_columns(visits.columns, {*CORE, "ROW_ID", *feature_columns},
                    "Cannot construct fixed-horizon dataset")
    types = {f.name: f.dataType for f in visits.schema.fields}
    return visits.withColumns(
        {
            "EVENT_ID": label_norm("EVENT_ID"),
            "VISIT_DATE": lenient_timestamp("VISIT_DATE", types["VISIT_DATE"]),
            "SCORE": lenient_double("SCORE", types["SCORE"]),
        }
    )


def _pairing_rows(visits: DataFrame, feature_columns: Sequence[str], read_once: bool) -> DataFrame:
    """The coerced rows with a subject id; staged, so that the pairing reads their source once."""
    columns = dict.fromkeys([*CORE, "ROW_ID", *feature_columns])
    rows = prepare_visits(visits, feature_columns).select(*columns).filter(F.col("PATNO").isNotNull())
    return staged_rows(rows, "visits") if read_once else rows


def baseline_table(
    visits: DataFrame,
    baseline_event_ids: Sequence[str] = ("BL",),
    feature_columns: Sequence[str] = (),
) -> DataFrame:
    """One row per subject that has a baseline-labelled visit (WIN1).

    ``usable`` is true when the earliest baseline with date and score exists;
    then ``Baseline_Date`` / ``Baseline_Score`` / features come from it.
    Ties on date are broken by ``ROW_ID`` (input order).
    """
    events = [str(e).strip().upper() for e in baseline_event_ids]
    is_bl = F.coalesce(F.col("EVENT_ID").isin(events), F.lit(False))
    usable = F.col("VISIT_DATE").isNotNull() & F.col("SCORE").isNotNull()
    payload = F.struct(
        F.col("VISIT_DATE").alias("Baseline_Date"),
        F.col("SCORE").alias("Baseline_Score"),
        *[F.col(c) for c in feature_columns],
    )
    order_key = F.when(is_bl & usable, F.struct("VISIT_DATE", "ROW_ID"))
    best = visits.filter(F.col("PATNO").isNotNull() & is_bl).groupBy("PATNO").agg(
        F.min_by(payload, order_key).alias("b"),
        F.count(order_key).alias("n_usable"),
    )
    return best.select("PATNO", (F.col("n_usable") > 0).alias("usable"), "b.*")


def _is_baseline(events: Sequence[str]) -> Column:
    return F.coalesce(F.col("EVENT_ID").isin([str(e).strip().upper() for e in events]), F.lit(False))


def _baselines_and_hot(rows: DataFrame, events: Sequence[str]):
    """Baseline dates materialised once (reliable checkpoint) + hot subjects.

    One hash aggregate over fixed-width columns: per subject with a baseline
    event, whether a usable one exists, its earliest date and the number of
    visits. The table is reused by the pairing join, the ledger and the hot-key
    check; the hot list is bounded by the number of shuffle partitions.
    """
    checkpoint_dir(rows.sparkSession)
    is_bl = _is_baseline(events)
    usable = is_bl & F.col("VISIT_DATE").isNotNull() & F.col("SCORE").isNotNull()
    per_subject = rows.groupBy("PATNO").agg(
        F.count_if(is_bl).alias("_n_baseline"),
        F.count_if(usable).alias("_n_usable"),
        F.min(F.when(usable, F.col("VISIT_DATE"))).alias("Baseline_Date"),
        F.count(F.lit(1)).alias("_n_visits"),
    )
    baselines = per_subject.filter(F.col("_n_baseline") > 0).select(
        "PATNO", (F.col("_n_usable") > 0).alias("usable"), "Baseline_Date", "_n_visits"
    ).checkpoint()
    hot = hot_from_counts(baselines.filter("usable"), "PATNO", "_n_visits")
    return baselines.drop("_n_visits"), hot


def _candidates(
    rows: DataFrame,
    baselines: DataFrame,
    events: Sequence[str],
    feature_columns: Sequence[str],
    lower: int,
    upper: int,
    hot: dict | None = None,
) -> DataFrame:
    """Rows that can decide a pair: the subject's baseline rows and follow-ups in range.

    ``_b`` is the baseline payload on rows at the baseline date with a baseline
    event (null on follow-ups, so predictors move for baseline rows only).
    """
    payload = F.struct(F.col("SCORE").alias("Baseline_Score"), *[F.col(c) for c in feature_columns])
    points = rows.filter(F.col("VISIT_DATE").isNotNull() & F.col("SCORE").isNotNull()).select(
        "PATNO", "EVENT_ID", "VISIT_DATE", "SCORE", "ROW_ID",
        F.when(_is_baseline(events), payload).alias("_b"),
    )
    base = baselines.filter("usable").select("PATNO", "Baseline_Date")
    if hot:
        # hot subjects: visits spread over salts, their baseline row copied per salt
        joined = salt_big_side(points, "PATNO", hot, ["ROW_ID"]).join(
            salt_small_side(base, "PATNO", hot), ["PATNO", "_salt"], "inner"
        ).drop("_salt")
    else:
        joined = points.join(base, "PATNO", "inner")
    days = whole_days("VISIT_DATE", "Baseline_Date")
    at_baseline = F.col("VISIT_DATE") == F.col("Baseline_Date")
    return joined.withColumns(
        {"Follow_Up_Days": days, "_b": F.when(at_baseline, F.col("_b"))}
    ).filter(
        F.col("_b").isNotNull()
        | ((F.col("Follow_Up_Days") > 0) & F.col("Follow_Up_Days").between(lower, upper))
    )


def _select_nearest(
    candidates: DataFrame,
    horizon_days: int | Column,
    feature_columns: Sequence[str],
    group_keys: Sequence[str] = ("PATNO",),
) -> DataFrame:
    """One row per group that has a follow-up: first baseline row by ROW_ID, nearest follow-up."""
    follow = F.col("_b").isNull()
    order_key = F.struct(
        F.abs(F.col("Follow_Up_Days") - horizon_days).alias("d"),
        F.col("VISIT_DATE"),
        F.col("EVENT_ID").isNull().alias("event_missing"),
        F.col("EVENT_ID"),
        F.col("ROW_ID"),
    )
    target = F.struct(
        "Baseline_Date",
        F.col("VISIT_DATE").alias("Target_Date"),
        "Follow_Up_Days",
        F.col("SCORE").alias("Target_Score"),
    )
    best = candidates.groupBy(*group_keys).agg(
        F.min_by("_b", F.when(~follow, F.struct("ROW_ID"))).alias("b"),
        F.min_by(target, F.when(follow, order_key)).alias("t"),
    )
    return best.filter(F.col("t").isNotNull()).select(
        *group_keys, "t.Baseline_Date", "t.Target_Date", "t.Follow_Up_Days", "b.Baseline_Score",
        *[F.col("b").getField(c).alias(c) for c in feature_columns], "t.Target_Score",
    )


def fixed_horizon_pairs(
    visits: DataFrame,
    horizon_days: int = 730,
    tolerance_days: int = 90,
    baseline_event_ids: Sequence[str] = ("BL",),
    read_once: bool = True,
) -> DataFrame:
    """Short-form pairing: PATNO, Baseline_Score, Target_Score, Delta_Score."""
    return fixed_horizon_result(
        visits, horizon_days, tolerance_days, baseline_event_ids, read_once=read_once
    ).pairs


@dataclass
class HorizonResult:
    """Lazy outputs of one pairing: the patient table and its ledger parts."""

    pairs: DataFrame
    baselines: DataFrame
    feature_pairs: DataFrame

    def summary(self) -> DataFrame:
        """AGG4: five-number attrition summary as a one-row table."""
        return horizon_summary(self.baselines, self.pairs)


def _validate_horizon(horizon_days: int, tolerance_days: int) -> None:
    if isinstance(horizon_days, bool) or not isinstance(horizon_days, int) or horizon_days <= 0:
        raise ValueError("target_horizon_days must be a positive integer.")
    if isinstance(tolerance_days, bool) or not isinstance(tolerance_days, int) or tolerance_days < 0:
        raise ValueError("window_tolerance must be a non-negative integer.")


def fixed_horizon_result(
    visits: DataFrame,
    horizon_days: int = 730,
    tolerance_days: int = 90,
    baseline_event_ids: Sequence[str] = ("BL",),
    feature_columns: Sequence[str] = (),
    read_once: bool = True,
) -> HorizonResult:
    """JN3/JN4: nearest-in-window pairing with baseline-only covariates.

    Two passes over the visits (baseline dates, then pairs). ``read_once``
    stages them first, which pays where they come from joins or text; a plain
    scan of a few columns is better read twice.
    """
    _validate_horizon(horizon_days, tolerance_days)
    rows = _pairing_rows(visits, feature_columns, read_once)
    baselines, hot = _baselines_and_hot(rows, baseline_event_ids)
    cands = _candidates(
        rows, baselines, baseline_event_ids, feature_columns,
        horizon_days - tolerance_days, horizon_days + tolerance_days, hot,
    )
    chosen = _select_nearest(cands, horizon_days, feature_columns)
    chosen = chosen.withColumn("Delta_Score", F.col("Target_Score") - F.col("Baseline_Score"))
    pairs = chosen.select("PATNO", "Baseline_Score", "Target_Score", "Delta_Score")
    return HorizonResult(pairs=pairs, baselines=baselines, feature_pairs=chosen)


def fixed_horizon_features(
    visits: DataFrame,
    task: TaskSpec,
    feature_columns: Sequence[str],
) -> DataFrame:
    """JN4 output contract for one task (features from the baseline row only)."""
    res = fixed_horizon_result(
        visits, task.horizon_days, task.tolerance_days, task.baseline_event_ids,
        list(dict.fromkeys(feature_columns)),
    )
    out = res.feature_pairs.withColumns(
        {
            "task_id": F.lit(task.task_id),
            "horizon_months": F.lit(task.horizon_months).cast("int"),
            "tolerance_days": F.lit(task.tolerance_days).cast("int"),
        }
    )
    if task.outcome_type == "binary":
        out = out.withColumn("progression_label", progression_label("Delta_Score", task.progression_threshold))
    return out


def progression_label(delta: str | Column, threshold: float) -> Column:
    """PRJ12: 1 when the change reaches the threshold, else 0."""
    col = F.col(delta) if isinstance(delta, str) else delta
    return (col >= F.lit(float(threshold))).cast("int")


def create_progression_label(
    dataset: DataFrame, threshold: float, target: str = "Delta_Score", check: bool = True
) -> DataFrame:
    """PRJ12 with the reference guards: column present, no nulls, two classes.

    The guard is one aggregate (nulls + min/max label) read back to the driver.
    """
    if target not in dataset.columns:
        raise MissingColumnError(f"Target column '{target}' is not present in dataset.")
    labelled = dataset.withColumn("progression_label", progression_label(target, threshold))
    if check:
        row = labelled.agg(
            F.count_if(F.col(target).isNull()).alias("nulls"),
            F.min("progression_label").alias("lo"),
            F.max("progression_label").alias("hi"),
        ).first()
        if row["nulls"]:
            raise ValueError(f"Target column '{target}' contains missing values.")
        if row["lo"] is None or row["lo"] == row["hi"]:
            raise ValueError(
                "Progression label has a single class; choose another threshold."
            )
    return labelled


def horizon_summary(baselines: DataFrame, pairs: DataFrame) -> DataFrame:
    """AGG4 as one aggregate over (per-subject flags UNION retained subjects)."""
    flags = baselines.select(
        F.lit(1).alias("has_bl"), F.col("usable").cast("int").alias("usable"), F.lit(0).alias("kept")
    ).unionByName(pairs.select(F.lit(0).alias("has_bl"), F.lit(0).alias("usable"), F.lit(1).alias("kept")))
    s = flags.agg(
        F.sum("has_bl").cast("bigint").alias("baseline_patients"),
        F.sum("usable").cast("bigint").alias("usable_baseline_patients"),
        F.sum("kept").cast("bigint").alias("retained_patients"),
    )
    return s.select(
        F.coalesce("baseline_patients", F.lit(0)).cast("bigint").alias("baseline_patients"),
        F.coalesce("usable_baseline_patients", F.lit(0)).cast("bigint").alias("usable_baseline_patients"),
        F.coalesce("retained_patients", F.lit(0)).cast("bigint").alias("retained_patients"),
    ).select(
        "*",
        (F.col("baseline_patients") - F.col("usable_baseline_patients")).alias("excluded_invalid_baseline"),
        (F.col("usable_baseline_patients") - F.col("retained_patients")).alias("excluded_missing_follow_up"),
    )


# ---------------------------------------------------------------- multi-task

def multi_task_result(
    visits: DataFrame,
    tasks: Sequence[TaskSpec],
    feature_columns: Sequence[str] = (),
    read_once: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """JN5: every task of a grid in one pass.

    Returns ``(pairs, ledger)``. ``pairs`` has one row per (task_id, PATNO);
    ``ledger`` has three stage rows per task. All tasks must share the
    baseline event set (it is a cohort-level setting).
    """
    if not tasks:
        raise ConfigurationError("No tasks given.")
    event_sets = {t.baseline_event_ids for t in tasks}
    if len(event_sets) != 1:
        raise ConfigurationError("All tasks of one pass must share baseline_event_ids.")
    feature_columns = list(dict.fromkeys(feature_columns))
    spark = visits.sparkSession
    grid = task_grid_frame(spark, list(tasks))
    rows = _pairing_rows(visits, feature_columns, read_once)
    events = next(iter(event_sets))
    baselines, hot = _baselines_and_hot(rows, events)
    lo = min(t.horizon_days - t.tolerance_days for t in tasks)
    hi = max(t.horizon_days + t.tolerance_days for t in tasks)
    cands = _candidates(rows, baselines, events, feature_columns, lo, hi, hot)
    # Tasks that differ by outcome only share their window: pair once per distinct
    # window (a literal array, no join), then fan the top-1 rows out to the tasks.
    windows = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.lit(t).alias("tolerance_days"))
        for h, t in sorted({(t.horizon_days, t.tolerance_days) for t in tasks})
    ])
    near = F.filter(windows, lambda w: F.abs(F.col("Follow_Up_Days") - w["horizon_days"]) <= w["tolerance_days"])
    # a subject's baseline rows take part in every window
    of_row = F.when(F.col("_b").isNull(), near).otherwise(windows)
    in_window = cands.withColumn("_w", F.explode(of_row)).select("*", "_w.*").drop("_w")
    nearest = _select_nearest(
        in_window, F.col("horizon_days"), feature_columns, ("horizon_days", "tolerance_days", "PATNO"),
    ).withColumn("Delta_Score", F.col("Target_Score") - F.col("Baseline_Score"))
    chosen = nearest.join(
        grid.drop("task_name"), ["horizon_days", "tolerance_days"], "inner"
    ).select(
        "task_id", "outcome_type", "horizon_months", "tolerance_days", "progression_threshold",
        *[c for c in nearest.columns if c not in ("horizon_days", "tolerance_days")],
    )
    pairs = chosen.withColumn(
        "progression_label",
        F.when(
            F.col("outcome_type") == "binary",
            (F.col("Delta_Score") >= F.col("progression_threshold")).cast("int"),
        ),
    ).drop("outcome_type", "progression_threshold")
    ledger = multi_task_ledger(baselines, pairs, tasks)
    return pairs, ledger


def multi_task_ledger(baselines: DataFrame, pairs: DataFrame, tasks: Sequence[TaskSpec]) -> DataFrame:
    """Three ledger stages per task from one aggregate (no join)."""
    ids = list(dict.fromkeys(t.task_id for t in tasks))
    flags = baselines.select(
        F.lit(None).cast("string").alias("task_id"),
        F.lit(1).alias("has_bl"),
        F.col("usable").cast("int").alias("usable"),
    ).unionByName(pairs.select("task_id", F.lit(0).alias("has_bl"), F.lit(0).alias("usable")))
    aggs = [
        F.coalesce(F.sum("has_bl"), F.lit(0)).cast("bigint").alias("b"),
        F.coalesce(F.sum("usable"), F.lit(0)).cast("bigint").alias("u"),
    ] + [F.count_if(F.col("task_id") == t).cast("bigint").alias(f"r{i}") for i, t in enumerate(ids)]
    one = flags.agg(*aggs)
    spec = {t.task_id: t for t in tasks}
    rows = []
    for i, tid in enumerate(ids):
        t = spec[tid]
        reason = f"No eligible follow-up within {t.horizon_days} +/- {t.tolerance_days} days"
        rows += [
            F.struct(F.lit(tid).alias("task_id"), F.lit(1).alias("stage_order"),
                     F.lit("eligible_baseline_event").alias("stage"), F.col("b").alias("patients_retained"),
                     F.lit(0).cast("bigint").alias("patients_excluded_at_stage"),
                     F.lit("Eligible baseline event present").alias("exclusion_reason")),
            F.struct(F.lit(tid).alias("task_id"), F.lit(2).alias("stage_order"),
                     F.lit("usable_baseline").alias("stage"), F.col("u").alias("patients_retained"),
                     (F.col("b") - F.col("u")).alias("patients_excluded_at_stage"),
                     F.lit("Missing baseline score or date").alias("exclusion_reason")),
            F.struct(F.lit(tid).alias("task_id"), F.lit(3).alias("stage_order"),
                     F.lit("fixed_horizon_follow_up").alias("stage"), F.col(f"r{i}").alias("patients_retained"),
                     (F.col("u") - F.col(f"r{i}")).alias("patients_excluded_at_stage"),
                     F.lit(reason).alias("exclusion_reason")),
        ]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*").withColumn(
        "flow_component", F.lit("fixed_horizon")
    )


# ------------------------------------------------------------------- legacy

def endpoint_delta_dataset(
    visits: DataFrame,
    endpoint: str = "SCORE",
    feature_columns: Sequence[str] = (),
    baseline_event_ids: Sequence[str] = ("BL", "V01"),
) -> DataFrame:
    """VAL18: every post-baseline visit paired with the subject's baseline.

    Baseline = first visit, ordered by (date with missing dates last, event
    label, ROW_ID), whose raw label is in ``baseline_event_ids`` and whose
    endpoint is present. Baseline predictors are carried as
    ``<feature>_baseline``; only rows with ``time_from_baseline_days > 0`` and
    a present delta remain. The follow-up side contributes the endpoint only.
    """
    require_columns(visits.columns, {"PATNO", "EVENT_ID", "VISIT_DATE", endpoint, "ROW_ID", *feature_columns},
                    f"Cannot build {endpoint} model")
    needed = dict.fromkeys(["PATNO", "EVENT_ID", "VISIT_DATE", endpoint, "ROW_ID", *feature_columns])
    visits = staged_rows(visits.select(*needed).filter(F.col(endpoint).isNotNull()), "endpoint")
    bl = visits.filter(
        F.col("EVENT_ID").isin(list(baseline_event_ids))
        & F.col(endpoint).isNotNull() & F.col("PATNO").isNotNull()
    )
    payload = F.struct(
        F.col("VISIT_DATE").alias("baseline_date"),
        F.col(endpoint).alias(f"{endpoint}_baseline"),
        *[F.col(c).alias(f"{c}_baseline") for c in feature_columns],
    )
    order_key = F.struct(
        F.col("VISIT_DATE").isNull(), F.col("VISIT_DATE"), F.col("EVENT_ID"), F.col("ROW_ID")
    )
    base = bl.groupBy("PATNO").agg(F.min_by(payload, order_key).alias("b")).select("PATNO", "b.*")
    follow = visits.filter(F.col(endpoint).isNotNull() & F.col("VISIT_DATE").isNotNull()).select(
        "PATNO", "EVENT_ID", "VISIT_DATE", "ROW_ID", endpoint
    )
    # visits x one baseline row per subject: hot subjects are split over salts
    joined = split_hot_keys(follow, base, "PATNO", "inner", row_cols=["ROW_ID"]).withColumn(
        "time_from_baseline_days", whole_days("VISIT_DATE", "baseline_date")
    )
    return joined.filter(F.col("time_from_baseline_days") > 0).withColumn(
        f"{endpoint}_delta", F.col(endpoint) - F.col(f"{endpoint}_baseline")
    )


def cohort_counts(visits: DataFrame, result: HorizonResult) -> DataFrame:
    """AGG5: records, subjects, baseline subjects and the AGG4 numbers, one row.

    One aggregate over (per-subject rows UNION per-subject pairing flags);
    the per-subject pre-aggregation collapses hot subjects map-side.
    """
    per_subject = visits.groupBy("PATNO").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(label_norm("EVENT_ID") == "BL").alias("bl"),
    )
    flags = per_subject.select(
        F.col("n").alias("records"),
        F.when(F.col("PATNO").isNotNull(), 1).otherwise(0).alias("patient"),
        F.when(F.col("PATNO").isNotNull() & F.col("bl"), 1).otherwise(0).alias("bl_patient"),
        F.lit(0).alias("usable"), F.lit(0).alias("kept"),
    ).unionByName(
        result.baselines.select(
            F.lit(0).alias("records"), F.lit(0).alias("patient"), F.lit(0).alias("bl_patient"),
            F.col("usable").cast("int").alias("usable"), F.lit(0).alias("kept"),
        )
    ).unionByName(
        result.pairs.select(
            F.lit(0).alias("records"), F.lit(0).alias("patient"), F.lit(0).alias("bl_patient"),
            F.lit(0).alias("usable"), F.lit(1).alias("kept"),
        )
    )
    s = flags.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                    for c in ("records", "patient", "bl_patient", "usable", "kept")])
    return s.select(
        F.col("records").alias("visit_records"),
        F.col("patient").alias("unique_patients"),
        F.col("bl_patient").alias("baseline_patients"),
        F.col("usable").alias("usable_baseline_patients"),
        F.col("kept").alias("retained_patients"),
        (F.col("bl_patient") - F.col("usable")).alias("excluded_invalid_baseline"),
        (F.col("usable") - F.col("kept")).alias("excluded_missing_follow_up"),
    )
