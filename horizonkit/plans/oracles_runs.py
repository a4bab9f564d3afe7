"""DuckDB twins: what of a persisted run follows from the visits alone."""

from __future__ import annotations

from horizonkit.plans.grid import TaskSpec
from horizonkit.plans.oracles import ENDPOINT, GAP_VISITS, LI_FEATURES, VISITS, baseline_cte, candidates_cte, oracle

SPLITS, REPEATS, FEATURES = 3, 2, 4
TASK = TaskSpec("run_24m", "score", "continuous", 24, 90)


def _pairs() -> str:
    """CTEs up to ``kept``: the subjects of the 24-month pairing over the endpoint's records."""
    h, t = TASK.horizon_days, TASK.tolerance_days
    cohort = f"{LI_FEATURES}, {VISITS}, {GAP_VISITS}, {ENDPOINT}"
    paired = f"{baseline_cte([])},\n{candidates_cte([], h - t, h + t)}".replace("FROM visits", "FROM ev")
    return f"""WITH {cohort},
ev AS (SELECT PATNO, EVENT_ID, VISIT_DATE, SCORE, ROW_ID FROM es WHERE valid AND st = 'OFF'),
{paired},
kept AS (SELECT DISTINCT PATNO FROM cw),
o(outcome_type, metrics) AS (VALUES ('continuous', 5), ('binary', 8))"""


@oracle("val20_run_artifacts")
def _val20() -> str:
    fits = SPLITS * REPEATS
    return f"""{_pairs()},
n AS (SELECT count(*) AS n FROM kept),
a(artifact, per_subject, fixed) AS (VALUES
  ('cohort_flow', 0, 10), ('specification_manifest', 0, 1), ('fold_assignments', {fits}, 0),
  ('oof_predictions', {REPEATS}, 0), ('fold_metrics', 0, {fits}), ('feature_records', 0, {fits * FEATURES}),
  ('tuning_results', 0, {fits}), ('confidence_intervals', 0, 0), ('feature_stability', 0, {FEATURES}))
SELECT outcome_type, artifact,
       CAST(per_subject * n + fixed + CASE WHEN artifact = 'confidence_intervals' THEN metrics ELSE 0 END AS BIGINT) AS rows
FROM a, n, o"""


@oracle("val20_run_ledger")
def _val20_ledger() -> str:
    return f"""{_pairs()},
st AS (
  SELECT 'cohort' AS flow_component, 'input' AS stage, count(DISTINCT PATNO) AS p FROM c
  UNION ALL SELECT 'cohort', 'valid_patient_identifier', count(DISTINCT PATNO) FROM c
  UNION ALL SELECT 'cohort', 'eligible_diagnostic_group', count(DISTINCT PATNO) FROM c WHERE g
  UNION ALL SELECT 'cohort', 'baseline_eligible', count(DISTINCT PATNO) FROM cohort
  UNION ALL SELECT 'endpoint', 'endpoint_input', count(DISTINCT PATNO) FROM es
  UNION ALL SELECT 'endpoint', 'valid_endpoint_score', count(DISTINCT PATNO) FROM es WHERE valid
  UNION ALL SELECT 'endpoint', 'medication_state_off', count(DISTINCT PATNO) FROM es WHERE valid AND st = 'OFF'
  UNION ALL SELECT 'fixed_horizon', 'eligible_baseline_event', count(DISTINCT PATNO) FROM ev WHERE EVENT_ID = 'BL'
  UNION ALL SELECT 'fixed_horizon', 'usable_baseline', count(DISTINCT PATNO) FROM bl
  UNION ALL SELECT 'fixed_horizon', 'fixed_horizon_follow_up', count(*) FROM kept)
SELECT outcome_type, flow_component, stage, CAST(p AS BIGINT) AS patients_retained FROM st, o"""


@oracle("val22_persisted_audit")
def _val22() -> str:
    """A sound run passes every check; the checks are listed, and their number of subjects is not zero."""
    names = ("no_patient_overlap", "oof_rows_have_test_assignment", "test_assignments_have_oof",
             "one_test_fold_per_repeat", "no_duplicate_oof", "manifest_matches_assignments",
             "manifest_matches_predictions", "expected_fit_count", "files_present", "no_added_files",
             "file_hashes_match", "one_source", "source_recorded", "versions_recorded", "specifications_known",
             "no_identifiers_in_summary")
    values = ", ".join(f"('{n}')" for n in names)
    return f"""{_pairs()}, checks("check") AS (VALUES {values})
SELECT "check", (SELECT count(*) > 0 FROM kept) AS passed FROM checks"""
