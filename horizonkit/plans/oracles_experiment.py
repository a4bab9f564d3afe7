"""DuckDB twins: experiment-grid chain, audit and fingerprints."""

from __future__ import annotations

from horizonkit.plans import tasks as T
from horizonkit.plans.grid import FEATURE_BLOCKS
from horizonkit.plans.oracles import LI_FEATURES, VISITS, _jn5, grid_values, md5_draw, oracle, task_json
from horizonkit.plans.oracles_eval import boot_regression_sql
from horizonkit.plans.oracles_prep import STAB

SPLITS, REPEATS, RESAMPLES, SEED = 5, 2, 50, 42
FEATS = ["Baseline_Score", "ACCTBAL", "N_LINES", "SUM_QTY", "MAX_DISC"]


BLOCKS = '["demographics_disease_history", "baseline_motor", "olfaction_sleep_autonomic"]'


def _manifest_values() -> str:
    return (grid_values(T.grid_tasks()) + f""",
manifest AS (SELECT task_id AS configuration_id, task, '{BLOCKS}' AS feature_blocks, 'none' AS imputation_strategy,
                    'no_change' AS model_family, '{{}}' AS model_parameters FROM grid),
config AS (SELECT sha256('{{"features":["ACCTBAL","N_LINES","SUM_QTY","MAX_DISC"],"n_resamples":{RESAMPLES},"outer_repeats":{REPEATS},"outer_splits":{SPLITS},"seed":{SEED},"tasks":['
                         || string_agg(task, ',' ORDER BY place) || ']}}') AS config_sha256 FROM grid)""")


def _chain() -> str:
    fv = " UNION ALL ".join(
        f"SELECT configuration_id, patient_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM pairs"
        for f in FEATS
    )
    return f"""WITH pairs AS (SELECT task_id AS configuration_id, PATNO AS patient_id, Baseline_Score, ACCTBAL,
                         N_LINES, SUM_QTY, MAX_DISC, Target_Score, Delta_Score FROM ({_jn5()}) q),
rep AS (SELECT p.configuration_id, p.patient_id, CAST(t.r AS INTEGER) AS repeat
        FROM pairs p, generate_series(1, {REPEATS}) AS t(r)),
hs AS (SELECT *, {md5_draw(f'{SEED} + repeat - 1', 'patient_id')} AS hh FROM rep),
sf AS (SELECT configuration_id, patient_id, repeat,
              CAST((row_number() OVER (PARTITION BY configuration_id, repeat ORDER BY hh, patient_id) - 1)
                   % {SPLITS} + 1 AS INTEGER) AS fold FROM hs),
asg AS (SELECT configuration_id,
               configuration_id || '-r' || CAST(repeat AS VARCHAR) || '-f' || CAST(o.f AS VARCHAR) AS fit_id,
               repeat, CAST(o.f AS INTEGER) AS outer_fold,
               CASE WHEN fold = o.f THEN 'test' ELSE 'train' END AS partition, patient_id
        FROM sf, generate_series(1, {SPLITS}) AS o(f)),
oof AS (SELECT a.configuration_id, a.fit_id, a.repeat, a.outer_fold, a.patient_id, p.Target_Score AS y_true,
               p.Baseline_Score AS y_pred, p.Target_Score - p.Baseline_Score AS residual
        FROM asg a JOIN pairs p ON a.configuration_id = p.configuration_id AND a.patient_id = p.patient_id
        WHERE a.partition = 'test'),
fv AS ({fv}),
px AS (SELECT sf.configuration_id, sf.repeat, sf.fold, fv.feature, fv.value AS x,
              CAST(p.Delta_Score AS DOUBLE) AS y
       FROM sf JOIN pairs p ON sf.configuration_id = p.configuration_id AND sf.patient_id = p.patient_id
       JOIN fv ON fv.configuration_id = sf.configuration_id AND fv.patient_id = sf.patient_id
       WHERE fv.value IS NOT NULL AND p.Delta_Score IS NOT NULL),
per AS (SELECT configuration_id, repeat, fold, feature, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx,
               sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM px GROUP BY ALL),
s AS (SELECT p.configuration_id, p.repeat, CAST(o.f AS INTEGER) AS outer_fold, p.feature, sum(n) AS n,
             sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy
      FROM per p, generate_series(1, {SPLITS}) AS o(f) WHERE p.fold <> o.f GROUP BY ALL),
m0 AS (SELECT *, sxy - sx * sy / n AS cv, sxx - sx * sx / n AS vx, syy - sy * sy / n AS vy FROM s),
rr AS (SELECT configuration_id,
              configuration_id || '-r' || CAST(repeat AS VARCHAR) || '-f' || CAST(outer_fold AS VARCHAR) AS fit_id,
              feature, round(CASE WHEN vx > 0 AND vy > 0 THEN cv / sqrt(vx * vy) ELSE 0.0 END, 12) AS signed_value
       FROM m0),
rr2 AS (SELECT *, abs(signed_value) AS importance FROM rr),
recs AS (SELECT *, CAST(rank() OVER (PARTITION BY fit_id ORDER BY importance DESC)
                        + (count(*) OVER (PARTITION BY fit_id, importance) - 1) / 2.0 AS DOUBLE) AS rank,
                CASE WHEN sum(importance) OVER (PARTITION BY fit_id) > 0
                     THEN importance / sum(importance) OVER (PARTITION BY fit_id) ELSE 0.0 END
                  AS normalized_importance
         FROM rr2),
{STAB},
stabsum AS (SELECT configuration_id, CAST(count(DISTINCT feature) AS BIGINT) AS feature_count,
                   avg(sign_consistency) AS mean_sign_consistency,
                   avg(inclusion_frequency) AS mean_inclusion_frequency,
                   avg(rank_stability) AS mean_rank_stability,
                   array_to_string(list(feature ORDER BY rank_stability DESC, mean_importance DESC, mean_rank,
                                        feature)[1:5], ';') AS top_stable_features
            FROM stab GROUP BY configuration_id),
ci AS (SELECT * FROM ({boot_regression_sql(
        "WITH bi AS (SELECT configuration_id, patient_id, y_true AS y_value, y_pred AS y_estimate FROM oof)")}) q),
coh AS (SELECT configuration_id, CAST(count(*) AS BIGINT) AS retained_patients FROM pairs GROUP BY 1),
{_manifest_values()},
man AS (SELECT configuration_id, imputation_strategy, model_family, model_parameters,
               json_extract_string(task, '$.outcome_type') AS outcome_type,
               CAST(json_extract_string(task, '$.horizon_months') AS INTEGER) AS horizon_months,
               CAST(json_extract_string(task, '$.tolerance_days') AS INTEGER) AS tolerance_days,
               json_extract_string(task, '$.endpoint') AS endpoint,
               CAST(json_extract_string(task, '$.progression_threshold') AS DOUBLE) AS progression_threshold,
               json_extract_string(task, '$.medication_state') AS medication_state,
               array_to_string(from_json(feature_blocks, '["VARCHAR"]'), '+') AS selected_feature_blocks,
               {", ".join(f"CAST(list_contains(from_json(feature_blocks, '[\"VARCHAR\"]'), '{b}') AS INTEGER) AS feature_block__{b}" for b in FEATURE_BLOCKS)}
        FROM manifest),
summary AS (
  SELECT ci.*, man.* EXCLUDE (configuration_id), stabsum.* EXCLUDE (configuration_id), coh.retained_patients,
         'grid' AS batch_experiment, 'grid:' || ci.configuration_id AS specification_key,
         'patient_isolated' AS validation_strategy, CAST({SPLITS} AS INTEGER) AS outer_splits,
         CAST({REPEATS} AS INTEGER) AS outer_repeats, CAST(0 AS INTEGER) AS inner_splits,
         (SELECT config_sha256 FROM config) AS config_sha256,
         'testdata' AS database_version, CAST({SEED} AS INTEGER) AS random_seed,
         CAST(NULL AS VARCHAR) AS source_file_sha256, '0.1.0' AS software_version,
         CASE WHEN ci.metric IN ('mae', 'rmse', 'brier_score') THEN 'lower_is_better'
              ELSE 'higher_is_better' END AS metric_direction
  FROM ci LEFT JOIN man ON ci.configuration_id = man.configuration_id
  LEFT JOIN stabsum ON ci.configuration_id = stabsum.configuration_id
  LEFT JOIN coh ON ci.configuration_id = coh.configuration_id)"""


@oracle("val21_experiment_summary")
def _val21() -> str:
    return _chain() + "\nSELECT * FROM summary"


@oracle("prj19_choice_grid")
def _prj19() -> str:
    labels = ["Demographics/history", "Baseline motor", "Cognition", "Olfaction/sleep/autonomic", "Biofluid",
              "DAT-SPECT", "Genetics"]
    rows = [
        ("Horizon", "CAST(horizon_months AS VARCHAR) || 'm'", "false"),
        ("Tolerance", "'+/-' || CAST(tolerance_days AS VARCHAR) || 'd'", "false"),
        ("Imputation", "imputation_strategy", "false"),
        ("Validation", "validation_strategy", "false"),
        ("Model", "model_family", "false"),
    ] + [(lab, f"CAST(coalesce(feature_block__{b}, 0) AS VARCHAR)", "true")
         for lab, b in zip(labels, FEATURE_BLOCKS, strict=True)]
    parts = " UNION ALL ".join(
        f"SELECT specification_key, CAST({i + 1} AS INTEGER) AS row_order, '{name}' AS choice, {expr} AS value, "
        f"{flag} AS binary FROM spec"
        for i, (name, expr, flag) in enumerate(rows)
    )
    return _chain() + f""",
spec AS (SELECT DISTINCT specification_key, horizon_months, tolerance_days, imputation_strategy,
                validation_strategy, model_family, {", ".join(f"feature_block__{b}" for b in FEATURE_BLOCKS)}
         FROM summary)
{parts}"""


@oracle("win6_specification_curve")
def _win6() -> str:
    return _chain() + """,
d AS (SELECT * FROM summary WHERE metric = 'mae' AND estimate IS NOT NULL AND NOT isnan(estimate)),
a AS (SELECT *, estimate - ci_lower AS lo, ci_upper - estimate AS hi FROM d)
SELECT metric, specification_key, estimate, ci_lower, ci_upper,
       CAST(row_number() OVER (ORDER BY round(estimate, 9), specification_key) AS INTEGER) AS plot_index,
       CASE WHEN lo IS NOT NULL AND NOT isnan(lo) AND lo >= 0 AND hi IS NOT NULL AND NOT isnan(hi) AND hi >= 0
            THEN lo END AS lower_arm,
       CASE WHEN lo IS NOT NULL AND NOT isnan(lo) AND lo >= 0 AND hi IS NOT NULL AND NOT isnan(hi) AND hi >= 0
            THEN hi END AS upper_arm
FROM a"""


def _checks() -> str:
    return """,
tk AS (SELECT configuration_id, fit_id, patient_id FROM asg WHERE partition = 'test'),
ok AS (SELECT configuration_id, fit_id, patient_id FROM oof),
c1 AS (SELECT count(*) AS n FROM (SELECT fit_id, patient_id FROM asg GROUP BY ALL
       HAVING count(*) FILTER (WHERE partition = 'train') > 0 AND count(*) FILTER (WHERE partition = 'test') > 0)),
c2 AS (SELECT count(*) AS n FROM (SELECT * FROM ok EXCEPT ALL SELECT * FROM tk)),
c3 AS (SELECT count(*) AS n FROM (SELECT * FROM tk EXCEPT ALL SELECT * FROM ok)),
c4 AS (SELECT count(*) AS n FROM (SELECT configuration_id, repeat, patient_id FROM asg GROUP BY ALL
       HAVING count(*) FILTER (WHERE partition = 'test') <> 1)),
c5 AS (SELECT count(*) AS n FROM (SELECT fit_id, patient_id FROM oof GROUP BY ALL HAVING count(*) > 1)),
mi AS (SELECT DISTINCT configuration_id FROM manifest),
ai AS (SELECT DISTINCT configuration_id FROM asg),
oi AS (SELECT DISTINCT configuration_id FROM oof),
c6 AS (SELECT count(*) AS n FROM ((SELECT * FROM mi EXCEPT SELECT * FROM ai) UNION ALL
                                   (SELECT * FROM ai EXCEPT SELECT * FROM mi))),
c7 AS (SELECT count(*) AS n FROM ((SELECT * FROM mi EXCEPT SELECT * FROM oi) UNION ALL
                                   (SELECT * FROM oi EXCEPT SELECT * FROM mi))),
fitcount AS (SELECT (SELECT count(DISTINCT configuration_id) FROM manifest) AS specs,
                    (SELECT count(DISTINCT fit_id) FROM asg) AS fits)
SELECT 'no_patient_overlap' AS "check", n = 0 AS passed, CAST(n AS VARCHAR) || ' leaking subject-fit pairs' AS detail FROM c1
UNION ALL SELECT 'oof_rows_have_test_assignment', n = 0, CAST(n AS VARCHAR) || ' OOF rows without a test assignment' FROM c2
UNION ALL SELECT 'test_assignments_have_oof', n = 0, CAST(n AS VARCHAR) || ' test assignments without an OOF row' FROM c3
UNION ALL SELECT 'one_test_fold_per_repeat', n = 0, CAST(n AS VARCHAR) || ' subject-repeat pairs not tested exactly once' FROM c4
UNION ALL SELECT 'no_duplicate_oof', n = 0, CAST(n AS VARCHAR) || ' duplicated OOF keys' FROM c5
UNION ALL SELECT 'manifest_matches_assignments', n = 0, CAST(n AS VARCHAR) || ' configuration ids differ' FROM c6
UNION ALL SELECT 'manifest_matches_predictions', n = 0, CAST(n AS VARCHAR) || ' configuration ids differ' FROM c7
UNION ALL SELECT 'expected_fit_count', fits = specs * 10, CAST(fits AS VARCHAR) || ' fits, expected ' || CAST(specs * 10 AS VARCHAR) FROM fitcount"""


@oracle("val22_integrity_audit")
def _val22() -> str:
    return _chain() + _checks()


@oracle("val22_audit_tampered")
def _val22_tampered() -> str:
    checks = _checks().replace("FROM oof", "FROM oof2").replace("FROM asg", "FROM asg2")
    return _chain() + """,
oof1 AS (SELECT * FROM oof WHERE patient_id % 7 <> 0),
oof2 AS (SELECT * FROM oof1 UNION ALL SELECT * FROM oof1 WHERE patient_id % 11 = 0),
asg2 AS (SELECT * FROM asg UNION ALL SELECT * REPLACE ('train' AS partition) FROM asg
         WHERE patient_id % 13 = 0 AND partition = 'test'),
man2 AS (SELECT * FROM manifest WHERE configuration_id <> (SELECT min(configuration_id) FROM manifest))""" + \
        checks.replace("FROM manifest", "FROM man2")


@oracle("agg23_audit_totals")
def _agg23() -> str:
    return _chain() + f"""
SELECT CAST((SELECT count(DISTINCT configuration_id) FROM manifest) AS BIGINT) AS specs,
       CAST((SELECT count(DISTINCT fit_id) FROM asg) AS BIGINT) AS fits,
       CAST((SELECT count(*) FROM oof) AS BIGINT) AS oof_rows,
       CAST((SELECT count(*) FROM asg WHERE partition = 'test') AS BIGINT) AS test_rows,
       CAST((SELECT count(DISTINCT configuration_id) FROM manifest) * {SPLITS * REPEATS} AS BIGINT) AS expected_fits"""


@oracle("agg6_duplicate_visit_keys")
def _agg6() -> str:
    return f"""WITH {LI_FEATURES}, {VISITS}
SELECT PATNO, VISIT_DATE, CAST(count(*) AS BIGINT) AS rows FROM visits GROUP BY ALL HAVING count(*) > 1"""


@oracle("prj16_row_fingerprint")
def _prj16() -> str:
    return """SELECT c_custkey, substr(sha256(to_json({'c_acctbal': CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), 'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment,
       'c_name': c_name, 'c_nationkey': c_nationkey})), 1, 16) AS row_id FROM customer"""


@oracle("jn9_parameter_grid")
def _jn9() -> str:
    med = "'\"OFF\"'"
    return f"""WITH ep AS (
  SELECT n_name AS study, c_mktsegment AS endpoint, 'OFF' AS medication_state, CAST(count(*) AS BIGINT) AS subjects
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
h(hp, horizon_months, horizon_days) AS (VALUES (0, 12, 365), (1, 24, 730), (2, 36, 1095)),
t(tp, tolerance_days) AS (VALUES (0, 60), (1, 90)),
o(op, outcome_type, progression_threshold) AS (VALUES (0, 'continuous', CAST(NULL AS DOUBLE)), (1, 'binary', 5.0)),
i(ip, imputation_strategy) AS (VALUES (0, 'median'), (1, 'most_frequent')),
m(mp, model_family) AS (VALUES (0, 'elasticnet'), (1, 'random_forest')),
b(bp, feature_blocks) AS (VALUES (0, '["baseline_motor"]'),
                                 (1, '["demographics_disease_history", "baseline_motor"]')),
grid0 AS (SELECT *, ((((hp * 2 + tp) * 2 + op) * 2 + ip) * 2 + mp) * 2 + bp AS place,
                 study || '_' || endpoint || '_' || CAST(horizon_months AS VARCHAR) || 'm_' || outcome_type AS task_name,
                 CASE WHEN model_family = 'random_forest' THEN '{{"max_depth": [null, 5]}}'
                      WHEN outcome_type = 'binary' THEN '{{"C": [0.1, 1.0]}}'
                      ELSE '{{"alpha": [0.1]}}' END AS model_parameters
          FROM ep, h, t, o, i, m, b),
g AS (SELECT *, {task_json(med)} AS task, {task_json(med, ": ", ", ")} AS spaced FROM grid0)
SELECT study, endpoint, medication_state, subjects,
       substr(sha256('{{"feature_blocks": ' || feature_blocks || ', "imputation_strategy": "' || imputation_strategy
              || '", "model_family": "' || model_family || '", "model_parameters": ' || model_parameters
              || ', "task": ' || spaced || '}}'), 1, 16) AS configuration_id,
       CAST(place AS INTEGER) AS position, substr(sha256(task), 1, 16) AS task_id, task, task_name, outcome_type,
       CAST(horizon_months AS INTEGER) AS horizon_months, CAST(horizon_days AS INTEGER) AS horizon_days,
       CAST(tolerance_days AS INTEGER) AS tolerance_days, progression_threshold, feature_blocks,
       imputation_strategy, model_family, model_parameters
FROM g"""


@oracle("set1_ledger_union")
def _set1() -> str:
    from horizonkit.plans.oracles import _agg2, _agg3, _agg4_grid

    return (f"SELECT * FROM ({_agg2()}) a UNION ALL BY NAME SELECT * FROM ({_agg3()}) b "
            f"UNION ALL BY NAME SELECT * FROM ({_agg4_grid()}) c")
