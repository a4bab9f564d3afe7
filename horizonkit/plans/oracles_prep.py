"""DuckDB twins: fold-local preprocessing and feature stability."""

from __future__ import annotations

from horizonkit.plans import tasks as T
from horizonkit.plans.oracles import OUTER, STRAT, _agg10, _jn4, oracle

FEATS = ["Baseline_Score", "ACCTBAL", "N_LINES", "SUM_QTY", "MAX_DISC"]


def _gds() -> str:
    return f"""ds AS (SELECT PATNO AS patient_id, progression_label, Delta_Score, Baseline_Score,
       CASE WHEN PATNO % 7 = 0 THEN NULL ELSE ACCTBAL END AS ACCTBAL, N_LINES, SUM_QTY,
       CASE WHEN PATNO % 11 = 0 THEN NULL ELSE MAX_DISC END AS MAX_DISC FROM ({_jn4()}) q),
fv AS ({' UNION ALL '.join(f"SELECT patient_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM ds"
                          for f in FEATS)})"""


LONG = """lg AS (SELECT sf.repeat, sf.fold, sf.patient_id, fv.feature, fv.value
       FROM sf JOIN fv ON sf.patient_id = fv.patient_id),
tr AS (SELECT lg.repeat, CAST(o.f AS INTEGER) AS outer_fold, lg.feature, lg.value
       FROM lg, generate_series(1, 5) AS o(f) WHERE lg.fold <> o.f),
allp AS (SELECT DISTINCT repeat, outer_fold, feature FROM tr),
med AS (SELECT repeat, outer_fold, feature, median(value) AS m FROM tr
        WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
imp AS (SELECT a.repeat, a.outer_fold, a.feature, coalesce(m, 0.0) AS impute_value
        FROM allp a LEFT JOIN med USING (repeat, outer_fold, feature))"""


def _base() -> str:
    return f"WITH {_gds()}, {STRAT}, {LONG}"


@oracle("agg8_feature_coverage")
def _agg8() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(count({f}) AS BIGINT) AS usable_values, count({f}) = 0 AS no_usable_value "
        f"FROM ds" for f in FEATS
    )
    return f"WITH {_gds()} {parts}"


@oracle("agg21_impute_median")
def _agg21m() -> str:
    return _base() + "\nSELECT * FROM imp"


@oracle("agg21_impute_most_frequent")
def _agg21f() -> str:
    return _base() + """,
cnt AS (SELECT repeat, outer_fold, feature, value, count(*) AS c FROM tr
        WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY repeat, outer_fold, feature ORDER BY c DESC, value) AS rk
         FROM cnt)
SELECT a.repeat, a.outer_fold, a.feature, coalesce(b.value, 0.0) AS impute_value
FROM allp a LEFT JOIN (SELECT * FROM best WHERE rk = 1) b USING (repeat, outer_fold, feature)"""


@oracle("agg22_fold_scaling")
def _agg22() -> str:
    return _base() + """,
trv AS (SELECT t.repeat, t.outer_fold, t.feature, coalesce(t.value, i.impute_value) AS v
        FROM tr t JOIN imp i USING (repeat, outer_fold, feature))
SELECT repeat, outer_fold, feature, CAST(count(*) AS BIGINT) AS n, avg(v) AS mean, stddev_pop(v) AS sd,
       CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS scale
FROM trv GROUP BY ALL"""


@oracle("agg24_domain_guards")
def _agg24() -> str:
    return f"""WITH {_gds()},
g AS (SELECT CAST(count(*) AS BIGINT) AS rows,
             CAST(count(*) FILTER (WHERE patient_id IS NULL) AS BIGINT) AS missing_ids,
             CAST(count(*) FILTER (WHERE progression_label IS NULL) AS BIGINT) AS missing_targets,
             CAST(count(*) FILTER (WHERE progression_label IS NOT NULL AND progression_label NOT IN (0, 1))
                  AS BIGINT) AS non_binary_targets,
             CAST(count(DISTINCT progression_label) AS BIGINT) AS target_classes,
             CAST(count(*) - count(DISTINCT patient_id) AS BIGINT) AS duplicate_ids FROM ds)
SELECT *, (missing_ids = 0 AND missing_targets = 0 AND non_binary_targets = 0 AND target_classes = 2
           AND duplicate_ids = 0) AS passed FROM g"""


@oracle("agg24_training_classes")
def _agg24t() -> str:
    return f"""WITH {_gds()}, {STRAT}
SELECT sf.repeat, CAST(o.f AS INTEGER) AS outer_fold,
       CAST(count(DISTINCT sf.progression_label) AS BIGINT) AS training_classes,
       count(DISTINCT sf.progression_label) = 2 AS two_classes
FROM sf, generate_series(1, {OUTER}) AS o(f) WHERE sf.fold <> o.f GROUP BY ALL"""


def _records_sql(folds_cte: str, cfg: str) -> str:
    return f"""WITH {_gds()}, {folds_cte},
pairs AS (SELECT sf.repeat, sf.fold, fv.feature, fv.value AS x, CAST(d.Delta_Score AS DOUBLE) AS y
          FROM sf JOIN ds d ON sf.patient_id = d.patient_id JOIN fv ON fv.patient_id = sf.patient_id
          WHERE fv.value IS NOT NULL AND d.Delta_Score IS NOT NULL),
per AS (SELECT repeat, fold, feature, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy,
               sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM pairs GROUP BY ALL),
s AS (SELECT p.repeat, CAST(o.f AS INTEGER) AS outer_fold, p.feature, sum(n) AS n, sum(sx) AS sx,
             sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy
      FROM per p, generate_series(1, {OUTER}) AS o(f) WHERE p.fold <> o.f GROUP BY ALL),
m AS (SELECT *, sxy - sx * sy / n AS cv, sxx - sx * sx / n AS vx, syy - sy * sy / n AS vy FROM s),
rr AS (SELECT '{cfg}' AS configuration_id,
              '{cfg}-r' || CAST(repeat AS VARCHAR) || '-f' || CAST(outer_fold AS VARCHAR) AS fit_id,
              CAST(repeat AS INTEGER) AS repeat, outer_fold, 'univariate' AS model_family,
              'coefficient' AS importance_type, feature,
              round(CASE WHEN vx > 0 AND vy > 0 THEN cv / sqrt(vx * vy) ELSE 0.0 END, 12) AS signed_value
       FROM m),
rr2 AS (SELECT *, abs(signed_value) AS importance FROM rr),
recs AS (SELECT *, CAST(rank() OVER (PARTITION BY fit_id ORDER BY importance DESC)
                        + (count(*) OVER (PARTITION BY fit_id, importance) - 1) / 2.0 AS DOUBLE) AS rank,
                CASE WHEN sum(importance) OVER (PARTITION BY fit_id) > 0
                     THEN importance / sum(importance) OVER (PARTITION BY fit_id) ELSE 0.0 END
                  AS normalized_importance
         FROM rr2)"""


def _strat_records() -> str:
    return _records_sql(STRAT, T.feature_task().task_id)


UNSHUFFLED = f"""sf AS (SELECT patient_id, CAST(1 AS INTEGER) AS repeat,
        CAST((row_number() OVER (ORDER BY patient_id) - 1) % {OUTER} + 1 AS INTEGER) AS fold FROM ds)"""


def _harness_records() -> str:
    return _records_sql(UNSHUFFLED, "harness") + """,
fc AS (SELECT outer_fold AS fold, feature, signed_value AS coefficient, importance AS absolute_importance,
              normalized_importance FROM recs),
hs AS (SELECT feature, avg(normalized_importance) AS mean_normalized_importance,
              stddev_samp(normalized_importance) AS importance_standard_deviation,
              avg(coefficient) AS mean_coefficient,
              CAST(count(*) FILTER (WHERE coefficient <> 0) AS BIGINT) AS nonzero_folds
       FROM fc GROUP BY feature),
hst AS (SELECT *, nonzero_folds / 5.0 AS stability_rate FROM hs)"""


STAB = """tot AS (SELECT configuration_id, count(DISTINCT fit_id) AS fits, greatest(max(rank), 1.0) AS mr
        FROM recs GROUP BY ALL),
per2 AS (SELECT configuration_id, feature, avg(normalized_importance) AS mean_importance,
                count(*) FILTER (WHERE importance > 0) AS inc,
                count(*) FILTER (WHERE importance > 0 AND signed_value > 0) AS pos,
                count(*) FILTER (WHERE importance > 0 AND signed_value < 0) AS neg,
                avg(rank) AS mean_rank, stddev_pop(rank) AS rank_standard_deviation,
                count(DISTINCT fit_id) AS n_fits FROM recs GROUP BY ALL),
stab AS (SELECT configuration_id, feature, mean_importance, inc / fits AS inclusion_frequency,
                CASE WHEN inc > 0 THEN greatest(pos, neg) / inc END AS sign_consistency,
                mean_rank, rank_standard_deviation,
                greatest(0.0, 1 - rank_standard_deviation / mr) AS rank_stability,
                CAST(n_fits AS BIGINT) AS n_fits
         FROM per2 JOIN tot USING (configuration_id))"""


@oracle("win3_feature_records")
def _win3() -> str:
    return _strat_records() + "\nSELECT * FROM recs"


@oracle("agg13_feature_stability")
def _agg13() -> str:
    return _strat_records() + f",\n{STAB}\nSELECT * FROM stab"


@oracle("agg15_stability_summary")
def _agg15() -> str:
    return _strat_records() + f""",
{STAB}
SELECT configuration_id, CAST(count(DISTINCT feature) AS BIGINT) AS feature_count,
       avg(sign_consistency) AS mean_sign_consistency, avg(inclusion_frequency) AS mean_inclusion_frequency,
       avg(rank_stability) AS mean_rank_stability,
       array_to_string(list(feature ORDER BY rank_stability DESC, mean_importance DESC, mean_rank, feature)[1:5],
                       ';') AS top_stable_features
FROM stab GROUP BY configuration_id"""


@oracle("agg14_harness_stability")
def _agg14() -> str:
    return _harness_records() + "\nSELECT * FROM hst"


@oracle("agg18_coefficient_matrix")
def _agg18() -> str:
    cols = ", ".join(f'avg(coefficient) FILTER (WHERE fold = {f}) AS "{f}"' for f in range(1, OUTER + 1))
    return _harness_records() + f"\nSELECT feature, {cols} FROM fc GROUP BY feature"


@oracle("jn10_stability_labels")
def _jn10() -> str:
    return _harness_records() + """
SELECT f.feature, f.feature || ' (stability=' || coalesce(printf('%.2f', h.stability_rate), 'nan') || ')' AS label
FROM (SELECT DISTINCT feature FROM fc) f LEFT JOIN hst h USING (feature)"""


@oracle("win7_top_features")
def _win7() -> str:
    return _harness_records() + """,
o AS (SELECT *, row_number() OVER (ORDER BY mean_normalized_importance * stability_rate DESC,
                                   stability_rate DESC, mean_normalized_importance DESC, feature) AS position
      FROM hst)
SELECT CAST(position AS INTEGER) AS position, feature, mean_normalized_importance, stability_rate
FROM o WHERE position <= 5"""


@oracle("win8_point_sizes")
def _win8() -> str:
    return _harness_records() + """,
iv AS (SELECT feature, 1.0 / (coalesce(importance_standard_deviation, 0.0) + 1e-9) AS inv FROM hst),
mm AS (SELECT min(inv) AS lo, max(inv) AS hi FROM iv)
SELECT feature, CASE WHEN hi - lo = 0 THEN 150.0 ELSE 80.0 + (inv - lo) / (hi - lo) * 270.0 END AS size
FROM iv, mm"""


@oracle("agg19_fold_score_quartiles")
def _agg19() -> str:
    return f"""WITH fm AS (SELECT group_id AS fold, auroc AS auc_roc, f1_score, precision FROM ({_agg10()}) q),
lg AS (SELECT 'AUC-ROC' AS metric, auc_roc AS score FROM fm WHERE auc_roc IS NOT NULL
       UNION ALL SELECT 'F1-score', f1_score FROM fm WHERE f1_score IS NOT NULL
       UNION ALL SELECT 'Precision', precision FROM fm WHERE precision IS NOT NULL)
SELECT metric, CAST(count(*) AS BIGINT) AS n, min(score) AS q0, quantile_cont(score, 0.25) AS q1,
       quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3, max(score) AS q4
FROM lg GROUP BY metric"""
