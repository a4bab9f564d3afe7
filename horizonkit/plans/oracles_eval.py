"""DuckDB twins: bootstrap, calibration, stability, summaries, audits."""

from __future__ import annotations

import math

from horizonkit.plans.oracles import calibration_cte, md5_draw, oracle

N_RESAMPLES, LEVEL, SEED = 50, 0.95, 42
ALPHA = (1 - LEVEL) / 2

BOOT_INPUT = """bi AS (
  SELECT l_linestatus AS configuration_id, l_orderkey AS patient_id,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
         round(l_discount * 10, 1) AS y_probability,
         CASE WHEN round(l_discount * 10, 1) >= 0.5 THEN 1 ELSE 0 END AS y_pred,
         l_extendedprice AS y_value, l_quantity * 1500.0 AS y_estimate
  FROM lineitem)"""


def _weights_sql(stats: str) -> str:
    """CTEs ix (subject positions) and wt (group, b, subject, w) over ``stats``."""
    draw = (f"('0x' || substr(md5(CAST({SEED} AS VARCHAR) || ':' || CAST(t.b AS VARCHAR) || ':' || "
            f"CAST(j AS VARCHAR)), 1, 8))::BIGINT % n")
    return f"""ix AS (
  SELECT configuration_id, patient_id,
         row_number() OVER (PARTITION BY configuration_id ORDER BY hh, patient_id) - 1 AS j,
         count(*) OVER (PARTITION BY configuration_id) AS n
  FROM (SELECT configuration_id, patient_id, {md5_draw(SEED, 'patient_id')} AS hh FROM {stats}) q),
dr AS (SELECT configuration_id, t.b, {draw} AS k FROM ix, generate_series(1, {N_RESAMPLES}) AS t(b)),
wc AS (SELECT configuration_id, b, k, count(*) AS w FROM dr GROUP BY ALL),
wt AS (SELECT wc.configuration_id, wc.b, ix.patient_id, wc.w FROM wc
       JOIN ix ON wc.configuration_id = ix.configuration_id AND wc.k = ix.j
       UNION ALL SELECT configuration_id, 0, patient_id, 1 FROM ix)"""


def _intervals_sql(metrics: list[str]) -> str:
    longs = "\n  UNION ALL ".join(
        f"SELECT configuration_id, b, '{m}' AS metric, {m} AS value FROM m" for m in metrics
    )
    ok = "CASE WHEN b > 0 AND value IS NOT NULL AND NOT isnan(value) THEN value END"
    return f"""lg AS ({longs})
SELECT configuration_id, metric, max(CASE WHEN b = 0 THEN value END) AS estimate,
       quantile_cont({ok}, {ALPHA!r}) AS ci_lower, quantile_cont({ok}, {1 - ALPHA!r}) AS ci_upper,
       CAST({LEVEL!r} AS DOUBLE) AS confidence_level, CAST(count({ok}) AS BIGINT) AS valid_resamples
FROM lg GROUP BY configuration_id, metric"""


@oracle("agg12_bootstrap_regression")
def _agg12r() -> str:
    return boot_regression_sql(f"WITH {BOOT_INPUT}")


@oracle("agg12_bootstrap_poisson")
def _agg12p() -> str:
    return boot_regression_sql(f"WITH {BOOT_INPUT}", _poisson_sql("st"))


def _poisson_sql(stats: str, resamples: int = 1000) -> str:
    """CTE wt (group, b, subject, w): Poisson(1) weights by the inverse distribution function of a 32-bit draw."""
    u = f"(({md5_draw(f'{SEED} || chr(58) || t.b', 'patient_id')} + 0.5) / 4294967296.0)"
    steps, total, term = [], 0.0, math.exp(-1.0)
    for k in range(12):
        total += term
        steps.append(f"WHEN u <= {total!r} THEN {k}")
        term /= k + 1
    return f"""du AS (SELECT configuration_id, t.b, patient_id, {u} AS u FROM {stats}, generate_series(1, {resamples}) AS t(b)),
wt AS (SELECT * FROM (SELECT configuration_id, b, patient_id, CASE {' '.join(steps)} ELSE 12 END AS w FROM du) q WHERE w > 0
       UNION ALL SELECT configuration_id, 0, patient_id, 1 FROM {stats})"""


def boot_regression_sql(head: str, weights: str | None = None) -> str:
    """Bootstrap SQL over ``bi(configuration_id, patient_id, y_value, y_estimate)``.

    ``head`` is the WITH prefix that defines ``bi`` (and anything it needs);
    ``weights`` defines ``wt`` over the subject sums ``st``.
    """
    r = "(y_value - y_estimate)"
    return f"""{head},
st AS (SELECT configuration_id, patient_id, CAST(count(*) AS DOUBLE) AS n, sum(abs({r})) AS abs_r,
              sum({r} * {r}) AS r2s, sum({r}) AS rs, sum(y_value) AS ys, sum(y_value * y_value) AS y2s
       FROM bi GROUP BY ALL),
{weights or _weights_sql('st')},
pb AS (SELECT wt.configuration_id, wt.b, sum(w * st.n) AS N, sum(w * abs_r) AS A, sum(w * r2s) AS S,
              sum(w * rs) AS R, sum(w * ys) AS Y, sum(w * y2s) AS Y2
       FROM wt JOIN st ON wt.configuration_id = st.configuration_id AND wt.patient_id = st.patient_id
       GROUP BY ALL),
m AS (SELECT configuration_id, b, A / N AS mae, sqrt(S / N) AS rmse,
             CASE WHEN Y2 - Y * Y / N > 0 THEN 1 - S / (Y2 - Y * Y / N) WHEN S = 0 THEN 1.0 ELSE 0.0 END AS r2,
             R / N AS residual_mean,
             CASE WHEN N > 1 THEN sqrt(greatest((S - R * R / N) / (N - 1), 0.0)) END
               AS residual_standard_deviation
      FROM pb),
{_intervals_sql(['mae', 'rmse', 'r2', 'residual_mean', 'residual_standard_deviation'])}"""


@oracle("agg12_bootstrap_classification")
def _agg12c() -> str:
    return f"""WITH {BOOT_INPUT},
pp AS (SELECT configuration_id, patient_id, CAST(count(*) AS DOUBLE) AS n,
              sum((y_probability - y_true) * (y_probability - y_true)) AS sq,
              CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp,
              CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp,
              CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn
       FROM bi GROUP BY ALL),
ps AS (SELECT configuration_id, patient_id, y_probability AS s,
              CAST(count(*) FILTER (WHERE y_true = 1) AS DOUBLE) AS pos,
              CAST(count(*) FILTER (WHERE y_true <> 1) AS DOUBLE) AS neg
       FROM bi GROUP BY ALL),
{_weights_sql('pp')},
si AS (SELECT wt.configuration_id, wt.b, sum(w * n) AS n, sum(w * sq) AS sq, sum(w * tp) AS tp,
              sum(w * fp) AS fp, sum(w * fn) AS fn
       FROM wt JOIN pp ON wt.configuration_id = pp.configuration_id AND wt.patient_id = pp.patient_id
       GROUP BY ALL),
sc AS (SELECT wt.configuration_id, wt.b, ps.s, sum(w * pos) AS pos, sum(w * neg) AS neg
       FROM wt JOIN ps ON wt.configuration_id = ps.configuration_id AND wt.patient_id = ps.patient_id
       GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY configuration_id, b ORDER BY s DESC
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
               sum(neg) OVER (PARTITION BY configuration_id, b ORDER BY s DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cfp,
               sum(pos) OVER (PARTITION BY configuration_id, b) AS n_pos,
               sum(neg) OVER (PARTITION BY configuration_id, b) AS n_neg FROM sc),
rk AS (SELECT configuration_id, b,
              CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
                   THEN sum(pos * ((n_neg - cfp) + 0.5 * neg)) / (max(n_pos) * max(n_neg)) END AS auroc,
              CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
                   THEN sum(pos * ctp / (ctp + cfp)) / max(n_pos) END AS auprc
       FROM cum GROUP BY ALL),
kc AS (SELECT configuration_id AS cfg, b AS rb, s, pos, neg FROM sc),
{calibration_cte('kc', 'cfg, rb', 's')},
m AS (SELECT si.configuration_id, si.b, auroc, auprc, sq / n AS brier_score, calibration_intercept, calibration_slope,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1_score
      FROM si JOIN rk ON si.configuration_id = rk.configuration_id AND si.b = rk.b
      LEFT JOIN cal ON cal.cfg = si.configuration_id AND cal.rb = si.b),
{_intervals_sql(['auroc', 'auprc', 'brier_score', 'calibration_intercept', 'calibration_slope', 'precision', 'recall', 'f1_score'])}"""
