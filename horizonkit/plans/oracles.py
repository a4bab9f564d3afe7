"""DuckDB twins of the registered queries (the correctness gate).

Each string runs on DuckDB with the driver tables registered as views and
must return the same columns (names and values) as the Spark query of the
same key. Shared view text lives in the CTE builders below.
"""

from __future__ import annotations

from horizonkit.plans import tasks as T
from horizonkit.plans.grid import TaskSpec

ORACLES: dict[str, object] = {}


def oracle(name: str):
    """Register a SQL builder; the text is produced when ``oracle_sql()`` asks."""
    def deco(fn):
        ORACLES[name] = fn
        return fn

    return deco


LI_FEATURES = """li AS (
  SELECT l_orderkey AS ROW_ID, CAST(count(*) AS DOUBLE) AS N_LINES,
         sum(l_quantity) AS SUM_QTY, max(l_discount) AS MAX_DISC
  FROM lineitem GROUP BY l_orderkey)"""

VISITS = """visits AS (
  SELECT o.o_custkey AS PATNO,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'BL'
              ELSE concat('V', substr(o.o_orderpriority, 1, 1)) END AS EVENT_ID,
         o.o_orderdate AS VISIT_DATE, o.o_totalprice AS SCORE,
         c.c_mktsegment AS DIAGNOSTIC_GROUP,
         CASE o.o_orderstatus WHEN 'F' THEN 'off medication' WHEN 'O' THEN 'ON' ELSE '1' END
           AS MEDICATION_STATE,
         o.o_orderkey AS ROW_ID, c.c_acctbal AS ACCTBAL, li.N_LINES, li.SUM_QTY, li.MAX_DISC
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.ROW_ID = o.o_orderkey)"""

EVENT_VISITS = """visits AS (
  SELECT user_id AS PATNO,
         CASE WHEN event_type = 'signup' THEN 'BL' ELSE upper(event_type) END AS EVENT_ID,
         ts AS VISIT_DATE, value AS SCORE, event_id AS ROW_ID
  FROM events)"""

FEATS = ["ACCTBAL", "N_LINES", "SUM_QTY", "MAX_DISC"]


def days_expr(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS INTEGER)"


def baseline_cte(features: list[str], events: tuple[str, ...] = ("BL",)) -> str:
    ev = ", ".join(f"'{e}'" for e in events)
    fcols = "".join(f", {f}" for f in features)
    return f"""bl_all AS (
  SELECT PATNO, VISIT_DATE AS Baseline_Date, SCORE AS Baseline_Score{fcols},
         (VISIT_DATE IS NOT NULL AND SCORE IS NOT NULL) AS ok,
         row_number() OVER (PARTITION BY PATNO
                            ORDER BY (VISIT_DATE IS NOT NULL AND SCORE IS NOT NULL) DESC,
                                     VISIT_DATE, ROW_ID) AS rn
  FROM visits WHERE upper(trim(EVENT_ID)) IN ({ev}) AND PATNO IS NOT NULL),
bl AS (SELECT * FROM bl_all WHERE rn = 1 AND ok)"""


def candidates_cte(features: list[str], lo: int, hi: int) -> str:
    fcols = "".join(f", b.{f}" for f in features)
    return f"""cand AS (
  SELECT v.PATNO, upper(trim(v.EVENT_ID)) AS EVENT_ID, v.VISIT_DATE, v.SCORE, v.ROW_ID,
         b.Baseline_Date, b.Baseline_Score{fcols},
         {days_expr('v.VISIT_DATE', 'b.Baseline_Date')} AS Follow_Up_Days
  FROM visits v JOIN bl b ON v.PATNO = b.PATNO
  WHERE v.VISIT_DATE IS NOT NULL AND v.SCORE IS NOT NULL),
cw AS (SELECT * FROM cand WHERE Follow_Up_Days > 0 AND Follow_Up_Days BETWEEN {lo} AND {hi})"""


def nearest_sql(features: list[str], task: TaskSpec, extra_cte: str = VISITS) -> str:
    h, t = task.horizon_days, task.tolerance_days
    fcols = "".join(f", {f}" for f in features)
    return f"""WITH {LI_FEATURES}, {extra_cte},
{baseline_cte(features, task.baseline_event_ids)},
{candidates_cte(features, h - t, h + t)},
sel AS (
  SELECT *, row_number() OVER (PARTITION BY PATNO
            ORDER BY abs(Follow_Up_Days - {h}), VISIT_DATE, EVENT_ID NULLS LAST, ROW_ID) AS rk
  FROM cw)
SELECT PATNO, Baseline_Date, VISIT_DATE AS Target_Date, Follow_Up_Days, Baseline_Score{fcols},
       SCORE AS Target_Score, SCORE - Baseline_Score AS Delta_Score
FROM sel WHERE rk = 1"""


@oracle("jn3_nearest_pairing")
def _jn3() -> str:
    inner = nearest_sql([], T.flagship_task())
    return f"SELECT PATNO, Baseline_Score, Target_Score, Delta_Score FROM ({inner}) q"


@oracle("jn4_feature_pairing")
def _jn4() -> str:
    t = T.feature_task()
    inner = nearest_sql(FEATS, t)
    return f"""WITH {grid_values([t])}
SELECT q.*, grid.task_id, CAST({t.horizon_months} AS INTEGER) AS horizon_months,
       CAST({t.tolerance_days} AS INTEGER) AS tolerance_days,
       CAST(Delta_Score >= {float(t.progression_threshold)} AS INTEGER) AS progression_label
FROM ({inner}) q, grid"""


def task_json(medication: str = "'null'", colon: str = ":", comma: str = ",") -> str:
    """SQL text expression: a task's JSON from the columns of a grid CTE."""
    parts = {
        "baseline_event_ids": """'["BL"]'""",
        "endpoint": "to_json(endpoint)",
        "horizon_days": "CAST(horizon_days AS VARCHAR)",
        "horizon_months": "CAST(horizon_months AS VARCHAR)",
        "medication_state": medication,
        "name": "to_json(task_name)",
        "outcome_type": "to_json(outcome_type)",
        "progression_threshold": "coalesce(CAST(progression_threshold AS VARCHAR), 'null')",
        "target_column": """CASE outcome_type WHEN 'binary' THEN '"progression_label"' ELSE '"Delta_Score"' END""",
        "tolerance_days": "CAST(tolerance_days AS VARCHAR)",
    }
    fields = f" || '{comma}' || ".join(f"""'"{k}"{colon}' || {v}""" for k, v in parts.items())
    return "('{' || " + fields + " || '}')"


def grid_values(tasks: list[TaskSpec]) -> str:
    """Grid CTE; the ids are digests taken in SQL of the JSON text built there."""
    rows = []
    for i, t in enumerate(tasks):
        thr = "NULL" if t.progression_threshold is None else repr(float(t.progression_threshold))
        rows.append(
            f"({i}, '{t.name}', '{t.endpoint}', '{t.outcome_type}', {t.horizon_months}, {t.horizon_days}, "
            f"{t.tolerance_days}, CAST({thr} AS DOUBLE))"
        )
    return (
        "grid0(place, task_name, endpoint, outcome_type, horizon_months, horizon_days, tolerance_days, "
        "progression_threshold) AS (VALUES " + ", ".join(rows) + "), "
        f"grid AS (SELECT *, {task_json()} AS task, substr(sha256({task_json()}), 1, 16) AS task_id FROM grid0)"
    )


@oracle("jn5_multi_task_pairing")
def _jn5() -> str:
    tasks = T.grid_tasks()
    lo = min(t.horizon_days - t.tolerance_days for t in tasks)
    hi = max(t.horizon_days + t.tolerance_days for t in tasks)
    fcols = "".join(f", {f}" for f in FEATS)
    return f"""WITH {LI_FEATURES}, {VISITS}, {grid_values(tasks)},
{baseline_cte(FEATS)},
{candidates_cte(FEATS, lo, hi)},
j AS (SELECT c.*, g.task_id, g.outcome_type, g.horizon_months, g.horizon_days, g.tolerance_days,
             g.progression_threshold
      FROM cw c JOIN grid g
        ON c.Follow_Up_Days BETWEEN g.horizon_days - g.tolerance_days AND g.horizon_days + g.tolerance_days),
sel AS (SELECT *, row_number() OVER (PARTITION BY task_id, PATNO
             ORDER BY abs(Follow_Up_Days - horizon_days), VISIT_DATE, EVENT_ID NULLS LAST, ROW_ID) AS rk
        FROM j)
SELECT task_id, CAST(horizon_months AS INTEGER) AS horizon_months,
       CAST(tolerance_days AS INTEGER) AS tolerance_days, PATNO, Baseline_Date,
       VISIT_DATE AS Target_Date, Follow_Up_Days, Baseline_Score{fcols}, SCORE AS Target_Score,
       SCORE - Baseline_Score AS Delta_Score,
       CASE WHEN outcome_type = 'binary'
            THEN CAST((SCORE - Baseline_Score) >= progression_threshold AS INTEGER) END AS progression_label
FROM sel WHERE rk = 1"""


def _ledger_counts(tasks: list[TaskSpec]) -> str:
    lo = min(t.horizon_days - t.tolerance_days for t in tasks)
    hi = max(t.horizon_days + t.tolerance_days for t in tasks)
    return f"""WITH {LI_FEATURES}, {VISITS}, {grid_values(tasks)},
{baseline_cte([])},
{candidates_cte([], lo, hi)},
bpat AS (SELECT count(DISTINCT PATNO) AS b FROM visits WHERE upper(trim(EVENT_ID)) = 'BL' AND PATNO IS NOT NULL),
upat AS (SELECT count(*) AS u FROM bl),
kept AS (SELECT g.task_id, count(DISTINCT c.PATNO) AS r
         FROM grid g LEFT JOIN cw c
           ON c.Follow_Up_Days BETWEEN g.horizon_days - g.tolerance_days AND g.horizon_days + g.tolerance_days
         GROUP BY g.task_id)"""


@oracle("agg4_horizon_ledger")
def _agg4() -> str:
    t = T.flagship_task()
    return _ledger_counts([t]) + """
SELECT CAST(b AS BIGINT) AS baseline_patients, CAST(u AS BIGINT) AS usable_baseline_patients,
       CAST(r AS BIGINT) AS retained_patients, CAST(b - u AS BIGINT) AS excluded_invalid_baseline,
       CAST(u - r AS BIGINT) AS excluded_missing_follow_up
FROM bpat, upat, kept"""


@oracle("agg4_grid_ledger")
def _agg4_grid() -> str:
    tasks = T.grid_tasks()
    return _ledger_counts(tasks) + """,
g2 AS (SELECT g.task_id, g.horizon_days, g.tolerance_days, k.r FROM grid g JOIN kept k USING (task_id))
SELECT task_id, 1 AS stage_order, 'eligible_baseline_event' AS stage, CAST(b AS BIGINT) AS patients_retained,
       CAST(0 AS BIGINT) AS patients_excluded_at_stage, 'Eligible baseline event present' AS exclusion_reason,
       'fixed_horizon' AS flow_component FROM g2, bpat
UNION ALL
SELECT task_id, 2, 'usable_baseline', CAST(u AS BIGINT), CAST(b - u AS BIGINT),
       'Missing baseline score or date', 'fixed_horizon' FROM g2, bpat, upat
UNION ALL
SELECT task_id, 3, 'fixed_horizon_follow_up', CAST(r AS BIGINT), CAST(u - r AS BIGINT),
       'No eligible follow-up within ' || horizon_days || ' +/- ' || tolerance_days || ' days',
       'fixed_horizon' FROM g2, upat"""


@oracle("agg16_retained_cohort")
def _agg16() -> str:
    return _ledger_counts(T.grid_tasks()) + """
SELECT task_id, CAST(r AS BIGINT) AS retained_patients FROM kept"""


@oracle("win1_earliest_baseline")
def _win1() -> str:
    fcols = ", ".join(f"CASE WHEN ok THEN {f} END AS {f}" for f in FEATS)
    return f"""WITH {LI_FEATURES}, {VISITS}, {baseline_cte(FEATS)}
SELECT PATNO, ok AS usable, CASE WHEN ok THEN Baseline_Date END AS Baseline_Date,
       CASE WHEN ok THEN Baseline_Score END AS Baseline_Score, {fcols}
FROM bl_all WHERE rn = 1"""


@oracle("prj12_progression_label")
def _prj12() -> str:
    inner = nearest_sql([], T.flagship_task())
    return f"""SELECT PATNO, Baseline_Score, Target_Score, Delta_Score,
       CAST(Delta_Score >= {float(T.PROGRESSION_THRESHOLD)} AS INTEGER) AS progression_label
FROM ({inner}) q"""


@oracle("prj13_intraday_pairing")
def _prj13() -> str:
    # horizon 7 +/- 2 days is below the month grid, so it is written out here.
    return f"""WITH {EVENT_VISITS},
{baseline_cte([])},
{candidates_cte([], 5, 9)},
sel AS (SELECT *, row_number() OVER (PARTITION BY PATNO
             ORDER BY abs(Follow_Up_Days - 7), VISIT_DATE, EVENT_ID NULLS LAST, ROW_ID) AS rk FROM cw)
SELECT PATNO, Baseline_Date, VISIT_DATE AS Target_Date, Follow_Up_Days, Baseline_Score,
       SCORE AS Target_Score, SCORE - Baseline_Score AS Delta_Score
FROM sel WHERE rk = 1"""


@oracle("val18_endpoint_delta")
def _val18() -> str:
    return f"""WITH {LI_FEATURES}, {VISITS},
b AS (SELECT PATNO, VISIT_DATE AS baseline_date, SCORE AS SCORE_baseline, ACCTBAL AS ACCTBAL_baseline,
             SUM_QTY AS SUM_QTY_baseline,
             row_number() OVER (PARTITION BY PATNO ORDER BY VISIT_DATE NULLS LAST, EVENT_ID, ROW_ID) AS rn
      FROM visits WHERE EVENT_ID IN ('BL', 'V2') AND SCORE IS NOT NULL AND PATNO IS NOT NULL),
j AS (SELECT v.PATNO, v.EVENT_ID, v.VISIT_DATE, v.ROW_ID, v.SCORE, b.baseline_date, b.SCORE_baseline,
             b.ACCTBAL_baseline, b.SUM_QTY_baseline,
             {days_expr('v.VISIT_DATE', 'b.baseline_date')} AS time_from_baseline_days
      FROM visits v JOIN b ON v.PATNO = b.PATNO AND b.rn = 1
      WHERE v.SCORE IS NOT NULL AND v.VISIT_DATE IS NOT NULL)
SELECT *, SCORE - SCORE_baseline AS SCORE_delta FROM j WHERE time_from_baseline_days > 0"""


# ------------------------------------------------------ cohort and endpoint

GAP_VISITS = """gv AS (
  SELECT CASE WHEN ROW_ID % 23 = 0 THEN NULL ELSE PATNO END AS PATNO, EVENT_ID, VISIT_DATE,
         CASE WHEN ROW_ID % 17 = 0 THEN NULL ELSE SCORE END AS SCORE,
         CASE WHEN ROW_ID % 29 = 0 THEN ' ' || lower(DIAGNOSTIC_GROUP) || ' ' ELSE DIAGNOSTIC_GROUP END
           AS DIAGNOSTIC_GROUP,
         MEDICATION_STATE, ROW_ID, ACCTBAL, N_LINES, SUM_QTY, MAX_DISC
  FROM visits),
c AS (SELECT *, coalesce(upper(trim(DIAGNOSTIC_GROUP)) IN ('BUILDING', 'MACHINERY'), false) AS g,
             coalesce(upper(trim(EVENT_ID)) IN ('BL'), false) AS e FROM gv),
blp AS (SELECT DISTINCT PATNO FROM c WHERE PATNO IS NOT NULL AND g AND e),
cohort AS (SELECT PATNO, EVENT_ID, VISIT_DATE, SCORE, DIAGNOSTIC_GROUP, MEDICATION_STATE, ROW_ID,
                  ACCTBAL, N_LINES, SUM_QTY, MAX_DISC
           FROM c WHERE PATNO IS NOT NULL AND g AND PATNO IN (SELECT PATNO FROM blp))"""

MED_MAP = """CASE upper(trim(MEDICATION_STATE))
  WHEN 'ON' THEN 'ON' WHEN 'ON MEDICATION' THEN 'ON' WHEN 'ON_MEDICATION' THEN 'ON' WHEN '1' THEN 'ON'
  WHEN 'OFF' THEN 'OFF' WHEN 'OFF MEDICATION' THEN 'OFF' WHEN 'OFF_MEDICATION' THEN 'OFF' WHEN '0' THEN 'OFF' END"""

ENDPOINT = f"""es AS (SELECT *, (SCORE IS NOT NULL AND SCORE >= 1000.0 AND SCORE <= 400000.0) AS valid,
             {MED_MAP} AS st FROM cohort)"""


def _stage_select(component: str) -> str:
    return f"""SELECT CAST(stage_order AS INTEGER) AS stage_order, stage,
       CAST(r AS BIGINT) AS records_retained, CAST(p AS BIGINT) AS patients_retained,
       CAST(coalesce(lag(r) OVER (ORDER BY stage_order), r) - r AS BIGINT) AS records_excluded_at_stage,
       CAST(coalesce(lag(p) OVER (ORDER BY stage_order), p) - p AS BIGINT) AS patients_excluded_at_stage,
       exclusion_reason, '{component}' AS flow_component
FROM st"""


@oracle("agg2_cohort_ledger")
def _agg2() -> str:
    return f"""WITH {LI_FEATURES}, {VISITS}, {GAP_VISITS},
st AS (
  SELECT 1 AS stage_order, 'input' AS stage, count(*) AS r, count(DISTINCT PATNO) AS p,
         'All input records' AS exclusion_reason FROM c
  UNION ALL SELECT 2, 'valid_patient_identifier', count(*), count(DISTINCT PATNO),
         'Missing patient identifier' FROM c WHERE PATNO IS NOT NULL
  UNION ALL SELECT 3, 'eligible_diagnostic_group', count(*), count(DISTINCT PATNO),
         'Control or unrelated diagnostic group' FROM c WHERE PATNO IS NOT NULL AND g
  UNION ALL SELECT 4, 'baseline_eligible', count(*), count(DISTINCT PATNO),
         'No eligible baseline event' FROM cohort)
{_stage_select('cohort')}"""


@oracle("jn6_cohort_records")
def _jn6() -> str:
    return f"WITH {LI_FEATURES}, {VISITS}, {GAP_VISITS} SELECT * FROM cohort"


@oracle("agg3_endpoint_ledger")
def _agg3() -> str:
    return f"""WITH {LI_FEATURES}, {VISITS}, {GAP_VISITS}, {ENDPOINT},
st AS (
  SELECT 1 AS stage_order, 'endpoint_input' AS stage, count(*) AS r, count(DISTINCT PATNO) AS p,
         'All cohort-eligible records' AS exclusion_reason FROM es
  UNION ALL SELECT 2, 'valid_endpoint_score', count(*), count(DISTINCT PATNO),
         'Missing or out-of-range endpoint score' FROM es WHERE valid
  UNION ALL SELECT 3, 'medication_state_off', count(*), count(DISTINCT PATNO),
         'Endpoint requires OFF medication state' FROM es WHERE valid AND st = 'OFF')
{_stage_select('endpoint')}"""


@oracle("prj7_endpoint_records")
def _prj7() -> str:
    return f"""WITH {LI_FEATURES}, {VISITS}, {GAP_VISITS}, {ENDPOINT}
SELECT PATNO, EVENT_ID, VISIT_DATE, SCORE, DIAGNOSTIC_GROUP, st AS MEDICATION_STATE, ROW_ID,
       ACCTBAL, N_LINES, SUM_QTY, MAX_DISC
FROM es WHERE valid AND st = 'OFF'"""


@oracle("agg5_cohort_counts")
def _agg5() -> str:
    return _ledger_counts([T.flagship_task()]) + """,
vc AS (SELECT count(*) AS n, count(DISTINCT PATNO) AS np,
              count(DISTINCT CASE WHEN upper(trim(EVENT_ID)) = 'BL' THEN PATNO END) AS nb FROM visits)
SELECT CAST(n AS BIGINT) AS visit_records, CAST(np AS BIGINT) AS unique_patients,
       CAST(nb AS BIGINT) AS baseline_patients, CAST(u AS BIGINT) AS usable_baseline_patients,
       CAST(r AS BIGINT) AS retained_patients, CAST(nb - u AS BIGINT) AS excluded_invalid_baseline,
       CAST(u - r AS BIGINT) AS excluded_missing_follow_up
FROM vc, upat, kept"""


@oracle("prj1_harmonize")
def _prj1() -> str:
    return f"WITH {LI_FEATURES}, {VISITS} SELECT PATNO, EVENT_ID, SCORE, VISIT_DATE FROM visits"


@oracle("prj2_harmonize_features")
def _prj2() -> str:
    return f"""WITH {LI_FEATURES}, {VISITS}
SELECT PATNO, EVENT_ID, VISIT_DATE, DIAGNOSTIC_GROUP, SCORE, ACCTBAL AS moca, SUM_QTY, N_LINES,
       MAX_DISC, 'OFF' AS MEDICATION_STATE, ROW_ID
FROM visits"""


TEXT_EXPORT = """tx AS (
  SELECT CASE WHEN ROW_ID % 31 = 0 THEN 'unknown'
              WHEN ROW_ID % 37 = 0 THEN CAST(PATNO AS VARCHAR) || '.0'
              ELSE CAST(PATNO AS VARCHAR) END AS PATNO,
         CASE WHEN ROW_ID % 41 = 0 THEN NULL ELSE ' ' || EVENT_ID || ' ' END AS EVENT_ID,
         CASE WHEN ROW_ID % 43 = 0 THEN 'not a date'
              WHEN ROW_ID % 3 = 0 THEN strftime(VISIT_DATE, '%Y-%m-%d')
              WHEN ROW_ID % 3 = 1 THEN strftime(VISIT_DATE, '%m/%d/%Y')
              ELSE strftime(VISIT_DATE, '%b %-d, %Y') END AS visit_date,
         CASE WHEN ROW_ID % 19 = 0 THEN 'n/a' ELSE CAST(SCORE AS VARCHAR) END AS updrs3_score,
         CAST(ROW_ID AS VARCHAR) AS ROW_ID
  FROM visits)"""


@oracle("src2_contract_report")
def _src2() -> str:
    parts = []
    for name, dtype in (("PATNO", "DOUBLE"), ("EVENT_ID", "VARCHAR"), ("visit_date", "DATE"),
                        ("updrs3_score", "DOUBLE")):
        decl = {"DOUBLE": "double", "VARCHAR": "string", "DATE": "date"}[dtype]
        parsed = PARSED_DATE if name == "visit_date" else f"try_cast({name} AS {dtype})"
        parts.append(
            f"SELECT '{name}' AS column_name, '{decl}' AS declared_type, CAST(count(*) AS BIGINT) AS rows, "
            f"CAST(count(*) FILTER (WHERE {name} IS NULL) AS BIGINT) AS nulls, "
            f"CAST(count(*) FILTER (WHERE {name} IS NOT NULL AND {parsed} IS NULL) AS BIGINT) "
            f"AS failed_casts FROM tx"
        )
    return f"WITH {LI_FEATURES}, {VISITS}, {TEXT_EXPORT}\n" + "\nUNION ALL\n".join(parts)


PARSED_DATE = """coalesce(try_cast(trim(visit_date) AS TIMESTAMP),
                  try_strptime(trim(visit_date), '%m/%d/%Y'),
                  try_strptime(trim(visit_date), '%b %d, %Y'))"""


@oracle("src3_normalise_visits")
def _src3() -> str:
    return f"""WITH {LI_FEATURES}, {VISITS}, {TEXT_EXPORT},
p AS (SELECT try_cast(PATNO AS DOUBLE) AS PATNO, trim(EVENT_ID) AS EVENT_ID, {PARSED_DATE} AS visit_date,
             try_cast(updrs3_score AS DOUBLE) AS updrs3_score, ROW_ID FROM tx)
SELECT CAST(PATNO AS BIGINT) AS PATNO, EVENT_ID, visit_date, updrs3_score, ROW_ID
FROM p WHERE PATNO IS NOT NULL AND EVENT_ID IS NOT NULL AND visit_date IS NOT NULL"""


@oracle("src4_split_genetics")
def _src4() -> str:
    return f"""WITH {LI_FEATURES}, {VISITS}
SELECT PATNO, DIAGNOSTIC_GROUP, ACCTBAL, ROW_ID FROM (
  SELECT *, row_number() OVER (PARTITION BY PATNO ORDER BY ROW_ID) AS rn
  FROM visits WHERE PATNO IS NOT NULL) q WHERE rn = 1"""


@oracle("src4_split_tables")
def _src4_tables() -> str:
    keys = "PATNO, EVENT_ID, VISIT_DATE"
    return f"""WITH {LI_FEATURES}, {VISITS}
SELECT 'clinical' AS block, {keys}, SCORE, MEDICATION_STATE FROM visits
UNION ALL BY NAME SELECT 'biofluid' AS block, {keys}, SUM_QTY FROM visits
UNION ALL BY NAME SELECT 'imaging' AS block, {keys}, N_LINES, MAX_DISC FROM visits
UNION ALL BY NAME SELECT 'genetics' AS block, PATNO, DIAGNOSTIC_GROUP, ACCTBAL, ROW_ID FROM (
  SELECT *, row_number() OVER (PARTITION BY PATNO ORDER BY ROW_ID) AS rn
  FROM visits WHERE PATNO IS NOT NULL) q WHERE rn = 1"""


@oracle("snk3_table_fingerprint")
def _snk3() -> str:
    fields = [
        "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
        "CAST(CAST(o_totalprice AS DECIMAL(20,8)) AS VARCHAR)", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')",
        "o_orderpriority",
    ]
    text = " || ".join(f"coalesce(CAST(length({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields)
    return f"""WITH o AS (SELECT md5({text}) AS h FROM orders)
SELECT CAST(count(*) AS BIGINT) AS rows,
       CAST(bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR) AS xor_lane,
       CAST(sum(CAST(('0x' || substr(h, 25, 8))::BIGINT AS DECIMAL(38,0))) AS VARCHAR) AS sum_lane
FROM o"""


# --------------------------------------------------------------- folds (VAL)

OUTER, REPEATS, INNER, SEED = 5, 2, 3, 42


def _ds() -> str:
    return f"ds AS (SELECT PATNO AS patient_id, progression_label FROM ({_jn4()}) q)"


def md5_draw(seed_expr: str, id_expr: str) -> str:
    return (f"('0x' || substr(md5(CAST({seed_expr} AS VARCHAR) || ':' || CAST({id_expr} AS VARCHAR)), 1, 8))"
            "::BIGINT")


STRAT = f"""rep AS (SELECT d.patient_id, d.progression_label, CAST(t.r AS INTEGER) AS repeat
        FROM ds d, generate_series(1, {REPEATS}) AS t(r)),
hs AS (SELECT *, {md5_draw(f'{SEED} + repeat - 1', 'patient_id')} AS hh FROM rep),
sf AS (SELECT patient_id, progression_label, repeat,
              CAST((row_number() OVER (PARTITION BY repeat, progression_label ORDER BY hh, patient_id) - 1)
                   % {OUTER} + 1 AS INTEGER) AS fold FROM hs)"""


def _assign_sql() -> str:
    tid = T.feature_task().task_id
    return f"""WITH {_ds()}, {STRAT},
asg AS (SELECT '{tid}' AS configuration_id,
               '{tid}' || '-r' || CAST(repeat AS VARCHAR) || '-f' || CAST(o.f AS VARCHAR) AS fit_id,
               repeat, CAST(o.f AS INTEGER) AS outer_fold,
               CASE WHEN fold = o.f THEN 'test' ELSE 'train' END AS partition, patient_id
        FROM sf, generate_series(1, {OUTER}) AS o(f))"""


@oracle("val1_patient_folds")
def _val1() -> str:
    return f"""WITH {_ds()}
SELECT patient_id, CAST(1 AS INTEGER) AS repeat,
       CAST((row_number() OVER (ORDER BY patient_id) - 1) % {OUTER} + 1 AS INTEGER) AS fold FROM ds"""


@oracle("val2_repeated_folds")
def _val2() -> str:
    return f"""WITH {_ds()},
rep AS (SELECT d.patient_id, CAST(t.r AS INTEGER) AS repeat FROM ds d, generate_series(1, {REPEATS}) AS t(r)),
hs AS (SELECT *, {md5_draw(f'{SEED} + repeat - 1', 'patient_id')} AS hh FROM rep)
SELECT patient_id, repeat,
       CAST((row_number() OVER (PARTITION BY repeat ORDER BY hh, patient_id) - 1) % {OUTER} + 1 AS INTEGER) AS fold
FROM hs"""


@oracle("val3_stratified_folds")
def _val3() -> str:
    return f"WITH {_ds()}, {STRAT} SELECT * FROM sf"


@oracle("val4_shuffle_split")
def _val4() -> str:
    return f"""WITH {_ds()},
hs AS (SELECT patient_id, {md5_draw(SEED, 'patient_id')} AS hh FROM ds),
rk AS (SELECT patient_id, row_number() OVER (ORDER BY hh, patient_id) - 1 AS pos, count(*) OVER () AS n FROM hs)
SELECT patient_id, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS partition FROM rk"""


@oracle("val5_inner_folds")
def _val5() -> str:
    return f"""WITH {_ds()}, {STRAT},
tr AS (SELECT sf.patient_id, sf.progression_label, sf.repeat, CAST(o.f AS INTEGER) AS outer_fold
       FROM sf, generate_series(1, {OUTER}) AS o(f) WHERE sf.fold <> o.f),
hi AS (SELECT *, {md5_draw(f'{SEED + 10000} + repeat - 1 + outer_fold', 'patient_id')} AS hh FROM tr)
SELECT patient_id, progression_label, repeat, outer_fold,
       CAST((row_number() OVER (PARTITION BY repeat, outer_fold, progression_label ORDER BY hh, patient_id) - 1)
            % {INNER} + 1 AS INTEGER) AS inner_fold
FROM hi"""


@oracle("val6_fold_assignments")
def _val6() -> str:
    return _assign_sql() + "\nSELECT * FROM asg"


@oracle("jn8_overlap_report")
def _jn8() -> str:
    return _assign_sql() + """
SELECT fit_id, patient_id FROM asg GROUP BY fit_id, patient_id
HAVING count(*) FILTER (WHERE partition = 'train') > 0 AND count(*) FILTER (WHERE partition = 'test') > 0"""


@oracle("agg17_fold_audit")
def _agg17() -> str:
    return _assign_sql() + """,
per AS (SELECT fit_id, repeat, outer_fold, patient_id, bool_or(partition = 'train') AS tr,
               bool_or(partition = 'test') AS te FROM asg GROUP BY ALL)
SELECT fit_id, repeat, outer_fold, CAST(count(*) FILTER (WHERE tr) AS BIGINT) AS train_patients,
       CAST(count(*) FILTER (WHERE te) AS BIGINT) AS test_patients,
       CAST(count(*) FILTER (WHERE tr AND te) AS BIGINT) AS overlapping_patients
FROM per GROUP BY ALL"""


@oracle("agg7_class_feasibility")
def _agg7() -> str:
    return f"""WITH {_ds()},
c AS (SELECT progression_label, count(DISTINCT patient_id) AS patients FROM ds GROUP BY 1)
SELECT progression_label, CAST(patients AS BIGINT) AS patients,
       CAST(ceil(patients / {float(OUTER)}) AS BIGINT) AS largest_test_fold,
       (patients >= {OUTER} AND patients - ceil(patients / {float(OUTER)}) >= {INNER}) AS feasible
FROM c"""


# ------------------------------------------------------------ metrics (AGG)

PRED = """pred AS (
  SELECT l_suppkey AS group_id, l_orderkey AS patient_id, l_linenumber AS line_id,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
         round(l_discount * 10, 1) AS y_probability,
         CASE WHEN round(l_discount * 10, 1) >= 0.5 THEN 1 ELSE 0 END AS y_pred,
         l_extendedprice AS y_value, l_quantity * 1500.0 AS y_estimate
  FROM lineitem)"""


def cum_sql(src: str, group: str, score: str) -> str:
    return f"""sc AS (SELECT {group}, {score} AS s, CAST(sum(y_true) AS DOUBLE) AS pos,
              CAST(sum(1 - y_true) AS DOUBLE) AS neg FROM {src} GROUP BY {group}, {score}),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY {group} ORDER BY s DESC
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (PARTITION BY {group} ORDER BY s DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
               sum(pos) OVER (PARTITION BY {group}) AS n_pos,
               sum(neg) OVER (PARTITION BY {group}) AS n_neg FROM sc)"""


@oracle("agg9_regression_metrics")
def _agg9() -> str:
    r = "(y_value - y_estimate)"
    return f"""WITH {PRED}
SELECT group_id, CAST(count(*) AS BIGINT) AS n, avg(abs({r})) AS mae, sqrt(avg({r} * {r})) AS rmse,
       CASE WHEN var_pop(y_value) * count(*) > 0 THEN 1 - sum({r} * {r}) / (var_pop(y_value) * count(*))
            WHEN sum({r} * {r}) = 0 THEN 1.0 ELSE 0.0 END AS r2,
       avg({r}) AS residual_mean, stddev_samp({r}) AS residual_standard_deviation
FROM pred GROUP BY group_id"""


#: Newton steps of a calibration fit, and the largest last step of one at rest.
CALIBRATION_STEPS, CALIBRATION_REST = 24, 1e-6


def calibration_cte(counts: str, keys: str, score: str) -> str:
    """CTEs up to ``cal(keys, calibration_intercept, calibration_slope)`` over ``counts(keys, score, pos, neg)``."""
    clipped = f"least(greatest(CAST({score} AS DOUBLE), 1e-6), 1 - 1e-6)"
    parts = [f"""cx AS MATERIALIZED (SELECT {keys}, ln({clipped} / (1 - {clipped})) AS x, pos, pos + neg AS w FROM {counts}),
n0 AS (SELECT {keys}, sum(pos) > 0 AND sum(pos) < sum(w) AND min(x) < max(x) AS fits,
              CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS step FROM cx GROUP BY {keys})"""]
    s = "(1 / (1 + exp(-(a + b * x))))"
    for k in range(CALIBRATION_STEPS):
        parts.append(f"""s{k} AS (SELECT {keys}, any_value(fits) AS fits, any_value(a) AS a, any_value(b) AS b,
  sum(w * {s} - pos) AS g0, sum((w * {s} - pos) * x) + any_value(b) / 1e6 AS g1, sum(w * {s} * (1 - {s})) AS h0,
  sum(w * {s} * (1 - {s}) * x) AS h1, sum(w * {s} * (1 - {s}) * x * x) + 1 / 1e6 AS h2
  FROM cx JOIN n{k} USING ({keys}) GROUP BY {keys}),
d{k} AS (SELECT *, fits AND h0 * h2 - h1 * h1 > 0 AS f, (h2 * g0 - h1 * g1) / nullif(h0 * h2 - h1 * h1, 0) AS da,
                (h0 * g1 - h1 * g0) / nullif(h0 * h2 - h1 * h1, 0) AS db FROM s{k}),
n{k + 1} AS MATERIALIZED (SELECT {keys}, f AS fits, CASE WHEN f THEN a - da END AS a, CASE WHEN f THEN b - db END AS b,
                CASE WHEN f THEN greatest(abs(da), abs(db)) END AS step FROM d{k})""")
    parts.append(f"""cal AS (SELECT {keys}, CASE WHEN fits AND step < {CALIBRATION_REST} THEN a END AS calibration_intercept,
  CASE WHEN fits AND step < {CALIBRATION_REST} THEN b END AS calibration_slope FROM n{CALIBRATION_STEPS})""")
    return ",\n".join(parts)


CLASS_COUNTS = """cc AS (SELECT group_id, y_probability, CAST(count(*) FILTER (WHERE y_true = 1) AS DOUBLE) AS pos,
              CAST(count(*) FILTER (WHERE y_true <> 1) AS DOUBLE) AS neg FROM pred GROUP BY ALL)"""


@oracle("agg11_calibration")
def _agg11() -> str:
    return f"WITH {PRED}, {CLASS_COUNTS}, {calibration_cte('cc', 'group_id', 'y_probability')}\nSELECT * FROM cal"


@oracle("agg10_classification_metrics")
def _agg10() -> str:
    return f"""WITH {PRED}, {cum_sql('pred', 'group_id', 'y_probability')}, {CLASS_COUNTS},
{calibration_cte('cc', 'group_id', 'y_probability')},
rk AS (SELECT group_id,
              CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
                   THEN sum(pos * ((n_neg - fp) + 0.5 * neg)) / (max(n_pos) * max(n_neg)) END AS auroc,
              CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
                   THEN sum(pos * tp / (tp + fp)) / max(n_pos) END AS auprc
       FROM cum GROUP BY group_id),
si AS (SELECT group_id, count(*) AS n,
              avg((y_probability - y_true) * (y_probability - y_true)) AS brier_score,
              count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
              count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
              count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn
       FROM pred GROUP BY group_id)
SELECT si.group_id, CAST(n AS BIGINT) AS n, auroc, auprc, brier_score, calibration_intercept, calibration_slope,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1_score
FROM si JOIN rk USING (group_id) LEFT JOIN cal USING (group_id)"""


@oracle("win5_roc_points")
def _win5() -> str:
    return f"""WITH {PRED}, {cum_sql('pred', 'group_id', 'y_probability')}
SELECT group_id, s AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       tp / n_pos AS tpr, fp / n_neg AS fpr, tp / (tp + fp) AS precision
FROM cum"""


def _threshold_sql(method: str) -> str:
    if method == "youden":
        score = "tp / n_pos - fp / n_neg"
    else:
        score = ("CASE WHEN 2 * tp + fp + (n_pos - tp) > 0 THEN 2 * tp / (2 * tp + fp + (n_pos - tp)) "
                 "ELSE 0.0 END")
    return f"""WITH {PRED},
cand AS (SELECT group_id, y_probability, y_true FROM pred
         UNION ALL SELECT g.group_id, x.t, NULL FROM (SELECT DISTINCT group_id FROM pred) g,
                          (VALUES (0.01), (0.99)) AS x(t)),
sc AS (SELECT group_id, y_probability AS s, CAST(coalesce(sum(y_true), 0) AS DOUBLE) AS pos,
              CAST(count(*) FILTER (WHERE y_true = 0) AS DOUBLE) AS neg FROM cand GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY group_id ORDER BY s DESC
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (PARTITION BY group_id ORDER BY s DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
               sum(pos) OVER (PARTITION BY group_id) AS n_pos,
               sum(neg) OVER (PARTITION BY group_id) AS n_neg FROM sc),
scored AS (SELECT group_id, s AS threshold, {score} AS score FROM cum),
best AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, threshold) AS rk
         FROM scored WHERE score IS NOT NULL AND NOT isnan(score))
SELECT group_id, threshold, score FROM best WHERE rk = 1"""


@oracle("val13_threshold_youden")
def _val13y() -> str:
    return _threshold_sql("youden")


@oracle("val13_threshold_f1")
def _val13f() -> str:
    return _threshold_sql("f1")


@oracle("agg20_residual_histogram")
def _agg20() -> str:
    return f"""WITH {PRED}, r AS (SELECT y_value - y_estimate AS residual FROM pred),
st AS (SELECT min(residual) AS lo, max(residual) AS hi FROM r),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0
                  ELSE least(floor((residual - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin, lo, hi
      FROM r, st WHERE residual IS NOT NULL)
SELECT bin, any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30) AS bin_start,
       any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 30) AS bin_end,
       CAST(count(*) AS BIGINT) AS count
FROM b GROUP BY bin"""
