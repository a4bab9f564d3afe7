"""DuckDB twins: the columns of nested runs that do not depend on a solver."""

from __future__ import annotations

from horizonkit.plans.oracles import SEED, md5_draw, oracle
from horizonkit.plans.oracles_prep import _gds

OUTER, REPEATS = 5, 5


@oracle("val17_oof_keys")
def _val17_keys() -> str:
    return f"""WITH {_gds()},
rep AS (SELECT d.patient_id, d.progression_label, CAST(t.r AS INTEGER) AS repeat
        FROM ds d, generate_series(1, {REPEATS}) AS t(r)),
hs AS (SELECT *, {md5_draw(f'{SEED} + repeat - 1', 'patient_id')} AS hh FROM rep),
sf AS (SELECT patient_id, progression_label, repeat,
              CAST((row_number() OVER (PARTITION BY repeat, progression_label ORDER BY hh, patient_id) - 1)
                   % {OUTER} + 1 AS INTEGER) AS outer_fold FROM hs)
SELECT 'binary_enet' AS configuration_id,
       'binary_enet-r' || CAST(repeat AS VARCHAR) || '-f' || CAST(outer_fold AS VARCHAR) AS fit_id,
       repeat, outer_fold, patient_id, CAST(progression_label AS DOUBLE) AS y_true,
       CAST(count(*) OVER (PARTITION BY repeat) - count(*) OVER (PARTITION BY repeat, outer_fold) AS BIGINT)
         AS train_patients,
       CAST(count(*) OVER (PARTITION BY repeat, outer_fold) AS BIGINT) AS test_patients
FROM sf"""
