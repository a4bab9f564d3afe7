"""The experiment-grid workflow as one lazily composed Spark plan (VAL20/VAL21).

harmonised visits -> multi-task pairing (JN5, one pass for all tasks)
  -> per-configuration subject folds (VAL2, one pass, strata = configuration)
  -> fold assignments (VAL6) -> out-of-fold rows
  -> fold-local feature records (VAL15 data part) -> stability (AGG13/AGG15)
  -> subject bootstrap CIs per configuration (AGG12)
  -> ledger retained counts (AGG16) -> master summary (JN7/PRJ17/PRJ18)

Nothing loops over configurations on the driver: every step carries
``configuration_id`` as a column. Model fitting (``plans.nested``) plugs in
where ``predictions`` are produced; the default predictor here is the
no-change reference (target = baseline score), which needs no fit and keeps
the whole chain checkable in SQL.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.operators import bootstrap as B
from horizonkit.operators import folds as FO
from horizonkit.operators import horizon
from horizonkit.operators import stability as S
from horizonkit.operators import summary as SM
from horizonkit.operators.harmonize import resolve_feature_columns
from horizonkit.plans.grid import FEATURE_BLOCKS, TaskSpec, canonical_json
from horizonkit.session import checkpoint_dir

MANIFEST_COLUMNS = ("configuration_id", "task", "feature_blocks", "imputation_strategy",
                    "model_family", "model_parameters")


@dataclass
class ExperimentTables:
    pairs: DataFrame
    ledger: DataFrame
    folds: DataFrame
    assignments: DataFrame
    oof: DataFrame
    records: DataFrame
    stability: DataFrame
    ci: DataFrame
    manifest: DataFrame
    summary: DataFrame


def grid_manifest(spark: SparkSession, tasks: list[TaskSpec], blocks: list[str]) -> DataFrame:
    """What this run does, one row per task: the blocks whose columns it reads and
    the no-change predictor, which imputes nothing and has no parameters."""
    rows = [(t.task_id, canonical_json(t.to_dict()), json.dumps(blocks), "none", "no_change", "{}")
            for t in tasks]
    return spark.createDataFrame(rows, list(MANIFEST_COLUMNS))


def run_grid_experiment(
    visits: DataFrame,
    tasks: list[TaskSpec],
    feature_blocks: Mapping[str, Sequence[str]],
    outer_splits: int = 5,
    outer_repeats: int = 2,
    n_resamples: int = 50,
    seed: int = 42,
    experiment_name: str = "grid",
) -> ExperimentTables:
    spark = visits.sparkSession
    blocks = [b for b in FEATURE_BLOCKS if feature_blocks.get(b)]
    features = resolve_feature_columns(feature_blocks, blocks)
    checkpoint_dir(spark)  # shared folder from the session conf
    pairs, ledger = horizon.multi_task_result(visits, tasks, features)
    # The paired table and the folds feed four branches (folds, OOF rows,
    # feature records, ledger); reliable checkpoints in the shared folder cut
    # the lineage once instead of recomputing the pairing per branch.
    pairs = pairs.checkpoint()
    ds = pairs.withColumnRenamed("task_id", "configuration_id").withColumnRenamed("PATNO", "patient_id")
    folds = FO.patient_folds(ds, outer_splits, outer_repeats, seed, group_cols=["configuration_id"]).checkpoint()
    assignments = FO.fold_assignments(folds, outer_splits, F.col("configuration_id"))
    oof = (
        # assignments come from explode(K): keep them out of broadcast sizing
        assignments.filter(F.col("partition") == "test").hint("merge")
        .join(ds.select("configuration_id", "patient_id",
                        F.col("Target_Score").alias("y_true"), F.col("Baseline_Score").alias("y_pred")),
              ["configuration_id", "patient_id"], "inner")
        .select("configuration_id", "fit_id", "repeat", "outer_fold", "patient_id", "y_true", "y_pred",
                (F.col("y_true") - F.col("y_pred")).alias("residual"))
    )
    records = S.univariate_feature_records(
        ds, folds, ["Baseline_Score", *features], "Delta_Score", outer_splits, None,
        configuration_col="configuration_id",
    )
    stability = S.stability_summary(S.feature_stability(records))
    ci = B.bootstrap_regression(oof, ["configuration_id"], "patient_id", "y_true", "y_pred",
                                n_resamples, 0.95, seed)
    manifest = grid_manifest(spark, tasks, blocks)
    cohort = SM.retained_cohort(ledger.withColumnRenamed("task_id", "configuration_id"))
    summary = SM.experiment_summary(
        ci, manifest, stability, cohort, experiment_name,
        {"split_strategy": "patient_isolated", "outer_splits": outer_splits,
         "outer_repeats": outer_repeats, "inner_splits": 0},
        experiment_config_sha(tasks, features, seed, outer_splits, outer_repeats, n_resamples),
        "testdata", seed,
    )
    return ExperimentTables(pairs, ledger, folds, assignments, oof, records, stability, ci, manifest, summary)


def experiment_config_sha(tasks: list[TaskSpec], features: list[str], seed: int, outer_splits: int,
                          outer_repeats: int, n_resamples: int) -> str:
    """SHA-256 of the canonical JSON of the experiment settings."""
    config = {"tasks": [t.to_dict() for t in tasks], "features": features, "seed": seed,
              "outer_splits": outer_splits, "outer_repeats": outer_repeats, "n_resamples": n_resamples}
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()
