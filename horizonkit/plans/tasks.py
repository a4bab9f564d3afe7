"""Task sets used by the registered queries over the driver tables."""

from __future__ import annotations

from horizonkit.plans.grid import TaskSpec

PROGRESSION_THRESHOLD = 0.0


def flagship_task() -> TaskSpec:
    """12-month continuous task with +/- 90 days (the minimum slice)."""
    return TaskSpec("demo_score_12m_continuous", "score", "continuous", 12, 90)


def feature_task() -> TaskSpec:
    """24-month binary task used by the feature-variant query."""
    return TaskSpec(
        "demo_score_24m_binary", "score", "binary", 24, 90,
        progression_threshold=PROGRESSION_THRESHOLD,
    )


def grid_tasks() -> list[TaskSpec]:
    """12 tasks: horizons 12/24/36 x tolerance 30/90 x both outcome types."""
    tasks = []
    for months in (12, 24, 36):
        for tol in (30, 90):
            for outcome in ("continuous", "binary"):
                tasks.append(
                    TaskSpec(
                        f"demo_score_{months}m_{outcome}", "score", outcome, months, tol,
                        progression_threshold=PROGRESSION_THRESHOLD if outcome == "binary" else None,
                    )
                )
    return tasks


# Grid expanded by the registered grid query (per study and endpoint).
GRID_CONFIG = {
    "cohort": {"baseline_event_ids": ["BL"]},
    "task_grid": {"horizons_months": [12, 24, 36], "tolerance_days": [60, 90],
                  "outcome_types": ["continuous", "binary"], "progression_threshold": 5.0,
                  "feature_sets": [["baseline_motor"], ["demographics_disease_history", "baseline_motor"]]},
    "validation": {"imputation_strategies": ["median", "most_frequent"], "split_strategy": "patient_isolated"},
    "models": {"elasticnet": {"binary_parameter_grid": {"C": [0.1, 1.0]},
                              "continuous_parameter_grid": {"alpha": [0.1]}},
               "random_forest": {"parameter_grid": {"max_depth": [None, 5]}}},
}
