"""horizonkit: longitudinal cohort analytics written as Spark DataFrame/SQL jobs.

Long subject-visit tables become one-row-per-subject datasets (earliest
usable baseline paired with the closest follow-up inside a fixed window),
with attrition ledgers, subject-isolated folds, exact ranking / calibration /
error metrics, subject-level bootstrap intervals, feature-stability summaries
and integrity audits. Every operator is a function ``DataFrame -> DataFrame``.
"""

from horizonkit.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
