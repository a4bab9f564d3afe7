"""Column expressions (all built-in Spark functions, no Python UDFs)."""

from horizonkit.functions.expressions import (
    MEDICATION_STATE_ALIASES,
    label_norm,
    lenient_double,
    lenient_timestamp,
    medication_state,
    metric_direction,
    row_fingerprint,
    whole_days,
)

__all__ = [
    "MEDICATION_STATE_ALIASES",
    "label_norm",
    "lenient_double",
    "lenient_timestamp",
    "medication_state",
    "metric_direction",
    "row_fingerprint",
    "whole_days",
]
