"""Sources and sinks: driver tables, file readers, schema gates, artifacts."""

from horizonkit.sources.tables import (
    DRIVER_TABLES,
    VISIT_FEATURES,
    event_visit_table,
    lineitem_predictions,
    order_line_features,
    read_table,
    visit_table,
)

__all__ = [
    "DRIVER_TABLES",
    "VISIT_FEATURES",
    "event_visit_table",
    "lineitem_predictions",
    "order_line_features",
    "read_table",
    "visit_table",
]
