"""Row-level expressions shared by the operators.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen and is pushed through the optimizer like any
other projection.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values --------------------------------------------------------
# Medication-state aliases (normalised label -> canonical state). Labels are
# compared after trim + upper case; anything else maps to null.
MEDICATION_STATE_ALIASES: dict[str, str] = {
    "ON": "ON",
    "ON MEDICATION": "ON",
    "ON_MEDICATION": "ON",
    "1": "ON",
    "OFF": "OFF",
    "OFF MEDICATION": "OFF",
    "OFF_MEDICATION": "OFF",
    "0": "OFF",
}
# Metrics where a smaller value is better; every other metric is larger-better.
LOWER_IS_BETTER_METRICS: tuple[str, ...] = ("mae", "rmse", "brier_score")
# Date layouts accepted by the lenient parser after the ISO forms.
LENIENT_DATE_PATTERNS: tuple[str, ...] = (
    "MM/dd/yyyy",
    "yyyy/MM/dd",
    "MMM d, yyyy",
    "d MMM yyyy",
    "MM/dd/yyyy HH:mm",
)
# -------------------------------------------------------------------------

MICROS_PER_DAY = 86_400_000_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Numeric coercion where anything unparseable becomes null.

    ANSI mode makes a plain ``cast`` raise, so ``try_cast`` is used; NaN is
    folded into null because "not present" is a single state here.
    """
    col = _col(c)
    if dtype is not None and isinstance(dtype, T.NumericType):
        casted = col.cast("double")
    else:
        casted = col.try_cast("double")
    return F.nanvl(casted, F.lit(None).cast("double"))


def strip(c: Column) -> Column:
    """Text without white space at either end: tabs and line breaks too, not spaces alone."""
    return F.trim(c.cast("string"), F.lit(" \t\n\r\f\x0b"))


def lenient_timestamp(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Mixed-format timestamp parse; unparseable text becomes null.

    Timestamps pass through (as ``TIMESTAMP_NTZ``); dates are widened.
    Strings are tried as ISO first, then the fixed layouts above.
    """
    col = _col(c)
    if isinstance(dtype, (T.TimestampNTZType,)):
        return col
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return col.cast("timestamp_ntz")
    text = strip(col)
    parsed = [text.try_cast("timestamp_ntz")]
    for pattern in LENIENT_DATE_PATTERNS:
        parsed.append(F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))
    return F.coalesce(*parsed)


def label_norm(c: str | Column, upper: bool = True) -> Column:
    """Strip (and upper-case) a label, comparing labels as strings."""
    text = strip(_col(c))
    return F.upper(text) if upper else text


def medication_state(c: str | Column) -> Column:
    """Map a raw medication label to ``ON`` / ``OFF`` (null when unknown)."""
    pairs: list[Column] = []
    for alias, state in MEDICATION_STATE_ALIASES.items():
        pairs.extend([F.lit(alias), F.lit(state)])
    return F.element_at(F.create_map(*pairs), label_norm(c)) if pairs else F.lit(None)


def whole_days(later: str | Column, earlier: str | Column) -> Column:
    """Elapsed whole days, floor of the duration (not calendar-day difference).

    ``datediff`` counts calendar boundaries (23:00 -> 01:00 is one day); here a
    duration under 24 h is zero days, and negative durations round down.
    """
    return F.floor(_wall_micros_between(_col(earlier), _col(later)) / F.lit(MICROS_PER_DAY)).cast("int")


def _micros_of_day(ts: Column) -> Column:
    seconds = F.extract(F.lit("SECOND"), ts)  # decimal seconds with microseconds
    return (F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
            + (seconds * 1_000_000).cast("long"))


def _wall_micros_between(earlier: Column, later: Column) -> Column:
    """Wall-clock microseconds between two ``TIMESTAMP_NTZ`` values.

    Calendar days (``datediff`` of the dates) plus the time-of-day
    difference: no session time zone is involved, so a DST change in the
    session zone cannot shift a duration by an hour (``timestamp_diff``
    casts NTZ values through the session zone).
    """
    days = F.datediff(F.to_date(later), F.to_date(earlier)).cast("long")
    return days * MICROS_PER_DAY + _micros_of_day(later) - _micros_of_day(earlier)


def row_fingerprint(columns: Iterable[str], length: int | None = None) -> Column:
    """SHA-256 of the canonical JSON of the named fields (keys sorted).

    Null fields are kept (``"x":null``) so that the text is total.
    """
    names = sorted(columns)
    doc = F.to_json(
        F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"}
    )
    digest = F.sha2(doc, 256)
    return F.substring(digest, 1, length) if length else digest


def metric_direction(c: str | Column) -> Column:
    """``lower_is_better`` for error metrics, ``higher_is_better`` otherwise."""
    return F.when(
        _col(c).isin(*LOWER_IS_BETTER_METRICS), F.lit("lower_is_better")
    ).otherwise(F.lit("higher_is_better"))


def hash_bigint(*parts: str | Column, hex_digits: int = 8) -> Column:
    """Deterministic non-negative integer draw from ``md5`` of the parts.

    ``conv(substr(md5(a:b:...),1,8),16,10)`` is reproducible in other SQL
    engines, so folds and bootstrap draws can be checked outside Spark.
    """
    text = F.concat_ws(":", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("bigint")
