"""Error classes raised by guards (driver-side checks and lazy ``raise_error``)."""


class HorizonKitError(Exception):
    """Base class of all library errors."""


class ConfigurationError(HorizonKitError, ValueError):
    """A configuration or task contract is internally inconsistent."""


class MissingColumnError(HorizonKitError, KeyError):
    """A required column is absent from a table."""

    def __str__(self) -> str:  # KeyError quotes its message otherwise
        return str(self.args[0]) if self.args else ""


class DataFileNotFoundError(HorizonKitError, FileNotFoundError):
    """An input path does not exist."""


class CohortDefinitionError(HorizonKitError, ValueError):
    """The cohort contract is empty or leaves no subject."""


class PhenotypeDefinitionError(HorizonKitError, ValueError):
    """The endpoint contract is invalid or leaves no record."""


class PatientLeakageError(HorizonKitError, ValueError):
    """A subject appears on both sides of a train/test split."""


class AuditFailure(HorizonKitError, AssertionError):
    """A persisted artifact failed an integrity assertion."""


def require_columns(df_columns, required, context: str) -> None:
    """Raise ``MissingColumnError`` listing the sorted missing columns.

    This is an analysis-time check: it reads the schema only, never the data.
    """
    missing = sorted(set(required).difference(df_columns))
    if missing:
        raise MissingColumnError(f"{context}; missing columns: " + ", ".join(missing))
