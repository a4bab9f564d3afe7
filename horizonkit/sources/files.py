"""File sources, the schema contract gate and visit normalisation (SRC1-SRC4).

* SRC1 reads by suffix through ``spark.read`` (CSV always as text, typed
  afterwards), so the scan is distributed and pruned like any other.
* SRC2 is two things: an analysis-time check of the header (no data read)
  and a contract *report* computed by one aggregate over the real table.
* SRC3 coerces with ``try_cast`` and fixed date layouts; no Python per row.
* SRC4 splits a wide table; the per-subject table keeps the first row by
  ``ROW_ID`` via ``min_by`` (partial aggregation, skew-safe).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horizonkit.errors import DataFileNotFoundError, require_columns
from horizonkit.functions.expressions import label_norm, lenient_double, lenient_timestamp

# --- fixed values --------------------------------------------------------
# Required columns of a visit export.
EXPORT_REQUIRED_COLUMNS = ("PATNO", "EVENT_ID", "visit_date", "moca", "updrs3_score")
# Optional numeric columns coerced by the normaliser when present.
EXPORT_NUMERIC_COLUMNS = ("moca", "updrs3_score", "age", "SEX", "EDUCYRS", "duration", "upsit")
# -------------------------------------------------------------------------

SUFFIX_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def read_source(spark: SparkSession, path: str, case_sensitive: bool = False) -> DataFrame:
    """SRC1: read a table chosen by suffix; CSV columns stay text.

    ``case_sensitive`` tells CSV headers apart that differ only by case (a
    visit export may carry ``moca`` and ``MOCA``): the spelling of the export
    contract keeps its name, else the first; the others get their place as a
    suffix (``MOCA_2``). The session's own setting is left as it was.
    """
    lower = path.lower().rstrip("/")
    fmt = next((f for s, f in SUFFIX_FORMATS.items() if lower.endswith(s)), None)
    if fmt is None:
        raise ValueError("Input must be a .csv, .parquet or .json path.")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    before = spark.conf.get("spark.sql.caseSensitive")
    try:
        if fmt == "csv" and case_sensitive:  # only while the header line is read
            spark.conf.set("spark.sql.caseSensitive", "true")
            names = reader.load(path).columns
            spark.conf.set("spark.sql.caseSensitive", before)
            # an explicit schema is applied by place
            reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in _distinct_names(names)]))
        df = reader.load(path)
        df.schema  # resolve now: a missing path fails here, not in a later job
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise DataFileNotFoundError(f"Input file was not found: {path}") from exc
        raise
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
    return df


def _distinct_names(names: Sequence[str]) -> list[str]:
    """Header names of which no two differ only by case."""
    declared = {*EXPORT_REQUIRED_COLUMNS, *EXPORT_NUMERIC_COLUMNS}
    owner: dict[str, int] = {}
    for place in sorted(range(len(names)), key=lambda i: (names[i] not in declared, i)):
        owner.setdefault(names[place].lower(), place)
    return [n if owner[n.lower()] == i else f"{n}_{i}" for i, n in enumerate(names)]


def validate_schema(df: DataFrame, required: Iterable[str] = EXPORT_REQUIRED_COLUMNS) -> DataFrame:
    """SRC2 gate: sorted missing columns in the error; reads no rows."""
    require_columns(df.columns, required, "The table does not meet its contract")
    return df


def contract_report(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """SRC2 report: per declared column, rows / nulls / failed casts.

    One aggregate over the table; ``failed_casts`` counts present values that
    the normaliser (SRC3) would not keep either: numbers and dates are read by
    the same lenient parsers, other types by ``try_cast``.
    """
    validate_schema(df, contract)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def parsed(name: str, dtype: str):
        if dtype in ("double", "float"):
            return lenient_double(name, kinds[name])
        if dtype in ("date", "timestamp", "timestamp_ntz"):
            return lenient_timestamp(name, kinds[name])
        return F.col(name).try_cast(dtype)

    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (name, dtype) in enumerate(contract.items()):
        c = F.col(name)
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        aggs.append(F.count_if(c.isNotNull() & parsed(name, dtype).isNull()).alias(f"f{i}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("declared_type"),
            F.col("rows").cast("bigint").alias("rows"),
            F.col(f"n{i}").cast("bigint").alias("nulls"),
            F.col(f"f{i}").cast("bigint").alias("failed_casts"),
        )
        for i, (name, dtype) in enumerate(contract.items())
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def normalise_visits(df: DataFrame) -> DataFrame:
    """SRC3: numeric id, trimmed event, parsed date, numeric optionals.

    Rows without id, event or date are dropped; the id becomes BIGINT. No
    ordering is imposed here (sort at the sink when a file needs it).
    """
    require_columns(df.columns, {"PATNO", "EVENT_ID", "visit_date"}, "Cannot normalise data")
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = {
        "PATNO": lenient_double("PATNO", types["PATNO"]),
        "EVENT_ID": label_norm("EVENT_ID", upper=False),
        "visit_date": lenient_timestamp("visit_date", types["visit_date"]),
    }
    for name in EXPORT_NUMERIC_COLUMNS:
        if name in df.columns:
            cols[name] = lenient_double(name, types[name])
    clean = df.withColumns(cols).dropna(subset=["PATNO", "EVENT_ID", "visit_date"])
    return clean.withColumn("PATNO", F.col("PATNO").cast("bigint"))


def split_wide_table(
    df: DataFrame,
    blocks: Mapping[str, Sequence[str]],
    per_subject: Sequence[str] = ("genetics",),
    keys: Sequence[str] = ("PATNO", "EVENT_ID", "VISIT_DATE"),
    order_col: str = "ROW_ID",
) -> dict[str, DataFrame]:
    """SRC4: one narrow table per block; per-subject blocks keep the first row."""
    out: dict[str, DataFrame] = {}
    for name, columns in blocks.items():
        require_columns(df.columns, {*keys, *columns}, f"Cannot split block {name}")
        if name in per_subject:
            payload = F.struct(*[F.col(c) for c in columns])
            out[name] = (
                df.filter(F.col(keys[0]).isNotNull())
                .groupBy(keys[0])
                .agg(F.min_by(payload, F.col(order_col)).alias("p"))
                .select(keys[0], "p.*")
            )
        else:
            out[name] = df.select(*keys, *columns)
    return out
