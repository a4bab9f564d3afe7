"""Session construction and cluster-facing settings.

The settings below are the ones the operators rely on:

* AQE on, with skew-join splitting even when the split needs an extra
  shuffle afterwards (``forceOptimizeSkewedJoin``). That rule only applies
  to joins whose children are plain shuffle stages; the per-subject joins
  (visits x baseline, cohort semi-join) have an aggregate on one side, so
  they salt hot subjects explicitly (``operators.skew``).
* Broadcasts: Spark's size check (file-size based estimates, 10 MB default)
  is kept for scan-derived sides, where it over-estimates. A side produced
  by ``explode`` is sized by its *input* and can be B times larger than
  estimated (it once chose to broadcast the N x B bootstrap draws), so every
  join with an exploded side carries an explicit ``shuffle_hash`` / ``merge``
  hint. The library's own ``broadcast()`` hints are on one table of model numbers
  in ``plans.nested``, whose size the run's settings give, and on the large
  groups of a calibration (``operators.metrics``), fewer than rows / 50,000.
* Session time zone pinned to UTC (day arithmetic is done on
  ``TIMESTAMP_NTZ`` micros anyway, so this only affects display).
* The Spark UI is off: no server is started by the library.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructType

DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "horizonkit",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is only read.
    Only a local-mode session without the setting (tests, laptop runs) gets a
    fresh private folder under the system temp directory.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a shared folder on a cluster session."
        )
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    folder = tempfile.mkdtemp(prefix="horizonkit-ckpt-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged_rows(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the checkpoint folder and read back.

    For tables that several branches of a plan read: their sources and joins
    run once, and each branch prunes columns and pushes its filters into the
    files. Columns of the void type have no Parquet form and are added again.
    """
    spark = df.sparkSession
    kept = [f for f in df.schema.fields if not isinstance(f.dataType, NullType)]
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{label}-{uuid.uuid4().hex}"
    df.select(*[F.col(f"`{f.name}`") for f in kept]).write.parquet(path)
    back = spark.read.schema(StructType(kept)).parquet(path)
    return back.select(*[
        F.lit(None).alias(f.name) if isinstance(f.dataType, NullType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
