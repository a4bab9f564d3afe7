"""Subject-isolated folds and their audits (VAL1-VAL6, JN8, AGG7, AGG17, WIN9).

Folds are a function of the subject id and a seed only:

    h(seed, id) = first 32 bits of md5("seed:id")
    position    = rank of (h, id) inside the stratum  (0-based, exact)
    fold        = position % k + 1

so every subject lands in exactly one test fold per repeat, fold sizes differ
by at most one (per class when stratified), and any SQL engine with ``md5``
reproduces the assignment.

The exact rank is computed without a single-partition window
(``dense_index``): rows are range-bucketed by the top bits of ``h``, bucket
counts (one row per non-empty stratum x bucket) are prefix-summed and joined
back, and the final ``row_number`` runs inside each (stratum, bucket) -
about n / buckets rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonkit.errors import PatientLeakageError
from horizonkit.functions.expressions import hash_bigint
from horizonkit.operators.quantiles import running_totals

HASH_BITS = 32
DEFAULT_BUCKET_BITS = 12  # 4096 buckets per stratum


def subject_hash(seed: int | Column, id_col: str) -> Column:
    """32-bit draw from md5('seed:id')."""
    seed_col = seed if isinstance(seed, Column) else F.lit(int(seed))
    return hash_bigint(seed_col, F.col(id_col))


def dense_index(
    df: DataFrame,
    hash_col: str,
    tie_col: str,
    strata: Sequence[str] = (),
    bucket_bits: int = DEFAULT_BUCKET_BITS,
) -> DataFrame:
    """Add ``_pos`` (0-based rank by (hash, tie) within strata) and ``_n``.

    ``hash_col`` must be uniform in [0, 2^32) so that buckets are balanced.
    The offsets table has one row per non-empty (stratum, bucket).
    """
    shift = HASH_BITS - bucket_bits
    b = df.withColumn("_bucket", F.shiftright(F.col(hash_col), shift))
    keys = [*strata, "_bucket"]
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*strata).orderBy("_bucket") if strata else Window.orderBy("_bucket")
    wt = Window.partitionBy(*strata) if strata else Window.partitionBy()
    offsets = counts.select(
        *keys,
        (F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cnt"))
        .alias("_offset"),
        F.sum("_cnt").over(wt).alias("_n"),
    )
    inner = Window.partitionBy(*keys).orderBy(hash_col, tie_col)
    ranked = b.withColumn("_rn", F.row_number().over(inner) - 1)
    # No explicit broadcast: offsets grow with strata x buckets. ``ranked`` is
    # already hash-partitioned by (strata, bucket) from its window, so only
    # the small offsets side moves (or AQE broadcasts it if measured small).
    return (
        ranked.join(offsets, keys, "inner")
        .withColumn("_pos", F.col("_offset") + F.col("_rn"))
        .drop("_bucket", "_rn", "_offset")
    )


def _subjects(dataset: DataFrame, id_col: str, label_col: str | None, group_cols: Sequence[str] = ()) -> DataFrame:
    cols = [*group_cols, id_col] + ([label_col] if label_col else [])
    return dataset.select(*cols).dropDuplicates([*group_cols, id_col])


def patient_folds(
    dataset: DataFrame,
    n_splits: int = 5,
    repeats: int = 1,
    seed: int = 42,
    id_col: str = "patient_id",
    stratify_col: str | None = None,
    shuffle: bool = True,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """VAL1/VAL2/VAL3: one row per (repeat, subject) with its test ``fold``.

    Repeat r uses seed + r - 1. ``shuffle=False`` ranks by the id itself
    (deterministic, unshuffled folds). ``group_cols`` (e.g. a configuration
    id) makes independent fold sets per group in the same pass.
    """
    if isinstance(n_splits, bool) or not isinstance(n_splits, int) or n_splits < 2:
        raise ValueError("n_splits must be an integer greater than one.")
    subjects = _subjects(dataset, id_col, stratify_col, group_cols)
    rep = subjects.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(int(repeats)))))
    strata = [*group_cols, "repeat"] + ([stratify_col] if stratify_col else [])
    if shuffle:
        rep = rep.withColumn("_h", subject_hash(F.lit(int(seed)) + F.col("repeat") - 1, id_col))
        idx = dense_index(rep, "_h", id_col, strata)
    else:
        # rank by id: bounds come from the ids' own quantiles, so an outlier id
        # does not gather the others in one bucket
        idx = running_totals(rep.withColumn("_one", F.lit(1)), strata, id_col, ["_one"]).withColumn(
            "_pos", F.col("_upto__one") - 1)
    return idx.select(
        *(c for c in subjects.columns),
        "repeat",
        (F.col("_pos") % n_splits + 1).cast("int").alias("fold"),
    )


def inner_folds(
    folds: DataFrame,
    n_outer: int,
    n_inner: int,
    seed: int = 42,
    id_col: str = "patient_id",
    stratify_col: str | None = None,
    seed_offset: int = 10_000,
) -> DataFrame:
    """VAL5: inner folds inside each outer training part.

    For outer fold f of repeat r the inner split uses seed + r - 1 +
    seed_offset + f over the subjects whose outer fold is not f.
    """
    outer = folds.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(int(n_outer)))))
    train = outer.filter(F.col("fold") != F.col("outer_fold")).drop("fold")
    seed_col = F.lit(int(seed) + int(seed_offset)) + F.col("repeat") - 1 + F.col("outer_fold")
    train = train.withColumn("_h", subject_hash(seed_col, id_col))
    strata = ["repeat", "outer_fold"] + ([stratify_col] if stratify_col else [])
    idx = dense_index(train, "_h", id_col, strata)
    return idx.select(
        *(c for c in folds.columns if c != "fold"),
        "outer_fold",
        (F.col("_pos") % n_inner + 1).cast("int").alias("inner_fold"),
    )


def fit_id(configuration_id: str | Column, repeat: str = "repeat", fold: str = "outer_fold") -> Column:
    """WIN9: ``<config>-r<repeat>-f<fold>``."""
    cfg = F.lit(configuration_id) if isinstance(configuration_id, str) else configuration_id
    return F.concat(cfg, F.lit("-r"), F.col(repeat).cast("string"), F.lit("-f"), F.col(fold).cast("string"))


def fold_assignments(
    folds: DataFrame, n_splits: int, configuration_id: str | Column = "cfg", id_col: str = "patient_id"
) -> DataFrame:
    """VAL6: every subject x outer fold, marked train or test (no join).

    Rows = subjects x repeats x k, generated by ``explode(sequence(1, k))``.
    """
    out = folds.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(int(n_splits)))))
    cfg = F.lit(configuration_id) if isinstance(configuration_id, str) else configuration_id
    return out.select(
        cfg.alias("configuration_id"),
        fit_id(cfg).alias("fit_id"),
        F.col("repeat").cast("int").alias("repeat"),
        F.col("outer_fold").cast("int").alias("outer_fold"),
        F.when(F.col("fold") == F.col("outer_fold"), F.lit("test")).otherwise(F.lit("train")).alias("partition"),
        F.col(id_col).alias("patient_id"),
    )


def grouped_shuffle_split(
    dataset: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "patient_id"
) -> DataFrame:
    """VAL4: ceil(test_size * n) subjects in test, chosen by hash rank."""
    subjects = _subjects(dataset, id_col, None).withColumn("_h", subject_hash(seed, id_col))
    idx = dense_index(subjects, "_h", id_col)
    n_test = F.ceil(F.col("_n") * F.lit(float(test_size)))
    return idx.select(
        id_col,
        F.when(F.col("_pos") < n_test, F.lit("test")).otherwise(F.lit("train")).alias("partition"),
    )


def overlap_report(assignments: DataFrame) -> DataFrame:
    """JN8: (fit_id, patient_id) present on both sides; empty when isolated."""
    return (
        assignments.groupBy("fit_id", "patient_id")
        .agg(
            F.count_if(F.col("partition") == "train").alias("n_train"),
            F.count_if(F.col("partition") == "test").alias("n_test"),
        )
        .filter((F.col("n_train") > 0) & (F.col("n_test") > 0))
        .select("fit_id", "patient_id")
    )


def verify_no_overlap(assignments: DataFrame) -> None:
    """JN8 guard: raise with the number of leaking subjects and the smallest one.

    ``overlap_report`` has the whole list as a table.
    """
    leaks = overlap_report(assignments).agg(
        F.countDistinct("patient_id").alias("n"), F.min("patient_id").alias("first")
    ).first()
    if leaks["n"]:
        raise PatientLeakageError(
            "Patient leakage detected between training and evaluation: "
            f"{leaks['n']} subjects, the smallest is [{leaks['first']}]; overlap_report lists them."
        )


def fold_audit(assignments: DataFrame) -> DataFrame:
    """AGG17: per fit, distinct train / test / overlapping subjects.

    Pre-aggregated per (fit, subject) first, so the final counts are sums.
    """
    per = assignments.groupBy("fit_id", "repeat", "outer_fold", "patient_id").agg(
        F.max(F.col("partition") == "train").alias("tr"),
        F.max(F.col("partition") == "test").alias("te"),
    )
    return per.groupBy("fit_id", "repeat", "outer_fold").agg(
        F.count_if("tr").cast("bigint").alias("train_patients"),
        F.count_if("te").cast("bigint").alias("test_patients"),
        F.count_if(F.col("tr") & F.col("te")).cast("bigint").alias("overlapping_patients"),
    )


def class_feasibility(
    dataset: DataFrame, target: str, outer_splits: int, inner_splits: int, id_col: str = "patient_id"
) -> DataFrame:
    """AGG7: distinct subjects per class and whether nested folds are feasible."""
    per = dataset.select(target, id_col).dropDuplicates([target, id_col])
    counts = per.groupBy(target).agg(F.count(F.lit(1)).cast("bigint").alias("patients"))
    largest_test = F.ceil(F.col("patients") / F.lit(float(outer_splits)))
    return counts.select(
        target,
        "patients",
        largest_test.cast("bigint").alias("largest_test_fold"),
        ((F.col("patients") >= outer_splits) & (F.col("patients") - largest_test >= inner_splits)).alias("feasible"),
    )
