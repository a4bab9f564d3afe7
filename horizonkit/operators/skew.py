"""Hot-key splitting for joins whose other side has one row per key.

AQE's skew-join rule only splits joins whose children are plain shuffle
stages; the per-subject joins here (visits x baseline, visits semi-join
eligible subjects) have an aggregate on the small side, so a subject with a
third of all visits would be one straggler task. ``split_hot_keys``:

1. counts rows per key (partial aggregation) and keeps keys holding more
   than an average partition's share (``total / partitions``). Fewer than
   ``partitions`` keys can qualify, so the list that comes back to the driver
   is bounded by its rule, at every size of the table;
2. gives each row of a hot key a salt in ``[0, s_key)`` from a hash of the
   row (``s_key`` = the key's rows / average share, rounded up), other rows get
   salt 0;
3. replicates only the hot keys' rows of the small side ``s_key`` times.

The join on (key, salt) then spreads a hot key over ``s_key`` tasks; per-key
aggregations after it still aggregate partially before their exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.session import checkpoint_dir


def hot_keys(df: DataFrame, key: str, partitions: int | None = None) -> dict:
    """{key value: salts} for keys above the average partition share.

    The per-key counts (one row per key, partial aggregation) are written
    once to the checkpoint folder, then read by the small check jobs.
    """
    checkpoint_dir(df.sparkSession)
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c")).checkpoint()
    return hot_from_counts(counts, key, "_c", partitions)


def hot_from_counts(per_key: DataFrame, key: str, count_col: str, partitions: int | None = None) -> dict:
    """Hot keys from an existing one-row-per-key count table.

    Keys above ``total / partitions`` rows number fewer than ``partitions``,
    and so do a key's salts: the list that returns is bounded by its rule. Rows
    without a key meet nothing in a join, so they are neither hot nor counted.
    """
    per_key = per_key.filter(F.col(key).isNotNull())
    p = max(partitions or int(per_key.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    total = per_key.agg(F.sum(count_col)).first()[0] or 0
    share = max(total / p, 1.0)
    hot = per_key.filter(F.col(count_col) > F.lit(share)).select(key, count_col).collect()
    return {r[0]: math.ceil(r[1] / share) for r in hot}


def _salt_map(hot: dict):
    pairs = []
    for k, s in hot.items():
        pairs.extend([F.lit(k), F.lit(s)])
    return F.create_map(*pairs)


def salt_big_side(df: DataFrame, key: str, hot: dict, row_cols: Sequence[str]) -> DataFrame:
    """Salt column for the many-rows side (hash of the row's own columns)."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    n = F.coalesce(F.element_at(_salt_map(hot), F.col(key)), F.lit(1))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in row_cols]), n).cast("int"))


def salt_small_side(df: DataFrame, key: str, hot: dict) -> DataFrame:
    """Replicate the one-row-per-key side once per salt of a hot key."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    n = F.coalesce(F.element_at(_salt_map(hot), F.col(key)), F.lit(1))
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))


def split_hot_keys(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    row_cols: Sequence[str] | None = None,
) -> DataFrame:
    """``big.join(small, key, how)`` with hot keys of ``big`` spread out."""
    hot = hot_keys(big, key)
    if not hot:
        return big.join(small, key, how)
    b = salt_big_side(big, key, hot, row_cols or big.columns)
    s = salt_small_side(small, key, hot)
    return b.join(s, [key, "_salt"], how).drop("_salt")
