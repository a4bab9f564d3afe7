"""Connected components as Spark joins (large-star / small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root = smallest reachable.

    Each round re-hangs larger neighbours, then smaller ones, on the smallest
    neighbour, until the edge set is a star per component. A round's edge table
    is written to the shared folder; only its count and checksum reach the
    driver. Nulls and loops are ignored; an empty input gives an empty result.
    """
    current = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _checksum(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("lo"))
        lowest = lowest.select("u", F.least("u", "lo").alias("lo"))
        large = (
            both.join(lowest, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("lo").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = (
            large.join(lowest, "u").where("v <> lo")
            .select(F.col("v").alias("u"), F.col("lo").alias("v"))
            .unionByName(lowest.select("u", F.col("lo").alias("v")))
            .distinct()
        )
        current = materialise(small, "edges")
        before, mark = mark, _checksum(current)
        if before == mark:
            break
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        .unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    )


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    ).first()
    return int(row[0]), int(row[1])
