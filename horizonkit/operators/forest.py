"""Regression forest grown tree by tree over the cells of binned features (VAL19).

A split of a binned forest sees a row only through its bins, so a tree needs
no rows: per distinct combination of bins (a cell) the number of draws and the
sum of their targets say all. Rows gather once by cell, every tree's draws are
summed there, and each tree then grows in a task of its own from its cells.
With 32 bins a tree has at most 32 to the power of the features' number of
cells, and never more than there are rows. Cells to be predicted go along with
no weight and leave with their leaf's mean, so no model is ever gathered,
broadcast or kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.operators.quantiles import running_totals
from horizonkit.session import staged_rows

#: Bins of a feature, as many as ``pyspark.ml`` makes by default.
BINS = 32
#: Rows whose draws one task makes.
ROWS_PER_TASK = 32_768
#: Nodes whose split tables are held at once.
NODES_AT_ONCE = 32_768
_ZERO = ord("0")


def split_points(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Per feature at most ``bins - 1`` ascending thresholds, from the exact counts of all its values.

    Midpoints between all neighbouring values where these are few; else, as in
    ``pyspark.ml`` (which samples), the neighbours between which the running count comes
    nearest to the next multiple of n / bins, one threshold a step.
    """
    counts = rows.select(*features).unpivot([], list(features), "feature", "value").groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("c")).withColumn("one", F.lit(1))
    ranked = staged_rows(running_totals(counts, ["feature"], "value", ["c", "one"], n_buckets=BINS), "splits")
    rank, middle = F.col("_upto_one"), F.col("_upto_c") - F.col("c") / 2
    passed = [F.min(F.when((rank > 1) & (middle > F.col("_total_c") * k / bins), rank)) for k in range(1, bins)]
    wanted: dict[str, list[int]] = {}
    for r in ranked.groupBy("feature").agg(F.max("_total_one").alias("n"), F.array(*passed).alias("passed")).collect():
        if r["n"] <= bins:
            wanted[r["feature"]] = list(range(2, r["n"] + 1))
            continue
        steps = wanted.setdefault(r["feature"], [])
        for first in r["passed"]:
            at = max(first, steps[-1] + 1) if first and steps else first
            if not at or at > r["n"]:
                break
            steps.append(at)
    near = F.lit(False)
    for name, steps in wanted.items():
        near = near | ((F.col("feature") == name) & rank.isin(sorted({k - d for k in steps for d in (0, 1)})))
    value = {(r["feature"], r["_upto_one"]): r["value"] for r in ranked.filter(near).collect()}  # two per threshold
    points = {f: [(value[f, k - 1] + value[f, k]) / 2 for k in wanted.get(f, [])] for f in features}
    return {f: sorted({p for p in found if p < np.inf}) for f, found in points.items()}


def with_cells(rows: DataFrame, points: dict[str, list[float]]) -> DataFrame:
    """Adds ``_cell``: a character per feature, its number of thresholds below the value."""
    binned = [f"_bin{i}" for i in range(len(points))]
    # a bucket holds its lower bound, a bin its upper one
    edges = [[-np.inf, *np.nextafter(p or [0.0], np.inf).tolist(), np.inf] for p in points.values()]
    out = Bucketizer(splitsArray=edges, inputCols=list(points), outputCols=binned).transform(rows)
    return out.withColumn("_cell", F.concat(*[F.char(F.col(b).cast("long") + _ZERO) for b in binned])).drop(*binned)


def bagged_cells(cells: DataFrame, n_rows: int, n_trees: int, seed: int, bootstrap: bool = True) -> DataFrame:
    """``(tree, cell, n, total, asked)`` from ``(_cell, _train, _y)``: draws of each tree in each cell, their targets' sum.

    Training rows are drawn Poisson(1) times; other rows have no weight and make their cell ``asked`` in every tree.
    A cell comes in several rows where it crosses Arrow batches.
    """

    def draw(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).dictionary_encode()
            code = cell.indices.to_numpy()
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            train = batch.column(1).to_numpy(zero_copy_only=False)
            y = np.where(train, batch.column(2).to_numpy(zero_copy_only=False), 0.0)
            draws = rng.poisson(1.0, (len(y), n_trees)) if bootstrap else np.ones((len(y), n_trees), np.int64)
            draws = draws * train[:, None].astype(float)
            n, total = np.add.reduceat(draws, starts), np.add.reduceat(draws * y[:, None], starts)
            asked = np.logical_or.reduceat(~train, starts)
            at, tree = np.nonzero((n > 0) | asked[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int32()), cell.dictionary.take(pa.array(code[starts][at])), pa.array(n[at, tree]),
                 pa.array(total[at, tree]), pa.array(asked[at])], names=["tree", "cell", "n", "total", "asked"])

    tasks = max(1, -(-n_rows // ROWS_PER_TASK))
    gathered = cells.select("_cell", "_train", "_y").repartition(tasks, "_cell").sortWithinPartitions("_cell", "_train", "_y")
    return gathered.mapInArrow(draw, "tree int, cell string, n double, total double, asked boolean")


def best_splits(node: np.ndarray, k: int, bins: np.ndarray, n: np.ndarray, total: np.ndarray,
                min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and last bin of the left side that lower each node's squared error most.

    ``node`` ascends and has the numbers 0 to ``k - 1``.
    """
    feature, at = np.full(k, -1), np.zeros(k, np.int64)
    for lo in range(0, k, NODES_AT_ONCE):
        hi = min(k, lo + NODES_AT_ONCE)
        rows = slice(*np.searchsorted(node, [lo, hi]))
        own, size = node[rows] - lo, hi - lo
        here = np.arange(size)
        least = None
        for f in range(bins.shape[1]):
            key = own * BINS + bins[rows, f]
            table = lambda v: np.bincount(key, v[rows], size * BINS).reshape(size, BINS).cumsum(1)  # noqa: B023, E731
            left, left_total = table(n), table(total)
            whole, whole_total = left[:, -1:], left_total[:, -1:]
            if least is None:
                least = whole_total[:, 0] ** 2 / np.maximum(whole[:, 0], 1)
                best = least + 1e-12 * np.abs(least)
            left, left_total = left[:, :-1], left_total[:, :-1]
            right = whole - left
            held = left_total**2 / np.maximum(left, 1) + (whole_total - left_total) ** 2 / np.maximum(right, 1)
            held[(left < min_leaf) | (right < min_leaf)] = -np.inf
            first = held.argmax(1)
            better = held[here, first] > best
            best = np.where(better, held[here, first], best)
            feature[lo:hi][better], at[lo:hi][better] = f, first[better]
    return feature, at


def grow(bins: np.ndarray, n: np.ndarray, total: np.ndarray, min_leaf: int) -> np.ndarray:
    """Leaf mean of every cell: nodes split level by level while a side of ``min_leaf`` draws lowers the error."""
    mean = np.zeros(len(n))
    centre = total.sum() / max(1.0, n.sum())
    total = total - n * centre  # squares of sums lose less
    order, node, k = np.arange(len(n)), np.zeros(len(n), np.int64), 1  # cells by node
    while len(order):
        own_bins, own_n, own_total = bins[order], n[order], total[order]
        feature, at = best_splits(node, k, own_bins, own_n, own_total, min_leaf)
        weight, sums = np.bincount(node, own_n, k), np.bincount(node, own_total, k)
        done = feature[node] < 0
        mean[order[done]] = (sums / np.maximum(weight, 1))[node[done]] + centre
        order, node, own_bins = order[~done], node[~done], own_bins[~done]
        side = own_bins[np.arange(len(node)), feature[node]] > at[node]
        child = 2 * node + side
        by_child = np.argsort(child, kind="stable")
        order, child = order[by_child], child[by_child]
        node = np.cumsum(np.diff(child, prepend=child[:1]) > 0)
        k = int(node[-1]) + 1 if len(node) else 0
    return mean


def forest_predictions(rows: DataFrame, features: Sequence[str], target: str, train: str, n_trees: int = 100,
                       min_leaf: int = 2, seed: int = 42, bootstrap: bool = True) -> DataFrame:
    """``rows`` that are not training rows (boolean ``train``) with the forest's mean ``prediction``.

    ``features`` hold no null or NaN. All features are candidates at every split and depth has no limit.
    """
    y = F.col(target).cast("double")
    guarded = F.when(F.col(train) & (y.isNull() | F.isnan(y)), F.raise_error(F.lit("Targets must not be null or NaN.")))
    kept = rows.withColumns({"_train": F.col(train), "_y": F.coalesce(guarded.cast("double"), y)})
    points = split_points(kept.filter("_train"), features)
    celled = staged_rows(with_cells(kept, points), "cells")
    bags = bagged_cells(celled, celled.count(), n_trees, seed, bootstrap)
    width = len(features)

    def tree(table: pa.Table) -> pa.Table:
        cells, asked = table["cell"].combine_chunks(), table["asked"].to_numpy()
        bins = np.frombuffer("".join(cells.to_pylist()).encode(), np.uint8).reshape(-1, width) - np.uint8(_ZERO)
        mean = grow(bins, table["n"].to_numpy(), table["total"].to_numpy(), min_leaf)
        return pa.table({"_cell": cells.filter(pa.array(asked)), "prediction": pa.array(mean[asked])})

    found = bags.repartition(n_trees, "tree").groupBy("tree").applyInArrow(tree, "_cell string, prediction double")
    means = found.groupBy("_cell").agg(F.avg("prediction").alias("prediction"))
    return celled.filter("not _train").join(means, "_cell").drop("_cell", "_train", "_y")
