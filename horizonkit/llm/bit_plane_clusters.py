"""Centroid clustering with exact integer distances by bit-plane popcounts.

A vector of 64 components becomes integers, and each bit plane of them (bit k
of all components, in two's complement) one unsigned 64-bit word. With plane
weights ``w`` (powers of two, the sign plane's negative), the dot product of
two vectors is the sum of ``w[i] * w[j] * popcount(x[i] & c[j])``: exact, with
no multiplication per component. Rounds read the packed table; each task sends
one row of counts and sums per centroid, so a round moves centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.common import materialise

COMPONENTS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: With more planes a squared distance would not fit a long.
MOST_PLANES = 28
BLOCK = 4096


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, q)`` of the vectors kept: exactly 64 components, none null or non-finite; ``q`` is floor(1024 x)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where((F.size(x) == COMPONENTS) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("q"))


def plane_weights(planes: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """``(n, planes)`` words of ``(n, 64)`` integers; component c is bit c of each word."""
    bits = [np.packbits(((values >> k) & 1).astype(np.uint8), axis=1, bitorder="little") for k in range(planes)]
    return np.stack(bits, 1).view("<u8")[:, :, 0] if len(values) else np.zeros((0, planes), "<u8")


def from_planes(words: np.ndarray) -> np.ndarray:
    """The bits ``(n, planes, 64)`` of packed vectors."""
    as_bytes = np.ascontiguousarray(words).view(np.uint8).reshape(*words.shape, 8)
    return np.unpackbits(as_bytes, axis=2, bitorder="little")


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products ``(n, k)`` of packed vectors with packed centroids."""
    weights = plane_weights(x.shape[1])
    total = np.zeros((len(x), len(c)), np.int64)
    for i, weight in enumerate(weights):
        shared = np.bitwise_count(x[:, i, None, None] & c[None])  # (n, k, planes)
        total += weight * (shared @ weights)
    return total


def norms(x: np.ndarray) -> np.ndarray:
    """Exact squared lengths of packed vectors."""
    weights = plane_weights(x.shape[1])
    total = np.zeros(len(x), np.int64)
    for i, weight in enumerate(weights):
        total += weight * (np.bitwise_count(x[:, i, None] & x) @ weights)
    return total


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of ties) and the squared distance."""
    distances = norms(x)[:, None] - 2 * dots(x, centroids) + norms(centroids)[None]
    best = distances.argmin(1)
    return best, distances[np.arange(len(x)), best]


def _words(column: pa.Array, planes: int) -> Iterator[np.ndarray]:
    """Blocks of packed vectors of a binary column."""
    packed = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, planes)
    for start in range(0, len(packed), BLOCK):
        yield packed[start : start + BLOCK]


def pack(kept: DataFrame, planes: int) -> DataFrame:
    """``(vec_id, planes)``, the planes of a vector as little-endian words."""

    def compute(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, COMPONENTS)
            words = to_planes(values, planes).astype("<u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w.tobytes() for w in words], pa.binary())], names=["vec_id", "planes"]
            )

    return kept.mapInArrow(compute, "vec_id long, planes binary")


def cluster_sums(packed: DataFrame, centroids: np.ndarray, planes: int) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty centroid its vectors' count and component sums: one row per task and centroid is moved."""
    words = to_planes(centroids, planes)

    def compute(batches):
        counts = np.zeros(len(words), np.int64)
        sums = np.zeros((len(words), COMPONENTS), np.int64)
        weights = plane_weights(planes)
        for batch in batches:
            for x in _words(batch.column(0), planes):
                best, _ = nearest(x, words)
                bits = from_planes(x)
                for k in np.unique(best).tolist():
                    members = best == k
                    counts[k] += members.sum()
                    sums[k] += weights @ bits[members].sum(0, dtype=np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = packed.select("planes").mapInArrow(compute, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(COMPONENTS)]).alias("sums")
    )
    return {r["cluster"]: (r["n"], r["sums"]) for r in totals.collect()}


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``; of one id's rows the smaller components first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    top = kept.where("vec_id is not null").select(order.alias("h"), "q").orderBy("h", "q").limit(clusters)
    return np.array([r["q"] for r in top.collect()], np.int64).reshape(-1, COMPONENTS)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per vector kept.

    Other vectors (see ``scaled``) have no row, and a table without any kept
    one gives none. With fewer than ``clusters`` vectors there are fewer
    centroids. Repeated rows and rows of one id count each; a row with a null
    id is clustered, but starts no centroid (its id has no hash). Extra columns
    are ignored. Raises where components are so large that a squared distance
    would not fit a long. ``clusters`` is a setting: centroids and their sums
    are all that the driver sees.
    """
    spark = vectors.sparkSession
    kept = materialise(scaled(vectors, id_col, vector_col), "scaled")
    ends = kept.agg(F.max(F.array_max("q")).alias("high"), F.min(F.array_min("q")).alias("low")).first()
    centroids = first_centroids(kept, clusters, seed)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], columns)
    planes = 1 + max(int(ends["high"]).bit_length(), (-int(ends["low"]) - 1).bit_length(), 1)
    if planes > MOST_PLANES:
        raise ValueError(f"components need {planes} bits; squared distances fit a long up to {MOST_PLANES}")
    packed = materialise(pack(kept, planes), "planes")
    for _ in range(rounds):
        for k, (n, sums) in cluster_sums(packed, centroids, planes).items():
            centroids[k] = [s // n for s in sums]
    words = to_planes(centroids, planes)

    def assign(batches):
        for batch in batches:
            found = [nearest(x, words) for x in _words(batch.column(1), planes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([f[0] for f in found] or [[]]).astype(np.int32)),
                 pa.array(np.concatenate([f[1] for f in found] or [[]]).astype(np.int64))],
                names=["vec_id", "cluster", "distance"],
            )

    assigned = materialise(packed.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame(
        [(k, d, sum(inertia.values()), digests[k]) for k, d in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # one row per centroid, so the copy each task gets is of fixed size
    return assigned.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
