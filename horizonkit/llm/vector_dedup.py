"""Embedding near-dedup with a robust-pruned flat graph.

Vectors are unit-normalised and equal ones reduced to one row. Per label, a
k-means on a bounded sample gives shard centres; every vector joins its nearest
few shards. Each shard builds a robust-pruned graph. The adjacency lists of the
overlapping shards are united per vector, and each shard answers its own vectors
by a range-expanding greedy search from its medoid over the united lists; hits
are verified by the cosine in double precision. Links between vectors of
different shards come from an exact join of every two shards, of those vectors
that lie near enough to the border between them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.common import materialise
from horizonkit.llm.components import connected_components

THRESHOLD = 0.93
LEAST_RECALL = 0.9
AUDITED = 1000
SHARD_SIZE = 1500
OVERLAP = 3
SAMPLE = 20_000
DEGREE = 24
CANDIDATES = 96
ALPHA = 1.2
BEAM = 32
#: Edges to members drawn at random that each node keeps besides its pruned ones.
RANDOM_EDGES = 8
#: Search again so much wider where the audit finds too few links.
WIDER = 4
SLACK = 0.1
BLOCK = 512


def unit(vector: list | None) -> np.ndarray | None:
    """The vector scaled to length one; None where it cannot link.

    It is divided by its largest component first, so squares stay in range.
    """
    if not vector or any(x is None for x in vector):
        return None
    values = np.array(vector, np.float64)
    top = np.abs(values).max()
    if not 0 < top < np.inf:  # zero, infinite or not a number
        return None
    values = values / top + 0.0  # no negative zeros
    return values / np.sqrt(values @ values)


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """``(vec_id, label, v, key)``; ``v`` and ``key`` are null where the vector cannot link.

    That is: a null id, label or vector, null or non-finite components, or
    length zero. The dimension is part of the returned label, so vectors of
    unequal dimension never compare. Equal keys mean equal label and vector.
    """

    def scale(batches):
        for batch in batches:
            rows = []
            for vec_id, label, vector in zip(*(c.to_pylist() for c in batch.columns)):
                v = unit(vector) if vec_id is not None and label is not None else None
                if v is None:
                    rows.append((vec_id, label, None, None))
                else:
                    label = f"{label}:{len(v)}"
                    rows.append((vec_id, label, v.tolist(), hashlib.sha256(label.encode() + v.tobytes()).digest()))
            columns = zip(*rows) if rows else [()] * 4
            kinds = [pa.int64(), pa.string(), pa.list_(pa.float64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["vec_id", "label", "v", "key"]
            )

    return vectors.select(
        F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>")
    ).mapInArrow(scale, "vec_id long, label string, v array<double>, key binary")


def _kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors; starts from evenly spaced rows, so it is repeatable."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(points[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 1e-12, sums / np.maximum(lengths, 1e-12), centres)
    return centres


def fit_centres(distinct: DataFrame, sizes: DataFrame, shard_size: int = SHARD_SIZE, sample: int = SAMPLE) -> DataFrame:
    """``(label, centre, c)``: as many centres as the label's rows fill shards.

    Each label fits on about ``sample`` vectors, picked by a hash of the id;
    it gets one centre per ``shard_size`` rows, at most half its sample.
    """
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    pick = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share * (1 << 20)
    sampled = distinct.select("label", "rep", "v").join(sizes, "label").where(pick)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        points = np.stack(rows["v"].to_numpy())
        k = max(1, min(len(points) // 2, -(-int(rows["n"].iloc[0]) // shard_size)))
        centres = _kmeans(points, k)
        return pd.DataFrame({"label": rows["label"].iloc[0], "centre": np.arange(k), "c": list(centres)})

    return sampled.groupBy("label").applyInPandas(fit, "label string, centre int, c array<double>")


def with_centres(rows: DataFrame, sizes: DataFrame, centres: DataFrame, function, schema: str) -> DataFrame:
    """``function(points, table)`` over chunks of a label's rows, with all its centres by number.

    A label's rows are dealt over chunks of bounded size, and its centres (at
    most half a sample) go to every chunk.
    """
    chunks = sizes.select("label", F.ceil(F.col("n") / SAMPLE).cast("int").alias("chunks"))
    dealt = rows.join(chunks, "label").select(
        *rows.columns, F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk")
    )
    copies = centres.join(chunks, "label").select(
        F.col("label").alias("of"), F.col("centre").alias("number"), "c",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("at"),
    )
    return dealt.groupBy("label", "chunk").cogroup(copies.groupBy("of", "at")).applyInPandas(
        lambda points, table: function(points.drop(columns="chunk"), table.sort_values("number")), schema
    )


PLACED = "label string, rep long, copies long, v array<double>, centre int, primary boolean"


def assign_shards(distinct: DataFrame, sizes: DataFrame, centres: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """One row per vector and shard: the ``overlap`` nearest centres, the first one primary."""

    def nearest(points: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if points.empty:
            return points.assign(centre=0, primary=False)
        wide = min(overlap, len(table))
        cosines = np.stack(points["v"].to_numpy()) @ np.stack(table["c"].to_numpy()).T
        best = np.argsort(-cosines, axis=1, kind="stable")[:, :wide]
        return pd.concat([points.assign(centre=best[:, k], primary=k == 0) for k in range(wide)])

    return with_centres(distinct.select("label", "rep", "copies", "v"), sizes, centres, nearest, PLACED)


def border_shards(placed: DataFrame, sizes: DataFrame, centres: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Primary rows with ``across``: the other shards that may hold a vector linked to theirs.

    A vector is on its own side of the plane halfway between its centre and
    another one. One further from that plane than the link angle allows has no
    link to the other side.
    """
    reach = np.sqrt(1 - threshold**2) if threshold > 0 else np.inf

    def reachable(points: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        across = pd.Series([None] * len(points), index=points.index, dtype=object)
        numbers, c = table["number"].to_numpy(), np.stack(table["c"].to_numpy()) if len(table) else None
        for own, part in points.groupby("centre"):
            at = int(np.searchsorted(numbers, own))
            limit = reach * np.linalg.norm(c[at] - c, axis=1) + 1e-9
            limit[at] = -1
            for start in range(0, len(part), BLOCK):
                block = part.iloc[start : start + BLOCK]
                cosines = np.stack(block["v"].to_numpy()) @ c.T
                for row, near in zip(block.index, cosines[:, [at]] - cosines <= limit):
                    across[row] = numbers[near].tolist()
        return points.assign(across=across)

    rows = placed.where("primary").drop("primary")
    return with_centres(
        rows, sizes, centres, reachable,
        "label string, rep long, copies long, v array<double>, centre int, across array<int>",
    )


def border_links(rows: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """All links between two shards, as the ``count`` and ``star`` rows of ``shard_links``."""
    rows = rows.sort_values(["centre", "rep"])
    low = int((rows["centre"] == rows["low"]).sum())
    points, copies, reps = np.stack(rows["v"].to_numpy()), rows["copies"].to_numpy(), rows["rep"].to_numpy()
    count, distinct, group = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
    for start in range(0, low, BLOCK):
        end = min(low, start + BLOCK)
        for first in range(low, len(rows), 8 * BLOCK):
            last = min(len(rows), first + 8 * BLOCK)
            near = points[start:end] @ points[first:last].T >= threshold
            count[start:end] += near @ copies[first:last]
            count[first:last] += near.T @ copies[start:end]
            distinct[start:end] += near.sum(1)
            distinct[first:last] += near.sum(0)
            for row in np.flatnonzero(near.any(1)).tolist():
                met = np.unique(np.append(group[first:last][near[row]], group[start + row]))
                if len(met) > 1:
                    group[np.isin(group, met)] = met[0]
    linked, moved = np.flatnonzero(distinct), np.flatnonzero(group != np.arange(len(rows)))
    return pd.DataFrame({
        "kind": np.array(["count"] * len(linked) + ["star"] * len(moved), object),
        "a": np.concatenate((reps[linked], reps[moved])), "b": np.concatenate((reps[linked], reps[group[moved]])),
        "n": np.concatenate((count[linked], np.zeros_like(moved))),
        "m": np.concatenate((distinct[linked], np.zeros_like(moved))),
    })


def robust_prune(similar: np.ndarray, between: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Positions kept of candidates sorted by falling cosine.

    ``similar`` are cosines to the node, ``between`` those among candidates. A
    candidate goes when a kept one is ``alpha`` times nearer to it than the node is.
    """
    far, apart = np.sqrt(np.maximum(0, 2 - 2 * similar)), np.sqrt(np.maximum(0, 2 - 2 * between))
    alive = np.ones(len(similar), bool)
    kept = []
    for i in range(len(similar)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * apart[i] > far
    return np.array(kept, np.int64)


def build_graph(points: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES,
                random_edges: int = RANDOM_EDGES) -> list[np.ndarray]:
    """Robust-pruned neighbour lists within one bounded shard, reverse edges included.

    The candidates of a vector in a dense cluster are all members of it, so
    pruned lists alone lead nowhere else; every node also keeps a few edges to
    members drawn at random (from a generator seeded by the shard's size).
    """
    n = len(points)
    lists: list[list[int]] = [[] for _ in range(n)]
    wide = min(candidates, n - 1)
    if wide < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    for start in range(0, n, BLOCK):
        cosines = points[start : start + BLOCK] @ points.T
        rows = np.arange(len(cosines))
        cosines[rows, start + rows] = -2
        nearest = np.argpartition(-cosines, wide - 1, axis=1)[:, :wide]
        nearest = np.take_along_axis(nearest, np.argsort(-np.take_along_axis(cosines, nearest, 1), axis=1, kind="stable"), 1)
        for row, near in enumerate(nearest):
            kept = near[robust_prune(cosines[row, near], points[near] @ points[near].T, degree)]
            lists[start + row] += kept.tolist()
            for other in kept:
                lists[other].append(start + row)
    drawn = np.random.default_rng(n).integers(0, n, (n, min(random_edges, n - 1)))
    for node, others in enumerate(drawn.tolist()):
        for other in others:
            if other != node:
                lists[node].append(other)
                lists[other].append(node)
    return [np.unique(np.array(x, np.int64)) for x in lists]


def medoids(points: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Of each group of positions that is not empty, the member nearest to its mean."""
    return np.unique([g[(points[g] @ points[g].mean(0)).argmax()] for g in groups if len(g)]).astype(np.int64)


def range_search(points: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, threshold: float = THRESHOLD,
                 beam: int = BEAM, slack: float = SLACK, starts: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query position the others of at least ``threshold`` that the search meets.

    Greedy search walks from ``starts`` (the medoid unless given) with a beam
    until the beam is expanded; then everything met within the widened range
    expands, ring by ring, until no new member turns up.
    """
    n = len(points)
    starts = medoids(points, [np.arange(n)]) if starts is None else starts
    hits = []
    for query in queries.tolist():
        own = points[query]
        cosine, met, expanded = np.full(n, -2.0), starts, np.zeros(n, bool)
        cosine[starts] = points[starts] @ own

        def expand(ring: np.ndarray) -> np.ndarray:
            expanded[ring] = True
            near = np.concatenate([graph[p] for p in ring.tolist()])
            fresh = np.unique(near[cosine[near] == -2.0])
            cosine[fresh] = points[fresh] @ own
            return fresh

        while True:
            if len(met) > beam:
                met = met[np.argpartition(-cosine[met], beam - 1)[:beam]]
            todo = met[~expanded[met]]
            if not len(todo):
                break
            met = np.append(met, expand(todo[np.argsort(-cosine[todo])[:8]]))
        while len(ring := np.flatnonzero((cosine >= threshold - slack) & ~expanded)):
            expand(ring)
        cosine[query] = -2.0
        hits.append(np.flatnonzero(cosine >= threshold))
    return hits


def shard_links(rows: pd.DataFrame, threshold: float = THRESHOLD, beam: int = BEAM) -> pd.DataFrame:
    """Links among one shard's primary vectors, as ``kind, a, b, n, m`` rows.

    ``count``: ``n`` linked rows and ``m`` linked distinct vectors of ``a``;
    ``star``: a spanning forest of the links.
    """
    rows = rows.sort_values("rep").reset_index(drop=True)
    points, reps, primary = np.stack(rows["v"].to_numpy()), rows["rep"].to_numpy(), rows["primary"].to_numpy()
    copies = rows["copies"].to_numpy()
    graph = []
    for near in rows["near"]:  # the united lists name vectors; those of this shard count
        ids = np.unique(np.asarray([] if near is None else near, np.int64))
        at = np.searchsorted(reps, ids)
        at[at == len(reps)] = 0
        graph.append(at[reps[at] == ids] if len(ids) else at)
    asked = np.flatnonzero(primary)
    # the shard's own medoid, that of the vectors it shares with others, and that of both
    starts = medoids(points, [np.arange(len(points)), asked, np.flatnonzero(~primary)])
    links: set[tuple[int, int]] = set()
    for query, found in zip(asked.tolist(), range_search(points, graph, asked, threshold, beam, starts=starts)):
        links.update((min(query, p), max(query, p)) for p in found[primary[found]].tolist())
    count, distinct = np.zeros(len(reps), np.int64), np.zeros(len(reps), np.int64)
    parent = list(range(len(reps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        count[a] += copies[b]
        count[b] += copies[a]
        distinct[[a, b]] += 1
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    out = [("count", reps[i], reps[i], count[i], distinct[i]) for i in np.flatnonzero(distinct)]
    out += [("star", reps[i], reps[r], 0, 0) for i in range(len(reps)) if (r := root(i)) != i]
    return pd.DataFrame(out, columns=["kind", "a", "b", "n", "m"])


LINKS = "kind string, a long, b long, n long, m long"


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_size: int = SHARD_SIZE,
                    overlap: int = OVERLAP, width: int = 1) -> DataFrame:
    """``(vec_id, n_links, n_distinct, component_id, kept)`` per row of ``vectors(vec_id, embedding, label)``.

    ``n_links`` counts linked rows, ``n_distinct`` linked vectors other than the row's own.
    Vectors that cannot link (see ``unit_vectors``) have no
    links and are their own component. Equal vectors are one node with a
    count, so a hot vector costs one row; repeated rows are copies too. An
    empty table gives no rows. ``width`` multiplies the beam and the random edges.
    """
    rows = unit_vectors(vectors)
    distinct = materialise(
        rows.where("key is not null").groupBy("key")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("v").alias("v")),
        "vectors",
    )
    sizes = distinct.groupBy("label").agg(F.count("*").alias("n"))
    centres = materialise(fit_centres(distinct, sizes, shard_size), "centres")
    placed = materialise(assign_shards(distinct, sizes, centres, overlap), "shards")

    def link_lists(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("rep")
        reps = shard["rep"].to_numpy()
        lists = build_graph(np.stack(shard["v"].to_numpy()), random_edges=width * RANDOM_EDGES)
        return pd.DataFrame({"label": shard["label"].iloc[0], "rep": reps, "near": [reps[x] for x in lists]})

    lists = placed.groupBy("label", "centre").applyInPandas(link_lists, "label string, rep long, near array<long>")
    united = lists.groupBy("label", "rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    joined = placed.join(united, ["label", "rep"])
    within = joined.groupBy("label", "centre").applyInPandas(lambda shard: shard_links(shard, threshold, width * BEAM), LINKS)
    border = border_shards(placed, sizes, centres, threshold).withColumn("other", F.explode("across")).select(
        "label", F.least("centre", "other").alias("low"), F.greatest("centre", "other").alias("high"),
        "centre", "rep", "copies", "v",
    )
    between = border.groupBy("label", "low", "high").applyInPandas(lambda pair: border_links(pair, threshold), LINKS)
    found = materialise(within.unionByName(between), "links")
    counts = (
        found.where("kind = 'count'").groupBy(F.col("a").alias("rep"))
        .agg(F.sum("n").alias("others"), F.sum("m").alias("n_distinct"))
    )
    roots = connected_components(found.where("kind = 'star'").select("a", "b").distinct())
    nodes = (
        distinct.select("key", "rep", "copies").join(counts, "rep", "left")
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "n_distinct",
                F.coalesce("root", "rep").alias("component_id"))
    )
    # rows without a key meet nothing, so they stay out of the join
    keyed, alone = rows.where("key is not null").select("vec_id", "key"), rows.where("key is null").select("vec_id")
    linked = keyed.join(nodes, "key", "left").select("vec_id", "n_links", "n_distinct", "component_id").unionByName(
        alone, allowMissingColumns=True
    )
    component = F.coalesce("component_id", "vec_id")
    return linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def audit_recall(result: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> float:
    """Share found of the true links between unequal vectors, of ``audited`` vectors over all labels.

    Brute force of the audited vectors against all distinct vectors of their
    labels. The smaller of the share of all links and the mean share per
    audited vector with links; 1 where there are none. Ids whose rows disagree
    (one id with unequal vectors) are not audited.
    """
    distinct = materialise(
        unit_vectors(vectors).where("key is not null").groupBy("key")
        .agg(F.min("vec_id").alias("rep"), F.any_value("label").alias("label"), F.any_value("v").alias("v")),
        "audit-vectors",
    )
    sizes = distinct.groupBy("label").agg(F.count("*").alias("n"))
    asked = (
        distinct.withColumn("h", F.xxhash64("rep", F.lit(7))).orderBy("h", "rep").limit(audited)
        .select("label", F.col("rep").alias("centre"), F.col("v").alias("c"))
    )

    def count(points: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        true = np.zeros(len(table), np.int64)
        for start in range(0, len(points) if len(table) else 0, 8 * BLOCK):
            block = np.stack(points["v"].iloc[start : start + 8 * BLOCK].to_numpy())
            true += (np.stack(table["c"].to_numpy()) @ block.T >= threshold).sum(1)
        return pd.DataFrame({"vec_id": table["number"], "true_links": true})

    truth = (
        with_centres(distinct.select("label", "rep", "v"), sizes, asked, count, "vec_id long, true_links long")
        .groupBy("vec_id").agg((F.sum("true_links") - 1).alias("true_links"))  # the vector meets itself
        .where("true_links > 0")
    )
    found = (
        truth.join(result.select("vec_id", "n_distinct"), "vec_id").groupBy("vec_id")
        .agg(F.any_value("true_links").alias("true"), F.min("n_distinct").alias("least"), F.max("n_distinct").alias("most"))
        .where("least = most").withColumn("met", F.least("true", "least"))
    )
    row = found.agg(F.sum("met") / F.sum("true"), F.avg(F.col("met") / F.col("true"))).first()
    return 1.0 if row[0] is None else min(row)
