"""Best-fit packing of token pieces by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. Packing looks only at
how many pieces there are of each length, a table of at most ``capacity``
counts. For every length, longest first, the plan looks up single, pair and
triple length sums that fill the remaining gap exactly and consumes as many
copies of the combination as the counts allow. What is left goes best-fit
decreasing into the bins of the residue. Pieces then find their place from
their running number within their length, so no task or driver sees them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horizonkit.llm.byte_bpe import ByteBpe
from horizonkit.llm.common import keyed_text, materialise

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, task int, nth long"


def piece_bounds(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; the first one may be shorter."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n_tokens, capacity)]


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every text, append the end id and cut it into pieces.

    Besides the piece, a row has the task that made it and its running number
    among the task's pieces of that length.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def compute(batches):
        encoder = ByteBpe.shared(path)
        end = np.array([END_ID], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                view = memoryview(encoder.id_bytes(text) + end)
                for k, (start, length) in enumerate(piece_bounds(len(view) // 4, capacity)):
                    crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                    rows.append((doc_id, k, start, length, crc, task, int(made[length])))
                    made[length] += 1
            columns = zip(*rows) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(compute, PIECES)


def _complement(available: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One to three available lengths that sum to ``gap``; the longest first member wins."""
    if available[gap]:
        return (gap,)
    lengths = np.flatnonzero(available[: gap + 1])
    has = available > 0
    for first in lengths[::-1]:
        rest = gap - first
        if rest > 0 and rest <= first and has[rest] and (rest != first or available[first] > 1):
            return (int(first), int(rest))
    for first in lengths[::-1]:
        rest = gap - first
        if rest < 2:
            continue
        if 3 * first < gap:
            break
        second = lengths[(lengths <= first) & (lengths < rest) & (2 * lengths >= rest)]
        for b in second[has[rest - second]][::-1]:
            need = np.bincount([first, b, rest - b])
            if (available[: len(need)] >= need).all():
                return (int(first), int(b), int(rest - b))
    return None


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of one sequence, how many such sequences)`` that use every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(combination: tuple[int, ...]) -> None:
        need = np.bincount(combination, minlength=capacity + 1)
        used = need > 0
        times = int((left[used] // need[used]).min())
        left[used] -= need[used] * times
        plan.append((combination, times))

    if left[capacity]:
        consume((capacity,))
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            fill = _complement(left, capacity - length)
            left[length] += 1
            if fill is None:
                break
            consume((length, *fill))
    # best fit decreasing of the residue: bins by remaining gap
    bins: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                each = capacity // length
                for size, times in ((each, n // each), (n % each, 1)):
                    if size and times:
                        bins.setdefault(capacity - size * length, []).append([(length,) * size, times])
                break
            held, times = bins[gap][-1]
            moved = min(n, times)
            if moved == times:
                bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
            else:
                bins[gap][-1][1] -= moved
            bins.setdefault(gap - length, []).append([(*held, length), moved])
            n -= moved
    plan += [(held, times) for group in bins.values() for held, times in group]
    return plan


def slot_runs(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows ``(length, first number, first sequence, per sequence, first offset)``.

    The pieces of one length, numbered from 0, fill these runs in order. There
    are at most four rows per consumed combination and one per distinct length
    of a residual bin group; their number depends on the capacity, not on the
    number of pieces.
    """
    rows, numbered, sequence = [], {}, 0
    for combination, times in plan:
        offset = 0
        for length in sorted(set(combination), reverse=True):
            per = combination.count(length)
            rows.append((length, numbered.get(length, 0), sequence, per, offset))
            numbered[length] = numbered.get(length, 0) + per * times
            offset += per * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         planner: Callable = plan_packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there.

    A null or empty text is a document of the end id alone. Repeated rows are
    packed as often as they occur, null ids included; an empty table gives an
    empty result. Equal lengths are told apart by (task, running number), so
    ties need no further order.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    made = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = made.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = slot_runs(planner(counts, capacity))

    def place(batches):
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            length = columns["length"].to_numpy()
            number = columns["nth"].to_numpy() + columns["first"].to_numpy()
            run = runs[np.searchsorted(keys, (length << 44) + number, "right") - 1] if len(length) else runs[:0]
            into, slot = np.divmod(number - run[:, 1], run[:, 3])
            yield pa.RecordBatch.from_arrays(
                [*(columns[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(run[:, 2] + into), pa.array(run[:, 4] + slot * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = pieces.join(first, ["task", "length"])
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "first").mapInArrow(
        place, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumn("piece", F.col("piece").cast("int"))
