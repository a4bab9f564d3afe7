"""Document fingerprints: SimHash with permuted block tables for the search.

Every distinct term (pair of neighbouring words) of a text votes on all bits
with the sign of its hash's bit and the weight ``1 + ln(count)``. Fingerprints
within the radius agree on at least two of ``radius + 2`` blocks of bits, so
one table per pair of blocks, keyed by those blocks, holds all of them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horizonkit.llm.common import keyed_text, materialise

BITS = 128
RADIUS = 5
_SHIFTED = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_LANES = np.arange(BITS // 8, dtype=np.int64) * 256


def fingerprint(text: str) -> bytes:
    """16 bytes; all zero for a text without words, the word's own for one word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(BITS // 8)
    terms = Counter(map(b" ".join, zip(words, words[1:])) if len(words) > 1 else words)
    weights = 1 + np.log(np.fromiter(terms.values(), np.float64, len(terms)))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), np.uint8).reshape(-1, BITS // 8)
    votes = np.bincount((hashes + _LANES).ravel(), np.repeat(weights, BITS // 8), 256 * BITS // 8)
    ones = (votes.reshape(-1, 256) @ _SHIFTED).ravel()
    return np.packbits(ones * 2 > weights.sum(), bitorder="little").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited_text(text: str, following: str) -> str:
    """The last third (rounded down) gives way to as much of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _row(doc_id, text: str, own: bytes, following: str, other: bytes) -> tuple:
    edited = edited_text(text, following)
    changed = fingerprint(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        own, changed, likeness(own, changed), likeness(own, other),
    )


_COLUMNS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()),
    ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_EDGE = [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
_TYPES = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def _batch(rows: list[tuple], columns) -> pa.RecordBatch:
    values = zip(*rows) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kind) for v, (_, kind) in zip(values, columns)], names=[n for n, _ in columns]
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its text edited with the next document.

    Documents follow each other by descending id (null ids last; repeated ids
    by a hash of the text, then the text); the first follows the last. One
    range shuffle puts neighbours together; only the first and last document
    of each partition meet in a join by partition number. Null texts are
    empty. An empty table gives no rows; a single document follows itself.
    """
    keyed = keyed_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    columns = _COLUMNS + _EDGE

    def walk(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = fingerprint(text)
                if held is None:
                    rows.append((None, None, None, own, None, None, None, part, "first", text))
                else:
                    rows.append((*_row(*held, text, own), part, None, None))
                held = doc_id, text, own
            yield _batch(rows, columns)
        if held is not None:
            yield _batch([(held[0], None, None, held[2], None, None, None, part, "last", held[1])], columns)

    walked = materialise(ordered.mapInArrow(walk, f"{_TYPES}, part int, edge string, text string"), "fingerprints")
    firsts = walked.where("edge = 'first'").select(F.col("part").alias("then"), F.col("fp").alias("next_fp"),
                                                    F.col("text").alias("next_text"))
    lasts = walked.where("edge = 'last'").select("part", "doc_id", "text", "fp")
    in_turn = Window.orderBy("part")  # one row per partition of the shuffle
    parts = lasts.select("part").withColumn("then", F.lead("part").over(in_turn))
    parts = parts.withColumn("then", F.coalesce("then", F.min("part").over(Window.partitionBy())))

    def close(batches):
        for batch in batches:
            cells = (c.to_pylist() for c in batch.columns)
            yield _batch([_row(i, t, fp, t2, fp2) for i, t, fp, t2, fp2 in zip(*cells)], _COLUMNS)

    closed = (
        lasts.join(parts, "part").join(firsts, "then")
        .select("doc_id", "text", "fp", "next_text", "next_fp").mapInArrow(close, _TYPES)
    )
    return walked.where("edge is null").drop("part", "edge", "text").unionByName(closed)


def _halves(column: str):
    """A 16-byte fingerprint as two longs."""
    digits = F.hex(column)
    return [
        F.conv(F.substring(digits, 1 + 16 * i, 16), 16, -10).cast("long").alias(half) for i, half in enumerate(("hi", "lo"))
    ]


def block_masks(radius: int) -> list[tuple[int, int]]:
    """Signed (hi, lo) masks of all pairs of the ``radius + 2`` blocks."""
    edges = [BITS * i // (radius + 2) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]

    def signed(word: int) -> int:
        return word - (1 << 64) if word >> 63 else word

    return [
        (signed((a | b) >> 64), signed((a | b) & ((1 << 64) - 1))) for a, b in combinations(blocks, 2)
    ]


def find_within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, n_near)`` per distinct fingerprint of ``queries(fp)``.

    ``n_near`` counts the rows of ``prints(fp)`` within the radius. Rows that
    share a fingerprint are counted before the tables are made, so copies cost
    nothing; candidates are verified inside the join.
    """
    masks = block_masks(radius)
    keys = F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("hi").bitwiseAND(F.lit(a).cast("long")).alias("h"),
                 F.col("lo").bitwiseAND(F.lit(b).cast("long")).alias("l"))
        for t, (a, b) in enumerate(masks)
    ])).alias("key")
    data = prints.groupBy("fp").agg(F.count("*").alias("copies"))
    rows = data.select("copies", *_halves("fp")).select("hi", "lo", "copies", keys).select("hi", "lo", "copies", "key.*")
    asked = queries.select("fp").distinct().select("fp", *_halves("fp"))
    wanted = asked.select(F.col("hi"), F.col("lo"), keys).select(F.col("hi").alias("qhi"), F.col("lo").alias("qlo"), "key.*")
    apart = (
        F.bit_count(F.col("hi").bitwiseXOR(F.col("qhi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("qlo")))
    )
    same = (rows["t"] == wanted["t"]) & (rows["h"] == wanted["h"]) & (rows["l"] == wanted["l"])
    near = (
        wanted.join(rows, same & (apart <= radius))
        .select("qhi", "qlo", "hi", "lo", "copies").distinct()  # a pair may meet in several tables
        .groupBy(F.col("qhi").alias("hi"), F.col("qlo").alias("lo")).agg(F.sum("copies").alias("n_near"))
    )
    return asked.join(near, ["hi", "lo"]).select("fp", "n_near")
