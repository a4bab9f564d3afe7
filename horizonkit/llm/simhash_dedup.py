"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of the XXH64 values of its
word shingles. Every distinct fingerprint emits all variants within half the
radius. Two fingerprints within the radius meet in at least one variant, and
two that meet are at most the radius apart, so one star per variant bucket
keeps every link: a bucket holds at most one ball of fingerprints (65 at
radius 2) however many documents share them.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horizonkit.llm.common import keyed_text, materialise
from horizonkit.llm.components import connected_components

SEED = 42
WIDTH = 3
RADIUS = 2
BLOCK = 1 << 16

_hash64 = xxhash.xxh64_intdigest
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_LANES = np.arange(8, dtype=np.int64) * 256


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set (bit 0 first)."""
    lanes = hashes.view(np.uint8).reshape(-1, 8) + _LANES
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def text_fingerprint(text: str, width: int = WIDTH) -> int:
    """Unsigned fingerprint of one text; zero when it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return _hash64(b" ".join(words), SEED)
    total, votes = len(words) - width + 1, np.zeros(64, np.int64)
    for start in range(0, total, BLOCK):  # bounded memory for very long texts
        part = words[start : start + BLOCK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width))))
        votes += bit_votes(np.fromiter(map(_hash64, shingles, repeat(SEED)), np.uint64))
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = WIDTH, keyed: bool = False) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint's bits in a signed long, and ``text_key`` if ``keyed``."""

    def compute(batches):
        for batch in batches:
            values = [text_fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), *batch.columns[2:]],
                names=["doc_id", "fp", *["text_key"] * keyed],
            )

    return keyed_text(docs, id_col, text_col, keyed).mapInArrow(
        compute, "doc_id long, fp long" + ", text_key binary" * keyed
    )


def ball_masks(radius: int) -> list[int]:
    """Signed 64-bit masks with at most ``radius`` bits set."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints within ``radius``.

    ``prints(fp)`` must be distinct. The edges are the stars of the variant
    buckets, verified; their closure equals that of all links.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be an even number of bits")
    variants = prints.select(
        "fp",
        F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in ball_masks(radius // 2)]))
        .alias("variant"),
    )
    bucket = Window.partitionBy("variant")
    return (
        variants.withColumn("lowest", F.min("fp").over(bucket))
        .where("fp <> lowest")
        .select(F.col("fp").alias("a"), F.col("lowest").alias("b"))
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = WIDTH, radius: int = RADIUS, keyed: bool = False) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``, and ``text_key`` and ``root`` if ``keyed``.

    ``component_id`` is the smallest doc_id among the texts reachable by links
    of at most ``radius`` differing bits. Null and empty texts (fingerprint
    zero) are linked like any other; a null doc_id keeps its row and never
    becomes a component id unless the whole component lacks ids; repeated rows
    each keep theirs. Rows of one hot fingerprint are reduced to one
    (fp, smallest id) row before any link is sought. ``root`` tells groups
    apart, which may share a component id where one id has several texts.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width, keyed), "simhash")
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(by_print.select("fp"), radius))
    linked = roots.join(by_print.withColumnRenamed("fp", "node"), "node")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = linked.join(smallest, "root").select(F.col("node").alias("fp"), "component_id", "root")
    of_print = (
        by_print.join(of_print, "fp", "left")
        .select("fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    )
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id", *["text_key", "root"] * keyed)


def hex_fingerprint(column: str = "fp"):
    """16 lowercase hex digits of a signed-long fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
