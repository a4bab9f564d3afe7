"""Alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers cut the same bytes. Places where a token of each ends cut a
text into groups, and tokens whose bytes overlap are linked. Per pair of linked
ids there is a posting: the compressed bitmap of the documents that hold it, in
blocks of bounded size numbered within a task. A block's part is a sorted list
of 16-bit places, or a bitmap of words where that is smaller. Multiplicity
planes hold the bits of "links in the document, less one", so that

    documents = popcount(plane 0)
    links     = popcount(plane 0) + sum of 2^(k - 1) * popcount(plane k).

Batches are merged into their block's bitmaps, and the blocks of a pair are
popcounted with a partial sum before anything moves. Then each posting returns
the pair's scores to its block, where they are added up per document. A pair
that all documents hold costs one small bitmap per block, so it is no hot key.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.byte_bpe import ByteBpe, byte_symbols
from horizonkit.llm.common import keyed_text, materialise

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Documents of a block; a place is a signed 16-bit number.
BLOCK_DOCS = 32_768
#: A block also ends after so many (document, pair) entries.
BLOCK_ENTRIES = 3_000_000
#: Characters tokenized and linked at a time; a longer text is one batch.
BATCH_CHARS = 1_000_000
#: Vocabulary ids take so many bits in a pair, and places so many in a sort key.
ID_BITS, PLACE_BITS = 24, 15


class TwoTokenizers:
    """Ids and token bytes of both tokenizers for texts with a space in front."""

    _made: dict[tuple[str, str], TwoTokenizers] = {}

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.a = ByteBpe.shared(path_a)
        symbol = byte_symbols()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in symbol for c in token):
                self.bytes_a[i] = bytes(symbol[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece_bytes(i) for i in range(self.b.vocab_size())]
        self.long_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.long_b = np.array([len(t) for t in self.bytes_b], np.int64)
        #: decimal ids with what may follow them in a group's text
        self.spelt = [f"{i}{end}".encode() for i in range(len(self.bytes_a)) for end in (",", "|")]
        self.spelt_b = len(self.spelt)
        self.spelt += [f"{i}{end}".encode() for i in range(len(self.bytes_b)) for end in (",", ";", "")]

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @classmethod
    def shared(cls, path_a: str, path_b: str) -> TwoTokenizers:
        """One pair per Python worker and vocabulary files."""
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Both id lists, or None where there are none or their bytes are not those of space + text."""
        if not text:
            return None
        whole = f" {text}".encode()
        a = self.a.plain_ids(f" {text}")
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole:
            return None
        b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return a, b


class Linked:
    """Groups and links of a batch of aligned documents, laid out one after the other."""

    def __init__(self, pair: TwoTokenizers, ids: list[tuple[list[int], list[int]]]):
        self.pair, self.n = pair, len(ids)
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([np.array(x[k], np.int64) for x in ids]) for k in (0, 1))
        self.ends_a, self.ends_b = np.cumsum(pair.long_a[self.a]), np.cumsum(pair.long_b[self.b])
        doc_ends = self.ends_a[np.cumsum(self.n_a) - 1]
        both = np.concatenate((self.ends_a, self.ends_b))
        both.sort(kind="stable")
        twice = both[1:] == both[:-1]
        self.common = both[1:][twice]
        #: each stretch between neighbouring ends lies in one token of each: it is a link
        stretch = both[np.append(True, ~twice)]
        self.link_a = self.a[np.searchsorted(self.ends_a, stretch)]
        self.link_b = self.b[np.searchsorted(self.ends_b, stretch)]
        self.link_doc = np.searchsorted(doc_ends, stretch)
        self.n_links = np.bincount(self.link_doc, minlength=self.n)
        self.n_groups = np.bincount(np.searchsorted(doc_ends, self.common), minlength=self.n)

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text."""
        group_a, group_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        last_a, last_b = self.ends_a == self.common[group_a], self.ends_b == self.common[group_b]
        before_b = np.append(0, np.searchsorted(self.ends_b, self.common, "right"))
        through_a = np.searchsorted(self.ends_a, self.common, "right")
        after_b = last_b.astype(np.int64)
        after_b[np.cumsum(self.n_b) - 1] = 2
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + before_b[group_a]] = 2 * self.a + last_a
        codes[np.arange(len(self.b)) + through_a[group_b]] = self.pair.spelt_b + 3 * self.b + after_b
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        spell = self.pair.spelt.__getitem__
        return [
            hashlib.sha256(b"".join(map(spell, codes[start:stop].tolist()))).hexdigest()
            for start, stop in zip([0, *stops], stops)
        ]

    def entries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (pair, place of the document) and their links."""
        pairs = (self.link_a << ID_BITS) | self.link_b
        return np.unique((pairs << PLACE_BITS) | places[self.link_doc], return_counts=True)


ALIGNED = (
    "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair long, plane int, places array<short>, words array<long>"
)
KINDS = {
    "block": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
    "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "pair": pa.int64(), "plane": pa.int32(), "places": pa.list_(pa.int16()), "words": pa.list_(pa.int64()),
}


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of ``ALIGNED`` rows; columns not given are null."""
    arrays = [columns[c] if c in columns else pa.nulls(n, kind) for c, kind in KINDS.items()]
    return pa.RecordBatch.from_arrays(
        [a if isinstance(a, pa.Array) else pa.array(a, kind) for a, kind in zip(arrays, KINDS.values())], names=list(KINDS)
    )


def to_words(places: np.ndarray) -> np.ndarray:
    """Bitmap of sorted places as signed 64-bit words."""
    bits = np.zeros(((int(places[-1]) >> 6) + 1) * 64, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def from_words(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8), bitorder="little"))


def _plane_rows(block: int, plane: int, pairs: np.ndarray, places: np.ndarray):
    """Batches of one plane of a block's postings; the entries are sorted by (pair, place)."""
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    sizes = np.diff(np.append(starts, len(pairs)))
    # a list takes 2 bytes a place, a bitmap 8 a word up to the last place
    last = places[starts + sizes - 1].astype(np.int64)
    dense = 2 * sizes > 8 * ((last >> 6) + 1)
    for chosen in (~dense, dense):
        part = np.flatnonzero(chosen)
        if not len(part):
            continue
        common = {
            "block": np.full(len(part), block), "pair": pairs[starts[part]], "plane": np.full(len(part), plane, np.int32)
        }
        if chosen is dense:
            words = [to_words(places[s : s + n]) for s, n in zip(starts[part], sizes[part])]
            yield _rows(len(part), **common, words=pa.array(words, KINDS["words"]))
        else:
            offsets = np.append(0, np.cumsum(sizes[part])).astype(np.int32)
            listed = pa.array(places[np.repeat(chosen, sizes)], pa.int16())
            yield _rows(len(part), **common, places=pa.ListArray.from_arrays(pa.array(offsets), listed))


def posting_rows(block: int, keys: np.ndarray, links: np.ndarray):
    """Batches of a block's postings; ``keys`` are sorted (pair, place)."""
    pairs, places, extra = keys >> PLACE_BITS, (keys & ((1 << PLACE_BITS) - 1)).astype(np.int16), links - 1
    if len(pairs):
        yield from _plane_rows(block, 0, pairs, places)
    for plane in range(1, int(extra.max(initial=0)).bit_length() + 1):
        held = (extra >> (plane - 1)) & 1 == 1
        if held.any():
            yield from _plane_rows(block, plane, pairs[held], places[held])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (``pair`` is null) and one per posting, plane and block (``doc_id``, ``n_a`` are null)."""

    def compute(batches):
        pair = TwoTokenizers.shared(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        keys, links, held, size = [], [], 0, 0

        def batch_rows(ids: list, texts: list, first: int):
            nonlocal size
            cut = [pair.ids(text) for text in texts]
            good = [i for i, x in enumerate(cut) if x is not None]
            n = {c: np.zeros(len(ids), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
            digests = [""] * len(ids)
            if good:
                linked = Linked(pair, [cut[i] for i in good])
                for name, values in n.items():
                    values[good] = getattr(linked, name)
                for i, digest in zip(good, linked.digests()):
                    digests[i] = digest
                key, count = linked.entries(first + np.array(good, np.int64))
                keys.append(key)
                links.append(count)
                size += len(key)
            return _rows(
                len(ids), block=np.full(len(ids), block), place=np.arange(first, first + len(ids), dtype=np.int32),
                doc_id=pa.array(ids, pa.int64()), groups_sha256=pa.array(digests, pa.string()), **n,
            )

        def postings():
            # documents of batches differ, so the batches' bitmaps are merged by sorting their places together
            nonlocal keys, links, held, size, block
            if keys:
                key, count = np.concatenate(keys), np.concatenate(links)
                order = np.argsort(key, kind="stable")
                yield from posting_rows(block, key[order], count[order])
            keys, links, held, size, block = [], [], 0, 0, block + 1

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            while start < len(ids):
                stop, chars = start, 0
                while stop < len(ids) and stop - start < BLOCK_DOCS - held and (stop == start or chars + len(texts[stop]) <= BATCH_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                yield batch_rows(ids[start:stop], texts[start:stop], held)
                held += stop - start
                start = stop
                if held >= BLOCK_DOCS or size >= BLOCK_ENTRIES:
                    yield from postings()
        yield from postings()

    return keyed_text(docs, id_col, text_col).mapInArrow(compute, ALIGNED)


def popcount():
    """Documents in a posting's part."""
    listed = F.coalesce(F.array_size("places"), F.lit(0)).cast("long")
    return listed + F.coalesce(
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w).cast("long")), F.lit(0).cast("long")
    )


def plane_weight():
    """Links that a document in the plane stands for."""
    return F.when(F.col("plane") == 0, F.lit(1)).otherwise(F.expr("shiftleft(1L, plane - 1)")).cast("long")


def pair_scores(postings: DataFrame) -> DataFrame:
    """``(pair, links, documents, best)``; ``best``: no pair with the same id of the second tokenizer has more links."""
    counted = postings.select("pair", "plane", popcount().alias("n"), plane_weight().alias("weight"))
    totals = counted.groupBy("pair").agg(
        F.sum(F.col("n") * F.col("weight")).alias("links"), F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("documents")
    ).withColumn("b", F.col("pair") % (1 << ID_BITS))
    top = totals.groupBy("b").agg(F.max("links").alias("most"))
    return totals.join(top, "b").select("pair", "links", "documents", (F.col("links") == F.col("most")).alias("best"))


SCORED = "block long, place int, n_best long, count_sum long, docs_sum long"


def return_scores(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Per document of a block the sums over its links: best ones, link counts and document counts of their pairs."""

    def add_up(table: pa.Table) -> pa.Table:
        sums = np.zeros((BLOCK_DOCS, 3), np.int64)
        weight = table["weight"].to_numpy()
        values = np.stack([table["best"].to_numpy().astype(np.int64), table["links"].to_numpy(), table["documents"].to_numpy()], 1)
        values *= weight[:, None]
        places = table["places"].combine_chunks()
        sizes = np.nan_to_num(places.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = places.flatten().to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(weight)), sizes)
        for column in range(3):
            np.add.at(sums[:, column], flat, values[rows, column])
        words = table["words"].combine_chunks()
        for row in np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False)).tolist():
            sums[from_words(words[row].values.to_numpy())] += values[row]
        met = np.flatnonzero(sums[:, 1])
        block = table["block"][0].as_py()
        return pa.table({
            "block": np.full(len(met), block), "place": met.astype(np.int32), "n_best": sums[met, 0],
            "count_sum": sums[met, 1], "docs_sum": sums[met, 2],
        })

    carried = postings.select("block", "pair", plane_weight().alias("weight"), "places", "words")
    return carried.join(scores, "pair").drop("pair").groupBy("block").applyInArrow(add_up, SCORED)


def alignment_scores(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per document with its tokens, groups, links and the corpus-wide scores of its linked pairs.

    ``docs_sum`` adds up, over the links, in how many documents their pair
    occurs. A null or empty text, and one whose tokens do not spell space +
    text, has zeros and an empty digest. Repeated rows and null ids are
    documents of their own, so copies count in the corpus; other columns are
    ignored; an empty table gives no rows. A very long text is one batch.
    """
    path_a, path_b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)
    aligned = materialise(align(docs, path_a, path_b, id_col, text_col), "aligned")
    postings = aligned.where("pair is not null").select("block", "pair", "plane", "places", "words")
    scored = return_scores(postings, pair_scores(postings))
    own = aligned.where("n_a is not null").select(
        "block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"
    )
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum", "docs_sum")]
    return own.join(scored, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256"
    )
