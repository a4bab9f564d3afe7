"""Token counts, tokenizer alignment and centroid clustering against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from horizonkit.llm import bit_plane_clusters, pair_bitmaps, queries, token_transducer
from horizonkit.llm.oracles_clusters import centroid_clusters
from tests.llm.conftest import TEXTS

SMALL = "/root/testdata/sf0.001"
LETTERS = [*"abcdefst'''   \n\t\r\x1c\x85　\xa012!.-<|>éß日本αβγ٣Ⅷ\U0001f600", "<|endoftext|>", "'re", "'ll", "  ", " '", "▁"]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def random_texts(n, most, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def machine():
    return token_transducer.Transducer.shared(public_tokenizers.path("byte_bpe_50k.json"))


def test_transducer_counts_as_the_library(machine, library):
    texts = random_texts(1500, 40) + ["a" * 3000, " " * 500 + "x", "=" * 700, "ab" * 900, "\n" * 300, "x<|endoftext|>" * 50]
    for text in texts:
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_state_table_may_be_compiled_anew(machine, library, monkeypatch):
    monkeypatch.setattr(token_transducer, "MAX_STATES", 50)
    for text in random_texts(200, 60, seed=6):
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [1, 7, 40, 300])
def test_state_maps_compose_in_any_grouping(machine, library, chunk):
    rng = random.Random(chunk)
    for text in random_texts(60, 700, seed=chunk):
        maps = [machine.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)] or [machine.chunk_map("")]
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [maps[i].then(maps[i + 1], machine)]
        assert maps[0].total(machine) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_messy_rows(docs, no_docs, library):
    want = Counter()
    for i, text in TEXTS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 512] += 1
    assert rows_of(token_transducer.token_counts(docs)) == want
    assert rows_of(token_transducer.token_counts(docs, chunk_chars=50)) == want
    assert token_transducer.token_counts(no_docs).count() == 0


def test_very_long_texts_are_counted_by_chunks(spark, library):
    texts = ["word " * 300_000, "a" * 200_000, "x1" * 400_000 + "<|endoftext|>" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, len(t), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in enumerate(texts)}
    assert {tuple(r) for r in token_transducer.token_counts(docs).collect()} == want


def test_token_counts_query(spark, library):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 512] += 1
    assert rows_of(queries.op12_token_counts(spark, SMALL)) == want


def byte_values():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_alignment(rows):
    """Row by row and link by link, with the library itself for the first tokenizer."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value = byte_values()
    per_doc, links, in_docs = [], Counter(), Counter()
    for doc_id, text in rows:
        a, b = [], []
        if text:
            for i in first.encode(f" {text}", add_special_tokens=False).ids:
                a.append((i, bytes(value[c] for c in first.id_to_token(i))))
            for i in second.encode(text):
                piece = second.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == f" {text}".encode():
                a, b = [], []
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        own = Counter()
        j = 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                own[i, spans[1][k][2]] += 1
                k += 1
        links.update(own)
        in_docs.update(own.keys())
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        per_doc.append((doc_id, len(a), len(b), len(cuts), own, digest))
    most = defaultdict(int)
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return Counter(
        (i, na, nb, g, sum(own.values()), sum(n for p, n in own.items() if links[p] == most[p[1]]),
         sum(n * links[p] for p, n in own.items()), sum(n * in_docs[p] for p, n in own.items()), digest)
        for i, na, nb, g, own, digest in per_doc
    )


def test_alignment_of_messy_rows(spark, docs, no_docs):
    assert rows_of(pair_bitmaps.alignment_scores(docs)) == brute_alignment(TEXTS)
    assert pair_bitmaps.alignment_scores(no_docs).count() == 0
    texts = list(enumerate(random_texts(300, 60, seed=8)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows_of(pair_bitmaps.alignment_scores(table)) == brute_alignment(texts)


def test_alignment_over_many_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(pair_bitmaps, "BLOCK_ENTRIES", 200)
    monkeypatch.setattr(pair_bitmaps, "BATCH_CHARS", 100)
    texts = [(i, ("the cat the cat " * (i % 40)) + f"sat {i % 7}") for i in range(600)]
    table = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    assert rows_of(pair_bitmaps.alignment_scores(table)) == brute_alignment(texts)


def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op11_cross_tokenizer_alignment(spark, SMALL)) == brute_alignment(rows)


def test_postings_hold_documents_and_multiplicities():
    rng = np.random.default_rng(1)
    entries = {(int(p), int(d)): int(m) for p, d, m in zip(rng.integers(0, 9, 4000), rng.integers(0, 900, 4000), rng.integers(1, 40, 4000))}
    entries |= {(3, d): 1 for d in range(900)}  # dense
    keys = np.array(sorted((p << pair_bitmaps.PLACE_BITS) | d for p, d in entries))
    links = np.array([entries[k >> pair_bitmaps.PLACE_BITS, k & 0x7FFF] for k in keys.tolist()])
    got, kinds = Counter(), set()
    for batch in pair_bitmaps.posting_rows(5, keys, links):
        for row in batch.to_pylist():
            kinds.add(row["words"] is not None)
            weight = 1 if row["plane"] == 0 else 1 << (row["plane"] - 1)
            places = row["places"] if row["words"] is None else pair_bitmaps.from_words(np.array(row["words"])).tolist()
            for place in places:
                got[row["pair"], place] += weight
    assert got == Counter(entries) and kinds == {True, False}


def brute_clusters(rows, clusters=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(np.float64(x)))) for x in v]))
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:clusters]
    centres = [list(q) for _, q in starts]

    def assign():
        out = []
        for _, q in kept:
            d = [sum((x - c) ** 2 for x, c in zip(q, centre)) for centre in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for (k, _), (_, q) in zip(assign(), kept):
            members[k].append(q)
        for k, qs in members.items():
            centres[k] = [sum(column) // len(qs) for column in zip(*qs)]
    final = assign()
    inertia = Counter()
    for k, d in final:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for (i, _), (k, d) in zip(kept, final))


VECTORS = "vec_id long, embedding array<double>, label int, planes string, cluster int"


def test_clusters_of_messy_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(64)], 0, "x", 1) for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None), (7, rows[2][1], 1, "x", 1)]
    rows += [(100, None, 0, "x", 1), (101, [1.0] * 63, 0, "x", 1), (102, [1.0] * 63 + [None], 0, "x", 1), (103, [], 0, "x", 1)]
    rows += [(104, [float("nan")] * 64, 0, "x", 1), (105, [float("-inf")] * 64, 0, "x", 1), (106, [0.0] * 64, 0, "x", 1)]
    rows += [(107, [-3000.0, *[1e-9] * 62, -1e-9], 0, "x", 1)]
    got = rows_of(bit_plane_clusters.cluster(spark.createDataFrame(rows, VECTORS)))
    assert got == brute_clusters([r[:2] for r in rows])


def test_few_equal_and_no_vectors(spark):
    one = [(i, [0.5] * 64, 0, "x", 1) for i in (1, 1, 2)]
    assert rows_of(bit_plane_clusters.cluster(spark.createDataFrame(one, VECTORS))) == brute_clusters([r[:2] for r in one])
    assert bit_plane_clusters.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert bit_plane_clusters.cluster(spark.createDataFrame([(1, None, 0, "x", 1)], VECTORS)).count() == 0
    with pytest.raises(ValueError, match="fit a long"):
        bit_plane_clusters.cluster(spark.createDataFrame([(1, [1e9] * 64, 0, "x", 1)], VECTORS))


def test_popcounts_are_exact():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-(1 << 20), 1 << 20, (50, 64)), rng.integers(-(1 << 20), 1 << 20, (5, 64))
    px, pc = bit_plane_clusters.to_planes(x, 21), bit_plane_clusters.to_planes(c, 21)
    assert (bit_plane_clusters.dots(px, pc) == x @ c.T).all()
    best, distance = bit_plane_clusters.nearest(px, pc)
    want = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (best == want.argmin(1)).all() and (distance == want.min(1)).all()


def test_clustering_query_and_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{SMALL}/embeddings.parquet')")
    got = queries.op13_centroid_clustering(spark, SMALL)
    relation = con.sql(centroid_clusters())
    assert sorted(relation.columns) == sorted(got.columns)
    rows = Counter(tuple(dict(zip(relation.columns, r))[c] for c in got.columns) for r in relation.fetchall())
    assert rows_of(got) == rows
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert rows_of(got) == brute_clusters(table)
