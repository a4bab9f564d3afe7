"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences. Each sentence has its own probability from a
linear model over hashed word features, and the bag's probability is their
noisy-or, ``1 - prod(1 - p_s)``. Only document labels train the model, so the
sentence probabilities also tell which sentences are to blame.

Training reads at most ``max_rows`` labelled rows (in the order of a hash of
the id) in one task; scoring reads every text and keeps one weight per word.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat
from math import expm1, log1p, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.llm.common import id_bucket, keyed_text

MAX_ROWS = 8_000
THRESHOLD = 0.3
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7)
MIN_DOCS = 4
EPOCHS = 150
RATE = 0.1
SPARSITY = 1e-4
CACHE = 1_000_000

# A-Z to lower case, sentence ends to newline, other ASCII but letters, digits
# and apostrophes to space; bytes of non-ASCII characters stay.
_ENDS = b".!?\n\r"
_TABLE = bytes(
    b + 32 if 65 <= b <= 90
    else 10 if b in _ENDS
    else b if b >= 128 or chr(b).isalnum() or b == 39
    else 32
    for b in range(256)
)


def sentences(text: str) -> list[list[bytes]]:
    """Words of each sentence; sentences without words are left out."""
    parts = text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n")
    return [words for part in parts if (words := part.split())]


def word_features(word: bytes) -> list[int]:
    """Hash buckets of the word and of its longer prefixes."""
    marked = [b"w" + word, *(b"p" + word[:k] for k in PREFIXES if len(word) > k)]
    return [h % BUCKETS for h in map(xxhash.xxh64_intdigest, marked, repeat(1))]


class _Weights(dict):
    """Word to weight, filled on demand; emptied when it outgrows ``CACHE``."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = float(self.weights[word_features(word)].sum())
        return value


def _softplus(z: float) -> float:
    return z + log1p(exp(-z)) if z > 0 else log1p(exp(z))


def bag_score(bag: list[list[bytes]], weight: _Weights, bias: float) -> float:
    """Noisy-or of the sentence probabilities; 0 for a bag without sentences."""
    get = weight.__getitem__
    return -expm1(-sum(_softplus(bias + sum(map(get, words))) for words in bag))


def fit(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights per bucket and the bias, by Adam on the bags' log loss.

    Without rows or with one class only, all weights are zero and the bias
    stands for "clean".
    """
    weights = np.zeros(BUCKETS, np.float64)
    y = np.asarray(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return weights, -12.0 if not y.sum() else 2.0
    vocabulary: dict[bytes, int] = {}
    tokens, sentence_at, bag_at, kept = [], [], [], []
    for text, label in zip(texts, y):
        bag = sentences(text)
        if not bag:
            continue
        kept.append(label)
        bag_at.append(len(sentence_at))
        for words in bag:
            sentence_at.append(len(tokens))
            tokens.extend(vocabulary.setdefault(w, len(vocabulary)) for w in words)
    y = np.array(kept)
    token = np.array(tokens, np.int64)
    sizes = np.diff(np.append(sentence_at, len(tokens)))
    of_sentence = np.repeat(np.arange(len(sizes)), sizes)
    bag_of = np.repeat(np.arange(len(bag_at)), np.diff(np.append(bag_at, len(sizes))))
    features = [word_features(w) for w in vocabulary]
    feature = np.concatenate([np.array(f) for f in features])
    of_word = np.repeat(np.arange(len(features)), [len(f) for f in features])
    used, feature = np.unique(feature, return_inverse=True)
    # features of fewer than MIN_DOCS documents keep weight zero
    word_docs = np.unique(bag_of[of_sentence] * len(features) + token) % len(features)
    common = np.bincount(feature, np.bincount(word_docs, minlength=len(features))[of_word]) >= MIN_DOCS
    w, bias = np.zeros(len(used)), -4.0
    moment, power = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, EPOCHS + 1):
        per_word = np.bincount(of_word, w[feature], len(features))
        z = np.bincount(of_sentence, per_word[token], len(sizes)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(bag_of, np.logaddexp(0, z), len(y))  # -log P(no toxic sentence)
        toxic = np.maximum(-np.expm1(-clean), 1e-9)
        # d loss / d z: p for a clean bag, -p * P(clean) / P(toxic) for a toxic one
        slope = p * np.where(y > 0, -np.exp(-clean) / toxic, 1.0)[bag_of] / len(y)
        by_word = np.bincount(token, slope[of_sentence], len(features))
        gradient = np.append(np.bincount(feature, by_word[of_word], len(used)) * common, slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        power = 0.999 * power + 0.001 * gradient**2
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
        w -= change[:-1]
        step_size = RATE * SPARSITY / (np.sqrt(power[:-1] / (1 - 0.999**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - step_size, 0)  # soft threshold
        bias -= change[-1]
    weights[used] = w
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, keep, max_rows: int = MAX_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Fit on the labelled rows whose id passes ``keep`` (a Column function).

    Labels are first reduced to one per id (1 if any row says 1; null ids and
    null labels are left out). ``max_rows`` bounds the rows read by the one
    training task and the broadcast id list.
    """
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(keep(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = keyed_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")  # at most max_rows ids

    def learn(batches):
        seen: dict[int, tuple[str, int]] = {}
        for batch in batches:
            for i, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                if i not in seen or text < seen[i][0]:  # one text per id, whatever the order
                    seen[i] = text, label
        ordered = [seen[i] for i in sorted(seen)]
        weights, bias = fit([t for t, _ in ordered], [y for _, y in ordered])
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"]
        )

    model = (
        rows.select("doc_id", "text", "toxic").repartition(1)
        .mapInArrow(learn, "weights binary, bias double").first()
    )
    return (np.frombuffer(bytes(model["weights"]), np.float64), model["bias"]) if model else fit([], [])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id",
          text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``(doc_id, score, n_sentences, worst_sentence, worst_score)`` per row, and ``text_key`` if ``keyed``.

    Null and empty texts have no sentence: their score is 0 and the worst
    sentence null. Repeated rows score alike. ``worst_sentence`` is the
    position (from 0) of the likeliest sentence, the first one on a tie.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def compute(batches):
        weights, bias = shared.value
        weight = _Weights(weights)
        get = weight.__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                z = [bias + sum(map(get, words)) for words in sentences(text)]
                top = max(z, default=None)
                rows.append((
                    -expm1(-sum(map(_softplus, z))), len(z),
                    None if top is None else z.index(top),
                    None if top is None else exp(-_softplus(-top)),
                ))
            total, n, worst, worst_p = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.float64()), pa.array(n, pa.int32()),
                 pa.array(worst, pa.int32()), pa.array(worst_p, pa.float64()), *batch.columns[2:]],
                names=["doc_id", "score", "n_sentences", "worst_sentence", "worst_score", *["text_key"] * keyed],
            )

    return keyed_text(docs, id_col, text_col, keyed).mapInArrow(
        compute, "doc_id long, score double, n_sentences int, worst_sentence int, worst_score double"
                 + ", text_key binary" * keyed
    )


def offending_sentences(text: str, model: tuple[np.ndarray, float], at_least: float = 0.5) -> list[str]:
    """The sentences of one text whose own probability reaches ``at_least``."""
    weight = _Weights(model[0])
    found = []
    for words in sentences(text):
        z = model[1] + sum(map(weight.__getitem__, words))
        if exp(-_softplus(-z)) >= at_least:
            found.append(b" ".join(words).decode("utf-8", "replace"))
    return found


def not_held_out(column, folds: int = 4, held: int = 2):
    """Training ids: crc32 of the id as text, mod ``folds``, is not ``held``."""
    return id_bucket(column, folds) != held


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame,
             keep: Callable = not_held_out, threshold: float = THRESHOLD, keyed: bool = False) -> DataFrame:
    """Train on ``labels`` and score all ``docs``: adds ``held_out`` and ``predicted``."""
    scored = score(docs, train(docs, labels, keep), keyed=keyed)
    return scored.select(
        "doc_id",
        (~keep(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_sentences", "worst_sentence", "worst_score", *["text_key"] * keyed,
    )
