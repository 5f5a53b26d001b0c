"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed features: words, their stems (first four
and five bytes), pairs of neighbours, and pairs with one word between them. FTRL-proximal learns one document at a time
with a rate of its own for every coordinate; the L1 term keeps a weight at zero
until its feature has shown enough evidence, so the model is a short list of
(feature, weight) that is broadcast to score every whole text where it lies.

Labels come from at most ``max_rows`` training rows, those with the smallest
hashes of their doc_id (a documented bound of the fit); held-out rows, lang,
source and doc_id are never inputs.

Rows: a NULL or empty text has no features and gets the score of the bias;
NULL labels are left out of the fit; several labels of one doc_id count as
several rows; repeated rows get repeated results; a NULL doc_id is never
learnt from and its ``held_out`` is false; without labels every score is 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.text import WordTable, crc_fold, dropped, hash_sample, map_rows, mixed, one_text, written

BITS = 22
STEMS = (4, 5)  # bytes of a word's beginning that count as its stem
MAX_ROWS = 8_000
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))  # ASCII case and marks


def hashers() -> WordTable:
    """Hashes of whole words and of their stems, for one task."""
    stem = lambda n: lambda w: xxhash.xxh3_64_intdigest(w[:n], n)
    return WordTable(xxhash.xxh3_64_intdigest, *[stem(n) for n in STEMS])


def features(words: list[bytes], hashes: WordTable, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of a document's words; 0 is the bias."""
    numbers = hashes(words)
    h, once = hashes.column(0, numbers), np.unique(numbers)
    with np.errstate(over="ignore"):
        kinds = [h, *[hashes.column(k, once) for k in (1, 2)], h[:-1] * np.uint64(3) + h[1:] * np.uint64(5), h[:-2] * np.uint64(7) + h[2:] * np.uint64(11)]
        found = np.unique((mixed(np.concatenate(kinds)) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate([np.zeros(1, np.int32), found[found > 0]])


def _document_features(docs: DataFrame, columns: list[str], bits: int) -> DataFrame:
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", idx binary"

    def work():
        hashes = hashers()

        def each(batch: pa.RecordBatch):
            idx = [features(plain_words(t), hashes, bits).tobytes() for t in batch.column(len(columns)).to_pylist()]
            return [*batch.columns[: len(columns)], pa.array(idx, pa.binary())]

        return each

    return map_rows(docs, [*columns, "text"], schema, work)


def plain_words(text: str | None) -> list[bytes]:
    """Words in ASCII lower case, parted at white space and ASCII marks."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


@dataclass
class Ftrl:
    """FTRL-proximal state of a logistic model over binary features."""

    bits: int = BITS
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0

    def __post_init__(self):
        self.z, self.n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        l1 = np.where(idx == 0, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, idx: np.ndarray, label: int) -> None:
        w = self.weights(idx)
        g = sigmoid(w.sum()) - label
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        idx = np.flatnonzero(self.n)
        w = self.weights(idx)
        return idx[w != 0].astype(np.int32), w[w != 0].astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``doc_id, text, y`` of the training rows with the smallest hashes, ``max_rows`` at most: one for each doc_id and label."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(crc_fold() != 0)
    picked = hash_sample(known, ["doc_id", "y"], max_rows)
    return one_text(docs, picked, ["doc_id"]).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, epochs: int = 3, bits: int = BITS):
    """Sparse weights (feature, weight) learnt from the labelled sample, in another fixed order in every epoch.

    The sample's features are written once and stream through the learner one partition at a time.
    """
    rows = written(_document_features(labelled_sample(docs, labels, label, max_rows), ["doc_id", "y"], bits), "sample-features")
    model = Ftrl(bits)
    for epoch in range(epochs):
        order = [F.xxhash64("doc_id", F.lit(epoch)), "doc_id", "y", F.xxhash64("idx")]
        for row in rows.orderBy(*order).select("y", "idx").toLocalIterator():
            model.learn(np.frombuffer(row["idx"], np.int32), row["y"])
    dropped(rows)
    return model.sparse()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work():
        hashes, dense = hashers(), np.zeros(1 << bits, np.float32)
        dense[shared.value[0]] = shared.value[1]

        def each(batch: pa.RecordBatch):
            s = [sigmoid(float(dense[features(plain_words(t), hashes, bits)].sum(dtype=np.float64))) for t in batch.column(1).to_pylist()]
            return [batch.column(0), pa.array(s, pa.float64())]

        return each

    scored = map_rows(docs, ["doc_id", "text"], "doc_id bigint, score double", work)
    held_out = F.coalesce(crc_fold() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows=max_rows))

    @F.pandas_udf("boolean")
    def clean(texts):
        hashes, dense = hashers(), np.zeros(1 << BITS, np.float32)
        dense[shared.value[0]] = shared.value[1]
        return texts.map(lambda t: float(dense[features(plain_words(t), hashes)].sum(dtype=np.float64)) < 0.0)

    return docs.where(clean(F.col("text")))
