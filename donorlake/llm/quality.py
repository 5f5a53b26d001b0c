"""Quality scores: random-indexing word vectors, pooled per document, in a small calibrated network.

Random indexing gives every token a sparse random index vector (a few +1 and
−1 drawn from its hash) and adds up, over the whole corpus, the index vectors of
its neighbours: its context vector. Tokens are the words and their shapes
(upper case, lower case, digits and marks, repeats folded); both are hashed into
a fixed number of rows, so the table of vectors has a fixed size and can be
broadcast, and every task adds its counts up before one small shuffle.

A document is the mean of its tokens' vectors, for words and for shapes, with
their spread and two counts. A network with one hidden layer, written in numpy,
learns from at most ``max_rows`` labelled training rows (those with the smallest
hashes of doc_id, a documented bound); a quarter of them is kept back to fit the
temperature that calibrates its probabilities. Held-out rows, lang, source and
doc_id are never inputs.

Rows: a NULL or empty text pools to zeros and gets a score like any other; NULL
labels are left out; a NULL doc_id is never learnt from and its ``held_out`` is
false; repeated rows get repeated results; without labels every score is 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.text import Shared, WordTable, crc_fold, map_rows, mixed, split_words
from donorlake.llm.toxicity import labelled_sample, sigmoid

ROWS = 1 << 13  # rows of the vector table; shapes take the last eighth
SHAPE_ROWS = ROWS // 8
DIM = 32
NONZERO = 4  # entries of an index vector
REACH = 2  # neighbours on either side
BLOCK = 256  # table rows sent at a time
FAN_IN = 256  # tasks whose sums are added up at once
MAX_ROWS = 12_000
_KINDS = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)


_REPEATS = regex.compile(rb"(.)\1+", regex.DOTALL)


def shape(word: bytes) -> bytes:
    """``A`` for capitals, ``a`` for other letters, ``0`` for digits, marks as they are; repeats folded."""
    return _REPEATS.sub(rb"\1", word.translate(_KINDS))[:12]


class Tokens:
    """Table rows of the words and shapes of a text, alternating."""

    def __init__(self):
        digest = xxhash.xxh3_64_intdigest
        self.rows = WordTable(lambda w: digest(w) % (ROWS - SHAPE_ROWS), lambda w: digest(shape(w)) % SHAPE_ROWS + ROWS - SHAPE_ROWS)

    def __call__(self, text: str | None) -> np.ndarray:
        numbers = self.rows(split_words(text))
        out = np.empty(2 * len(numbers), np.int64)
        out[0::2], out[1::2] = self.rows.column(0, numbers), self.rows.column(1, numbers)
        return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per table row: the positions of its index vector's entries and their signs."""
    with np.errstate(over="ignore"):
        h = mixed(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(0x5EED)).reshape(ROWS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def context_counts(docs: DataFrame) -> DataFrame:
    """``block, body``: sums of neighbours' index vectors for each block of table rows, over all documents."""

    def run(batches):
        tokens, (places, signs) = Tokens(), index_vectors()
        table = np.zeros(ROWS * DIM)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                # A gap between documents keeps them from being neighbours.
                parts = [x for t in batch.column(0).slice(start, 1024).to_pylist() for x in (tokens(t), np.full(REACH, -1))]
                ids = np.concatenate(parts)
                for at in range(0, len(ids), 1 << 18):
                    piece = ids[max(0, at - REACH) : at + (1 << 18)]
                    fresh = min(at, REACH)  # pairs that end before were counted with the piece before
                    for gap in range(1, REACH + 1):
                        a, b = piece[max(0, fresh - gap) : -gap], piece[max(0, fresh - gap) + gap :]
                        both = (a >= 0) & (b >= 0)
                        for x, y in ((a[both], b[both]), (b[both], a[both])):
                            for e in range(NONZERO):
                                table += np.bincount(x * DIM + places[y, e], signs[y, e], minlength=ROWS * DIM)
        cells = table.reshape(-1, BLOCK * DIM).astype(np.int32)
        used = np.flatnonzero(cells.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([cells[i].tobytes() for i in used], pa.binary())], names=["block", "body"]
        )

    def add(kind):
        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(BLOCK * DIM, np.int64)
            for body in pdf["body"]:
                out += np.frombuffer(body, kind)
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "body": [out.tobytes()]})

        return total

    # Sums of up to FAN_IN tasks first, so that what meets for a block stays small however many tasks there are.
    parts = docs.select("text").mapInArrow(run, "block int, body binary").withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
    some = parts.groupBy("block", "part").applyInPandas(add(np.int32), "block int, body binary")
    return some.groupBy("block").applyInPandas(add(np.int64), "block int, body binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors: unit context vector plus unit index vector."""
    total = np.zeros((ROWS, DIM))
    for row in context_counts(docs).collect():  # ROWS / BLOCK rows of fixed size
        total.reshape(-1, BLOCK * DIM)[row["block"]] = np.frombuffer(row["body"], np.int64)
    places, signs = index_vectors()
    own = np.zeros((ROWS, DIM))
    np.add.at(own, (np.repeat(np.arange(ROWS), NONZERO), places.ravel()), signs.ravel())
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centred = unit(total) - unit(total)[total.any(axis=1)].mean(axis=0) if total.any() else total
    return (unit(own) + centred).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word and of the shape vectors, and two counts."""
    if not len(ids):
        return np.zeros(4 * DIM + 2, np.float32)
    out = []
    for part in (ids[0::2], ids[1::2]):
        total, squares = np.zeros(DIM), np.zeros(DIM)
        for at in range(0, len(part), 1 << 16):
            v = vectors[part[at : at + (1 << 16)]]
            total += v.sum(axis=0)
            squares += np.einsum("ij,ij->j", v, v)
        mean = total / len(part)
        out += [mean, np.sqrt(np.maximum(squares / len(part) - mean * mean, 0.0))]
    words = ids[0::2]
    return np.concatenate([*out, [np.log1p(len(words)), len(np.unique(words)) / len(words)]]).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0.0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the cross-entropy in a fixed order; the temperature comes from the rows that were kept back."""
    width = x.shape[1]
    if not len(x):
        return Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept, learn = (order[: len(x) // 4], order[len(x) // 4 :])
    mean, scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-3
    z, t = (x[learn] - mean) / scale, y[learn].astype(np.float64)
    params = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        shuffled = rng.permutation(len(z))
        for at in range(0, len(z), 128):
            pick = shuffled[at : at + 128]
            a = z[pick] @ params[0] + params[1]
            h = np.maximum(a, 0.0)
            g = (sigmoid(h @ params[2] + params[3]) - t[pick]) / len(pick)
            back = np.outer(g, params[2]) * (a > 0)
            grads = [z[pick].T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            step += 1
            now = rate * (1 - epoch / epochs)
            for p, g_, m, v in zip(params, grads, first, second):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *params[:3], float(params[3][0]))
    if len(kept):
        logits, t = net.logit(x[kept]), y[kept]
        grid = np.geomspace(0.25, 8.0, 61)
        loss = [np.mean(np.logaddexp(0.0, logits / c) - t * logits / c) for c in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def pooled_documents(docs: DataFrame, vectors, columns: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def work():
        tokens = Tokens()
        return lambda batch: [
            *batch.columns[: len(columns)],
            pa.array([pooled(tokens(t), vectors.value).tobytes() for t in batch.column(len(columns)).to_pylist()], pa.binary()),
        ]

    return map_rows(docs, [*columns, "text"], ", ".join(f"{c} {kinds[c]}" for c in columns) + ", x binary", work)


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs))
    rows = pooled_documents(labelled_sample(docs, labels, label, max_rows), vectors, ["doc_id", "y"]).toArrow()
    order = np.lexsort((rows["y"].to_numpy(), rows["doc_id"].to_numpy())) if rows.num_rows else np.empty(0, int)
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, 4 * DIM + 2)[order].astype(np.float64)
    shared = Shared(docs.sparkSession, (vectors.value, train(x, rows["y"].to_numpy()[order])))

    def work():
        tokens = Tokens()

        def each(batch: pa.RecordBatch):
            table, net = shared.value
            x = np.stack([pooled(tokens(t), table) for t in batch.column(1).to_pylist()])
            return [batch.column(0), pa.array(net.score(x.astype(np.float64)))]

        return each

    scored = map_rows(docs, ["doc_id", "text"], "doc_id bigint, score double", work)
    held_out = F.coalesce(crc_fold() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
