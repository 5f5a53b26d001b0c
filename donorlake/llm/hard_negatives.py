"""Hard negatives of anchor rows from lists shared by clusters of anchors (after MAXIMUS).

Anchors of a chunk are clustered by direction. For a cluster with centroid c and
half-angle t, every row i of a block has the angle a to c, and no member u of the
cluster scores above |u| |i| cos(max(0, a - t)) with it. A task sorts its block by
|i| cos(max(0, a - t)) once per cluster, and all members walk down that list in
strips: a member stops as soon as the bound of the next row is below its k-th best
score so far, which certifies that nothing of worth is left. Scores are exact
integers; only bounds are floating point, with a margin.

Two walks are needed: one for the positives (rows of the anchor's label), and one
for the negatives (rows of other labels whose score lies in a band that a positive
sets; an anchor has a band per positive, and all of them share one walk). Each
walk is first made over a sixteenth of the rows: its k-th best scores are safe
floors for the walk over all rows, so that tasks hand on few rows.

Equal vectors of one label are one class, with its k + 1 smallest ids, so a vector
that a third of all rows hold is scored once. Chunks of anchors have a bounded size
and one broadcast each; rows are never copied or shuffled for them.

Rows without vec_id or label and vectors that are NULL or hold NULL or non-finite
components take no part; of rows with the same vec_id the smallest (vector, label)
counts; a shorter vector counts as filled up with zeros; ties go to the smaller
vec_id; an anchor without another row of its label has no rows, and so has a
positive without a negative in its band; an empty table gives an empty result;
other columns are ignored. A score that doesn't fit a long fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlake.llm.text import written
from donorlake.llm.topk import _matrix, _product
from donorlake.operators.ordering import union_all

CHUNK = 2048  # anchor classes per broadcast
PER_CLUSTER = 32  # anchors of a cluster, about
BLOCK = 16_384  # rows that are sorted together
STRIP = 256  # rows a member walks at a time
SAMPLE = 16  # one in so many rows sets the floors
NONE = np.iinfo(np.int64).min // 4


def usable_rows(table: DataFrame, scale: int, relabel: Column | None = None) -> DataFrame:
    """``vec_id, v array<bigint>, label``: floor(scale · x) of every usable vector, one row per vec_id."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select("vec_id", "embedding", "label").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    ints = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))
    label = F.col("label") if relabel is None else relabel
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), ints.alias("v"), label.cast("bigint").alias("label"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.v", "r.label")


def clusters(vectors: np.ndarray, per_cluster: int = PER_CLUSTER, rounds: int = 5) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Anchors (rows of a bounded matrix) by direction: (members, unit centroid, half-angle) of every cluster."""
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.maximum(norms, 1e-300)[:, None]
    k = max(1, len(vectors) // per_cluster)
    centres = unit[np.random.default_rng(0).choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-300)[:, None], centres)
    nearest = (unit @ centres.T).argmax(axis=1)
    out = []
    for c in range(k):
        members = np.flatnonzero(nearest == c)
        if len(members):
            angle = np.arccos(np.clip(unit[members] @ centres[c], -1, 1)).max()
            out.append((members, centres[c], float(angle)))
    return out


class SharedLists:
    """Per anchor and band, the k best classes met so far; one per task."""

    def __init__(self, asked: dict, k: int):
        # asked: vectors (anchor by width), label, same (bool), low and high (anchor by band), cluster arrays
        self.asked, self.k = asked, k
        shape = (*asked["low"].shape, k)
        self.score, self.cid = np.full(shape, NONE), np.full(shape, np.iinfo(np.int64).max)
        self.norm = np.linalg.norm(asked["vectors"].astype(np.float64), axis=1)

    def _take(self, members: np.ndarray, rows: np.ndarray, cid: np.ndarray, label: np.ndarray) -> None:
        """Score a strip with the members that still walk and keep the best of every band."""
        asked = self.asked
        score = _product(rows, asked["vectors"][members]).T
        alike = asked["label"][members][:, None] == label[None, :]
        score = np.where(alike == asked["same"], score, NONE)
        for band in range(asked["low"].shape[1]):
            low, high = asked["low"][members, band], asked["high"][members, band]
            mine = np.where((score >= np.maximum(low, NONE + 1)[:, None]) & (score <= high[:, None]), score, NONE)
            some = np.flatnonzero((mine >= self.score[members, band, -1:]).any(axis=1) & (mine > NONE).any(axis=1))
            if not len(some):
                continue
            who = members[some]
            s = np.concatenate([self.score[who, band], mine[some]], axis=1)
            c = np.concatenate([self.cid[who, band], np.broadcast_to(cid, (len(some), len(cid)))], axis=1)
            best = np.lexsort((c, -s), axis=1)[:, : self.k]
            self.score[who, band], self.cid[who, band] = np.take_along_axis(s, best, 1), np.take_along_axis(c, best, 1)

    def _needed(self, members: np.ndarray) -> np.ndarray:
        """The score below which a row is of no use to a member, over its bands."""
        return np.maximum(self.score[members, :, -1], self.asked["low"][members]).min(axis=1)

    def walk(self, rows: np.ndarray, cid: np.ndarray, label: np.ndarray) -> None:
        """All members of all clusters along a block of rows."""
        asked, size = self.asked, np.linalg.norm(rows.astype(np.float64), axis=1)
        unit = rows / np.maximum(size, 1e-300)[:, None]
        for members, centre, half in asked["clusters"]:
            angle = np.arccos(np.clip(unit @ centre, -1, 1))
            bound = size * np.cos(np.maximum(0, angle - half - 1e-7))
            order = np.argsort(-bound, kind="stable")
            for start in range(0, len(order), STRIP):
                reach = self.norm[members] * bound[order[start]]
                members = members[reach + 1e-6 * np.abs(reach) + 1 >= self._needed(members)]
                if not len(members):
                    break
                strip = order[start : start + STRIP]
                self._take(members, rows[strip], cid[strip], label[strip])

    def rows(self) -> pa.RecordBatch:
        a, b, at = np.nonzero(self.score > NONE)
        columns = [a.astype(np.int32), b.astype(np.int32), self.cid[a, b, at], self.score[a, b, at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "band", "cid", "score"])


def _walk(classes: DataFrame, asked: dict, k: int) -> DataFrame:
    """``a, band, cid, score``: the k best classes of every anchor and band, each task's first, then of all."""
    shared, width = classes.sparkSession.sparkContext.broadcast(asked), asked["vectors"].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SharedLists(shared.value, k)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                lists.walk(_matrix(piece.column(1), width), piece.column(0).to_numpy(), piece.column(2).to_numpy())
        yield lists.rows()

    best = Window.partitionBy("a", "band").orderBy(F.desc("score"), "cid")
    found = classes.select("cid", "v", "label").mapInArrow(run, "a int, band int, cid bigint, score bigint")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("a", "band", "cid", "score")


def best_in_bands(classes: DataFrame, asked: dict, k: int) -> DataFrame:
    """``a, band, cid, score`` over all classes, with the floors that a sample of them sets. Anchors and bands are of one chunk."""
    some = classes.where(F.pmod(F.xxhash64("cid"), F.lit(SAMPLE)) == 0)
    low = asked["low"].copy()
    floors = _walk(some, asked, k).groupBy("a", "band").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    found = floors.toArrow()  # at most one row per anchor of the chunk and band
    a, band, least = (found[c].to_numpy() for c in ("a", "band", "least"))
    low[a, band] = np.maximum(low[a, band], least)
    return written(_walk(classes, asked | {"low": low}, k), "negatives-walk")


def _bounds(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integer x with low · score <= 100 x <= high · score."""
    wide = score.astype(object)
    return (-((-low * wide) // 100)).astype(np.int64), ((high * wide) // 100).astype(np.int64)


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, chunk: int = CHUNK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors (vec_id, v, label)`` as from ``usable_rows``; ``anchors (vec_id)`` names rows of it. An anchor's positives
    are its best ``positives`` other rows of its label; the negatives of each are the best ``negatives`` rows of other
    labels that score ``low`` to ``high`` percent of the positive.
    """
    spark, keep = vectors.sparkSession, max(positives + 1, negatives)
    first_ids = Window.partitionBy("v", "label").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(first_ids)).where(F.col("r") <= keep)
    classes = few.groupBy("v", "label").agg(F.min("vec_id").alias("cid"), F.collect_list("vec_id").alias("ids"))
    classes = written(classes, "negatives-classes")
    asked = vectors.join(anchors.select("vec_id").distinct(), "vec_id").join(classes.select("v", "label", "cid"), ["v", "label"])
    asked = written(asked.select(F.col("vec_id").alias("anchor_id"), F.col("cid").alias("acid")), "negatives-anchors")
    wanted = asked.select(F.col("acid").alias("cid")).distinct()
    size, width = wanted.count(), classes.agg(F.max(F.size("v"))).first()[0] or 0
    chunks, done = -(-size // chunk), []
    for i in range(chunks):
        part = wanted.where(F.pmod(F.xxhash64("cid"), F.lit(chunks)) == i) if chunks > 1 else wanted
        rows = part.join(classes, "cid").select("cid", "v", "label").toArrow()  # a chunk
        if rows.num_rows:
            done.append(_mine_chunk(classes, rows, width, positives, negatives, low, high))
    if not done:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    near, far = union_all([d[0] for d in done]), union_all([d[1] for d in done])
    ids = classes.select("cid", "ids")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = asked.join(near.join(ids, "cid"), "acid").select("anchor_id", "acid", F.col("score").alias("positive_score"), F.explode("ids").alias("positive_id"))
    pairs = pairs.where("positive_id <> anchor_id").withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives).drop("p")
    ranked = Window.partitionBy("acid", "positive_score").orderBy(F.desc("score"), "negative_id")
    lists = far.join(ids, "cid").select("acid", "positive_score", "score", F.explode("ids").alias("negative_id"))
    lists = lists.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    out = pairs.join(lists.withColumnRenamed("score", "negative_score"), ["acid", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _mine_chunk(classes: DataFrame, rows: pa.Table, width: int, positives: int, negatives: int, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Best classes of the anchors' label (``acid, cid, score``), and of other labels per positive score."""
    spark = classes.sparkSession
    acid, label = rows["cid"].to_numpy(), rows["label"].to_numpy()
    vectors = _matrix(rows["v"].combine_chunks(), width)
    asked = {"vectors": vectors, "label": label, "clusters": clusters(vectors.astype(np.float64))}
    n = len(acid)
    open_low, open_high = np.full((n, 1), NONE), np.full((n, 1), np.iinfo(np.int64).max)
    near = best_in_bands(classes, asked | {"same": True, "low": open_low, "high": open_high}, positives + 1)
    scores = near.select("a", "score").distinct().toArrow()  # at most positives + 1 per anchor of the chunk
    a, s = scores["a"].to_numpy(), scores["score"].to_numpy()
    order = np.lexsort((s, a))
    a, s = a[order], s[order]
    band = np.arange(len(a)) - np.searchsorted(a, a)
    shape = (n, positives + 1)
    lows, highs, owner = np.full(shape, np.iinfo(np.int64).max), np.full(shape, NONE), np.zeros(shape, np.int64)
    lows[a, band], highs[a, band] = _bounds(s, low, high)
    owner[a, band] = s
    far = best_in_bands(classes, asked | {"same": False, "low": lows, "high": highs}, negatives)
    names = spark.createDataFrame([(i, int(c)) for i, c in enumerate(acid)], "a int, acid bigint")
    bands = spark.createDataFrame([(int(x), int(b), int(owner[x, b])) for x, b in zip(a, band)], "a int, band int, positive_score bigint")
    near = near.join(names, "a").select("acid", "cid", "score")
    far = far.join(bands, ["a", "band"]).join(names, "a").select("acid", "positive_score", "cid", "score")
    return near, far
