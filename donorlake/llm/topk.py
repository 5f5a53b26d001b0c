"""Exact top-k search by inner product with a three-phase uniform threshold.

The components of a vector are cut into lists (blocks of dimensions); a row's
score is the sum of its partial scores over the lists.

1. Every task keeps the best partial scores of its rows per query and list.
   The best of each list over all tasks are gathered, and the rows in them get
   their exact scores. The k-th best of those is a safe cutoff T: no row below
   it can be among the first k.
2. With U_j the best partial score of list j, a row that reaches T is at most
   S = ΣU_j − T below the best in all lists together, so at most S / lists
   below it in one list at least. This uniform threshold is broadcast and a
   task takes all entries at or above it. Lists where a row did not show up
   bound its missing part; rows whose bound is under T go, in their task.
3. The rest is joined to its vectors, and missing partial scores are resolved.

Queries go in chunks of bounded size (one broadcast each); rows are scanned
once per chunk and phase and never copied or shuffled for it. Equal vectors
are one class: it stands in the search once, with its k + 1 smallest ids, so a
vector held by a third of all rows doesn't tie with itself at each of them.

Rows: vectors that are NULL or hold NULL or non-finite components, and rows
without vec_id, take no part; of rows with the same vec_id the smallest vector
counts; a shorter vector counts as filled up with zeros; ties go to the
smaller vec_id; an empty table gives an empty result; other columns are
ignored. A score that doesn't fit a long fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorlake.llm.text import map_rows, written
from donorlake.operators.ordering import union_all

CHUNK = 2048  # query classes per broadcast
LISTS = 2


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v array<bigint>``: floor(scale · x) of every usable vector, one row per vec_id."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(usable)
    ints = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a slice as a matrix, filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), np.int64)
    out[np.arange(width)[None, :] < ends[:, None]] = flat
    return out


def _product(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products, row by query."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return rows @ queries.T
    wide = rows.astype(object) @ queries.T.astype(object)
    if any(abs(x) >= 2**63 for x in wide.ravel()):
        raise OverflowError("a score does not fit a long")
    return wide.astype(np.int64)


def _cuts(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _local_lists(classes: DataFrame, chunk, k: int, cuts: list[slice], width: int) -> DataFrame:
    """Phase 1 in a task: its k best partial scores per query and list, ``q, list, cid, part``."""
    names = ["q", "list", "cid", "part"]

    def run(batches):
        queries = chunk.value
        best = [(np.empty((0, len(queries)), np.int64), np.empty((0, len(queries)), np.int64)) for _ in cuts]
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                piece = batch.slice(start, 4096)
                rows, cid = _matrix(piece.column(1), width), piece.column(0).to_numpy()
                for j, cut in enumerate(cuts):
                    part = np.concatenate([best[j][0], _product(rows[:, cut], queries[:, cut])])
                    ids = np.concatenate([best[j][1], np.broadcast_to(cid[:, None], (len(cid), len(queries)))])
                    if len(part) > k:
                        top = np.argpartition(-part, k - 1, axis=0)[:k]
                        part, ids = np.take_along_axis(part, top, 0), np.take_along_axis(ids, top, 0)
                    best[j] = part, ids
        for j, (part, ids) in enumerate(best):
            if len(part):
                q = np.broadcast_to(np.arange(len(queries), dtype=np.int32), part.shape)
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (q, np.full(part.shape, j, np.int32), ids, part)], names=names)

    return classes.select("cid", "v").mapInArrow(run, "q int, list int, cid bigint, part bigint")


def _reaching(classes: DataFrame, chunk, limits, cuts: list[slice], width: int) -> DataFrame:
    """Phase 2 in a task: ``q, cid`` of the rows whose entries at or above the uniform threshold, with the missing parts at
    their most, reach the cutoff. All entries of a row lie in its task, so only such pairs leave it."""

    def work():
        def each(batch: pa.RecordBatch):
            rows, cid, queries = _matrix(batch.column(1), width), batch.column(0).to_numpy(), chunk.value
            floors, cutoff = limits.value
            parts, below = [_product(rows[:, cut], queries[:, cut]) for cut in cuts], floors - 1
            if sum(int(p.max(initial=0)) for p in parts) - sum(int(b.min(initial=0)) for b in below.T) >= 2**62:
                parts, below, cutoff = [p.astype(object) for p in parts], below.astype(object), cutoff.astype(object)
            over = sum(np.where(p > low, p - low, 0) for p, low in zip(parts, below.T))
            r, q = np.nonzero((over > 0) & (over >= cutoff - below.sum(axis=1)))
            return [pa.array(q.astype(np.int32)), pa.array(cid[r])]

        return each

    return map_rows(classes, ["cid", "v"], "q int, cid bigint", work, step=2048)


def _exact(pairs: DataFrame, classes: DataFrame, chunk, width: int) -> DataFrame:
    """``q, cid, score`` with the missing partial scores resolved from the vectors. ``pairs`` are distinct."""

    def work():
        def each(batch: pa.RecordBatch):
            q, rows = batch.column(0).to_numpy(), _matrix(batch.column(2), width)
            queries = chunk.value[q]
            if int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, width) >= 2**63:
                score = np.array([int(_product(a[None], b[None])[0, 0]) for a, b in zip(rows, queries)], np.int64)
            else:
                score = (rows * queries).sum(axis=1)
            return [batch.column(0), batch.column(1), pa.array(score)]

        return each

    # Both sides look small: Spark knows neither how many pairs a task makes nor that vectors are packed in their file.
    return map_rows(pairs.join(classes.hint("merge"), "cid"), ["q", "cid", "v"], "q int, cid bigint, score bigint", work, step=4096)


def _chunk_top(classes: DataFrame, qcid: list[int], queries: np.ndarray, k: int, lists: int) -> DataFrame:
    """The k best classes of every query class of one chunk: ``qcid, cid, score``."""
    spark, width = classes.sparkSession, queries.shape[1]
    cuts = _cuts(width, lists)
    chunk = spark.sparkContext.broadcast(queries)
    in_list = Window.partitionBy("q", "list").orderBy(F.desc("part"), "cid")
    gathered = _local_lists(classes, chunk, k, cuts, width).withColumn("r", F.row_number().over(in_list)).where(F.col("r") <= k)
    gathered = written(gathered, "topk-lists")
    first = _exact(gathered.select("q", "cid").distinct(), classes, chunk, width)
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    ranked = first.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k)
    cutoff = ranked.groupBy("q").agg(F.min("score").alias("t"), F.count(F.lit(1)).alias("n"))
    best = gathered.where("r = 1").select("q", "list", "part")
    top = np.zeros((len(queries), lists), np.int64)
    for row in best.collect():  # one row per query of the chunk and list
        top[row["q"], row["list"]] = row["part"]
    safe = np.full(len(queries), np.iinfo(np.int64).min // 4)
    for row in cutoff.collect():
        if row["n"] >= k:  # with fewer rows than k, all are wanted
            safe[row["q"]] = row["t"]
    floor = top - ((top.sum(axis=1) - safe) // lists)[:, None]
    limits = spark.sparkContext.broadcast((floor, safe))
    wanted = _reaching(classes, chunk, limits, cuts, width)
    top_rows = _exact(wanted, classes, chunk, width).withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k)
    names = spark.createDataFrame([(i, int(c)) for i, c in enumerate(qcid)], "q int, qcid bigint")
    return written(top_rows.join(names, "q").select("qcid", "cid", "score"), "topk-chunk")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = LISTS, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of ``vectors (vec_id, v)`` for each query row.

    ``queries (vec_id)`` names rows of ``vectors``.
    """
    spark = vectors.sparkSession
    first_ids = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(first_ids)).where(F.col("r") <= k + 1)
    classes = few.groupBy("v").agg(F.min("vec_id").alias("cid"), F.collect_list("vec_id").alias("ids"))
    classes = written(classes, "topk-classes")
    # The hints: packed vectors look several times smaller than they are, and would be broadcast.
    asked = vectors.join(queries.select("vec_id").distinct(), "vec_id").join(classes.select("v", "cid").hint("merge"), "v")
    asked = written(asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qcid")), "topk-queries")
    wanted = asked.select(F.col("qcid").alias("cid")).distinct()
    size = wanted.count()
    width = classes.agg(F.max(F.size("v"))).first()[0] or 0
    chunks = -(-size // chunk)
    parts = []
    for i in range(chunks):
        mine = wanted.where(F.pmod(F.xxhash64("cid"), F.lit(chunks)) == i) if chunks > 1 else wanted
        rows = F.broadcast(mine).join(classes, "cid").select("cid", "v").toArrow()
        if rows.num_rows:
            vecs = _matrix(rows.column("v").combine_chunks(), width)
            parts.append(_chunk_top(classes, rows.column("cid").to_pylist(), vecs, k + 1, lists))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    best = union_all(parts).join(classes.select("cid", "ids").hint("merge"), "cid")
    pairs = asked.join(best, "qcid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
