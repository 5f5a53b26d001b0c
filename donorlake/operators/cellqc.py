"""Per-cell and per-gene quality, normalisation, variable genes, rank tokens, PCA and neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlake.functions.scalars import is_mito
from donorlake.operators import subspace
from donorlake.operators.ordering import quantiles, union_all, with_group_totals
from donorlake.session import dropped, durable, task_slots, written

# QC thresholds, target sums and the token budget.
MIN_GENES, MAX_GENES, MIN_CELLS, MAX_PCT_MITO = 200, 6000, 3, 20.0
NORMALISE_TO = 1e4
N_VARIABLE_GENES = 2000
N_MEAN_BINS = 20
MAX_TOKENS = 2048
SORTED_ROWS = 100_000  # entries of a gene that one task sorts at most


def cell_gene_sums(counts: DataFrame) -> DataFrame:
    """One row per (cell, gene): repeated entries are added."""
    return counts.groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))


def mito_genes(genes: DataFrame, symbol: str = "gene_symbol", prefix: str = "MT-") -> DataFrame:
    return genes.withColumn("is_mito", is_mito(symbol, prefix))


def mito_summary(genes: DataFrame, flag: str = "is_mito") -> DataFrame:
    return genes.agg(
        F.count(F.lit(1)).alias("total_genes"), F.count_if(flag).alias("mito_genes"), F.count_if(~F.col(flag)).alias("non_mito_genes")
    )


def cell_metrics(sums: DataFrame, genes: DataFrame, flag: str = "is_mito") -> DataFrame:
    """Detected genes, total counts and mitochondrial percentage of every cell with counts."""
    rows = sums.join(genes.select("gene_id", flag), "gene_id", "left")  # a gene that the table lacks counts, but not as mitochondrial
    m = rows.groupBy("cell_id").agg(
        F.count_if(F.col("value") > 0).alias("n_genes_by_counts"), F.sum("value").alias("total_counts"),
        F.coalesce(F.sum(F.when(F.col(flag), F.col("value"))), F.lit(0.0)).alias("_mt"),
    )
    pct = F.when(F.col("total_counts") > 0, 100.0 * F.col("_mt") / F.col("total_counts")).otherwise(F.lit(0.0))
    return m.select("cell_id", "n_genes_by_counts", "total_counts", pct.alias("pct_counts_mt"))


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("value").alias("n_counts"))


def cells_per_gene(sums: DataFrame) -> DataFrame:
    return sums.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_cells"))


def qc_filter(
    sums: DataFrame, genes: DataFrame, min_genes: int = MIN_GENES, max_genes: int = MAX_GENES,
    min_cells: int = MIN_CELLS, max_pct_mito: float = MAX_PCT_MITO, flag: str = "is_mito",
) -> tuple[DataFrame, DataFrame]:
    """Kept (cell, gene, value) rows and the kept cells' metrics.

    In this order: cells by detected genes, then genes by remaining cells, then
    cells by mitochondrial share of what remains.
    """
    detected = sums.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("_g"))
    rows = sums.join(detected.where(F.col("_g").between(min_genes, max_genes)).select("cell_id"), "cell_id", "left_semi")
    rows = rows.join(cells_per_gene(rows).where(F.col("n_cells") >= min_cells).select("gene_id"), "gene_id", "left_semi")
    metrics = cell_metrics(rows, genes, flag).where(F.col("pct_counts_mt") < max_pct_mito)
    return rows.join(metrics.select("cell_id"), "cell_id", "left_semi"), metrics


def qc_summary(cells_before: DataFrame, genes_before: DataFrame, kept: DataFrame) -> DataFrame:
    """Cells and genes before and after QC."""
    n = lambda df, stage, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), F.lit(what).alias("what"), "n")
    return (
        n(cells_before, "before", "cells")
        .unionByName(n(genes_before, "before", "genes"))
        .unionByName(n(kept.select("cell_id").distinct(), "after", "cells"))
        .unionByName(n(kept.select("gene_id").distinct(), "after", "genes"))
    )


def normalize_log1p(sums: DataFrame, target: float = NORMALISE_TO) -> DataFrame:
    """Counts, counts scaled to ``target`` per cell, and their log1p, as three columns."""
    totals = sums.groupBy("cell_id").agg(F.sum("value").alias("_t"))
    scaled = F.try_divide(F.col("value") * target, F.col("_t"))
    return sums.join(totals, "cell_id").withColumns({"normalized": scaled, "log_normalized": F.log1p(scaled)}).drop("_t")


def gene_dispersion(normalized: DataFrame, n_cells: int | Column, value: str = "normalized", genes: DataFrame | None = None) -> DataFrame:
    """Mean and sample variance per gene over all cells (absent rows are zeros), log1p mean and log dispersion.

    ``genes`` adds the genes no cell expresses: they widen the range of means but have no dispersion.
    """
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    v = F.col(value)
    s = normalized.groupBy("gene_id").agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    if genes is not None:
        s = genes.select("gene_id").join(s, "gene_id", "left").fillna({"_s": 0.0, "_q": 0.0})
    mean = F.col("_s") / n
    var = (F.col("_q") - n * mean * mean) / (n - 1)
    s = s.select("gene_id", mean.alias("mean"), F.greatest(var, F.lit(0.0)).alias("variance"))
    ratio = F.col("variance") / F.when(F.col("mean") == 0, F.lit(1e-12)).otherwise(F.col("mean"))
    return s.withColumns({"log_mean": F.log1p("mean"), "dispersion": F.ln(F.nullif(ratio, F.lit(0.0)))})


def highly_variable(dispersion: DataFrame, n_top: int = N_VARIABLE_GENES, bins: int = N_MEAN_BINS) -> DataFrame:
    """Dispersion z-scored inside equal-width bins of the log mean; exactly ``n_top`` genes flagged.

    A bin with one gene scores it 1 (its own dispersion is the bin's spread).
    The gene table is written once, so the counts behind it are read only once.
    """
    dispersion = durable(dispersion)
    ends = dispersion.agg(F.min("log_mean").alias("_lo"), F.max("log_mean").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.ceil(F.try_divide(F.col("log_mean") - F.col("_lo"), width)) - 1
    rows = with_group_totals(dispersion, ends, []).withColumn(
        "bin", F.coalesce(F.least(F.greatest(slot, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")
    )
    stats = rows.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_sd"))
    z = F.try_divide(F.col("dispersion") - F.col("_m"), F.col("_sd"))
    score = F.when(F.col("dispersion").isNotNull(), F.when(F.col("_sd").isNull(), F.lit(1.0)).otherwise(z))
    scored = rows.join(stats, "bin").withColumn("dispersion_norm", score).drop("_lo", "_hi", "_m", "_sd")
    top = scored.where(F.col("dispersion_norm").isNotNull()).orderBy(F.desc("dispersion_norm"), "gene_id").limit(n_top)
    flags = top.select("gene_id", F.lit(True).alias("highly_variable"))
    return scored.join(flags, "gene_id", "left").fillna({"highly_variable": False})


def gene_medians(sums: DataFrame, target: float = NORMALISE_TO) -> DataFrame:
    """Exact median of each gene's non-zero normalised value, for rank tokens.

    A gene of up to ``SORTED_ROWS`` entries is sorted by one task; entries of larger ones are spread over their values' prefixes.
    """
    nonzero = normalize_log1p(sums, target).where(F.col("normalized") > 0).select("gene_id", "normalized")
    large = sums.groupBy("gene_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SORTED_ROWS).select("gene_id")
    gene = Window.partitionBy("gene_id")
    middle = (F.count(F.lit(1)).over(gene) - 1) / 2.0
    ranked = nonzero.join(large, "gene_id", "left_anti").withColumns({"_at": F.row_number().over(gene.orderBy("normalized")) - 1, "_middle": middle})
    at = lambda side: F.max(F.when(F.col("_at") == side("_middle"), F.col("normalized")))
    ends = ranked.where((F.col("_at") == F.floor("_middle")) | (F.col("_at") == F.ceil("_middle")))
    ends = ends.groupBy("gene_id").agg(at(F.floor).alias("_lo"), at(F.ceil).alias("_hi"), F.max(F.col("_middle") - F.floor("_middle")).alias("_share"))
    few = ends.select("gene_id", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")).alias("median"))
    many = quantiles(nonzero.join(large, "gene_id", "left_semi"), "normalized", [0.5], by=["gene_id"]).withColumnRenamed("q0", "median")
    return few.unionByName(many)


def rank_tokens(sums: DataFrame, medians: DataFrame, max_len: int = MAX_TOKENS) -> DataFrame:
    """Genes of a cell by descending value over gene median, cut to the model's input size.

    Dividing by the cell total would not change the order inside a cell, so it
    is left out. The rank filter is pushed below the shuffle by Spark, so one
    huge cell sends at most ``max_len`` rows per task.
    """
    rows = sums.where(F.col("value") > 0).join(medians, "gene_id").withColumn("_v", F.col("value") / F.col("median"))
    w = Window.partitionBy("cell_id").orderBy(F.desc("_v"), "gene_id")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_len).select("cell_id", "position", "gene_id")


def token_sequences(tokens: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("position", "gene_id")))
    return tokens.groupBy("cell_id").agg(F.transform(pairs, lambda p: p["gene_id"]).alias("tokens"))


def embed(tokens: DataFrame, embed_fn: Callable[[pd.Series], Sequence], keep: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Apply a user's model to token sequences, one Arrow batch at a time; vectors come back as ``embedding``.

    The vectors are written once, so that the model and the ranking before it don't run again for every later step.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[list(keep)].copy()
            out["embedding"] = [list(map(float, v)) for v in embed_fn(pdf["tokens"])]
            yield out

    return durable(tokens.mapInPandas(run, f"{fields}, embedding array<double>"))


def pca(vectors: DataFrame, k: int, vector: str = "embedding", out: str = "components") -> DataFrame:
    """Scores on the first k principal components of the centred vectors; each component's largest entry is positive."""
    return subspace.scores(vectors, subspace.fit(vectors, k, vector), vector, out)


VISIT_ROWS = 4096  # rows of a frame that a task passes on


def _visit_frames(pdf: pd.DataFrame, i: np.ndarray, c: np.ndarray) -> Iterator[pd.DataFrame]:
    """Row ``i`` of the batch with pivot ``c``, in small frames: each visit carries the vector, up to one per row and pivot."""
    for start in range(0, len(i), VISIT_ROWS):
        rows = i[start : start + VISIT_ROWS]
        yield pd.DataFrame({"_id": pdf["_id"].to_numpy()[rows], "_v": pdf["_v"].to_numpy()[rows], "_c": c[start : start + VISIT_ROWS].astype("int32")})


def _stacked(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch as a matrix; all have the same length."""
    sizes = column.value_lengths()
    if column.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("a vector is NULL or of another length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Finds:
    """The k best references of some queries so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, distances: np.ndarray):
        self.ids, self.distances = ids, distances  # row by k, NaN where nothing was found yet

    def reach(self) -> np.ndarray:
        last = self.distances[:, -1]
        return np.where(np.isnan(last), np.inf, last)

    def add(self, i: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        """Takes in finds of rows ``i``."""
        rows, k = np.unique(i), self.ids.shape[1]
        old = ~np.isnan(self.distances[rows])
        at = np.concatenate([np.repeat(rows, k)[old.ravel()], i])
        new, far = np.concatenate([self.ids[rows][old], ids]), np.concatenate([self.distances[rows][old], distances])
        order = np.lexsort((new, far, at))
        at, new, far = at[order], new[order], far[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < k
        self.ids[at[first], place[first]], self.distances[at[first], place[first]] = new[first], far[first]


def _search(x: np.ndarray, own: np.ndarray, finds: _Finds, go: Callable, chunk: tuple, centre: np.ndarray, exclude_self: bool) -> None:
    """Compare some queries with the cells of a chunk that ``go(c, reach)`` names.

    Products of 32-bit floats tell which pairs may be near enough, with room for their rounding; those pairs are compared exactly.
    """
    vectors, ids, starts = chunk
    k, room = finds.ids.shape[1], np.float32(2.4e-7 * (x.shape[1] + 16))
    low, square = (x - centre).astype(np.float32), ((x - centre) ** 2).sum(axis=1)
    for c in range(len(starts) - 1):
        a, b = starts[c], starts[c + 1]
        reach = finds.reach()
        i = np.flatnonzero(go(c, reach))
        if a == b or not len(i):
            continue
        ref = vectors[a:b] - centre
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (ref**2).sum(axis=1)
            near = (-2 * low[i]) @ ref.astype(np.float32).T
            near += squares.astype(np.float32)[None, :]
            slack = room * (square[i] + squares.max())
            most = reach[i] ** 2 * (1 + 1e-6) + slack
            blank = np.flatnonzero(np.isinf(reach[i]))
            if len(blank):  # fewer than k found: nothing beyond the k-th of this cell is needed
                other = near[blank]
                if exclude_self:
                    other = np.where(own[i[blank]][:, None] == ids[a:b][None, :], np.inf, other)
                last = min(k, b - a) - 1
                most[blank] = np.partition(other, last, axis=1)[:, last] + square[i[blank]] + 2 * slack[blank]
            row, at = np.nonzero(~(near > (most - square[i] + slack).astype(np.float32)[:, None]))
        for s in range(0, len(row), 65_536):
            r, j = i[row[s : s + 65_536]], a + at[s : s + 65_536]
            far = np.sqrt(((vectors[j] - x[r]) ** 2).sum(axis=1))
            ok = np.isfinite(far) & (far <= finds.reach()[r])
            if exclude_self:
                ok &= own[r] != ids[j]
            if ok.any():
                finds.add(r[ok], ids[j[ok]], far[ok])


CHUNK_VALUES = 4_000_000  # values of reference vectors that a pass sends to the tasks, about


def _chunks(sizes: dict[int, int], rows: int) -> list[list[tuple[int, int, int]]]:
    """Cells in groups of about ``rows`` references, as ``(cell, part, parts)``; a larger cell is cut into parts."""
    out, room = [], 0
    for c, n in sorted(sizes.items()):
        parts = -(-n // rows)
        for part in range(parts):
            if room < n // parts or not out:
                out.append([])
                room = rows
            out[-1].append((c, part, parts))
            room -= n // parts
    return out


def knn(
    queries: DataFrame, references: DataFrame, k: int, key: str = "cell_id", vector: str = "embedding",
    block_rows: int = 512, exclude_self: bool = False, max_pivots: int = 256, chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """Exact k nearest neighbours ``(key, neighbor, distance, rank)`` by euclidean distance, ties to the smaller id.

    References belong to the nearest of at most ``max_pivots`` pivots. A query first searches its own pivot's cell;
    the distance of its k-th find bounds what it still needs, and by the triangle inequality it visits only cells
    whose nearest possible member can be within that bound. Cells go to the tasks in chunks of bounded size, one pass
    over the queries per chunk; queries stay where they are with their k finds, so a pass writes one row per query
    and no visit is ever stored or shuffled. ``block_rows`` queries are compared at a time.
    """
    kind, spark = dict(queries.dtypes)[key], queries.sparkSession
    slim = lambda df: df.select(F.col(key).alias("_id"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    q, r = slim(queries), slim(references)
    n_pivots = int(min(max_pivots, max(1, np.sqrt(references.count()))))
    chosen = [row["_v"] for row in r.orderBy(F.xxhash64("_id"), "_id").limit(n_pivots).collect()]  # max_pivots vectors
    w = Window.partitionBy("_id").orderBy("distance", "neighbor")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not chosen:
        return ranked(q.select("_id", F.col("_id").alias("neighbor"), F.lit(0.0).alias("distance")).where("false")).withColumnRenamed("_id", key)
    pivots = spark.sparkContext.broadcast(np.array(chosen))

    def distances(x: np.ndarray, which) -> np.ndarray:
        return np.stack([np.sqrt(((pivots.value[which] - row) ** 2).sum(axis=1)) for row in x])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_stacked(batch.column(1)), slice(None))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d.argmin(axis=1).astype("int32")), pa.array(d.min(axis=1))], names=["_id", "_v", "_c", "_d"])

    slots, assigned = task_slots(spark), f"_id {kind}, _v array<double>, _c int, _d double"
    r = written(r.mapInArrow(assign, assigned), "knn-references")
    cells = {row["_c"]: row for row in r.groupBy("_c").agg(F.max("_d").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    groups = _chunks({c: row["n"] for c, row in cells.items()}, max(1, chunk_values // max(1, len(chosen[0]))))
    home = np.zeros(len(chosen), int)  # the chunk that a query of each pivot takes first; later ones may hold other parts of its cell
    for g, group in reversed(list(enumerate(groups))):
        home[[c for c, _, _ in group]] = g
    blank = {"_near": F.array_repeat(F.col("_id"), k), "_far": F.array_repeat(F.lit(float("nan")), k)}
    placed = q.repartition(slots, "_id", "_v").mapInArrow(assign, assigned).drop("_d")
    placed = written(placed.withColumns(blank | {"_g": F.element_at(F.array(*[F.lit(int(g)) for g in home]), F.col("_c") + 1)}), "knn-queries")

    order = ["_id", "_v", "_c", "_near", "_far", "_g"]

    def passed(rows: DataFrame, g: int, first: bool) -> DataFrame:
        """The queries after chunk ``g``: those that begin there take their own cell and then the others (``first``), or all
        others take what they still need."""
        parts = {c: [p for x, p, _ in groups[g] if x == c] for c, _, n in groups[g] if n > 1}
        split = [(F.col("_c") == c) & F.pmod(F.xxhash64("_id", "_v"), F.lit(n)).isin(parts[c]) for c, n in {(c, n) for c, _, n in groups[g] if n > 1}]
        sent = r.where(reduce(or_, split, F.col("_c").isin([c for c, _, n in groups[g] if n == 1]))).select("_c", "_id", "_v").toArrow()
        names = np.array(sorted({c for c, _, _ in groups[g]}))
        at = sent.column(0).to_numpy()
        by_cell = np.argsort(at, kind="stable")
        bounds = np.append(np.searchsorted(at[by_cell], names), len(at))
        vectors = np.concatenate([_stacked(x) for x in sent.column(2).chunks if len(x)] or [np.empty((0, len(chosen[0])))])[by_cell]
        chunk = spark.sparkContext.broadcast((vectors, sent.column(1).to_numpy()[by_cell], bounds, names, np.array([cells[c]["radius"] for c in names])))
        del sent, vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, ids, bounds, names, radius = chunk.value
            centre = pivots.value.mean(axis=0)
            for batch in (b.slice(s, block_rows) for b in batches for s in range(0, b.num_rows, block_rows)):
                x, own, c, begins = _stacked(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), batch.column(5).to_numpy()
                found, d = _stacked(batch.column(3)), distances(x, names)
                finds = _Finds(found.astype(np.result_type(found, ids)), _stacked(batch.column(4)).copy())
                # A hair of slack for rounding: it can only add visits.
                near = lambda i, reach: d[:, i] - radius[i] <= reach * (1 + 1e-9) + 1e-9 * (1 + d[:, i])
                if first:
                    _search(x, own, finds, lambda i, reach: c == names[i], (vectors, ids, bounds), centre, exclude_self)
                    _search(x, own, finds, lambda i, reach: (c != names[i]) & near(i, reach), (vectors, ids, bounds), centre, exclude_self)
                else:
                    _search(x, own, finds, lambda i, reach: (begins != g) & near(i, reach), (vectors, ids, bounds), centre, exclude_self)
                ends = np.arange(0, len(x) * k + 1, k, dtype=np.int32)
                near_ids = pa.ListArray.from_arrays(ends, pa.array(finds.ids.ravel(), type=batch.column(3).type.value_type, from_pandas=True))
                far = pa.ListArray.from_arrays(ends, pa.array(finds.distances.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), near_ids, far, batch.column(5)], names=order)

        out = written(rows.mapInArrow(run, f"_id {kind}, _v array<double>, _c int, _near array<{kind}>, _far array<double>, _g int"), "knn-finds")
        chunk.destroy()
        return out

    parts = [passed(placed.where(F.col("_g") == g).select(*order), g, True) for g in range(len(groups))]
    dropped(placed)
    now = union_all(parts)
    for g in range(len(groups) if len(groups) > 1 else 0):
        before, now = parts, passed(now, g, False)
        dropped(*before)
        parts = [now]
    dropped(r)
    each = now.select("_id", F.explode(F.arrays_zip("_near", "_far")).alias("_f")).where(~F.isnan("_f._far"))
    return ranked(each.select("_id", F.col("_f._near").alias("neighbor"), F.col("_f._far").alias("distance"))).withColumnRenamed("_id", key)


def label_transfer(neighbors: DataFrame, labels: DataFrame, key: str = "cell_id", label: str = "label") -> DataFrame:
    """Majority label among a query's neighbours; ties go to the smallest label."""
    named = neighbors.join(labels.select(F.col(key).alias("neighbor"), label), "neighbor")
    votes = named.groupBy(key, label).agg(F.count(F.lit(1)).alias("_v"))
    best = F.min(F.struct((-F.col("_v")).alias("neg"), F.col(label).alias("lab"), F.col("_v").alias("v")))
    return votes.groupBy(key).agg(best.alias("_b"), F.sum("_v").alias("_n")).select(
        key, F.col("_b.lab").alias(label), (F.col("_b.v") / F.col("_n")).alias("vote_share")
    )


def qc_by_sample(cells: DataFrame, metrics: DataFrame, sample: str, doublet: str | None = None) -> DataFrame:
    """Cells, exact medians of the QC metrics and (where known) the doublet rate per sample."""
    rows = cells.join(metrics, "cell_id")
    aggs = [F.count(F.lit(1)).alias("n_cells")]
    if doublet:
        aggs.append(F.avg(F.col(doublet).cast("double")).alias("doublet_rate"))
    out = rows.groupBy(sample).agg(*aggs)
    names = ("n_genes_by_counts", "total_counts", "pct_counts_mt")
    long = rows.select(sample, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("_m"))
    medians = quantiles(long.select(sample, "_m.*"), "value", [0.5], by=[sample, "metric"])
    wide = medians.groupBy(sample).agg(*[F.max(F.when(F.col("metric") == c, F.col("q0"))).alias(f"median_{c}") for c in names])
    return out.join(wide, sample)


def distribution(cells: DataFrame, donor: str, field: str) -> DataFrame:
    """Cells per level of a field for each donor, as one sorted map column (levels, not cells, are collected)."""
    counts = cells.groupBy(donor, field).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(field), F.col("_n"))))
    return counts.groupBy(donor).agg(F.map_from_entries(entries).alias(f"{field}_distribution"))


def schema_audit(cells: DataFrame, genes: DataFrame, donor: str, group: str) -> DataFrame:
    """Matrix size and cells per patient, in one row."""
    per = cells.groupBy(donor).agg(F.count(F.lit(1)).alias("_n"), F.min(group).alias("_g"))
    out = per.agg(
        F.sum("_n").alias("n_obs"), F.count(F.lit(1)).alias("n_patients"), F.min("_n").alias("min_cells_per_patient"),
        F.max("_n").alias("max_cells_per_patient"), F.avg("_n").alias("mean_cells_per_patient"),
        F.countDistinct("_g").alias("n_groups"),
    )
    return out.withColumn("n_vars", genes.agg(F.count(F.lit(1)).alias("_n")).scalar())


def _picks(loads: Sequence[int], size: int, count: int) -> list[int]:
    """How many of ``count`` donors of one size every batch gets if each goes to the least loaded (ties: the first) batch.

    A batch takes its i-th donor at load + i · size, so the first ``count`` of these loads are the ones taken.
    """
    if size == 0:
        return [count if b == loads.index(min(loads)) else 0 for b in range(len(loads))]
    below = lambda level: [max(0, -((x - level) // size)) for x in loads]
    low, high = min(loads), max(loads) + size * count + 1  # the highest level with at most ``count`` loads below it
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    taken = below(low)
    left = count - sum(taken)
    for b, x in enumerate(loads):
        if left and x + taken[b] * size == low:
            taken[b], left = taken[b] + 1, left - 1
    return taken


def balanced_batches(donors: DataFrame, k: int, donor: str = "donor_id", size: str = "n_cells") -> DataFrame:
    """Deal donors, largest first (ties: the smaller id), each to the least loaded of k batches (ties: the first).

    Donors of one size are alike, so the driver only walks the distinct sizes with the k loads; which donor of a size takes
    which place follows from ranks. Sizes are whole numbers; NULL and negative ones fail.
    """
    from donorlake.operators.ordering import global_rank

    cells = F.col(size)
    checked = donors.withColumn("_size", F.when(cells.isNull() | (cells < 0), F.raise_error(F.lit("a size is NULL or negative"))).otherwise(cells.cast("bigint")))
    loads, places = [0] * k, []
    for row in checked.groupBy("_size").count().orderBy(F.desc("_size")).toLocalIterator():
        for b, n in enumerate(_picks(loads, row["_size"], row["count"])):
            if n:
                places.append((row["_size"], b, loads[b], n))
        for s, b, _, n in places[-k:]:
            if s == row["_size"]:
                loads[b] += s * n
    slots = donors.sparkSession.createDataFrame(places, "_size bigint, batch int, load bigint, n bigint")
    slots = slots.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    slots = slots.select("_size", "batch", (F.col("load") + F.col("_i") * F.col("_size")).alias("_at"), "_i")
    slots = global_rank(slots, ["_at", "batch", "_i"], by=["_size"], name="_rank").select("_size", "_rank", "batch")
    ranked = global_rank(checked, [F.asc(donor)], by=["_size"], name="_rank")
    return ranked.join(slots, ["_size", "_rank"]).drop("_size", "_rank")


def run_progress(log: DataFrame, order: str, done: str, seconds: str) -> DataFrame:
    """Running totals and running rate over a batch log."""
    from donorlake.operators.ordering import running_totals

    steps = running_totals(log, order, {"done": F.sum(done), "seconds": F.sum(seconds)})
    return steps.drop("total_done", "total_seconds").withColumn("rate", F.try_divide(F.col("cum_done").cast("double"), F.col("cum_seconds")))
