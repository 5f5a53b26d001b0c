"""Sparse cell-by-gene counts to donor-by-gene features.

Counts are long rows ``(cell_id, gene_id, value)`` and stay long: zeros are
absent, so every mean divides by the number of cells, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.operators.ordering import global_rank, with_group_totals

TASK_ROWS = 500_000  # counts that a task of the expressing fraction sorts and sums, about


def restrict_genes(counts: DataFrame, genes: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Keep counts of the given genes. Goes below every aggregate, so CPM totals are the restricted ones."""
    return counts.join(genes.select(gene), gene, "left_semi")


def restrict_cells(counts: DataFrame, cells: DataFrame, cell: str = "cell_id") -> DataFrame:
    return counts.join(cells.select(cell), cell, "left_semi")


def _per_cell(counts: DataFrame, cells: DataFrame, keys: list[str], cell: str, gene: str) -> DataFrame:
    """``*keys, gene, _v``: the sum of every (cell, gene) beside its cell's keys.

    Counts and cells are dealt by cell to tasks of about ``TASK_ROWS`` counts, so a task's sort and hash map stay the same
    when the tables grow (coalesced shuffles are cut by compressed bytes). Sums and join need no other shuffle.
    """
    counts = counts.where(F.col(cell).isNotNull()).select(cell, gene, "value")
    tasks = max(counts.sparkSession.sparkContext.defaultParallelism, counts.count() // TASK_ROWS + 1)
    sums = counts.repartition(tasks, cell).groupBy(cell, gene).agg(F.sum("value").alias("_v"))
    return sums.join(cells.select(cell, *keys).repartition(tasks, cell).distinct().hint("merge"), cell).select(*keys, gene, "_v")


def pseudobulk(
    counts: DataFrame,
    cells: DataFrame,
    donor: str = "donor_id",
    method: str = "sum",
    strata: Sequence[str] = (),
    cell: str = "cell_id",
    gene: str = "gene_id",
) -> DataFrame:
    """Σ, mean or expressing fraction per (donor, [strata,] gene).

    The sum is a partial aggregate on the map side, so a donor with most of the
    cells sends one row per gene and task, not one per count.
    """
    keys = [donor, *strata]
    # Cells grow with the counts, and their file looks small: without the hint Spark would broadcast millions of them.
    rows = counts.join(cells.select(cell, *keys).hint("merge"), cell)
    if method == "sum":
        return rows.groupBy(*keys, gene).agg(F.sum("value").alias("value"))
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))
    if method == "mean":
        top = rows.groupBy(*keys, gene).agg(F.sum("value").alias("_top"))
    elif method == "fraction":
        top = _per_cell(counts, cells, keys, cell, gene).groupBy(*keys, gene).agg(F.count_if(F.col("_v") > 0).alias("_top"))
    else:
        raise ValueError("method must be sum, mean or fraction")
    return top.join(sizes, keys).select(*keys, gene, (F.col("_top") / F.col("n_cells")).alias("value"))


def cpm_log1p(
    features: DataFrame,
    donor: str | Sequence[str] = "donor_id",
    scale: float = 1e6,
    on_zero: str = "error",
    value: str = "value",
) -> DataFrame:
    """``log1p(value / Σ value · scale)`` per donor, kept beside the raw value.

    Totals come from a grouped sum joined back (not a window), so a donor with
    very many genes is never one task. A zero total fails, becomes NULL, or is dropped.
    """
    keys = [donor] if isinstance(donor, str) else list(donor)
    totals = features.groupBy(*keys).agg(F.sum(value).alias("total"))
    positive = F.col("total") > 0
    if on_zero == "drop":
        totals = totals.where(positive)
    elif on_zero == "error":
        message = F.concat(F.lit("zero total counts for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
        totals = totals.withColumn("total", F.when(positive, F.col("total")).otherwise(F.raise_error(message).cast("double")))
    elif on_zero == "null":
        totals = totals.withColumn("total", F.when(positive, F.col("total")))
    else:
        raise ValueError("on_zero must be error, null or drop")
    cpm = F.col(value) / F.col("total") * scale
    return with_group_totals(features, totals, keys).withColumns({"cpm": cpm, "log1p_cpm": F.log1p(cpm)})


def donor_totals(counts: DataFrame, cells: DataFrame, donor: str = "donor_id", cell: str = "cell_id") -> DataFrame:
    """Cells and summed counts per donor; donors without any count keep a zero total."""
    per_cell = counts.groupBy(cell).agg(F.sum("value").alias("_v"))
    rows = cells.select(cell, donor).join(per_cell, cell, "left")
    return rows.groupBy(donor).agg(
        F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("_v"), F.lit(0.0)).alias("total_counts")
    )


def gene_intersection(a: DataFrame, b: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Sorted distinct genes both sides have."""
    return a.select(gene).intersect(b.select(gene)).orderBy(gene)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side; no row means the sets are equal."""
    sides = a.select(key).distinct().withColumn("_a", F.lit(True)).join(
        b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full_outer"
    )
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only")
    return sides.select(key, side.alias("side")).where(F.col("side").isNotNull())


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes, shared size and shared percentage of each side."""
    sides = a.select(key).distinct().withColumn("_a", F.lit(1)).join(
        b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer"
    )
    totals = sides.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("n_right"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_shared"),
    )
    return totals.withColumns(
        {
            "pct_of_left": F.try_divide(100.0 * F.col("n_shared"), F.col("n_left")),
            "pct_of_right": F.try_divide(100.0 * F.col("n_shared"), F.col("n_right")),
        }
    )


def feature_arrays(
    features: DataFrame, donor: str = "donor_id", feature: str = "feature_id", value: str = "value", size: int = 100_000
) -> DataFrame:
    """Long rows to one ordered array per donor. The feature list must fit ``size`` (a donor's array is one value)."""
    n = features.select(feature).distinct().count()
    if n > size:
        raise ValueError(f"{n} features exceed the array bound {size}; use blocked_arrays")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(feature), F.col(value))))
    return features.groupBy(donor).agg(pairs.alias("_pairs")).select(
        donor,
        F.transform("_pairs", lambda p: p[feature]).alias("features"),
        F.transform("_pairs", lambda p: p[value]).alias("values"),
    )


def feature_columns(features: DataFrame, names: Sequence, donor: str = "donor_id", feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Wide form for a short, given list of features; absent values are 0."""
    return features.groupBy(donor).pivot(feature, list(names)).agg(F.first(value)).fillna(0.0)


BLOCK = 4096  # features of a block of the donor matrix


def feature_positions(features: DataFrame, feature: str = "feature_id") -> DataFrame:
    """``feature, position``: features numbered from 0 in their order."""
    ranked = global_rank(features.select(feature).distinct(), [feature], name="_r")
    return ranked.select(feature, (F.col("_r") - 1).alias("position"))


def blocked_arrays(
    features: DataFrame, positions: DataFrame, donor: str = "donor_id", feature: str = "feature_id", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Long rows to the donor matrix in blocks: ``donor, block, first, values array<double>``.

    ``positions (feature, position)`` gives the columns; absent values are 0, and so are blocks without a row (they have
    none). A row holds ``block`` values at most, so donors and features may both grow without limit. A feature without a
    position is left out; NULL values and repeated entries fail.
    """
    placed = features.join(positions.select(feature, "position"), feature).select(donor, "position", F.col(value).cast("double").alias("x"))
    placed = placed.withColumn("block", F.floor(F.col("position") / block).cast("bigint"))
    entry = F.struct((F.col("position") - F.col("block") * block).cast("int").alias("at"), "x")
    gathered = placed.groupBy(donor, "block").agg(F.collect_list(entry).alias("e"), F.count_if(F.col("x").isNull()).alias("_null"), F.countDistinct("position").alias("_d"))
    bad = (F.col("_null") > 0) | (F.col("_d") < F.size("e"))
    gathered = gathered.withColumn("e", F.when(bad, F.raise_error(F.lit("a feature of a donor is NULL or repeated"))).otherwise(F.col("e")))
    kind = dict(features.dtypes)[donor]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(2)
            out = np.zeros((batch.num_rows, block))
            who = np.repeat(np.arange(batch.num_rows), e.value_lengths().to_numpy())
            flat = e.flatten()
            out[who, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
            values = pa.ListArray.from_arrays(np.arange(0, out.size + 1, block, dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=[donor, "block", "values"])

    filled = gathered.select(donor, "block", "e").mapInArrow(run, f"`{donor}` {kind}, block bigint, `values` array<double>")
    return filled.select(donor, "block", (F.col("block") * block).alias("first"), "values")


def long_rows(blocks: DataFrame, positions: DataFrame, donor: str = "donor_id", feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Blocks back to long rows; zeros are left out."""
    flat = blocks.select(donor, "first", F.posexplode("values").alias("at", value)).where(F.col(value) != 0)
    flat = flat.select(donor, (F.col("first") + F.col("at")).alias("position"), value)
    return flat.join(positions.select(feature, "position"), "position").select(donor, feature, value)


def blocked_cpm(blocks: DataFrame, donor: str = "donor_id") -> DataFrame:
    """log1p counts per million on the blocks themselves: a total per donor, then one expression per block."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    totals = blocks.groupBy(donor).agg(F.sum(add("values")).alias("_t"))
    return with_group_totals(blocks, totals, [donor]).withColumn(
        "values", F.transform("values", lambda x: F.when(F.col("_t") > 0, F.log1p(x / F.col("_t") * 1e6)).otherwise(0.0))
    ).drop("_t")


def model_rows(blocks: DataFrame, size: int, donor: str = "donor_id", block: int = BLOCK) -> DataFrame:
    """``donor, features array<double>`` of ``size`` values for the model operators: a donor's blocks in order, absent ones 0."""
    held = blocks.groupBy(donor).agg(F.map_from_entries(F.collect_list(F.struct("block", "values"))).alias("_b"))
    every = F.sequence(F.lit(0), F.lit(max(0, -(-size // block) - 1)))
    whole = F.flatten(F.transform(every, lambda i: F.coalesce(F.col("_b")[i.cast("bigint")], F.array_repeat(F.lit(0.0), block))))
    return held.select(donor, F.slice(whole, 1, size).alias("features"))
