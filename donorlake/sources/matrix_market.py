"""MatrixMarket coordinate files (genes × cells, 1-based) as count rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlake.sources import ranges


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-comment lines of one scan, and whether a line is its file's size line.

    A block's lines come in order within one task, and the size line is the
    first non-comment line of the block that starts at 0; comments stand before
    it in that block. A running marker per task, not a second scan, finds it.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim("value").alias("line")
    )

    def mark(batches):
        seen = None
        for batch in batches:
            line = batch.column(2)
            batch = batch.filter(pc.and_(pc.invert(pc.starts_with(line, "%")), pc.not_equal(line, "")))
            if not batch.num_rows:
                continue
            file, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            codes, first = file.indices.to_numpy(), np.zeros(batch.num_rows, bool)
            for at in np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (block[1:] != block[:-1])])):
                name = file.dictionary[int(codes[at])].as_py()
                if block[at] == 0 and name != seen:
                    first[at], seen = True, name
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(first)], names=["file", "line", "is_size"])

    return text.mapInArrow(mark, "file string, line string, is_size boolean")


def sample_key(file: str = "file"):
    """The part of the file name before the first underscore."""
    return F.split_part(F.regexp_extract(file, "([^/]+)$", 1), F.lit("_"), F.lit(1))


def declared_sizes(spark: SparkSession, path: str, sample: Column | None = None) -> DataFrame:
    """Genes, cells and entries each file declares in its size line. Bodies stay unread.

    The last part of ``path`` may be a pattern of file names; files of folders below count too. A file without a size line fails.
    """
    key = sample_key() if sample is None else sample
    folder, name = path.rsplit("/", 1) if any(c in path.rsplit("/", 1)[-1] for c in "*?[") else (path, "*")
    first = ranges.first_lines(spark, folder, name).select(F.col("path").alias("file"), "line")
    line = F.when(F.col("line").rlike(r"^\d+\s+\d+\s+\d+$"), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no size line in "), "file")))
    parts = F.split(line, r"\s+")
    return first.select(key.alias("sample_id"), "file", *[parts[i].cast("bigint").alias(n) for i, n in enumerate(("n_genes", "n_cells", "nnz"))])


def read_mtx(spark: SparkSession, path: str, genes: DataFrame | None = None, sample: Column | None = None) -> DataFrame:
    """All samples of a glob as ``(sample_id, cell_id, gene_ix | gene_id, value)``.

    ``genes`` names the shared row order as ``(gene_ix, gene_id)``, 1-based;
    ``sample`` derives the sample from ``file`` (the path) where the name prefix
    is not it. A gzip file is one task, plain files split.
    """
    key = sample_key() if sample is None else sample
    parts = F.split("line", r"\s+")
    rows = _lines(spark, path).where(~F.col("is_size")).select(
        key.alias("sample_id"),
        F.concat_ws("_", key, parts[1]).alias("cell_id"),
        parts[0].cast("bigint").alias("gene_ix"),
        parts[2].cast("double").alias("value"),
    )
    return rows if genes is None else rows.join(genes, "gene_ix").drop("gene_ix")


def companion_problems(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("matrix.mtx.gz", "barcodes.tsv.gz"), name: Column | None = None) -> DataFrame:
    """Samples that do not have exactly one file of each kind; ``name`` derives ``<sample>_<kind>`` from ``path``."""
    name = F.regexp_extract("path", "([^/]+)$", 1) if name is None else name
    files = spark.read.format("binaryFile").load(path).select(name.alias("file"))
    counts = files.groupBy(sample_key().alias("sample_id")).agg(*[F.count_if(F.col("file").endswith(s)).alias(f"_{i}") for i, s in enumerate(suffixes)])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("suffix"), F.col(f"_{i}").alias("n_files")) for i, s in enumerate(suffixes)]))
    return counts.select("sample_id", rows.alias("_r")).select("sample_id", "_r.*").where(F.col("n_files") != 1)
