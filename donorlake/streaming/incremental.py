"""Pseudobulk sums over count chunks that arrive as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_counts(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet chunks of a folder as a stream; without ``files_per_batch`` a micro-batch takes all files that are there."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def stream_pseudobulk(counts: DataFrame, cells: DataFrame | None = None, donor: str = "donor_id", gene: str = "gene_id") -> DataFrame:
    """Running Σ per (donor, gene) as keyed state, for ``outputMode('update')``."""
    rows = counts if cells is None else counts.join(cells.select("cell_id", donor), "cell_id")
    return rows.groupBy(donor, gene).agg(F.sum("value").alias("value"))


def append_partial_sums(counts: DataFrame, out: str, checkpoint: str, cells: DataFrame | None = None, donor: str = "donor_id", gene: str = "gene_id"):
    """Write each micro-batch's own (donor, gene) sums below ``out/batch_id=…`` and return the started query.

    Nothing is kept between batches. A batch that is replayed after a failure
    overwrites its own folder, so its counts are never added twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if cells is None else batch.join(cells.select("cell_id", donor), "cell_id")
        rows.groupBy(donor, gene).agg(F.sum("value").alias("value")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark knows; none if it doesn't exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def _deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the manifests that were written to their ends."""
    names = _children(spark, f"{out}/manifest")
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and "_SUCCESS" in _children(spark, f"{out}/manifest/{n}"))


def _runs(spark: SparkSession, out: str, version: int) -> list[tuple[str, int, int, int]]:
    """``(folder, first batch, last batch, level)`` of a manifest, oldest first; one row per run, logarithmic in the batches."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{out}/manifest/v={version}").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


_MANIFEST = "folder string, first bigint, last bigint, level int"


def _current(spark: SparkSession, out: str) -> tuple[int, list[tuple[str, int, int, int]]]:
    """The newest version, its runs, and behind them the finished batches that no run holds yet, as runs of level 0."""
    versions = _versions(spark, out)
    runs = _runs(spark, out, versions[-1]) if versions else []
    held = runs[-1][2] if runs else -1
    batches = sorted(int(n.split("=")[1]) for n in _children(spark, out) if n.startswith("batch_id="))
    fresh = [b for b in batches if b > held and "_SUCCESS" in _children(spark, f"{out}/batch_id={b}")]
    return (versions[-1] if versions else 0), runs + [(f"batch_id={b}", b, b, 0) for b in fresh]


def _summed(spark: SparkSession, out: str, folders: list[str], donor: str, gene: str) -> DataFrame:
    return spark.read.parquet(*[f"{out}/{f}" for f in folders]).groupBy(donor, gene).agg(F.sum("value").alias("value"))


def compact_sums(spark: SparkSession, out: str, checkpoint: str, fanout: int = 8, donor: str = "donor_id", gene: str = "gene_id") -> int:
    """Merge batch folders so that ``read_sums`` reads few of them; returns how many runs are left.

    Whenever ``fanout`` neighbouring runs have one level they become one run of the next, so every sum is rewritten a
    logarithmic number of times and at most ``fanout − 1`` runs of a level stay. Only batches that the stream has
    committed (``checkpoint/commits``) are merged: a batch that may still be replayed stays a folder of its own, and
    a replay of a merged one lands in a folder that readers skip.

    A run is written whole before a new manifest names it, and readers follow the newest finished manifest. So a compaction that
    dies leaves the sums as they were; its folders, and those that neither of the two newest manifests names, are
    deleted by the next one. One compaction runs at a time; readers and the stream need not stop.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    version, every = _current(spark, out)
    committed = {int(n) for n in _children(spark, f"{checkpoint}/commits") if n.isdigit()}
    done = max(committed, default=-1)
    runs, later = [r for r in every if r[2] <= done], [r for r in every if r[2] > done]
    merged = []
    while True:
        at = next((i for i in range(len(runs) - fanout + 1) if len({r[3] for r in runs[i : i + fanout]}) == 1), None)
        if at is None:
            break
        part = runs[at : at + fanout]
        first, last, level = part[0][1], part[-1][2], part[0][3] + 1
        folder = f"runs/{first}-{last}-{uuid.uuid4().hex}"
        _summed(spark, out, [r[0] for r in part], donor, gene).write.parquet(f"{out}/{folder}")
        merged.append(folder)
        runs[at : at + fanout] = [(folder, first, last, level)]
    if merged:
        spark.createDataFrame(runs, _MANIFEST).coalesce(1).write.parquet(f"{out}/manifest/v={version + 1}")
    _expired(spark, out)
    return len(runs) + len(later)


def _expired(spark: SparkSession, out: str) -> None:
    """Delete what the two newest manifests don't name."""
    kept = _versions(spark, out)[-2:]
    if not kept:
        return
    lists = [_runs(spark, out, v) for v in kept]
    named = {r[0] for runs in lists for r in runs}
    oldest_held = lists[0][-1][2] if len(kept) == 2 else -1  # batches behind it are read through the older manifest
    for n in _children(spark, f"{out}/runs"):
        if f"runs/{n}" not in named:
            _deleted(spark, f"{out}/runs/{n}")
    for n in _children(spark, out):
        if n.startswith("batch_id=") and n not in named and int(n.split("=")[1]) <= oldest_held:
            _deleted(spark, f"{out}/{n}")
    for n in _children(spark, f"{out}/manifest"):
        if n.startswith("v=") and int(n[2:]) < kept[0]:
            _deleted(spark, f"{out}/manifest/{n}")


def read_sums(spark: SparkSession, out: str, donor: str = "donor_id", gene: str = "gene_id") -> DataFrame:
    """Sum of all batches so far, compacted or not: the same table a batch job over all chunks gives."""
    return _summed(spark, out, [r[0] for r in _current(spark, out)[1]], donor, gene)
