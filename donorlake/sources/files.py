"""Directories of files as tables: inventory, fingerprints, per-donor matrices."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlake.functions.scalars import file_category


def _binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def _name(path: str = "path"):
    return F.regexp_extract(path, "([^/]+)$", 1)


def file_inventory(spark: SparkSession, path: str, suffix: str = ".npy") -> DataFrame:
    """One row: files, matching files, their total/min/max size and whether all sizes are equal. Contents stay unread."""
    files = _binary(spark, path).select(_name().alias("name"), "length")
    mine = F.col("name").endswith(suffix)
    size = F.when(mine, F.col("length"))
    return files.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(mine).alias("n_matching"), F.count_if(~mine).alias("n_other"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"),
        (F.min(size) == F.max(size)).alias("all_same_size"),
    )


def file_categories(spark: SparkSession, path: str, suffix: str = ".npy") -> DataFrame:
    files = _binary(spark, path).select(_name().alias("name")).where(F.col("name").endswith(suffix))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.groupBy(file_category(stem).alias("category")).agg(F.count(F.lit(1)).alias("n_files"))


def fingerprint(spark: SparkSession, path: str, pattern: str | None = None, name: Column | None = None) -> DataFrame:
    """SHA-256 of each file's content, which is one value of its row (2 GiB at most); ``name`` derives the name from ``path``."""
    return _binary(spark, path, pattern).select((_name() if name is None else name).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table of any size: row count, sum and xor of row hashes.

    A row's hash is the first 60 bits of the md5 of its values as text, each behind its length (``-`` for NULL), so no
    two different rows have one text.
    """
    value = lambda c: F.col(c).cast("string")
    text = F.concat(*[F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in df.columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    hashed = df.select(h.alias("_h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("_h").alias("hash_xor")
    )


def compare_fingerprints(recorded: DataFrame, live: DataFrame, key: str = "file", value: str = "sha256") -> DataFrame:
    """Recorded against live fingerprints: ok, drifted, missing or unrecorded."""
    sides = recorded.select(key, F.col(value).alias("recorded")).join(live.select(key, F.col(value).alias("live")), key, "full_outer")
    status = (
        F.when(F.col("live").isNull(), "missing")
        .when(F.col("recorded").isNull(), "unrecorded")
        .when(F.col("recorded") == F.col("live"), "ok")
        .otherwise("drifted")
    )
    return sides.withColumn("status", status)


def read_vectors(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray] | None = None, pattern: str = "*.npy") -> DataFrame:
    """A directory of one matrix per donor as rows ``(donor_id, cell_ix, embedding)``.

    The donor is the file stem. A matrix must be two-dimensional and non-empty;
    one common width is a check over the result (``vector_rows``).
    """
    decode = decode or (lambda content: np.load(io.BytesIO(content), allow_pickle=False))
    stem = F.regexp_replace(_name(), r"\.[^.]*$", "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for donor, content in zip(pdf["donor_id"], pdf["content"]):
                m = np.asarray(decode(content), dtype="float64")
                if m.ndim != 2 or 0 in m.shape:
                    raise ValueError(f"matrix of {donor} has shape {m.shape}")
                for start in range(0, len(m), 4096):
                    part = m[start : start + 4096]
                    yield pd.DataFrame({"donor_id": donor, "cell_ix": range(start, start + len(part)), "embedding": part.tolist()})

    files = _binary(spark, path, pattern).select(stem.alias("donor_id"), "content")
    return files.mapInPandas(run, "donor_id string, cell_ix bigint, embedding array<double>")
