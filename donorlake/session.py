"""Session settings and durable cut points."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "donorlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    Adaptive execution coalesces small shuffles and splits skewed join
    partitions; broadcast joins stay under Spark's own size threshold, so no
    operator forces a broadcast of data that can grow. Compressed parquet is
    counted at four times its file size, so that a fact table that only looks
    small on disk is not broadcast.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.fileCompressionFactor", "4.0")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def task_slots(spark: SparkSession) -> int:
    """Tasks to deal a small input to before it is multiplied: the shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a local master without the setting gets a temporary one, which goes when
    the driver ends."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="donorlake-checkpoint-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table beside the checkpoints."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the files.

    Used where a later step reads the same rows twice and both reads must see
    the same physical order, or where an iterative fit must not replay its
    lineage. The folder comes from ``spark.checkpoint.dir``; only a local
    master without that setting gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once to the shared folder and go on from the files.

    The shuffles that made it are not needed again, so their files go as soon as it is written.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete intermediate tables made by ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
