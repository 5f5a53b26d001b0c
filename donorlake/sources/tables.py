"""Table readers and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlake.functions.columns import ContractError, require_columns

DONOR_METADATA = T.StructType(
    [
        T.StructField("donor_id", T.StringType()),
        T.StructField("disease", T.StringType()),
        T.StructField("sle_label", T.IntegerType()),
        T.StructField("sex", T.StringType()),
        T.StructField("self_reported_ethnicity", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("age_flag", T.StringType()),
        T.StructField("metadata_arm_eligible", T.BooleanType()),
        T.StructField("development_stage_raw", T.StringType()),
        T.StructField("n_cells", T.LongType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """Read by suffix. Without a schema a CSV is inferred once, with ``ids`` kept as text."""
    suffix = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if suffix not in ("csv", "gz", "tsv"):
        raise ContractError(f"unsupported table format: {path}")
    reader = spark.read.option("header", True).option("sep", "\t" if ".tsv" in path.lower() else ",")
    if schema is None:
        inferred = reader.option("inferSchema", True).csv(path).schema
        require_columns(inferred.names, ids)
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in ids else f.dataType) for f in inferred])
    return reader.option("inferSchema", False).schema(schema).csv(path)


def scan(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Column-pruned, filtered parquet scan; both reach the file reader."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def parquet_columns(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> list[str]:
    """Column names from the footers only; no job over the rows."""
    return [c for c in spark.read.parquet(path).schema.names if c not in exclude]


def read_gene_list(spark: SparkSession, path: str, column: int = 0, name: str = "gene_id") -> DataFrame:
    """One column of a headerless tab-separated gene list, blank ids skipped."""
    df = spark.read.option("sep", "\t").option("header", False).csv(path)
    return df.select(F.trim(F.col(f"_c{column}")).alias(name)).where(F.col(name) != "")


def read_results(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Earlier results (CSV or multi-line JSON) as lookup rows."""
    if path.endswith(".json"):
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a fixed column order; NULL and NaN are written empty."""
    kinds = dict(df.dtypes)
    cols = [F.nanvl(F.col(c), F.lit(None).cast(kinds[c])).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    df.select(*cols).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, sort_by: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Range-sorted zstd parquet, so later scans on the sort key skip row groups."""
    out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if not partition_by else df.sortWithinPartitions(*partition_by, *sort_by)
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Counts or cells bucketed on the join key: joins of two such tables need no shuffle. ``path`` places the files."""
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_json(row: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def blocked_outputs(spark: SparkSession, schemas: Mapping[str, T.StructType | str], status: str, reason: str) -> dict[str, DataFrame]:
    """Empty tables with their schemas plus a one-row status, for a run whose inputs are missing."""
    out = {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    out["status"] = spark.createDataFrame([(status, reason)], "status string, reason string")
    return out


def read_or_block(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType | str]) -> tuple[DataFrame | None, dict[str, DataFrame]]:
    """The table, or ``None`` and the blocked outputs if the path cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        return read_table(spark, path), {}
    except (AnalysisException, ContractError) as error:
        return None, blocked_outputs(spark, schemas, "blocked_missing_input", str(error).splitlines()[0])
