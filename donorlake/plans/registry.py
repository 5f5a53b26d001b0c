"""Registry of queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(sql: str, *columns: str) -> str:
    """Wrap a statement so that the named floating columns are rounded to six places."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({sql}) AS q"


# --- the driver tables in the roles of a cohort -----------------------------------

CELLS = """cells AS (
  SELECT o_orderkey AS cell_id, o_custkey AS donor_id, c_nationkey AS nation_id, c_mktsegment AS grp,
         o_orderpriority AS cell_type, o_orderstatus AS batch, o_totalprice AS score
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
COUNTS = "counts AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id, l_quantity AS value FROM lineitem)"
GENES = "genes AS (SELECT p_partkey AS gene_id, p_type || '-' || p_name AS gene_symbol FROM part)"
PATIENTS = """patients AS (
  SELECT donor_id, grp, nation_id, count(*) AS n_cells FROM cells GROUP BY donor_id, grp, nation_id)"""
TASK_LIST = (("building_vs_machinery", "BUILDING", "MACHINERY"), ("building_vs_household", "BUILDING", "HOUSEHOLD"))
MANIFEST = """tasks(task, grp, label) AS (VALUES
  ('building_vs_machinery', 'BUILDING', 1), ('building_vs_machinery', 'MACHINERY', 0),
  ('building_vs_household', 'BUILDING', 1), ('building_vs_household', 'HOUSEHOLD', 0)),
manifest AS (SELECT p.*, t.task, t.label FROM patients p JOIN tasks t ON p.grp = t.grp)"""
PREDICTIONS = """predictions AS (
  SELECT d.doc_id, d.lang, n_chars, n_chars / (n_chars + 1000.0) AS score, quality AS label, toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
DONOR_TEXT = """donor_text AS (
  SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'FLARE' WHEN 'MACHINERY' THEN 'HC-'
           WHEN 'AUTOMOBILE' THEN 'IGTB' ELSE '' END || c_custkey::VARCHAR AS donor_id
  FROM customer)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c.hint("merge"), o.o_custkey == c.c_custkey).select(  # donors grow with the cells: no broadcast
        F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("donor_id"), F.col("c_nationkey").alias("nation_id"),
        F.col("c_mktsegment").alias("grp"), F.col("o_orderpriority").alias("cell_type"), F.col("o_orderstatus").alias("batch"),
        F.col("o_totalprice").alias("score"),
    )


def counts(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value")
    )


def genes(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("gene_id"), F.concat_ws("-", "p_type", "p_name").alias("gene_symbol"), "p_type", "p_brand"
    )


def patients(spark, sf) -> DataFrame:
    return cells(spark, sf).groupBy("donor_id", "grp", "nation_id").agg(F.count(F.lit(1)).alias("n_cells"))


def manifest(spark, sf) -> DataFrame:
    from donorlake.operators.confounding import Task, expand_tasks

    return expand_tasks(patients(spark, sf), [Task(*t) for t in TASK_LIST], "grp")


def predictions(spark, sf) -> DataFrame:
    d, l = table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        "doc_id", "lang", "n_chars", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"), F.col("quality").alias("label"), "toxic"
    )


def donor_text(spark, sf) -> DataFrame:
    """Customers under donor-style ids, one pattern per market segment."""
    seg = F.col("c_mktsegment")
    prefix = F.when(seg == "BUILDING", "FLARE").when(seg == "MACHINERY", "HC-").when(seg == "AUTOMOBILE", "IGTB").otherwise("")
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.concat(prefix, F.col("c_custkey").cast("string")).alias("donor_id"))
