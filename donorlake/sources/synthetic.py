"""A deterministic count fixture generated by Spark itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlake.functions.hashing import draw, uniform

# Ten patients by group, fifty mitochondrial genes, three quality classes of cells.
GROUPS = ("Flare", "Flare", "Flare", "Managed", "Managed", "Treated", "Treated", "Healthy", "Healthy", "Healthy")
CELL_TYPES = ("B", "T", "NK", "Monocyte")
MITO_GENES = 50


def synthetic_cohort(spark: SparkSession, cells_per_patient: int = 50, n_genes: int = 2500, seed: int = 0, density: float = 0.15):
    """``(cells, genes, counts)`` with low-gene, high-mito and passing cells."""
    n_patients = len(GROUPS)
    cells = spark.range(n_patients * cells_per_patient).select(
        F.concat(F.lit("CELL"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("cell_id"),
        F.concat(F.lit("P"), F.lpad((F.col("id") % n_patients + 1).cast("string"), 3, "0")).alias("donor_id"),
        F.element_at(F.array(*[F.lit(g) for g in GROUPS]), (F.col("id") % n_patients + 1).cast("int")).alias("disease_group"),
        (F.col("id") % n_patients * 1.5).cast("double").alias("SLEDAI"),
        F.element_at(F.array(*[F.lit(t) for t in CELL_TYPES]), (F.floor(F.col("id") / n_patients) % len(CELL_TYPES) + 1).cast("int")).alias("cell_type"),
        F.when(F.col("id") % 25 == 0, "low_gene").when(F.col("id") % 25 == 1, "high_mito").otherwise("pass").alias("synthetic_quality_class"),
    )
    genes = spark.range(n_genes).select(
        F.concat(F.lit("G"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("gene_id"),
        F.when(F.col("id") < MITO_GENES, F.concat(F.lit("MT-SYN"), F.col("id").cast("string"))).otherwise(
            F.concat(F.lit("SYN"), F.col("id").cast("string"))
        ).alias("gene_symbol"),
        (F.col("id") < MITO_GENES).alias("_mito"),
    )
    grid = cells.select("cell_id", "synthetic_quality_class").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(n_genes - 1))))
    mito = F.col("_g") < MITO_GENES
    share = (
        F.when(F.col("synthetic_quality_class") == "low_gene", F.lit(0.02))
        .when((F.col("synthetic_quality_class") == "high_mito") & mito, F.lit(1.0))
        .otherwise(F.lit(density))
    )
    amount = F.when((F.col("synthetic_quality_class") == "high_mito") & mito, 40).otherwise(1) + draw(seed + 1, "cell_id", "_g") % (3 + F.col("_g") % 7)
    counts = grid.where(uniform(seed, "cell_id", "_g") < share).select(
        "cell_id", F.concat(F.lit("G"), F.lpad(F.col("_g").cast("string"), 5, "0")).alias("gene_id"), amount.cast("double").alias("value")
    )
    return cells, genes.drop("_mito"), counts
