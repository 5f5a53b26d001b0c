"""Dataset catalogs and gene mapping tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlake.functions.columns import AUDIT_MISSING, is_missing
from donorlake.functions.scalars import as_true, composite_key
from donorlake.operators.checks import VERIFIED_STATUS

# Eligibility weights and the lower bounds of their categories.
ELIGIBILITY_WEIGHTS = {
    "core_dataset_validity": 25,
    "prediction_task_feasibility": 20,
    "patient_level_modeling_feasibility": 20,
    "cross_cohort_validation_suitability": 15,
    "bioinformatics_interpretability": 10,
    "reproducibility_and_accessibility": 10,
}
ELIGIBILITY_CATEGORIES = ((80, "excellent"), (60, "usable_with_caution"), (40, "limited"), (0, "reject"))
UNSCORED = "not_scored_pending_manual_audit"
READY = "ready_for_manual_scoring"
SYMBOL_MISSING = ("", "TODO", "unclear")


def scoring_status(rows: DataFrame, source: str, key_columns: Sequence[str], hard_fields: Sequence[str]) -> DataFrame:
    """Which catalog rows may be scored: unverified rows wait, verified rows must have every hard field."""
    gaps = F.array_compact(F.array(*[F.when(is_missing(f, AUDIT_MISSING), F.lit(f)) for f in hard_fields]))
    status = F.trim(F.coalesce(F.col("audit_status").cast("string"), F.lit("")))
    verified = status == VERIFIED_STATUS
    score_status = (
        F.when(is_missing("audit_status", AUDIT_MISSING), "error_missing_audit_status")
        .when(~verified, UNSCORED)
        .when(F.size(gaps) > 0, "error_missing_hard_fields")
        .otherwise(READY)
    )
    return rows.select(
        F.lit(source).alias("source_table"),
        composite_key(*key_columns).alias("candidate_key"),
        status.alias("audit_status"),
        score_status.alias("score_status"),
        F.when(verified, F.array_join(gaps, ", ")).otherwise(F.lit("TODO")).alias("missing_information"),
    )


def eligibility(rows: DataFrame, rejections: Sequence[str] = (), weights: Mapping[str, int] = ELIGIBILITY_WEIGHTS) -> DataFrame:
    """Weighted 0–100 score of criterion shares in [0, 1], its category, and hard rejection by any flag column."""
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    category: Column | None = None
    for floor, name in ELIGIBILITY_CATEGORIES:
        hit = F.col("total_score") >= floor
        category = F.when(hit, name) if category is None else category.when(hit, name)
    flags = F.array_join(F.array_compact(F.array(*[F.when(as_true(c), F.lit(c)) for c in rejections])), "; ") if rejections else F.lit("")
    out = rows.withColumn("total_score", total).withColumn("hard_rejection_flags", flags)
    return out.withColumn("eligibility_category", F.when(F.col("hard_rejection_flags") != "", "reject").otherwise(category))


def audit_copy(rows: DataFrame, status: str = "TODO", notes: str = "") -> DataFrame:
    """Catalog rows with audit columns added where the table has none."""
    extra = {c: F.lit(v) for c, v in (("audit_status", status), ("audit_notes", notes)) if c not in rows.columns}
    return rows.withColumns(extra)


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts per table, zero for an empty one."""
    from donorlake.operators.ordering import union_all

    return union_all([df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(name)) for name, df in tables.items()])


def duplicate_symbols(genes: DataFrame, symbol: str = "gene_symbol") -> DataFrame:
    """Non-empty symbols that occur more than once."""
    known = genes.where(F.col(symbol).isNotNull() & ~F.col(symbol).isin(*SYMBOL_MISSING))
    return known.groupBy(symbol).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def mapping_summary(rows: DataFrame) -> DataFrame:
    yes = lambda c: F.count_if(F.lower(F.col(c).cast("string")).isin("true", "yes", "1"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.lower("mapping_status") == "mapped").alias("mapped_rows"),
        yes("unmapped_flag").alias("unmapped_rows"),
        yes("duplicate_flag").alias("duplicate_rows"),
        yes("foundation_vocab_match").alias("foundation_vocab_matches"),
        yes("pathway_eligible").alias("pathway_eligible_rows"),
    )


def gene_mapping_report(genes: DataFrame, vocabulary: DataFrame, pathways: DataFrame, gene: str = "gene_id", symbol: str = "gene_symbol") -> DataFrame:
    """Per gene: mapped or not, duplicate symbol, member of the model vocabulary and of a pathway set."""
    vocab = vocabulary.select(gene).distinct().withColumn("_v", F.lit(True))
    path = pathways.select(symbol).distinct().withColumn("_p", F.lit(True))
    dup = duplicate_symbols(genes, symbol).select(symbol, F.lit(True).alias("_d"))
    rows = genes.join(vocab, gene, "left").join(path, symbol, "left").join(dup, symbol, "left")
    unmapped = F.col(symbol).isNull() | F.col(symbol).isin(*SYMBOL_MISSING)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        gene,
        symbol,
        F.when(unmapped, "unmapped").otherwise("mapped").alias("mapping_status"),
        yes("_d").alias("duplicate_flag"),
        unmapped.alias("unmapped_flag"),
        yes("_v").alias("foundation_vocab_match"),
        (yes("_p") & ~unmapped).alias("pathway_eligible"),
    )
