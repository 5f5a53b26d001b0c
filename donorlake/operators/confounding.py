"""Case/control imbalance of technical and demographic covariates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from donorlake.functions.scalars import warning_level
from donorlake.operators.ordering import mid_ranks, quantiles, union_all, with_group_totals

# Thresholds (moderate, strong) and the bucket of an absent category.
CELL_COUNT_LEVELS = (0.5, 1.0)
COMPOSITION_LEVELS = (0.10, 0.20)
CATEGORY_LEVELS = (0.25, 1.0)
MISSING_CATEGORY = "__missing__"


class Task(NamedTuple):
    task: str
    case: str
    control: str


def expand_tasks(donors: DataFrame, tasks: Sequence[Task], group: str = "group") -> DataFrame:
    """Donor rows of each task's two groups, stacked, with ``task`` and 0/1 ``label``.

    The task list is part of the expression, so this is a map-side explode, not a join.
    """
    sides = [
        F.when(F.col(group) == g, F.struct(F.lit(t.task).alias("task"), F.lit(y).alias("label")))
        for t in tasks
        for g, y in ((t.case, 1), (t.control, 0))
    ]
    return donors.withColumn("_t", F.explode(F.array_compact(F.array(*sides)))).select("*", "_t.*").drop("_t")


def _side(label: str, y: int, value: Column) -> Column:
    return F.when(F.col(label) == y, value)


def smd(df: DataFrame, value: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Standardised mean difference case − control over the pooled sample variance.

    No case or no control: NULL. Zero pooled sd: 0 for equal means, otherwise infinity.
    """
    v = F.col(value).cast("double")
    s = df.groupBy(*by).agg(
        *[f(_side(label, y, v)).alias(n + str(y)) for y in (0, 1) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))]
    )
    n1, n0 = F.col("n1"), F.col("n0")
    spread = (n1 - 1) * F.coalesce(F.col("v1"), F.lit(0.0)) + (n0 - 1) * F.coalesce(F.col("v0"), F.lit(0.0))
    pooled = F.when(n1 + n0 > 2, spread / (n1 + n0 - 2)).otherwise(F.lit(0.0))
    sd = F.sqrt(F.greatest(pooled, F.lit(0.0)))
    gap = F.col("m1") - F.col("m0")
    equal = F.abs(gap) <= 1e-9 * F.greatest(F.abs(F.col("m1")), F.abs(F.col("m0")))
    result = (
        F.when((n1 == 0) | (n0 == 0), F.lit(None).cast("double"))
        .when((n1 < 2) & (n0 < 2), F.when(equal, F.lit(0.0)))
        .when(sd == 0, F.when(equal, F.lit(0.0)).otherwise(F.lit(float("inf"))))
        .otherwise(gap / sd)
    )
    return s.select(*by, result.alias("smd"))


def cell_count_audit(manifest: DataFrame, by: str = "task") -> DataFrame:
    """Cells per donor in cases against controls: counts, means, exact medians, SMD of log1p."""
    rows = manifest.withColumn("_log", F.log1p(F.col("n_cells").cast("double")))
    n, g = F.col("n_cells").cast("double"), F.col("_log")
    base = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.count_if(F.col("label") == 1).alias("n_cases"),
        F.count_if(F.col("label") == 0).alias("n_controls"),
        F.avg(_side("label", 1, n)).alias("mean_n_cells_case"),
        F.avg(_side("label", 0, n)).alias("mean_n_cells_control"),
        F.avg(_side("label", 1, g)).alias("mean_log1p_n_cells_case"),
        F.avg(_side("label", 0, g)).alias("mean_log1p_n_cells_control"),
    )
    med = quantiles(rows, "n_cells", [0.5], by=[by, "label"]).groupBy(by).agg(
        F.max(_side("label", 1, F.col("q0"))).alias("median_n_cells_case"),
        F.max(_side("label", 0, F.col("q0"))).alias("median_n_cells_control"),
    )
    gaps = smd(rows, "_log", by=[by]).withColumnRenamed("smd", "log1p_n_cells_smd")
    return base.join(med, by).join(gaps, by).withColumn("warning_flag", warning_level("log1p_n_cells_smd", *CELL_COUNT_LEVELS))


def composition_audit(shares: DataFrame, manifest: DataFrame, donor: str = "donor_id", feature: str = "cell_type", by: str = "task") -> DataFrame:
    """Mean share of each cell type in cases and controls.

    Works on the long shares: a donor without a type counts as 0, so sums are
    divided by the number of donors of the class, taken from the manifest.
    """
    sizes = manifest.groupBy(by).agg(
        F.count_if(F.col("label") == 1).alias("_n1"), F.count_if(F.col("label") == 0).alias("_n0")
    )
    sums = shares.join(manifest.select(by, donor, "label"), donor).groupBy(by, feature).agg(
        F.coalesce(F.sum(_side("label", 1, F.col("fraction"))), F.lit(0.0)).alias("_s1"),
        F.coalesce(F.sum(_side("label", 0, F.col("fraction"))), F.lit(0.0)).alias("_s0"),
    )
    out = sums.join(sizes, by).select(
        by,
        feature,
        F.try_divide(F.col("_s1"), F.col("_n1")).alias("mean_prop_case"),
        F.try_divide(F.col("_s0"), F.col("_n0")).alias("mean_prop_control"),
    )
    out = out.withColumn("abs_mean_prop_diff", F.abs(F.col("mean_prop_case") - F.col("mean_prop_control")))
    return out.withColumn("warning_flag", warning_level("abs_mean_prop_diff", *COMPOSITION_LEVELS))


def long_fields(df: DataFrame, fields: Sequence[str], keys: Sequence[str], field: str = "source_field", value: str = "category") -> DataFrame:
    """Unpivot columns to (field, text value), NULL as its own category."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias(field), F.coalesce(F.col(f).cast("string"), F.lit(MISSING_CATEGORY)).alias(value))
            for f in fields
        ]
    )
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")


def category_audit(manifest: DataFrame, fields: Sequence[str], by: str = "task") -> DataFrame:
    """Per field and category: class counts, class shares, their gap, presence in one class only."""
    sizes = manifest.groupBy(by).agg(
        F.greatest(F.count_if(F.col("label") == 1), F.lit(1)).alias("_n1"),
        F.greatest(F.count_if(F.col("label") == 0), F.lit(1)).alias("_n0"),
    )
    counts = long_fields(manifest, fields, [by, "label"]).groupBy(by, "source_field", "category").agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.count_if(F.col("label") == 1).alias("n_cases"),
        F.count_if(F.col("label") == 0).alias("n_controls"),
    )
    case, control = F.col("n_cases") / F.col("_n1"), F.col("n_controls") / F.col("_n0")
    one_class = ((F.col("n_cases") == 0) != (F.col("n_controls") == 0)) & (F.col("n_patients") >= 2)
    out = counts.join(sizes, by).withColumns(
        {
            "case_class_proportion": case,
            "control_class_proportion": control,
            "abs_class_proportion_diff": F.abs(case - control),
            "present_in_only_one_class": one_class,
        }
    )
    level = F.when(F.col("present_in_only_one_class"), F.lit(1.0)).otherwise(F.col("abs_class_proportion_diff"))
    return out.withColumn("warning_flag", warning_level(level, *CATEGORY_LEVELS)).drop("_n1", "_n0")


def audit_summary(cell_counts: DataFrame, cell_types: DataFrame, categories: DataFrame, feature: str = "cell_type", by: str = "task") -> DataFrame:
    """Roll-up per task: worst flag, the three largest cell-type gaps as text, flagged fields."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.round("abs_mean_prop_diff", 12).desc(), feature))
    top = cell_types.withColumn("_r", rank).where((F.col("_r") <= 3) & (F.col("abs_mean_prop_diff") > 0))
    entry = F.struct("_r", F.format_string("%s=%.3f", F.col(feature), F.col("abs_mean_prop_diff")).alias("text"))
    top = top.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("_top")).select(
        by, F.array_join(F.transform("_top", lambda e: e["text"]), "; ").alias("top_cell_type_imbalances")
    )
    fields = categories.where(F.col("warning_flag") != "none").groupBy(by).agg(
        F.array_join(F.array_sort(F.collect_set("source_field")), "; ").alias("source_batch_warning_fields"),
        F.count(F.lit(1)).alias("source_batch_categories_flagged"),
    )
    severity = F.when(F.col("warning_flag") == "strong", 3).when(F.col("warning_flag") == "flag", 2).when(
        F.col("warning_flag") == "not_estimable", 1
    ).otherwise(0)
    worst = union_all([d.select(by, severity.alias("_s")) for d in (cell_counts, cell_types, categories)])
    worst = worst.groupBy(by).agg(F.max("_s").alias("_s")).select(
        by, F.when(F.col("_s") == 3, "strong").when(F.col("_s") == 2, "flag").when(F.col("_s") == 1, "not_estimable").otherwise("none").alias("warning_flag")
    )
    head = cell_counts.select(by, "n_patients", "n_cases", "n_controls", F.col("warning_flag").alias("cell_count_warning_flag"))
    return (
        head.join(top, by, "left")
        .join(fields, by, "left")
        .join(worst, by)
        .fillna({"top_cell_type_imbalances": "", "source_batch_warning_fields": "", "source_batch_categories_flagged": 0})
    )


def group_cell_types(cells: DataFrame, group: str = "group", cell_type: str = "cell_type") -> DataFrame:
    """Cells per (group, cell type) and their share of the group."""
    counts = cells.groupBy(group, cell_type).agg(F.count(F.lit(1)).alias("cell_count"))
    totals = counts.groupBy(group).agg(F.sum("cell_count").alias("group_total_cells"))
    return counts.join(totals, group).withColumn("cell_fraction_within_group", F.col("cell_count") / F.col("group_total_cells"))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X ≥ x) for whole degrees of freedom, from the finite half-integer series."""

    def tail(v, k):
        if pd.isna(v) or pd.isna(k) or k < 1:
            return None
        h, k = v / 2.0, int(k)
        total = math.exp(-h) if k % 2 == 0 else math.erfc(math.sqrt(h))
        for i in range(1 if k % 2 == 0 else 0, k // 2):
            a = i if k % 2 == 0 else i + 0.5
            if h > 0:
                total += math.exp(a * math.log(h) - h - math.lgamma(a + 1))
        return total

    return pd.Series([tail(v, k) for v, k in zip(x, dof)], dtype="float64")


def chi_square(donors: DataFrame, features: Sequence[str], group: str = "group") -> DataFrame:
    """Level-by-group table with zero cells, group shares, χ², degrees of freedom, p (NULL for one level)."""
    rows = long_fields(donors, features, [group], "feature", "level")
    cells = rows.groupBy("feature", "level", group).agg(F.count(F.lit(1)).alias("patient_count"))
    levels = cells.groupBy("feature", "level").agg(F.sum("patient_count").alias("_level"))
    groups = cells.groupBy("feature", group).agg(F.sum("patient_count").alias("group_total"))
    sizes = levels.groupBy("feature").agg(F.sum("_level").alias("_all"), F.count(F.lit(1)).alias("_nl")).join(
        groups.groupBy("feature").agg(F.count(F.lit(1)).alias("_ng")), "feature"
    )
    table = levels.join(groups, "feature").join(cells, ["feature", "level", group], "left").fillna({"patient_count": 0})
    table = table.join(sizes, "feature")
    expected = F.col("_level") * F.col("group_total") / F.col("_all")
    gap = F.col("patient_count") - expected
    stats = table.groupBy("feature", "_nl", "_ng").agg(F.sum(gap * gap / expected).alias("_x"))
    dof = ((F.col("_nl") - 1) * (F.col("_ng") - 1)).cast("double")
    stats = stats.select(
        "feature", F.when(dof > 0, F.col("_x")).alias("chi2"), F.when(dof > 0, dof).alias("dof")
    ).withColumn("p_value", chi2_tail("chi2", "dof"))
    return table.join(stats, "feature").select(
        "feature", "level", group, "patient_count", "group_total",
        (F.col("patient_count") / F.col("group_total")).alias("group_fraction"), "chi2", "dof", "p_value",
    )


def kruskal(df: DataFrame, value: str, group: str = "group", by: Sequence[str] = ()) -> DataFrame:
    """Kruskal–Wallis H with tie correction and its χ² p-value, per ``by``."""
    by = list(by)
    ranks = mid_ranks(df, value, by).withColumnRenamed("n", "_ties")
    per_value = df.groupBy(*by, value, group).agg(F.count(F.lit(1)).alias("_n"))
    sums = per_value.join(ranks, by + [value]).groupBy(*by, group).agg(
        F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("mid_rank")).alias("_r")
    )
    totals = sums.groupBy(*by).agg(
        F.sum("_n").cast("double").alias("n"),
        F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    t = F.col("_ties").cast("double")
    ties = ranks.groupBy(*by).agg(F.sum(t * t * t - t).alias("_t"))
    n = F.col("n")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("_s") - 3.0 * (n + 1)
    correction = 1.0 - F.try_divide(F.col("_t"), n * n * n - n)
    out = with_group_totals(totals, ties, by).withColumns(
        {"h": F.when(correction > 0, raw / correction), "dof": (F.col("n_groups") - 1).cast("double")}
    )
    return out.select(*by, F.col("n").cast("bigint").alias("n"), "n_groups", "h", "dof", chi2_tail("h", "dof").alias("p_value"))


def numeric_summary(df: DataFrame, value: str, cohort: str) -> DataFrame:
    """n, mean, sample sd, min, exact median, max per cohort, as long rows."""
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull()).groupBy(cohort).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    wide = base.join(quantiles(df, value, [0.5], by=[cohort]).withColumnRenamed("q0", "median"), cohort)
    names = ("n", "mean", "sd", "min", "median", "max")
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in names])
    return wide.select(cohort, F.lit(value).alias("variable"), F.explode(pairs).alias("_p")).select(cohort, "variable", "_p.*")


def categorical_summary(df: DataFrame, fields: Sequence[str], cohort: str) -> DataFrame:
    """Counts and percentage of each level per cohort; a field the table lacks gets a NOT_AVAILABLE row."""
    present = [f for f in fields if f in df.columns]
    absent = [f for f in fields if f not in df.columns]
    frames = []
    if present:
        counts = long_fields(df, present, [cohort], "variable", "category").groupBy(cohort, "variable", "category").agg(
            F.count(F.lit(1)).alias("n")
        )
        totals = counts.groupBy(cohort, "variable").agg(F.sum("n").alias("_all"))
        frames.append(counts.join(totals, [cohort, "variable"]).withColumn("pct", 100.0 * F.col("n") / F.col("_all")).drop("_all"))
    if absent:
        names = F.explode(F.array(*[F.lit(f) for f in absent]))
        frames.append(
            df.select(cohort).distinct().select(
                cohort, names.alias("variable"), F.lit("NOT_AVAILABLE").alias("category"),
                F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("pct"),
            )
        )
    return union_all(frames)
