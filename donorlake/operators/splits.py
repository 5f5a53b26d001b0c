"""Leakage-safe donor splits: one row per donor, so no donor is on both sides of a fold.

Leave-one-out is described by the held-out donor alone. The training side of a
fold is "everyone else"; its statistics are totals minus the donor's own
contribution, so n folds cost one pass instead of n² rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.operators.ordering import global_rank, hash_rank, running_totals, with_group_totals


def leave_one_out(donors: DataFrame, donor: str = "donor_id", by: Sequence[str] = ()) -> DataFrame:
    """``fold_id`` loocv_001, loocv_002… over sorted donors, each held out once."""
    ranked = global_rank(donors, [donor], by, name="_rank")
    number = F.col("_rank").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return ranked.withColumn("fold_id", F.concat(F.lit("loocv_"), padded)).drop("_rank")


def round_robin_kfold(donors: DataFrame, k: int, donor: str = "donor_id", stratify: str | None = None) -> DataFrame:
    """Sorted donors dealt to k folds in turn, inside each label when stratified."""
    ranked = global_rank(donors, [donor], [stratify] if stratify else [], name="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def shuffled_kfold(
    donors: DataFrame, k: int, label: str = "label", seed: int = 0, donor: str = "donor_id", by: Sequence[str] = (), largest: int | None = None
) -> DataFrame:
    """Stratified folds of a seeded shuffle: every fold gets an even share of each label. ``largest`` as in ``hash_rank``."""
    ranked = hash_rank(donors, donor, seed, by=[*by, label], name="_rank", largest=largest)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def fold_roles(folds: DataFrame, k: int) -> DataFrame:
    """(fold_id, row, role) for k folds: each donor is test once and train k − 1 times."""
    spread = folds.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return spread.withColumn("role", F.when(F.col("fold_id") == F.col("fold"), "test").otherwise("train")).drop("fold")


def stratification_shortfalls(donors: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Labels with fewer donors than folds; no row means k stratified folds are feasible."""
    return donors.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def split_summary(manifest: DataFrame, split: str = "split", label: str = "label_group") -> DataFrame:
    return manifest.groupBy(split, label).agg(F.count(F.lit(1)).alias("n_donors"))


# --- statistics of "everyone but this donor" ---------------------------------


def loo_class_counts(donors: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Training size and class counts of each donor's fold."""
    totals = donors.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    own = F.col(label)
    return with_group_totals(donors, totals, by).withColumns(
        {
            "n_train": F.col("_n") - 1,
            "n_train_cases": F.col("_p") - own,
            "n_train_controls": F.col("_n") - 1 - (F.col("_p") - own),
        }
    ).drop("_n", "_p")


def loo_moments(features: DataFrame, value: str = "value", by: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Training mean and population sd of each donor's fold; an sd of 0 becomes divisor 1. A feature that only one row
    has leaves nothing to train on: both are NULL.

    Sums are centred on the overall mean first, which keeps the subtraction well conditioned.
    """
    centre = features.groupBy(*by).agg(F.avg(value).alias("_c"))
    rows = with_group_totals(features, centre, by).withColumn("_d", F.col(value) - F.col("_c"))
    totals = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_q")
    )
    m = F.col("_n") - 1
    shift = F.try_divide(F.col("_s") - F.col("_d"), m)
    var = F.greatest(F.try_divide(F.col("_q") - F.col("_d") * F.col("_d"), m) - shift * shift, F.lit(0.0))
    sd = F.sqrt(F.when(var > 1e-18 * F.greatest(F.col("_q") / F.col("_n"), F.lit(1e-300)), var).otherwise(0.0))
    return with_group_totals(rows, totals, by).withColumns(
        {"train_mean": F.col("_c") + shift, "train_sd": F.when(m > 0, F.when(sd > 0, sd).otherwise(F.lit(1.0)))}
    ).drop("_c", "_d", "_n", "_s", "_q")


def loo_median(donors: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median of everyone else's known values, from at most four central order statistics."""
    known = donors.where(F.col(value).isNotNull())
    steps = running_totals(known, value, {"n": F.count(F.lit(1))}, by).withColumnRenamed("total_n", "_n")

    def at(position):
        hit = (F.col("cum_n") - F.col("n") <= position) & (position < F.col("cum_n"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    n = F.col("_n")
    lo, hi = F.floor((n - 2) / 2), F.ceil((n - 2) / 2)
    central = steps.groupBy(*by).agg(
        at(F.floor((n - 1) / 2)).alias("_a"), at(F.ceil((n - 1) / 2)).alias("_b"),
        at(lo).alias("_lo0"), at(lo + 1).alias("_lo1"), at(hi).alias("_hi0"), at(hi + 1).alias("_hi1"),
    )
    v = F.col(value).cast("double")
    left = F.when(F.col("_lo0") < v, F.col("_lo0")).otherwise(F.col("_lo1"))
    right = F.when(F.col("_hi0") < v, F.col("_hi0")).otherwise(F.col("_hi1"))
    everyone = (F.col("_a") + F.col("_b")) / 2.0
    out = with_group_totals(donors, central, by)
    return out.withColumn("train_median", F.when(v.isNull(), everyone).otherwise((left + right) / 2.0)).drop(
        "_a", "_b", "_lo0", "_lo1", "_hi0", "_hi1"
    )


def loo_mode(donors: DataFrame, field: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent category of everyone else (ties to the smallest) and whether the donor's own category is known
    to the training side."""
    by = list(by)
    counts = donors.where(F.col(field).isNotNull()).groupBy(*by, field).agg(F.count(F.lit(1)).alias("_own"))
    key = F.struct((-F.col("_own")).alias("neg"), F.col(field).alias("cat"))
    best = counts.groupBy(*by).agg(F.min(key).alias("_best"))
    rest = with_group_totals(counts, best, by).where(F.col(field) != F.col("_best.cat"))
    second = rest.groupBy(*by).agg(F.min(key).alias("_second"))
    ends = with_group_totals(best, second, by) if not by else best.join(second, by, "left")
    rows = donors.join(counts, by + [field], "left")
    rows = with_group_totals(rows, ends, by) if not by else rows.join(ends, by, "left")
    other = F.when(F.col(field) == F.col("_best.cat"), F.col("_second")).otherwise(F.col("_best"))
    mine = F.when(F.col("_own") > 1, F.struct((1 - F.col("_own")).alias("neg"), F.col(field).alias("cat")))
    pick = F.least(other, mine)
    return rows.withColumns(
        {"train_mode": pick["cat"], "category_in_train": F.coalesce(F.col("_own") > 1, F.lit(False))}
    ).drop("_own", "_best", "_second")
