"""Classification and calibration metrics as aggregates, per group where asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlake.functions.scalars import safe_ratio
from donorlake.operators.ordering import dominance, running_totals, with_group_totals


def _weighted(label: str, positive: bool, weight: str | None) -> Column:
    w = F.lit(1) if weight is None else F.col(weight)
    return F.coalesce(F.sum(F.when(F.col(label) == (1 if positive else 0), w)), F.lit(0))


def auroc(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact AUROC, ties counted half; NULL for a group with one class."""
    won = dominance(df, score, _weighted(label, True, weight), _weighted(label, False, weight), by)
    pairs = F.col("up").cast("double") * F.col("low")
    value = F.when(pairs > 0, F.col("won") / pairs)
    return won.select(*by, F.col("up").alias("n_pos"), F.col("low").alias("n_neg"), value.alias("auroc"))


def _descending(df, score, label, by):
    counts = {"pos": _weighted(label, True, None), "n": F.count(F.lit(1))}
    steps = running_totals(df, score, counts, by, descending=True)
    return steps.withColumnsRenamed({"total_pos": "n_pos", "total_n": "n_all"})


def average_precision(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Σ (recall step · precision) over distinct thresholds, without interpolation."""
    steps = _descending(df, score, label, by)
    term = F.col("pos") / F.col("n_pos") * F.col("cum_pos") / F.col("cum_n")
    return steps.groupBy(*by).agg(F.sum(F.when(F.col("n_pos") > 0, term)).alias("average_precision"))


def precision_recall_points(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    steps = _descending(df, score, label, by)
    return steps.select(
        *by,
        F.col(score).alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("n_pos")).alias("recall"),
    )


def roc_points(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr) at every distinct threshold; the origin carries a NULL threshold."""
    steps = _descending(df, score, label, by)
    points = steps.select(
        *by,
        F.col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("cum_n") - F.col("cum_pos"), F.col("n_all") - F.col("n_pos")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("n_pos")).alias("tpr"),
    )
    origin = df.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def predicted(df: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    return df.withColumn("predicted", (F.col(score) >= threshold).cast("int"))


def confusion(
    df: DataFrame,
    label: str = "label",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    zero_division: str = "zero",
) -> DataFrame:
    """Counts and the metrics derived from them.

    ``zero_division='nan'`` leaves undefined ratios NaN, except F1, which is 0
    when precision and sensitivity are both 0 or undefined.
    """
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns(
        {
            "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn, zero_division),
            "sensitivity": safe_ratio(tp, tp + fn, zero_division),
            "specificity": safe_ratio(tn, tn + fp, zero_division),
            "precision": safe_ratio(tp, tp + fp, zero_division),
        }
    )
    return out.withColumns(
        {
            "balanced_accuracy": (F.col("sensitivity") + F.col("specificity")) / 2.0,
            "f1": safe_ratio(2.0 * tp, 2.0 * tp + fp + fn, "zero"),
        }
    )


def brier(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def reliability(
    df: DataFrame, score: str = "score", label: str = "label", bins: int = 10, strategy: str = "fixed", by: Sequence[str] = ()
) -> DataFrame:
    """Per bin: rows, mean score, observed rate. Fixed bins are equal width on [0, 1]; adaptive bins hold equal
    row counts, and tied scores always share a bin."""
    by = list(by)
    if strategy == "fixed":
        slot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
        rows = df.withColumn("bin", slot).withColumns({"_n": F.lit(1), "_s": F.col(score), "_y": F.col(label)})
    elif strategy == "adaptive":
        counts = {"_n": F.count(F.lit(1)), "_y": F.sum(label)}
        steps = running_totals(df, score, counts, by)
        slot = F.floor((F.col("cum__n") - F.col("_n")) * bins / F.col("total__n")).cast("int")
        rows = steps.withColumn("bin", slot).withColumn("_s", F.col(score) * F.col("_n"))
    else:
        raise ValueError("strategy must be fixed or adaptive")
    sums = rows.groupBy(*by, "bin").agg(F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum("_y").alias("_y"))
    return sums.select(
        *by, "bin", "n", (F.col("_s") / F.col("n")).alias("mean_score"), (F.col("_y") / F.col("n")).alias("observed_rate")
    )


def ece(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10, strategy: str = "fixed", by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error: row-weighted mean gap between score and observed rate."""
    table = reliability(df, score, label, bins, strategy, by)
    gap = F.abs(F.col("mean_score") - F.col("observed_rate"))
    return table.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins over [low, high]; the last bin includes ``high``, values outside are left out."""
    width = (high - low) / bins
    slot = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(value).between(low, high)).withColumn("bin", slot)
    counts = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bin_start", F.lit(low) + F.col("bin") * width)


def entropy(score: str | Column) -> Column:
    """Binary prediction entropy in nats."""
    p = F.col(score) if isinstance(score, str) else score
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.ln(p) + (1 - p) * F.ln(1 - p)))


def risk_coverage(df: DataFrame, confidence: str, wrong: str, by: Sequence[str] = ()) -> DataFrame:
    """Error rate among the most confident share, at every distinct confidence."""
    steps = running_totals(df, confidence, {"n": F.count(F.lit(1)), "bad": F.sum(wrong)}, by, descending=True)
    return steps.select(
        *by,
        F.col(confidence).alias("confidence"),
        (F.col("cum_n") / F.col("total_n")).alias("coverage"),
        (F.col("cum_bad") / F.col("cum_n")).alias("risk"),
    )


def prediction_summary(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Confusion metrics, Brier, AUROC and average precision in one row per group."""
    parts = [
        confusion(predicted(df, score, threshold), label, by=by, zero_division="nan"),
        brier(df, score, label, by),
        auroc(df, score, label, by).drop("n_pos", "n_neg"),
        average_precision(df, score, label, by),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = with_group_totals(out, p, by)
    return out
