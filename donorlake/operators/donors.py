"""Cell rows to donor rows: sizes, invariants, composition, pooled vectors, aligned joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlake.functions.scalars import CLINICAL_STATUSES, donor_id, donor_status, parse_age, sanitize
from donorlake.operators.ordering import with_group_totals

# Fixed value: the category of a donor whose cells disagree.
MIXED = "__mixed_within_patient__"


def cell_counts(cells: DataFrame, donor: str = "donor_id", ordinal: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Cells per donor; ``ordinal`` adds the position at which a donor is first seen."""
    aggs = [F.count(F.lit(1)).alias("n_cells")]
    if ordinal:
        aggs.append(F.min(ordinal).alias("first_seen"))
    return cells.groupBy(donor, *extra).agg(*aggs)


def status_counts(cells: DataFrame, donor: str = "donor_id", status: Column | None = None, statuses=CLINICAL_STATUSES) -> DataFrame:
    """Donors and cells per status, with zero rows for statuses nobody has."""
    status = donor_status(donor) if status is None else status
    per_donor = cells.withColumn("status", status).groupBy("status", donor).agg(F.count(F.lit(1)).alias("_n"))
    found = per_donor.groupBy("status").agg(F.count(F.lit(1)).alias("n_donors"), F.sum("_n").alias("n_cells"))
    blank = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in statuses])).alias("status"))
    zeros = blank.select("status", F.lit(0).cast("bigint").alias("n_donors"), F.lit(0).cast("bigint").alias("n_cells"))
    return found.unionByName(zeros).groupBy("status").agg(F.sum("n_donors").alias("n_donors"), F.sum("n_cells").alias("n_cells"))


def cohort_summary(cells: DataFrame, donor: str = "donor_id") -> DataFrame:
    sizes = cell_counts(cells, donor)
    return sizes.agg(F.coalesce(F.sum("n_cells"), F.lit(0)).alias("n_cells"), F.count(F.lit(1)).alias("n_donors"))


def donor_labels(ids: DataFrame, donor: str = "donor_id", on_unknown: str = "error") -> DataFrame:
    """Distinct normalised donor ids with their status."""
    return ids.select(donor_id(donor).alias(donor)).distinct().withColumn("status", donor_status(donor, on_unknown))


def invariant_report(cells: DataFrame, donor: str, fields: Sequence[str]) -> DataFrame:
    """Per field: how many donors hold more than one value."""
    spread = cells.groupBy(donor).agg(*[(F.min(f) != F.max(f)).alias(f) for f in fields])
    counts = spread.agg(*[F.count_if(f).alias(f) for f in fields])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_varying_donors")) for f in fields])).alias("r")
    ).select("r.*")


def collapse(cells: DataFrame, donor: str, field: str, policy: str = "error") -> DataFrame:
    """One value per donor from its non-blank cell values.

    ``error`` fails on disagreement, ``mixed`` writes a category for it, ``flag``
    gives NULL plus ``<field>_ambiguous``. Min and max decide, so no value set is collected.
    """
    text = F.trim(F.col(field).cast("string"))
    known = F.when(text != "", text)
    low, high = F.min(known), F.max(known)
    ends = cells.groupBy(donor).agg(low.alias("_low"), high.alias("_high"))
    same = F.col("_low").isNull() | (F.col("_low") == F.col("_high"))
    if policy == "error":
        message = F.concat(F.lit(f"{field} differs within donor "), F.col(donor).cast("string"))
        value = F.when(same, F.col("_low")).otherwise(F.raise_error(message).cast("string"))
        return ends.select(donor, value.alias(field))
    if policy == "mixed":
        return ends.select(donor, F.when(same, F.col("_low")).otherwise(F.lit(MIXED)).alias(field))
    if policy == "flag":
        return ends.select(donor, F.when(same, F.col("_low")).alias(field), (~same).alias(f"{field}_ambiguous"))
    raise ValueError("policy must be error, mixed or flag")


def composition(cells: DataFrame, donor: str = "donor_id", cell_type: str = "cell_type") -> DataFrame:
    """Long cell-type shares per donor; a type a donor lacks has no row (share 0)."""
    counts = cells.groupBy(donor, cell_type).agg(F.count(F.lit(1)).alias("cell_count"))
    totals = counts.groupBy(donor).agg(F.sum("cell_count").alias("total_cells"))
    return counts.join(totals, donor).withColumn("fraction", F.col("cell_count") / F.col("total_cells"))


def composition_wide(cells: DataFrame, types: Sequence[str], donor: str = "donor_id", cell_type: str = "cell_type") -> DataFrame:
    """One ``cell_type_prop_<name>`` column per given type, zeros filled, plus ``n_cells``; one aggregate. A type that
    isn't listed, or NULL, fails: without it the shares wouldn't add up to 1."""
    import re

    def column(t: str) -> str:
        return "cell_type_prop_" + (re.sub("[^0-9a-z]+", "_", t.strip().lower()).strip("_") or "unknown")

    shares = [(F.count_if(F.col(cell_type) == t) / F.count(F.lit(1))).alias(column(t)) for t in types]
    listed = F.coalesce(F.col(cell_type).isin(*types), F.lit(False))
    message = F.concat(F.lit("cell type not listed: "), F.coalesce(F.max(F.when(~listed, F.col(cell_type))), F.lit("NULL")))
    n = F.when(F.count_if(~listed) == 0, F.count(F.lit(1))).otherwise(F.raise_error(message).cast("bigint"))
    return cells.groupBy(donor).agg(n.alias("n_cells"), *shares)


def composition_feature_names(shares: DataFrame, cell_type: str = "cell_type") -> DataFrame:
    return shares.withColumn("feature", F.concat(F.lit("cell_type_prop_"), sanitize(cell_type)))


def log_ratios(shares: DataFrame, donor: str = "donor_id", fraction: str = "fraction", epsilon: float = 0.0) -> DataFrame:
    """Logit and centred log-ratio of composition shares (over the types a donor has); ``epsilon`` keeps logits finite."""
    f = F.col(fraction)
    means = shares.groupBy(donor).agg(F.avg(F.ln(f)).alias("_m"))
    logit = F.ln((f + epsilon) / (1.0 - f + epsilon))
    return shares.join(means, donor).withColumns({"logit": logit, "clr": F.ln(f) - F.col("_m")}).drop("_m")


def donor_metadata(cells: DataFrame, donor: str = "donor_id", case_disease: str = "systemic lupus erythematosus") -> DataFrame:
    """Donor record: distinct stages, parsed age, ambiguity flag, eligibility, 0/1 label, cell count.

    Disease, sex or ethnicity that differ within a donor fail. Several stages make the age ambiguous and the donor
    ineligible; one stage that names no age leaves the age NULL and the donor eligible.
    """
    stage = F.col("development_stage").cast("string")
    ages = cells.withColumn("_age", parse_age(stage))

    def invariant(c: str):
        message = F.concat(F.lit(f"{c} differs within donor "), F.first(donor).cast("string"))
        return F.when(F.min(c) != F.max(c), F.raise_error(message).cast("string")).otherwise(F.min(c))

    rows = ages.groupBy(donor).agg(
        *[invariant(c).alias(c) for c in ("disease", "sex", "self_reported_ethnicity")],
        F.array_join(F.array_sort(F.collect_set(stage)), ";").alias("development_stage_raw"),
        (F.min(stage) != F.max(stage)).alias("_many"),
        F.min("_age").alias("_age"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    flag = F.when(F.col("_many"), "age_ambiguous").otherwise("ok")
    return rows.select(
        donor,
        "disease",
        (F.col("disease") == case_disease).cast("int").alias("sle_label"),
        "sex",
        "self_reported_ethnicity",
        F.when(~F.col("_many"), F.col("_age")).alias("age"),
        flag.alias("age_flag"),
        (flag == "ok").alias("metadata_arm_eligible"),
        "development_stage_raw",
        "n_cells",
    )


def patient_summary(cells: DataFrame, donor: str, group: str, score: str, cell_type: str) -> DataFrame:
    """Group (one per patient), exact median score, sorted cell types, cells."""
    from donorlake.operators.ordering import quantiles

    groups = collapse(cells, donor, group)
    scores = quantiles(cells, score, [0.5], by=[donor]).withColumnRenamed("q0", f"median_{score}")
    types = cells.groupBy(donor).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.array_join(F.array_sort(F.collect_set(cell_type)), "|").alias("cell_types"),
    )
    return types.join(groups, donor).join(scores, donor, "left")


def mean_pool(vectors: DataFrame, donor: str = "donor_id", vector: str = "embedding", min_cells: int = 1, cell: str = "cell_id") -> DataFrame:
    """Mean vector per donor with map-side partial sums. Differing sizes and a cell id that repeats fail."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    pooled = vectors.groupBy(donor).agg(
        F.count(F.lit(1)).alias("n_cells"), Summarizer.mean(array_to_vector(v)).alias("_mean")
    )
    repeats = vectors.groupBy(cell).agg(F.count(F.lit(1)).alias("_r")).agg(F.max("_r").alias("_most"))
    once = F.when(F.coalesce("_most", F.lit(1)) == 1, F.col("n_cells")).otherwise(F.raise_error(F.lit("a cell id repeats")).cast("bigint"))
    pooled = with_group_totals(pooled, repeats, []).withColumn("n_cells", once)
    if min_cells > 1:
        message = F.concat(F.lit("too few cells for donor "), F.col(donor).cast("string"))
        n = F.when(F.col("n_cells") >= min_cells, F.col("n_cells")).otherwise(F.raise_error(message).cast("bigint"))
        pooled = pooled.withColumn("n_cells", n)
    return pooled.select(donor, "n_cells", vector_to_array("_mean").alias(vector))


def aligned_join(a: DataFrame, b: DataFrame, key: str = "donor_id") -> DataFrame:
    """Inner join of two feature sets that must hold the same keys; a key on one side only fails."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    message = F.concat(F.lit("donor in one feature set only: "), F.col(key).cast("string"))
    together = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.where(F.when(together, True).otherwise(F.raise_error(message).cast("boolean"))).drop("_a", "_b")


def attach(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Join a dimension on; a row without a match fails."""
    joined = rows.join(dimension.withColumn("_hit", F.lit(True)), key, "left")
    message = F.concat(F.lit("no metadata for "), F.col(key).cast("string"))
    return joined.where(F.coalesce(F.col("_hit"), F.raise_error(message).cast("boolean"))).drop("_hit")


def compare_counts(expected: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """Missing keys, extra keys and differing values between two keyed tables."""
    sides = expected.select(key, F.col(value).alias("expected"), F.lit(True).alias("_e")).join(
        observed.select(key, F.col(value).alias("observed"), F.lit(True).alias("_o")), key, "full_outer"
    )
    status = (
        F.when(F.col("_o").isNull(), "missing")
        .when(F.col("_e").isNull(), "extra")
        .when(~F.col("expected").eqNullSafe(F.col("observed")), "different")
    )
    return sides.select(key, "expected", "observed", status.alias("status")).where(F.col("status").isNotNull())


def compare_results(recorded: DataFrame, recomputed: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Recorded against recomputed numbers: absolute difference and whether it is within tolerance."""
    sides = recorded.select(key, F.col(value).alias("recorded")).join(
        recomputed.select(key, F.col(value).alias("recomputed")), key, "full_outer"
    )
    gap = F.abs(F.col("recorded") - F.col("recomputed"))
    return sides.withColumns({"abs_diff": gap, "matches": F.coalesce(gap < tolerance, F.lit(False))})


def cohort_union(dev: DataFrame, external: DataFrame) -> DataFrame:
    """Two cohorts stacked, with membership as a 0/1 label."""
    return dev.withColumn("cohort_label", F.lit(0)).unionByName(external.withColumn("cohort_label", F.lit(1)))


def label_balance(donors: DataFrame, label: str, expected: dict | None = None) -> DataFrame:
    """Rows per label; given expected counts, a differing one fails."""
    counts = donors.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if expected is None:
        return counts
    want = F.lit(None).cast("bigint")
    for k, n in expected.items():
        want = F.when(F.col(label) == k, F.lit(n)).otherwise(want)
    message = F.concat(F.lit("unexpected count for label "), F.col(label).cast("string"))
    return counts.withColumn("n", F.when(F.col("n") == want, F.col("n")).otherwise(F.raise_error(message).cast("bigint")))
