"""Row-level quality and leakage checks.

Every check returns violations ``(rule, key, detail)``; no row means it passed.
Row rules of one table are evaluated together in one scan. Group rules compare
min and max instead of counting distinct values, so they stay partial aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlake.functions.columns import (
    AUDIT_MISSING,
    EXTERNAL_MISSING,
    LEAKAGE_MISSING,
    is_missing,
    require_columns,
)
from donorlake.functions.scalars import as_true, is_finite, vector_problem
from donorlake.operators.ordering import union_all
from donorlake.session import durable

# Allowed and forbidden domains of the manifests.
SPLITS = ("train", "validation", "test", "external_validation", "holdout")
TRAIN_LIKE = ("train", "validation", "test")
HOLDOUT_LIKE = ("external_validation", "holdout")
CELL_UNITS = ("cell_id", "barcode")
CELL_SPLIT_GROUPS = ("cell", "cell_id", "cell_level", "barcode")
DONOR_UNITS = ("patient_id", "donor_id", "sample_id")
PREDICTION_UNITS = ("patient", "patient_id", "donor", "donor_id", "sample", "sample_id")
CELL_PREDICTION_UNITS = ("cell", "cell_id", "cell_level", "barcode")
AGGREGATION_METHODS = ("sum_counts", "mean_expression", "fraction_expressing")
CANDIDATE_STATUSES = ("candidate_pending_audit", "manual_metadata_verified", "rejected_metadata_only")
VERIFIED_STATUS = "manual_metadata_verified"
EXTERNAL_DECISIONS = ("external_validation_ready", "usable_with_caution", "internal_validation_only", "reject")
EXTERNAL_CRITICAL_FIELDS = ("candidate_id", "source", "accession_or_collection_id", "decision", "audit_status")
APPROVAL_WORDS = ("approved", "approve", "selected", "accepted", "external_validation_ready")
INTENDED_ROLES = ("candidate_training", "candidate_external_validation", "candidate_reference", "TODO")
UNAPPROVED_ROLES = ("TODO", "none")
GATED_ROLES = ("training", "external_validation", "reference")


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def blank(column: Column | str) -> Column:
    c = _c(column)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def row_violations(df: DataFrame, key: Column | str, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """All row rules ``name -> (is violated, detail)`` in one pass over the table."""
    k = _c(key).cast("string").alias("key")
    hits = [
        F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), k, detail.cast("string").alias("detail")))
        for rule, (bad, detail) in rules.items()
    ]
    return df.select(F.explode(F.array_compact(F.array(*hits))).alias("_v")).select("_v.*")


def _as_violations(df: DataFrame, rule: str, key: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def report(violations: DataFrame, table: DataFrame) -> DataFrame:
    """One row: PASS/FAIL, number of violations, violated rules, checked rows."""
    found = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_violations"),
        F.array_join(F.array_sort(F.collect_list("rule")), "; ").alias("errors"),
    )
    status = F.when(F.col("n_violations") > 0, "FAIL").otherwise("PASS")
    checked = table.agg(F.count(F.lit(1)).alias("_n")).scalar()
    return found.select(status.alias("status"), "n_violations", "errors", checked.alias("checked_rows"))


# --- leakage ------------------------------------------------------------------


def entity_overlap(rows: DataFrame, fields: Sequence[str] = ("patient_id", "donor_id", "sample_id"), split: str = "split") -> DataFrame:
    """Known ids of any listed field with rows in more than one split; all fields in one scan and one shuffle."""
    s = F.trim(F.col(split))
    entry = lambda f: F.when(~is_missing(f), F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("key")))
    ids = rows.where(s != "").select(s.alias("_s"), F.explode(F.array_compact(F.array(*[entry(f) for f in fields]))).alias("_e"))
    ends = ids.groupBy("_e.field", "_e.key").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where(F.col("_a") != F.col("_b"))
    return ends.select(F.concat("field", F.lit("_in_several_splits")).alias("rule"), "key", F.concat_ws(",", "_a", "_b").alias("detail"))


def cell_level_split(rows: DataFrame, key: str = "entity_id", unit: str = "entity_type") -> DataFrame:
    return row_violations(rows, key, {"cell_level_split": (F.trim(unit).isin(*CELL_UNITS), F.col(unit))})


def cohort_contamination(rows: DataFrame, cohort: str = "cohort_id", split: str = "split") -> DataFrame:
    """Cohorts with rows in a train-like and in a holdout-like split."""
    s = F.trim(F.col(split))
    sides = rows.where(~is_missing(cohort)).groupBy(F.trim(F.col(cohort).cast("string")).alias(cohort)).agg(
        F.max(s.isin(*TRAIN_LIKE)).alias("_t"), F.max(s.isin(*HOLDOUT_LIKE)).alias("_h")
    )
    return _as_violations(sides.where(F.col("_t") & F.col("_h")), "cohort_contamination", cohort, F.lit("train-like and holdout"))


def batch_confounding(rows: DataFrame, batch: str = "batch_id", split: str = "split") -> DataFrame:
    """Splits whose known batches are a single one."""
    b = F.trim(F.col(batch).cast("string"))
    ends = rows.where(~is_missing(batch) & (F.trim(split) != "")).groupBy(F.trim(F.col(split)).alias(split)).agg(
        F.min(b).alias("_a"), F.max(b).alias("_b")
    )
    return _as_violations(ends.where(F.col("_a") == F.col("_b")), "batch_confounding", split, F.col("_a"))


def label_leakage(rows: DataFrame, label: str = "disease_label", split: str = "split") -> DataFrame:
    """Labels that identify the split: at least two of each, every label in one split only."""
    y, s = F.trim(F.col(label).cast("string")), F.trim(F.col(split))
    pairs = rows.where(~is_missing(label) & (s != "")).groupBy(y.alias("label"), s.alias("split")).agg(F.lit(1).alias("_one"))
    per_label = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("_k"), F.min("split").alias("_s"))
    verdict = per_label.agg(
        F.count(F.lit(1)).alias("_labels"), F.max("_k").alias("_k"), F.min("_s").alias("_a"), F.max("_s").alias("_b")
    )
    tied = verdict.where((F.col("_labels") >= 2) & (F.col("_k") == 1) & (F.col("_a") != F.col("_b")))
    return tied.select(F.lit("label_leakage").alias("rule"), F.lit(label).alias("key"), F.lit("label tied to split").alias("detail"))


def missing_audit_status(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    return row_violations(rows, key, {"missing_audit_status": (blank("audit_status"), F.lit("audit_status"))})


def _leakage_groups(rows: DataFrame) -> DataFrame:
    """Everything the leakage rules need, from one scan and one shuffle: per (check, key, detail) the number of rows, the
    smallest and largest other side, and whether a train-like and a holdout-like split occurs."""
    s, known = F.trim(F.col("split")), lambda c: F.trim(F.col(c).cast("string"))
    none = F.lit(None).cast("string")

    def entry(check: str, when: Column, key: Column, side: Column = none, detail: Column = none) -> Column:
        made = F.struct(F.lit(check).alias("check"), key.alias("key"), side.alias("side"), detail.alias("detail"), s.isin(*TRAIN_LIKE).alias("t"), s.isin(*HOLDOUT_LIKE).alias("h"))
        return F.when(when, made)

    entity = F.col("entity_id").cast("string")
    entries = [
        entry("rows", F.lit(True), none),
        entry("missing_audit_status", F.coalesce(blank("audit_status"), F.lit(False)), entity, detail=F.lit("audit_status")),
        entry("cell_level_split", F.coalesce(F.trim("entity_type").isin(*CELL_UNITS), F.lit(False)), entity, detail=F.col("entity_type").cast("string")),
        *[entry(f"{f}_in_several_splits", ~is_missing(f) & (s != ""), known(f), s) for f in ("patient_id", "donor_id", "sample_id", "cell_id")],
        entry("cohort_contamination", ~is_missing("cohort_id"), known("cohort_id")),
        entry("batch_confounding", ~is_missing("batch_id") & (s != ""), s, known("batch_id")),
        entry("label_leakage", ~is_missing("disease_label") & (s != ""), known("disease_label"), s),
    ]
    spread = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    return spread.groupBy("check", "key", "detail").agg(
        F.count(F.lit(1)).alias("n"), F.min("side").alias("a"), F.max("side").alias("b"), F.max("t").alias("t"), F.max("h").alias("h")
    )


def _direct_rules() -> tuple[Column, Column, Column, Column]:
    """Groups that are violations by themselves: of single rows, of ids, of cohorts, of batches."""
    check = F.col("check")
    return (
        check.isin("missing_audit_status", "cell_level_split"),
        check.endswith("_in_several_splits") & (F.col("a") != F.col("b")),
        (check == "cohort_contamination") & F.col("t") & F.col("h"),
        (check == "batch_confounding") & (F.col("a") == F.col("b")),
    )


def _leakage_found(groups: DataFrame) -> DataFrame:
    """``rule, key, detail, n``: violations of the grouped checks, ``n`` equal ones per row."""
    check, one = F.col("check"), F.lit(1).cast("bigint")
    by_row, several, cohort, batch = _direct_rules()
    detail = F.when(by_row, F.col("detail")).when(several, F.concat_ws(",", "a", "b")).when(batch, F.col("a")).otherwise("train-like and holdout")
    direct = groups.where(by_row | several | cohort | batch).select(check.alias("rule"), "key", detail.alias("detail"), F.when(by_row, F.col("n")).otherwise(one).alias("n"))
    verdict = groups.where(check == "label_leakage").agg(
        F.count(F.lit(1)).alias("labels"), F.bool_and(F.col("a") == F.col("b")).alias("single"), F.min("a").alias("a"), F.max("b").alias("b")
    )
    tied = verdict.where((F.col("labels") >= 2) & F.col("single") & (F.col("a") != F.col("b")))
    return direct.unionByName(tied.select(F.lit("label_leakage").alias("rule"), F.lit("disease_label").alias("key"), F.lit("label tied to split").alias("detail"), one.alias("n")))


def leakage_checks(rows: DataFrame) -> DataFrame:
    """All leakage checks of a manifest, as one violations table; the manifest is read once."""
    # Written, else each rule's filter moves below the aggregate and the manifest is read once per rule.
    found = _leakage_found(durable(_leakage_groups(rows)))
    return found.select("rule", "key", "detail", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).drop("col")


def leakage_report(rows: DataFrame) -> DataFrame:
    """The report on all leakage checks in one pass: groups fold to one row per check, and those to the report."""
    by_row, several, cohort, batch = _direct_rules()
    per_check = _leakage_groups(rows).groupBy("check").agg(
        F.sum("n").alias("n"), F.sum(F.when(by_row, F.col("n")).when(several | cohort | batch, 1).otherwise(0)).alias("direct"),
        F.count(F.lit(1)).alias("keys"), F.bool_and(F.col("a") == F.col("b")).alias("single"), F.min("a").alias("a"), F.max("b").alias("b"),
    )
    tied = (F.col("check") == "label_leakage") & (F.col("keys") >= 2) & F.col("single") & (F.col("a") != F.col("b"))
    counted = per_check.select("check", "n", F.when(tied, F.lit(1)).otherwise(F.col("direct")).cast("bigint").alias("v"))
    folded = counted.agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("n_violations"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("v") > 0, F.col("check")))), "; ").alias("errors"),
        F.coalesce(F.sum(F.when(F.col("check") == "rows", F.col("n"))), F.lit(0)).alias("checked_rows"),
    )
    return folded.select(F.when(F.col("n_violations") > 0, "FAIL").otherwise("PASS").alias("status"), "n_violations", "errors", "checked_rows")


def id_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Known ids on both sides, sorted by the caller if wanted."""
    side = lambda d: d.where(~is_missing(key)).select(F.col(key).cast("string").alias(key))
    return side(train).intersect(side(test))


# --- split manifests and folds --------------------------------------------------


def split_manifest(rows: DataFrame, key: str = "entity_id", units: Sequence[str] = DONOR_UNITS, splits: Sequence[str] = SPLITS) -> DataFrame:
    unit, split = F.trim("entity_type"), F.trim("split")
    found = row_violations(
        rows,
        key,
        {
            "missing_audit_status": (blank("audit_status"), F.lit("audit_status")),
            "cell_level_split": (unit.isin(*CELL_UNITS), F.col("entity_type")),
            "unsupported_entity_type": (~F.coalesce(unit, F.lit("")).isin(*units, *CELL_UNITS), F.col("entity_type")),
            "unsupported_split": (~F.coalesce(split, F.lit("")).isin(*splits), F.col("split")),
            "missing_entity_id": (blank(key), F.lit(key)),
        },
    )
    both = rows.where(~blank(key)).groupBy(F.trim(F.col(key).cast("string")).alias(key)).agg(
        F.max(split == "train").alias("_a"), F.max(split == "test").alias("_b")
    )
    return found.unionByName(_as_violations(both.where(F.col("_a") & F.col("_b")), "train_test_overlap", key, F.lit("train,test")))


def donor_manifest(
    rows: DataFrame, labels: Sequence[str], required_splits: Sequence[str] = TRAIN_LIKE, expected: int | None = None,
    donor: str = "donor_id", split: str = "split", label: str = "label_group",
) -> DataFrame:
    """Unique donors, one split each, required splits present, labels in domain, expected number of donors."""
    per_donor = rows.groupBy(donor).agg(F.count(F.lit(1)).alias("_n"), F.min(split).alias("_a"), F.max(split).alias("_b"))
    frames = [
        _as_violations(per_donor.where(F.col("_n") > 1), "duplicate_donor", donor, F.col("_n")),
        _as_violations(per_donor.where(F.col("_a") != F.col("_b")), "donor_in_several_splits", donor, F.concat_ws(",", "_a", "_b")),
        row_violations(rows, donor, {"label_outside_domain": (~F.coalesce(F.col(label), F.lit("")).isin(*labels), F.col(label))}),
    ]
    present = rows.agg(*[F.coalesce(F.max(F.col(split) == s), F.lit(False)).alias(f"_{i}") for i, s in enumerate(required_splits)])
    gaps = F.array_compact(F.array(*[F.when(~F.col(f"_{i}"), F.lit(s)) for i, s in enumerate(required_splits)]))
    frames.append(present.select(F.explode(gaps).alias("key")).select(F.lit("missing_split").alias("rule"), "key", F.lit("no donor").alias("detail")))
    if expected is not None:
        n = per_donor.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") != expected)
        frames.append(n.select(F.lit("unexpected_donor_count").alias("rule"), F.lit("donors").alias("key"), F.col("_n").cast("string").alias("detail")))
    return union_all(frames)


def fold_checks(roles: DataFrame, donors: DataFrame, donor: str = "donor_id") -> DataFrame:
    """Folds have two non-empty disjoint sides, donors are unique, known and each held out."""
    side = lambda r: F.max(F.col("role") == r)
    per_fold = roles.groupBy("fold_id").agg(side("train").alias("_a"), side("test").alias("_b"))
    pairs = roles.groupBy("fold_id", donor).agg(side("train").alias("_a"), side("test").alias("_b"), F.count(F.lit(1)).alias("_n"))
    held = roles.where(F.col("role") == "test").select(donor).distinct()
    known = donors.select(donor).distinct()
    return union_all(
        [
            _as_violations(per_fold.where(~(F.col("_a") & F.col("_b"))), "empty_side", "fold_id", F.lit("train and test needed")),
            _as_violations(pairs.where(F.col("_a") & F.col("_b")), "donor_on_both_sides", donor, F.col("fold_id")),
            _as_violations(pairs.where(F.col("_n") > 1), "donor_repeated_in_fold", donor, F.col("fold_id")),
            _as_violations(known.join(held, donor, "left_anti"), "never_held_out", donor, F.lit("no test fold")),
            _as_violations(held.join(known, donor, "left_anti"), "unknown_donor", donor, F.lit("not in donor table")),
        ]
    )


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return _as_violations(n.where(F.col("_n") > 1), f"duplicate_{key}", key, F.col("_n"))


# --- value manifests ------------------------------------------------------------


def canonical_metadata(rows: DataFrame, key: str, required: Sequence[str], tokens: Sequence[str] = LEAKAGE_MISSING, split_group: str | None = None) -> DataFrame:
    """Required fields exist and are resolved; the split unit is not the cell."""
    require_columns(rows, required)
    rules = {f"unresolved_{f}": (is_missing(f, tokens), F.lit(f)) for f in required}
    if split_group:
        rules["cell_level_split"] = (F.trim(split_group).isin(*CELL_SPLIT_GROUPS), F.col(split_group))
    return row_violations(rows, key, rules)


def _unit_rules(unit: str, allowed: Sequence[str], forbidden: Sequence[str]) -> dict:
    u = F.lower(F.trim(F.col(unit)))
    return {
        "cell_level_unit": (u.isin(*forbidden), F.col(unit)),
        "unsupported_unit": (~F.coalesce(u, F.lit("")).isin(*allowed, *forbidden), F.col(unit)),
    }


def _required_rules(fields: Sequence[str]) -> dict:
    return {f"missing_{f}": (blank(f), F.lit(f)) for f in fields}


def composition_rows(rows: DataFrame, key: str = "feature_id") -> DataFrame:
    n, total, share = (F.col(c).try_cast("double") for c in ("cell_count", "total_cells", "cell_type_fraction"))
    return row_violations(
        rows,
        key,
        _required_rules(
            ["feature_id", "dataset_id", "aggregation_id", "cell_type", "transformation_status", "split_group", "audit_status"]
        )
        | _unit_rules("aggregation_unit", DONOR_UNITS, CELL_UNITS)
        | {
            "not_numeric": (n.isNull() | total.isNull() | share.isNull(), F.lit("cell_count, total_cells, cell_type_fraction")),
            "total_not_positive": (total <= 0, F.col("total_cells")),
            "count_outside_total": ((total > 0) & ((n < 0) | (n > total)), F.col("cell_count")),
            "fraction_outside_unit": ((share < 0) | (share > 1), F.col("cell_type_fraction")),
            "cell_level_split": (F.lower(F.trim("split_group")).isin(*CELL_SPLIT_GROUPS), F.col("split_group")),
        },
    )


def pseudobulk_rows(rows: DataFrame, key: str = "feature_id") -> DataFrame:
    method = F.coalesce(F.col("aggregation_method"), F.lit(""))
    return row_violations(
        rows,
        key,
        _required_rules(
            ["feature_id", "dataset_id", "aggregation_id", "aggregation_method", "value_type", "normalization_status", "split_group", "audit_status"]
        )
        | _unit_rules("aggregation_unit", DONOR_UNITS, CELL_UNITS)
        | {
            "unknown_method": (~method.isin(*AGGREGATION_METHODS), F.col("aggregation_method")),
            "cell_level_split": (F.lower(F.trim("split_group")).isin(*CELL_SPLIT_GROUPS), F.col("split_group")),
        },
    )


def _gate_rules() -> dict:
    return {
        "label_not_verified": (~as_true("label_verified"), F.col("label_verified")),
        "leakage_checks_not_passed": (~as_true("leakage_checks_passed"), F.col("leakage_checks_passed")),
    }


def prediction_rows(rows: DataFrame, key: str = "run_id") -> DataFrame:
    no_id = blank("patient_id") & blank("donor_id") & blank("sample_id")
    return row_violations(
        rows,
        key,
        _required_rules(["run_id", "dataset_id", "split", "true_label", "predicted_score", "predicted_label", "audit_status"])
        | _unit_rules("prediction_unit", PREDICTION_UNITS, CELL_PREDICTION_UNITS)
        | {"no_identifier": (no_id, F.lit("patient_id, donor_id, sample_id"))}
        | _gate_rules(),
    )


def calibration_rows(rows: DataFrame, key: str = "run_id") -> DataFrame:
    n = F.col("n_patients").cast("string").try_cast("int")
    return row_violations(
        rows,
        key,
        _required_rules(["run_id", "dataset_id", "model_family", "task", "status", "audit_status"])
        | _unit_rules("prediction_unit", PREDICTION_UNITS, CELL_PREDICTION_UNITS)
        | {
            "n_patients_not_integer": (n.isNull(), F.col("n_patients")),
            "n_patients_not_positive": (n <= 0, F.col("n_patients")),
        }
        | _gate_rules(),
    )


def threshold_decisions(rows: DataFrame, key: str = "threshold_id") -> DataFrame:
    return row_violations(
        rows,
        key,
        {
            "missing_audit_status": (blank("audit_status"), F.lit("audit_status")),
            "guessed_threshold": (F.lower(F.trim("threshold_source")) == "guessed", F.col("threshold_source")),
            "applied_without_approver": (as_true("applied") & blank("approved_by"), F.col("applied")),
        },
    )


def cell_gene_matrix(cells: DataFrame, genes: DataFrame, counts: DataFrame, cell: str = "cell_id", gene: str = "gene_id", required: Sequence[str] = ()) -> DataFrame:
    """Unique cell and gene ids, required cell fields present, and every count refers to a known cell and gene."""
    orphans = lambda dim, key, rule: _as_violations(
        counts.select(key).distinct().join(dim.select(key), key, "left_anti"), rule, key, F.lit("in counts only")
    )
    frames = [
        duplicate_ids(cells, cell), duplicate_ids(genes, gene),
        orphans(cells, cell, "unknown_cell"), orphans(genes, gene, "unknown_gene"),
    ]
    if required:
        frames.append(row_violations(cells, cell, _required_rules(required)))
    return union_all(frames)


def readiness(
    cells: DataFrame, genes: DataFrame, counts: DataFrame, donor: str = "donor_id", symbol: str = "gene_symbol",
    minimum_donors: int = 1, mito_prefix: str = "MT-", require_mito: bool = True,
) -> DataFrame:
    """Matrix consistency plus enough donors, usable symbols and (if wanted) at least one mitochondrial gene."""
    donors = cells.agg(F.countDistinct(donor).alias("_n")).where(F.col("_n") < minimum_donors)
    frames = [
        cell_gene_matrix(cells, genes, counts, required=[donor]),
        row_violations(genes, "gene_id", {"blank_symbol": (blank(symbol), F.lit(symbol))}),
        donors.select(F.lit("too_few_donors").alias("rule"), F.lit("donors").alias("key"), F.col("_n").cast("string").alias("detail")),
    ]
    if require_mito:
        flag = F.upper(F.trim(symbol)).startswith(mito_prefix.upper())
        none = genes.agg(F.count_if(flag).alias("_n")).where(F.col("_n") == 0)
        frames.append(none.select(F.lit("no_mitochondrial_gene").alias("rule"), F.lit(symbol).alias("key"), F.lit(mito_prefix).alias("detail")))
    return union_all(frames)


def declared_totals(declared: Mapping[str, int], observed: DataFrame) -> DataFrame:
    """Declared numbers against a one-row table of observed ones."""
    rules = {f"differs_{k}": (F.col(k) != F.lit(v), F.concat_ws(" vs ", F.lit(str(v)), F.col(k).cast("string"))) for k, v in declared.items()}
    return row_violations(observed, F.lit("manifest"), rules)


def donor_features(rows: DataFrame, donor: str = "donor_id", features: str = "features", split: str = "split", label: str = "label") -> DataFrame:
    """Feature records fit for a classifier: unique donors, one vector size, finite values, enough rows and labels."""
    bad = row_violations(rows, donor, {"unusable_vector": (vector_problem(features).isNotNull(), vector_problem(features))})
    train = F.col(split) == "train"
    stats = rows.agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(train).alias("_train"), F.count_if(~train).alias("_held"),
        F.min(F.size(features)).alias("_lo"), F.max(F.size(features)).alias("_hi"),
        (F.min(F.when(train, F.col(label))) != F.max(F.when(train, F.col(label)))).alias("_two"),
    )
    table = row_violations(
        stats,
        F.lit("table"),
        {
            "too_few_rows": (F.col("_n") < 3, F.col("_n")),
            "too_few_train_rows": (F.col("_train") < 2, F.col("_train")),
            "one_train_label": (~F.coalesce(F.col("_two"), F.lit(False)), F.lit("train")),
            "nothing_held_out": (F.col("_held") < 1, F.col("_held")),
            "sizes_differ": (F.col("_lo") != F.col("_hi"), F.concat_ws(",", "_lo", "_hi")),
        },
    )
    return union_all([duplicate_ids(rows, donor), bad, table])


def prediction_sanity(rows: DataFrame, positive: str, key: str = "donor_id", label: str = "true_label", predicted: str = "predicted_label", score: str = "score") -> DataFrame:
    """Exactly two labels, the positive one among them, scores inside [0, 1]."""
    bad = row_violations(rows, key, {"score_outside_unit": (~F.coalesce(F.col(score).between(0.0, 1.0), F.lit(False)), F.col(score))})
    seen = rows.select(F.explode(F.array(label, predicted)).alias("_l")).groupBy("_l").agg(F.lit(1).alias("_one"))
    stats = seen.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.max(F.col("_l") == positive), F.lit(False)).alias("_has"))
    return bad.unionByName(
        row_violations(
            stats, F.lit("table"), {"not_two_labels": (F.col("_n") != 2, F.col("_n")), "no_positive_label": (~F.col("_has"), F.lit(positive))}
        )
    )


def vector_rows(rows: DataFrame, size: int | None = None, donor: str = "donor_id", cell: str = "cell_id", vector: str = "embedding") -> DataFrame:
    """Cell vector records: ids present, vectors non-empty, finite and of the expected size, cell ids unique."""
    problem = vector_problem(vector, size)
    found = row_violations(
        rows, cell, {f"missing_{donor}": (blank(donor), F.lit(donor)), f"missing_{cell}": (blank(cell), F.lit(cell)), "unusable_vector": (problem.isNotNull(), problem)}
    )
    return found.unionByName(duplicate_ids(rows.where(~blank(cell)), cell))


def centroid_table(centroids: DataFrame, label: str = "label", vector: str = "centroid") -> DataFrame:
    problem = vector_problem(vector)
    bad = row_violations(centroids, label, {"unusable_centroid": (problem.isNotNull(), problem)})
    stats = centroids.agg(F.count(F.lit(1)).alias("_n"), F.min(F.size(vector)).alias("_lo"), F.max(F.size(vector)).alias("_hi"))
    return bad.unionByName(
        row_violations(
            stats, F.lit("table"), {"too_few_labels": (F.col("_n") < 2, F.col("_n")), "sizes_differ": (F.col("_lo") != F.col("_hi"), F.concat_ws(",", "_lo", "_hi"))}
        )
    )


def processed_output(cells: DataFrame, genes: DataFrame, summary: DataFrame, n_top: int, donor: str = "donor_id", group: str = "group") -> DataFrame:
    """Post-conditions of a processed cohort: n_top flagged genes, patient cells add up, ids unique, two groups or more."""
    flagged = genes.agg(F.count_if("highly_variable").alias("_n")).where(F.col("_n") != n_top)
    total = summary.agg(F.sum("n_cells").alias("_a")).withColumn("_b", cells.agg(F.count(F.lit(1)).alias("_b")).scalar())
    groups = summary.agg(F.countDistinct(group).alias("_n")).where(F.col("_n") < 2)
    one = lambda d, rule, detail: d.select(F.lit(rule).alias("rule"), F.lit("table").alias("key"), detail.cast("string").alias("detail"))
    return union_all(
        [
            one(flagged, "unexpected_variable_genes", F.col("_n")),
            one(total.where(F.col("_a") != F.col("_b")), "cells_do_not_add_up", F.concat_ws(" vs ", "_a", "_b")),
            one(groups, "fewer_than_two_groups", F.col("_n")),
            duplicate_ids(summary, donor),
        ]
    )


# --- catalogs -------------------------------------------------------------------


def candidate_rows(rows: DataFrame, key: str = "accession", statuses: Sequence[str] = CANDIDATE_STATUSES) -> DataFrame:
    status = F.trim("audit_status")
    return row_violations(
        rows,
        key,
        {
            "missing_key": (blank(key), F.lit(key)),
            "missing_audit_status": (blank("audit_status"), F.lit("audit_status")),
            "status_not_allowed": (~blank("audit_status") & ~status.isin(*statuses), status),
        },
    )


def patient_audit_rows(rows: DataFrame, key: str = "patient_id") -> DataFrame:
    return row_violations(
        rows, key, {f"missing_{f}": (is_missing(f, AUDIT_MISSING), F.lit(f)) for f in ("patient_id", "audit_status")}
    )


def label_audit_rows(rows: DataFrame, allowed: Sequence[str], critical: Sequence[str], key: str) -> DataFrame:
    """Critical fields known, label type allowed, no labels that exist per cell only."""
    return row_violations(
        rows,
        key,
        {f"missing_{f}": (is_missing(f, AUDIT_MISSING), F.lit(f)) for f in critical}
        | {
            "label_type_not_allowed": (~F.coalesce(F.trim("label_type"), F.lit("")).isin(*allowed), F.col("label_type")),
            "cell_level_only_label": (as_true("cell_level_only"), F.col("cell_level_only")),
        },
    )


def external_candidate_rows(rows: DataFrame, ready_fields: Sequence[str], key: str = "candidate_id") -> DataFrame:
    """Critical fields known, decision allowed, and a ready decision only with every critical field resolved."""
    ready = F.trim("decision") == "external_validation_ready"
    return row_violations(
        rows,
        key,
        {f"missing_{f}": (is_missing(f, EXTERNAL_MISSING), F.lit(f)) for f in EXTERNAL_CRITICAL_FIELDS}
        | {"decision_not_allowed": (~F.coalesce(F.trim("decision"), F.lit("")).isin(*EXTERNAL_DECISIONS), F.col("decision"))}
        | {f"ready_but_unresolved_{f}": (ready & is_missing(f, EXTERNAL_MISSING), F.lit(f)) for f in ready_fields},
    )


def approval_words(rows: DataFrame, key: str, fields: Sequence[str], words: Sequence[str] = APPROVAL_WORDS) -> DataFrame:
    """Rows in which any field is, as a whole, a word of approval."""
    hit = lambda f: F.lower(F.trim(F.col(f).cast("string"))).isin(*words)
    return row_violations(rows, key, {f"approval_in_{f}": (hit(f), F.col(f)) for f in fields})


def cohort_manifest(rows: DataFrame, key: str, required: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Schema-driven values, candidate roles only, provenance present, approved roles behind the human gate."""
    role = F.coalesce(F.trim("approved_role"), F.lit(""))
    gated = role.isin(*GATED_ROLES) & as_true("human_gate_approved")
    rules = _required_rules(required)
    rules |= {f"not_allowed_{f}": (~blank(f) & ~F.trim(f).isin(*v), F.col(f)) for f, v in allowed.items()}
    rules |= {
        "intended_role_not_allowed": (~F.coalesce(F.trim("intended_role"), F.lit("")).isin(*INTENDED_ROLES), F.col("intended_role")),
        "missing_audit_status": (blank("audit_status"), F.lit("audit_status")),
        "missing_provenance_url": (blank("provenance_url"), F.lit("provenance_url")),
        "dataset_selected": (as_true("selected_dataset"), F.col("selected_dataset")),
        "role_without_gate": (~role.isin(*UNAPPROVED_ROLES) & ~gated, role),
    }
    return row_violations(rows, key, rules)


def finite_features(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    return row_violations(rows, key, {f"not_finite_{f}": (~is_finite(f), F.col(f)) for f in fields})
