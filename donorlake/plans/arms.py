"""Whole analyses composed from the operators: one arm, an external cohort, two arms against each other, the
metadata baseline, and the confounding audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.functions.columns import (
    CELL_TYPE_NAMES,
    GROUP_NAMES,
    PATIENT_ID_NAMES,
    ContractError,
    batch_columns,
    canonical,
    drop_blank,
    reject_columns,
    resolve_column,
)
from donorlake.operators import confounding as cf
from donorlake.operators import donors as dn
from donorlake.operators import metrics as mt
from donorlake.operators import models as md
from donorlake.operators import pseudobulk as pb
from donorlake.operators import resample as rs
from donorlake.operators import splits as sp
from donorlake.session import durable

N_BOOTSTRAP, N_PERMUTATIONS, ALPHA = 5000, 1000, 0.05


def run_arm(
    name: str, donors: DataFrame, seed: int, fixed_c: float | None = None, permutation_c: float | None = None,
    n_bootstrap: int = N_BOOTSTRAP, n_permutations: int = N_PERMUTATIONS, key: str = "donor_id", label: str = "label",
) -> DataFrame:
    """Out-of-fold AUROC of one feature set with interval, refit permutation test and the null-mean sanity flag.

    ``permutation_c`` fixes C inside the permutations (for arms whose search is
    costly); without it every replicate repeats the whole nested search.
    """
    oof, picks = md.nested_cv(donors, seed, fixed_c=fixed_c, key=key, label=label)
    oof = durable(oof)
    # Written, since every column below is read from them by itself.
    boot = durable(rs.bootstrap_interval(rs.bootstrap_auroc(oof, ["score"], "label", key, n_bootstrap, seed)))
    null = md.permutation_refit(donors, n_permutations, seed, key, label, fixed_c=permutation_c if permutation_c is not None else fixed_c)
    observed = durable(mt.auroc(oof))
    summary = durable(rs.permutation_summary(null, observed, by=[]))
    chosen = picks.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("fold", "c"))), lambda p: p["c"])).alias("selected_c"))
    parts = [summary.withColumnRenamed("observed", "auroc"), observed.select("n_pos", "n_neg"), boot.drop("arm"), chosen]
    out = parts[0]
    for p in parts[1:]:
        out = out.withColumns({c: p.select(c).scalar() for c in p.columns if c not in out.columns})
    return out.withColumn("arm", F.lit(name))


def external_arm(
    dev: DataFrame, external: DataFrame, c: float, seed: int, strata: str | None = None, n_bootstrap: int = N_BOOTSTRAP,
    n_permutations: int = N_PERMUTATIONS, key: str = "donor_id", label: str = "label",
) -> tuple[DataFrame, DataFrame]:
    """Fit once on the development cohort at a frozen C, score the external cohort, and describe the scores.

    Returns the scores and one summary row per stratum (``all`` first).
    """
    scored = durable(md.score_external(md.fit_final(dev, c, key, label), external, key, label))
    groups = scored.withColumn("stratum", F.lit("all"))
    if strata:
        groups = groups.unionByName(scored.join(external.select(key, F.col(strata).cast("string").alias("stratum")), key))
    boot = rs.bootstrap_interval(rs.bootstrap_auroc(groups, ["score"], "label", key, n_bootstrap, seed, ["stratum"]), by=["stratum"])
    observed = mt.auroc(groups, by=["stratum"])
    null = rs.permutation_auroc(scored, ["score"], "label", key, n_permutations, seed)
    test = durable(rs.permutation_summary(null, mt.auroc(scored), by=[]))
    whole = lambda c: F.when(F.col("stratum") == "all", test.select(c).scalar())
    return scored, observed.join(boot, "stratum").withColumns({c: whole(c) for c in ("p_value", "null_mean", "null_std")})


def co_primary(
    arms: DataFrame, comparisons: Sequence[tuple[str, str, str]], seed: int, alpha: float = ALPHA, n_bootstrap: int = N_BOOTSTRAP,
    n_permutations: int = N_PERMUTATIONS, key: str = "donor_id", label: str = "label",
) -> DataFrame:
    """Paired differences between score columns of ``arms``: interval, permutation p, Holm step, decision.

    ``comparisons`` lists (name, arm a, arm b).
    """
    columns = sorted({a for _, *pair in comparisons for a in pair})
    arms = durable(arms.select(key, label, *columns))  # every step below walks over the scores again
    boot = durable(rs.bootstrap_auroc(arms, columns, label, key, n_bootstrap, seed))
    null = durable(rs.permutation_auroc(arms, columns, label, key, n_permutations, seed))
    seen = None
    for c in columns:
        one = mt.auroc(arms, c, label).select(F.lit(c).alias("arm"), F.lit(0).alias("replicate"), "auroc")
        seen = one if seen is None else seen.unionByName(one)
    seen = durable(seen)
    frames = []
    for name, a, b in comparisons:
        interval = rs.bootstrap_interval(rs.paired_difference(boot, a, b), "diff", by=[])
        observed = rs.paired_difference(seen, a, b).drop("replicate")
        test = rs.permutation_summary(rs.paired_difference(null, a, b), observed, "diff", by=[], alternative="difference")
        frames.append(
            test.select("observed", "p_value", "null_mean", "null_std").withColumns({c: interval.select(c).scalar() for c in interval.columns}).withColumn("test", F.lit(name))
        )
    table = durable(rs.union_all(frames))
    steps = rs.holm(table, alpha=alpha).drop("p_value")
    return rs.decide(table, steps)


def cohort_probe(dev: DataFrame, external: DataFrame, seed: int, **options) -> DataFrame:
    """Can the features tell the two cohorts apart? One arm run on cohort membership."""
    both = dn.cohort_union(dev.drop("label"), external.drop("label")).withColumnRenamed("cohort_label", "label")
    return run_arm("cohort_membership", both, seed, **options)


def metadata_design(donors: DataFrame, numeric: Sequence[str], categorical: Sequence[str], key: str = "donor_id"):
    """Feature arrays of a metadata-only model and each held-out donor's imputation vector.

    Unknown values are NaN. The levels of a category are those that occur (one column of the design each). A level that only the held-out donor has is constant
    zero in its training side, so its weight is 0: the same as an encoder that
    ignores unknown categories. Medians and modes come from everyone else.
    """
    nan = F.lit(float("nan"))
    parts = [F.coalesce(F.col(c).cast("double"), nan) for c in numeric]
    scaled = [True] * len(parts)
    rows, fills = donors, []
    for c in numeric:
        median = sp.loo_median(donors.select(key, c), c).select(key, F.col("train_median").alias(f"_fill_{c}"))
        rows = rows.join(median, key)
        fills.append(F.col(f"_fill_{c}"))
    for c in categorical:
        mode = sp.loo_mode(donors.select(key, c), c).select(key, F.col("train_mode").alias(f"_fill_{c}"))
        rows = rows.join(mode, key)
        levels = donors.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()
        for v in [r[0] for r in levels]:
            parts.append(F.when(F.col(c).isNull(), nan).otherwise((F.col(c) == v).cast("double")))
            fills.append((F.col(f"_fill_{c}") == v).cast("double"))
            scaled.append(False)
    fill = F.transform(F.array(*fills), lambda x: F.coalesce(x, F.lit(0.0)))
    out = rows.withColumns({"features": F.array(*parts), "fill": fill})
    return out.drop(*[f"_fill_{c}" for c in (*numeric, *categorical)]), scaled


def metadata_loocv(donors: DataFrame, numeric: Sequence[str], categorical: Sequence[str], c: float = 0.1, key: str = "donor_id", label: str = "label") -> DataFrame:
    """Leave-one-out predictions from donor metadata only, all preparation inside the fold."""
    rows, scaled = metadata_design(donors, numeric, categorical, key)
    rows = durable(rows)
    return md.loocv(rows.select(key, label, "features"), c, key, label, True, scaled, rows.select(key, "fill"))


def confounding_audit(cells: DataFrame, tasks: Sequence[cf.Task]) -> dict[str, DataFrame]:
    """All tables of the audit from cell metadata whose column names are resolved by alias."""
    reject_columns(cells.columns)
    donor = resolve_column(cells.columns, PATIENT_ID_NAMES, required=True)
    group = resolve_column(cells.columns, GROUP_NAMES, required=True)
    kind = resolve_column(cells.columns, CELL_TYPE_NAMES)
    sources = batch_columns(cells.columns, exclude=[c for c in (donor, group, kind) if c])
    rows = drop_blank(cells, donor, group)
    rows = canonical(rows, [donor, group]).withColumnsRenamed({donor: "donor_id", group: "group"} | ({kind: "cell_type"} if kind else {}))
    patients = dn.collapse(rows, "donor_id", "group").join(dn.cell_counts(rows), "donor_id")
    for s in sources:
        patients = patients.join(dn.collapse(rows, "donor_id", s, "mixed"), "donor_id")
    patients = patients.withColumn("log1p_n_cells", F.log1p(F.col("n_cells").cast("double")))
    manifest = cf.expand_tasks(patients, tasks)
    counts = cf.cell_count_audit(manifest)
    out = {"patients": patients, "manifest": manifest, "cell_counts": counts}
    if not kind:
        raise ContractError("the audit needs a cell type column")
    shares = dn.composition(rows)
    out["cell_types"] = cf.composition_audit(shares, manifest)
    out["categories"] = cf.category_audit(manifest, sources) if sources else cf.category_audit(manifest.withColumn("no_source", F.lit(None).cast("string")), ["no_source"])
    out["summary"] = cf.audit_summary(counts, out["cell_types"], out["categories"])
    return out


def pseudobulk_features(counts: DataFrame, cells: DataFrame, genes: DataFrame | None = None, donor: str = "donor_id") -> DataFrame:
    """Counts to log1p-CPM features; with ``genes`` the counts are restricted before they are normalised."""
    kept = counts if genes is None else pb.restrict_genes(counts, genes)
    return pb.cpm_log1p(pb.pseudobulk(kept, cells, donor), donor)
