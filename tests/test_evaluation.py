import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from donorlake.functions.columns import ContractError
from donorlake.operators import confounding as cf
from donorlake.operators import metrics as mt
from donorlake.operators import models as md
from donorlake.operators import resample as rs
from donorlake.operators import splits as sp
from donorlake.plans import arms

TASKS = [cf.Task("flare_vs_managed", "Flare", "Managed"), cf.Task("flare_vs_healthy", "Flare", "Healthy")]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def audit_cells(spark):
    spec = [
        ("FLARE001", "Flare", "site_a", "batch_1", 8, 2), ("FLARE002", "Flare", "site_a", "batch_1", 12, 8), ("MGD001", "Managed", "site_b", "batch_2", 1, 4),
        ("MGD002", "Managed", "site_b", "batch_2", 1, 4), ("HC001", "Healthy", "site_c", "batch_3", 2, 8), ("HC002", "Healthy", "site_c", "batch_3", 2, 10),
    ]
    out = [(p, g, t, s, b) for p, g, s, b, nb, nt in spec for t, n in (("B", nb), ("T", nt)) for _ in range(n)]
    return spark.createDataFrame(out + [(None, "Flare", "B", "x", "y"), (" ", "Flare", "B", "x", "y")], "patient_id string, disease_group string, cell_type string, source string, batch string")


def test_confounding_audit(audit_cells):
    out = arms.confounding_audit(audit_cells, TASKS)
    first = out["patients"].where("donor_id = 'FLARE001'").head()
    assert first["n_cells"] == 10 and first["log1p_n_cells"] == pytest.approx(math.log1p(10))
    task = out["manifest"].where("task = 'flare_vs_managed'")
    assert rows(task.select("donor_id", "label"), "donor_id") == [("FLARE001", 1), ("FLARE002", 1), ("MGD001", 0), ("MGD002", 0)]
    count = out["cell_counts"].where("task = 'flare_vs_managed'").head()
    assert (count["mean_n_cells_case"], count["mean_n_cells_control"], count["warning_flag"]) == (15.0, 5.0, "strong")
    b = out["cell_types"].where("task = 'flare_vs_managed' and cell_type = 'B'").head()
    assert (b["mean_prop_case"], b["mean_prop_control"]) == pytest.approx((0.7, 0.2)) and b["warning_flag"] == "strong"
    site = out["categories"].where("task = 'flare_vs_managed' and category = 'site_a'").head()
    assert site["present_in_only_one_class"] and site["warning_flag"] == "strong"
    summary = out["summary"].where("task = 'flare_vs_managed'").head()
    assert summary["warning_flag"] == "strong" and summary["top_cell_type_imbalances"] == "B=0.500; T=0.500"
    assert summary["source_batch_warning_fields"] == "batch; source"
    with pytest.raises(ContractError):
        arms.confounding_audit(audit_cells.withColumn("pc1", F.lit(1)), TASKS)


@pytest.mark.parametrize(
    "case, control, want",
    [([], [1.0], None), ([1.0], [1.0], 0.0), ([1.0], [2.0], None), ([2.0, 2.0], [2.0, 2.0], 0.0), ([2.0, 2.0], [1.0, 1.0], math.inf), ([1.0, 3.0], [0.0, 2.0], 1 / math.sqrt(2))],
)
def test_smd_edges(spark, case, control, want):
    df = spark.createDataFrame([(1, v) for v in case] + [(0, v) for v in control], "label int, v double")
    got = cf.smd(df, "v").head()["smd"]
    assert got == want if want is None else got == pytest.approx(want)


def test_chi_square_published_table(spark):
    counts = {("flare", "female"): 14, ("healthy", "female"): 96, ("healthy", "male"): 2, ("managed", "female"): 133, ("managed", "male"): 15}
    df = spark.createDataFrame([(g, s, "blood") for (g, s), n in counts.items() for _ in range(n)], "grp string, sex string, tissue string")
    got = cf.chi_square(df, ["sex", "tissue"], "grp")
    male = got.where("feature = 'sex' and level = 'male' and grp = 'flare'").head()
    assert (male["patient_count"], male["group_total"], male["dof"]) == (0, 14, 2.0)
    assert male["chi2"] == pytest.approx(7.356440073526908) and male["p_value"] == pytest.approx(0.025267910783454067)
    assert {r["p_value"] for r in got.where("feature = 'tissue'").collect()} == {None}


def test_chi2_tail_known_values(spark):
    df = spark.createDataFrame([(3.841458820694124, 1.0), (5.991464547107979, 2.0), (7.814727903251179, 3.0), (11.070497693516351, 5.0), (0.0, 3.0), (None, 2.0)], "x double, k double")
    got = [r[0] for r in df.select(cf.chi2_tail("x", "k")).collect()]
    assert got[:5] == pytest.approx([0.05, 0.05, 0.05, 0.05, 1.0]) and got[5] is None


def test_kruskal_small_example(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0)] + [("b", v) for v in (3.0, 4.0)] + [("c", v) for v in (2.0, 6.0, 7.0)], "grp string, v double")
    got = cf.kruskal(df, "v", "grp").head()
    pdf = df.toPandas()
    r = pdf["v"].rank()
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(x.sum() ** 2 / len(x) for _, x in r.groupby(pdf["grp"])) - 3 * (n + 1)
    ties = pdf["v"].value_counts()
    h /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    assert got["h"] == pytest.approx(h) and got["p_value"] == pytest.approx(math.exp(-h / 2))


def test_summaries(spark):
    df = spark.createDataFrame([("dev", 1.0, "f"), ("dev", 3.0, None), ("dev", None, "f")], "cohort string, age double, sex string")
    got = {c: v for _, _, c, v in rows(cf.numeric_summary(df, "age", "cohort"), "category")}
    assert got == {"n": 2.0, "mean": 2.0, "sd": pytest.approx(math.sqrt(2)), "min": 1.0, "median": 2.0, "max": 3.0}
    cats = rows(cf.categorical_summary(df, ["sex", "eth"], "cohort").select("variable", "category", "n"), "variable", "category")
    assert cats == [("eth", "NOT_AVAILABLE", None), ("sex", "__missing__", 1), ("sex", "f", 2)]


# --- metrics ------------------------------------------------------------------------


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([("flare", "flare", 0.8), ("managed", "managed", 0.2), ("flare", "managed", 0.3)], "t string, p string, score double")
    df = df.select((F.col("t") == "flare").cast("int").alias("label"), (F.col("p") == "flare").cast("int").alias("predicted"), "score")
    r = mt.confusion(df).head()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (1, 1, 0, 1)
    assert (r["accuracy"], r["balanced_accuracy"], r["sensitivity"], r["specificity"], r["precision"], r["f1"]) == pytest.approx((2 / 3, 0.75, 0.5, 1.0, 1.0, 2 / 3))
    assert mt.brier(df).head()["brier"] == pytest.approx((0.04 + 0.04 + 0.49) / 3)
    none = df.withColumns({"label": F.lit(0), "predicted": F.lit(0)})
    z, n = mt.confusion(none).head(), mt.confusion(none, zero_division="nan").head()
    assert (z["sensitivity"], z["precision"], z["f1"]) == (0.0, 0.0, 0.0)
    assert math.isnan(n["sensitivity"]) and math.isnan(n["precision"]) and n["f1"] == 0.0


def test_average_precision_is_the_step_sum(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"score": np.round(rng.random(80), 1), "label": rng.integers(0, 2, 80)})
    df = spark.createDataFrame(pdf)
    ap, last = 0.0, 0.0
    for t in sorted(pdf.score.unique(), reverse=True):
        hit = pdf[pdf.score >= t]
        recall = hit.label.sum() / pdf.label.sum()
        ap += (recall - last) * hit.label.mean()
        last = recall
    assert mt.average_precision(df).head()[0] == pytest.approx(ap)
    roc = mt.roc_points(df).orderBy("fpr", "tpr").toPandas()
    assert np.trapezoid(roc.tpr, roc.fpr) == pytest.approx(mt.auroc(df).head()["auroc"])
    assert mt.precision_recall_points(df).where("recall = 1").count() >= 1


def test_calibration_and_histogram(spark):
    df = spark.createDataFrame([(0.0, 0), (0.05, 1), (0.95, 1), (1.0, 1)], "score double, label int")
    table = rows(mt.reliability(df), "bin")
    assert [(b, n) for b, n, *_ in table] == [(0, 2), (9, 2)]
    assert mt.ece(df).head()[0] == pytest.approx(0.5 * 0.475 + 0.5 * 0.025)
    tied = df.withColumn("score", F.lit(0.7))
    assert mt.reliability(tied, strategy="adaptive").count() == 1
    assert rows(mt.histogram(df, "score", 0.0, 1.0, 2).select("bin", "n"), "bin") == [(0, 2), (1, 2)]
    assert df.select(mt.entropy("score")).first()[0] == 0.0


# --- splits -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(6)
    data = [(f"d{i:03d}", int(rng.integers(0, 2)), None if i % 9 == 0 else float(np.round(rng.normal(), 1)), None if i % 7 == 0 else "fmx"[int(rng.integers(0, 2))]) for i in range(40)]
    data[3] = ("d003", 1, 0.5, "Unknown")
    return spark.createDataFrame(data, "donor_id string, label int, age double, sex string")


def test_fold_assignments(people):
    loo = rows(sp.leave_one_out(people.select("donor_id")), "donor_id")
    assert loo[0] == ("d000", "loocv_001") and loo[39] == ("d039", "loocv_040")
    rr = rows(sp.round_robin_kfold(people.select("donor_id"), 3), "donor_id")
    assert [f for _, f in rr] == [i % 3 for i in range(40)]
    for folds in (sp.shuffled_kfold(people, 4, seed=1), sp.round_robin_kfold(people, 4, stratify="label")):
        sizes = folds.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d")).collect()
        assert all(r["d"] <= 1 for r in sizes)
    a = rows(sp.shuffled_kfold(people, 4, seed=1).select("donor_id", "fold"), "donor_id")
    assert a != rows(sp.shuffled_kfold(people, 4, seed=2).select("donor_id", "fold"), "donor_id")


def test_leave_one_out_statistics_match_brute_force(people):
    pdf = people.toPandas()
    med = sp.loo_median(people, "age").toPandas().set_index("donor_id")["train_median"]
    mode = sp.loo_mode(people, "sex").toPandas().set_index("donor_id")
    known = people.where("age is not null").withColumn("feature_id", F.lit("age"))
    mom = sp.loo_moments(known, "age").toPandas().set_index("donor_id")
    cls = sp.loo_class_counts(people).toPandas().set_index("donor_id")
    for i, row in pdf.iterrows():
        train = pdf.drop(i)
        assert med[row.donor_id] == pytest.approx(train.age.median())
        counts = train.sex.value_counts()
        assert mode.loc[row.donor_id, "train_mode"] == sorted(counts[counts == counts.max()].index)[0]
        assert mode.loc[row.donor_id, "category_in_train"] == (row.sex in set(train.sex.dropna()))
        assert cls.loc[row.donor_id, "n_train_cases"] == train.label.sum()
        if not np.isnan(row.age):
            assert mom.loc[row.donor_id, "train_mean"] == pytest.approx(train.age.mean())
            assert mom.loc[row.donor_id, "train_sd"] == pytest.approx(train.age.std(ddof=0))
    assert not mode.loc["d003", "category_in_train"]


def test_constant_feature_has_divisor_one(spark):
    df = spark.createDataFrame([("a", "f", 0.1), ("b", "f", 0.1), ("c", "f", 0.1), ("d", "f", 5.0)], "donor_id string, feature_id string, value double")
    got = sp.loo_moments(df).where("donor_id = 'd'").head()
    assert (got["train_mean"], got["train_sd"]) == (pytest.approx(0.1), 1.0)
    z = md.standardize(df, F.col("donor_id") != "d").where("donor_id = 'd'").head()
    assert z["train_sd"] == 1.0 and z["z"] == pytest.approx(4.9)


def test_fold_imputers_and_one_hot_use_training_rows(people):
    roles = sp.fold_roles(sp.shuffled_kfold(people, 4, seed=1), 4)
    pdf = roles.where("role = 'train'").toPandas()
    got = md.fold_imputers(roles, ["age"], ["sex"]).toPandas()
    for f, train in pdf.groupby("fold_id"):
        assert got[(got.fold_id == f) & (got.column == "age")]["median"].item() == pytest.approx(train.age.median())
        assert got[(got.fold_id == f) & (got.column == "sex")]["mode"].item() == train.sex.mode()[0]
    hot = md.one_hot(roles, "sex")
    held = roles.where("donor_id = 'd003' and role = 'test'").head()["fold_id"]
    assert hot.where((F.col("donor_id") == "d003") & (F.col("fold_id") == held)).count() == 0


# --- resampling -----------------------------------------------------------------------

SCORES = "donor_id string, label int, score double, other double"


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 40)
    return spark.createDataFrame([(f"d{i}", int(v), float(np.round(v + rng.normal(), 1)), float(rng.normal())) for i, v in enumerate(y)], SCORES)


def test_bootstrap_is_seeded_paired_and_counts_skips(spark, scored):
    reps = rs.bootstrap_auroc(scored, ["score", "other"], n=60, seed=1)
    again = rs.bootstrap_auroc(scored.repartition(3), ["score", "other"], n=60, seed=1)
    assert rows(reps, "arm", "replicate") == rows(again, "arm", "replicate")
    sizes = reps.withColumn("s", F.col("n_pos") + F.col("n_neg")).select("s").distinct().collect()
    assert [r["s"] for r in sizes] == [40]
    same = reps.groupBy("replicate").agg(F.countDistinct("n_pos").alias("k")).where("k > 1").count()
    assert same == 0
    ci = rs.bootstrap_interval(reps).where("arm = 'score'").head()
    assert ci["ci_lower"] < mt.auroc(scored).head()["auroc"] < ci["ci_upper"] and ci["n_skipped"] == 0
    few = spark.createDataFrame([("a", 1, 0.9, 0.0), ("b", 0, 0.1, 0.0)], SCORES)
    ci = rs.bootstrap_interval(rs.bootstrap_auroc(few, n=50, seed=2)).head()
    assert ci["n_skipped"] > 0 and ci["n_valid"] + ci["n_skipped"] == 50 and ci["ci_lower"] == 1.0


def test_permutation_equals_auroc_of_shuffled_labels(scored):
    null = rs.permutation_auroc(scored, ["score"], n=40, seed=3).toPandas()
    assert len(null) == 40 and abs(null.auroc.mean() - 0.5) < 0.08
    from donorlake.operators.models import shuffled_labels

    relabelled = shuffled_labels(scored, 40, 3)
    assert {r["s"] for r in relabelled.groupBy("rep").agg(F.sum("label").alias("s")).collect()} == {scored.agg(F.sum("label")).head()[0]}
    want = mt.auroc(relabelled, by=["rep"]).toPandas().sort_values("rep")["auroc"]
    assert np.allclose(null.sort_values("replicate")["auroc"], want)


def test_permutation_p_values(spark):
    null = spark.createDataFrame([(0.1,), (0.8,), (0.9,), (None,)], "auroc double")
    seen = spark.createDataFrame([(0.8,)], "auroc double")
    up = rs.permutation_summary(null, seen, by=[], alternative="greater", ddof=1).head()
    assert up["p_value"] == 3 / 4 and (up["n_permutations"], up["n_valid"]) == (4, 3)
    assert up["null_std"] == pytest.approx(np.std([0.1, 0.8, 0.9], ddof=1))
    assert rs.permutation_summary(null, seen, by=[]).head()["p_value"] == 1.0
    diff = rs.permutation_summary(null, seen, by=[], alternative="difference").head()
    assert diff["p_value"] == 3 / 4


@pytest.mark.parametrize("p1, p2, want", [(0.0869, 0.1838, [False, False]), (0.02, 0.04, [True, True]), (0.02, 0.06, [True, False]), (0.026, 0.03, [False, False]), (0.03, 0.03, [False, False]), (0.02, 0.02, [True, True])])
def test_holm_two_tests(spark, p1, p2, want):
    df = spark.createDataFrame([("a", p1), ("b", p2)], "test string, p_value double")
    got = {r["test"]: r["significant"] for r in rs.holm(df).collect()}
    assert [got["a"], got["b"]] == want


def test_holm_many_matches_loop_and_decision(spark):
    ps = [0.001, 0.2, 0.012, 0.008, 0.03]
    df = spark.createDataFrame([(f"t{i}", p) for i, p in enumerate(ps)], "test string, p_value double")
    want, stop = {}, False
    for step, i in enumerate(np.argsort(ps)):
        stop = stop or ps[i] > 0.05 / (len(ps) - step)
        want[f"t{i}"] = not stop
    holm = rs.holm(df)
    assert {r["test"]: r["significant"] for r in holm.collect()} == want
    ci = spark.createDataFrame([("t0", 0.1), ("t2", -0.1), ("t1", 0.1)], "test string, ci_lower double")
    assert {r["test"]: r["decision"] for r in rs.decide(ci, holm).collect()} == {"t0": "GO", "t2": "REJECTED", "t1": "REJECTED"}


def test_matched_sets(spark):
    universe = spark.createDataFrame([(f"TOY_GENE_{i:03d}",) for i in range(1, 41)], "gene_id string")
    targets = spark.createDataFrame([(p, f"TOY_GENE_{i:03d}") for p, k in (("a", 3), ("b", 4), ("c", 5)) for i in range(1, k + 1)], "plan_id string, gene_id string")
    sets = rs.matched_sets(targets, universe, 2, 11)
    sizes = rows(sets.groupBy("plan_id", "control_index").count(), "plan_id", "control_index")
    assert sizes == [(p, c, k) for p, k in (("a", 3), ("b", 4), ("c", 5)) for c in (1, 2)]
    assert sets.join(targets, ["plan_id", "gene_id"]).count() == 0
    assert rows(sets, *sets.columns) == rows(rs.matched_sets(targets, universe.repartition(7), 2, 11), *sets.columns)
    with pytest.raises(PySparkException, match="too small"):
        rs.matched_sets(targets, universe.limit(7), 1, 1).collect()
    with pytest.raises(PySparkException, match="too small"):  # nothing is left at all
        rs.matched_sets(targets.where("plan_id = 'c'"), targets.where("plan_id = 'c'").select("gene_id"), 1, 1).collect()


def test_control_summary(spark):
    df = spark.createDataFrame([("p", True, 0, 1.0), ("p", False, 1, 0.5), ("p", False, 2, -1.5)], "plan_id string, is_target boolean, control_index int, score_shift double")
    r = rs.control_summary(df).head()
    assert (r["target_mean"], r["random_mean"], r["n_random"], r["p_value"]) == (1.0, -0.5, 2, 2 / 3)


# --- models -----------------------------------------------------------------------------


def newton(x, y, c, weight=None):
    z = np.column_stack([x, np.ones(len(x))])
    s = np.ones(len(y)) if weight is None else weight
    w = np.zeros(z.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(c * (z * (s * p * (1 - p))[:, None]).T @ z + np.diag(ridge), c * z.T @ (s * (p - y)) + ridge * w)
        w = w - step
    return w


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(48, 3)) * [1, 10, 0.1] + [0, 100, 5]
    x = np.column_stack([x, np.full(48, 3.3)])
    y = (x[:, 0] + rng.normal(size=48) > 0).astype(int)
    df = spark.createDataFrame([(f"d{i:02d}", int(v), r.tolist()) for i, (v, r) in enumerate(zip(y, x))], "donor_id string, label int, features array<double>")
    return df, x, y


@pytest.mark.parametrize("c, balanced", [(0.01, False), (1.0, True), (100.0, False)])
def test_logistic_matches_newton(cohort, c, balanced):
    df, x, y = cohort
    fitted = md.fit_final(df, c, balanced=balanced)
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 1e-9, sd, 1)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else None
    assert np.allclose(fitted.weights[0], newton(z, y, c, weight), atol=1e-8)


def test_nested_cv_scores_each_row_once_from_training_rows_only(cohort):
    df, x, y = cohort
    oof, picks = md.nested_cv(df, 5, c_grid=(0.01, 1.0))
    got = oof.toPandas().sort_values("donor_id").reset_index(drop=True)
    assert list(got.donor_id) == [f"d{i:02d}" for i in range(48)]
    c = picks.toPandas().set_index("fold")["c"]
    for f, part in got.groupby("fold"):
        train = np.setdiff1d(np.arange(48), part.index)
        mu, sd = x[train].mean(0), x[train].std(0)
        sd = np.where(sd > 1e-9, sd, 1)
        w = newton((x[train] - mu) / sd, y[train], c[f])
        want = 1 / (1 + np.exp(-(((x[part.index] - mu) / sd) @ w[:-1] + w[-1])))
        assert np.allclose(part.score, want, atol=1e-7)
    assert md.frozen_c(picks).head()[0] in {0.01, 1.0, 0.505}


def test_inner_search_picks_by_mean_auroc(spark):
    df = spark.createDataFrame([(0, 0.1, 0.5), (0, 1.0, 0.5), (1, 0.1, 0.2), (1, 1.0, 0.9), (1, 1.0, 0.7)], "fold int, c double, score double")
    assert rows(md.best_c(df, ["fold"]).select("fold", "c"), "fold") == [(0, 0.1), (1, 1.0)]


def test_loocv_matches_brute_force(cohort):
    df, x, y = cohort
    got = md.loocv(df, 0.1).toPandas().sort_values("donor_id").reset_index(drop=True)
    for i in (0, 17, 47):
        train = np.delete(np.arange(48), i)
        mu, sd = x[train].mean(0), x[train].std(0)
        sd = np.where(sd > 1e-9, sd, 1)
        n, k = 47, y[train].sum()
        w = newton((x[train] - mu) / sd, y[train], 0.1, np.where(y[train] == 1, n / (2 * k), n / (2 * (n - k))))
        assert got.score[i] == pytest.approx(1 / (1 + np.exp(-(((x[i] - mu) / sd) @ w[:-1] + w[-1]))), abs=1e-7)
        assert got.n_train_cases[i] == k and got.fold_id[i] == f"loocv_{i + 1:03d}"
    whole = md.MAX_STATE
    md.MAX_STATE = 40  # a few held-out donors at a time
    try:
        parts = md.loocv(df, 0.1).toPandas().sort_values("fold_id").reset_index(drop=True)
    finally:
        md.MAX_STATE = whole
    assert np.abs(parts.score - got.score).max() < 1e-9 and list(parts.fold_id) == list(got.fold_id)
    folds = df.withColumns({"rep": F.lit(0), "folds": F.array(F.lit(0))})
    with pytest.raises(RuntimeError, match="not converged"):
        md.fit_logistic(folds, [md.Fit(0, (), 1.0)], 4, max_iter=1)
    assert not md.fit_logistic(folds, [md.Fit(0, (), 1.0)], 4, max_iter=1, on_unconverged="keep").converged.any()


def test_wide_fit_equals_direct_fit(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 50))
    x[:, 7] = 2.0
    y = np.array([0, 1] * 10)
    donors = spark.createDataFrame([(f"d{i:02d}", int(v)) for i, v in enumerate(y)], "donor_id string, label int")
    long = spark.createDataFrame([(f"d{i:02d}", f"g{j}", float(x[i, j])) for i in range(20) for j in range(50)], "donor_id string, feature_id string, value double")
    direct = donors.join(spark.createDataFrame([(f"d{i:02d}", r.tolist()) for i, r in enumerate(x)], "donor_id string, features array<double>"), "donor_id")
    a = md.cv_wide(long, donors, 3, 0.5).toPandas().sort_values("donor_id")["score"]
    b = md.nested_cv(direct, 3, fixed_c=0.5)[0].toPandas().sort_values("donor_id")["score"]
    assert np.allclose(a, b, atol=1e-7)


def test_external_scores_do_not_refit(cohort):
    df, x, y = cohort
    fitted = md.fit_final(df, 1.0)
    alone = md.score_external(fitted, df.limit(1)).head()
    whole = md.score_external(fitted, df).where(F.col("donor_id") == alone["donor_id"]).head()
    assert alone["score"] == pytest.approx(whole["score"])
    ranked = rows(md.coefficients(fitted, ["a", "b", "c", "flat"], df.sparkSession), "coefficient_rank")
    assert ranked[-1][0] == "flat" and ranked[-1][-1] == "none" and ranked[0][0] == "a" and ranked[0][-1] == "increases"


def test_permutation_refits(spark, cohort):
    df, *_ = cohort
    a = md.permutation_refit(df, 4, 1, fixed_c=0.1, stage=2)
    assert a.count() == 4 and a.select("replicate").distinct().count() == 4
    small = spark.createDataFrame([(f"P{i}", list(v), int(i > 2)) for i, v in enumerate([(-3.0, -3.0), (-2.7, -2.5), (-2.4, -2.8), (2.4, 2.7), (2.8, 2.5), (3.0, 3.2)])], "donor_id string, features array<double>, label int")
    out = md.permutation_loocv(small, 5, 42)
    assert rows(out.select("replicate", "status"), "replicate") == [(i, "valid") for i in range(5)]
    observed = mt.auroc(md.loocv(small)).head()["auroc"]
    assert observed == 1.0
    two = small.where("donor_id in ('P0', 'P3', 'P4')")
    assert {r["status"] for r in md.permutation_loocv(two, 3, 1).collect()} == {"skipped_one_class_fold"}


def test_centroids(spark):
    df = spark.createDataFrame(
        [("D001", "train", "flare", [1.0, 1.0]), ("D002", "train", "managed", [5.0, 5.0]), ("D003", "train", "flare", [1.5, 1.5]),
         ("D004", "validation", "flare", [1.2, 1.2]), ("D005", "test", "managed", [4.8, 4.8]), ("D006", "holdout", "flare", [4.9, 4.9])],
        "donor_id string, split string, label string, features array<double>",
    )
    model = md.fit_centroids(df.where("split = 'train'"))
    assert rows(model, "label") == [("flare", 2, [1.25, 1.25]), ("managed", 1, [5.0, 5.0])]
    out = rows(md.predict_centroids(model, df.where("split <> 'train'"), "flare").select("donor_id", "predicted_label", "score"), "donor_id")
    assert [p for _, p, _ in out] == ["flare", "managed", "managed"]
    d = [math.dist((1.2, 1.2), c) for c in ((1.25, 1.25), (5.0, 5.0))]
    assert out[0][2] == pytest.approx((1 / (d[0] + 1)) / sum(1 / (v + 1) for v in d))
    tie = spark.createDataFrame([("m", "flare", [3.125, 3.125])], "donor_id string, label string, features array<double>")
    assert md.predict_centroids(model, tie, "flare").head()["predicted_label"] == "flare"


def test_metadata_baseline_has_no_leak(spark):
    data = [("FLARE001", 1, 42.0, "F", 8, 0.75), ("FLARE002", 1, 39.0, "F", 8, 0.625), ("HC001", 0, 31.0, "Unknown", 8, 0.125), ("HC002", 0, 29.0, "F", 8, 0.25)]
    df = spark.createDataFrame(data, "donor_id string, label int, age double, sex string, n_cells int, b double")
    rows_, scaled = arms.metadata_design(df, ["age", "n_cells", "b"], ["sex"])
    fill = {r["donor_id"]: r["fill"] for r in rows_.collect()}
    assert fill["FLARE001"][0] == 31.0 and scaled == [True, True, True, False, False]
    assert not sp.loo_mode(df, "sex").where("donor_id = 'HC001'").head()["category_in_train"]
    out = arms.metadata_loocv(df, ["age", "n_cells", "b"], ["sex"])
    assert out.count() == 4 and out.where("score < 0 or score > 1").count() == 0


def test_imputed_rows_equal_explicit_rows(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(14, 2))
    y = np.array([0, 1] * 7)
    holes = x.copy()
    holes[3, 0] = holes[8, 0] = np.nan
    df = spark.createDataFrame([(f"d{i:02d}", int(v), None if np.isnan(r[0]) else float(r[0]), float(r[1])) for i, (v, r) in enumerate(zip(y, holes))], "donor_id string, label int, a double, b double")
    got = arms.metadata_loocv(df, ["a", "b"], []).toPandas().sort_values("donor_id").reset_index(drop=True)
    for i in (0, 3):
        train = np.delete(np.arange(14), i)
        full = np.where(np.isnan(holes), [np.nanmedian(holes[train, 0]), 0.0], holes)
        mu, sd = full[train].mean(0), full[train].std(0)
        n, k = 13, y[train].sum()
        w = newton((full[train] - mu) / sd, y[train], 0.1, np.where(y[train] == 1, n / (2 * k), n / (2 * (n - k))))
        assert got.score[i] == pytest.approx(1 / (1 + np.exp(-(((full[i] - mu) / sd) @ w[:-1] + w[-1]))), abs=1e-7)


def test_arm_external_and_co_primary(cohort):
    df, *_ = cohort
    arm = arms.run_arm("a", df, 1, fixed_c=0.1, n_bootstrap=30, n_permutations=4).head()
    assert arm["n_permutations"] == 4 and arm["ci_lower"] <= arm["auroc"] <= arm["ci_upper"] and arm["selected_c"] == "[0.1,0.1,0.1,0.1,0.1]"
    ext = df.withColumn("age_group", F.when(F.substring("donor_id", 3, 1) < "5", "child").otherwise("adult"))
    _, summary = arms.external_arm(df, ext, 0.1, 2, "age_group", 30, 30)
    assert rows(summary.select("stratum"), "stratum") == [("adult",), ("all",), ("child",)]
    both = df.select("donor_id", "label", F.col("features")[0].alias("good"), F.col("features")[2].alias("noise"), F.col("features")[1].alias("other"))
    out = {r["test"]: r for r in arms.co_primary(both, [("x", "good", "noise"), ("y", "noise", "other")], 3, n_bootstrap=60, n_permutations=60).collect()}
    assert out["x"]["observed"] == pytest.approx(mt.auroc(both, "good").head()["auroc"] - mt.auroc(both, "noise").head()["auroc"])
    assert all((r["decision"] == "GO") == (r["ci_lower"] > 0 and r["significant"]) for r in out.values())


def test_a_stratum_without_positives_keeps_its_replicates(spark):
    df = spark.createDataFrame([(i, "none" if i < 5 else "both", int(i == 7), float(i)) for i in range(10)], "donor_id long, s string, label int, score double")
    got = rs.permutation_auroc(df, n=6, by=["s"]).collect()
    assert sorted((r["s"], r["replicate"]) for r in got) == sorted((s, r) for s in ("none", "both") for r in range(6))
    assert all((r["auroc"] is None) == (r["s"] == "none") for r in got)


def test_packed_replicates_equal_copied_features(cohort):
    df, *_ = cohort
    rows_ = md.shuffled_labels(df, 3, 11)
    copied, picks = md.nested_cv(rows_, 4, c_grid=(0.01, 1.0), reps=range(3))
    packed, same = md.nested_cv(rows_.drop("features"), 4, c_grid=(0.01, 1.0), reps=range(3), features=df)
    a, b = (x.toPandas().sort_values(["rep", "donor_id"]).reset_index(drop=True) for x in (copied, packed))
    assert np.allclose(a.score, b.score, atol=1e-9) and list(a.label) == list(b.label) and list(a.fold) == list(b.fold)
    assert rows(picks, "rep", "fold") == rows(same, "rep", "fold")
    assert md.repeated_cv(df, 2, 1, fixed_c=0.1).count() == 2


def test_co_primary_computes_its_scores_once(spark):
    from donorlake.plans import arms

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return float(i * 37 % 101)

    df = spark.range(100).select(F.col("id").alias("donor_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("a"), score("id").alias("b"))
    assert arms.co_primary(df, [("t", "a", "b")], 1, n_bootstrap=4, n_permutations=4).count() == 1
    assert seen.value == 100


def test_few_rows_make_few_tasks(spark):
    rows = spark.range(300).select(F.lit(0).alias("rep"), F.col("id").alias("donor_id"), F.lit(1).alias("label"), F.array(F.lit(1.0)).alias("features"), F.array(F.lit(0)).alias("folds"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        placed = md._place(rows, "donor_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert placed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert placed.count() == 300
