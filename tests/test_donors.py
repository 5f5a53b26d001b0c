import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from donorlake.operators import catalogs as cat
from donorlake.operators import cellqc as qc
from donorlake.operators import donors as dn
from donorlake.operators import pseudobulk as pb
from donorlake.operators import splits as sp

CELLS = "cell_id string, donor_id string, cell_type string"
COUNTS = "cell_id string, gene_id string, value double"


@pytest.fixture(scope="module")
def small(spark):
    cells = spark.createDataFrame([("c1", "A", "B"), ("c2", "A", "T"), ("c3", "B", "T"), ("c4", "C", "T")], CELLS)
    counts = spark.createDataFrame(
        [("c1", "g1", 2.0), ("c1", "g1", 1.0), ("c2", "g2", 3.0), ("c3", "g1", 4.0), ("c3", "g3", 0.0)], COUNTS
    )
    return cells, counts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_tasks_of_the_fraction_grow_with_the_counts(small, monkeypatch):
    cells, counts = small
    counts = counts.unionByName(counts.sparkSession.createDataFrame([(None, "g1", 1.0)], counts.schema))
    monkeypatch.setattr(pb, "TASK_ROWS", 1, raising=False)
    for copies in (10, 20):
        many = counts.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("i")
        out = pb.pseudobulk(many, cells.unionByName(cells), method="fraction")
        assert f", {5 * copies + 1}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
        assert rows(out, "donor_id", "gene_id") == [("A", "g1", 0.25), ("A", "g2", 0.25), ("B", "g1", 0.5), ("B", "g3", 0.0)]


def test_pseudobulk_methods(small):
    cells, counts = small
    assert rows(pb.pseudobulk(counts, cells), "donor_id", "gene_id") == [("A", "g1", 3.0), ("A", "g2", 3.0), ("B", "g1", 4.0), ("B", "g3", 0.0)]
    assert rows(pb.pseudobulk(counts, cells, method="mean"), "donor_id", "gene_id")[0] == ("A", "g1", 1.5)
    fraction = dict(((d, g), v) for d, g, v in rows(pb.pseudobulk(counts, cells, method="fraction"), "donor_id", "gene_id"))
    assert fraction == {("A", "g1"): 0.5, ("A", "g2"): 0.5, ("B", "g1"): 1.0, ("B", "g3"): 0.0}
    by_type = rows(pb.pseudobulk(counts, cells, strata=["cell_type"]), "donor_id", "cell_type", "gene_id")
    assert by_type[:2] == [("A", "B", "g1", 3.0), ("A", "T", "g2", 3.0)]
    with pytest.raises(ValueError):
        pb.pseudobulk(counts, cells, method="median")


def test_restriction_happens_before_normalisation(spark, small):
    cells, counts = small
    genes = spark.createDataFrame([("g1",)], "gene_id string")
    whole = pb.cpm_log1p(pb.pseudobulk(counts, cells)).where("donor_id = 'A' and gene_id = 'g1'").head()
    cut = pb.cpm_log1p(pb.pseudobulk(pb.restrict_genes(counts, genes), cells)).where("donor_id = 'A'").head()
    assert whole["total"] == 6.0 and cut["total"] == 3.0
    assert cut["log1p_cpm"] == pytest.approx(np.log1p(1e6)) and whole["log1p_cpm"] == pytest.approx(np.log1p(5e5))


def test_zero_totals(spark):
    zero = spark.createDataFrame([("A", "g1", 0.0), ("B", "g1", 1.0)], "donor_id string, gene_id string, value double")
    with pytest.raises(PySparkException, match="zero total"):
        pb.cpm_log1p(zero).collect()
    assert rows(pb.cpm_log1p(zero, on_zero="drop").select("donor_id"), "donor_id") == [("B",)]
    assert pb.cpm_log1p(zero, on_zero="null").where("donor_id = 'A'").head()["cpm"] is None


def test_donor_without_counts_keeps_zero_total(small):
    cells, counts = small
    assert rows(pb.donor_totals(counts, cells), "donor_id") == [("A", 2, 6.0), ("B", 1, 4.0), ("C", 1, 0.0)]


@pytest.mark.parametrize("a, b, want", [("ABC", "BCD", "BC"), ("AB", "CD", ""), ("ZAM", "MZA", "AMZ"), ("AAB", "ABB", "AB"), ("", "A", "")])
def test_gene_intersection(spark, a, b, want):
    side = lambda s: spark.createDataFrame([(c,) for c in s], "gene_id string")
    assert [r["gene_id"] for r in pb.gene_intersection(side(a), side(b)).collect()] == list(want)
    left_only = {r["gene_id"] for r in pb.symmetric_difference(side(a), side(b), "gene_id").where("side = 'left_only'").collect()}
    assert left_only == set(a) - set(b)


def test_arrays_and_columns(spark):
    f = spark.createDataFrame([("A", "y", 2.0), ("A", "x", 1.0), ("B", "y", 3.0)], "donor_id string, feature_id string, value double")
    assert rows(pb.feature_columns(f, ["x", "y"]), "donor_id") == [("A", 1.0, 2.0), ("B", 0.0, 3.0)]
    assert rows(pb.feature_arrays(f), "donor_id")[0] == ("A", ["x", "y"], [1.0, 2.0])
    with pytest.raises(ValueError):
        pb.feature_arrays(f, size=1)


def test_cohort_counts(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["FLARE1", "123", "FLARE1", "IGTB1", "123", "123"])], "ix int, donor_id string")
    ordered = rows(dn.cell_counts(df, "donor_id", "ix"), "first_seen")
    assert ordered == [("FLARE1", 2, 0), ("123", 3, 1), ("IGTB1", 1, 3)]
    assert rows(dn.status_counts(df), "status") == [("Flare", 1, 2), ("Healthy", 1, 1), ("Managed", 1, 3)]
    only = dn.status_counts(df.where("donor_id = '123'"))
    assert rows(only, "status") == [("Flare", 0, 0), ("Healthy", 0, 0), ("Managed", 1, 3)]
    assert rows(dn.cohort_summary(df), "n_cells") == [(6, 3)]
    assert rows(dn.donor_labels(df), "donor_id") == [("123", "Managed"), ("FLARE1", "Flare"), ("IGTB1", "Healthy")]
    with pytest.raises(PySparkException):
        dn.status_counts(spark.createDataFrame([("SLE-001",)], "donor_id string")).collect()


def test_collapse_policies(spark):
    df = spark.createDataFrame([("A", "x"), ("A", " x "), ("A", ""), ("B", "x"), ("B", "y"), ("C", None)], "d string, v string")
    with pytest.raises(PySparkException):
        dn.collapse(df, "d", "v").collect()
    assert rows(dn.collapse(df, "d", "v", "mixed"), "d") == [("A", "x"), ("B", dn.MIXED), ("C", None)]
    assert rows(dn.collapse(df, "d", "v", "flag"), "d") == [("A", "x", False), ("B", None, True), ("C", None, False)]
    assert rows(dn.invariant_report(df, "d", ["v"]), "field") == [("v", 2)]


def test_donor_metadata(spark):
    cells = spark.createDataFrame(
        [("1004", "systemic lupus erythematosus", "female", "x", "39-year-old stage")] * 2
        + [("1130", "normal", "male", "x", "27-year-old stage"), ("1130", "normal", "male", "x", "29-year-old stage"), ("7", "normal", "male", "x", "adult")],
        "donor_id string, disease string, sex string, self_reported_ethnicity string, development_stage string",
    )
    got = {r["donor_id"]: r.asDict() for r in dn.donor_metadata(cells).collect()}
    assert got["1004"]["age"] == 39 and got["1004"]["sle_label"] == 1 and got["1004"]["metadata_arm_eligible"]
    assert got["1130"]["age"] is None and got["1130"]["age_flag"] == "age_ambiguous" and not got["1130"]["metadata_arm_eligible"]
    assert got["1130"]["development_stage_raw"] == "27-year-old stage;29-year-old stage"
    assert got["7"]["age"] is None and got["7"]["age_flag"] == "ok" and got["7"]["metadata_arm_eligible"]
    for column in ("disease", "sex", "self_reported_ethnicity"):
        torn = cells.where("donor_id = '7'").unionByName(cells.where("donor_id = '7'").withColumn(column, F.lit("other")))
        with pytest.raises(PySparkException, match=f"{column} differs within donor 7"):
            dn.donor_metadata(torn).collect()


def test_patient_summary(spark):
    df = spark.createDataFrame([("A", "g", 1.0, "T"), ("A", "g", None, "B"), ("A", "g", 4.0, "T"), ("B", "h", None, "T")], "d string, g string, s double, t string")
    assert [tuple(r) for r in dn.patient_summary(df, "d", "g", "s", "t").select("d", "g", "median_s", "cell_types", "n_cells").orderBy("d").collect()] == [
        ("A", "g", 2.5, "B|T", 3),
        ("B", "h", None, "T", 1),
    ]


def test_composition_sums_to_one(spark, small):
    cells, _ = small
    shares = dn.composition(cells)
    assert {r[1] for r in shares.groupBy("donor_id").agg(F.sum("fraction")).collect()} == {1.0}
    wide = dn.composition_wide(cells, ["B", "T"])
    assert rows(wide.select("donor_id", "cell_type_prop_b", "cell_type_prop_t"), "donor_id") == [("A", 0.5, 0.5), ("B", 0.0, 1.0), ("C", 0.0, 1.0)]
    ratio = dn.log_ratios(shares).where("donor_id = 'A'").collect()
    assert all(r["logit"] == 0.0 and r["clr"] == 0.0 for r in ratio)
    assert {r["feature"] for r in dn.composition_feature_names(shares).collect()} == {"cell_type_prop_b", "cell_type_prop_t"}


def test_mean_pool(spark):
    v = spark.createDataFrame([("a", "1", [1.0, 2.0, 3.0]), ("a", "2", [3.0, 4.0, 5.0]), ("b", "3", [10.0, 20.0, 30.0])], "donor_id string, cell_id string, embedding array<double>")
    assert rows(dn.mean_pool(v), "donor_id") == [("a", 2, [2.0, 3.0, 4.0]), ("b", 1, [10.0, 20.0, 30.0])]
    with pytest.raises(PySparkException):
        dn.mean_pool(v, min_cells=2).collect()
    with pytest.raises(Exception, match="Dimensions mismatch"):
        dn.mean_pool(v.union(spark.createDataFrame([("a", "4", [1.0])], v.schema))).collect()


def test_aligned_join_and_attach_fail_on_gaps(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "donor_id string, f int")
    b = spark.createDataFrame([("y", 3), ("x", 4)], "donor_id string, g int")
    assert rows(dn.aligned_join(a, b), "donor_id") == [("x", 1, 4), ("y", 2, 3)]
    for extra in (a.limit(0).union(spark.createDataFrame([("z", 1)], a.schema)), a.where("donor_id = 'x'")):
        with pytest.raises(PySparkException, match="one feature set"):
            dn.aligned_join(extra, b).collect()
    assert dn.attach(a, b, "donor_id").count() == 2
    with pytest.raises(PySparkException, match="no metadata"):
        dn.attach(a, b.where("g = 3"), "donor_id").collect()


def test_comparisons(spark):
    e = spark.createDataFrame([("x", 1), ("y", 2), ("n", None)], "k string, v int")
    o = spark.createDataFrame([("x", 1), ("y", 5), ("z", 1), ("n", None)], "k string, v int")
    assert rows(dn.compare_counts(e, o, "k", "v").select("k", "status"), "k") == [("y", "different"), ("z", "extra")]
    r = dn.compare_results(e, o, "k", "v", 1e-9)
    assert rows(r.select("k", "matches"), "k") == [("n", False), ("x", True), ("y", False), ("z", False)]


def test_label_balance(spark):
    df = spark.createDataFrame([(1,), (1,), (0,)], "y int")
    assert rows(dn.label_balance(df, "y", {1: 2, 0: 1}), "y") == [(0, 1), (1, 2)]
    with pytest.raises(PySparkException):
        dn.label_balance(df, "y", {1: 3, 0: 1}).collect()
    union = dn.cohort_union(df, df.limit(1))
    assert rows(union.groupBy("cohort_label").count(), "cohort_label") == [(0, 3), (1, 1)]


def test_gene_mapping(spark):
    genes = spark.createDataFrame([("e1", "GENE1"), ("e2", "GENE2"), ("e3", "GENE1"), ("e4", "")], "gene_id string, gene_symbol string")
    assert rows(cat.duplicate_symbols(genes), "gene_symbol") == [("GENE1", 2)]
    report = cat.gene_mapping_report(genes, genes.where("gene_id = 'e2'"), genes.where("gene_id = 'e1'"))
    assert rows(cat.mapping_summary(report), "total_rows") == [(4, 3, 1, 2, 1, 2)]
    two = spark.createDataFrame([("mapped", "true", "false", "yes", "1"), ("unmapped", "no", "TRUE", "", None)], "mapping_status string, duplicate_flag string, unmapped_flag string, foundation_vocab_match string, pathway_eligible string")
    assert rows(cat.mapping_summary(two), "total_rows") == [(2, 1, 1, 1, 1, 1)]


def test_cell_metrics_and_filter_order(spark):
    genes = spark.createDataFrame([("g1", "MT-A"), ("g2", "B"), ("g3", "C")], "gene_id string, gene_symbol string")
    counts = spark.createDataFrame(
        [("c1", "g1", 1.0), ("c1", "g2", 3.0), ("c2", "g2", 1.0), ("c2", "g3", 1.0), ("c3", "g1", 9.0), ("c3", "g2", 1.0), ("c4", "g3", 1.0)], COUNTS
    )
    sums, mito = qc.cell_gene_sums(counts), qc.mito_genes(genes)
    assert rows(qc.cell_metrics(sums, mito), "cell_id")[0] == ("c1", 2, 4.0, 25.0)
    # c4 falls to the gene minimum, then g3 falls to the cell minimum, then c3 to its mitochondrial share.
    kept, metrics = qc.qc_filter(sums, mito, 2, 5, 2, 50.0)
    assert rows(metrics.select("cell_id", "total_counts"), "cell_id") == [("c1", 4.0), ("c2", 1.0)]
    assert {r["gene_id"] for r in kept.collect()} == {"g1", "g2"}
    assert rows(qc.mito_summary(mito), "total_genes") == [(3, 1, 2)]


def test_synthetic_cohort_yields_exact_number_of_variable_genes(spark):
    from donorlake.sources.synthetic import synthetic_cohort

    cells, genes, counts = synthetic_cohort(spark, seed=1)
    assert cells.count() == 500 and genes.count() == 2500
    per_patient = {r["count"] for r in cells.groupBy("donor_id").count().collect()}
    groups = {r["disease_group"]: r["n"] for r in cells.groupBy("disease_group").agg(F.countDistinct("donor_id").alias("n")).collect()}
    assert per_patient == {50} and groups == {"Flare": 3, "Managed": 2, "Treated": 2, "Healthy": 3}
    assert rows(qc.mito_summary(qc.mito_genes(genes)), "total_genes") == [(2500, 50, 2450)]
    kept, metrics = qc.qc_filter(qc.cell_gene_sums(counts), qc.mito_genes(genes))
    classes = {r["synthetic_quality_class"] for r in metrics.join(cells, "cell_id").select("synthetic_quality_class").distinct().collect()}
    assert classes == {"pass"}
    hv = qc.highly_variable(qc.gene_dispersion(qc.normalize_log1p(kept), metrics.count()))
    assert hv.where("highly_variable").count() == 2000


def test_variable_genes_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(rng.gamma(1.0, 2.0, 60), size=(40, 60)).astype(float)
    counts = spark.createDataFrame([(f"c{i}", f"g{j:02d}", float(x[i, j])) for i in range(40) for j in range(60) if x[i, j]], COUNTS)
    genes = spark.createDataFrame([(f"g{j:02d}",) for j in range(60)], "gene_id string")
    got = qc.highly_variable(qc.gene_dispersion(qc.normalize_log1p(counts), 40, genes=genes), 10, bins=5).toPandas().sort_values("gene_id")
    z = x / x.sum(1, keepdims=True) * 1e4
    mean, var = z.mean(0), z.var(0, ddof=1)
    used = mean > 0
    disp, lm = np.full(60, np.nan), np.log1p(mean)
    disp[used] = np.log(var[used] / mean[used])
    assert not used.all()
    edges = np.linspace(lm.min(), lm.max(), 6)
    bins = np.clip(np.searchsorted(edges, lm, side="left") - 1, 0, 4)
    norm = np.full(60, np.nan)
    for b in range(5):
        mine = (bins == b) & used
        d = disp[mine]
        norm[mine] = 1.0 if len(d) == 1 else (d - d.mean()) / (d.std(ddof=1) if len(d) else 1)
    assert np.allclose(got["dispersion_norm"].astype(float), norm, equal_nan=True)
    assert set(got.loc[got.highly_variable, "gene_id"]) == {f"g{j:02d}" for j in np.argsort(-np.nan_to_num(norm, nan=-99))[:10]}


def test_rank_tokens_and_embedding(spark):
    sums = spark.createDataFrame([("c", "g1", 2.0), ("c", "g2", 9.0), ("c", "g3", 2.0), ("d", "g1", 1.0)], COUNTS)
    medians = spark.createDataFrame([("g1", 1.0), ("g2", 9.0), ("g3", 1.0)], "gene_id string, median double")
    tokens = qc.token_sequences(qc.rank_tokens(sums, medians, 2))
    assert rows(tokens, "cell_id") == [("c", ["g1", "g3"]), ("d", ["g1"])]
    out = qc.embed(tokens, lambda seqs: [[len(t), 1.0] for t in seqs])
    assert rows(out, "cell_id") == [("c", [2.0, 1.0]), ("d", [1.0, 1.0])]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(70, 4)), 1)
    x[5] = x[9]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "cell_id int, embedding array<double>, label int")
    got = qc.knn(df, df, 4, block_rows=16, exclude_self=True).orderBy("cell_id", "rank").toPandas()
    for i in range(70):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(70), np.round(d, 12))) if j != i][:4]
        mine = got[got.cell_id == i]
        assert np.allclose(mine["distance"], d[order])
    votes = qc.label_transfer(spark.createDataFrame(got), df)
    assert votes.count() == 70 and votes.where("vote_share <= 0 or vote_share > 1").count() == 0


def test_pca_components_are_centred(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id int, embedding array<double>")
    got = np.stack(qc.pca(df, 2).orderBy("cell_id").toPandas()["components"])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_balanced_batches(spark):
    df = spark.createDataFrame([(f"d{i:02d}", 100 - i) for i in range(16)], "donor_id string, n_cells int")
    loads = qc.balanced_batches(df, 4).groupBy("batch").agg(F.sum("n_cells").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["n"] for r in loads} == {4} and max(r["s"] for r in loads) - min(r["s"] for r in loads) == 0


@pytest.mark.parametrize("sizes", [[50] + [1] * 49, [7, 7, 7, 5, 5, 3, 2, 2, 2, 2, 2, 0, 0, 0], [3] * 11, list(range(30)), []])
def test_batches_equal_the_sequential_rule(spark, sizes):
    df = spark.createDataFrame([(f"d{i:02d}", n) for i, n in enumerate(sizes)], "donor_id string, n_cells int").repartition(3)
    loads, want = [0] * 4, {}
    for n, d in sorted(((-n, f"d{i:02d}") for i, n in enumerate(sizes))):
        b = loads.index(min(loads))
        want[d], loads[b] = b, loads[b] - n
    assert {r["donor_id"]: r["batch"] for r in qc.balanced_batches(df, 4).collect()} == want


def test_batches_of_bad_sizes_fail(spark):
    for bad in (None, -1):
        with pytest.raises(PySparkException, match="NULL or negative"):
            qc.balanced_batches(spark.createDataFrame([("a", bad), ("b", 1)], "donor_id string, n_cells int"), 2).collect()


def test_rows_that_used_to_vanish(spark):
    v = spark.createDataFrame([("a", "1", [1.0]), ("a", "1", [3.0])], "donor_id string, cell_id string, embedding array<double>")
    with pytest.raises(PySparkException, match="repeats"):
        dn.mean_pool(v).collect()
    with pytest.raises(PySparkException, match="not listed"):
        dn.composition_wide(spark.createDataFrame([("a", "T"), ("a", "X")], "donor_id string, cell_type string"), ["T"]).collect()
    sums = spark.createDataFrame([("c", "g1", 5.0), ("c", "g9", 95.0)], "cell_id string, gene_id string, value double")
    genes = spark.createDataFrame([("g1", True)], "gene_id string, is_mito boolean")
    assert tuple(qc.cell_metrics(sums, genes).head()) == ("c", 2, 100.0, 5.0)
    lone = sp.loo_moments(spark.createDataFrame([("a", "f", 2.0), ("a", "g", 1.0), ("b", "g", 3.0)], "donor_id string, feature_id string, value double"))
    assert {(r["donor_id"], r["feature_id"], r["train_mean"]) for r in lone.collect()} == {("a", "f", None), ("a", "g", 3.0), ("b", "g", 1.0)}


def test_knn_prunes_and_stays_exact(spark):
    """Clusters, ties, a hot vector and fewer references than k."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 5)) * 40
    x = np.concatenate([centres[rng.integers(0, 8, 300)] + rng.normal(size=(300, 5)), np.tile(centres[0], (60, 1))]).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id int, embedding array<double>")
    got = qc.knn(df, df, 5, block_rows=32, exclude_self=True).orderBy("cell_id", "rank").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        mine = got[got.cell_id == i]
        assert list(mine["neighbor"]) == list(np.lexsort((np.arange(len(x)), d[i]))[:5]) and np.allclose(mine["distance"], np.sort(d[i])[:5])
    assert qc.knn(df, df.limit(3), 5).groupBy("cell_id").count().where("count <> 3").count() == 0
    assert qc.knn(df, df.where("false"), 5).count() == 0 and qc.knn(df.where("false"), df, 5).count() == 0


@pytest.mark.parametrize("values, kind", [(150, "string"), (20, "int"), (100_000, "int")])
def test_knn_stores_no_visits(spark, monkeypatch, values, kind):
    """Chunks smaller than a cell, and one chunk: the result is that of all pairs, and what is written has a row per vector."""
    rng, tables, write = np.random.default_rng(2), [], qc.written
    x = np.concatenate([rng.normal(size=(150, 5)), np.tile(rng.normal(size=5), (40, 1)), 1e4 + rng.normal(size=(10, 5))]).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id int, embedding array<double>").withColumn("cell_id", F.lpad(F.col("cell_id").cast("string"), 3, "0").cast(kind))
    monkeypatch.setattr(qc, "written", lambda t, name: (lambda out: (tables.append(out.count()), out)[1])(write(t, name)))
    got = qc.knn(df, df, 4, block_rows=32, exclude_self=True, max_pivots=6, chunk_values=values).orderBy("cell_id", "rank").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = [j for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:4]]
    assert got["neighbor"].astype(int).tolist() == want and np.allclose(got["distance"], [d[i // 4, j] for i, j in enumerate(want)])
    assert max(tables) <= len(x) and len(tables) >= (6 if values < 1000 else 3)


def test_visits_go_on_in_small_frames():
    from donorlake.operators import cellqc

    pdf = pd.DataFrame({"_id": range(100), "_v": [np.full(4, float(x)) for x in range(100)]})
    i, c = np.nonzero(np.ones((100, 256), bool))
    frames = list(cellqc._visit_frames(pdf, i, c))
    assert max(map(len, frames)) <= 4096 and sum(map(len, frames)) == 25_600
    assert [len(f) for f in cellqc._visit_frames(pdf, i[:0], c[:0])] == []
    assert (pd.concat(frames)["_id"].to_numpy() == i).all() and (pd.concat(frames)["_c"].to_numpy() == c).all()


def test_a_model_runs_once_per_cell(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(tokens):
        seen.add(len(tokens))
        return [(float(len(t)),) for t in tokens]

    cells = spark.createDataFrame([(i, "ab"[i % 2], [1] * (i + 1)) for i in range(6)], "cell_id long, donor_id string, tokens array<long>")
    pooled = dn.mean_pool(qc.embed(cells, model, ("cell_id", "donor_id")))
    assert rows(pooled, "donor_id") == [("a", 3, [3.0]), ("b", 3, [4.0])] and seen.value == 6


@pytest.mark.parametrize("sorted_rows", [0, 6, 100])
def test_gene_medians_of_small_and_large_genes(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(qc, "SORTED_ROWS", sorted_rows, raising=False)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (12, 9)) * (rng.random((12, 9)) < np.linspace(0.1, 1, 9))
    sums = spark.createDataFrame([(c, g, float(x[c, g])) for c in range(12) for g in range(9) if x[c, g] or g == 3], "cell_id long, gene_id long, value double")
    share = x * 1e4 / np.where(x.sum(axis=1) > 0, x.sum(axis=1), 1)[:, None]
    want = {g: float(np.median(share[:, g][share[:, g] > 0])) for g in range(9) if x[:, g].any()}
    assert {r["gene_id"]: r["median"] for r in qc.gene_medians(sums).collect()} == pytest.approx(want)
