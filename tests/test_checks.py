import pytest
from pyspark.sql import functions as F

from donorlake.operators import catalogs as cat
from donorlake.operators import checks as ck
from donorlake.operators import splits as sp

LEAK = "entity_id string, entity_type string, patient_id string, donor_id string, sample_id string, cell_id string, cohort_id string, batch_id string, split string, disease_label string, audit_status string"


def leak_rows(**changes):
    base = [
        ["p1", "patient_id", "p1", "d1", "s1", "c1", "k", "b1", "train", "SLE", "ok"],
        ["p2", "patient_id", "p2", "d2", "s2", "c2", "k", "b2", "train", "control", "ok"],
        ["p3", "patient_id", "p3", "d3", "s3", "c3", "k", "b1", "test", "SLE", "ok"],
        ["p4", "patient_id", "p4", "d4", "s4", "c4", "k", "b2", "test", "control", "ok"],
    ]
    names = [f.split()[0] for f in LEAK.split(", ")]
    for key, value in changes.items():
        column, row = key.rsplit("_", 1)
        base[int(row)][names.index(column)] = value
    return [tuple(r) for r in base]


def found(df):
    return sorted({r["rule"] for r in df.collect()})


def test_clean_manifest_passes(spark):
    rows = spark.createDataFrame(leak_rows(), LEAK)
    report = ck.report(ck.leakage_checks(rows), rows).head()
    assert (report["status"], report["n_violations"], report["errors"], report["checked_rows"]) == ("PASS", 0, "", 4)


@pytest.mark.parametrize(
    "changes, rules",
    [
        ({"split_2": "external_validation"}, ["batch_confounding", "cohort_contamination"]),
        ({"batch_id_1": "b1"}, ["batch_confounding"]),
        ({"disease_label_1": "SLE", "disease_label_2": "control"}, ["label_leakage"]),
        ({"audit_status_0": " "}, ["missing_audit_status"]),
        ({"entity_type_3": "barcode"}, ["cell_level_split"]),
        ({"patient_id_2": "p1"}, ["patient_id_in_several_splits"]),
        ({"donor_id_0": "TODO", "donor_id_2": "TODO"}, []),
        ({"cell_id_3": "c1"}, ["cell_id_in_several_splits"]),
        ({"sample_id_3": "s1"}, ["sample_id_in_several_splits"]),
        ({"donor_id_0": None, "donor_id_2": None}, []),
    ],
)
def test_mutations_are_found(spark, changes, rules):
    rows = spark.createDataFrame(leak_rows(**changes), LEAK)
    if "split_2" in changes:  # moving one row leaves single-batch splits behind
        rules = sorted(set(rules))
    assert found(ck.leakage_checks(rows)) == rules
    assert ck.report(ck.leakage_checks(rows), rows).head()["status"] == ("FAIL" if rules else "PASS")


def test_id_overlap(spark):
    a = spark.createDataFrame([("x",), ("TODO",), (None,)], "id string")
    b = spark.createDataFrame([("x",), ("TODO",), ("y",)], "id string")
    assert [r["id"] for r in ck.id_overlap(a, b, "id").collect()] == ["x"]


def test_split_and_donor_manifests(spark):
    rows = spark.createDataFrame(leak_rows(), LEAK)
    assert found(ck.split_manifest(rows)) == []
    assert found(ck.split_manifest(spark.createDataFrame(leak_rows(entity_id_2="p1"), LEAK))) == ["train_test_overlap"]
    assert found(ck.split_manifest(spark.createDataFrame(leak_rows(split_1="dev", entity_type_0="cell_id", entity_id_3=""), LEAK))) == [
        "cell_level_split", "missing_entity_id", "unsupported_split",
    ]
    donors = spark.createDataFrame([("FLARE001", "train", "flare"), ("HC-002", "validation", "healthy"), ("12345", "test", "managed")], "donor_id string, split string, label_group string")
    domain = ["flare", "healthy", "managed"]
    assert found(ck.donor_manifest(donors, domain, expected=3)) == []
    assert found(ck.donor_manifest(donors.where("split <> 'test'"), domain, expected=3)) == ["missing_split", "unexpected_donor_count"]
    twice = donors.union(spark.createDataFrame([("HC-002", "test", "sick")], donors.schema))
    assert found(ck.donor_manifest(twice, domain)) == ["donor_in_several_splits", "duplicate_donor", "label_outside_domain"]


def test_fold_checks(spark):
    donors = spark.createDataFrame([(f"donor_{i}", "flare" if i % 2 else "managed") for i in range(1, 5)], "donor_id string, label string")
    roles = sp.fold_roles(sp.round_robin_kfold(donors, 2, stratify="label"), 2)
    assert found(ck.fold_checks(roles, donors)) == []
    both = roles.where("role = 'test'").groupBy("fold_id").agg(F.countDistinct("label").alias("n")).collect()
    assert {r["n"] for r in both} == {2}
    assert sp.stratification_shortfalls(donors, 3).count() == 2 and sp.stratification_shortfalls(donors, 2).count() == 0
    broken = roles.where("donor_id <> 'donor_1'").union(roles.where("donor_id = 'donor_2'").withColumn("role", F.lit("test")))
    assert found(ck.fold_checks(broken, donors)) == ["donor_on_both_sides", "donor_repeated_in_fold", "never_held_out"]


COMP = "feature_id string, dataset_id string, aggregation_unit string, aggregation_id string, cell_type string, cell_count int, total_cells int, cell_type_fraction double, transformation_status string, split_group string, audit_status string"


@pytest.mark.parametrize(
    "change, rules",
    [
        ({}, []),
        ({"cell_type_fraction": 1.2}, ["fraction_outside_unit"]),
        ({"total_cells": 0, "cell_count": 0}, ["total_not_positive"]),
        ({"cell_count": 101}, ["count_outside_total"]),
        ({"aggregation_unit": "cell_id"}, ["cell_level_unit"]),
        ({"aggregation_unit": "plate"}, ["unsupported_unit"]),
        ({"split_group": "barcode"}, ["cell_level_split"]),
        ({"audit_status": None}, ["missing_audit_status"]),
    ],
)
def test_composition_rows(spark, change, rules):
    base = dict(feature_id="f", dataset_id="d", aggregation_unit="donor_id", aggregation_id="a", cell_type="B", cell_count=25, total_cells=100,
                cell_type_fraction=0.25, transformation_status="none", split_group="donor", audit_status="ok") | change
    assert found(ck.composition_rows(spark.createDataFrame([tuple(base.values())], COMP))) == rules


def test_manifest_rows(spark):
    base = dict(feature_id="f", dataset_id="d", aggregation_unit="donor_id", aggregation_id="a", aggregation_method="sum_counts", value_type="count",
                normalization_status="raw", split_group="donor", audit_status="ok")
    schema = ", ".join(f"{k} string" for k in base)
    one = lambda **c: spark.createDataFrame([tuple((base | c).values())], schema)
    assert found(ck.pseudobulk_rows(one())) == []
    assert found(ck.pseudobulk_rows(one(aggregation_method="median", aggregation_unit="barcode", value_type=""))) == ["cell_level_unit", "missing_value_type", "unknown_method"]
    cal = dict(run_id="r", dataset_id="d", model_family="m", task="t", status="s", audit_status="ok", prediction_unit="patient", n_patients="20", label_verified="true", leakage_checks_passed="true")
    row = lambda **c: spark.createDataFrame([tuple((cal | c).values())], ", ".join(f"{k} string" for k in cal))
    assert found(ck.calibration_rows(row())) == []
    assert found(ck.calibration_rows(row(n_patients="0"))) == ["n_patients_not_positive"]
    assert found(ck.calibration_rows(row(n_patients="x", label_verified="false"))) == ["label_not_verified", "n_patients_not_integer"]
    thr = spark.createDataFrame([("1", "guessed", "false", "", "ok"), ("2", "paper", "yes", None, "ok"), ("3", "paper", "yes", "me", "")], "threshold_id string, threshold_source string, applied string, approved_by string, audit_status string")
    assert found(ck.threshold_decisions(thr)) == ["applied_without_approver", "guessed_threshold", "missing_audit_status"]


def test_matrix_and_readiness(spark):
    genes = spark.createDataFrame([("e1", "IFI44L"), ("e2", "MX1")], "gene_id string, gene_symbol string")
    cells = spark.createDataFrame([("c1", "FLARE1"), ("c2", "123"), ("c3", "HC-001")], "cell_id string, donor_id string")
    counts = spark.createDataFrame([("c1", "e1", 1.0), ("c9", "e9", 1.0)], "cell_id string, gene_id string, value double")
    assert found(ck.cell_gene_matrix(cells, genes, counts)) == ["unknown_cell", "unknown_gene"]
    assert found(ck.cell_gene_matrix(cells.union(cells.limit(1)), genes, counts.limit(0))) == ["duplicate_cell_id"]
    assert found(ck.readiness(cells, genes, counts.limit(0), minimum_donors=4)) == ["no_mitochondrial_gene", "too_few_donors"]
    assert found(ck.readiness(cells, genes, counts.limit(0), minimum_donors=3, require_mito=False)) == []


def test_feature_and_prediction_sanity(spark):
    feats = spark.createDataFrame(
        [("D1", "train", "flare", [1.0, 1.0]), ("D2", "train", "managed", [5.0, 5.0]), ("D3", "test", "flare", [1.0, 2.0])], "donor_id string, split string, label string, features array<double>"
    )
    assert found(ck.donor_features(feats)) == []
    assert found(ck.donor_features(feats.where("label = 'flare'"))) == ["one_train_label", "too_few_rows", "too_few_train_rows"]
    preds = spark.createDataFrame([("D4", "flare", "flare", 0.8), ("D5", "managed", "managed", 0.2)], "donor_id string, true_label string, predicted_label string, positive_label_score double")
    assert found(ck.prediction_sanity(preds, "flare", score="positive_label_score")) == []
    assert found(ck.prediction_sanity(preds.withColumn("positive_label_score", F.lit(1.5)), "other", score="positive_label_score")) == ["no_positive_label", "score_outside_unit"]
    vec = spark.createDataFrame([("a", "1", [1.0, 2.0]), ("a", "1", [1.0]), (None, "2", [float("nan"), 0.0]), ("b", "", [])], "donor_id string, cell_id string, embedding array<double>")
    assert found(ck.vector_rows(vec, 2)) == ["duplicate_cell_id", "missing_cell_id", "missing_donor_id", "unusable_vector"]


def test_catalog_rules(spark):
    c = spark.createDataFrame([("a", "manual_metadata_verified", "human", ""), ("b", "candidate_pending_audit", "", ""), ("", " ", "human", "x")], "accession string, audit_status string, organism string, assay string")
    assert found(ck.candidate_rows(c)) == ["missing_audit_status", "missing_key"]
    got = [r["score_status"] for r in cat.scoring_status(c, "geo", ["accession"], ["organism", "assay"]).collect()]
    assert got == ["error_missing_hard_fields", cat.UNSCORED, "error_missing_audit_status"]
    assert found(ck.approval_words(c.withColumn("note", F.lit(" Approved ")), "accession", ["note", "assay"])) == ["approval_in_note"]
    assert found(ck.approval_words(c.withColumn("note", F.lit("approved by")), "accession", ["note"])) == []
    copied = cat.audit_copy(c.drop("audit_status"), "TODO", "n")
    assert copied.columns[-2:] == ["audit_status", "audit_notes"]


def test_declared_totals(spark):
    seen = spark.createDataFrame([(3, 10)], "n_donors long, n_cells long")
    assert found(ck.declared_totals({"n_donors": 3, "n_cells": 10}, seen)) == []
    assert found(ck.declared_totals({"n_donors": 4, "n_cells": 10}, seen)) == ["differs_n_donors"]
