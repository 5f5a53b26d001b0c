import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from donorlake.functions import columns as col
from donorlake.functions import scalars as sc


def values(df, column):
    return [r[column] for r in df.collect()]


def test_resolve_prefers_candidate_order_then_case():
    assert col.resolve_column(["Donor", "patient_id"], col.PATIENT_ID_NAMES) == "patient_id"
    assert col.resolve_column([" DONOR_ID "], col.PATIENT_ID_NAMES) == " DONOR_ID "
    assert col.resolve_column(["x"], col.PATIENT_ID_NAMES) is None
    with pytest.raises(col.ContractError):
        col.resolve_column(["x"], col.PATIENT_ID_NAMES, required=True)


def test_batch_columns_and_rejection():
    assert col.batch_columns(["Batch", "source", "cell_type"], exclude=["source"]) == ["Batch"]
    with pytest.raises(col.ContractError):
        col.reject_columns(["age", "PC12"])
    with pytest.raises(col.ContractError):
        col.reject_columns(["gene_x"])
    col.reject_columns(["age", "pcr"])


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    col.require_columns(df, ["a"])
    with pytest.raises(col.ContractError, match="c"):
        col.require_columns(df, ["a", "c"])
    col.require_header(df, ["a", "b"])
    with pytest.raises(col.ContractError):
        col.require_header(df, ["b", "a"])
    col.require_header(df, ["b"], exact=False)


def test_availability_and_features(spark):
    df = spark.createDataFrame([("a", "b", 1, "f", 0.5)], "donor_id string, disease string, age int, sex string, cell_type_prop_b double")
    report = col.availability(df)
    assert report["patient_id_available"] and report["age_available"] and not report["cell_type_available"]
    assert col.model_features(df.drop("donor_id", "disease")) == (["age", "cell_type_prop_b"], ["sex"])


def test_blank_ids_and_nulls_are_dropped(spark):
    df = spark.createDataFrame([(" a ", "1"), (None, "2"), ("  ", "x")], "id string, n string")
    kept = col.canonical(col.drop_blank(df, "id"), ["id"], ["n"])
    assert [tuple(r) for r in kept.collect()] == [("a", 1.0)]
    coerced = col.canonical(df, [], ["n"])
    assert values(coerced, "n") == [1.0, 2.0, None]


def test_missing_tokens(spark):
    df = spark.createDataFrame([(" TODO ",), (None,), ("ok ",), ("UNKNOWN",)], "v string")
    assert values(col.normalize_missing(df, ["v"]), "v") == ["TODO", "TODO", "ok", "TODO"]


def test_donor_status_patterns(spark):
    ids = ["FLARE001", "flare2", "HC-001", "IGTB1", "123", "  HC-001  "]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert values(df.select(sc.donor_status("id").alias("s")), "s") == ["Flare", "Flare", "Healthy", "Healthy", "Managed", "Healthy"]
    odd = spark.createDataFrame([("SLE-001",)], "id string")
    with pytest.raises(PySparkException):
        odd.select(sc.donor_status("id")).collect()
    assert values(odd.select(sc.donor_status("id", "default").alias("s")), "s") == ["Managed"]
    for bad in (None, "  ", "NaN"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "id string").select(sc.donor_status("id", "default")).collect()


def test_prefix_rule_differs_from_pattern_rule(spark):
    df = spark.createDataFrame([("ICC_control",), ("flare1",)], "id string")
    assert values(df.select(sc.donor_group_by_prefix("id").alias("s")), "s") == ["Managed", "Managed"]
    assert values(df.select(sc.file_category("id").alias("s")), "s") == ["control_like", "other"]


def test_age_and_mito(spark):
    df = spark.createDataFrame([("39-year-old stage",), ("adult stage",), ("39-year-old",), (None,)], "s string")
    assert values(df.select(sc.parse_age("s").alias("a")), "a") == [39, None, None, None]
    g = spark.createDataFrame([("mt-CO1",), ("MTOR",), (" MT-ND1",)], "g string")
    assert values(g.select(sc.is_mito("g").alias("m")), "m") == [True, False, True]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("",)], "g string").select(sc.is_mito("g")).collect()


def test_text_and_list_helpers(spark):
    df = spark.createDataFrame([("  CD4+ T cell!",), ("--",), (None,)], "s string")
    assert values(df.select(sc.sanitize("s").alias("x")), "x") == ["cd4_t_cell", "unknown", "unknown"]
    df = spark.createDataFrame([("[0.1, 1, 10]",), ("[0.01, 0.1]",)], "s string")
    assert values(df.select(sc.array_median(sc.json_doubles("s")).alias("m")), "m") == pytest.approx([1.0, 0.055])
    df = spark.createDataFrame([(["b", "a", "b"],)], "v array<string>")
    assert values(df.select(sc.joined("v").alias("x")), "x") == ["a|b"]
    df = spark.createDataFrame([(" c ", "d")], "a string, b string")
    assert values(df.select(sc.composite_key("a", "b").alias("x")), "x") == ["c::d"]


def test_boolean_direction_warning(spark):
    df = spark.createDataFrame([(" Yes",), ("0",), (None,), ("TRUE",)], "s string")
    assert values(df.select(sc.as_true("s").alias("x")), "x") == [True, False, False, True]
    df = spark.createDataFrame([(0.1,), (-0.2,), (0.0,), (float("inf"),), (float("nan"),), (-1.0,), (0.5,)], "v double")
    assert values(df.select(sc.direction("v").alias("x")), "x")[:3] == ["increase", "decrease", "no_change"]
    assert values(df.select(sc.warning_level("v", 0.5, 1.0).alias("x")), "x") == ["none", "none", "none", "not_estimable", "not_estimable", "strong", "flag"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert values(df.select(sc.vector_problem("v", 2).alias("x")), "x") == [None, "empty vector", "non-finite value", "unexpected size", "empty vector"]
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(sc.euclidean("a", "b").alias("d")).withColumn("i", sc.inverse_distance("d")).head()
    assert row["d"] == 5.0 and row["i"] == pytest.approx(1 / 6)
    assert values(spark.createDataFrame([(["1", "x"],)], "v array<string>").select(sc.numeric_vector("v").alias("x")), "x") == [[1.0, None]]


def test_run_stamp(spark):
    assert spark.range(1).select(sc.run_stamp()).head()[0].endswith("+00:00")
