import gzip

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from donorlake.functions.columns import ContractError
from donorlake.operators import pseudobulk as pb
from donorlake.sources import files, matrix_market, tables
from donorlake.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_csv_sink_and_typed_read(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5, None), ("8", float("nan"), "x")], "donor_id string, v double, t string")
    path = str(tmp_path / "out.csv")
    tables.write_csv(df, path, ["t", "donor_id", "v"])
    text = {line for f in (tmp_path / "out.csv").glob("part-*") for line in f.read_text().splitlines()}
    assert text == {",007,1.5", "t,donor_id,v", "x,8,"}
    back = tables.read_table(spark, path, ids=["donor_id"])
    assert rows(back.select("donor_id", "v", "t"), "donor_id") == [("007", 1.5, None), ("8", None, "x")]
    with pytest.raises(ContractError):
        tables.read_table(spark, str(tmp_path / "x.h5ad"))
    assert tables.DONOR_METADATA.names[0] == "donor_id"


def test_parquet_scan_is_pruned_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    tables.write_parquet(spark.range(100).select(F.col("id").alias("gene_id"), F.lit(1.0).alias("value"), F.lit("x").alias("extra")), path, ["gene_id"])
    df = tables.scan(spark, path, ["gene_id"], F.col("gene_id") < 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(gene_id,5)" in plan and "ReadSchema: struct<gene_id:bigint>" in plan
    assert df.count() == 5
    assert tables.parquet_columns(spark, path, ["extra"]) == ["gene_id", "value"]


def test_gene_list_and_results(spark, tmp_path):
    (tmp_path / "genes.tsv").write_text("ENSG1\tA\nENSG2\t\n\tB\nENSG3\tC\n")
    assert [r[0] for r in tables.read_gene_list(spark, str(tmp_path / "genes.tsv")).collect()] == ["ENSG1", "ENSG2", "ENSG3"]
    (tmp_path / "r.json").write_text('{"arms": {"a": {"auroc": 0.5}}}')
    assert tables.read_results(spark, str(tmp_path / "r.json")).select("arms.a.auroc").head()[0] == 0.5
    (tmp_path / "r.csv").write_text("task,auroc\nx,0.9\n")
    assert rows(tables.read_results(spark, str(tmp_path / "r.csv")), "task") == [("x", 0.9)]


def test_blocked_outputs(spark, tmp_path):
    table, out = tables.read_or_block(spark, str(tmp_path / "none.parquet"), {"metrics": "task string, auroc double"})
    assert table is None and out["metrics"].count() == 0 and out["metrics"].columns == ["task", "auroc"]
    assert out["status"].head()["status"] == "blocked_missing_input"
    spark.range(3).write.parquet(str(tmp_path / "some.parquet"))
    table, out = tables.read_or_block(spark, str(tmp_path / "some.parquet"), {})
    assert table.count() == 3 and out == {}


def test_bucketed_join_needs_no_shuffle(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS cohort LOCATION '%s'" % (tmp_path / "db"))
    tables.write_bucketed(spark.range(1000).select((F.col("id") % 50).alias("cell_id"), F.lit(1.0).alias("value")), "cohort.counts", "cell_id", 4)
    tables.write_bucketed(spark.range(50).select(F.col("id").alias("cell_id"), F.lit("d").alias("donor_id")), "cohort.cells", "cell_id", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("cohort.counts").join(spark.table("cohort.cells"), "cell_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


MTX = "%%MatrixMarket matrix coordinate integer general\n% comment\n3 2 {n}\n{body}"


def test_matrix_market(spark, tmp_path):
    for name, body, zipped in (("GSM1_matrix.mtx", "1 1 5\n3 2 1\n", False), ("GSM2_matrix.mtx.gz", "1 1 2\n1 2 3\n2 2 4\n", True)):
        text = MTX.format(n=body.count("\n"), body=body)
        if zipped:
            with gzip.open(tmp_path / name, "wt") as f:
                f.write(text)
        else:
            (tmp_path / name).write_text(text)
    (tmp_path / "GSM1_barcodes.tsv").write_text("AA\nBB\n")
    genes = spark.createDataFrame([(1, "g1"), (2, "g2"), (3, "g3")], "gene_ix long, gene_id string")
    got = matrix_market.read_mtx(spark, str(tmp_path / "*matrix*"), genes)
    assert rows(got.select("sample_id", "cell_id", "gene_id", "value"), "cell_id", "gene_id") == [
        ("GSM1", "GSM1_1", "g1", 5.0), ("GSM1", "GSM1_2", "g3", 1.0), ("GSM2", "GSM2_1", "g1", 2.0), ("GSM2", "GSM2_2", "g1", 3.0), ("GSM2", "GSM2_2", "g2", 4.0),
    ]
    sizes = matrix_market.declared_sizes(spark, str(tmp_path / "*matrix*")).select("sample_id", "n_genes", "n_cells", "nnz")
    assert rows(sizes, "sample_id") == [("GSM1", 3, 2, 2), ("GSM2", 3, 2, 3)]
    bad = matrix_market.companion_problems(spark, str(tmp_path), ("matrix.mtx", "barcodes.tsv"))
    assert rows(bad.select("sample_id", "suffix"), "suffix") == [("GSM2", "barcodes.tsv"), ("GSM2", "matrix.mtx")]


def test_vector_directory(spark, tmp_path):
    for name, m in (("FLARE1", np.arange(6.0).reshape(2, 3)), ("123", np.ones((1, 3)))):
        np.save(tmp_path / f"{name}.npy", m)
    (tmp_path / "notes.txt").write_text("x")
    got = files.read_vectors(spark, str(tmp_path))
    assert rows(got, "donor_id", "cell_ix") == [("123", 0, [1.0, 1.0, 1.0]), ("FLARE1", 0, [0.0, 1.0, 2.0]), ("FLARE1", 1, [3.0, 4.0, 5.0])]
    inv = files.file_inventory(spark, str(tmp_path)).head()
    assert (inv["n_files"], inv["n_matching"], inv["n_other"], inv["all_same_size"]) == (3, 2, 1, False)
    assert rows(files.file_categories(spark, str(tmp_path)), "category") == [("flare_like", 1), ("managed_sle_numeric_like", 1)]
    np.save(tmp_path / "bad.npy", np.ones(3))
    with pytest.raises(PySparkException, match="shape"):
        files.read_vectors(spark, str(tmp_path)).collect()
    custom = files.read_vectors(spark, str(tmp_path), lambda b: np.frombuffer(b[:1], dtype="u1").reshape(1, 1), "notes.txt")
    assert rows(custom, "donor_id") == [("notes", 0, [float(ord("x"))])]


def test_fingerprints(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("b.csv", "2")):
        (tmp_path / name).write_text(text)
    recorded = spark.createDataFrame(files.fingerprint(spark, str(tmp_path)).toPandas())
    (tmp_path / "b.csv").write_text("3")
    (tmp_path / "c.csv").write_text("4")
    live = files.fingerprint(spark, str(tmp_path)).where("file <> 'a.csv'")
    assert rows(files.compare_fingerprints(recorded, live).select("file", "status"), "file") == [("a.csv", "missing"), ("b.csv", "drifted"), ("c.csv", "unrecorded")]
    df = spark.range(50)
    one, two = files.table_fingerprint(df).head(), files.table_fingerprint(df.repartition(7)).head()
    assert one == two and one != files.table_fingerprint(df.limit(49)).head()


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    chunks, out, state = (str(tmp_path / n) for n in ("chunks", "out", "state"))
    schema = "cell_id string, gene_id string, value double"
    cells = spark.createDataFrame([("c1", "A"), ("c2", "B")], "cell_id string, donor_id string")
    first = spark.createDataFrame([("c1", "g1", 1.0), ("c2", "g1", 2.0), ("c1", "g1", 4.0)], schema)
    second = spark.createDataFrame([("c1", "g1", 8.0), ("c2", "g2", 16.0)], schema)
    first.coalesce(1).write.parquet(chunks)
    run = lambda: incremental.append_partial_sums(incremental.stream_counts(spark, chunks, schema), out, state, cells).awaitTermination()
    run()
    second.coalesce(1).write.mode("append").parquet(chunks)
    run()
    want = rows(pb.pseudobulk(first.union(second), cells), "donor_id", "gene_id")
    assert rows(incremental.read_sums(spark, out), "donor_id", "gene_id") == want
    again = first.join(cells, "cell_id").groupBy("donor_id", "gene_id").agg(F.sum("value").alias("value"))
    again.write.mode("overwrite").parquet(f"{out}/batch_id=0")  # a replayed batch replaces itself
    assert rows(incremental.read_sums(spark, out), "donor_id", "gene_id") == want


def test_compaction_keeps_sums_through_replays_and_broken_runs(spark, tmp_path, monkeypatch):
    chunks, out, state = (str(tmp_path / n) for n in ("chunks", "out", "state"))
    schema, want = "donor_id string, gene_id string, value double", {}

    def arrive(first, last):
        for b in range(first, last):
            part = [("A", "g", float(2**b)), ("A", f"g{b % 3}", 1.0)]
            for d, g, v in part:
                want[d, g] = want.get((d, g), 0.0) + v
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(chunks)
        stream = incremental.stream_counts(spark, chunks, schema, files_per_batch=1)
        incremental.append_partial_sums(stream, out, state).awaitTermination()

    def check():
        assert {(r[0], r[1]): r[2] for r in incremental.read_sums(spark, out).collect()} == want

    arrive(0, 5)
    assert incremental.compact_sums(spark, out, state, fanout=2) == 2  # four batches as one run of level 2, and the fifth
    check()
    # A batch that is merged already is replayed: readers skip its folder.
    spark.createDataFrame([("A", "g", 1.0), ("A", "g0", 1.0)], schema).write.mode("overwrite").parquet(f"{out}/batch_id=0")
    check()
    arrive(5, 7)
    # The compaction dies before its manifest: the sums stay, and so does what it read.
    with monkeypatch.context() as m:
        m.setattr(incremental, "_MANIFEST", "no schema")
        with pytest.raises(Exception):
            incremental.compact_sums(spark, out, state, fanout=2)
    check()
    # The last batch counts as not committed: it is left alone while it is being replayed.
    (tmp_path / "state" / "commits" / "6").rename(tmp_path / "six")
    incremental.compact_sums(spark, out, state, fanout=2)
    assert (tmp_path / "out" / "batch_id=6").exists()
    spark.createDataFrame([("A", "g", 64.0), ("A", "g0", 1.0)], schema).write.mode("overwrite").parquet(f"{out}/batch_id=6")
    check()
    (tmp_path / "six").rename(tmp_path / "state" / "commits" / "6")
    arrive(7, 9)
    assert incremental.compact_sums(spark, out, state, fanout=2) == 2
    check()
    held = incremental._current(spark, out)[1]
    assert [r[1:] for r in held] == [(0, 7, 3), (8, 8, 0)]
    assert len(list((tmp_path / "out" / "manifest").iterdir())) <= 4  # two versions and their checksums at most
    assert incremental.compact_sums(spark, out, state, fanout=2) == 2  # nothing to do
    check()
    with pytest.raises(ValueError):
        incremental.compact_sums(spark, out, state, fanout=1)


def test_keyed_state_stream(spark, tmp_path):
    chunks = str(tmp_path / "chunks")
    schema = "donor_id string, gene_id string, value double"
    spark.createDataFrame([("A", "g", 1.0), ("A", "g", 2.0), ("B", "g", 5.0)], schema).repartition(2).write.parquet(chunks)
    sums = incremental.stream_pseudobulk(incremental.stream_counts(spark, chunks, schema))
    q = sums.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("sums"), "donor_id") == [("A", "g", 3.0), ("B", "g", 5.0)]
