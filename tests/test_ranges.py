"""Files read by ranges: matrices, block digests, heads."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from donorlake.sources import matrix_market, ranges


def test_matrices_by_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    mats = {"a": rng.normal(size=(101, 5)).astype("<f4"), "b": rng.normal(size=(1, 3)), "c": np.arange(12, dtype="<i8").reshape(4, 3)}
    for name, m in mats.items():
        np.save(tmp_path / f"{name}.npy", m)
    (tmp_path / "notes.txt").write_text("no matrix")
    for size in (64, 173, 1 << 20):
        got = ranges.read_matrices(spark, str(tmp_path), range_bytes=size).collect()
        assert len(got) == 106
        for r in got:
            assert r["embedding"] == mats[r["donor_id"]][r["cell_ix"]].astype(float).tolist()
    assert len(ranges.MatrixReader({"path": str(tmp_path), "pattern": "a*", "range_bytes": "500"}).partitions()) == 5


@pytest.mark.parametrize("bad", [np.zeros(3), np.zeros((0, 3)), np.asfortranarray(np.ones((3, 3)))])
def test_unusable_matrices_fail(spark, tmp_path, bad):
    np.save(tmp_path / "x.npy", bad)
    with pytest.raises(PySparkException, match="matrix of x"):
        ranges.read_matrices(spark, str(tmp_path)).collect()


def test_cut_off_matrix_fails(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.ones((50, 4)))
    whole = (tmp_path / "x.npy").read_bytes()
    (tmp_path / "x.npy").write_bytes(whole[:-8])
    with pytest.raises(PySparkException, match="cut off"):
        ranges.read_matrices(spark, str(tmp_path)).collect()


def test_matrix_of_more_than_two_gib(tmp_path):
    """A sparse file: only the ranges that are asked for are read."""
    rows, width = 300_000_000, 2
    with open(tmp_path / "big.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, width)})
        begin = f.tell()
        f.truncate(begin + rows * width * 4)
        f.seek(begin + (rows - 1) * width * 4)
        f.write(np.array([1.5, -2.0], "<f4").tobytes())
    reader = ranges.MatrixReader({"path": str(tmp_path), "range_bytes": str(1 << 20)})
    parts = reader.partitions()
    assert len(parts) == -(-(begin + rows * 8) // (1 << 20)) and parts[-1].stop > 2**31
    last = list(reader.read(parts[-1]))[-1]
    assert last["cell_ix"][-1].as_py() == rows - 1 and last["embedding"][-1].as_py() == [1.5, -2.0]
    counts = [sum(b.num_rows for b in reader.read(p)) for p in (parts[0], parts[1])]
    first = next(reader.read(parts[1]))
    assert first["cell_ix"][0].as_py() == counts[0]


def test_written_matrices(spark, tmp_path):
    rows = spark.range(0, 40).select((F.col("id") % 3).cast("string").alias("donor_id"), F.col("id").alias("cell_ix"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("embedding"))
    assert ranges.write_matrices(rows, str(tmp_path / "m")) == 3
    m = np.load(tmp_path / "m" / "1.npy")
    assert m.dtype == np.float32 and m[:, 0].tolist() == [float(i) for i in range(1, 40, 3)]
    assert ranges.read_matrices(spark, str(tmp_path / "m")).count() == 40


def test_a_donors_rows_meet_in_one_task(spark, tmp_path):
    """A join that turns into a broadcast while it runs left a donor's rows where they were read, and several tasks wrote its file."""
    donor = F.when(F.col("id") < 400, (F.col("id") % 3).cast("string"))
    rows = spark.range(0, 402, 1, 5).select(donor.alias("donor_id"), F.col("id").alias("cell_ix"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("embedding"))
    dealt = ranges._by_donor(rows, "donor_id", "cell_ix", "embedding")
    dealt.collect()
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan and "AQEShuffleRead local" not in plan
    assert {(r["donor"], r["_n"]) for r in dealt.collect()} == {("0", 134), ("1", 133), ("2", 133)}
    assert ranges.write_matrices(rows, str(tmp_path / "m")) == 3
    for d in range(3):
        assert np.load(tmp_path / "m" / f"{d}.npy")[:, 0].tolist() == [float(i) for i in range(d, 400, 3)]


def test_digest_trees(spark, tmp_path):
    texts = {"empty": b"", "one": b"x" * 10, "two": b"y" * 150, "many": bytes(range(256)) * 40}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t)
    blocks = ranges.block_digests(spark, str(tmp_path), block_bytes=100)
    got = {r["path"].rsplit("/", 1)[1]: r for r in ranges.tree_digests(blocks, 3).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for name, t in texts.items():
        level = [sha(t[i : i + 100]) for i in range(0, max(1, len(t)), 100)]
        assert got[name]["n_blocks"] == len(level) and got[name]["bytes"] == len(t)
        while len(level) > 1:
            parts = [level[i : i + 3] for i in range(0, len(level), 3)]
            level = [p[0] if len(p) == 1 else sha("".join(p).encode()) for p in parts]
        assert got[name]["root"] == level[0]


def test_heads_do_not_read_bodies(spark, tmp_path):
    head = b"%%MatrixMarket matrix coordinate integer general\n%" + b"c" * 9000 + b"\n\n  3 2 4 \n"
    (tmp_path / "s1_matrix.mtx").write_bytes(head + b"1 1 5\n" * 2_000_000)
    (tmp_path / "s2_matrix.mtx").write_bytes(head + b"1 1 5\n")
    (tmp_path / "s3_matrix.mtx.gz").write_bytes(gzip.compress(head + b"1 1 5\n" * 100_000))
    (tmp_path / "none").write_bytes(b"% only\n%comments")
    got = {r["path"].rsplit("/", 1)[1]: r for r in ranges.first_lines(spark, str(tmp_path)).collect()}
    assert {r["line"] for n, r in got.items() if n != "none"} == {"3 2 4"} and got["none"]["line"] is None
    assert got["s1_matrix.mtx"]["bytes_read"] == 12_288 == got["s3_matrix.mtx.gz"]["bytes_read"]
    sizes = matrix_market.declared_sizes(spark, str(tmp_path / "*matrix*"))
    assert {tuple(r)[2:] for r in sizes.collect()} == {(3, 2, 4)} and {r["sample_id"] for r in sizes.collect()} == {"s1", "s2", "s3"}
    with pytest.raises(PySparkException, match="no size line"):
        matrix_market.declared_sizes(spark, str(tmp_path)).collect()


def test_small_blocks_share_a_task_and_a_tree_may_end_early(spark, tmp_path):
    data = bytes(range(256)) * 20
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(b"")
    blocks = ranges.block_digests(spark, str(tmp_path), "*.txt", 100)
    assert blocks.rdd.getNumPartitions() == 2
    got = sorted((r["block"], r["bytes"], r["sha256"]) for r in blocks.where("path LIKE '%a.txt'").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(data[i * 100 : i * 100 + 100]), sha(data[i * 100 : i * 100 + 100])) for i in range(52)]
    assert got == want
    nodes = [sha("".join(w[2] for w in want[i : i + 4]).encode()) for i in range(0, 52, 4)]
    nodes = [sha("".join(nodes[i : i + 4]).encode()) if len(nodes[i : i + 4]) > 1 else nodes[i] for i in range(0, 13, 4)]
    tops = [(r["bytes"], r["n_blocks"], r["root"]) for r in ranges.tree_digests(blocks, 4, levels=2).where("path LIKE '%a.txt'").collect()]
    assert sorted(tops) == sorted((len(data), 52, n) for n in nodes)


def test_small_ranges_grow_with_the_files(tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((40_000, 8), "f4"))
    parts = ranges.MatrixReader({"path": str(tmp_path), "range_bytes": "100"}).partitions()
    assert len(parts) <= 258 and parts[-1].stop == parts[0].size
