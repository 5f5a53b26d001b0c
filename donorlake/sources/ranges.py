"""Files read by ranges: binary matrices, digests of blocks, and heads of text files, as Python data sources.

A partition is a range of bytes of one file, so a file of any size is dealt over tasks,
which seek to their part. The planner lists files and never opens them; a task reads a
file's header itself (a few hundred bytes). Paths are what ``pyarrow.fs`` opens: local
or mounted folders, and object stores and HDFS where pyarrow supports them.
"""

from __future__ import annotations

import ast
import fnmatch
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
FAN = 1024  # digests that make one digest of the level above
_PIECE = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files below a folder (or the file itself) whose name fits ``pattern``, with their sizes; hidden ones are left out."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    ok = lambda f: f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    return sorted((prefix + f.path, f.size) for f in found if ok(f))


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        self.path, self.start, self.stop, self.size = path, start, stop, size


class RangeReader(DataSourceReader):
    """Cuts every listed file into ranges of ``range_bytes``; an empty file is one empty range."""

    def __init__(self, options: dict):
        self.options, self.step = options, int(options.get("range_bytes", RANGE_BYTES))

    def widen(self, total: int) -> None:
        """Called with the bytes of all files before they are cut."""

    def partitions(self) -> list[Range]:
        out, files = [], listed(self.options["path"], self.options.get("pattern", "*"))
        self.widen(sum(size for _, size in files))
        for path, size in files:
            out += [Range(path, at, min(size, at + self.step), size) for at in range(0, max(size, 1), self.step)]
        return out


# --- matrices -------------------------------------------------------------------


def matrix_header(file, name: str) -> tuple[int, np.dtype, int, int]:
    """Where the values start, their type, rows and columns of an array file of version 1 or 2."""
    head = file.read(12)
    if head[:6] != b"\x93NUMPY" or head[6] not in (1, 2, 3):
        raise ValueError(f"{name} is not an array file")
    length, at = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
    file.seek(at)
    text = ast.literal_eval(file.read(length).decode("latin-1"))
    shape, kind = text["shape"], np.dtype(text["descr"])
    if len(shape) != 2 or 0 in shape or text["fortran_order"] or kind.kind not in "fiu":
        raise ValueError(f"matrix of {name} has shape {shape}, type {kind}, column order {text['fortran_order']}")
    return at + length, kind, *shape


class MatrixReader(RangeReader):
    def widen(self, total: int) -> None:
        """Small ranges grow with the files, up to 1 MB, so that tasks don't: some 256 and one per file."""
        self.step = max(self.step, min(_PIECE, total // 256))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The rows whose first byte lies in the range."""
        system, path = opened(part.path)
        donor = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        with system.open_input_file(path) as file:
            begin, kind, n, width = matrix_header(file, donor)
            stride = width * kind.itemsize
            if begin + n * stride > part.size:
                raise ValueError(f"matrix of {donor} is cut off")
            first = max(0, -(-(part.start - begin) // stride))
            last = min(n, max(0, -(-(part.stop - begin) // stride)))
            step = max(1, _PIECE // stride)
            file.seek(begin + first * stride)
            for at in range(first, last, step):
                rows = min(step, last - at)
                flat = np.frombuffer(file.read(rows * stride), kind).astype(np.float64)
                values = pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([donor] * rows), pa.array(np.arange(at, at + rows, dtype=np.int64)), values], names=["donor_id", "cell_ix", "embedding"])


class MatrixRows(DataSource):
    """A folder of one array file per donor, whose name is the donor."""

    @classmethod
    def name(cls) -> str:
        return "matrix_rows"

    def schema(self) -> str:
        return "donor_id string, cell_ix bigint, embedding array<double>"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options)


def read_matrices(spark: SparkSession, path: str, pattern: str = "*.npy", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``donor_id, cell_ix, embedding`` of all array files below ``path``; a large file is read by many tasks.

    A file that isn't two-dimensional, is empty, in column order or cut off fails; a folder without files gives no rows.
    """
    spark.dataSource.register(MatrixRows)
    return spark.read.format("matrix_rows").options(path=path, pattern=pattern, range_bytes=str(range_bytes)).load()


def _by_donor(rows: DataFrame, donor: str, order: str, value: str) -> DataFrame:
    """``donor, _n, _w, _v, x, o``: every donor's rows in order in one task, beside their number, least and greatest length.

    By a window, which needs a donor's rows together: after a join with the sizes Spark drops a repartition by the same key,
    and then may turn the join into one that leaves the rows where they were read.
    """
    named = rows.where(F.col(donor).isNotNull())
    named = named.select(F.col(donor).cast("string").alias("donor"), F.size(value).alias("w"), F.col(value).cast("array<float>").alias("x"), F.col(order).alias("o"))
    mine = Window.partitionBy("donor").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = [F.count(F.lit(1)).over(mine).alias("_n"), F.min("w").over(mine).alias("_w"), F.max("w").over(mine).alias("_v")]
    return named.select("donor", *sizes, "x", "o").sortWithinPartitions("donor", "o")


def write_matrices(rows: DataFrame, path: str, donor: str = "donor_id", order: str = "cell_ix", value: str = "embedding") -> int:
    """One array file of 32-bit floats per donor, its rows in ``order``; returns how many. Rows stream through the task of
    their donor; vectors of unequal length fail."""
    system, root = opened(path)
    system.create_dir(root, recursive=True)
    whole = _by_donor(rows, donor, order, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        now, out, done = None, None, 0
        for batch in batches:
            for name, n, low, high, x in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4)):
                if low != high:
                    raise ValueError(f"vectors of {name} have {low} to {high} components")
                if name != now:
                    if out is not None:
                        out.close()
                    now, done = name, done + 1
                    out = system.open_output_stream(f"{root}/{name}.npy")
                    head = repr({"descr": "<f4", "fortran_order": False, "shape": (n, low)}).encode() + b" "
                    head += b" " * (-(len(head) + 11) % 64) + b"\n"
                    out.write(b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head)
                out.write(x.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["files"])

    return whole.mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0] or 0


# --- digests ---------------------------------------------------------------------


class BlockReader(RangeReader):
    """A partition is as many whole blocks of a file as lie in ``RANGE_BYTES``, one block at least: small blocks don't make a task each."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.block = self.step
        self.step *= max(1, RANGE_BYTES // self.block)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, path = opened(part.path)
        found = []
        with system.open_input_file(path) as file:
            file.seek(part.start)
            for start in range(part.start, max(part.stop, part.start + 1), self.block):
                stop = min(part.stop, start + self.block)
                digest, left = hashlib.sha256(), stop - start
                while left:
                    piece = file.read(min(left, _PIECE))
                    if not piece:
                        raise ValueError(f"{path} became shorter")
                    digest.update(piece)
                    left -= len(piece)
                found.append((part.path, start // self.block, stop - start, digest.hexdigest()))
                if len(found) == 4096 or stop >= part.stop:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["path", "block", "bytes", "sha256"])
                    found = []


class FileBlocks(DataSource):
    """SHA-256 of every block of every file."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return "path string, block bigint, bytes bigint, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


def block_digests(spark: SparkSession, path: str, pattern: str = "*", block_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, block, bytes, sha256`` of the blocks of all files below ``path``."""
    spark.dataSource.register(FileBlocks)
    return spark.read.format("file_blocks").options(path=path, pattern=pattern, range_bytes=str(block_bytes)).load()


def tree_digests(blocks: DataFrame, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """``path, bytes, n_blocks, root``: a digest tree over the blocks of every file.

    A level's digest is the SHA-256 of the hex digests of up to ``fan`` nodes below, in order (a lone node's digest is kept), so
    a file of one block has that block's digest. The root depends on the block size and fan, so compare files that were cut alike.
    With ``levels`` the tree ends that many levels up: a file of more than fan ** levels blocks has a row per node there.
    """
    level = blocks.select("path", "block", "bytes", F.lit(1).cast("bigint").alias("n"), "sha256")
    deepest = (level.agg(F.max("block")).first()[0] or 0) + 1
    files = level.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n_blocks"))
    while deepest > 1 and levels != 0:
        node = F.floor(F.col("block") / fan).cast("bigint")
        below = F.array_sort(F.collect_list(F.struct("block", "sha256")))  # fan at most
        joined = level.groupBy("path", node.alias("block")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), below.alias("b"))
        text = F.array_join(F.transform("b", lambda x: x["sha256"]), "")
        # A lone node goes up as it is, so that a root doesn't depend on how deep other files are.
        level = joined.select("path", "block", "bytes", "n", F.when(F.size("b") == 1, text).otherwise(F.sha2(text, 256)).alias("sha256"))
        deepest, levels = -(-deepest // fan), levels and levels - 1
    if deepest > 1:  # nodes of the same file are told apart by their digests only
        return level.select("path", F.col("sha256").alias("root")).join(files, "path").select("path", "bytes", "n_blocks", "root")
    return level.select("path", "bytes", F.col("n").alias("n_blocks"), F.col("sha256").alias("root"))


# --- heads ------------------------------------------------------------------------


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.comment = options, options.get("comment", "%").encode()

    def partitions(self) -> list[Range]:
        return [Range(path, 0, size, size) for path, size in listed(self.options["path"], self.options.get("pattern", "*"))]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The first line that isn't empty or a comment. Reads 4 KB at a time, until that line ends."""
        system, path = opened(part.path)
        text, used, line = b"", 0, None
        with system.open_input_stream(path, compression="detect", buffer_size=0) as file:
            while line is None:
                piece = file.read(4096)
                used, text = used + len(piece), text + piece
                done = text.split(b"\n") if not piece else text.split(b"\n")[:-1]
                line = next((x.strip() for x in done if x.strip() and not x.lstrip().startswith(self.comment)), None)
                if line is None and not piece:
                    break
                text = text[text.rfind(b"\n") + 1 :] if line is None else text
        found = None if line is None else line.decode()
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([found], pa.string()), pa.array([used], pa.int64())], names=["path", "line", "bytes_read"])


class FileHeads(DataSource):
    """The first line of text of every file."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, line string, bytes_read bigint"

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options)


def first_lines(spark: SparkSession, path: str, pattern: str = "*", comment: str = "%") -> DataFrame:
    """``path, line, bytes_read``: the first line of every file below ``path`` that isn't empty or a comment (NULL: none).

    Bodies stay unread; gzip files are unpacked as far as needed.
    """
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").options(path=path, pattern=pattern, comment=comment).load()
