"""Small helpers shared by the text operators: words, hashes, row keys, Arrow batches."""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlake.session import dropped, written  # noqa: F401

_CACHE_WORDS = 400_000  # entries a task keeps before it starts anew
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes (NULL: none). ``bytes.split`` parts at exactly these bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordTable:
    """Numbers of words, and for each number one 64-bit value per function in ``values``.

    Kept for words seen before; a table that has grown past ``limit`` starts anew, so its memory is bounded.
    """

    def __init__(self, *values: Callable[[bytes], int], limit: int = _CACHE_WORDS):
        self._values, self._limit = values, limit
        self._start()

    def _start(self) -> None:
        columns = self._columns = [array("Q") for _ in self._values]
        values = self._values

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                for column, value in zip(columns, values):
                    column.append(value(word))
                self[word] = number = len(self)
                return number

        self._known = Known()

    def __call__(self, words: Sequence[bytes]) -> np.ndarray:
        """Numbers of the words, good until the next call."""
        if len(self._known) > self._limit:
            self._start()
        return np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))

    def column(self, k: int, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self._columns[k], np.uint64)[numbers] if len(numbers) else np.empty(0, np.uint64)


class WordHashes:
    """64-bit hashes of the words of a text."""

    def __init__(self, seed: int = 0):
        self._table = WordTable(lambda w: xxhash.xxh3_64_intdigest(w, seed))

    def __call__(self, words: Sequence[bytes]) -> np.ndarray:
        return self._table.column(0, self._table(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(h: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes, in order; ``second`` gives an independent one."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        base = mixed(h + _SECOND) if second else h
        acc = np.zeros(n, np.uint64)
        for j in range(size):
            acc = acc * _MULTIPLIER + base[j : j + n]
        return mixed(acc)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest value (leftmost on ties) of every ``width`` neighbours, each position once."""
    if not len(values):
        return np.empty(0, np.int64)
    if len(values) <= width:
        return np.array([int(np.argmin(values))])
    view = np.lib.stride_tricks.sliding_window_view(values, width)
    picks = [np.argmin(view[s : s + 65_536], axis=1) + np.arange(s, min(s + 65_536, len(view))) for s in range(0, len(view), 65_536)]
    return np.unique(np.concatenate(picks))


def map_rows(df: DataFrame, columns: Sequence[str], schema: str, work: Callable, step: int = 512) -> DataFrame:
    """``mapInArrow`` over the named columns in small slices, so that one slice of very long texts stays small.

    ``work`` is called once per task and returns a function from a slice to a list of output columns.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                out = each(batch.slice(start, step))
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    return df.select(*columns).mapInArrow(run, schema)


class Shared:
    """A broadcast of a value of this package's classes. It travels with their definitions, so executors don't import them."""

    def __init__(self, spark: SparkSession, value: object):
        self._held, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"_held": self._held, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._held.value)
        return self._value


def text_key() -> Column:
    """Tells rows of one doc_id with different texts apart; equal rows share a key and a result."""
    return F.xxhash64("text")


def crc_fold() -> Column:
    """crc32 of doc_id as text, modulo 5; remainder 0 is the held-out part."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def hash_sample(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` distinct keys of the rows: those with the smallest hashes.

    Large tables are first cut to about ``2 n`` keys by the hash alone, so that what meets in one task stays small.
    """
    rows = rows.select(*keys).distinct()
    total, order = rows.count(), F.shiftrightunsigned(F.xxhash64(*keys), 33)
    if total > 4 * n:
        rows = rows.where(order < int(2**31 * (2 * n / total)))
    return rows.orderBy(order, *keys).limit(n)


def one_text(docs: DataFrame, picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``picked``, a bounded sample, beside the text of one row of ``docs`` with the same ``keys``: the one with the smallest hash."""
    rows = docs.join(F.broadcast(picked.select(*keys).distinct()), list(keys), "left_semi")
    one = rows.groupBy(*keys).agg(F.min(F.struct(text_key().alias("k"), "text")).alias("one"))
    return one.select(*keys, "one.text").join(F.broadcast(picked), list(keys))
