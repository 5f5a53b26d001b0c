"""Benchmark decontamination by greedy string tiling.

Every run of ``min_match`` tokens of a test item is a seed; a task finds the
seeds that its documents share by a rolling Karp-Rabin hash, compared token by
token. Seeds on one diagonal join to maximal matches. The longest match is
marked in both texts, again and again, as long as unmarked matches of
``min_match`` tokens are left (equally long ones in order of their places in
the item, then in the document). Tiles may stand in any order, so a passage
whose parts were moved still covers its item. A document is contaminated if
tiles cover at least ``threshold`` of an item's tokens.

The benchmark's seeds are broadcast in passes of at most ``pass_bytes`` of test
text (one pass for a small benchmark, more for a large one; the results are the
same). Documents are neither copied nor shuffled; only findings are.

Tokens are words in ASCII lower case, parted at white space and ASCII marks.
Rows: NULL or empty texts, and documents or items shorter than ``min_match``
tokens, have no match; items with NULL item_id or text are left out; items that
repeat count once per item_id and text; a row with NULL doc_id is judged like
any other; repeated rows get repeated results; empty tables give no findings;
other columns are ignored (``keep_clean`` keeps them).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.text import Shared, map_rows, mixed, text_key
from donorlake.llm.toxicity import plain_words
from donorlake.operators.ordering import union_all

MIN_MATCH = 5
THRESHOLD = 0.6
PASS_BYTES = 16_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Seeds:
    """The seeds of some items, sorted by hash."""

    words: dict[bytes, int]
    tokens: np.ndarray  # of all items in a row
    item: np.ndarray  # per token: number of its item
    starts: np.ndarray
    ids: list[int]
    keys: np.ndarray
    places: np.ndarray
    size: int


def rolling(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens from each place in ``at``."""
    acc = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            acc = acc * _MULTIPLIER + ids[at + j].astype(np.uint64) + np.uint64(1)
        return mixed(acc)


def seeds_of(items: list[tuple[int, str]], size: int) -> Seeds:
    words: dict[bytes, int] = {}
    tokens, item, starts, ids = [], [], [0], []
    for item_id, text in items:
        found = plain_words(text)
        tokens += [words.setdefault(w, len(words)) for w in found]
        item += [len(ids)] * len(found)
        starts.append(len(tokens))
        ids.append(item_id)
    tokens, item = np.array(tokens, np.int64), np.array(item, np.int64)
    at = np.arange(max(0, len(tokens) - size + 1))
    at = at[item[at] == item[at + size - 1]] if len(at) else at
    keys = rolling(tokens, at, size)
    order = np.argsort(keys, kind="stable")
    return Seeds(words, tokens, item, np.array(starts), ids, keys[order], at[order], size)


def matches(text: str | None, seeds: Seeds) -> np.ndarray:
    """Maximal matches of a document with all items: rows of (item, place in the item, place in the document, length)."""
    none = np.empty((0, 4), np.int64)
    found = plain_words(text)
    size = seeds.size
    if len(found) < size or not len(seeds.keys):
        return none
    ids = np.fromiter(map(seeds.words.get, found, repeat(-1)), np.int64, len(found))
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    at = np.flatnonzero(unknown[size:] == unknown[:-size])
    if not len(at):
        return none
    keys = rolling(ids, at, size)
    low, high = np.searchsorted(seeds.keys, keys, "left"), np.searchsorted(seeds.keys, keys, "right")
    n = high - low
    t = np.repeat(at, n)
    if not len(t):
        return none
    p = seeds.places[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(t))]
    same = np.ones(len(t), bool)
    for j in range(size):
        same &= ids[t + j] == seeds.tokens[p + j]
    t, p = t[same], p[same]
    item = seeds.item[p]
    order = np.lexsort((t, t - p, item))
    t, p, item = t[order], p[order], item[order]
    first = np.ones(len(t), bool)
    first[1:] = (item[1:] != item[:-1]) | (t[1:] != t[:-1] + 1) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(t))) + size - 1
    return np.column_stack([item[begin], p[begin] - seeds.starts[item[begin]], t[begin], length])


def tiled(runs: list[tuple[int, int, int]], n_item: int, size: int) -> int:
    """Number of an item's tokens under greedy tiles, from its maximal matches (place in item, in document, length)."""
    marked_p, marked_t = np.zeros(n_item, bool), set()
    heap = [(-n, p, t) for p, t, n in runs]
    heapq.heapify(heap)
    while heap:
        n, p, t = heapq.heappop(heap)
        n = -n
        free = [not marked_p[p + i] and t + i not in marked_t for i in range(n)]
        if all(free):
            marked_p[p : p + n] = True
            marked_t.update(range(t, t + n))
            continue
        start = None
        for i, ok in enumerate([*free, False]):  # what is left of a match goes back in line
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= size:
                    heapq.heappush(heap, (start - i, p + start, t + start))
                start = None
    return int(marked_p.sum())


def coverages(text: str | None, seeds: Seeds, threshold: float) -> list[tuple[int, float]]:
    """``(item_id, covered share)`` of all items that tiles cover by the threshold at least."""
    found = matches(text, seeds)
    out = []
    for item in np.unique(found[:, 0]):
        runs = found[found[:, 0] == item, 1:]
        n_item = int(seeds.starts[item + 1] - seeds.starts[item])
        bound = np.zeros(n_item + 1, np.int64)  # tiles lie inside matches, so their union bounds the coverage
        np.add.at(bound, runs[:, 0], 1)
        np.add.at(bound, runs[:, 0] + runs[:, 2], -1)
        if (np.cumsum(bound)[:-1] > 0).sum() < threshold * n_item:
            continue
        share = tiled([tuple(map(int, r)) for r in runs], n_item, seeds.size) / n_item
        if share >= threshold:
            out.append((seeds.ids[item], share))
    return out


def findings(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``doc_id, text_key, item_id, coverage`` of every contaminated document and the items it covers."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total * 2 // pass_bytes)) if total > pass_bytes else 1
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    parts = []
    for i in range(passes):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        seeds = Shared(spark, seeds_of([(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()], min_match))

        def work(seeds=seeds):
            def each(batch: pa.RecordBatch):
                hits = [(k, *x) for k, t in enumerate(batch.column(2).to_pylist()) for x in coverages(t, seeds.value, threshold)]
                if not hits:
                    return None
                at, item, share = zip(*hits)
                pick = pa.array(at, pa.int64())
                return [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(item, pa.int64()), pa.array(share, pa.float64())]

            return each

        schema = "doc_id bigint, text_key bigint, item_id bigint, coverage double"
        parts.append(map_rows(rows, ["doc_id", "text_key", "text"], schema, work))
    return union_all(parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``doc_id, contaminated, coverage, item_id, item_ids`` of every document: its best item (ties: the smaller id) and all."""
    best = F.max_by("item_id", F.struct("coverage", (-F.col("item_id")).alias("i")))
    found = findings(docs, benchmark, **settings).groupBy("doc_id", "text_key").agg(
        F.max("coverage").alias("coverage"), best.alias("item_id"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    rows = docs.select("doc_id", text_key().alias("text_key")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key"))
    return rows.join(found.alias("f"), same, "left").select(
        "d.doc_id", F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id", "item_ids"
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    found = findings(docs, benchmark, **settings).select("doc_id", "text_key").distinct().alias("f")
    rows = docs.withColumn("_text_key", text_key()).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._text_key") == F.col("f.text_key"))
    return rows.join(found, same, "left_anti").drop("_text_key")
