"""Exact check of word windows that repeat in smaller documents, from candidate places.

Operators that reveal repeats hand over candidate places of texts; here the
windows around them are compared by a 96-bit hash of their words, the smallest
doc_id of every window is found by a partial aggregate, and windows whose
smallest doc_id is below their own document's are marked.

Equal whole texts are one class, named by its smallest doc_id: only that
document is checked, and every other one with the text repeats it as a whole.
So a text held by a third of all documents is looked at once.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.text import WordHashes, dropped, map_rows, split_words, text_key, window_hashes, written


def text_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, first``: every document with the smallest doc_id that has its text."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", text_key().alias("text_key"), F.md5("text").alias("digest")).distinct()
    first = written(rows.groupBy("text_key", "digest").agg(F.min("doc_id").alias("first")), "text-firsts")
    return rows.join(first, ["text_key", "digest"]).select("doc_id", "text_key", "first")


def repeated_starts(docs: DataFrame, classes: DataFrame, places: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """``doc_id, text_key, starts``: where the windows of ``size`` words start that also start in a smaller document.

    ``places (text_key, pos)`` are candidates: a window can only repeat if it starts at ``pos − before`` to
    ``pos − after`` of one of them.
    """

    def near(texts: list[np.ndarray], marks: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for h, at in zip(texts, marks):
            n = max(0, len(h) - size + 1)
            open_at = np.zeros(n + 1, np.int64)
            np.add.at(open_at, np.clip(at - before, 0, n), 1)
            np.add.at(open_at, np.clip(at - after + 1, 0, n), -1)
            out.append(np.flatnonzero(np.cumsum(open_at)[:n] > 0))
        return out

    return checked_starts(docs, classes, places.withColumnRenamed("pos", "mark"), size, near)


def checked_starts(docs: DataFrame, classes: DataFrame, marked: DataFrame, size: int, candidates: Callable) -> DataFrame:
    """``doc_id, text_key, starts``: where the windows of ``size`` words start that also start in a smaller document.

    ``marked (text_key, mark)`` tells what was revealed in a text. ``candidates`` gets word hashes and marks of some
    texts, and says for each where the windows start that may repeat.
    """
    listed = marked.groupBy("text_key").agg(F.collect_set("mark").alias("marks"))  # no longer than the text
    firsts = classes.where("doc_id = first").join(listed, "text_key").select("doc_id", "text_key", "marks")
    rows = docs.select("doc_id", "text", text_key().alias("text_key")).join(firsts, ["doc_id", "text_key"])

    def work():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch):
            texts = [hashes(split_words(text)) for text in batch.column(2).to_pylist()]
            out: list = [[], [], [], []]
            for k, starts in enumerate(candidates(texts, [at.values.to_numpy() for at in batch.column(3)])):
                if len(starts):
                    out[0].append(window_hashes(texts[k], size)[starts].view(np.int64))
                    out[1].append((window_hashes(texts[k], size, second=True)[starts] >> np.uint64(33)).astype(np.int32))
                    out[2].append(starts.astype(np.int32))
                    out[3].append(np.full(len(starts), k))
            if not out[0]:
                return None
            who = pa.array(np.concatenate(out[3]))
            return [*[pa.array(np.concatenate(x)) for x in out[:3]], batch.column(0).take(who), batch.column(1).take(who)]

        return each

    schema = "h bigint, c int, start int, doc_id bigint, text_key bigint"
    windows = written(map_rows(rows, ["doc_id", "text_key", "text", "marks"], schema, work), "repeat-windows")
    spread = windows.groupBy("h", "c").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # Written first, so that the join has a plain shuffle on either side and Spark can split a hot window.
    spread = written(spread.select("h", "c", "least"), "repeat-least")
    marked = windows.join(spread, ["h", "c"]).where("doc_id > least")
    found = written(marked.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("start")).alias("starts")), "repeat-starts")
    dropped(windows, spread)
    return found


def marks(classes: DataFrame, starts: DataFrame) -> DataFrame:
    """``doc_id, text_key, whole, starts`` of the documents in which something repeats."""
    copies = classes.where("doc_id > first").select("doc_id", "text_key").distinct()
    copies = copies.select("*", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts"))
    return copies.unionByName(starts.select("doc_id", "text_key", F.lit(False).alias("whole"), "starts"))


def covered(n_words: int, whole: bool | None, starts: np.ndarray | None, size: int) -> np.ndarray:
    """Which words of a document lie in a repeated window."""
    if n_words < size or (not whole and starts is None):
        return np.zeros(n_words, bool)
    if whole:
        return np.ones(n_words, bool)
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n_words] > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of marked words, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def per_document(docs: DataFrame, marked: DataFrame, size: int, schema: str, columns: Callable) -> DataFrame:
    """One row per row of ``docs``: doc_id and what ``columns(words, mask)`` makes of its words and marks."""
    rows = docs.select("doc_id", "text", text_key().alias("text_key")).join(marked, ["doc_id", "text_key"], "left")

    def work():
        def each(batch: pa.RecordBatch):
            out = []
            for text, whole, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                words = split_words(text)
                at = starts.values.to_numpy() if starts.is_valid else None
                out.append(columns(words, covered(len(words), whole, at, size)))
            return [batch.column(0), *[pa.array(c, type=t) for c, t in zip(zip(*out), kinds)]]

        return each

    kinds = [{"bigint": pa.int64(), "string": pa.string()}[part.split()[1]] for part in schema.split(",")]
    return map_rows(rows, ["doc_id", "text", "whole", "starts"], f"doc_id bigint, {schema}", work)


def kept_digest(words: list[bytes], mask: np.ndarray) -> str:
    return sha256(b" ".join([w for w, gone in zip(words, mask.tolist()) if not gone]) if mask.any() else b" ".join(words)).hexdigest()
