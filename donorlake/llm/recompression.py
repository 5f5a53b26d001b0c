"""Removal of repeated 13-word windows by recompression.

A round of recompression names pairs of neighbouring symbols: a symbol's class
(left or right) is a bit of its name and the round, and a left symbol followed by
a right one becomes one symbol whose name is a hash of both; the others go on
as they are. Words are the symbols of the first round. Two symbols pair up whatever
surrounds them; that a symbol stays single depends on one neighbour. So every symbol
has a reach: the words that decide that it comes about, which are its own and those of
the neighbours that had to be seen. Equal word sequences have the same symbols
wherever the reach lies inside, in every document and without any exchange of names.
Neighbours of one name have one class, so a run of a token stays a run of its name.

Of the symbols of all rounds whose reach lies in a 13-word window, one stands for the
window: the one of the highest round that still counts, which is any of four words and
more, else of three, of two or of one, and among these the smallest name. Equal windows
have equal names, so a window can only repeat if its name is in two different
texts; those names reveal the long repeats, and their windows are verified word by word (by
96-bit hashes) against the smallest document that has them.

Rows: NULL or empty texts have no words; documents with NULL doc_id are neither
changed nor a reason to change others; rows that share a doc_id never repeat
one another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.repeats import checked_starts, kept_digest, marks, per_document, text_classes
from donorlake.llm.text import WordHashes, dropped, map_rows, mixed, split_words, text_key, written

WINDOW = 13
ROUNDS = 3
NAME_WORDS = 4  # symbols of so many words and more rank alike
AT_ONCE = 200_000  # words that are laid out together; a longer text is alone
_NONE = np.uint64(np.iinfo(np.uint64).max)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _ranked(names: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    """Names under which longer symbols (up to ``NAME_WORDS``) are smaller."""
    rank = np.uint64(NAME_WORDS) - np.minimum(words, NAME_WORDS).astype(np.uint64)
    return rank << np.uint64(60) | mixed(names) >> np.uint64(4)


def symbols(h: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every round the pairs it makes: names, lengths in words, first word of the reach and the one after it.

    ``h`` holds word hashes of texts, ``ends`` tells the place behind each text; a reach that touches it is without bounds.
    """
    n = len(h)
    names, end = h, ends.copy()
    start, stop = np.arange(n), np.arange(1, n + 1)
    low, high = np.where(end, -4 * n - 64, start), np.where(end, 4 * n + 64, stop)
    for i in range(1, rounds + 1):
        with np.errstate(over="ignore"):
            right = (mixed(names + np.uint64(i) * _MULTIPLIER) & np.uint64(1)).astype(bool)
            joined = mixed(names[:-1] * _MULTIPLIER + names[1:])
        first = np.flatnonzero(~right[:-1] & right[1:] & ~end[:-1] & ~end[1:])
        before, after = np.maximum(np.arange(len(names)) - 1, 0), np.minimum(np.arange(len(names)) + 1, len(names) - 1)
        seen = np.where(right, before, after)  # the neighbour that a symbol could have paired with
        new_low, new_high = np.minimum(low, low[seen]), np.maximum(high, high[seen])
        if len(names) and right[0]:
            new_low[0] = -4 * n - 64
        new_low[first], new_high[first] = np.minimum(low[first], low[first + 1]), np.maximum(high[first], high[first + 1])
        names, stop = names.copy(), stop.copy()
        names[first], stop[first] = joined[first], stop[first + 1]
        yield names[first], stop[first] - start[first], new_low[first], new_high[first]
        stay = np.ones(len(names), bool)
        stay[first + 1] = False
        names, end, start, stop, low, high = (x[stay] for x in (names, end, start, stop, new_low, new_high))


def _names_of(texts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The name of every window of every text; the texts are laid out in one row, each with a place behind it."""
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    n = int((lengths + 1).sum())
    ends = np.zeros(n, bool)
    ends[begins + lengths] = True
    h = np.zeros(n, np.uint64)
    h[~ends] = np.concatenate(texts)
    best = np.full(n, _NONE, np.uint64)
    for names, words, low, high in symbols(h, ends):
        inside = np.flatnonzero(high - low <= size)
        value, low, spare = _ranked(names[inside], words[inside]), low[inside], size - (high - low)[inside]
        for j in range(size):  # the window that starts j words before the reach
            fits = (spare >= j) & (low >= j)
            np.minimum.at(best, low[fits] - j, value[fits])
    windows = np.concatenate([np.arange(b, b + max(0, k - size + 1)) for b, k in zip(begins, lengths)])
    bare = windows[best[windows] == _NONE]
    if len(bare):
        view = np.lib.stride_tricks.sliding_window_view(_ranked(h, np.int64(1)), size)
        for at in range(0, len(bare), 65_536):
            part = bare[at : at + 65_536]
            best[part] = view[part].min(axis=1)
    return [best[b : b + max(0, k - size + 1)] for b, k in zip(begins.tolist(), lengths.tolist())]


def window_names(texts: list[np.ndarray], size: int = WINDOW) -> list[np.ndarray]:
    """The name of every window of every text of word hashes: a function of the window's words alone."""
    out, part, words = [], [], 0
    for t in texts:
        if part and words + len(t) > AT_ONCE:
            out += _names_of(part, size)
            part, words = [], 0
        part.append(t)
        words += len(t)
    return out + _names_of(part, size) if part else out


def revealed(docs: DataFrame) -> DataFrame:
    """``text_key, mark``: the names of windows that two or more different texts share."""

    def work():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch):
            found = [np.unique(x) for x in window_names([hashes(split_words(t)) for t in batch.column(1).to_pylist()])]
            who = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            return [pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(who)]

        return each

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(text_key().alias("text_key"), "text")
    names = written(map_rows(rows, ["text_key", "text"], "mark bigint, text_key bigint", work), "names")
    shared = names.groupBy("mark").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("mark")
    shared = written(shared, "names-shared")  # so that Spark can split a hot name in the join
    found = written(names.join(shared, "mark", "left_semi").select("text_key", "mark"), "names-found")
    dropped(names, shared)
    return found


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, whole, starts`` of the documents with windows that repeat smaller ones."""
    classes = written(text_classes(docs), "text-classes")
    found = revealed(docs)

    def named(texts: list[np.ndarray], shared: list[np.ndarray]) -> list[np.ndarray]:
        return [np.flatnonzero(np.isin(x, y.view(np.uint64))) for x, y in zip(window_names(texts), shared)]

    starts = checked_starts(docs, classes, found, WINDOW, named)
    dropped(found)
    return marks(classes, starts)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return per_document(
        docs, repeated(docs), WINDOW, "n_words bigint, n_removed bigint, kept_sha256 string",
        lambda words, mask: (len(words), int(mask.sum()), kept_digest(words, mask)),
    )


def kept_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the repeated words gone; the others are joined by one space."""
    return per_document(
        docs, repeated(docs), WINDOW, "text string",
        lambda words, mask: (b" ".join([w for w, gone in zip(words, mask.tolist()) if not gone]).decode("utf-8", "replace"),),
    )
