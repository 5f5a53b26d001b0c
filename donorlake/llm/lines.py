"""Lines that many documents hold are dropped from all of them but the last one.

Two Bloom filters tell lines seen once from lines seen again:

1. Every task puts the keys of its documents into a filter of its own (a key
   once per document); a key whose bits are all set already goes into a second
   one. Filters meet by segments: what is set in both firsts is set in the
   joint second, which so holds every key of two documents or more.
2. The joint second filter is broadcast. Only keys found in it leave their task,
   as 128-bit digests; the filter's false finds are sorted out by the exact count
   of documents per key, which also chooses the document that keeps the line.
3. Documents are rewritten beside the keys they lose.

A filter takes 16 bits a line and at most ``MAX_WORDS`` 64-bit words (32 MB). With
more lines than that it fills up: more keys are counted exactly (24 bytes each),
the result stays the same.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
in lower case. Rows: a NULL or empty text is one empty line; rows of one doc_id are
one document; rows without doc_id count for no line and keep all of theirs; repeated
rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.text import dropped, map_rows, text_key, written
from donorlake.session import task_slots

MIN_LENGTH = 20  # code points of a key that can be dropped
MIN_DOCS = 3
KEY_BITS = 16
MAX_WORDS = 1 << 22
PROBES = 4
SEGMENT = 1 << 14  # words of a filter that meet in one row


def line_keys(text: str | None, min_length: int = MIN_LENGTH) -> list[bytes | None]:
    """The key of every line in order; None for keys that are too short."""
    keys = [line.strip() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
    return [k if len(k) >= min_length and (k.isascii() or len(k.decode("utf-8", "surrogatepass")) >= min_length) else None for k in keys]


def digests(texts: list[str | None], min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests (two columns) of the distinct keys of every text, and the number of the text."""
    found, owner = [], []
    for i, text in enumerate(texts):
        keys = {k for k in line_keys(text, min_length) if k is not None}
        found += map(xxhash.xxh3_128_digest, keys)
        owner.append(len(keys))
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2), np.repeat(np.arange(len(texts)), owner)


def places(digest: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter and the bits in it of every digest."""
    bits = np.zeros(len(digest), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((digest[:, 1] >> np.uint64(6 * i)) & np.uint64(63))
    return (digest[:, 0] % np.uint64(words)).astype(np.int64), bits


class SeenTwice:
    """The two filters of one task."""

    def __init__(self, words: int):
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, digest: np.ndarray) -> None:
        if not len(digest):
            return
        _, first, count = np.unique(digest[:, 0], return_index=True, return_counts=True)
        word, bits = places(digest[first], len(self.once))
        again = (count > 1) | ((self.once[word] & bits) == bits)
        np.bitwise_or.at(self.twice, word[again], bits[again])
        np.bitwise_or.at(self.once, word, bits)

    def meet(self, word: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        """Add what other tasks set in some (distinct) words."""
        self.twice[word] |= twice | (self.once[word] & once)
        self.once[word] |= once


_FILTERS = "segment int, word array<int>, once array<bigint>, twice array<bigint>"


def _rows(segment: int, word: np.ndarray, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    one = lambda x, t: pa.array([x], pa.list_(t))
    columns = [pa.array([segment], pa.int32()), one(word.astype(np.int32), pa.int32()), one(once.view(np.int64), pa.int64()), one(twice.view(np.int64), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "word", "once", "twice"])


def _task_filters(docs: DataFrame, words: int, min_length: int) -> DataFrame:
    """The filters of every task, cut into segments; words without a bit are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = SeenTwice(words), min(words, SEGMENT)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                seen.add(digests(batch.column(0).slice(start, 512).to_pylist(), min_length)[0])
        for segment in range(words // size):
            cut = slice(segment * size, (segment + 1) * size)
            word = np.flatnonzero(seen.once[cut])
            if len(word):
                yield _rows(segment, word, seen.once[cut][word], seen.twice[cut][word])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, _FILTERS)


def _met_filters(parts: DataFrame, words: int) -> DataFrame:
    """The joint filters: every task holds the segments dealt to it, whose size is bounded, and streams the rows through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, SeenTwice] = {}
        for batch in batches:
            for segment, *lists in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in (1, 2, 3)]):
                word, once, twice = (x.values.to_numpy() for x in lists)
                held.setdefault(segment, SeenTwice(min(words, SEGMENT))).meet(word, once.view(np.uint64), twice.view(np.uint64))
        for segment, seen in held.items():
            word = np.flatnonzero(seen.twice)
            if len(word):
                yield _rows(segment, word, seen.once[word], seen.twice[word])

    slots = min(task_slots(parts.sparkSession), max(1, words // SEGMENT))
    return parts.repartition(slots, "segment").mapInArrow(run, _FILTERS)


def twice_filter(docs: DataFrame, min_length: int = MIN_LENGTH) -> np.ndarray:
    """The joint filter of keys that two documents or more hold (others by chance); at most ``MAX_WORDS`` words."""
    breaks = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    lines = docs.agg(F.sum(breaks)).first()[0] or 0
    words = min(MAX_WORDS, 1 << max(0, (lines * KEY_BITS // 64).bit_length()))
    met = _met_filters(_task_filters(docs, words, min_length), words).select("segment", "word", "twice").toArrow()
    out = np.zeros(words, np.uint64)
    for segment, word, twice in zip(met["segment"].to_pylist(), met["word"], met["twice"]):
        out[segment * SEGMENT + word.values.to_numpy()] = twice.values.to_numpy().view(np.uint64)
    return out


def suspects(docs: DataFrame, twice: np.ndarray, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, text_key, k, c``: the digests of each row's keys that the filter knows."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def work():
        def each(batch: pa.RecordBatch):
            known = shared.value
            digest, owner = digests(batch.column(2).to_pylist(), min_length)
            word, bits = places(digest, len(known))
            hit = (known[word] & bits) == bits
            who, digest = pa.array(owner[hit]), digest[hit].view(np.int64)
            return [batch.column(0).take(who), batch.column(1).take(who), pa.array(digest[:, 0]), pa.array(digest[:, 1])]

        return each

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", text_key().alias("text_key"), "text")
    return map_rows(rows, ["doc_id", "text_key", "text"], "doc_id bigint, text_key bigint, k bigint, c bigint", work)


def lost_keys(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text_key, lost``: the digests (32 bytes of hex) of the keys that a row loses."""
    found = written(suspects(docs, twice_filter(docs, min_length), min_length), "line-suspects")
    spread = found.groupBy("k", "c").agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
    # Written first, so that the join has a plain shuffle on either side and Spark can split a hot line.
    spread = written(spread.where(F.col("docs") >= min_docs).select("k", "c", "last"), "line-spread")
    gone = found.join(spread, ["k", "c"]).where("doc_id < last")
    lost = written(gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("k", "c")).alias("lost")), "line-lost")  # no longer than the text
    dropped(found, spread)
    return lost


def drop_repeated_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every row: its text without the lines whose key at least ``min_docs``
    documents hold, unless it is the document with the largest doc_id among them; n_lines counts before that."""
    rows = docs.select("doc_id", "text", text_key().alias("text_key"))
    rows = rows.join(lost_keys(docs, min_length, min_docs), ["doc_id", "text_key"], "left")

    def work():
        def each(batch: pa.RecordBatch):
            texts, before, less = [], [], []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2)):
                text = text or ""
                before.append(text.count("\n") + 1)
                if lost.is_valid:
                    k, c = (lost.values.field(i).to_numpy().view(np.uint64).tolist() for i in (0, 1))
                    gone = set(zip(k, c))
                    halves = [None if x is None else tuple(np.frombuffer(xxhash.xxh3_128_digest(x), "<u8").tolist()) for x in line_keys(text, min_length)]
                    text = "\n".join(line for line, h in zip(text.split("\n"), halves) if h not in gone)
                    less.append(sum(h in gone for h in halves))
                else:
                    less.append(0)
                texts.append(text)
            return [batch.column(0), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(less, pa.int64())]

        return each

    return map_rows(rows, ["doc_id", "text", "lost"], "doc_id bigint, text string, n_lines bigint, n_dropped bigint", work)
