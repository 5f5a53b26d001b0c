"""Long repeats by a sparse suffix array.

Of every ``SPREAD`` consecutive places of a text the suffix is retained whose
first ``PREFIX`` words have the smallest hash: a minimiser selected by content,
so equal passages retain the same suffixes. A window of 50 words always holds
one together with its prefix. The suffixes of all documents are sorted (by the
codes of their leading words, then by the hash of the whole prefix), each task
holds a range of that order and compares neighbours, and those that share their
prefix with a suffix of a different text go on. Around them matches are
extended left and right: every window of 50 words that contains the prefix is
compared with those of all other documents by a 96-bit hash.

Sorting by range splits a prefix that a third of all documents share over many
tasks; the first and last run of a range go on unseen, since their neighbours may lie
in the next one, and the extension decides.

Rows: NULL or empty texts have no words; documents with NULL doc_id have no
repeats and cause none; rows that share a doc_id never repeat one another; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.repeats import kept_digest, marks, per_document, repeated_starts, spans, text_classes
from donorlake.llm.text import WordHashes, dropped, map_rows, sliding_min, split_words, text_key, window_hashes, written

WINDOW = 50
PREFIX = 26
SPREAD = WINDOW - PREFIX + 1


def retained(docs: DataFrame) -> DataFrame:
    """``lead, prefix, text_key, pos`` of the retained suffixes: codes of the first four words, hash of the whole prefix."""

    def work():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch):
            out: list = [[], [], [], []]
            for k, text in enumerate(batch.column(1).to_pylist()):
                h = hashes(split_words(text))
                prefix = window_hashes(h, PREFIX)
                at = sliding_min(prefix, SPREAD)
                codes = (h >> np.uint64(49)) if len(h) else h
                lead = sum(codes[at + j] << np.uint64(15 * (3 - j)) for j in range(4)) if len(at) else np.empty(0, np.uint64)
                for column, x in zip(out, (lead.astype(np.int64), prefix[at].view(np.int64), np.full(len(at), k), at.astype(np.int32))):
                    column.append(x)
            lead, prefix, who, at = (np.concatenate(x) for x in out)
            return [pa.array(lead), pa.array(prefix), batch.column(0).take(pa.array(who)), pa.array(at)]

        return each

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(text_key().alias("text_key"), "text")
    return map_rows(rows, ["text_key", "text"], "lead bigint, prefix bigint, text_key bigint, pos int", work)


def with_like_neighbours(ordered: DataFrame) -> DataFrame:
    """``text_key, pos`` of the suffixes in runs of one prefix that hold different texts, or that touch a range's ends."""

    def run(batches):
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        prefix, text, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        mixed_run = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)
        mixed_run[0] = mixed_run[-1] = True
        keep = np.repeat(mixed_run, np.diff(np.append(first, len(prefix))))
        for at in range(0, len(prefix), 1 << 16):
            part = keep[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)][part]) for x in (text, pos)], names=["text_key", "pos"])

    return ordered.select("prefix", "text_key", "pos").mapInArrow(run, "text_key bigint, pos int")


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, whole, starts`` of the documents with windows that repeat smaller ones."""
    classes = written(text_classes(docs), "text-classes")
    suffixes = written(retained(docs), "suffixes")
    order = ["lead", "prefix", "text_key", "pos"]
    places = written(with_like_neighbours(suffixes.repartitionByRange(*order).sortWithinPartitions(*order)), "suffix-places")
    dropped(suffixes)
    found = repeated_starts(docs, classes, places, WINDOW, SPREAD - 1, 0)
    dropped(places)
    return marks(classes, found)


def long_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_repeated, spans, kept_sha256``: words in passages of 50 and more that a smaller document has too.

    Spans are ``start:end`` in words, end exclusive, comma-joined; kept words are joined by one space for the digest.
    """
    return per_document(
        docs, repeated(docs), WINDOW, "n_words bigint, n_repeated bigint, spans string, kept_sha256 string",
        lambda words, mask: (len(words), int(mask.sum()), ",".join(f"{a}:{b}" for a, b in spans(mask)), kept_digest(words, mask)),
    )
