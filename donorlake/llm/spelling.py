"""Spelling variants of words: PartEnum signatures of letter multisets, equi-joined and verified.

The letters of a word are a binary vector with a dimension for every half of the
word, letter and number of occurrence (``ban|ana``: a1 b1 n1 | a1 a2 n1). A replaced
letter moves two dimensions of one half, an inserted or deleted one moves one; the
other half, a partition of the first level, stays equal. The dimensions of a half
are dealt into ``parts`` of the second level: vectors that differ in at most two are
equal outside some two parts, those that differ in one outside some one. So words of
one length meet at the signatures of all choices of a half and two of its parts left
out, words whose lengths differ by one at those of one part left out, and no pair is
missed. Every meeting is verified by the edit distance.

Letters are dealt by their frequency, so that all parts tell words apart, and
more words get more parts, which keeps meetings by chance rare. A word's form is
its most frequent near word if that is ten times as frequent; counts grow tenfold
along forms, so roots follow from a few rounds of doubling.

Rows: NULL and empty texts have no words; repeated rows count again; texts of rows
without doc_id count unchanged; ties go to the smaller word in code-point order; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.text import dropped, map_rows, mixed, written

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
ONE_IN = 31  # runs of a document that lose a code point
_TABLE_WORDS = 300_000  # words a task counts before it hands them on


def _runs(text: str | None, doc_id: int | None, longer: re.Pattern, min_length: int) -> Iterator[tuple[str, int]]:
    """The words of a document with their counts: its runs in lower case, one in ``ONE_IN`` without one code point."""
    joined = "\n".join(longer.findall(text or "")).encode().lower()
    if not joined:
        return
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(joined.split(b"\n")).items():
        word = run.decode()
        if start is not None and (h := zlib.crc32(run, start)) % ONE_IN == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < min_length:
                continue
        yield word, n


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words of at least ``min_length`` code points and ``min_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")

        def rows(counts: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        counts: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in _runs(text.as_py(), doc_id, longer, min_length):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > _TABLE_WORDS:
                    yield rows(counts)
                    counts = {}
        if counts:
            yield rows(counts)

    partial = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_ranks(words: DataFrame) -> dict[int, int]:
    """Letters by falling frequency. The alphabet of the words has 90 letters at most."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    rows = sorted(letters.collect(), key=lambda r: (-r["count"], r["letter"]))
    return {ord(r["letter"]): i for i, r in enumerate(rows) if r["letter"]}


def part_hashes(words: list[str], ranks: dict[int, int], parts: int) -> np.ndarray:
    """Per word and part, the hash of the word's dimensions in that part (a sum, so of a set)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(code))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))  # earlier occurrences of the letter in its word
    rank = np.zeros(256, np.int64)
    rank[list(ranks)] = list(ranks.values())
    part = (rank[code] + nth * (parts // 2)) % parts
    out = np.zeros((len(words), parts), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, (owner, part), mixed((code.astype(np.uint64) << np.uint64(32)) + nth.astype(np.uint64) + np.uint64(1)))
    return out


def choices(parts: int, left_out: int) -> list[tuple[int, ...]]:
    """All choices of one or two parts to leave out."""
    return [(i,) for i in range(parts)] if left_out == 1 else [(i, j) for i in range(parts) for j in range(i)]


def halves(word: str, longer: int) -> list[tuple[str, str]]:
    """The word as (equal half, changed half), once for each half that may have changed.

    A word that has one letter more than its partner (``longer`` 1) is cut where the partner is: before the extra letter
    if that lies in the second half, after it if it lies in the first.
    """
    cut = (len(word) - longer) // 2
    return [(word[:cut], word[cut:]), (word[cut + longer :], word[: cut + longer])]


def signatures(words: DataFrame, ranks: dict[int, int], parts: int, left_out: int, longer: int = 0) -> DataFrame:
    """``sig, word``: for either half and every choice of ``left_out`` parts, one signature of the other half's letters, of what
    this half has in the other parts, and of the word's length less ``longer``."""
    chosen = choices(parts, left_out)

    def work():
        def each(batch: pa.RecordBatch):
            texts = batch.column(0).to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts)) - longer
            cut, sigs = [halves(w, longer) for w in texts], []
            for side in (0, 1):
                same = part_hashes([c[side][0] for c in cut], ranks, parts).sum(axis=1)
                hashes = part_hashes([c[side][1] for c in cut], ranks, parts)
                with np.errstate(over="ignore"):
                    total = hashes.sum(axis=1) + mixed(same + mixed(size.astype(np.uint64) * np.uint64(2) + np.uint64(side)))
                    sigs += [mixed(total - hashes[:, list(out)].sum(axis=1)) + np.uint64(k) for k, out in enumerate(chosen)]
            word = batch.column(0).take(pa.array(np.tile(np.arange(len(texts)), len(sigs))))
            return [pa.array(np.concatenate(sigs).view(np.int64)), word]

        return each

    return map_rows(words, ["word"], "sig bigint, word string", work, step=4096)


def parts_for(words: int) -> int:
    """More words are told apart by more parts: 4 up to a million, then one more for every fourfold."""
    return 4 + max(0, math.ceil(math.log(max(1, words) / 1e6, 4)))


def near_words(words: DataFrame, parts: int | None = None) -> DataFrame:
    """``word, other``, both ways: pairs of the distinct ``words`` that one inserted, deleted or replaced code point tells apart."""
    parts, ranks = parts or parts_for(words.count()), letter_ranks(words)
    pair = lambda left, right: left.select("sig", F.col("word").alias("u")).join(right.select("sig", F.col("word").alias("v")), "sig")
    # Written first, so that the joins have plain shuffles and Spark can split a hot signature.
    same = written(signatures(words, ranks, parts, 2), "spelling-pairs")
    replaced = pair(same, same).where("u < v").where(F.levenshtein("u", "v", 1) == 1).select("u", "v")
    short, long = written(signatures(words, ranks, parts, 1), "spelling-short"), written(signatures(words, ranks, parts, 1, 1), "spelling-long")
    changed = pair(short, long).where(F.length("u") + 1 == F.length("v")).where(F.levenshtein("u", "v", 1) == 1).select("u", "v")
    found = written(replaced.unionByName(changed).distinct(), "spelling-near")
    dropped(same, short, long)
    return found.select(F.col("u").alias("word"), F.col("v").alias("other")).unionByName(found.select(F.col("v").alias("word"), F.col("u").alias("other")))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` of the words with a form: forms are followed by doubling, as often as counts up to ``most`` allow."""
    state = forms.select("word", F.col("form").alias("root"))
    steps = max(1, int(math.log(max(most, 1), RATIO)) + 1)  # forms in a row, at most
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = written(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return state


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, parts: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the documents."""
    words = written(word_counts(docs, min_length, min_count), "spelling-words")
    near = near_words(words.select("word"), parts)
    beside = near.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = beside.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    placed = words.join(best, "word", "left").withColumn("is_form", -F.col("best.m") >= RATIO * F.col("n"))
    placed = written(
        placed.select(
            "word", F.when(F.col("is_form"), F.col("best.other")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("is_form"), -F.col("best.m")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(placed.where("form IS NOT NULL"), words.agg(F.max("n")).first()[0] or 0)
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
