"""SimHash fingerprints and near-duplicate groups by anchor-point covering.

Anchors are the code words of a covering code. A 64-bit fingerprint is cut into
two halves: of two fingerprints that differ in at most 3 bits, one half differs
in at most 1. On the first 31 bits of a half the perfect Hamming code has a code
word within radius 1 of every value; so a fingerprint has one home anchor per
half, and a partner's copy is found there if every fingerprint is replicated to
all anchors within radius 1 + threshold 1 = 2: one or sixteen of them. Homes
and replicas meet at 2**27 anchors and are compared there.

Equal fingerprints are one class before anything is replicated, and one class
of equal texts is fingerprinted through its rows only once per row, so copies
never meet each other. Fingerprints that share the home anchor of one half and
are equal in the other half differ in at most 2 bits: they are linked to the
smallest of them only. The comparison leaves such pairs out, so a dense group
doesn't emit all its pairs. Components follow from the links in star rounds.

Rows: a NULL or empty text has no words and fingerprint zero, linked like any
other; a row with NULL doc_id gets a fingerprint and its class's component;
repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.components import components
from donorlake.llm.text import map_rows, text_key, written

THRESHOLD = 3
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # value by bit, lowest first
_CHUNK = 1 << 18  # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of all word shingles of the ASCII-lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    size = min(shingle, len(words))
    ends = (ends - 1)[size - 1 :].tolist()
    n, digest, counts = len(ends), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    place = np.arange(8, dtype=np.int64) * 256
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], dtype="<u8")
        cells = np.bincount((h.view(np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048).reshape(8, 256)
        counts += (cells @ _BYTE_BITS).ravel()
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_key, fp bigint`` (the 64 bits as a signed number) of every row."""

    def work():
        def each(batch: pa.RecordBatch):
            fps = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            return [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))]

        return each

    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    return map_rows(rows, ["doc_id", "text_key", "text"], "doc_id bigint, text_key bigint, fp bigint", work)


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for i in range(31):
        s ^= np.where((x >> i) & 1 == 1, i + 1, 0)
    return s


def home_anchor(half: np.ndarray) -> np.ndarray:
    """The Hamming code word within 1 bit of the lower 31 bits."""
    x = half & 0x7FFFFFFF
    s = _syndrome(x)
    return np.where(s > 0, x ^ (np.int64(1) << np.maximum(s - 1, 0)), x)


def anchors_near(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All code words within 2 bits of each value: (index of the value, anchor)."""
    x = half & 0x7FFFFFFF
    s = _syndrome(x)
    rows, out = [np.arange(len(x))], [home_anchor(half)]
    off = np.flatnonzero(s)
    for i in range(1, 32):
        j = i ^ s[off]
        ok = j > i  # two flipped bits i < j with i ^ j = s lead to a code word
        rows.append(off[ok])
        out.append(x[off[ok]] ^ (1 << (i - 1)) ^ (np.int64(1) << (j[ok] - 1)))
    return np.concatenate(rows), np.concatenate(out)


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u & np.uint64(0xFFFFFFFF)).astype(np.int64), (u >> np.uint64(32)).astype(np.int64)]


def _placed(classes: DataFrame, replicas: bool) -> DataFrame:
    """Fingerprint classes at their home anchors, or at all anchors within radius plus threshold: ``anchor, home, fp``."""

    def work():
        def each(batch: pa.RecordBatch):
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at, anchor, homes = [], [], []
            for side, half in enumerate(_halves(fp)):
                home = home_anchor(half)
                rows, found = anchors_near(half) if replicas else (np.arange(len(fp)), home)
                at.append(rows)
                anchor.append(found * 2 + side)
                homes.append(home[rows] * 2 + side)
            at = np.concatenate(at)
            return [pa.array(np.concatenate(anchor)), pa.array(np.concatenate(homes)), pa.array(fp[at])]

        return each

    return map_rows(classes, ["fp"], "anchor bigint, home bigint, fp bigint", work, step=10_000)


def links(classes: DataFrame) -> DataFrame:
    """``u, v`` of distinct fingerprints: all within 3 bits are connected by them."""
    homes = _placed(classes, False)
    other = F.when(F.col("anchor") % 2 == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    near = homes.withColumn("other", other)
    first = near.groupBy("anchor", "other").agg(F.min("fp").alias("u"))
    stars = near.join(first, ["anchor", "other"]).where("u <> fp").select("u", F.col("fp").alias("v"))
    a, b = homes.select("anchor", F.col("fp").alias("u")), _placed(classes, True).select("anchor", "home", F.col("fp").alias("v"))
    apart = F.col("u").bitwiseXOR(F.col("v"))
    other_apart = F.when(F.col("anchor") % 2 == 0, F.shiftrightunsigned(apart, 32)).otherwise(apart.bitwiseAND(0xFFFFFFFF))
    same = (F.col("home") == F.col("anchor")) & (other_apart == 0)  # the stars have them
    pairs = a.join(b, "anchor").where((F.col("u") < F.col("v")) & (F.bit_count(apart) <= THRESHOLD) & ~same).select("u", "v")
    return stars.unionByName(pairs)


def _grouped(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_key, fp, component_id`` of every row."""
    rows = written(fingerprints(docs, shingle), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes)).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = linked.join(lowest, "root").select("fp", "component_id")
    return rows.join(placed, "fp").select("doc_id", "text_key", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: component_id is the smallest doc_id reachable over links."""
    return _grouped(docs, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The document with the smallest doc_id of every group of near-copies, with all its columns and repeated rows.

    Rows without a doc_id are kept: nothing says which of them came first.
    """
    heads = _grouped(docs, shingle).where("doc_id = component_id").select("doc_id", F.col("text_key").alias("_text_key")).distinct()
    kept = docs.withColumn("_text_key", text_key()).join(heads, ["doc_id", "_text_key"], "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))
