"""Near copies of the pipeline's stage beside the Jaccard similarity of all pairs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake.llm import near_copies, simhash


def shingles(text):
    words = text.encode().lower().split() if text else []
    n = min(5, len(words))
    return frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute_heads(rows, percent=80):
    """Rows (doc_id, text) that stay, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 100 * len(a & b) >= percent * len(a | b) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, t) for i, (d, t) in enumerate(rows) if d is None or d == least[find(i)]), key=str)


def edited():
    """Texts of 30 to 300 words with 0 to 12 words changed, around a similarity of 0.8, and one large group of edits."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []

    def add(words):
        out.append((len(out), " ".join(words)))

    for k in range(40):
        base = [word() for _ in range(rng.randint(30, 300))]
        add(base)
        for changes in (1, 3, 6, 12):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = word().upper()
            add(copy)
    base = [word() for _ in range(120)]
    for k in range(80):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            copy[at] = word()
        add(copy)
    for k in range(60):  # a common passage alone makes no near copy
        add(base[:60] + [word() for _ in range(rng.randint(20, 60))])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("few", [near_copies.FEW_PAIRS, 10])
def test_stage_keeps_what_all_pairs_keep(spark, few, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(near_copies, "FEW_PAIRS", few)
    if few == 10:
        monkeypatch.setattr(near_copies, "PASS_BYTES", 1_000_000)
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == brute_heads(rows)
    assert len(brute_heads(rows)) < len(rows) - 60


def test_hard_rows(hard_docs, plain, no_docs):
    kept = near_copies.keep_first(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == brute_heads(plain)
    assert near_copies.keep_first(no_docs).count() == 0


def test_similar_sets_meet_in_a_band():
    rng = np.random.default_rng(0)
    met = {50: 0, 80: 0}
    for percent in met:
        for k in range(300):
            both = rng.integers(0, 2**63, percent * 2, np.uint64)
            own = rng.integers(0, 2**63, (2, 100 - percent), np.uint64)
            a, b = (np.unique(np.concatenate([both, x])) for x in own)  # 2 percent of 200 in common
            keys = [near_copies.band_keys(x) for x in (a, b)]
            apart = sum(int(x ^ y).bit_count() for x, y in zip(*[k[near_copies.BANDS :].tolist() for k in keys]))
            met[percent] += bool(len(np.intersect1d(*[k[: near_copies.BANDS] for k in keys]))) and apart <= near_copies.most_apart()
    assert met[80] == 300 and met[50] < 20
    assert len(near_copies.band_keys(np.empty(0, np.uint64))) == 0
    long = rng.integers(0, 2**63, 5000, np.uint64)
    assert (near_copies.band_keys(long) == near_copies.band_keys(rng.permutation(long))).all()


def test_stage_on_a_corpus(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == brute_heads(rows)


@pytest.mark.parametrize("keep_first", [simhash.keep_first, near_copies.keep_first])
def test_rows_of_one_doc_id_are_told_apart(spark, keep_first):
    a, b = "one two three four five six seven", "red green blue black white grey pink"
    docs = spark.createDataFrame([(2, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in keep_first(docs).collect()) == [(2, a), (5, b)]


def test_stage_goes_through_simhash_first(spark, monkeypatch):
    """Without any bands the stage still finds the near copies that SimHash groups, and no other documents."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(near_copies, "links", lambda docs, rows, shingle, percent, known=None: known)
    rows = edited()
    kept = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert {d for d, _ in brute_heads(rows)} <= {*kept}
    assert len(kept) < len(rows) - 10


@pytest.mark.parametrize("few", [near_copies.FEW_PAIRS, 10])
def test_all_pairs_of_a_first_look_are_checked(spark, few, monkeypatch):
    """Members of one group that are near each other, but not its smallest class, are found without any band."""
    bands, mixed, n = near_copies.band_keys, near_copies.mixed, near_copies.BANDS

    def lone(h):  # keys that no other set has, then the sketch
        own = mixed(np.frombuffer(hashlib.sha256(h.tobytes()).digest()[:8], np.uint64) + np.arange(n, dtype=np.uint64))
        return np.concatenate([own, bands(h)[n:]]) if len(h) else bands(h)

    monkeypatch.setattr(near_copies, "band_keys", lone)
    monkeypatch.setattr(near_copies, "FEW_PAIRS", few)
    rows = edited()
    one_group = lambda texts: texts.select("doc_id", F.lit(7).alias("component_id"))
    kept = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), also=one_group)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == brute_heads(rows)


def test_parity_sketches_lose_no_near_copy():
    rng = np.random.default_rng(1)
    for size in (30, 400, 513, 3000):
        for _ in range(50):
            both = rng.integers(0, 2**63, size, np.uint64)
            own = rng.integers(0, 2**63, (2, size // 8), np.uint64)
            a, b = (np.unique(np.concatenate([both, x[: size // 8 - k]])) for k, x in enumerate(own))
            level = max(near_copies._level(len(a)), near_copies._level(len(b)))
            x, y = (near_copies.parity(s).reshape(2, -1)[level - near_copies._level(len(s))] for s in (a, b))
            apart, most = sum(int(i ^ j).bit_count() for i, j in zip(x, y)), (len(a) + len(b)) / 9 / 2**level
            assert apart <= (most if level == 0 else most + 5 * most**0.5 + 5)


def test_variants_that_are_not_near_leave_few_pairs(spark, monkeypatch):
    """Texts with three words changed of one that isn't there: they share bands, but none is near another."""
    rng, seen, similar = random.Random(3), [], near_copies._similar
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(200):
        copy = list(base)
        for at in (10 + k % 20, 50 + k // 20, 90 + k % 20):
            copy[at] = word().upper() + str(k)
        rows.append((k, " ".join(copy)))
    assert len(brute_heads(rows)) > 150

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(near_copies, "_similar", counted)
    kept = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == brute_heads(rows)
    assert sum(seen) < 400


def test_groups_are_joined_to_classes_not_to_bands(spark, monkeypatch):
    rows = edited()
    classes, tables, written = len({shingles(t) for _, t in rows}), {}, near_copies.written

    def counted(df, name):
        out = written(df, name)
        tables[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 0 < tables["near-copy-met"] <= classes and 0 < tables["near-copy-apart"] <= classes
