"""Search, conversations, classifiers and the pipeline."""

import os
import sys
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from donorlake.llm import bpe, quality, quotes, secret_scan, tiling, topk, toxicity
from donorlake.llm.queries import QUERIES, SQL, vocabulary_path

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
from compare import normal  # noqa: E402

from test_near_copies import brute_heads  # noqa: E402

SF = "/root/testdata/sf0.001"


def duck(**tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con


# --- search -----------------------------------------------------------------------


@pytest.mark.parametrize("lists,chunk", [(2, 2048), (3, 2), (1, 5)])
def test_top_k_equals_all_pairs(spark, lists, chunk):
    rng = np.random.default_rng(4)
    vecs = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.3, 8), 2)]) for i in range(0, 700, 2)]
    vecs += [(int(1000 + i), vecs[0][1]) for i in range(40)] + [(4001, None), (4002, [1.0, None] * 4), (4003, [float("nan")] * 8), (4100, [float("inf")] * 8)]
    vecs += [(5000, [0.5, -0.5]), (5001, []), vecs[3], (None, [1.0] * 8), (6001, [1e5] * 8), (6100, [2e5] * 8)]
    table = spark.createDataFrame([(i, v, 7) for i, v in vecs], "vec_id long, embedding array<float>, cid int").repartition(4)
    usable = {}
    for i, v in vecs:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable[i] = [int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v))
    want = []
    for q in (i for i in usable if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], usable[c])), c) for c in usable if c != q)
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:10])]
    ints = topk.integer_vectors(table)
    got = topk.top_k(ints, ints.where("vec_id % 100 = 0"), lists=lists, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_broadcasts_neither_vectors_nor_what_tasks_find(spark, monkeypatch):
    """Both look small to Spark at any size: vectors are packed in their file, a task's pairs are sized by its rows."""
    rng, plans, write = np.random.default_rng(5), [], topk.written
    table = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 1, 6)]) for i in range(300)], "vec_id long, embedding array<float>")
    ints = write(topk.integer_vectors(table), "test-vectors")
    monkeypatch.setattr(topk, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    assert topk.top_k(ints, ints.where("vec_id % 100 = 0")).count() == 30
    assert len(plans) == 4
    for plan in plans:
        lines = plan.splitlines()
        depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
        for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
            below = []
            for d, x in zip(depth[i + 1 :], lines[i + 1 :]):
                if d <= depth[i]:
                    break
                below.append(x)
            assert not any("MapInArrow" in x or " v#" in x or ",v#" in x or "[v#" in x for x in below), plan


def test_top_k_of_little(spark):
    few = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 2 << 20), (0, 2, 2, -(1 << 20))]
    assert topk.top_k(few.where("false"), few.where("false")).count() == 0


# --- conversations ----------------------------------------------------------------


def test_reply_order(spark):
    rows = [
        (1, 0, "user", "Where is the plan?\nIt should be in the folder.", 1), (1, 1, "assistant", "Here is the plan.", 1), (1, 2, "user", "Second topic: budget", 1),
        (1, 3, "assistant", "> Second topic:  BUDGET\nIt is fine.", 1), (1, 4, "user", "Ann wrote:\n> It should be in the folder.\nFound it.", 1),
        (1, 5, "assistant", ">> where is the plan?\n> Found it.\nGood.", 1), (1, 6, "user", "> never said before\nWhat?", 1),
        (2, 0, None, None, 1), (2, 0, None, None, 1), (None, 3, "user", "> a", 1), (3, None, "user", "no turn", 1), (3, 1, "user", "a", 1), (3, 1, "user", "b", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = {(r["conv_id"], r["turn"], r["content"]): r for r in quotes.reply_ordered(df).collect()}
    by_turn = {k[1]: v for k, v in got.items() if k[0] == 1}
    assert {t: r["parent_turn"] for t, r in by_turn.items()} == {0: None, 1: None, 2: None, 3: 2, 4: 0, 5: 4, 6: None}
    assert [t for t, _ in sorted(by_turn.items(), key=lambda x: x[1]["position"])] == [0, 4, 5, 1, 2, 3, 6]
    assert by_turn[4]["content"] == "Found it." and by_turn[5]["quote_level"] == 2 and by_turn[6]["content"] == "What?"
    assert got[2, 0, ""]["chat"] == "<|unknown|>\n" and len(got) == 12
    assert quotes.reply_ordered(df.where("false")).count() == 0
    want = duck(conversations=df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})).execute(SQL["op4_quotation_chat"]).df()
    assert normal(quotes.reply_ordered(df).toPandas()) == normal(want)


def test_messages_of_one_turn_have_links_of_their_own(spark):
    long = "word " * 200_000
    rows = [
        (1, 0, "user", "first thing"), (1, 0, "user", "other thing"), (1, 1, "user", "> first thing\nyes"), (1, 1, "assistant", "no quote here"),
        (1, 1, "bot", "> other thing\nmaybe"), (1, 2, "user", "> yes\nfine"), (1, 2, "user", "> no quote here\nwhat"), (2, 0, "user", long), (2, 1, "user", "> " + long + "\nshort"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["content"]: (r["parent_turn"], r["root_turn"]) for r in quotes.reply_ordered(df).collect()}
    assert got["no quote here"] == (None, 1) and got["yes"] == (0, 0) and got["maybe"] == (0, 0) and got["short"] == (0, 0)
    assert got["fine"] == (1, 0) and got["what"] == (1, 1)
    assert normal(quotes.reply_ordered(df).toPandas()) == normal(duck(conversations=df.toPandas()).execute(SQL["op4_quotation_chat"]).df())


def test_long_chains_of_replies(spark):
    rows = [(1, t, "user", (f"> line {t - 1}\n" if t else "") + f"line {t}") for t in range(70)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["root_turn"] for r in got} == {0} and {r["turn"]: r["parent_turn"] for r in got} == {t: t - 1 if t else None for t in range(70)}


# --- classifiers ------------------------------------------------------------------


def auc(score, label):
    rank, p = pd.Series(score).rank().to_numpy(), label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.fixture(scope="session")
def labelled(spark):
    path = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


@pytest.mark.parametrize("name,limit", [("toxic", 0.97), ("quality", 0.97)])
def test_held_out_accuracy(labelled, name, limit):
    docs, labels = labelled
    scored = toxicity.score(docs, toxicity.fit(docs, labels)) if name == "toxic" else quality.quality(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows["score"], rows[name].to_numpy()) >= limit
    assert (rows["predicted"] == rows[name]).mean() >= 0.95


@pytest.mark.parametrize("score", [lambda d, l: toxicity.score(d, toxicity.fit(d, l)), quality.quality])
def test_classifiers_on_hard_rows(spark, hard_docs, no_docs, plain, score):
    labels = spark.createDataFrame([(i, i % 2, i % 2, 3) for i in (1, 2, 4, 7, 8, 16, 100, 101, 102, 103)] + [(None, 1, 1, 3), (5, None, None, 3), (6, 7, 7, 3)], "doc_id long, quality int, toxic int, text int")
    rows = score(hard_docs, labels).collect()
    assert len(rows) == len(plain)
    for r in rows:
        assert 0.0 <= r["score"] <= 1.0 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert {r["score"] for r in score(hard_docs, labels.where("false")).collect()} == {0.5}
    assert score(no_docs, labels).count() == 0


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    model, hashes = toxicity.Ftrl(bits=16), toxicity.hashers()
    words = [f"w{i}".encode() for i in range(300)]
    docs = [([words[i] for i in rng.integers(0, 300, 30)], k % 4 == 0) for k in range(600)]
    idx = [toxicity.features(w + ([b"awful"] if bad else []), hashes, 16) for w, bad in docs]
    for i, (_, bad) in zip(idx, docs):
        model.learn(i, int(bad))
    kept, w = model.sparse()
    dense = np.zeros(1 << 16)
    dense[kept] = w
    assert len(kept) < 2000
    assert np.mean([(dense[i].sum() > 0) == bad for i, (_, bad) in list(zip(idx, docs))[300:]]) > 0.97


# --- pipeline ---------------------------------------------------------------------


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    left = docs.where(~docs["doc_id"].isin(*toxic)) if toxic else docs
    heads = brute_heads([(r["doc_id"], r["text"]) for r in left.collect()])
    left = left.where(left["doc_id"].isin(*{d for d, _ in heads}))
    leaked = {r["doc_id"] for r in tiling.decontaminate(left, bench).where("contaminated").collect()}
    left = left.where(~left["doc_id"].isin(*leaked)) if leaked else left
    net = secret_scan.fit(left)
    want = {d: secret_scan.redacted(texts[d], net) for d in (r["doc_id"] for r in left.select("doc_id").collect())}
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(out, vocabulary_path()).collect()} == want
    assert toxic and leaked and len(want) < len(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_every_operator_is_registered_once():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13
