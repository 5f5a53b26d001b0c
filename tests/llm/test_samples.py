"""What the fits of the classifiers learn from: thresholds and bounds."""

import numpy as np

from donorlake.llm import secret_scan, toxicity


def test_threshold_finds_the_recall_asked_for():
    """A twentieth of the secrets look like fillers, so their probabilities are below 0.5."""
    rows, y = secret_scan.generated(3, 1200)
    y = y.astype(float)
    y[np.random.default_rng(1).choice(np.flatnonzero(y == 0), 30, replace=False)] = 1.0
    for recall in (0.99, 0.9, 0.5):
        net = secret_scan.train(rows, y, recall=recall, epochs=3)
        kept = np.random.default_rng(7).permutation(len(rows))[: len(rows) // 4]
        p = np.array([net.probability(rows[i]) for i in kept if y[i] == 1])
        assert np.mean(p >= net.threshold - 1e-9) >= recall
        assert np.mean(p > net.threshold + 1e-9) < recall  # and none larger does


def test_findings_are_chosen_by_hash(spark):
    """Contexts that start with a late byte, and fillers after many keys, stay in the sample."""
    key = lambda i: f"{i:024x}"
    rows = [(i, f"{'a' if i % 2 else 'z'} {'pad ' * 8}{key(i)}") for i in range(400)]
    rows.append((400, " ".join(key(i) for i in range(60)) + " " + " ".join(f"{'filler' * 4}{chr(97 + i)}" for i in range(20))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, y = secret_scan.labelled_findings(docs.where("doc_id < 400"), 1000, 50, 500, 100)
    assert len(found) == 100
    every, _ = secret_scan.labelled_findings(docs.where("doc_id < 400"), 1000, 50, 500, 1000)
    first = {tuple(r) for r in sorted(every, key=lambda r: r.tobytes())[:100]}
    assert len(every) == 400 and len(first & {tuple(r) for r in found}) < 60
    found, y = secret_scan.labelled_findings(docs.where("doc_id = 400"), 1000, 50, 500, 1000)
    assert len(found) == 50 and 0 < (y == 0).sum() < 20


def test_repeated_rows_dont_fill_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(7, "text 7")] * 500 + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(7, 1)] * 500, "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", 1000).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 15 and all(r["text"] in (f"text {r['doc_id']}", "other") for r in rows)
    assert len(toxicity.labelled_sample(docs, labels, "toxic", 10).collect()) == 10

    keys = [(i, f"password = {i:024x}") for i in range(30)]
    docs = spark.createDataFrame(keys + [keys[3]] * 500, "doc_id long, text string")
    found, y = secret_scan.labelled_findings(docs, 20, 50, 500, 10_000)
    assert len(found) == 40 and len({tuple(r) for r in found}) == 40  # two findings in each of 20 documents
