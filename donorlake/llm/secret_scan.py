"""Secret scans: fixed rules, and a character network over every other candidate in its context.

Rules find assignments, access keys and hexadecimal keys. Beyond them every
long run of key characters that mixes letters and digits is a candidate: a
convolutional network in numpy reads its characters with some context, takes
the largest answer of every filter over all positions (so a candidate of any
length is read whole), and gives a probability. It learns from labelled
findings: those of the rules in at most ``max_rows`` documents that have
candidates (the smallest hashes of doc_id; a documented bound) as secrets, long
runs without digits there as none, and generated ones of common formats. The fit
has three more bounds: at most ``per_document`` findings of a document and
``findings`` in all, both by the smallest hashes of finding, context and label, so
that no class of them drops out, and the first ``longest`` characters of each. A part
that is kept back calibrates the probabilities and sets the threshold: the
largest that still finds ``recall`` of its secrets. The network only adds
spans; those of the rules always stay.

Rows: NULL or empty texts have no spans; a NULL doc_id stays NULL; repeated
rows get repeated results; an empty table gives an empty result; other columns
are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import heapq
import re
import string
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlake.llm.text import Shared, hash_sample, map_rows, one_text, text_key, written
from donorlake.llm.toxicity import sigmoid

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so its least length can stand in the pattern
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ANY_CANDIDATE = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{6}|[A-Za-z0-9+/_=-]{20,}"
CONTEXT = 24  # characters on either side
MAX_ROWS = 3_000  # documents the network learns from
PER_DOCUMENT = 50  # findings of one of them, the smallest hashes
LONGEST = 500  # characters of a finding that are read; scans read candidates whole
FINDINGS = 12_000  # findings in all, the smallest hashes
_CLASS = {c: i + 1 for i, c in enumerate(string.printable)}
_SIZE = len(_CLASS) + 2  # 0 fills up, the last stands for all other characters
_WIDTH = 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the rules, sorted; per kind leftmost and without overlap."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def other_candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters with letters and digits that no span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        run = m.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not any(s < b and a < e for s, _, e in spans):
            out.append((a, b))
    return out


def codes(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of a candidate and its context; those inside it are a set of their own."""
    a, b = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    out = np.array([_CLASS.get(c, _SIZE - 1) for c in text[a:b]], np.int32)
    out[start - a : end - a] += _SIZE
    return np.concatenate([np.zeros(_WIDTH, np.int32), out, np.zeros(_WIDTH, np.int32)])


@dataclass
class CharacterNetwork:
    filters: np.ndarray  # width, class, filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0
    threshold: float = 0.5

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter over the positions of each row, and where it is."""
        n = x.shape[1] - _WIDTH + 1
        best, where = None, None
        for at in range(0, n, 2048):
            stop = min(n, at + 2048)
            answers = sum(self.filters[k][x[:, at + k : stop + k]] for k in range(_WIDTH)) + self.bias
            place = answers.argmax(axis=1)
            top = np.take_along_axis(answers, place[:, None, :], 1)[:, 0, :]
            if best is None:
                best, where = top, place
            else:
                best, where = np.maximum(best, top), np.where(top > best, place + at, where)
        return best, where

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(x)[0], 0.0) @ self.out + self.out_bias

    def probability(self, row: np.ndarray) -> float:
        return float(sigmoid(self.logits(row[None])[0] / self.temperature))


def _stacked(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def generated(seed: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Labelled candidates of common formats: keys of random characters, and identifiers, paths, dates and fillers."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(np.array(list(letters))[rng.integers(0, len(letters), k)])
    mixed_case, lower = string.ascii_letters + string.digits, string.ascii_lowercase
    word = lambda: pick(lower, rng.integers(3, 9))
    rows, y = [], []
    for i in range(n):
        around = " ".join(word() for _ in range(6))
        k = int(rng.integers(20, 48))
        if i % 2:
            value = [lambda: pick(mixed_case, k), lambda: pick(mixed_case + "+/", k) + "=", lambda: pick(["ghp_", "sk_live_", "xoxb-"], 1) + pick(mixed_case, k),
                     lambda: pick("0123456789ABCDEF", k), lambda: pick(mixed_case + "-_", k)][rng.integers(0, 5)]()
        else:
            value = [lambda: "-".join(word() for _ in range(4)) + f"-{rng.integers(0, 3000)}", lambda: "/".join(word() for _ in range(5)) + f"/{rng.integers(0, 99)}",
                     lambda: "_".join(word() for _ in range(4)) + f"_{rng.integers(0, 99)}", lambda: f"2024-{rng.integers(10, 13)}-{rng.integers(10, 29)}T10-20-30-{word()}",
                     lambda: pick(string.digits, k) + word(), lambda: "".join(word().title() for _ in range(4)) + f"{rng.integers(0, 99)}", lambda: "=" * k + f"{rng.integers(0, 9)}a"][rng.integers(0, 7)]()
        text = f"{around[: rng.integers(0, 30)]} {value} {around[-rng.integers(1, 30):]}"
        start = text.index(value)
        rows.append(codes(text, start, start + len(value)))
        y.append(i % 2)
    return rows, np.array(y)


def train(rows: list[np.ndarray], y: np.ndarray, recall: float = 0.99, filters: int = 24, epochs: int = 8, seed: int = 7) -> CharacterNetwork:
    """Adam in a fixed order; the kept-back quarter sets temperature and threshold."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept, learn = order[: len(rows) // 4], order[len(rows) // 4 :]
    net = CharacterNetwork(rng.normal(0, 0.1, (_WIDTH, 2 * _SIZE, filters)), np.zeros(filters), rng.normal(0, 0.3, filters), 0.0)
    params = [net.filters, net.bias, net.out, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        shuffled = rng.permutation(learn)
        for at in range(0, len(shuffled), 64):
            pick = shuffled[at : at + 64]
            x = _stacked([rows[i] for i in pick])
            best, where = net.pooled(x)
            g = (sigmoid(np.maximum(best, 0) @ net.out + params[3][0]) - y[pick]) / len(pick)
            back = np.outer(g, net.out) * (best > 0)
            grads = [np.zeros_like(net.filters), back.sum(axis=0), np.maximum(best, 0).T @ g, np.array([g.sum()])]
            for k in range(_WIDTH):
                np.add.at(grads[0][k], (np.take_along_axis(x, where + k, 1), np.arange(filters)[None, :]), back)
            step += 1
            for p, g_, m, v in zip(params, grads, first, second):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p -= 5e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.out_bias = float(params[3][0])
    logits, t = net.logits(_stacked([rows[i] for i in kept])), y[kept]
    grid = np.geomspace(0.25, 8.0, 41)
    net.temperature = float(grid[int(np.argmin([np.mean(np.logaddexp(0.0, logits / c) - t * logits / c) for c in grid]))])
    secrets = np.sort(sigmoid(logits[t == 1] / net.temperature))
    net.threshold = float(secrets[len(secrets) - int(np.ceil(recall * len(secrets) - 1e-9))]) if len(secrets) else 0.5
    return net


def _finding_hash(body: bytes, label: int) -> int:
    return xxhash.xxh3_64_intdigest(body, label) >> 1


def fit(
    docs: DataFrame, max_rows: int = MAX_ROWS, per_document: int = PER_DOCUMENT, longest: int = LONGEST, findings: int = FINDINGS
) -> CharacterNetwork:
    """The network, from the labelled findings of a bounded sample and as many generated ones as that bound."""
    rows, labels = labelled_findings(docs, max_rows, per_document, longest, findings)
    made, made_y = generated(11, max_rows)
    return train(rows + made, np.concatenate([labels, made_y]).astype(np.float64))


def labelled_findings(docs: DataFrame, max_rows: int, per_document: int, longest: int, findings: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes and labels of the findings the network learns from, in the order of their hashes."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", text_key().alias("text_key"))
    holders = written(rows.where(F.col("text").rlike(ANY_CANDIDATE)).select("doc_id", "text_key"), "candidate-holders")
    some = one_text(rows, hash_sample(holders, ["doc_id", "text_key"], max_rows), ["doc_id", "text_key"])

    def work():
        def each(batch: pa.RecordBatch):
            out = []
            for text in batch.column(0).to_pylist():
                found = [(a, b, 1) for a, _, b in base_spans(text)]
                found += [(*m.span(), 0) for m in CANDIDATE.finditer(text) if not any(c.isdigit() for c in m.group())]
                coded = ((codes(text, a, min(b, a + longest)).tobytes(), label) for a, b, label in found)
                out += heapq.nsmallest(per_document, ((_finding_hash(body, label), body, label) for body, label in coded))
            order, body, y = zip(*out) if out else ((), (), ())
            return [pa.array(order, pa.int64()), pa.array(body, pa.binary()), pa.array(y, pa.int32())]

        return each

    found = map_rows(some, ["text"], "hash bigint, body binary, y int", work).orderBy("hash", "body", "y").limit(findings).toArrow()
    return [np.frombuffer(body, np.int32) for body in found["body"].to_pylist()], found["y"].to_numpy()


def all_spans(text: str | None, net: CharacterNetwork) -> tuple[list, list]:
    """Spans of the rules, and those with the network's added."""
    base = base_spans(text) if text else []
    added = [(a, 3, b) for a, b in other_candidates(text, base) if net.probability(codes(text, a, b)) >= net.threshold] if text else []
    return base, sorted(base + added)


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: CharacterNetwork) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every whole text."""
    shared = Shared(docs.sparkSession, net)

    def work():
        def each(batch: pa.RecordBatch):
            counts, digest, listed = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, shared.value)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digest.append(sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(every))
            return [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest), pa.array(listed)]

        return each

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_rows(docs, ["doc_id", "text"], schema, work)


def redacted(text: str | None, net: CharacterNetwork, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones together, replaced by a mark."""
    spans = all_spans(text, net)[1]
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, _, end = spans[i]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: CharacterNetwork) -> DataFrame:
    """All rows and columns of ``docs`` with secrets replaced in ``text`` (and ``n_chars`` counted anew, where it is)."""
    shared = Shared(docs.sparkSession, net)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redacted(t, shared.value), na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
