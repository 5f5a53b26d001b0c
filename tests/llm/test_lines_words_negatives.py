"""Line dedup, spelling variants and hard negatives beside brute-force versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from donorlake.llm import hard_negatives, lines, spelling
from donorlake.llm.queries import SQL
from compare import normal

bag = lambda rows: Counter(tuple(r) for r in rows)
lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# --- lines ------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        gone = [d is not None and len(holders[key(x)]) >= 3 and d < max(holders[key(x)]) for x in all_lines]
        out.append((d, "\n".join(x for x, g in zip(all_lines, gone) if not g), len(all_lines), sum(gone)))
    return out


def line_rows(rng):
    stock = ["short", "x" * 19, "é" * 19, "é" * 20, "A line that Many documents hold", "  a line that many documents hold\t", "two holders only, no more", ""]
    stock += [f"boiler plate line number {k} of all" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(stock) if rng.random() < 0.6 else f"own line {i} {j} with words" for j in range(rng.randint(1, 12)))) for i in range(150)]
    rows += [(500, "two holders only, no more\nx"), (501, "two holders only, no more"), (501, "two holders only, no more"), (None, stock[4]), (600, "\r\n".join(stock) + "\n")]
    rows += [(601, "\n" * 50), (602, "\n".join(["a line that many documents hold"] * 3)), (700, "\n".join(f"long text line {k} {'y' * 30}" for k in range(20_000)))]
    return rows


def test_repeated_lines(spark, hard_docs, plain, no_docs):
    rows = plain + line_rows(random.Random(2))
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, k int, lost int").repartition(6)
    want = brute_lines(rows)
    assert bag(lines.drop_repeated_lines(docs).collect()) == bag(want)
    assert sum(w[3] for w in want) > 300
    assert lines.drop_repeated_lines(no_docs).count() == 0
    assert bag(lines.drop_repeated_lines(docs, 5, 2).collect()) != bag(want)


def test_full_filters_change_nothing(spark, monkeypatch):
    rows = line_rows(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lines, "MAX_WORDS", 2)
    assert len(lines.twice_filter(docs)) == 2
    assert bag(lines.drop_repeated_lines(docs).collect()) == bag(brute_lines(rows))


def test_second_filter_holds_repeats_and_little_else():
    rng = np.random.default_rng(1)
    all_keys = rng.integers(0, 2**64, (6000, 2), np.uint64)
    held = [all_keys[:2500], all_keys[2000:4000], all_keys[4000:]]  # 500 keys in the first two
    tasks = []
    for keys in held:
        tasks.append(lines.SeenTwice(2048))
        tasks[-1].add(keys[:700])
        tasks[-1].add(keys[700:])
    whole = lines.SeenTwice(2048)
    for t in tasks:
        at = np.flatnonzero(t.once)
        whole.meet(at, t.once[at], t.twice[at])
    word, bits = lines.places(all_keys, 2048)
    hit = (whole.twice[word] & bits) == bits
    assert hit[2000:2500].all() and hit.sum() < 900
    again = lines.SeenTwice(2048)
    again.add(np.concatenate([all_keys[:10], all_keys[:3]]))
    word, bits = lines.places(all_keys[:10], 2048)
    assert ((again.twice[word] & bits) == bits).tolist() == [True] * 3 + [False] * 7


# --- spelling ---------------------------------------------------------------------


def brute_near(words):
    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = defaultdict(set)
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    return near


def brute_variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = 1 if d is None else zlib.crc32(f"{d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = brute_near(sorted(n))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def word_rows(rng):
    base = ["".join(rng.choice("abcdeéñÿ") for _ in range(rng.randint(6, 10))) for _ in range(25)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaab", "anagram", "nagaram", "ABCDEFG", "abcdéfg"]

    def edit(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcÉ") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]])

    rows = []
    for i in range(120):
        words = []
        for w in base:
            words += [w.upper() if rng.random() < 0.1 else w] * rng.choice([0, 1, 3])
            if rng.random() < 0.2:
                words.append(edit(w))
            if rng.random() < 0.02:
                words.append(edit(edit(w)))
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows + [(None, "aaaaaaa anagram"), (None, None), (7, None), (8, ""), (9, "z" * 3000 + " " + "z" * 3000), (9, "z" * 2999 + " " + "z" * 2999)]


@pytest.mark.parametrize("parts", [None, 4, 9])
def test_variants(spark, plain, no_docs, parts):
    rows = word_rows(random.Random(4)) + (plain if parts is None else [])
    docs = spark.createDataFrame([(d, t, 3, "x") for d, t in rows], "doc_id long, text string, n int, word string").repartition(5)
    want = brute_variants(rows)
    assert bag(spelling.variants(docs, parts=parts).collect()) == bag(want)
    assert sum(w[1] is not None for w in want) > 20
    assert spelling.variants(no_docs).count() == 0


def test_chains_of_forms(spark):
    chain = {"abcdefghijk": 20_000, "abcdefghijl": 2_000, "abcdefghixl": 200, "abcdefgyixl": 20, "abcdefgyixz": 2}
    texts = [(None, " ".join([w] * n)) for w, n in chain.items()]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {r["root"] for r in got.values()} == {"abcdefghijk"} and got["abcdefgyixz"]["form"] == "abcdefgyixl"


def test_near_words_are_equal_outside_a_few_parts():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(7, 9))) for _ in range(1500)})
    ranks, found = {ord(c): i for i, c in enumerate("dbac")}, 0
    for parts in (3, 4, 7):
        for a, others in brute_near(words).items():
            for b in others:
                if len(a) > len(b):
                    continue
                cuts = [spelling.halves(a, 0), spelling.halves(b, len(b) - len(a))]
                apart = []
                for side in (0, 1):
                    same = [spelling.part_hashes([c[side][0]], ranks, parts) for c in cuts]
                    changed = [spelling.part_hashes([c[side][1]], ranks, parts) for c in cuts]
                    if (same[0] == same[1]).all():
                        apart.append((changed[0] != changed[1]).sum())
                assert min(apart) <= (2 if len(a) == len(b) else 1)
                found += 1
    assert found > 300


# --- hard negatives ---------------------------------------------------------------


def brute_negatives(rows, k=5, m=10):
    usable = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        r = ([int(np.floor(256 * float(np.float32(x)))) for x in v], label)
        usable[i] = min(usable.get(i, r), r)
    width = max(len(v) for v, _ in usable.values())
    vec = {i: np.array(v + [0] * (width - len(v)), object) for i, (v, _) in usable.items()}
    out = []
    for a in (i for i in usable if i % 100 == 0):
        scored = sorted((-int(vec[a] @ vec[c]), c) for c in usable if c != a)
        for s, p in [(s, c) for s, c in scored if usable[c][1] == usable[a][1]][:k]:
            band = [(t, c) for t, c in scored if usable[c][1] != usable[a][1] and 30 * -s <= 100 * -t <= 90 * -s][:m]
            out += [(a, p, r + 1, c, -s, -t) for r, (t, c) in enumerate(band)]
    return out


def vector_rows():
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (6, 8))
    vecs = []
    for i in range(0, 900, 3):
        v = centres[i % 6] + rng.normal(0, 0.3, 8)
        vecs.append((int(i), [float(x) for x in np.round(v, 2)], int(rng.integers(0, 4))))
    vecs += [(2000 + i, vecs[0][1], i % 2) for i in range(60)]  # one vector of many rows, an anchor among them
    vecs += [(4001, None, 1), (4002, [1.0, None] * 4, 1), (4100, [float("inf")] * 8, 1), (4200, [1.0] * 8, None), (None, [1.0] * 8, 1), (5000, [0.5, -0.5], 1)]
    vecs += [(5100, [], 2), (5200, [0.0] * 8, 3), vecs[3], (6, [9.0] * 8, 2), (7000, [1e5] * 8, 77), (7001, [3e4] * 8, 5), (7002, [-1.0] * 8, 77)]
    return vecs


@pytest.mark.parametrize("chunk,block", [(2048, 16_384), (2, 40)])
def test_hard_negatives(spark, chunk, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "STRIP", 16)
    monkeypatch.setattr(hard_negatives, "PER_CLUSTER", 2)
    rows = vector_rows()
    table = spark.createDataFrame([(i, v, c, 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, cid int").repartition(5)
    ints = hard_negatives.usable_rows(table, 256)
    got = hard_negatives.mine(ints, ints.where("vec_id % 100 = 0"), chunk=chunk)
    want = brute_negatives(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 200
    assert hard_negatives.mine(ints.where("false"), ints.where("false")).count() == 0


def test_lists_end_early_where_vectors_have_directions():
    """A member of a tight cluster meets few rows of a block before its end is certified."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (20, 16))
    rows = (256 * (centres[rng.integers(0, 20, 8000)] + rng.normal(0, 0.05, (8000, 16)))).astype(np.int64)
    queries = (256 * (centres[rng.integers(0, 20, 200)] + rng.normal(0, 0.05, (200, 16)))).astype(np.int64)
    asked = {
        "vectors": queries, "label": np.zeros(200, np.int64), "same": True, "clusters": hard_negatives.clusters(queries.astype(float), 10),
        "low": np.full((200, 1), hard_negatives.NONE), "high": np.full((200, 1), np.iinfo(np.int64).max),
    }
    lists = hard_negatives.SharedLists(asked, 5)
    scored = []
    take = lists._take
    lists._take = lambda members, r, *rest: (scored.append(len(members) * len(r)), take(members, r, *rest))
    lists.walk(rows, np.arange(8000), np.zeros(8000, np.int64))
    exact = np.sort(queries @ rows.T, axis=1)[:, :-6:-1]
    assert (lists.score[:, 0] == exact).all()
    assert sum(scored) < 0.35 * 200 * 8000


def test_sql_on_hard_rows(spark, hard_docs):
    frame = hard_docs.where("doc_id IS NOT NULL").select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    docs = spark.createDataFrame([(int(d), t if isinstance(t, str) else None) for d, t in zip(frame.doc_id, frame.text)], "doc_id long, text string")
    assert normal(spelling.variants(docs).toPandas()) == normal(con.execute(SQL["op12_spelling"]).df())
    kept = lines.drop_repeated_lines(docs).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) AS kept_sha256")
    assert normal(kept.toPandas()) == normal(con.execute(SQL["op13_lines"]).df())
