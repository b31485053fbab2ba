"""Signatures, bands and classes against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import neardup as N


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def classes(texts):
    """(smallest key reachable by links) of (key, text) rows, by comparing all pairs."""
    sets = {k: np.unique(N.shingles(t)) for k, t in texts}
    label = {k: k for k in sets}
    keys = sorted(sets)
    changed = True
    near = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a]) and len(sets[b]) and (s := N.shared(sets[a], sets[b])) / (len(sets[a]) + len(sets[b]) - s) >= 0.8 - 1e-9]
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2**63, size=300).astype(np.uint64)
    a, b = pool[:200], pool[50:250]
    truth = 150 / 250
    marks = N.sign([a, b, pool[:3]], size=4000)
    assert abs((marks[0] == marks[1]).mean() - truth) < 0.03
    # weights count: a shingle that is repeated is kept more often
    heavy = np.concatenate([pool[:20], np.repeat(pool[0], 100)])
    share = (N.sign([heavy], size=4000)[0] == pool[0]).mean()
    assert abs(share - (1 + np.log(101)) / (20 + np.log(101))) < 0.03


def test_classes_match_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for group in range(25):
        base = words(rng, rng.randrange(60, 200))
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 50))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += ["a b c", "a b c", "A  b C", "one two three four five six", "one two three four five six seven"]
    rows = [*enumerate(texts)]
    rng.shuffle(rows)
    got = {r["node"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_query_on_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = N.op4(spark, small).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_odd_rows(spark):
    schema = "doc_id long, text string, node string, bands int, class_id int"
    long = " ".join(f"t{i}" for i in range(50_000))
    rows = [(7, "same text of a few words here", "x", 1, 2), (7, "same text of a few words here", "x", 1, 2), (3, "same text of a few words here", "y", 2, 3), (None, None, None, None, None), (None, None, None, None, None), (5, "", "z", 1, 1), (6, "", "z", 1, 1), (None, "another null key with words", None, None, None), (9, long, None, 1, 1), (10, long + " more", None, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = N.near_duplicates(docs).collect()
    by = {r["node"]: (r["class_id"], r["kept"]) for r in got}
    assert len(got) == len(rows) and by[7] == (3, False) and by[3] == (3, True) and by[5] == (5, True) and by[6] == (6, True) and by[10] == (9, False)
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 3, 5, 6, 9]
    assert N.near_duplicates(docs.limit(0)).count() == 0 and N.deduplicate(docs.limit(0)).count() == 0


def test_repeated_passages_hide_no_pair(spark):
    rng = random.Random(8)
    texts = []
    for pair in range(48):
        base = words(rng, 200)
        # the shingles stay nearly the same set, the counts do not
        part, times = ((40, 100), (100, 50), (100, 10))[pair % 3]
        texts += [" ".join(base), " ".join(base + base[:part] * times)]
    rows = [*enumerate(texts)]
    truth = classes(rows)
    assert all(truth[k] == k - k % 2 for k in truth)
    got = {r["node"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == truth


def edited(rng, base, most):
    w = list(base)
    for _ in range(rng.randrange(0, most + 1)):
        at = rng.randrange(len(w))
        if rng.random() < 0.3:
            del w[at]
        else:
            w[at] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def group(rng, n, most=9):
    """``n`` copies of one text with up to ``most`` edits; of some of the heavily edited ones there are copies with one edit more."""
    base = words(rng, 120)
    texts = [edited(rng, base, most) for _ in range(n - n // 10)]
    return texts + [edited(rng, rng.choice(texts).split(), 1) for _ in range(n // 10)]


def reach(rows):
    """As ``classes``, by numbers: for groups of a thousand."""
    sets = {k: set(N.shingles(t).tolist()) for k, t in rows}
    keys = sorted(sets)
    names = {h: i for i, h in enumerate({h for s in sets.values() for h in s})}
    x = np.zeros((len(keys), len(names)), dtype=np.float32)
    for i, k in enumerate(keys):
        x[i, [names[h] for h in sets[k]]] = 1
    both, n = x @ x.T, x.sum(axis=1)
    near = both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-6
    label = np.arange(len(keys))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(keys))])
        if (new == label).all():
            return {k: keys[label[i]] for i, k in enumerate(keys)}
        label = new


def made(spark, rows, monkeypatch):
    """Classes of ``rows`` and the rows of all tables that were written for them."""
    total = 0
    write = N.durable

    def counted(df, name):
        nonlocal total
        out = write(df, name)
        total += out.count()
        return out

    monkeypatch.setattr(N, "durable", counted)
    got = {r["node"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(N, "durable", write)
    return got, total


def test_large_groups_are_exact_and_linear(spark, monkeypatch):
    sizes = []
    for n in (300, 1200):
        rows = [*enumerate(group(random.Random(n), n))]
        got, total = made(spark, rows, monkeypatch)
        assert got == reach(rows)
        sizes.append(total)
    assert sizes[1] < 4 * 1.4 * sizes[0], sizes


def test_settling_finds_all_that_is_linked(spark):
    """Rows of three groups, by their edits alone, against all pairs."""
    rng = random.Random(12)
    rows, truth = [], set()
    for g in range(3):
        common = [rng.randrange(1 << 40) for _ in range(40)]
        sets = [set(rng.sample(common, rng.randrange(0, 24))) | {rng.randrange(1 << 40) for _ in range(rng.randrange(0, 6))} for _ in range(90)]
        rows += [(g, 1000 * g + i, 1000 * g + i, 90, 0, 0, sorted(s)) for i, s in enumerate(sets)]
        truth |= {(1000 * g + i, 1000 * g + j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 180 >= 9 * len(x ^ y)}
    for few in (24, 256):
        N.POSTED, before = few, N.POSTED
        try:
            found = N.settle(spark.createDataFrame(rows, "g long, node long, root long, n long, u long, marks long, edits array<long>")).collect()
        finally:
            N.POSTED = before
        found = {tuple(sorted(r)) for r in found}
        assert found <= truth and union(found) == union(truth)


def union(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label
