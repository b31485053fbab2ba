"""Near vectors and top-k against brute force."""

import math

import numpy as np

from quillstone.llm import topk as K
from quillstone.llm import vectordup as V


def make(n=900, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n, 3):
        x[i + 1] = x[i] + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.3])
    x[: n // 6] = x[0] + rng.normal(size=(n // 6, d)) * 0.05  # a hot group
    return x


def truth(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def test_near_vectors_match_brute_force(spark):
    x = make()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = V.near_vectors(rows).toPandas().sort_values("vec_id")
    links, label = truth(x)
    assert got.n_links.sum() >= 0.99 * links.sum() and (got.n_links.to_numpy() <= links).all()
    assert (got.component_id.to_numpy() == label).mean() >= 0.99
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_small_blocks_count_every_link_once(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    monkeypatch.setattr(V, "AT_ONCE", 16)
    x = make(300, seed=2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = V.near_vectors(rows).toPandas().sort_values("vec_id")
    links, label = truth(x)
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == label).all()


def test_near_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], None), (3, None, None), (4, [], None), (5, [0.0, 0.0], None), (6, [math.nan, 1.0], None), (7, [math.inf, 1.0], None), (8, [None, 1.0], None), (9, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0], None), (10, [1e300, 1e-300], None), (11, [1e-300, 0.0], None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")
    got = V.near_vectors(docs).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (4, 1) and by[2] == (4, 1) and by[10] == (4, 1) and by[11] == (4, 1)
    assert all(by[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9)) and by[None] == (0, None)
    assert V.near_vectors(docs.limit(0)).count() == 0
    assert V.near_vectors(docs.where("vec_id = 3")).collect()[0]["kept"]


def test_recall_on_the_query(spark):
    path = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{path}/embeddings.parquet").toPandas().sort_values("vec_id")
    links, _ = truth(np.stack(table.embedding.to_numpy()).astype(np.float64))
    got = V.op6(spark, path).toPandas().sort_values("vec_id")
    assert got.n_links.sum() >= 0.95 * links.sum() and (got.n_links.to_numpy() <= links).all()


def test_all_lists_find_every_link(spark):
    x = make(600, seed=5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = V.near_vectors(rows, probes=None).toPandas().sort_values("vec_id")
    links, label = truth(x)
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == label).all()


def test_an_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    got = sorted(map(tuple, V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=None).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def brute(x, ids, queries, k):
    out = {}
    for i in queries:
        scores = x @ x[ids.index(i)]
        order = sorted((-int(s), v) for s, v in zip(scores, ids, strict=True) if v != i)[:k]
        out[i] = [(n + 1, v, -s) for n, (s, v) in enumerate(order)]
    return out


def test_top_k_matches_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 100)
    monkeypatch.setattr(K, "BLOCK", 7)
    monkeypatch.setattr(K, "LEAF", 8)
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, size=(700, 6))
    x[:200] = x[0]  # a hot group of equal vectors
    rows = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = K.quantised(rows, "vec_id", "embedding")
    got = K.top_k(v, v.where("id % 20 = 0"), 20).collect()
    want = brute(x, list(range(700)), range(0, 700, 20), 20)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert by == want


def test_top_k_query(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids = table.vec_id.tolist()
    x = np.floor(np.stack(table.embedding.to_numpy()).astype(np.float64) * 64).astype(int)
    want = brute(x, ids, [i for i in ids if i % 20 == 0], 20)
    got = K.op2(spark, small).collect()
    assert len(got) == sum(map(len, want.values()))
    assert all((r["rank"], r["vec_id"], r["score"]) in want[r["query_id"]] for r in got)


def test_top_k_odd_rows(spark):
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [math.nan, 0.0]), (5, [math.inf, 0.0]), (None, [1.0, 1.0]), (6, []), (7, [1e9, 0.0]), (40, [0.0, 0.0])]
    v = K.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(map(tuple, K.top_k(v, v.where("id % 20 = 0")).collect()))
    score, own, big = 64 * 32 + 32 * 32, 64 * 64 + 32 * 32, 64 * 10**9 * 64
    # the other row of the repeated id is a candidate of each
    assert got == sorted([(20, 1, 7, big)] * 2 + [(20, 2, 20, own)] * 2 + [(20, 3, 1, score)] * 2 + [(20, 4, 40, 0)] * 2 + [(40, 1, 1, 0), (40, 2, 7, 0), (40, 3, 20, 0), (40, 4, 20, 0)])
    assert K.top_k(v.limit(0), v.limit(0)).count() == 0 and K.top_k(v, v.limit(0)).count() == 0
    big = K.quantised(spark.createDataFrame([(20, [4e6] * 64), (1, [4e6] * 64)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert K.top_k(big, big).collect()[0]["score"] == (4 * 10**6 * 64) ** 2 * 64


def test_top_k_of_an_id_with_two_vectors(spark):
    rows = [(20, [1.0]), (20, [1.0]), (20, [2.0]), (1, [3.0])]
    v = K.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(map(tuple, K.top_k(v, v.where("id = 20")).collect()))
    one, two = 64 * 64, 2 * 64 * 64
    assert got == sorted([(20, 1, 1, 3 * one), (20, 2, 20, two), (20, 3, 20, one)] * 2 + [(20, 1, 1, 3 * two), (20, 2, 20, two), (20, 3, 20, two)])


def test_products_are_exact_at_any_size():
    q, x = np.array([[1 << 40, -(1 << 40), 3]]), np.array([[(1 << 30) + 1, 1 << 30, 5], [1 << 21, 7, 1]])
    assert K.products(q, x).tolist() == [[(1 << 40) + 15, (1 << 61) - 7 * (1 << 40) + 3]]
    import pytest

    with pytest.raises(OverflowError):
        K.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_top_k_sends_a_shard_once_for_many_blocks(spark, monkeypatch):
    import numpy as np

    from quillstone.llm import topk

    for name, n in (("SHARD", 40), ("BLOCK", 6), ("CHUNK", 2), ("LEAF", 8)):
        monkeypatch.setattr(topk, name, n)
    plans = []
    keep = topk.durable
    monkeypatch.setattr(topk, "durable", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name))
    x = np.random.default_rng(4).integers(-9, 10, (150, 5))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<long>")
    got = {}
    for r in topk.top_k(vectors, vectors.where("id % 2 = 0"), 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert {"top-first", "top-rest"} <= {n for n, _ in plans}
    assert not any("Join" in p for n, p in plans if n in ("top-first", "top-rest"))  # a join writes a shard beside each block, or broadcasts all
    for i in range(0, 150, 2):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(150) if j != i)[:4]
        assert [got[i][n] for n in range(1, 5)] == [(j, -s) for s, j in want]
