"""Marginals against enumeration, features, and held-out accuracy."""

import itertools
import math
import zlib

import numpy as np

from quillstone.llm import quality as Q


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    per = np.array([1, 4, 2, 5])
    emit, link = rng.normal(size=per.sum()), rng.normal(size=(2, 2))
    good, pairs = Q.marginals(emit, link, per, want_pairs=True)
    at, want, links = 0, [], np.zeros((2, 2))
    for n in per:
        e = emit[at : at + n]
        total, own = 0.0, np.zeros(n)
        two = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            p = math.exp(sum(x * y for x, y in zip(e, path, strict=True)) + sum(link[a, b] for a, b in itertools.pairwise(path)))
            total += p
            own += p * np.array(path)
            for a, b in itertools.pairwise(path):
                two[a, b] += p
        want += (own / total).tolist()
        links += two / total
        at += n
    assert np.allclose(good, want) and np.allclose(pairs.sum(axis=0), links)
    assert np.allclose(Q.marginals(emit, link, per), want)


def test_features_see_neighbours():
    x, length, per = Q.features(["Good line here.\nBAD!! BAD!!\n", "", "one"])
    assert per.tolist() == [3, 1, 1] and length.tolist() == [15, 11, 0, 0, 3] and x.shape == (5, Q.WIDTH)
    upper, own = Q.OWN.index("upper"), len(Q.OWN)
    after = own + len(Q.SHARED) + 1 + Q.SHARED.index(upper)
    assert x[0, after] == x[1, upper] == 1 and x[4, after] == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality").collect()}
    rows = Q.op9(spark, path).collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    model = Q.fit(["A fine line of text.\nAnd one more of it."] * 5 + ["BAD!! BAD!! BAD!!"] * 5, [1] * 5 + [0] * 5)
    docs = spark.createDataFrame([(1, "A fine text.", "x", 1), (1, "A fine text.", "x", 1), (None, None, None, None), (3, "", "y", 2), (4, "line\n" * 20_000, None, 3), (5, "😀" * 1000, None, 1)], "doc_id long, text string, score string, predicted int")
    got = Q.score(docs, model)
    rows = got.collect()
    assert {"score_", "predicted_"} <= set(got.columns) and len(rows) == 6
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[None] == by[3] and all(0 <= s <= 1 for s in by.values())
    assert Q.score(docs.limit(0), model).count() == 0
    assert set(Q.fit([], []).score(["a", ""])) == {0.5} and Q.fit(["a"], [1]).score(["b"])[0] > 0.9
    whole = Q.Model(model.weights, model.link, model.scale).score(["x y z"] * 3 + ["BAD!!"])
    assert np.allclose(whole[0], model.score(["x y z"]))
