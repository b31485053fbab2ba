"""Training of small networks, one seed a task: sequential gradient steps on a bounded set of examples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def train(x: np.ndarray, y: np.ndarray, hidden: int, classes: int, seed: int, epochs: int = 60, rate: float = 0.1, patience: int = 10) -> tuple[list[np.ndarray], float]:
    """(weights, accuracy on the last fifth) of a network with one hidden layer; stops where that fifth no longer gains."""
    rng = np.random.default_rng(seed)
    cut = max(1, len(x) * 4 // 5)
    w1, b1 = rng.normal(size=(x.shape[1], hidden)) * (2 / x.shape[1]) ** 0.5, np.zeros(hidden)
    w2, b2 = rng.normal(size=(hidden, classes)) * (2 / hidden) ** 0.5, np.zeros(classes)

    def scores(v: np.ndarray) -> np.ndarray:
        return np.maximum(v @ w1 + b1, 0) @ w2 + b2

    best, kept, idle = -1.0, [], 0
    for _ in range(epochs):
        for i in rng.permutation(cut):
            h = np.maximum(x[i] @ w1 + b1, 0)
            z = h @ w2 + b2
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = (w2 @ p) * (h > 0)
            w2 -= rate * np.outer(h, p)
            b2 -= rate * p
            w1 -= rate * np.outer(x[i], back)
            b1 -= rate * back
        held = float((scores(x[cut:]).argmax(axis=1) == y[cut:]).mean()) if cut < len(x) else 1.0
        if held > best:
            best, kept, idle = held, [w1.copy(), b1.copy(), w2.copy(), b2.copy()], 0
        else:
            idle += 1
            if idle >= patience:
                break
    return kept, best


def by_seed(spark: SparkSession, x: np.ndarray, y: np.ndarray, hidden: int, classes: int, seeds: Sequence[int]) -> DataFrame:
    """(seed, parameters, accuracy): a network for each seed, trained in tasks of their own on the same examples."""
    shared = spark.sparkContext.broadcast((x, y))  # a bounded set of examples

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        weights, accuracy = train(*shared.value, hidden, classes, int(key[0]))
        return pd.DataFrame({"seed": [int(key[0])], "parameters": [sum(w.size for w in weights)], "accuracy": [accuracy]})

    return spark.createDataFrame([(int(s),) for s in seeds], "seed int").groupBy("seed").applyInPandas(one, "seed int, parameters int, accuracy double")
