"""Small dense networks compiled to column expressions, so that a forward pass stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rows of weights, biases, activation) of a layer.
Layer = tuple[Sequence[Sequence[float]], Sequence[float], str]


def _activate(values: list[Column], name: str) -> list[Column]:
    if name == "relu":
        return [F.greatest(F.lit(0), v) for v in values]
    if name == "sigmoid":
        return [F.lit(1.0) / (F.lit(1.0) + F.exp(-v)) for v in values]
    if name == "softmax":
        top = F.greatest(*values) if len(values) > 1 else values[0]
        parts = [F.exp(v - top) for v in values]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return [p / total for p in parts]
    if name == "linear":
        return values
    raise ValueError(f"unknown activation {name}")


def _sums(values: list[Column], weights: Sequence[Sequence[float]], biases: Sequence[float]) -> list[Column]:
    if any(len(row) != len(values) for row in weights) or len(weights) != len(biases):
        raise ValueError("a layer's weights don't fit its inputs or biases")
    sums = []
    for row, bias in zip(weights, biases, strict=True):
        total = F.lit(bias)
        for w, v in zip(row, values, strict=True):
            total = total + F.lit(w) * v
        sums.append(total)
    return sums


def forward(inputs: Column, layers: Sequence[Layer]) -> Column:
    """The outputs, as an array. Sums run from the bias over the inputs in order; whole weights and inputs stay whole numbers.

    One expression for all layers repeats each of them in the next; for more than a few units use ``layered``.
    """
    values = [F.get(inputs, F.lit(i)) for i in range(len(layers[0][0][0]))]
    for weights, biases, activation in layers:
        values = _activate(_sums(values, weights, biases), activation)
    return F.array(*values)


def layered(rows: DataFrame, inputs: Column, layers: Sequence[Layer], out: str) -> DataFrame:
    """``rows`` with the outputs as the array ``out``. Each layer's values are columns of their own, so none is worked out more than once."""
    width = len(layers[0][0][0])
    rows = rows.withColumns({f"__n0_{i}": F.get(inputs, F.lit(i)) for i in range(width)})
    made = [f"__n0_{i}" for i in range(width)]
    values = made
    for k, (weights, biases, activation) in enumerate(layers, 1):
        # sums first: an activation may need each of them several times
        rows = rows.withColumns({f"__s{k}_{i}": v for i, v in enumerate(_sums([F.col(v) for v in values], weights, biases))})
        found = _activate([F.col(f"__s{k}_{i}") for i in range(len(biases))], activation)
        rows = rows.withColumns({f"__n{k}_{i}": v for i, v in enumerate(found)})
        values = [f"__n{k}_{i}" for i in range(len(biases))]
        made += [f"__s{k}_{i}" for i in range(len(biases))] + values
    return rows.withColumn(out, F.array(*map(F.col, values))).drop(*made)


def parameters(layers: Sequence[Layer]) -> int:
    return sum(len(b) + sum(map(len, w)) for w, b, _ in layers)
