"""Tables of physical cases that are no full grid: a value from the nearest cases, if these can rebuild each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
FEWEST, RADIUS, TOLERANCE, CAP = 3, 0.25, 0.002, 0.9


def _weighted(near: Column, skip: int = 0) -> Column:
    """The mean of the outputs of ``near`` from number ``skip`` on, by inverse squared distance."""
    weight = lambda z: F.lit(1.0) / (F.greatest(z["far"], F.lit(1e-6)) * F.greatest(z["far"], F.lit(1e-6)))
    rest = F.slice(near, skip + 1, 1 << 20)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v"))
    step = lambda s, z: F.struct((s["w"] + weight(z)).alias("w"), (s["v"] + weight(z) * z["output"]).alias("v"))
    return F.aggregate(rest, zero, step, lambda s: s["v"] / F.nullif(s["w"], F.lit(0.0)))


def inverse_distance(rows: DataFrame, inputs: Sequence[str], scales: Sequence[float], cases: Sequence[tuple[tuple[float, ...], float]], domain: Sequence[tuple[float, float]], k: int = 4) -> DataFrame:
    """``rows`` with status, reason, value, support, error and confidence, from the ``k`` cases nearest in scaled inputs.

    ``cases`` are (inputs, output), a table of the call; equally near ones go in its order. A row outside ``domain`` abstains with out_of_domain; fewer than
    three cases within a distance of 0.25 with insufficient_neighbor_support; and where the others are off the nearest case's output by
    more than 0.2 % with neighbors_inconsistent. error is that share, null where it was not worked out.
    """
    if len(inputs) != len(scales) or len(inputs) != len(domain) or any(len(x) != len(inputs) for x, _ in cases):
        raise ValueError("inputs, scales, domain and cases don't fit")
    if len(cases) < FEWEST:
        raise ValueError(f"at least {FEWEST} cases are needed")
    scaled = [c(n).cast("double") / F.lit(float(s)) for n, s in zip(inputs, scales, strict=True)]

    def far(case: tuple[float, ...]) -> Column:
        gaps = [x - F.lit(float(v) / float(s)) for x, v, s in zip(scaled, case, scales, strict=True)]
        return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))

    table = F.array(*[F.struct(far(x).alias("far"), F.lit(i).alias("i"), F.lit(float(y)).alias("output")) for i, (x, y) in enumerate(cases)])
    inside = F.lit(True)
    for n, (low, high) in zip(inputs, domain, strict=True):
        inside = inside & F.coalesce(c(n).cast("double").between(float(low), float(high)), F.lit(False))
    rows = rows.withColumn("__near", F.filter(F.slice(F.array_sort(table), 1, k), lambda z: z["far"] <= F.lit(RADIUS)))
    rows = rows.withColumn("__inside", inside).withColumn("__n", F.size("__near"))
    held = F.get("__near", F.lit(0))["output"]
    rows = rows.withColumn("__error", F.when(c("__inside") & (c("__n") >= FEWEST), F.abs(_weighted(c("__near"), 1) - held) / F.greatest(F.abs(held), F.lit(1e-12))))
    reason = F.when(~c("__inside"), "out_of_domain").when(c("__n") < FEWEST, "insufficient_neighbor_support").when(c("__error") > TOLERANCE, "neighbors_inconsistent").otherwise("")
    rows = rows.withColumn("reason", reason)
    ok = c("reason") == ""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(CAP), F.lit(1.0) - F.lit(100.0) * c("__error")))
    out = rows.withColumns({"status": F.when(ok, "suggest").otherwise("abstain"), "value": F.when(ok, _weighted(c("__near"))), "support": F.when(c("__inside"), c("__n")).otherwise(0), "error": c("__error"), "confidence": F.when(ok, sure).otherwise(F.lit(0.0))})
    return out.drop("__near", "__inside", "__n", "__error")
