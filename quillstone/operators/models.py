"""Decisions of small networks with abstention, calibrated probabilities, temperatures found by sections, and estimates beside a reference."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import physics
from quillstone.operators import network
from quillstone.operators import values as V
from quillstone.sources import models as M

c = F.col
#: Confidence below which a network's answer is no answer: of imported models, and of models with a deterministic baseline.
IMPORTED, NANO = 0.45, 0.6
HIGHEST = 20_000.0
SECTIONS, ROUNDS = 16, 16


def checked(names: Sequence[str]) -> Column:
    """Features in order as an array; one that is unknown, not finite or outside of 0 to 1 stops the query."""

    def one(n: str) -> Column:
        x = c(n).cast("double")
        return F.when(x.isNotNull() & (x >= 0) & (x <= 1), x).otherwise(F.raise_error(F.lit(f"feature {n} must be known and between 0 and 1")).cast("double"))

    return F.array(*map(one, names))


def classified(rows: DataFrame, inputs: Column, model: dict[str, Any], labels: Sequence[str], least: float = IMPORTED, temperature: float = 1.0) -> DataFrame:
    """``rows`` with probabilities (at ``temperature``), label (null below ``least``), confidence and abstained."""
    if not 0 <= least <= 1:
        raise ValueError("the least confidence must be between 0 and 1")
    if model["layers"][-1] != len(labels):
        raise ValueError("outputs and labels don't fit")
    out = network.layered(rows, inputs, M.layers(model), "probabilities")
    if temperature != 1.0:
        out = out.withColumn("probabilities", V.temperature(c("probabilities"), F.lit(float(temperature))))
    out = out.withColumn("__best", V.decided(c("probabilities"), list(labels)))
    low = c("__best.confidence") < least
    return out.withColumns({"label": F.when(~low, c("__best.label")), "confidence": c("__best.confidence"), "abstained": low}).drop("__best")


def beside_baseline(rows: DataFrame, inputs: Column, model: dict[str, Any], labels: Sequence[str], baseline: Column, least: float = NANO) -> DataFrame:
    """``classified`` with the verdict of a deterministic rule, and whether the two agree (null where the network abstains)."""
    return classified(rows, inputs, model, labels, least).withColumn("baseline", baseline).withColumn("agrees", F.when(~c("abstained"), c("label") == c("baseline")))


def seam_baseline(gap: Column, seam: Column) -> Column:
    """A mismatch where the gap over the wrap is both far above the inner steps and large enough to be seen."""
    return F.when((gap > 0.25) & (seam > 0.04), "mismatch").otherwise("continuous")


def with_logits(rows: DataFrame, inputs: Column, model: dict[str, Any], out: str = "z") -> DataFrame:
    """``rows`` with what goes into a model's softmax."""
    M.fingerprint(model)  # refuses other models
    found = M.layers(model)
    return network.layered(rows, inputs, [*found[:-1], (found[-1][0], found[-1][1], "linear")], out)


def _softmax(z: Column, t: Column) -> Column:
    powers = F.transform(z, lambda x: F.exp(x / t - F.array_max(z) / t))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def calibrated(rows: DataFrame, inputs: Column, model: dict[str, Any], calibration: dict[str, Any]) -> DataFrame:
    """``rows`` with probabilities at a calibration's temperature; one of another model is refused."""
    if calibration.get("fingerprint") != M.fingerprint(model) or calibration.get("classes") != model["layers"][-1]:
        raise ValueError("the calibration is of another model")
    t = float(calibration["temperature"])
    if not 0 < t < float("inf"):
        raise ValueError("a temperature must be positive")
    return with_logits(rows, inputs, model, "__z").withColumn("probabilities", _softmax(c("__z"), F.lit(t))).drop("__z")


def _losses(rows: DataFrame, temperatures: Sequence[float]) -> list[float]:
    """The mean negative log likelihood of (z, label) at each temperature: one pass over the rows for all."""
    def loss(t: float) -> Column:
        powers = F.aggregate(F.transform("z", lambda x: F.exp((x - F.array_max("z")) / F.lit(t))), F.lit(0.0), lambda a, x: a + x)
        return F.avg(F.ln(powers) - (F.get("z", c("label")) - F.array_max("z")) / F.lit(t))

    return list(rows.agg(*[loss(float(t)).alias(f"l{i}") for i, t in enumerate(temperatures)]).first())


def fit_temperature(rows: DataFrame, classes: int, low: float = 0.1, high: float = 10.0) -> dict[str, float]:
    """temperature, before and after (mean loss) of (z, label): the temperature from ``low`` to ``high`` with the least loss.

    The loss has one minimum along the logarithm of the temperature. Each round tries SECTIONS temperatures between the ends in one pass and keeps the
    sections beside the best, so ROUNDS passes leave a share of (2 / 17) ** 16 of the range. 1 and the ends count as well. A class without rows is an error.
    """
    if not 0 < low <= 1 <= high < float("inf"):
        raise ValueError("the ends must be positive and contain 1")
    rows = rows.select(F.transform("z", lambda x: x.cast("double")).alias("z"), c("label").cast("int").alias("label"))
    support = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(classes + 1).collect()}  # one row a class
    if set(support) != set(range(classes)):
        raise ValueError("every class must have rows, and no other label may occur")
    at = lambda a, b: [a * (b / a) ** ((i + 1) / (SECTIONS + 1)) for i in range(SECTIONS)]
    a, b = float(low), float(high)
    rows = rows.persist()  # read once for all passes
    try:
        for _ in range(ROUNDS):
            tried = [a, *at(a, b), b]
            best = min(range(len(tried)), key=_losses(rows, tried).__getitem__)
            a, b = tried[max(0, best - 1)], tried[min(len(tried) - 1, best + 1)]
            if b / a < 1 + 1e-9:
                break
        options = [1.0, float(low), float(high), (a * b) ** 0.5]
        losses = _losses(rows, options)
    finally:
        rows.unpersist()
    found = min(range(4), key=lambda i: (losses[i], abs(options[i] - 1)))
    return {"temperature": options[found], "before": losses[0], "after": losses[found]}


def _inside(altitude: Column) -> Column:
    h = altitude.cast("double")
    return F.when((h >= 0) & (h <= HIGHEST), h).otherwise(F.raise_error(F.lit(f"an altitude must be between 0 and {HIGHEST:g} m")).cast("double"))


def gravity_inputs(latitude_deg: Column, altitude_m: Column) -> Column:
    """Squared sine of the latitude, its square, and the altitude over 20 km."""
    s = F.sin(F.radians(latitude_deg.cast("double")))
    return F.array(s * s, s * s * s * s, _inside(altitude_m) / F.lit(HIGHEST))


def pressure_inputs(altitude_m: Column) -> Column:
    n = _inside(altitude_m) / F.lit(HIGHEST)
    return F.array(n, n * n, n * n * n)


def _estimate(rows: DataFrame, value: Column, reference: Column, most: float | None) -> DataFrame:
    out = rows.withColumns({"value": value, "reference": reference}).withColumn("deviation", F.abs(c("value") - c("reference")))
    far = c("deviation") > most if most is not None else F.lit(False)
    return out.withColumn("status", F.when(far, "abstain").otherwise("suggest")).withColumn("value", F.when(~far, c("value")))


def estimate_gravity(rows: DataFrame, latitude: str, altitude: str, model: dict[str, Any] | None) -> DataFrame:
    """``rows`` with value, reference, deviation and status: a network's gravity; without a model the reference is the value (baseline_only).

    The output times ``target_scale`` plus ``offset`` is the value; further than ``declared_max_abs`` from the reference it abstains.
    """
    reference = physics.gravity(c(latitude), c(altitude))
    if model is None:
        return _estimate(rows, reference, reference, None).withColumn("status", F.lit("baseline_only"))
    layers, scale, offset = M.layers(model), float(model.get("target_scale", 10.0)), float(model.get("offset", 0.0))
    weights, biases, activation = layers[-1]
    if activation == "linear":  # the sum starts from the offset, so that values halfway between two millionths fall as in the SQL
        layers = [*layers[:-1], ([[float(w) * scale for w in row] for row in weights], [offset + float(b) * scale for b in biases], activation)]
        scale, offset = 1.0, 0.0
    rows = network.layered(rows, gravity_inputs(c(latitude), c(altitude)), layers, "__o")
    value = c("__o")[0] if (scale, offset) == (1.0, 0.0) else F.lit(offset) + c("__o")[0] * F.lit(scale)
    return _estimate(rows, value, reference, model.get("declared_max_abs")).drop("__o")


def estimate_pressure(rows: DataFrame, altitude: str, model: dict[str, Any] | None) -> DataFrame:
    """As ``estimate_gravity``: the output times ``target_scale``, its exponential if ``log_target``, is a share of the pressure at sea level; the bound is ``declared_max_abs_pa``."""
    reference = physics.pressure(c(altitude))
    if model is None:
        return _estimate(rows, reference, reference, None).withColumn("status", F.lit("baseline_only"))
    rows = network.layered(rows, pressure_inputs(c(altitude)), M.layers(model), "__o")
    out = c("__o")[0] * F.lit(float(model.get("target_scale", 1.0)))
    share = F.exp(out) if model.get("log_target") else out
    return _estimate(rows, share * F.lit(physics.P0), reference, model.get("declared_max_abs_pa")).drop("__o")
