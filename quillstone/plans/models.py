"""Decisions, calibrations and estimates of small networks with weights by rule, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.functions.physics import P0
from quillstone.operators import models as O
from quillstone.plans import choosing, rules, values
from quillstone.plans.perception import m
from quillstone.plans.raster import d
from quillstone.sources import models as M

c = F.col
_flat = lambda rows, columns: [x for row in choosing._rule(rows, columns) for x in row]
#: A cloud escalation model over the builder's seven values, and a seam model over six.
ESCALATION = {"layers": [7, 4, 3], "weights": [_flat(4, 7), _flat(3, 4)], "biases": [[0.5, -0.25, 0.25, 0.0], [0.0, 0.25, -0.25]], "activations": ["relu", "softmax"]}
SEAMS = {"layers": [6, 3, 2], "weights": [_flat(3, 6), _flat(2, 3)], "biases": [[0.25, 0.5, -0.25], [0.0, 0.125]], "activations": ["relu", "softmax"]}
SEAM_NAMES = ("gap", "seam", "interior", "edge_step", "seam_max", "hot_rows")
GRAVITY = {"layers": [3, 1], "weights": [[0.0517, 0.0002, -0.0614]], "biases": [[0.0]], "activations": ["linear"], "offset": 9.7803, "target_scale": 1.0, "declared_max_abs": 0.0004}
PRESSURE = {"layers": [3, 1], "weights": [[-2.34, -0.6, 0.03]], "biases": [[0.0]], "activations": ["linear"], "log_target": True, "declared_max_abs_pa": 1500.0}
ESCALATION_NAMES = ["effort_score", "task_type", "local_fail_history", "criticality", "budget_remaining", "time_pressure", "local_model_quality"]


def _escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values.parts(spark, sf_dir).withColumn("v", values._BUILT["cloud_escalation"]())
    return rows.select("p_partkey", "yes", "also", O.V.ordered(c("v"), ESCALATION_NAMES).alias("x"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.classified(_escalation(spark, sf_dir), c("x"), ESCALATION, M.LABELS["cloud_escalation_predictor"], temperature=2.0)
    return found.select("p_partkey", F.coalesce("label", F.lit("")).alias("label"), fixed(c("confidence")).alias("confidence"), "abstained")


def seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda k: (c("p_partkey") * k % 101) / F.lit(100.0)
    rows = values.read(spark, sf_dir, "part").select("p_partkey", *[share(k).alias(n) for n, k in zip(SEAM_NAMES, (3, 7, 13, 29, 31, 37), strict=True)])
    found = O.beside_baseline(rows, O.checked(SEAM_NAMES), SEAMS, ("continuous", "mismatch"), O.seam_baseline(c("gap"), c("seam")))
    return found.select("p_partkey", F.coalesce("label", F.lit("")).alias("label"), fixed(c("confidence")).alias("confidence"), "baseline", "agrees")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of the escalation model, with labels that follow the greatest for two parts of three."""
    rows = O.with_logits(_escalation(spark, sf_dir), c("x"), ESCALATION)
    top = F.array_position("z", F.array_max("z")) - 1
    return rows.select("p_partkey", "z", F.when(c("p_partkey") % 3 == 0, c("p_partkey") % 9 / 3).otherwise(top).cast("int").alias("label"))


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature in thousandths and the losses in ten thousandths."""
    found = O.fit_temperature(_labelled(spark, sf_dir), 3)
    return spark.range(1).select(fixed(F.lit(found["temperature"]), 1e3).alias("temperature"), fixed(F.lit(found["before"]), 1e4).alias("before"), fixed(F.lit(found["after"]), 1e4).alias("after"))


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    calibration = {"fingerprint": M.fingerprint(ESCALATION), "classes": 3, "temperature": 1.75}
    p = O.calibrated(_escalation(spark, sf_dir), c("x"), ESCALATION, calibration)
    return p.select("p_partkey", *[fixed(c("probabilities")[i]).alias(f"p{i}") for i in range(3)])


def gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.estimate_gravity(rules.places(spark, sf_dir), "lat", "alt", GRAVITY)
    return found.select("p_partkey", "status", fixed(c("value")).alias("value"), fixed(c("reference")).alias("reference"), fixed(c("deviation")).alias("deviation"))


def pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.estimate_pressure(rules.places(spark, sf_dir), "alt", PRESSURE)
    return found.select("p_partkey", "status", fixed(c("value"), 1e3).alias("value"), fixed(c("reference"), 1e3).alias("reference"), fixed(c("deviation"), 1e3).alias("deviation"))


QUERIES = {"model_decided": decided, "model_seams": seams, "model_temperature": fitted, "model_calibrated": calibrated, "model_gravity": gravity, "model_pressure": pressure}

_SOFT = lambda zs, t: [f"exp({z} / {d(t)} - greatest({', '.join(zs)}) / {d(t)})" for z in zs]


def _layers(model: dict) -> list:
    """Layers of a model with the softmax left to the SQL."""
    return [(w, b, a if a != "softmax" else "linear") for w, b, a in M.layers(model)]


def _net(inputs: list[str], model: dict, source: str, keys: str) -> str:
    linear = [(w, b, "relu" if a == "relu" else None) for w, b, a in _layers(model)]
    parts, names = [], inputs
    for k, (weights, biases, act) in enumerate(linear):
        sums = [f"{d(float(b))} + " + " + ".join(f"{d(float(w))} * ({x})" for w, x in zip(row, names, strict=True)) for row, b in zip(weights, biases, strict=True)]
        out = [f"{'z' if k == len(linear) - 1 else f'h{k}_'}{i}" for i in range(len(sums))]
        held = [f"greatest({d(0.0)}, {x})" if act == "relu" else x for x in sums]
        parts.append(f"n{k} AS (SELECT {keys}, {', '.join(f'{x} AS {o}' for x, o in zip(held, out, strict=True))} FROM {source})")
        names, source = out, f"n{k}"
    return ", ".join(parts)


def _shares(zs: list[str], t: float, source: str) -> str:
    e = _SOFT(zs, t)
    return f"e AS (SELECT *, {', '.join(f'{x} AS e{i}' for i, x in enumerate(e))} FROM {source}), s AS (SELECT *, [{', '.join(f'e{i} / ({" + ".join(f"e{j}" for j in range(len(zs)))})' for i in range(len(zs)))}] AS p FROM e)"


_ESC = f"{values._P}, x AS (SELECT p_partkey, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in values._SQL['cloud_escalation'].items())} FROM p), {_net(ESCALATION_NAMES, ESCALATION, 'x', 'p_partkey')}"
_Z = ["z0", "z1", "z2"]
_TOP = lambda labels: f"{list(labels)!r}[list_position(p, list_max(p))]"
_NLL = lambda t: f"ln(exp((z0 - mz) / {t}) + exp((z1 - mz) / {t}) + exp((z2 - mz) / {t})) - (CASE label WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END - mz) / {t}"
_LAB = f"{_ESC}, lb AS (SELECT z0, z1, z2, greatest(z0, z1, z2) AS mz, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 9 // 3 ELSE list_position([z0, z1, z2], greatest(z0, z1, z2)) - 1 END AS label FROM n1)"
_DEV = lambda v, r, most, scale: f"SELECT p_partkey, CASE WHEN abs(v - r) > {d(most)} THEN 'abstain' ELSE 'suggest' END AS status, CASE WHEN abs(v - r) <= {d(most)} THEN CAST(round_even(v * {d(scale)}, 0) AS BIGINT) END AS value, CAST(round_even(r * {d(scale)}, 0) AS BIGINT) AS reference, CAST(round_even(abs(v - r) * {d(scale)}, 0) AS BIGINT) AS deviation FROM (SELECT p_partkey, {v} AS v, {r} AS r FROM pl)"
_SIN, _N = "sin(radians(CAST(lat AS DOUBLE)))", f"(CAST(alt AS DOUBLE) / {d(20000.0)})"
_G, _Q = GRAVITY["weights"][0], PRESSURE["weights"][0]
ORACLES = {
    "model_decided": f"WITH {_ESC}, {_shares(_Z, 2.0, 'n1')} SELECT p_partkey, CASE WHEN list_max(p) < {d(0.45)} THEN '' ELSE {_TOP(M.LABELS['cloud_escalation_predictor'])} END AS label, {m('list_max(p)')} AS confidence, list_max(p) < {d(0.45)} AS abstained FROM s",
    "model_seams": f"WITH x AS (SELECT p_partkey, {', '.join(f'p_partkey * {k} % 101 / {d(100.0)} AS {n}' for n, k in zip(SEAM_NAMES, (3, 7, 13, 29, 31, 37), strict=True))} FROM part), {_net(list(SEAM_NAMES), SEAMS, 'x', 'p_partkey, gap, seam')}, {_shares(['z0', 'z1'], 1.0, 'n1')}, v AS (SELECT p_partkey, list_max(p) AS c, CASE WHEN list_max(p) >= {d(0.6)} THEN {_TOP(('continuous', 'mismatch'))} END AS label, CASE WHEN gap > {d(0.25)} AND seam > {d(0.04)} THEN 'mismatch' ELSE 'continuous' END AS baseline FROM s) SELECT p_partkey, coalesce(label, '') AS label, {m('c')} AS confidence, baseline, label = baseline AS agrees FROM v",
    "model_temperature": f"WITH {_LAB}, g1 AS (SELECT t.v / {d(100.0)} AS t, avg({_NLL(f'(t.v / {d(100.0)})')}) AS l FROM lb CROSS JOIN range(10, 1001) t(v) GROUP BY 1), b1 AS (SELECT arg_min(t, l) AS t FROM g1), g2 AS (SELECT least({d(10.0)}, greatest({d(0.1)}, b1.t + u.v / {d(50000.0)})) AS t, z0, z1, z2, mz, label FROM lb CROSS JOIN b1 CROSS JOIN range(-600, 601) u(v)), l2 AS (SELECT t, avg({_NLL('t')}) AS l FROM g2 GROUP BY t) SELECT CAST(round_even(arg_min(t, l) * 1000, 0) AS BIGINT) AS temperature, (SELECT CAST(round_even(avg({_NLL(d(1.0))}) * 1e4, 0) AS BIGINT) FROM lb) AS before, CAST(round_even(min(l) * 1e4, 0) AS BIGINT) AS after FROM l2",
    "model_calibrated": f"WITH {_ESC}, {_shares(_Z, 1.75, 'n1')} SELECT p_partkey, {', '.join(f'{m(f"p[{i + 1}]")} AS p{i}' for i in range(3))} FROM s",
    "model_gravity": f"WITH {rules._PL} " + _DEV(f"{d(GRAVITY['offset'])} + {d(_G[0])} * ({_SIN} * {_SIN}) + {d(_G[1])} * ({_SIN} * {_SIN} * {_SIN} * {_SIN}) + {d(_G[2])} * {_N}", rules._GRAV, GRAVITY["declared_max_abs"], 1e6),
    "model_pressure": f"WITH {rules._PL} " + _DEV(f"exp({d(_Q[0])} * {_N} + {d(_Q[1])} * ({_N} * {_N}) + {d(_Q[2])} * ({_N} * {_N} * {_N})) * {d(P0)}", rules._PRES, PRESSURE["declared_max_abs_pa"], 1e3),
}
