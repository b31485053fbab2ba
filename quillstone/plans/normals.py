"""Normals from many lights and their colours, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.operators import material as M
from quillstone.plans.raster import PX, ch, d, pixels

c = F.col
LIGHTS = M.light_directions(6)
MIX = [(3, 5, 7), (11, 2, 13), (1, 17, 5), (7, 7, 3), (19, 3, 2), (5, 11, 23)]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six intensities of each pixel by arithmetic on its channels; every 64th image is black."""
    px = pixels(spark, sf_dir)
    value = lambda m: F.when(c("image_id") % 64 == 2, 0.0).otherwise((c("r") * m[0] + c("g") * m[1] + c("b") * m[2]) % 256 / F.lit(255.0))
    return px.select("image_id", "y", "x", F.array(*map(value, MIX)).alias("v"))


def fitted(ambient: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = M.photometric_fit(captures(spark, sf_dir), LIGHTS, ambient)
        return found.select("image_id", "y", "x", *[fixed(c(n), 1e4).alias(n) for n in ("nx", "ny", "nz", "albedo", "ambient", "residual")])

    return run


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from channels less 128, unknown where red is 7 and zero in black."""
    px = pixels(spark, sf_dir)
    part = lambda n: F.when(c("r") != 7, (c(n) - 128) * (c("image_id") % 64 != 2).cast("int")).cast("double")
    return M.encode_normals(px.select("image_id", "y", "x", part("r").alias("nx"), part("g").alias("ny"), part("b").alias("nz")), "-y")


QUERIES = {"material_photometric_fit": fitted(True), "material_photometric_dark": fitted(False), "normal_encode": encoded}


def _fit_sql(ambient: bool) -> str:
    """By the normal equations: sums of products with each column of the model, times the inverse of the model's squares."""
    a = M.checked_lights(LIGHTS)
    model = np.hstack([a, np.ones((6, 1))]) if ambient else a
    inverse = np.linalg.inv(model.T @ model)
    seen = ", ".join(f"CASE WHEN image_id % 64 = 2 THEN 0 ELSE (r * {m[0]} + g * {m[1]} + b * {m[2]}) % 256 / {d(255.0)} END AS v{i}" for i, m in enumerate(MIX))
    sums = ", ".join(" + ".join(f"v{i} * {d(float(model[i, k]))}" for i in range(6)) + f" AS t{k}" for k in range(model.shape[1]))
    solved = ", ".join(" + ".join(f"t{k} * {d(float(inverse[j, k]))}" for k in range(model.shape[1])) + f" AS g{j}" for j in range(model.shape[1]))
    am = "coalesce(g3, 0)" if ambient else d(0.0)
    off = " + ".join(f"pow(greatest({d(0.0)}, least({d(1.0)}, al * greatest({d(0.0)}, nx * {d(float(x))} + ny * {d(float(y))} + nz * {d(float(z))}) + am)) - v{i}, 2)" for i, (x, y, z) in enumerate(a))
    w = lambda x: f"CAST(round_even(({x}) * {d(1e4)}, 0) AS BIGINT)"
    return f"""WITH {PX}, v AS (SELECT image_id, y, x, {seen} FROM px), t AS (SELECT *, {sums} FROM v), g AS (SELECT *, {solved} FROM t), n0 AS (SELECT *, CASE WHEN sqrt(g0 * g0 + g1 * g1 + g2 * g2) > {d(1e-6)} THEN sqrt(g0 * g0 + g1 * g1 + g2 * g2) END AS n FROM g),
 n1 AS (SELECT *, g0 / n AS nx, g1 / n AS ny, g2 / n AS nz, CASE WHEN n IS NULL THEN {d(0.0)} ELSE least(n, {d(1.0)}) END AS al, CASE WHEN n IS NULL THEN {d(0.0)} ELSE {am} END AS am FROM n0)
 SELECT image_id, y, x, {w('nx')} AS nx, {w('ny')} AS ny, {w('nz')} AS nz, {w('al')} AS albedo, {w('am')} AS ambient, {w(f'CASE WHEN n IS NULL THEN {d(1.0)} ELSE least({d(1.0)}, sqrt(({off}) / {d(6.0)})) END')} AS residual FROM n1"""


_DIR = lambda n, s: f"CASE WHEN n > 0 THEN {ch(f'({s}{n} / n + {d(1.0)}) * {d(0.5)} * {d(255.0)}')} ELSE {{}} END"
ORACLES = {
    "material_photometric_fit": _fit_sql(True),
    "material_photometric_dark": _fit_sql(False),
    "normal_encode": f"WITH {PX}, v AS (SELECT image_id, y, x, CASE WHEN r <> 7 AND image_id % 64 <> 2 THEN CAST(r - 128 AS DOUBLE) END AS u, CAST(g - 128 AS DOUBLE) AS v, CAST(b - 128 AS DOUBLE) AS w FROM px), n AS (SELECT *, sqrt(u * u + v * v + w * w) AS n FROM v) SELECT image_id, y, x, {_DIR('u', '').format(128)} AS r, {_DIR('v', '-').format(128)} AS g, {_DIR('w', '').format(255)} AS b FROM n",
}
