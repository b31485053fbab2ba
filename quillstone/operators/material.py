"""Field operators on pixel tables: normals, slopes, integration, curl, block means, photometric normals and occlusion."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.numeric import channel
from quillstone.operators.raster import KEYS, sizes

c = F.col
LIGHTS, FLAT = 4, (128, 128, 255)


def decode_normals(px: DataFrame, convention: str = "+y") -> DataFrame:
    """(image_id, y, x, nx, ny, nz) from 8-bit colours: x and y from red and green, z as what is left of a unit vector."""
    sign = 1.0 if convention == "+y" else -1.0
    nx = (F.lit(2.0) * c("r") - F.lit(255.0)) / F.lit(255.0)
    ny = F.lit(sign) * (F.lit(2.0) * c("g") - F.lit(255.0)) / F.lit(255.0)
    flat = px.select(*KEYS, nx.alias("nx"), ny.alias("ny"))
    rest = F.lit(1.0) - c("nx") * c("nx") - c("ny") * c("ny")
    return flat.withColumn("nz", F.sqrt(F.greatest(F.lit(0.0), rest)))


def slopes(normals: DataFrame, least: float = 0.0) -> DataFrame:
    """(image_id, y, x, sx, sy) where the normal faces the viewer by more than ``least``; other pixels are left out."""
    return normals.where(c("nz") > F.lit(float(least))).select(*KEYS, (-c("nx") / c("nz")).alias("sx"), (-c("ny") / c("nz")).alias("sy"))


def integrate(field: DataFrame) -> DataFrame:
    """(image_id, y, x, by_row, by_column, twice): running sums of sx along rows and of sy along columns, and their sum."""
    rows = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    columns = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    out = field.select(*KEYS, F.coalesce(F.sum("sx").over(rows), F.lit(0)).alias("by_row"), F.coalesce(F.sum("sy").over(columns), F.lit(0)).alias("by_column"))
    return out.withColumn("twice", c("by_row") + c("by_column"))


def curl(field: DataFrame) -> DataFrame:
    """(image_id, cells, curl_sum, worst): the absolute circulation around 2 x 2 cells of a whole-number slope field."""
    right = Window.partitionBy("image_id", "y").orderBy("x")
    down = Window.partitionBy("image_id", "x").orderBy("y")
    near = field.select(*KEYS, "sx", "sy", F.lead("sy").over(right).alias("sy_right"), F.lead("sx").over(down).alias("sx_down"))
    around = F.abs(c("sx") + c("sy_right") - c("sx_down") - c("sy"))
    return near.where("sy_right is not null and sx_down is not null").groupBy("image_id").agg(F.count("*").alias("cells"), F.sum(around).alias("curl_sum"), F.max(around).alias("worst"))


def block_means(px: DataFrame, factor: int = 2) -> DataFrame:
    """Sums of each channel over whole blocks, and the pixels in each: one step of a mip chain."""
    return px.groupBy("image_id", F.floor(c("y") / factor).cast("int").alias("y"), F.floor(c("x") / factor).cast("int").alias("x")).agg(*[F.sum(n).alias(n) for n in ("r", "g", "b")], F.count("*").alias("n"))


def photometric(captures: Sequence[DataFrame], inverse: Sequence[Sequence[float]]) -> DataFrame:
    """(image_id, y, x, gx, gy, gz) of three grey captures (image_id, y, x, v): albedo times normal, by the inverse of the lights' matrix."""
    both = captures[0].withColumnRenamed("v", "v0")
    for i, one in enumerate(captures[1:], 1):
        both = both.join(one.withColumnRenamed("v", f"v{i}"), list(KEYS))
    line = lambda row: F.lit(row[0]) * c("v0") + F.lit(row[1]) * c("v1") + F.lit(row[2]) * c("v2")
    return both.select(*KEYS, *[line(row).alias(n) for row, n in zip(inverse, ("gx", "gy", "gz"), strict=True)])


def occlusion(height: DataFrame, radius: int = 3, directions: Sequence[tuple[int, int]] = ((0, 1), (1, 0), (0, -1), (-1, 0))) -> DataFrame:
    """(image_id, y, x, open): one minus the mean sine of the horizon over the directions, from whole-number heights ``v``.

    A direction's horizon is the steepest rise within ``radius`` steps that stay inside the image; 0 where nothing rises.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("dir"), F.lit(k).alias("k"), F.lit(dy * k).alias("dy"), F.lit(dx * k).alias("dx")) for i, (dy, dx) in enumerate(directions) for k in range(1, radius + 1)])
    rays = height.select(*KEYS, c("v").alias("own"), F.explode(steps).alias("s"))
    rays = rays.select(*KEYS, "own", c("s.dir").alias("dir"), c("s.k").alias("k"), (c("y") + c("s.dy")).alias("sy"), (c("x") + c("s.dx")).alias("sx"))
    seen = rays.join(height.select("image_id", c("y").alias("sy"), c("x").alias("sx"), "v"), ["image_id", "sy", "sx"])
    rise = F.greatest(F.lit(0.0), F.max((c("v") - c("own")) / c("k")))
    horizon = seen.groupBy(*KEYS, "dir").agg(rise.alias("t"))
    sine = F.rint(c("t") / F.sqrt(F.lit(1.0) + c("t") * c("t")) * F.lit(1e6)).cast("long")
    found = horizon.groupBy(*KEYS).agg(F.sum(sine).alias("s"))
    return height.select(*KEYS).join(found, list(KEYS), "left").select(*KEYS, (F.lit(1_000_000).cast("long") - F.expr(f"coalesce(s, 0) div {len(directions)}")).alias("open"))


def height_range(height: DataFrame) -> DataFrame:
    """(image_id, low, top, pixels)."""
    return height.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("top"), F.count("*").alias("pixels"))


def quantize_height(height: DataFrame, bits: int = 4) -> DataFrame:
    """(image_id, y, x, q): heights as numbers of ``bits`` bits between the image's least and greatest; 0 in a flat image."""
    top = (1 << bits) - 1
    both = height.join(height_range(height), "image_id")
    span = c("top") - c("low")
    value = F.when(span > 0, F.rint((c("v") - c("low")) * F.lit(float(top)) / F.when(span > 0, span))).otherwise(F.lit(0.0))
    return both.select(*KEYS, value.cast("int").alias("q"))


def image_sizes(px: DataFrame) -> DataFrame:
    return sizes(px)


def tilt(normals: DataFrame, other: DataFrame) -> DataFrame:
    """(image_id, y, x, degrees): the angle between two normal fields."""
    both = normals.join(other.select(*KEYS, *[c(n).alias(f"o{n}") for n in ("nx", "ny", "nz")]), list(KEYS))
    dot = c("nx") * c("onx") + c("ny") * c("ony") + c("nz") * c("onz")
    return both.select(*KEYS, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))).alias("degrees"))


def luma_height(px: DataFrame) -> DataFrame:
    """(image_id, y, x, v): the scaled luma in whole hundreds, as a height."""
    v: Column = F.floor((2126 * c("r") + 7152 * c("g") + 722 * c("b")) / 100).cast("long")
    return px.select(*KEYS, v.alias("v"))


def encode_normals(normals: DataFrame, convention: str = "+y") -> DataFrame:
    """8-bit colours of (image_id, y, x, nx, ny, nz): directions from -1 to 1 as 0 to 255, without a transfer curve; unknown and zero vectors are flat."""
    if convention not in ("+y", "-y"):
        raise ValueError("a convention is +y or -y")
    length = F.sqrt(c("nx") * c("nx") + c("ny") * c("ny") + c("nz") * c("nz"))
    rows = normals.withColumn("__n", F.when(length > 1e-12, length))
    sign = {"nx": 1.0, "ny": 1.0 if convention == "+y" else -1.0, "nz": 1.0}
    value = lambda n: channel((F.lit(sign[n]) * c(n) / c("__n") + F.lit(1.0)) * F.lit(0.5) * F.lit(255.0))
    return rows.select(*KEYS, *[F.when(c("__n").isNull(), F.lit(flat)).otherwise(value(n)).alias(to) for n, to, flat in zip(sign, "rgb", FLAT, strict=True)])


def light_directions(count: int = 6) -> list[tuple[float, float, float]]:
    """Unit vectors around the upper hemisphere at heights of 35, 55 and 75 degrees in turn, to six places."""
    if isinstance(count, bool) or not isinstance(count, int) or count < LIGHTS:
        raise ValueError(f"at least {LIGHTS} lights are needed")
    out = []
    for i in range(count):
        up, around = math.radians(35 + 20 * (i % 3)), math.tau * i / count
        out.append(tuple(round(v, 6) for v in (math.cos(up) * math.cos(around), math.cos(up) * math.sin(around), math.sin(up))))
    return out


def checked_lights(lights: Sequence[Sequence[float]]) -> np.ndarray:
    """The lights as unit vectors; fewer than four, or one that has no direction, is a ValueError."""
    a = np.array([[float(v) for v in light] if len(light) == 3 else [math.nan] for light in lights if light is not None], dtype=object)
    if len(lights) < LIGHTS or a.shape != (len(lights), 3):
        raise ValueError(f"at least {LIGHTS} lights of three components are needed")
    a = a.astype(float)
    if not np.isfinite(a).all() or (np.linalg.norm(a, axis=1) <= 1e-9).any():
        raise ValueError("a light must be finite and not zero")
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def photometric_fit(captures: DataFrame, lights: Sequence[Sequence[float]], ambient: bool = True) -> DataFrame:
    """(image_id, y, x, nx, ny, nz, albedo, ambient, residual) of captures (image_id, y, x, v): the least-squares normal of one intensity from 0 to 1 for each light.

    The lights are the same for all pixels, so the fit is one constant matrix times v, with no shuffle. With ``ambient`` an unknown constant is fitted too. Lights
    that leave the fit open, and pixels without light, give null normals and a residual of 1; albedo is 1 at most. An intensity out of range stops the query.
    """
    a = checked_lights(lights)
    model = np.hstack([a, np.ones((len(a), 1))]) if ambient else a
    n = len(a)
    fine = (F.size("v") == n) & F.forall("v", lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    rows = captures.withColumn("v", F.when(fine, c("v")).otherwise(F.raise_error(F.lit(f"a pixel needs {n} intensities from 0 to 1")).cast("array<double>")))
    if np.linalg.matrix_rank(model) < model.shape[1]:
        nothing = [F.lit(None).cast("double").alias(k) for k in ("nx", "ny", "nz")]
        return rows.select(*KEYS, *nothing, F.when(F.size("v") == n, 0.0).alias("albedo"), F.lit(0.0).alias("ambient"), F.lit(1.0).alias("residual"))
    dot = lambda row, values: sum((F.lit(float(w)) * v for w, v in zip(row[1:], values[1:], strict=True)), F.lit(float(row[0])) * values[0])
    seen = [c("v")[i] for i in range(n)]
    rows = rows.withColumns({f"__g{i}": dot(row, seen) for i, row in enumerate(np.linalg.pinv(model))})
    length = F.sqrt(c("__g0") * c("__g0") + c("__g1") * c("__g1") + c("__g2") * c("__g2"))
    rows = rows.withColumn("__n", F.when(length > 1e-6, length))
    rows = rows.withColumns({k: c(f"__g{i}") / c("__n") for i, k in enumerate(("nx", "ny", "nz"))})
    known = c("__n").isNotNull()
    rows = rows.withColumn("albedo", F.when(known, F.least(c("__n"), F.lit(1.0))).otherwise(0.0)).withColumn("ambient", F.when(known, c("__g3")).otherwise(0.0) if ambient else F.lit(0.0))
    hold = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    off = [hold(c("albedo") * F.greatest(F.lit(0.0), dot(light, [c("nx"), c("ny"), c("nz")])) + c("ambient")) - v for light, v in zip(a, seen, strict=True)]
    squares = sum((o * o for o in off[1:]), off[0] * off[0])
    residual = F.when(known, F.least(F.lit(1.0), F.sqrt(squares / F.lit(float(n))))).otherwise(1.0)
    return rows.select(*KEYS, "nx", "ny", "nz", "albedo", "ambient", residual.alias("residual"))
