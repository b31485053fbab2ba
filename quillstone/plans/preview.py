"""Previews of oblong images, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.operators import preview as V
from quillstone.operators.editing import EditStack
from quillstone.plans.raster import PX, ch, d, oblong, three

c = F.col
SIDE = 7
STACK = EditStack().push("invert").push("tint", factors=[1.0, 0.5, 0.25])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 x 20 images; of every third only the first three columns, which need no preview."""
    return oblong(spark, sf_dir).where((c("image_id") % 3 > 0) | (c("x") < 3)).select("image_id", "y", "x", "r", "g", "b")


def _weights(px: DataFrame) -> DataFrame:
    return px.select("image_id", "y", "x", (c("x") * 500 + c("y") * 100).cast("long").alias("weight"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.report(images(spark, sf_dir), SIDE).withColumn("scale", fixed(c("scale")))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir)
    return V.reduced_mask(_weights(px), V.report(px, SIDE))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir)
    return V.preview(px, STACK, SIDE, {1: _weights(px)})


QUERIES = {"preview_sizes": sizes, "preview_reduced": lambda s, f: V.reduced(images(s, f), SIDE), "preview_mask": masks, "preview_stack": stack}

_IMAGES = f"{PX}, im AS (SELECT image_id, CAST((y * 10 + x) // 20 AS INT) AS y, CAST((y * 10 + x) % 20 AS INT) AS x, r, g, b FROM px WHERE image_id % 3 > 0 OR (y * 10 + x) % 20 < 3)"
_SIZES = f"""s0 AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM im GROUP BY 1), s1 AS (SELECT *, least({d(1.0)}, {d(float(SIDE))} / greatest(h, w)) AS scale FROM s0),
 sz AS (SELECT image_id, h, w, greatest(1, CAST(round_even(h * scale, 0) AS INT)) AS th, greatest(1, CAST(round_even(w * scale, 0) AS INT)) AS tw, scale, scale < 1 AS resampled FROM s1)"""
# cells from the side of the target, as ranges of source pixels
_CELLS = f"""cl AS (SELECT image_id, ty.v AS y, tx.v AS x, ty.v * h // th AS y0, greatest(ty.v * h // th + 1, (ty.v + 1) * h // th) AS y1, tx.v * w // tw AS x0, greatest(tx.v * w // tw + 1, (tx.v + 1) * w // tw) AS x1 FROM sz CROSS JOIN range({SIDE}) ty(v) CROSS JOIN range({SIDE}) tx(v) WHERE ty.v < th AND tx.v < tw),
 rd AS (SELECT cl.image_id, CAST(cl.y AS INT) AS y, CAST(cl.x AS INT) AS x, {three(lambda n: ch(f'CAST(sum({n}) AS DOUBLE) / count(*)'))}, CAST(round_even(CAST(sum(im.x * 500 + im.y * 100) AS DOUBLE) / count(*), 0) AS BIGINT) AS weight FROM cl JOIN im ON im.image_id = cl.image_id AND im.y >= y0 AND im.y < y1 AND im.x >= x0 AND im.x < x1 GROUP BY 1, 2, 3)"""
_FACTOR = {"r": 1.0, "g": 0.5, "b": 0.25}
_STEP = lambda n: f"CAST(round_even(255 - {n} + ({ch(f'(255 - {n}) * {d(_FACTOR[n])}')} - (255 - {n})) * weight / {d(10000.0)}, 0) AS INT)"
ORACLES = {
    "preview_sizes": f"WITH {_IMAGES}, {_SIZES} SELECT image_id, h, w, th, tw, CAST(round_even(scale * 1e6, 0) AS BIGINT) AS scale, resampled FROM sz",
    "preview_reduced": f"WITH {_IMAGES}, {_SIZES}, {_CELLS} SELECT image_id, y, x, r, g, b FROM rd",
    "preview_mask": f"WITH {_IMAGES}, {_SIZES}, {_CELLS} SELECT image_id, y, x, weight FROM rd",
    "preview_stack": f"WITH {_IMAGES}, {_SIZES}, {_CELLS} SELECT image_id, y, x, {three(_STEP)} FROM rd",
}
