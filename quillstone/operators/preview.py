"""Previews: images and masks averaged down to a bounded side, and edit stacks replayed on them. Never an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.numeric import channel
from quillstone.operators.editing import EditStack
from quillstone.operators.features import blend
from quillstone.operators.raster import KEYS, RGB, sizes

c = F.col
LEAST_SIDE = 4


def report(px: DataFrame, most: int) -> DataFrame:
    """(image_id, h, w, th, tw, scale, resampled): sizes of images and of their previews of ``most`` pixels a side at most; smaller images stay."""
    if isinstance(most, bool) or not isinstance(most, int) or most < LEAST_SIDE:
        raise ValueError(f"a side must be a whole number of at least {LEAST_SIDE}")
    s = sizes(px).withColumn("scale", F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("h", "w")))
    side = lambda n: F.greatest(F.lit(1), F.rint(c(n) * c("scale")).cast("int"))
    return s.select("image_id", "h", "w", side("h").alias("th"), side("w").alias("tw"), "scale", (c("scale") < 1).alias("resampled"))


def _cells(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``rows`` with the place of the preview pixel that each falls into: cells share no pixel, so no join of pixels is needed."""
    cell = lambda at, size, target: F.expr(f"CAST(((CAST({at} AS BIGINT) + 1) * {target} - 1) div {size} AS INT)")
    both = rows.join(sized.select("image_id", "h", "w", "th", "tw"), "image_id")
    return both.withColumns({"y": cell("y", "h", "th"), "x": cell("x", "w", "tw")})


def reduced(px: DataFrame, most: int) -> DataFrame:
    """The preview of each image: means of whole-pixel cells, rounded half to even."""
    return _cells(px, report(px, most)).groupBy(*KEYS).agg(*[channel(F.sum(n) / F.count("*")).alias(n) for n in RGB])


def reduced_mask(weights: DataFrame, sized: DataFrame) -> DataFrame:
    """A mask (image_id, y, x, weight in ten-thousandths) at the preview sizes of ``report``; weights are means, rounded half to even."""
    mean: Column = F.rint(F.sum("weight") / F.count("*")).cast("long")
    return _cells(weights, sized).groupBy(*KEYS).agg(mean.alias("weight"))


def preview(px: DataFrame, stack: EditStack, most: int, masks: dict[int, DataFrame] | None = None) -> DataFrame:
    """The steps of a stack on the previews of images; ``masks`` (by number of the step, at the size of the images) hold a step to a part.

    A masked step must keep the size of the preview, since the mask was made for it.
    """
    sized, now = report(px, most), reduced(px, most)
    for i, (name, options) in enumerate(stack.steps):
        edited = EditStack([(name, options)]).apply(now)
        mask = (masks or {}).get(i)
        now = edited if mask is None else blend(now, edited, reduced_mask(mask, sized))
    return now
