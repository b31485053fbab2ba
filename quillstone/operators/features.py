"""Folds of pixels and masks into features of an image, of a pair of frames or of a region; selections; sizes in words.

Features are kept as whole-number sums and counts, so that any engine adds them alike; ratios are left to the reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.numeric import luma_scaled
from quillstone.operators.raster import KEYS, neighbours, sizes

c = F.col


def anchor(mask: DataFrame) -> DataFrame:
    """(image_id, pixels, y0, x0, y1, x1, y_sum, x_sum, bottom, mirrored) of the set part: box, centroid sums, pixels in the box's lowest
    quarter, and pixels whose mirror image across the box's middle is set as well."""
    on = mask.where("m = 1").select(*KEYS)
    box = on.groupBy("image_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.count("*").alias("pixels"), F.sum("y").alias("y_sum"), F.sum("x").alias("x_sum"))
    inside = on.join(box, "image_id")
    twin = on.select("image_id", "y", c("x").alias("tx"))
    mirrored = inside.select("image_id", "y", (c("x0") + c("x1") - c("x")).alias("tx")).join(twin, ["image_id", "y", "tx"]).groupBy("image_id").agg(F.count("*").alias("mirrored"))
    low = inside.where((c("y") - c("y0") + 1) * 4 > 3 * (c("y1") - c("y0") + 1)).groupBy("image_id").agg(F.count("*").alias("bottom"))
    return box.join(low, "image_id", "left").join(mirrored, "image_id", "left").select("image_id", "pixels", "y0", "x0", "y1", "x1", "y_sum", "x_sum", F.coalesce("bottom", F.lit(0)).alias("bottom"), F.coalesce("mirrored", F.lit(0)).alias("mirrored"))


def loop(first: DataFrame, last: DataFrame) -> DataFrame:
    """(image_id, common, added, removed, dy, dx) of two masks of one image_id: pixels in common, new and gone, and centroid sums' difference."""
    a, b = first.select(*KEYS, c("m").alias("a")), last.select(*KEYS, c("m").alias("b"))
    j = a.join(b, list(KEYS), "full").select(*KEYS, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return j.groupBy("image_id").agg(
        F.count_if((c("a") == 1) & (c("b") == 1)).alias("common"), F.count_if((c("a") == 0) & (c("b") == 1)).alias("added"), F.count_if((c("a") == 1) & (c("b") == 0)).alias("removed"),
        F.sum(c("y") * (c("b") - c("a"))).alias("dy"), F.sum(c("x") * (c("b") - c("a"))).alias("dx"),
    )


def phase(features: DataFrame, hold: int = 30, impact: int = 300) -> DataFrame:
    """``loop`` features with change, in thousandths of the union, and a verdict: hold, build, recover or impact."""
    union = c("common") + c("added") + c("removed")
    change = F.when(union == 0, F.lit(0).cast("long")).otherwise(F.floor((c("added") + c("removed")) * 1000 / union).cast("long"))
    return features.withColumn("change", change).withColumn("verdict", F.when(c("change") <= hold, "hold").when(c("change") >= impact, "impact").when(c("added") >= c("removed"), "build").otherwise("recover"))


def mask_report(mask: DataFrame) -> DataFrame:
    """(image_id, pixels, set, on_border, edges, verdict): a cutout that is empty, full, or bleeds over the border is unsafe."""
    s = mask.join(sizes(mask), "image_id")
    border = (c("y") == 0) | (c("x") == 0) | (c("y") == c("h") - 1) | (c("x") == c("w") - 1)
    right = F.lead("m").over(Window.partitionBy("image_id", "y").orderBy("x"))
    below = F.lead("m").over(Window.partitionBy("image_id", "x").orderBy("y"))
    s = s.withColumns({"e": F.when(right != c("m"), 1).otherwise(0), "f": F.when(below != c("m"), 1).otherwise(0)})
    per = s.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum("m").alias("set"), F.count_if(border & (c("m") == 1)).alias("on_border"), F.sum(c("e") + c("f")).alias("edges"))
    verdict = F.when(c("set") == 0, "empty").when(c("set") * 100 > c("pixels") * 95, "full").when(c("on_border") * 2 > c("set"), "bleeds").otherwise("safe")
    return per.withColumn("verdict", verdict)


def region(px: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    """(image_id, pixels, luma_sum, colours, chroma_sum) of a half-open box of each image."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    inside = px.where((c("y") >= y0) & (c("y") < y1) & (c("x") >= x0) & (c("x") < x1))
    return inside.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum(luma_scaled(c("r"), c("g"), c("b")).cast("long")).alias("luma_sum"), F.countDistinct("r", "g", "b").alias("colours"), F.sum(top - low).alias("chroma_sum"))


def anomaly(px: DataFrame) -> DataFrame:
    """(image_id, pixels, r_sum, g_sum, b_sum, luma_sum, luma_squares, dark, border_sum, border, chroma_sum): one pass over an image."""
    s = px.join(sizes(px), "image_id").withColumn("l", luma_scaled(c("r"), c("g"), c("b")).cast("long"))
    edge = (c("y") == 0) | (c("x") == 0) | (c("y") == c("h") - 1) | (c("x") == c("w") - 1)
    return s.groupBy("image_id").agg(
        F.count("*").alias("pixels"), F.sum("r").alias("r_sum"), F.sum("g").alias("g_sum"), F.sum("b").alias("b_sum"), F.sum("l").alias("luma_sum"), F.sum(F.expr("l div 100") * F.expr("l div 100")).alias("luma_squares"), F.count_if(c("l") < 640_000).alias("dark"),
        F.sum(F.when(edge, c("l"))).alias("border_sum"), F.count_if(edge).alias("border"), F.sum(F.greatest("r", "g", "b") - F.least("r", "g", "b")).alias("chroma_sum"),
    )


def histogram_peaks(px: DataFrame, bins: int = 16) -> DataFrame:
    """(image_id, peaks, filled): bins of the luma that are higher than both neighbours, and bins that aren't empty."""
    level = F.least(F.lit(bins - 1), F.floor(luma_scaled(c("r"), c("g"), c("b")) * bins / 2_560_000)).cast("int")
    counts = px.groupBy("image_id", level.alias("bin")).agg(F.count("*").alias("n"))
    every = px.select("image_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    h = every.join(counts, ["image_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("image_id").orderBy("bin")
    h = h.withColumns({"before": F.coalesce(F.lag("n").over(w), F.lit(0)), "after": F.coalesce(F.lead("n").over(w), F.lit(0))})
    return h.groupBy("image_id").agg(F.count_if((c("n") > c("before")) & (c("n") > c("after"))).alias("peaks"), F.count_if(c("n") > 0).alias("filled"))


# ---- selections: a mask on the pixels of each image
def _masked(px: DataFrame, on: Column) -> DataFrame:
    return px.select(*KEYS, F.when(on, 1).otherwise(0).alias("m"))


def rectangle(px: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    return _masked(px, (c("y") >= y0) & (c("y") < y1) & (c("x") >= x0) & (c("x") < x1))


def ellipse(px: DataFrame, cy: int, cx: int, ry: int, rx: int) -> DataFrame:
    return _masked(px, (c("y") - cy) * (c("y") - cy) * rx * rx + (c("x") - cx) * (c("x") - cx) * ry * ry <= ry * ry * rx * rx)


def polygon(px: DataFrame, points: Sequence[tuple[int, int]]) -> DataFrame:
    """Even-odd rule at pixel centres; points are (y, x), doubled coordinates keep it in whole numbers."""
    crossings = F.lit(0)
    y, x = 2 * c("y") + 1, 2 * c("x") + 1
    for (ay, ax), (by, bx) in zip(points, [*points[1:], points[0]], strict=True):
        ay, ax, by, bx = 2 * ay, 2 * ax, 2 * by, 2 * bx
        if ay == by:
            continue
        if ay > by:
            ay, ax, by, bx = by, bx, ay, ax
        spans = (y >= ay) & (y < by)
        crossings = crossings + F.when(spans & ((x - ax) * (by - ay) < (y - ay) * (bx - ax)), 1).otherwise(0)
    return _masked(px, crossings % 2 == 1)


def brush(px: DataFrame, path: Sequence[tuple[int, int]], radius: int) -> DataFrame:
    near = F.lit(False)
    for y, x in path:
        near = near | ((c("y") - y) * (c("y") - y) + (c("x") - x) * (c("x") - x) <= radius * radius)
    return _masked(px, near)


def feather(mask: DataFrame, radius: int = 1) -> DataFrame:
    """(image_id, y, x, weight): the mean of the clamped square window, in ten-thousandths rounded down."""
    n = 2 * radius + 1
    grey = mask.select(*KEYS, c("m").alias("r"), c("m").alias("g"), c("m").alias("b"))
    return neighbours(grey, [[1.0] * n] * n).groupBy(*KEYS).agg(F.expr(f"sum(r) * 10000 div {n * n}").alias("weight"))


def blend(px: DataFrame, edited: DataFrame, weights: DataFrame) -> DataFrame:
    """``edited`` over the image by weights in ten-thousandths."""
    both = px.join(edited.select(*KEYS, *[c(n).alias(f"e{n}") for n in "rgb"]), list(KEYS)).join(weights, list(KEYS))
    mix = lambda n: F.rint(c(n) + (c(f"e{n}") - c(n)) * c("weight") / F.lit(10000.0)).cast("int")
    return both.select(*KEYS, *[mix(n).alias(n) for n in "rgb"])


def geometry(spec: Column, width: Column, height: Column) -> Column:
    """struct(w, h) of a size in words: P% or PxQ%, W, xH or WxH, with ! to ignore the proportions, ^ to fill, > to shrink only and < to
    grow only; null where the words make no size. Sizes are rounded to the nearest whole, at least 1."""
    s = F.trim(spec)
    n = lambda pattern, i: F.regexp_extract(s, pattern, i).try_cast("int")
    share = r"^(\d+)%(?:x(\d+)%)?$"
    size = r"^(\d*)x?(\d*)([!^<>]?)$"
    w, h, flag = n(size, 1), n(size, 2), F.regexp_extract(s, size, 3)
    whole = lambda a, b: F.greatest(F.lit(1), F.floor((2 * a + b) / (2 * b)).cast("int"))
    pw, ph = n(share, 1), F.coalesce(n(share, 2), n(share, 1))
    by_width = F.struct(w.alias("w"), whole(height.cast("long") * w, width).alias("h"))
    by_height = F.struct(whole(width.cast("long") * h, height).alias("w"), h.alias("h"))
    wider = width.cast("long") * h > height.cast("long") * w  # the image is wider than the box
    fit = F.when(h.isNull(), by_width).when(w.isNull(), by_height).when(flag == "!", F.struct(w.alias("w"), h.alias("h"))).when((flag == "^") == wider, by_height).otherwise(by_width)
    own = F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"))
    larger = (width > F.coalesce(w, width)) | (height > F.coalesce(h, height))
    return F.when(s.rlike(share), F.struct(whole(width.cast("long") * pw, F.lit(100)).alias("w"), whole(height.cast("long") * ph, F.lit(100)).alias("h"))).when(
        s.rlike(size) & (w.isNotNull() | h.isNotNull()), F.when((flag == ">") & ~larger, own).when((flag == "<") & larger, own).otherwise(fit)
    )


def syllables(rows: DataFrame) -> DataFrame:
    """(series, syllables, stressed, iambs, trochees, duration_sum, duration_squares, final) of (series, place, stress, duration)."""
    w = Window.partitionBy("series").orderBy("place")
    r = rows.withColumns({"next": F.lead("stress").over(w), "last": F.lead("place").over(w).isNull()})
    return r.groupBy("series").agg(
        F.count("*").alias("syllables"), F.count_if("stress").alias("stressed"), F.count_if(~c("stress") & c("next")).alias("iambs"), F.count_if(c("stress") & ~c("next")).alias("trochees"),
        F.sum("duration").alias("duration_sum"), F.sum(c("duration") * c("duration")).alias("duration_squares"), F.max(F.when(c("last"), c("duration"))).alias("final"),
    )


def results(verdicts: DataFrame, specialist: str) -> DataFrame:
    """The one result contract of all specialists: specialist_id, query_id, output, confidence, abstained, reason, authority."""
    return verdicts.select(F.lit(specialist).alias("specialist_id"), "query_id", "output", c("confidence"), (c("status") != "suggest").alias("abstained"), "reason", F.lit("consultative").alias("authority"))


def contract_violations(found: DataFrame) -> DataFrame:
    """(violations): results whose confidence leaves 0 to a million, that abstain with confidence or an output, or answer without."""
    wrong = ~c("confidence").between(0, 1_000_000) | (c("abstained") & ((c("confidence") != 0) | c("output").isNotNull() | (c("reason") == ""))) | (~c("abstained") & (c("output").isNull() | (c("reason") != "")))
    return found.agg(F.count_if(F.coalesce(wrong, F.lit(True))).alias("violations"), F.count("*").alias("results"))
