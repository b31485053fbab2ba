"""Raster operators on pixel tables (image_id, y, x, r, g, b).

An image is a set of rows, so point operators are projections, folds are aggregates by image and neighbourhoods are
joins with a small table of offsets on clamped coordinates. Every operator works on all images of a table at once and
is keyed by image_id, so images spread over the cluster; the tables of offsets, curves and palettes are constants of a call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.numeric import channel, luma, luma_scaled

KEYS = ("image_id", "y", "x")
RGB = ("r", "g", "b")
# The published sepia matrix in thousandths.
SEPIA = ((393, 769, 189), (349, 686, 168), (272, 534, 131))
# The 4 x 4 ordered dither matrix.
BAYER = ((0, 8, 2, 10), (12, 4, 14, 6), (3, 11, 1, 9), (15, 7, 13, 5))
BLEND_MODES = ("over", "multiply", "screen", "overlay", "darken", "lighten", "difference", "add", "subtract", "color_dodge", "soft_light")

c = F.col


def _out(px: DataFrame, r: Column, g: Column, b: Column, *more: Column) -> DataFrame:
    return px.select(*KEYS, r.alias("r"), g.alias("g"), b.alias("b"), *more)


def _blend(px: DataFrame, target: Sequence[Column], strength: float) -> DataFrame:
    if strength >= 1:
        return _out(px, *target)
    return _out(px, *[channel(c(n) + (t - c(n)) * F.lit(float(strength))) for n, t in zip(RGB, target, strict=True)])


def grayscale(px: DataFrame, strength: float = 1.0, weights: str = "luma") -> DataFrame:
    level = luma(c("r"), c("g"), c("b")) if weights == "luma" else (c("r") + c("g") + c("b")) / F.lit(3.0)
    return _blend(px, [channel(level)] * 3, strength)


def sepia(px: DataFrame, strength: float = 1.0) -> DataFrame:
    return _blend(px, [channel((F.lit(a) * c("r") + F.lit(b) * c("g") + F.lit(d) * c("b")) / F.lit(1000.0)) for a, b, d in SEPIA], strength)


def invert(px: DataFrame, strength: float = 1.0) -> DataFrame:
    return _blend(px, [F.lit(255) - c(n) for n in RGB], strength)


def contrast_scale(contrast: float) -> float:
    return (259.0 * (contrast * 255.0 + 255.0)) / (255.0 * (259.0 - contrast * 255.0))


def brightness_contrast(px: DataFrame, brightness: float = 0.0, contrast: float = 0.0, strength: float = 1.0) -> DataFrame:
    scale, shift = contrast_scale(contrast), brightness * 255.0
    return _blend(px, [channel(F.lit(scale) * (c(n) + F.lit(shift) - F.lit(128.0)) + F.lit(128.0)) for n in RGB], strength)


def saturation(px: DataFrame, factor: float = 1.0, strength: float = 1.0) -> DataFrame:
    grey = luma(c("r"), c("g"), c("b"))
    return _blend(px, [channel(grey + (c(n) - grey) * F.lit(float(factor))) for n in RGB], strength)


def tint(px: DataFrame, factors: Sequence[float] = (1.0, 1.0, 1.0), strength: float = 1.0) -> DataFrame:
    return _blend(px, [channel(c(n) * F.lit(float(f))) for n, f in zip(RGB, factors, strict=True)], strength)


def threshold(px: DataFrame, level: float = 0.5, strength: float = 1.0) -> DataFrame:
    value = F.when(luma(c("r"), c("g"), c("b")) / F.lit(255.0) >= F.lit(float(level)), 255).otherwise(0)
    return _blend(px, [value] * 3, strength)


def extract_channel(px: DataFrame, name: str = "r") -> DataFrame:
    """One channel, or the luma, as a grey image."""
    value = channel(luma(c("r"), c("g"), c("b"))) if name == "luma" else c(name)
    return _out(px, value, value, value)


def combine_channels(red: DataFrame, green: DataFrame, blue: DataFrame) -> DataFrame:
    """Three grey images as one; pixels that one of them lacks are left out."""
    keys = list(KEYS)
    return red.select(*keys, "r").join(green.select(*keys, "g"), keys).join(blue.select(*keys, "b"), keys)


def hsv(px: DataFrame) -> DataFrame:
    """Hue in hundredths of a degree, saturation and value in ten-thousandths, all as integers."""
    r, g, b = c("r"), c("g"), c("b")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sixth = lambda a, d, turn: F.lit(6000.0) * (a - d) / F.when(span == 0, F.lit(1)).otherwise(span) + F.lit(turn)
    hue = F.when(span == 0, F.lit(0.0)).when(top == r, F.pmod(sixth(g, b, 36000.0), F.lit(36000.0))).when(top == g, sixth(b, r, 12000.0)).otherwise(sixth(r, g, 24000.0))
    sat = F.when(top == 0, F.lit(0.0)).otherwise(F.lit(10000.0) * span / F.when(top == 0, F.lit(1)).otherwise(top))
    return px.select(*KEYS, F.rint(hue).cast("long").alias("h"), F.rint(sat).cast("long").alias("s"), F.rint(F.lit(10000.0) * top / F.lit(255)).cast("long").alias("v"))


def _mix(mode: str, b: Column, s: Column) -> Column:
    one, two = F.lit(1.0), F.lit(2.0)
    return {
        "over": s,
        "multiply": b * s,
        "screen": one - (one - b) * (one - s),
        "overlay": F.when(b < 0.5, two * b * s).otherwise(one - two * (one - b) * (one - s)),
        "darken": F.least(b, s),
        "lighten": F.greatest(b, s),
        "difference": F.abs(b - s),
        "add": F.least(one, b + s),
        "subtract": F.greatest(F.lit(0.0), b - s),
        "color_dodge": F.when(s >= 1.0, one).otherwise(F.least(one, b / (one - s + F.lit(1e-6)))),
        "soft_light": (one - two * s) * b * b + two * s * b,
    }[mode]


def composite(base: DataFrame, overlay: DataFrame, mode: str = "over", opacity: float = 1.0, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """``overlay`` on ``base`` at (y, x) ``offset``; base pixels that it doesn't cover stay."""
    if mode not in BLEND_MODES:
        raise ValueError(f"unknown blend mode {mode}; known: {', '.join(BLEND_MODES)}")
    top = overlay.select("image_id", (c("y") + offset[0]).alias("y"), (c("x") + offset[1]).alias("x"), *[c(n).alias(f"o{n}") for n in RGB])
    both = base.join(top, list(KEYS), "left")
    mixed = [c(n) + (_mix(mode, c(n) / F.lit(255.0), c(f"o{n}") / F.lit(255.0)) * F.lit(255.0) - c(n)) * F.lit(float(opacity)) for n in RGB]
    return _out(both, *[F.when(c(f"o{n}").isNull(), c(n)).otherwise(channel(m)) for n, m in zip(RGB, mixed, strict=True)])


def sizes(px: DataFrame) -> DataFrame:
    """(image_id, h, w)."""
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def _sized(px: DataFrame) -> DataFrame:
    return px.join(sizes(px), "image_id")


def problems(px: DataFrame) -> DataFrame:
    """(image_id, problem): images that are no full rectangle, repeat a pixel, or leave the range of a channel."""
    per = px.groupBy("image_id").agg(
        F.count("*").alias("n"), F.countDistinct("y", "x").alias("places"), F.min("y").alias("y0"), F.min("x").alias("x0"), ((F.max("y") + 1) * (F.max("x") + 1)).alias("area"), F.min(F.least("r", "g", "b")).alias("low"), F.max(F.greatest("r", "g", "b")).alias("top")
    )
    problem = F.when(c("n") != c("places"), "repeated_pixel").when((c("y0") != 0) | (c("x0") != 0) | (c("places") != c("area")), "not_rectangular").when((c("low") < 0) | (c("top") > 255), "channel_out_of_range")
    return per.select("image_id", problem.alias("problem")).where("problem is not null")


def transform(px: DataFrame, name: str) -> DataFrame:
    """flip_horizontal, flip_vertical, rotate_90, rotate_180 or rotate_270 (clockwise)."""
    s = _sized(px)
    y, x, h, w = c("y"), c("x"), c("h"), c("w")
    to = {"flip_horizontal": (y, w - 1 - x), "flip_vertical": (h - 1 - y, x), "rotate_90": (x, h - 1 - y), "rotate_180": (h - 1 - y, w - 1 - x), "rotate_270": (w - 1 - x, y)}[name]
    return s.select("image_id", to[0].cast("int").alias("y"), to[1].cast("int").alias("x"), *RGB)


def auto_orient(px: DataFrame, orientation: int) -> DataFrame:
    """The image upright, from its EXIF orientation 1 to 8."""
    s = _sized(px)
    y, x, h, w = c("y"), c("x"), c("h"), c("w")
    to = {1: (y, x), 2: (y, w - 1 - x), 3: (h - 1 - y, w - 1 - x), 4: (h - 1 - y, x), 5: (x, y), 6: (x, h - 1 - y), 7: (w - 1 - x, h - 1 - y), 8: (w - 1 - x, y)}[orientation]
    return s.select("image_id", to[0].cast("int").alias("y"), to[1].cast("int").alias("x"), *RGB)


def _grid(per: DataFrame, h: Column, w: Column) -> DataFrame:
    """A row for each place of an h x w grid of each image of ``per``."""
    rows = per.withColumn("y", F.explode(F.sequence(F.lit(0), h.cast("int") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), w.cast("int") - 1)))


def pad_extent(px: DataFrame, height: int, width: int, background: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """The image centred on a larger canvas."""
    canvas = _grid(sizes(px), F.lit(height), F.lit(width))
    canvas = canvas.withColumn("sy", c("y") - F.floor((F.lit(height) - c("h")) / 2)).withColumn("sx", c("x") - F.floor((F.lit(width) - c("w")) / 2))
    src = px.select("image_id", c("y").cast("long").alias("sy"), c("x").cast("long").alias("sx"), *RGB)
    both = canvas.join(src, ["image_id", "sy", "sx"], "left")
    return _out(both, *[F.coalesce(c(n), F.lit(v)) for n, v in zip(RGB, background, strict=True)])


def trim_uniform(px: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Cropped to the pixels that differ from the first one by more than ``3 * tolerance`` in all."""
    corner = px.where("y = 0 and x = 0").select("image_id", *[c(n).alias(f"c{n}") for n in RGB])
    marked = px.join(corner, "image_id")
    far = F.abs(c("r") - c("cr")) + F.abs(c("g") - c("cg")) + F.abs(c("b") - c("cb")) > F.lit(3.0 * tolerance)
    box = marked.where(far).groupBy("image_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    kept = px.join(box, "image_id").where("y between y0 and y1 and x between x0 and x1")
    return kept.select("image_id", (c("y") - c("y0")).cast("int").alias("y"), (c("x") - c("x0")).cast("int").alias("x"), *RGB)


def montage(px: DataFrame, order: str, columns: int, tile: int, padding: int = 2, per_sheet: int = 6) -> DataFrame:
    """Contact sheets of ``per_sheet`` equal tiles in the order of the whole number ``order``; sheets take the place of images."""
    place = F.pmod(c(order), F.lit(per_sheet))
    y = c("y") + F.floor(place / columns) * (tile + padding) + padding
    x = c("x") + F.pmod(place, F.lit(columns)) * (tile + padding) + padding
    return px.select(F.floor(c(order) / per_sheet).cast("long").alias("image_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), *RGB)


def slice_sheet(px: DataFrame, frame_h: int, frame_w: int) -> DataFrame:
    """(image_id, frame, y, x, r, g, b): whole frames of a sheet in reading order; what is left over at the edges is dropped."""
    s = _sized(px)
    across = F.floor(c("w") / frame_w)
    row, col = F.floor(c("y") / frame_h), F.floor(c("x") / frame_w)
    kept = s.where((row < F.floor(c("h") / frame_h)) & (col < across))
    return kept.select("image_id", (row * across + col).cast("int").alias("frame"), F.pmod("y", F.lit(frame_h)).alias("y"), F.pmod("x", F.lit(frame_w)).alias("x"), *RGB)


def resample_nearest(px: DataFrame, height: int, width: int) -> DataFrame:
    grid = _grid(sizes(px), F.lit(height), F.lit(width))
    grid = grid.withColumn("sy", F.least(c("h") - 1, F.floor(c("y") * c("h") / height)).cast("int")).withColumn("sx", F.least(c("w") - 1, F.floor(c("x") * c("w") / width)).cast("int"))
    return _out(grid.join(px.select("image_id", c("y").alias("sy"), c("x").alias("sx"), *RGB), ["image_id", "sy", "sx"]), c("r"), c("g"), c("b"))


def resample_box(px: DataFrame, height: int, width: int) -> DataFrame:
    """Means of whole-pixel cells; a target larger than the source repeats pixels."""
    grid = _grid(sizes(px), F.lit(height), F.lit(width))
    lo = lambda i, n, m: F.floor(c(i) * c(n) / m)
    hi = lambda i, n, m: F.greatest(lo(i, n, m) + 1, F.floor((c(i) + 1) * c(n) / m))
    cells = grid.withColumn("sy", F.explode(F.sequence(lo("y", "h", height), F.least(hi("y", "h", height), c("h").cast("long")) - 1)))
    cells = cells.withColumn("sx", F.explode(F.sequence(lo("x", "w", width), F.least(hi("x", "w", width), c("w").cast("long")) - 1)))
    both = cells.join(px.select("image_id", c("y").cast("long").alias("sy"), c("x").cast("long").alias("sx"), *RGB), ["image_id", "sy", "sx"])
    return both.groupBy(*KEYS).agg(*[channel(F.sum(n) / F.count("*")).alias(n) for n in RGB])


def corners(px: DataFrame, height: int, width: int) -> DataFrame:
    """Each pixel of a target with the four source pixels around its centre: channels ar, br, dr, er and so on, and the shares dy, dx."""
    grid = _grid(sizes(px), F.lit(height), F.lit(width))
    sy = (c("y") + F.lit(0.5)) * c("h") / F.lit(float(height)) - F.lit(0.5)
    sx = (c("x") + F.lit(0.5)) * c("w") / F.lit(float(width)) - F.lit(0.5)
    grid = grid.withColumns({"fy": sy, "fx": sx})
    grid = grid.withColumn("y0", F.greatest(F.lit(0), F.least(c("h") - 1, c("fy").cast("int")))).withColumn("x0", F.greatest(F.lit(0), F.least(c("w") - 1, c("fx").cast("int"))))
    grid = grid.withColumn("y1", F.least(c("h") - 1, c("y0") + 1)).withColumn("x1", F.least(c("w") - 1, c("x0") + 1)).withColumns({"dy": c("fy") - c("y0"), "dx": c("fx") - c("x0")})
    for tag, yy, xx in (("a", "y0", "x0"), ("b", "y0", "x1"), ("d", "y1", "x0"), ("e", "y1", "x1")):
        grid = grid.join(px.select("image_id", c("y").alias(yy), c("x").alias(xx), *[c(n).alias(f"{tag}{n}") for n in RGB]), ["image_id", yy, xx])
    return grid


def between(n: str) -> Column:
    """Channel ``n`` between the corners, before rounding."""
    one = F.lit(1.0)
    return (c(f"a{n}") * (one - c("dx")) + c(f"b{n}") * c("dx")) * (one - c("dy")) + (c(f"d{n}") * (one - c("dx")) + c(f"e{n}") * c("dx")) * c("dy")


def resample_bilinear(px: DataFrame, height: int, width: int) -> DataFrame:
    """Half-pixel bilinear interpolation, as a sum over the four weighted corners."""
    return _out(corners(px, height, width), *[channel(between(n)) for n in RGB])


def neighbours(px: DataFrame, kernel: Sequence[Sequence[float]]) -> DataFrame:
    """Each pixel (image_id, y, x) with the pixels under an odd kernel: weight w and r, g, b; edges are clamped."""
    ky, kx = len(kernel) // 2, len(kernel[0]) // 2
    offsets = F.array(*[F.struct(F.lit(i - ky).alias("dy"), F.lit(j - kx).alias("dx"), F.lit(float(v)).alias("w")) for i, row in enumerate(kernel) for j, v in enumerate(row)])
    s = _sized(px.select(*KEYS)).withColumn("k", F.explode(offsets))
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(c(n) - 1, v))
    at = s.select(*KEYS, c("k.w").alias("w"), clamp(c("y") + c("k.dy"), "h").alias("sy"), clamp(c("x") + c("k.dx"), "w").alias("sx"))
    return at.join(px.select("image_id", c("y").alias("sy"), c("x").alias("sx"), *RGB), ["image_id", "sy", "sx"])


def convolve(px: DataFrame, kernel: Sequence[Sequence[float]], divisor: float | None = None, offset: float = 0.0) -> DataFrame:
    """A k x k convolution with clamped edges; the divisor is the kernel's sum, or 1 if that is 0."""
    total = sum(v for row in kernel for v in row)
    div = divisor if divisor is not None else total if abs(total) >= 1e-6 else 1.0
    sums = neighbours(px, kernel).groupBy(*KEYS)
    return sums.agg(*[channel(F.sum(c(n) * c("w")) / F.lit(float(div)) + F.lit(float(offset))).alias(n) for n in RGB])


def sharpen(px: DataFrame, strength: float = 1.0) -> DataFrame:
    s = float(strength)
    return convolve(px, [[0, -s, 0], [-s, 1 + 4 * s, -s], [0, -s, 0]], 1.0)


def box_blur(px: DataFrame, radius: int = 1) -> DataFrame:
    n = 2 * radius + 1
    return convolve(px, [[1.0] * n] * n, float(n * n))


def emboss(px: DataFrame) -> DataFrame:
    return convolve(px, [[-2, -1, 0], [-1, 1, 1], [0, 1, 2]], 1.0, 128.0)


def laplacian(px: DataFrame) -> DataFrame:
    return convolve(px, [[0, 1, 0], [1, -4, 1], [0, 1, 0]], 1.0)


def sobel(px: DataFrame) -> DataFrame:
    """Gradient magnitude of the luma over four, as a grey image."""
    near = neighbours(px, [[float(3 * i + j) for j in range(3)] for i in range(3)])  # the weight tells the place
    gx, gy = (-1, 0, 1, -2, 0, 2, -1, 0, 1), (-1, -2, -1, 0, 0, 0, 1, 2, 1)
    pick = lambda g: F.element_at(F.array(*[F.lit(v) for v in g]), c("w").cast("int") + 1)
    lum = luma_scaled(c("r"), c("g"), c("b")).cast("long")
    sums = near.groupBy(*KEYS).agg(F.sum(lum * pick(gx)).alias("gx"), F.sum(lum * pick(gy)).alias("gy"))
    value = channel(F.sqrt((c("gx") * c("gx") + c("gy") * c("gy")).cast("double")) / F.lit(40000.0))
    return _out(sums, value, value, value)


def mask_of(px: DataFrame, level: int = 128) -> DataFrame:
    """(image_id, y, x, m): 1 where the luma reaches ``level``."""
    return px.select(*KEYS, F.when(luma_scaled(c("r"), c("g"), c("b")) >= level * 10000, 1).otherwise(0).alias("m"))


def morph(mask: DataFrame, how: str, radius: int = 1) -> DataFrame:
    """Dilates (the greatest of a square window) or erodes (the least); windows end at the image's edges."""
    n = 2 * radius + 1
    px = mask.select(*KEYS, c("m").alias("r"), c("m").alias("g"), c("m").alias("b"))
    near = neighbours(px, [[1.0] * n] * n)  # a clamped neighbour lies in the window as well
    return near.groupBy(*KEYS).agg((F.max if how == "dilate" else F.min)("r").alias("m"))


def local_threshold(px: DataFrame, window: int = 5, offset: float = 5.0) -> DataFrame:
    """1 where the luma reaches the mean of the window's part inside the image, less ``offset``."""
    half = window // 2
    s = _sized(px.select(*KEYS, luma_scaled(c("r"), c("g"), c("b")).cast("long").alias("own")))
    s = s.withColumn("sy", F.explode(F.sequence(F.greatest(F.lit(0), c("y") - half), F.least(c("h") - 1, c("y") + half))))
    s = s.withColumn("sx", F.explode(F.sequence(F.greatest(F.lit(0), c("x") - half), F.least(c("w") - 1, c("x") + half))))
    near = s.join(px.select("image_id", c("y").alias("sy"), c("x").alias("sx"), luma_scaled(c("r"), c("g"), c("b")).cast("long").alias("l")), ["image_id", "sy", "sx"])
    sums = near.groupBy(*KEYS, "own").agg(F.sum("l").alias("l"), F.count("*").alias("n"))
    return sums.select(*KEYS, F.when(c("own") * c("n") >= c("l") - F.lit(int(offset * 10000)) * c("n"), 1).otherwise(0).alias("m"))


def histogram(px: DataFrame) -> DataFrame:
    """(image_id, level, n): pixels by rounded luma."""
    return px.groupBy("image_id", channel(luma(c("r"), c("g"), c("b"))).alias("level")).agg(F.count("*").alias("n"))


def otsu(px: DataFrame) -> DataFrame:
    """(image_id, level): the first luma of greatest variance between classes; 128 where no split has any."""
    upto = Window.partitionBy("image_id").orderBy("level")
    whole = Window.partitionBy("image_id")
    h = histogram(px).withColumns({"wb": F.sum("n").over(upto), "sb": F.sum(c("n") * c("level")).over(upto), "total": F.sum("n").over(whole), "sum": F.sum(c("n") * c("level")).over(whole)})
    h = h.withColumn("wf", c("total") - c("wb"))
    gap = c("sb") / c("wb") - (c("sum") - c("sb")) / F.when(c("wf") > 0, c("wf"))
    between = (c("wb") * c("wf")).cast("double") * gap * gap
    best = F.max(F.when(between > 0, F.struct(between.alias("v"), (-c("level")).alias("l"))))
    return h.groupBy("image_id").agg(best.alias("best")).select("image_id", F.coalesce(-c("best.l"), F.lit(128)).alias("level"))


def equalize(px: DataFrame) -> DataFrame:
    """Histogram equalisation of the luma, carried over to the channels by its ratio."""
    h = histogram(px)
    upto, whole = Window.partitionBy("image_id").orderBy("level"), Window.partitionBy("image_id")
    h = h.withColumns({"cdf": F.sum("n").over(upto), "total": F.sum("n").over(whole)}).withColumn("least", F.min("cdf").over(whole))
    curve = F.when(c("total") > c("least"), channel((c("cdf") - c("least")) * F.lit(255.0) / F.when(c("total") > c("least"), c("total") - c("least")))).otherwise(c("level"))
    h = h.select("image_id", "level", curve.alias("to"))
    own = luma(c("r"), c("g"), c("b"))
    both = px.withColumn("level", channel(own)).join(h, ["image_id", "level"])
    ratio = F.when(own > 0, c("to") / F.when(own > 0, own)).otherwise(F.lit(1.0))
    return _out(both, *[channel(c(n) * ratio) for n in RGB])


def contrast_stretch(px: DataFrame, black: float = 0.01, white: float = 0.99) -> DataFrame:
    """Stretches between two index percentiles of the luma; images that span less than one level stay."""
    order = Window.partitionBy("image_id").orderBy("l")
    ranked = px.select("image_id", luma_scaled(c("r"), c("g"), c("b")).alias("l")).withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("image_id"))})
    at = lambda p: F.greatest(F.lit(0), F.least(c("n") - 1, F.floor(F.lit(float(p)) * c("n"))))
    ends = ranked.groupBy("image_id").agg(F.max(F.when(c("i") == at(black), c("l"))).alias("lo"), F.max(F.when(c("i") == at(white), c("l"))).alias("hi"))
    both = px.join(ends, "image_id")
    low, span = c("lo") / F.lit(10000.0), c("hi") / F.lit(10000.0) - c("lo") / F.lit(10000.0)
    return _out(both, *[F.when(span < 1.0, c(n)).otherwise(channel((c(n) - low) * F.lit(255.0) / F.when(span >= 1.0, span))) for n in RGB])


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of absolute and squared channel differences, greatest difference and differing pixels of each image pair."""
    both = a.join(b.select(*KEYS, *[c(n).alias(f"o{n}") for n in RGB]), list(KEYS))
    diffs = [F.abs(c(n) - c(f"o{n}")) for n in RGB]
    most = F.greatest(*diffs)
    return both.groupBy("image_id").agg(
        F.count("*").alias("pixels"), F.sum(diffs[0] + diffs[1] + diffs[2]).alias("abs_sum"), F.sum(diffs[0] * diffs[0] + diffs[1] * diffs[1] + diffs[2] * diffs[2]).alias("square_sum"), F.max(most).alias("max_delta"), F.count_if(most > 0).alias("mismatches")
    )


def diff_image(a: DataFrame, b: DataFrame, highlight: tuple[int, int, int] = (255, 0, 0)) -> DataFrame:
    both = a.join(b.select(*KEYS, *[c(n).alias(f"o{n}") for n in RGB]), list(KEYS))
    same = (c("r") == c("or")) & (c("g") == c("og")) & (c("b") == c("ob"))
    return _out(both, *[F.when(same, c(n)).otherwise(F.lit(v)) for n, v in zip(RGB, highlight, strict=True)])


def nearest_colour(px: DataFrame, palette: Sequence[tuple[int, int, int]]) -> Column:
    """The palette entry of least weighted distance (299, 587, 114) from a pixel's channels, the first of equals."""
    entries = [F.struct((F.lit(299) * (c("r") - p[0]) * (c("r") - p[0]) + F.lit(587) * (c("g") - p[1]) * (c("g") - p[1]) + F.lit(114) * (c("b") - p[2]) * (c("b") - p[2])).cast("long").alias("d"), F.lit(i).alias("i"), F.lit(p[0]).alias("r"), F.lit(p[1]).alias("g"), F.lit(p[2]).alias("b")) for i, p in enumerate(palette)]
    return F.array_min(F.array(*entries))


def quantize(px: DataFrame, palette: Sequence[tuple[int, int, int]]) -> DataFrame:
    best = px.withColumn("p", nearest_colour(px, palette))
    return _out(best, c("p.r"), c("p.g"), c("p.b"))


def ordered_dither(px: DataFrame, palette: Sequence[tuple[int, int, int]]) -> DataFrame:
    bayer = F.array(*[F.lit((v / 16.0 - 0.5) * 32.0) for row in BAYER for v in row])
    shift = F.element_at(bayer, F.pmod("y", F.lit(4)) * 4 + F.pmod("x", F.lit(4)) + 1)
    moved = px.withColumn("s", shift)
    return quantize(_out(moved, *[channel(c(n) + c("s")) for n in RGB]), palette)


def palette_usage(px: DataFrame, palette: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(image_id, entry, pixels, distance_sum)."""
    best = px.select("image_id", nearest_colour(px, palette).alias("p"))
    return best.groupBy("image_id", c("p.i").alias("entry")).agg(F.count("*").alias("pixels"), F.sum("p.d").alias("distance_sum"))


def _bits(rows: DataFrame, place: Column, on: Column) -> DataFrame:
    return rows.groupBy("image_id").agg(F.bit_or(F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(63) - place).cast("int"))).otherwise(F.lit(0).cast("long"))).alias("hash"))


def average_hash(px: DataFrame) -> DataFrame:
    """(image_id, hash): 64 bits as a signed integer, set where an 8 x 8 cell reaches the mean luma."""
    tiny = resample_box(px, 8, 8).withColumn("l", luma_scaled(c("r"), c("g"), c("b")).cast("long"))
    tiny = tiny.withColumn("sum", F.sum("l").over(Window.partitionBy("image_id")))
    return _bits(tiny.withColumn("place", c("y") * 8 + c("x")), c("place"), c("l") * 64 >= c("sum"))


def difference_hash(px: DataFrame) -> DataFrame:
    """(image_id, hash): 64 bits, set where an 8 x 9 cell is brighter than the next one in its row."""
    tiny = resample_box(px, 8, 9).withColumn("l", luma_scaled(c("r"), c("g"), c("b")).cast("long"))
    tiny = tiny.withColumn("next", F.lead("l").over(Window.partitionBy("image_id", "y").orderBy("x"))).where("x < 8")
    return _bits(tiny.withColumn("place", c("y") * 8 + c("x")), c("place"), c("l") > c("next"))


def profile(px: DataFrame, axis: str) -> DataFrame:
    """(image_id, axis, place, luma_sum, n): luma by column (x) or row (y)."""
    return px.groupBy("image_id", c(axis).alias("place")).agg(F.sum(luma_scaled(c("r"), c("g"), c("b")).cast("long")).alias("luma_sum"), F.count("*").alias("n")).withColumn("axis", F.lit(axis))


def content_box(mask: DataFrame) -> DataFrame:
    """(image_id, y0, x0, y1, x1, pixels) of the set part of each mask."""
    return mask.where("m = 1").groupBy("image_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.count("*").alias("pixels"))


def border_background(px: DataFrame, band: int = 1) -> DataFrame:
    """(image_id, r, g, b, share): the most frequent colour of the border band, the least of equals, in millionths of its pixels."""
    edge = _sized(px).where((c("y") < band) | (c("x") < band) | (c("y") >= c("h") - band) | (c("x") >= c("w") - band))
    counts = edge.groupBy("image_id", *RGB).agg(F.count("*").alias("n"))
    best = counts.groupBy("image_id").agg(F.min(F.struct((-c("n")).alias("n"), *RGB)).alias("p"), F.sum("n").alias("total"))
    return best.select("image_id", c("p.r").alias("r"), c("p.g").alias("g"), c("p.b").alias("b"), F.floor(-c("p.n") * 1000000 / c("total")).cast("long").alias("share"))


def seam(px: DataFrame) -> DataFrame:
    """(image_id, axis, seam_sum, inner_sum, n): luma steps across the wrap of each axis and between neighbours inside."""
    s = _sized(px).withColumn("l", luma_scaled(c("r"), c("g"), c("b")).cast("long"))
    parts = []
    for axis, across, size in (("x", "y", "w"), ("y", "x", "h")):
        near = s.withColumn("step", F.abs(c("l") - F.lag("l").over(Window.partitionBy("image_id", across).orderBy(axis))))
        ends = near.groupBy("image_id", across).agg(F.abs(F.sum(F.when(c(axis) == 0, c("l")).when(c(axis) == c(size) - 1, -c("l")))).alias("gap"), F.sum("step").alias("steps"), F.count("step").alias("n"))
        parts.append(ends.groupBy("image_id").agg(F.sum("gap").alias("seam_sum"), F.sum("steps").alias("inner_sum"), F.sum("n").alias("n")).withColumn("axis", F.lit(axis)))
    return parts[0].unionByName(parts[1])
