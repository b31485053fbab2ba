"""What a chosen preset, pattern, network or border does to images: filters, thresholds, resampling, tone curves, cutouts and regions to trace.

Pixel tables are (image_id, y, x, r, g, b). Presets, patterns, exemplars and network weights are arguments of a call. Lists are collected for one
image's border or one pixel's corners only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.numeric import channel, fixed, luma_scaled
from quillstone.operators import editing as E
from quillstone.operators import kernels as K
from quillstone.operators import network
from quillstone.operators import perception as P
from quillstone.operators import raster as R
from quillstone.operators.raster import KEYS, RGB

c = F.col
#: A cutout looks at this many pixels along the edge, their most frequent colours, and the nearest of them.
BAND, COLOURS, NEAREST, DISTANCE, SPREAD = 2, 512, 5, 48.0, 0.22
#: Shares of foreground that a cutout may have.
LEAST_SHARE, MOST_SHARE = 0.02, 0.92


def filtered(px: DataFrame, choices: DataFrame) -> DataFrame:
    """Each image under the filter that ``choices`` (image_id, preset) names; other presets leave it as it is, and so does no choice at all."""
    acts = {"denoise_soft": lambda p: E.gaussian_blur(p, 1, 0.8), "sharpen_subtle": lambda p: R.sharpen(p, 0.5), "edge_accentuate": R.sobel, "emboss_texture": R.emboss}
    marked = px.join(choices.select("image_id", "preset"), "image_id", "left")
    out = marked.where(F.coalesce(~c("preset").isin(*acts), F.lit(True))).select(*KEYS, *RGB)
    for name, act in acts.items():
        out = out.unionByName(act(marked.where(c("preset") == name).select(*KEYS, *RGB)).select(*KEYS, *RGB))
    return out


def binarised(px: DataFrame, strategies: DataFrame) -> DataFrame:
    """(image_id, y, x, m): images by their strategy: against the local mean, or against the image's own best level; those that abstain have no rows."""
    marked = px.join(strategies.select("image_id", "strategy"), "image_id").where("strategy <> 'abstain'")
    local = R.local_threshold(marked.where("strategy = 'adaptive_local'").select(*KEYS, *RGB))
    rest = marked.where("strategy <> 'adaptive_local'").select(*KEYS, *RGB)
    whole = rest.join(R.otsu(rest), "image_id").select(*KEYS, F.when(luma_scaled(*map(c, RGB)) >= c("level") * 10_000, 1).otherwise(0).alias("m"))
    return local.unionByName(whole)


def resample_by_pattern(px: DataFrame, height: int, width: int, patterns: Sequence[tuple[tuple[float, ...], tuple[float, ...]]]) -> DataFrame:
    """A target image whose pixels weigh the four corners as the nearest pattern does, and bilinearly where none is near or nothing changes there.

    A pattern is the lumas and the weights of the corners (top left, top right, bottom left, bottom right), both from 0 to 1. It applies below a squared distance
    of 0.1 and where the luma changes by more than 0.15 across or down. Images of one row or column are bilinear; matched tells where a pattern applied.
    """
    tags = "abde"
    grid = R.corners(px, height, width)
    grid = grid.withColumns({f"l{t}": luma_scaled(*[c(f"{t}{n}") for n in RGB]) / F.lit(10_000.0) / F.lit(255.0) for t in tags})
    best = F.lit(None).cast("struct<far:double,i:int,w:array<double>>")
    if patterns:
        far = lambda p: sum(((c(f"l{t}") - F.lit(float(v))) * (c(f"l{t}") - F.lit(float(v))) for t, v in zip(tags[1:], p[1:], strict=True)), (c("la") - F.lit(float(p[0]))) * (c("la") - F.lit(float(p[0]))))
        best = F.array_min(F.array(*[F.struct(far(p).alias("far"), F.lit(i).alias("i"), F.array(*[F.lit(float(x)) for x in w]).alias("w")) for i, (p, w) in enumerate(patterns)]))
    across = F.abs(c("lb") - c("la") + c("le") - c("ld")) / F.lit(2.0)
    down = F.abs(c("ld") - c("la") + c("le") - c("lb")) / F.lit(2.0)
    grid = grid.withColumn("best", best)
    on = F.coalesce((c("best.far") < 0.1) & ((across > 0.15) | (down > 0.15)) & (c("h") > 1) & (c("w") > 1), F.lit(False))
    grid = grid.withColumn("on", on)
    value = lambda n: c(f"a{n}") * c("best.w")[0] + c(f"b{n}") * c("best.w")[1] + c(f"d{n}") * c("best.w")[2] + c(f"e{n}") * c("best.w")[3]
    return grid.select(*KEYS, *[channel(F.when(c("on"), value(n)).otherwise(R.between(n))).alias(n) for n in RGB], c("on").alias("matched"))


def tone_curves(px: DataFrame, layers: Sequence[network.Layer]) -> DataFrame:
    """(image_id, gamma, lift, gain, pivot): what a network with eight inputs and four outputs makes of an image's luma."""
    t = P.tone(px)
    out = network.layered(t, F.array(*[c(n) for n in t.columns if n != "image_id"]), layers, "o")
    return out.select("image_id", (F.lit(0.5) + c("o")[0] * F.lit(1.5)).alias("gamma"), (c("o")[1] * F.lit(0.1)).alias("lift"), (F.lit(0.8) + c("o")[2] * F.lit(0.4)).alias("gain"), c("o")[3].alias("pivot"))


def toned(px: DataFrame, curves: DataFrame) -> DataFrame:
    """Images with each channel on its image's curve: the power 1 / gamma, times gain, plus lift."""
    value = lambda n: channel((F.pow(c(n) / F.lit(255.0), F.lit(1.0) / c("gamma")) * c("gain") + c("lift")) * F.lit(255.0))
    return px.join(curves, "image_id").select(*KEYS, *[value(n).alias(n) for n in RGB])


def local_features(px: DataFrame) -> DataFrame:
    """(image_id, y, x, grad_mag, norm_var, hf_energy, noise_proxy) of each pixel's 3 x 3 surroundings inside the image, from exact sums of luma."""
    own = px.select(*KEYS, luma_scaled(*map(c, RGB)).cast("long").alias("l"))
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # a pixel tells its luma to those around it; what falls outside the image meets no pixel
    told = own.withColumn("k", F.explode(steps)).select("image_id", (c("y") + c("k.dy")).alias("y"), (c("x") + c("k.dx")).alias("x"), c("l").alias("o"))
    s = own.join(told, list(KEYS)).groupBy(*KEYS, "l").agg(F.count("*").alias("n"), F.sum("o").alias("s"), F.sum(c("o") * c("o")).alias("ss"), F.sum(F.abs(c("o") - c("l"))).alias("d"))
    n, one = c("n").cast("double"), F.lit(1.0)
    mean = c("s") / n
    s = s.withColumn("norm_var", F.least(one, F.sqrt(F.greatest(F.lit(0.0), c("ss") / n - mean * mean)) / F.lit(640_000.0))).withColumn("grad_mag", F.least(one, c("d") / n / F.lit(480_000.0)))
    s = s.withColumn("hf_energy", F.least(one, F.abs(c("l") - mean) / F.lit(320_000.0))).withColumn("noise_proxy", F.greatest(F.lit(0.0), F.least(one, c("norm_var") * 0.8 - c("grad_mag") * 0.5)))
    return s.select(*KEYS, "grad_mag", "norm_var", "hf_energy", "noise_proxy")


def adaptive_filter(px: DataFrame, layers: Sequence[network.Layer]) -> DataFrame:
    """Images between a sharpened and a smoothed version, weighted pixel by pixel by a network with four inputs and two outputs; sharp is the first share."""
    f = local_features(px)
    out = network.layered(f, F.array("grad_mag", "norm_var", "hf_energy", "noise_proxy"), layers, "o")
    total = c("o")[0] + c("o")[1]
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    shares = out.select(*KEYS, (c("o")[0] / total).alias("sharp"), (c("o")[1] / total).alias("smooth"))
    crisp = R.sharpen(px, 0.8).select(*KEYS, *[c(n).alias(f"c{n}") for n in RGB])
    soft = E.gaussian_blur(px, 1, 0.8).select(*KEYS, *[c(n).alias(f"s{n}") for n in RGB])
    both = shares.join(crisp, list(KEYS)).join(soft, list(KEYS))
    return both.select(*KEYS, *[channel(c(f"c{n}") * c("sharp") + c(f"s{n}") * c("smooth")).alias(n) for n in RGB], "sharp")


# ---- cutouts
def _border(px: DataFrame) -> DataFrame:
    """(image_id, border, spread): the colours of an image's edge with their counts up to NEAREST, null if there are too many, and how much they vary."""
    sized = px.join(R.sizes(px), "image_id")
    edge = sized.where((c("y") < BAND) | (c("x") < BAND) | (c("y") >= c("h") - BAND) | (c("x") >= c("w") - BAND))
    colours = edge.groupBy("image_id", *RGB).agg(F.count("*").alias("n"))
    sums = [F.sum(c(n) * c("n")).alias(f"s{n}") for n in RGB] + [F.sum(c(n) * c(n) * c("n")).alias(f"q{n}") for n in RGB]
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(*RGB))
    # of an image with too many colours only so many are collected as tell that
    some = F.collect_list(F.when(c("place") <= COLOURS + 1, F.struct(*RGB, F.least(F.lit(NEAREST).cast("long"), c("n")).alias("n"))))
    per = colours.withColumn("place", place).groupBy("image_id").agg(F.sum("n").alias("n"), *sums, F.array_sort(some).alias("border"))
    n = c("n").cast("double")
    spread = sum((c(f"q{x}") / n - (c(f"s{x}") / n) * (c(f"s{x}") / n) for x in "gb"), c("qr") / n - (c("sr") / n) * (c("sr") / n))
    return per.select("image_id", F.when(F.size("border") <= COLOURS, c("border")).alias("border"), (F.sqrt(F.greatest(F.lit(0.0), spread / F.lit(3.0))) / F.lit(255.0)).alias("spread"))


def _mean_distance(border: Column, r: Column, g: Column, b: Column) -> Column:
    """The mean distance from a colour to its five nearest border pixels; a frequent colour counts up to five times."""
    gap = lambda z: (z["r"] - r) * (z["r"] - r) + (z["g"] - g) * (z["g"] - g) + (z["b"] - b) * (z["b"] - b)
    near = F.slice(F.array_sort(F.transform(border, lambda z: F.struct(gap(z).cast("long").alias("d"), z["n"].alias("n")))), 1, NEAREST)
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("k"))
    take = lambda s, z: F.least(z["n"], F.lit(NEAREST) - s["k"])
    return F.aggregate(near, zero, lambda s, z: F.struct((s["t"] + F.sqrt(z["d"].cast("double")) * take(s, z)).alias("t"), (s["k"] + take(s, z)).alias("k")), lambda s: s["t"] / F.nullif(s["k"], F.lit(0).cast("long")))


def cutout(px: DataFrame, threshold: float = DISTANCE) -> DataFrame:
    """(image_id, y, x, r, g, b, a, distance): opaque where a pixel is at least ``threshold`` from the border's colours. Images with too many of these have no rows."""
    if not math.isfinite(threshold) or threshold <= 0:
        raise ValueError("threshold must be positive and finite")
    rows = px.join(_border(px).where("border IS NOT NULL"), "image_id").withColumn("distance", _mean_distance(c("border"), *map(c, RGB)))
    return rows.select(*KEYS, *RGB, F.when(c("distance") >= threshold, 255).otherwise(0).alias("a"), "distance")


def cutout_verdict(px: DataFrame, threshold: float = DISTANCE) -> DataFrame:
    """(image_id, status, reason, foreground, spread, confidence) in millionths: whether an image's cutout can be used."""
    found = cutout(px, threshold).groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(c("a") > 0).alias("k"), F.sum(fixed(c("distance"))).alias("d"))
    all_ = _border(px).select("image_id", "spread", c("border").isNull().alias("many")).join(found, "image_id", "left")
    share = c("k") / c("n").cast("double")
    reason = F.when(c("spread") > SPREAD, "busy_border").when(c("many"), "too_many_border_colors").when((share < LEAST_SHARE) | (share > MOST_SHARE), "implausible_foreground").otherwise("")
    all_ = all_.withColumn("reason", reason)
    ok = c("reason") == ""
    margin = (c("d") / F.lit(1e6) / c("n") - F.lit(float(threshold))) / F.lit(255.0)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.lit(0.55) + margin + (F.lit(SPREAD) - c("spread"))))
    return all_.select("image_id", F.when(ok, "suggest").otherwise("abstain").alias("status"), "reason", F.when(c("reason").isin("", "implausible_foreground"), fixed(share)).alias("foreground"), fixed(c("spread")).alias("spread"), F.when(ok, fixed(sure)).otherwise(F.lit(0).cast("long")).alias("confidence"))


def on_white(rgba: DataFrame) -> DataFrame:
    """Pixels with an opacity a from 0 to 255 over white."""
    share = F.greatest(F.lit(0), F.least(F.lit(255), c("a"))) / F.lit(255.0)
    return rgba.select(*KEYS, *[channel(c(n) * share + F.lit(255.0) * (F.lit(1.0) - share)).alias(n) for n in RGB])


# ---- regions that could be traced
def region_features(px: DataFrame) -> DataFrame:
    """(image_id, component, area, luma_std, unique_ratio, compactness, fill_ratio, chroma) of the 4-connected regions of one colour.

    All pixels of such a region have its colour, so its luma has no spread and it holds one quantised colour.
    """
    same = lambda w: F.coalesce((F.lag("r").over(w) == c("r")) & (F.lag("g").over(w) == c("g")) & (F.lag("b").over(w) == c("b")), F.lit(False)).cast("int")
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    # an inner side is one of two pixels: both lose it from their outline
    rows = K.colour_regions(px).withColumn("inner", same(row)).withColumn("inner", c("inner") + same(column))
    s = rows.groupBy("image_id", "component").agg(F.count("*").alias("area"), (F.count("*") * 4 - F.sum("inner") * 2).alias("outline"), ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("box"), F.max(F.greatest(*RGB) - F.least(*RGB)).alias("chroma"))
    one = F.lit(1.0)
    return s.select(
        "image_id", "component", "area", F.lit(0.0).alias("luma_std"), (one / c("area")).alias("unique_ratio"), F.least(one, F.lit(4.0 * math.pi) * c("area") / (c("outline") * c("outline"))).alias("compactness"),
        F.least(one, c("area") / c("box").cast("double")).alias("fill_ratio"), (c("chroma") / F.lit(255.0)).alias("chroma"),
    )


def traceable(features: DataFrame, exemplars: Sequence[tuple[str, tuple[float, ...]]], least: float = 0.55) -> DataFrame:
    """``features`` with status, label and similarity to the nearest exemplar (the first of equals); what is far from all or nearest to a photo_texture abstains."""
    names = ["luma_std", "unique_ratio", "compactness", "fill_ratio", "chroma"]
    far = lambda p: F.sqrt(sum(((c(n) - F.lit(float(v))) * (c(n) - F.lit(float(v))) for n, v in zip(names, p, strict=True)), F.lit(0.0)))
    best = F.array_min(F.array(*[F.struct(far(p).alias("far"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(exemplars)]))
    rows = features.withColumn("__best", best).withColumn("similarity", F.greatest(F.lit(0.0), F.lit(1.0) - c("__best.far") / F.lit(math.sqrt(len(names)))))
    ok = (c("similarity") >= least) & (c("__best.name") != "photo_texture")
    return rows.withColumn("label", c("__best.name")).withColumn("status", F.when(ok, "suggest").otherwise("abstain")).withColumn("confidence", F.when(ok, F.least(F.lit(0.96), c("similarity"))).otherwise(c("similarity"))).drop("__best")
