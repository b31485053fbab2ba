"""What selectors and specialists look at: features of whole images, sheets and frames of samples, as expressions over pixel and sample tables.

Pixel tables are (image_id, y, x, r, g, b). All sums are of whole numbers, so results don't depend on the order of rows; features are
shares from 0 to 1. Lists are collected for one image or one frame, whose size the caller bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.numeric import channel, luma_scaled
from quillstone.operators.editing import lab
from quillstone.operators.raster import sizes

c = F.col
#: Ten thousand times the greatest luma.
WHITE = 2_550_000
#: Cells of a sheet are at least so long, and a period counts from this strength on (in hundredths).
MIN_CELL, PERIOD_STRENGTH = 4, 50
#: Samples of a frame are whole numbers from -SAMPLE to SAMPLE; a frame has at least MIN_SAMPLES.
SAMPLE, MIN_SAMPLES = 10_000, 32
#: Cells along each side of an image whose perceptual hash is taken.
HASH_SIDE = 32


def _l() -> Column:
    return luma_scaled(c("r"), c("g"), c("b")).cast("long")


def _deviation(squares: Column, total: Column, n: Column) -> Column:
    """The standard deviation from exact sums."""
    mean = total.cast("double") / n
    return F.sqrt(F.greatest(F.lit(0.0), squares.cast("double") / n - mean * mean))


def _square(x: Column) -> Column:
    return F.sum((x * x).cast("decimal(38,0)"))


def flat_color(px: DataFrame) -> DataFrame:
    """(image_id, luma_std, chroma, chroma_std, unique_ratio, channel_span): how flat the colour of an image is. Fewer than four pixels give no row."""
    chroma = (F.greatest("r", "g", "b") - F.least("r", "g", "b")).cast("long")
    n = c("n").cast("double")
    s = px.groupBy("image_id").agg(
        F.count("*").alias("n"), F.sum(_l()).alias("l"), _square(_l()).alias("ll"), F.sum(chroma).alias("k"), _square(chroma).alias("kk"),
        F.count_distinct(F.expr("r div 16 * 256 + g div 16 * 16 + b div 16")).alias("colours"), F.greatest(*[F.max(x) - F.min(x) for x in "rgb"]).alias("span"),
    )
    return s.where("n >= 4").select(
        "image_id", F.least(F.lit(1.0), _deviation(c("ll"), c("l"), n) / F.lit(float(WHITE)) / F.lit(0.5)).alias("luma_std"), (c("k") / n / F.lit(255.0)).alias("chroma"),
        F.least(F.lit(1.0), _deviation(c("kk"), c("k"), n) / F.lit(255.0) / F.lit(0.5)).alias("chroma_std"), (c("colours") / n).alias("unique_ratio"), (c("span") / F.lit(255.0)).alias("channel_span"),
    )


def tone(px: DataFrame) -> DataFrame:
    """(image_id, p5, p25, p50, p75, p95, mean, std, range) of luma from 0 to 1; a quantile is the value at that share of the sorted pixels."""
    s = px.groupBy("image_id").agg(F.array_sort(F.collect_list(_l())).alias("v"), F.count("*").alias("n"), F.sum(_l()).alias("l"), _square(_l()).alias("ll"))
    white = F.lit(float(WHITE))
    at = lambda p: F.get("v", F.least(c("n") - 1, F.floor(F.lit(p) * c("n"))).cast("int")) / white
    return s.select(
        "image_id", *[at(p / 100.0).alias(f"p{p}") for p in (5, 25, 50, 75, 95)], (c("l") / c("n").cast("double") / white).alias("mean"),
        (_deviation(c("ll"), c("l"), c("n").cast("double")) / white).alias("std"), ((F.get("v", (c("n") - 1).cast("int")) - F.get("v", F.lit(0))) / white).alias("range"),
    )


def _steps(px: DataFrame) -> DataFrame:
    """Pixels with luma, the steps to the right and down (null at the edge)."""
    rows = px.withColumn("l", _l())
    right, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    return rows.withColumn("dx", F.abs(F.lead("l").over(right) - c("l"))).withColumn("dy", F.abs(F.lead("l").over(down) - c("l")))


def filtering(px: DataFrame) -> DataFrame:
    """(image_id, mean_grad, norm_var, edge_density, hf_energy, dyn_range, noise_proxy): what decides on a filter."""
    s = _steps(px).groupBy("image_id").agg(
        F.count("*").alias("n"), F.sum("l").alias("l"), _square(c("l")).alias("ll"), F.max("l").alias("top"), F.min("l").alias("low"), (F.coalesce(F.sum("dx"), F.lit(0)) + F.coalesce(F.sum("dy"), F.lit(0))).alias("steps"),
        (F.count("dx") + F.count("dy")).alias("pairs"), F.count_if((c("dx") > 300_000) & c("dy").isNotNull()).alias("edges"), F.count_if(c("dx").isNotNull() & c("dy").isNotNull()).alias("inner"),
    )
    one = F.lit(1.0)
    s = s.withColumn("mean_grad", F.least(one, c("steps") / F.lit(10_000.0) / F.greatest(F.lit(1), c("pairs")) / F.lit(64.0))).withColumn("norm_var", F.least(one, _deviation(c("ll"), c("l"), c("n").cast("double")) / F.lit(1_280_000.0)))
    s = s.withColumn("edge_density", F.least(one, c("edges") / F.greatest(F.lit(1), c("inner")))).withColumn("hf_energy", F.least(one, (c("mean_grad") * 1.5 + c("edge_density")) / 2.0))
    s = s.withColumn("dyn_range", F.least(one, (c("top") - c("low")) / F.lit(float(WHITE)))).withColumn("noise_proxy", F.greatest(F.lit(0.0), F.least(one, (c("mean_grad") - c("edge_density") * 0.8) * 1.2)))
    return s.select("image_id", "mean_grad", "norm_var", "edge_density", "hf_energy", "dyn_range", "noise_proxy")


def thresholding(px: DataFrame) -> DataFrame:
    """(image_id, norm_mean, norm_var, bimodality, grad_density): what decides on a threshold; peaks are those of a histogram of 16 bins."""
    rows = _steps(px)
    bins = rows.groupBy("image_id", F.least(F.lit(15), F.expr("l div 160000")).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("l").alias("l"), _square(c("l")).alias("ll"), F.sum("dx").alias("dx"), F.count("dx").alias("pairs"))
    s = bins.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("ll").alias("ll"), F.coalesce(F.sum("dx"), F.lit(0)).alias("dx"), F.sum("pairs").alias("pairs"))
    held = lambda i: F.coalesce(c("h")[i], F.lit(0))
    peaks = F.size(F.filter(F.sequence(F.lit(1), F.lit(14)), lambda i: (held(i) > held(i - 1)) & (held(i) > held(i + 1))))
    one = F.lit(1.0)
    return s.select(
        "image_id", (c("l") / c("n").cast("double") / F.lit(10_000.0) / F.lit(255.0)).alias("norm_mean"), F.least(one, _deviation(c("ll"), c("l"), c("n").cast("double")) / F.lit(1_280_000.0)).alias("norm_var"),
        F.least(one, peaks / F.lit(3.0)).alias("bimodality"), F.least(one, c("dx") / F.lit(10_000.0) / F.greatest(F.lit(1), c("pairs")) / F.lit(48.0)).alias("grad_density"),
    )


def chosen(rows: DataFrame, features: list[str], presets: list[tuple[str, tuple[float, ...]]], least: float, most: float) -> DataFrame:
    """``rows`` with preset (the nearest, the first of equally near ones) and confidence: one less half the distance, held between ``least`` and ``most``."""
    far = lambda p: F.sqrt(sum(((c(f) - F.lit(v)) * (c(f) - F.lit(v)) for f, v in zip(features, p, strict=True)), F.lit(0.0)))
    best = F.array_min(F.array(*[F.struct(far(p).alias("far"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(presets)]))
    rows = rows.withColumn("best", best)
    return rows.withColumn("preset", c("best.name")).withColumn("confidence", F.greatest(F.lit(least), F.least(F.lit(most), F.lit(1.0) - c("best.far") / F.lit(2.0)))).drop("best")


def threshold_strategy(features: DataFrame, patterns: list[tuple[str, tuple[float, ...]]]) -> DataFrame:
    """(image_id, strategy, confidence): the strategy of the nearest pattern; an image without contrast abstains with confidence 0."""
    found = chosen(features, ["norm_mean", "norm_var", "bimodality", "grad_density"], patterns, 0.5, 0.96)
    flat = (c("norm_var") < 0.01) | (c("preset") == "abstain")
    return found.select("image_id", F.when(flat, "abstain").otherwise(c("preset")).alias("strategy"), F.when(flat, F.lit(0.0)).otherwise(c("confidence")).alias("confidence"))


def perceptual_hash(px: DataFrame, scale: int = 1 << 15) -> DataFrame:
    """(image_id, hash, hex): 63 bits, set where a low frequency of the 32 x 32 cosine transform is above the median.

    Cosines are rounded to multiples of 1 / ``scale``, so sums are whole numbers and the same on every machine. The 32 x 32 cells of the box mean are
    never written out: an axis of at least 32 pixels is cut into cells, one of fewer repeats its pixels, whose cosines are summed beforehand.
    """
    side = HASH_SIDE
    cosine = [[round(scale * math.cos((2 * i + 1) * u * math.pi / 64)) for i in range(side)] for u in range(8)]
    own = lambda n, at: [i for i in range(side) if i * n // side == at]  # noqa: E731  cells that a place of an axis of n fills
    rows = [(n, at, [sum(cosine[u][i] for i in own(n, at)) for u in range(8)]) for n in range(1, side + 1) for at in range(n)]
    table = F.broadcast(px.sparkSession.createDataFrame(rows, "n int, at int, t array<bigint>"))  # 528 rows, a constant
    # the cell that holds a pixel is the last that begins at or before it
    cell = lambda at, n: F.when(c(n) >= side, F.expr(f"(({at} + 1) * {side}L - 1) div {n}")).otherwise(c(at)).cast("int")
    sized = px.join(sizes(px), "image_id").select("image_id", cell("y", "h").alias("y"), cell("x", "w").alias("x"), F.least("h", F.lit(side)).cast("int").alias("h"), F.least("w", F.lit(side)).cast("int").alias("w"), "r", "g", "b")
    tiny = sized.groupBy("image_id", "h", "w", "y", "x").agg(*[channel(F.sum(n) / F.count("*")).alias(n) for n in "rgb"]).withColumn("l", _l())
    across = tiny.join(table.select(c("n").alias("w"), c("at").alias("x"), "t"), ["w", "x"])
    across = across.groupBy("image_id", "h", "y").agg(*[F.sum(c("l") * c("t")[v]).alias(f"p{v}") for v in range(8)])
    down = across.join(table.select(c("n").alias("h"), c("at").alias("y"), "t"), ["h", "y"])
    sums = down.groupBy("image_id").agg(*[F.sum(c(f"p{v}") * c("t")[u]).alias(f"s{u * 8 + v}") for u in range(8) for v in range(8) if u + v])
    zero = lambda n: F.lit(1.0) / F.sqrt(F.lit(2.0)) if n == 0 else F.lit(1.0)
    low = sums.select("image_id", F.array(*[zero(i // 8) * zero(i % 8) * c(f"s{i}").cast("double") for i in range(1, 64)]).alias("k"))
    low = low.withColumn("middle", F.array_sort("k")[31])
    bit = F.transform("k", lambda k, i: F.when(k > c("middle"), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(62) - i)).otherwise(F.lit(0).cast("long")))
    out = low.select("image_id", F.aggregate(bit, F.lit(0).cast("long"), lambda s, x: s + x).alias("hash"))
    return out.withColumn("hex", F.lpad(F.lower(F.hex("hash")), 16, "0"))


def delta_e(px: DataFrame, reference: tuple[int, int, int]) -> DataFrame:
    """(image_id, y, x, delta): the distance in L*a*b* to a colour, in thousandths."""
    ref = px.sparkSession.createDataFrame([(0, 0, 0, *reference)], px.select("image_id", "y", "x", "r", "g", "b").schema)
    own = lab(ref).select(*[c(n).alias(f"r{n}") for n in ("l", "a", "b_")])
    both = lab(px).crossJoin(F.broadcast(own))  # one row
    return both.select("image_id", "y", "x", F.rint(F.sqrt(sum((((c(n) - c(f"r{n}")) * (c(n) - c(f"r{n}"))).cast("double") for n in ("l", "a", "b_")), F.lit(0.0)))).cast("long").alias("delta"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Channels of a hue in degrees (any number), saturation and value from 0 to 1."""
    h = F.pmod(h.cast("double"), F.lit(360.0))
    hold = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))
    v = hold(v)
    k = v * hold(s)
    x = k * (F.lit(1.0) - F.abs(F.pmod(h / F.lit(60.0), F.lit(2.0)) - F.lit(1.0)))
    sextant = F.floor(h / F.lit(60.0)).cast("int")
    parts = ((k, x, 0), (x, k, 0), (0, k, x), (0, x, k), (x, 0, k), (k, 0, x))
    pick = lambda i: F.element_at(F.array(*[p[i] if isinstance(p[i], Column) else F.lit(0.0) for p in parts]), sextant + 1)
    return tuple(channel((pick(i) + (v - k)) * F.lit(255.0)) for i in range(3))


def presence(mask: DataFrame) -> DataFrame:
    """(image_id, axis, place, present) of a mask (image_id, y, x, m): whether a column (x) or a row (y) holds any foreground."""
    side = lambda a: mask.groupBy("image_id", c(a).alias("place")).agg(F.max("m").cast("int").alias("present")).select("image_id", F.lit(a).alias("axis"), "place", "present")
    return side("x").unionByName(side("y"))


def content_runs(profile: DataFrame) -> DataFrame:
    """(image_id, axis, first, last): the longest runs of places with content, ends included."""
    order = Window.partitionBy("image_id", "axis").orderBy("place")
    rows = profile.where("present > 0").withColumn("run", c("place") - F.row_number().over(order))
    return rows.groupBy("image_id", "axis", "run").agg(F.min("place").alias("first"), F.max("place").alias("last")).drop("run")


def cells_of_runs(profile: DataFrame) -> DataFrame:
    """(image_id, axis, cells, refusal): the cells that content runs show, or why they show none."""
    sizes = profile.groupBy("image_id", "axis").agg(F.count("*").alias("size"))
    runs = content_runs(profile).groupBy("image_id", "axis").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = sizes.join(runs, ["image_id", "axis"], "left").withColumn("n", F.coalesce(F.size("runs"), F.lit(0)).cast("long")).withColumn("n", F.greatest(c("n"), F.lit(0)))
    rows = rows.withColumn("cell", F.expr("size div greatest(n, 1)"))
    crosses = F.exists("runs", lambda r: r["last"] >= (F.floor(r["first"] / c("cell")) + 1) * c("cell"))
    refusal = F.when(c("n") < 2, "too_few_content_runs").when(c("size") % F.greatest(c("n"), F.lit(1)) != 0, "run_count_does_not_divide").when(c("cell") < MIN_CELL, "grid_too_small").when(crosses, "content_run_crosses_a_cell")
    return rows.withColumn("refusal", refusal).select("image_id", "axis", F.when(c("refusal").isNull(), c("n")).alias("cells"), F.coalesce("refusal", F.lit("")).alias("refusal"))


def cells_of_period(size: Column, period: Column, strength: Column) -> tuple[Column, Column]:
    """(cells, refusal) of a side by its period; strength in hundredths. No period, or a weak one, is one cell without a refusal."""
    none = period.isNull() | (strength < PERIOD_STRENGTH)
    refusal = F.when(none, "").when(period < MIN_CELL, "grid_too_small").when(size % F.greatest(period, F.lit(1)) != 0, "period_does_not_divide").otherwise("")
    return F.when(none | (refusal != ""), F.lit(1).cast("long")).otherwise(F.floor(size / F.greatest(period, F.lit(1))).cast("long")), refusal


def declared_cells(size: Column, cell: Column) -> tuple[Column, Column]:
    """(cells, refusal) of a side whose cell size the caller declares."""
    refusal = F.when(cell.isNull(), "nothing_declared").when(cell < MIN_CELL, "cell_too_small").when(size % cell != 0, "does_not_divide").otherwise("")
    return F.when(refusal == "", F.floor(size / cell).cast("long")), refusal


def flip_normals(px: DataFrame) -> DataFrame:
    """The normal map of the other handedness: green is the channel that flips."""
    return px.select("image_id", "y", "x", "r", (F.lit(255) - c("g")).alias("g"), "b")


def lighting(px: DataFrame) -> DataFrame:
    """(image_id, clipped, variation): the share of pixels whose mean reaches 0.999, and the relative spread of luma, one at most."""
    s = px.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if((c("r") + c("g") + c("b")) * 1000 >= 999 * 765).alias("top"), F.sum(_l()).alias("l"), _square(_l()).alias("ll"))
    n = c("n").cast("double")
    return s.select("image_id", (c("top") / n).alias("clipped"), F.when(c("l") <= 0, 0.0).otherwise(F.least(F.lit(1.0), _deviation(c("ll"), c("l"), n) / F.greatest(F.lit(1e-9), c("l") / n))).alias("variation"))


def power_of_two(extent: Column) -> Column:
    """The smallest power of two that holds a positive extent."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when(extent <= 1, 0).otherwise(F.length(F.bin((extent - 1).cast("long")))))


def sample_frames(series: DataFrame, length: int) -> DataFrame:
    """(series, frame, v): runs of ``length`` samples of (series, place, v) in order, held to the range; a short rest is left out."""
    order = Window.partitionBy("series").orderBy("place")
    rows = series.withColumn("at", F.row_number().over(order) - 1).withColumn("frame", F.floor(c("at") / length).cast("long"))
    held = F.greatest(F.lit(-SAMPLE), F.least(F.lit(SAMPLE), c("v"))).cast("long")
    rows = rows.groupBy("series", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", held.alias("v")))), lambda s: s["v"]).alias("v"))
    return rows.where(F.size("v") == length)


def _frame(frames: DataFrame) -> DataFrame:
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    n = F.size("v")
    steps = F.sequence(F.lit(1), n - 1)
    rows = frames.withColumn("n", n.cast("double")).withColumn("ss", total(F.transform("v", lambda x: x * x)))
    rows = rows.withColumn("crossings", F.size(F.filter(steps, lambda i: (F.get("v", i - 1) >= 0) != (F.get("v", i) >= 0)))).withColumn("jumps", F.size(F.filter(steps, lambda i: F.abs(F.get("v", i) - F.get("v", i - 1)) > 800)))
    lags = F.sequence(F.lit(8), F.least(F.lit(80), F.floor(n / 2).cast("int")) - 1)
    dot = lambda lag: total(F.transform(F.sequence(F.lit(0), n - lag - 1), lambda i: F.get("v", i) * F.get("v", i + lag)))
    best = F.array_max(F.transform(lags, lambda lag: dot(lag).cast("double") * c("n") / ((c("n") - lag) * c("ss").cast("double"))))
    rows = rows.withColumn("periodicity", F.when(c("ss") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), best))))
    return rows.withColumn("rms", F.sqrt(c("ss").cast("double") / c("n")) / F.lit(float(SAMPLE))).withColumn("peak", F.array_max(F.transform("v", F.abs)) / F.lit(float(SAMPLE)))


def voice(frames: DataFrame) -> DataFrame:
    """(series, frame, energy, zcr, periodicity, crest, high_ratio) of frames of at least 32 samples; periodicity is the best lag's correlation."""
    one = F.lit(1.0)
    return _frame(frames).select(
        "series", "frame", F.least(one, c("rms") / F.lit(0.35)).alias("energy"), F.least(one, c("crossings") / (c("n") - 1)).alias("zcr"), "periodicity",
        F.when(c("rms") < 1e-8, 0.0).otherwise(F.least(one, c("peak") / (F.greatest(c("rms"), F.lit(1e-9)) * 8.0))).alias("crest"), F.least(one, c("jumps") / (c("n") - 1)).alias("high_ratio"),
    )


def recording(frames: DataFrame) -> DataFrame:
    """(series, frame, energy, clipping, noise_floor, periodicity, zcr): the floor is the quietest of eight stretches of a frame."""
    one = F.lit(1.0)
    wide = F.greatest(F.lit(8), F.floor(F.size("v") / 8).cast("int"))
    quiet = F.array_min(F.transform(F.sequence(F.lit(0), F.size("v") - wide, wide), lambda s: F.aggregate(F.slice("v", s + 1, wide), F.lit(0).cast("long"), lambda a, x: a + x * x)))
    rows = _frame(frames).withColumn("floor", F.sqrt(quiet.cast("double") / wide) / F.lit(float(SAMPLE))).withColumn("clipped", F.size(F.filter("v", lambda x: F.abs(x) >= 9800)))
    return rows.select("series", "frame", F.least(one, c("rms") / F.lit(0.5)).alias("energy"), (c("clipped") / c("n")).alias("clipping"), F.least(one, c("floor") / F.lit(0.25)).alias("noise_floor"), "periodicity", F.least(one, c("crossings") / (c("n") - 1)).alias("zcr"))


def rhythm(rows: DataFrame) -> DataFrame:
    """(series, stress_ratio, iamb_ratio, trochee_ratio, duration_cv, final_lengthening, late_stress) of (series, place, stress, duration).

    Durations are positive whole numbers. A series of fewer than two syllables gives no row; without a stress ``late_stress`` is a half.
    """
    order = Window.partitionBy("series").orderBy("place")
    s = rows.withColumn("next", F.lead("stress").over(order)).withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    s = s.groupBy("series").agg(
        F.count("*").alias("n"), F.count_if("stress").alias("stressed"), F.sum(F.when(c("stress"), c("at"))).alias("late"), F.count_if(~c("stress") & c("next")).alias("iambs"), F.count_if(c("stress") & ~c("next")).alias("trochees"),
        F.sum("duration").alias("d"), _square(c("duration")).alias("dd"), F.max_by("duration", "at").alias("last"),
    ).where("n >= 2")
    n, one = c("n").cast("double"), F.lit(1.0)
    mean = c("d") / n
    return s.select(
        "series", (c("stressed") / n).alias("stress_ratio"), (c("iambs") / (n - 1)).alias("iamb_ratio"), (c("trochees") / (n - 1)).alias("trochee_ratio"), F.least(one, _deviation(c("dd"), c("d"), n) / mean).alias("duration_cv"),
        F.least(one, c("last") / (F.lit(2.0) * mean)).alias("final_lengthening"), F.when(c("stressed") > 0, c("late") / c("stressed").cast("double") / (n - 1)).otherwise(0.5).alias("late_stress"),
    )
