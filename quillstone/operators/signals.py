"""Ordered operators on series: running sums, progress curves, holds, peaks, frames and lags.

A series table is (series, place, v): v an integer, place its order in the series, which is the key that rows are spread by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLES = 7
# Reference progress curves at seven even places, in thousandths; the names are those of easings.
CURVES = {
    "linear": (0, 167, 333, 500, 667, 833, 1000),
    "ease-in": (0, 28, 111, 250, 444, 694, 1000),
    "ease-out": (0, 306, 556, 750, 889, 972, 1000),
    "ease-in-out": (0, 74, 259, 500, 741, 926, 1000),
    "overshoot": (0, 241, 630, 950, 1060, 1020, 1000),
}


def _order():
    return Window.partitionBy("series").orderBy("place")


def _whole():
    return Window.partitionBy("series")


def cumulative(s: DataFrame) -> DataFrame:
    """(series, i, total): running totals; i counts from 1."""
    return s.select("series", F.row_number().over(_order()).alias("i"), F.sum("v").over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("total"))


def progress(s: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(series, k, reached): the running total at even places, linearly interpolated, in thousandths of the whole; 0 where that is not positive."""
    totals = cumulative(s)
    origin = totals.select("series").distinct().select("series", F.lit(0).alias("i"), F.lit(0).cast("long").alias("total"))
    totals = totals.unionByName(origin).withColumns({"last": F.max("i").over(_whole()), "next": F.lead("total").over(Window.partitionBy("series").orderBy("i"))})
    span = F.max(F.when(F.col("i") == F.col("last"), F.col("total"))).over(_whole())
    totals = totals.withColumn("span", span).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    steps = samples - 1
    at = totals.where(F.expr(f"k * last div {steps}") == F.col("i"))
    rest = F.col("k") * F.col("last") % steps
    value = F.col("total") * (F.lit(steps) - rest) + F.coalesce("next", "total") * rest
    scaled = F.when(F.col("span") > 0, F.least(F.lit(1500.0), F.greatest(F.lit(0.0), F.floor(value * 1000 / (F.col("span") * steps))))).otherwise(F.lit(0.0))
    return at.select("series", "k", scaled.cast("long").alias("reached"))


def easing(curves: DataFrame) -> DataFrame:
    """(series, verdict, error): the named curve of least squared error in thousandths, or a rule where none is near.

    ``curves`` is (series, k, reached). Above 1020 is an overshoot; an error of at most 50 (root mean square) names the curve, the first of
    equals in the listed order; else the middle decides between ease-in, ease-out and ease-in-out.
    """
    per = curves.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("k", "reached"))).alias("c"), F.max("reached").alias("top"))
    at = lambda i: F.get("c", F.lit(i))["reached"]
    errors = []
    for i, (name, curve) in enumerate(CURVES.items()):
        total = sum((at(j) - v) * (at(j) - v) for j, v in enumerate(curve))
        errors.append(F.struct(total.cast("long").alias("e"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    best = F.array_min(F.array(*errors))
    middle = at(SAMPLES // 2)
    rule = F.when(middle < 350, "ease-in").when(middle > 650, "ease-out").otherwise("ease-in-out")
    verdict = F.when(F.col("top") > 1020, "overshoot").when(best["e"] <= SAMPLES * 2500, best["name"]).otherwise(rule)
    return per.select("series", verdict.alias("verdict"), best["e"].alias("error"))


def holds(s: DataFrame, twentieths: int = 1) -> DataFrame:
    """(series, start, length): runs of values below that many twentieths of the series' greatest; start counts from 0."""
    low = s.select("series", (F.row_number().over(_order()) - 1).alias("i"), "v", F.max("v").over(_whole()).alias("top")).where(F.col("v") * 20 < F.col("top") * twentieths)
    run = F.col("i") - F.row_number().over(Window.partitionBy("series").orderBy("i"))
    return low.withColumn("run", run).groupBy("series", "run").agg(F.min("i").alias("start"), F.count("*").alias("length")).drop("run")


def peaks(s: DataFrame) -> DataFrame:
    """(series, peak): the first place, from 0, of the greatest value."""
    rows = s.select("series", (F.row_number().over(_order()) - 1).alias("i"), "v")
    return rows.groupBy("series").agg((-F.max(F.struct("v", (-F.col("i")).alias("i")))["i"]).alias("peak"))


def variation(s: DataFrame) -> DataFrame:
    """(series, variation): the coefficient of variation squared, in millionths, at most one million; 0 for a mean that is not positive."""
    per = s.groupBy("series").agg(F.count("*").alias("n"), F.sum("v").alias("t"), F.sum(F.col("v").cast("decimal(19,0)") * F.col("v")).alias("q"))
    n, t, q = (F.col(x).cast("decimal(19,0)") for x in ("n", "t", "q"))
    value = F.floor((n * q - t * t) * 1_000_000 / (t * t))
    return per.select("series", F.when(F.col("t") > 0, F.least(F.lit(1_000_000), value).cast("long")).otherwise(F.lit(0).cast("long")).alias("variation"))


def frames(s: DataFrame, size: int) -> DataFrame:
    """(series, frame, n, energy, crossings, clipped): whole frames of ``size`` values; a last part frame is dropped.

    energy is the sum of squares, crossings the changes of sign inside the frame (zero counts as positive), clipped the values of at least 20,000.
    """
    rows = s.select("series", (F.row_number().over(_order()) - 1).alias("i"), "v", F.count("*").over(_whole()).alias("all"))
    rows = rows.withColumn("frame", F.floor(F.col("i") / size)).where((F.col("frame") + 1) * size <= F.col("all"))
    before = F.lag("v").over(Window.partitionBy("series", "frame").orderBy("i"))
    rows = rows.withColumn("turn", ((F.col("v") >= 0) != (before >= 0)))
    return rows.groupBy("series", "frame").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("energy"), F.count_if("turn").alias("crossings"), F.count_if(F.abs("v") >= 20_000).alias("clipped"))


def activity(framed: DataFrame, floor: int, most_crossings: int) -> DataFrame:
    """``frames`` with speech: enough energy for each value and not too many crossings."""
    return framed.withColumn("speech", (F.col("energy") >= F.col("n") * floor) & (F.col("crossings") <= most_crossings))


def report(active: DataFrame) -> DataFrame:
    """(series, frames, speech_frames, quality): clipped, silent, mixed or speech, by frames."""
    per = active.groupBy("series").agg(F.count("*").alias("frames"), F.count_if("speech").alias("speech_frames"), F.sum("clipped").alias("clipped"), F.sum("n").alias("values"))
    quality = F.when(F.col("clipped") * 200 > F.col("values"), "clipped").when(F.col("speech_frames") == 0, "silent").when(F.col("speech_frames") * 2 < F.col("frames"), "mixed").otherwise("speech")
    return per.select("series", "frames", "speech_frames", quality.alias("quality"))


def framed_vote(active: DataFrame) -> DataFrame:
    """(series, label): what most frames say; a tie abstains."""
    per = active.groupBy("series").agg(F.count_if("speech").alias("yes"), F.count_if(~F.col("speech")).alias("no"))
    return per.select("series", F.when(F.col("yes") > F.col("no"), "speech").when(F.col("yes") < F.col("no"), "silence").otherwise("abstain").alias("label"))


def autocorrelation(s: DataFrame, lags: int) -> DataFrame:
    """(series, lag, products, n): sums of v[i] * v[i + lag] for lags 1 to ``lags``, over the pairs there are."""
    shifted = s.select("series", "v", *[F.lead("v", k).over(_order()).alias(f"v{k}") for k in range(1, lags + 1)])
    pairs = shifted.select("series", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("v") * F.col(f"v{k}")).alias("p")) for k in range(1, lags + 1)])).alias("z")).where("z.p is not null")
    return pairs.groupBy("series", F.col("z.lag").alias("lag")).agg(F.sum("z.p").alias("products"), F.count("*").alias("n"))


def period(correlation: DataFrame) -> DataFrame:
    """(series, period): the lag of the greatest mean product, the smallest of equals, if that is positive; else 0."""
    best = correlation.groupBy("series").agg(F.max(F.struct(F.expr("products div n").alias("m"), (-F.col("lag")).alias("l"))).alias("b"))
    return best.select("series", F.when(F.col("b.m") > 0, -F.col("b.l")).otherwise(0).alias("period"))
