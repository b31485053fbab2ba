"""Edit stacks and recipes, tone and colour conversions, similarity of images and seam verdicts."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.numeric import channel, luma_scaled
from quillstone.operators import raster as R
from quillstone.operators.raster import KEYS, RGB

c = F.col
#: Operators that a recipe may name.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "grayscale": R.grayscale, "sepia": R.sepia, "invert": R.invert, "brightness_contrast": R.brightness_contrast, "saturation": R.saturation, "tint": R.tint, "threshold": R.threshold,
    "transform": R.transform, "pad_extent": R.pad_extent, "resample_box": R.resample_box, "resample_nearest": R.resample_nearest, "sharpen": R.sharpen, "box_blur": R.box_blur,
}


@dataclass
class EditStack:
    """An ordered list of steps with undo and redo. Applying it only adds to the plan, so nothing runs until rows are asked for."""

    steps: list[tuple[str, dict]] = field(default_factory=list)
    undone: list[tuple[str, dict]] = field(default_factory=list)

    def push(self, name: str, /, **options) -> EditStack:
        if name not in STEPS:
            raise ValueError(f"unknown step {name}; known: {', '.join(sorted(STEPS))}")
        self.steps.append((name, options))
        self.undone.clear()
        return self

    def undo(self) -> bool:
        if self.steps:
            self.undone.append(self.steps.pop())
            return True
        return False

    def redo(self) -> bool:
        if self.undone:
            self.steps.append(self.undone.pop())
            return True
        return False

    def apply(self, px: DataFrame) -> DataFrame:
        for name, options in self.steps:
            px = STEPS[name](px, **options)
        return px

    def to_recipe(self) -> str:
        return json.dumps([{"step": n, "options": o} for n, o in self.steps])

    @classmethod
    def from_recipe(cls, recipe: str) -> EditStack:
        stack = cls()
        for step in json.loads(recipe):
            if set(step) != {"step", "options"}:
                raise ValueError("a recipe's steps have a step and its options")
            stack.push(step["step"], **step["options"])
        return stack


def gaussian_kernel(radius: int = 1, sigma: float = 1.0) -> list[list[float]]:
    side = range(-radius, radius + 1)
    return [[math.exp(-(x * x + y * y) / (2.0 * sigma * sigma)) for x in side] for y in side]


def gaussian_blur(px: DataFrame, radius: int = 1, sigma: float = 1.0) -> DataFrame:
    return R.convolve(px, gaussian_kernel(radius, sigma))


def auto_gamma(px: DataFrame, target: float = 128.0) -> DataFrame:
    """Each image's channels raised to the power that brings its mean luma to ``target``, between 0.2 and 5; black and white images stay."""
    mean = px.groupBy("image_id").agg((F.sum(luma_scaled(c("r"), c("g"), c("b")).cast("long")) / F.count("*") / F.lit(2_550_000.0)).alias("mean"))
    gamma = F.when((c("mean") <= 0) | (c("mean") >= 1), F.lit(1.0)).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(5.0), F.lit(math.log(target / 255.0)) / F.ln(F.when((c("mean") > 0) & (c("mean") < 1), c("mean"))))))
    both = px.join(mean.select("image_id", gamma.alias("gamma")), "image_id")
    return both.select(*KEYS, *[channel(F.lit(255.0) * F.pow(c(n) / F.lit(255.0), c("gamma"))).alias(n) for n in RGB])


def lab(px: DataFrame) -> DataFrame:
    """(image_id, y, x, l, a, b_) of sRGB colours under D65, in thousandths as whole numbers."""
    line = lambda n: F.when(c(n) / F.lit(255.0) <= 0.04045, c(n) / F.lit(255.0) / F.lit(12.92)).otherwise(F.pow((c(n) / F.lit(255.0) + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))
    flat = px.select(*KEYS, *[line(n).alias(n) for n in RGB])
    sums = {"fx": ((0.4124564, 0.3575761, 0.1804375), 0.95047), "fy": ((0.2126729, 0.7151522, 0.0721750), 1.0), "fz": ((0.0193339, 0.1191920, 0.9503041), 1.08883)}
    bend = lambda t: F.when(t > (6.0 / 29.0) ** 3, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t / F.lit(3.0 * (6.0 / 29.0) ** 2) + F.lit(4.0 / 29.0))
    flat = flat.withColumns({k: bend((c("r") * F.lit(w[0]) + c("g") * F.lit(w[1]) + c("b") * F.lit(w[2])) / F.lit(white)) for k, (w, white) in sums.items()})
    whole = lambda v: F.rint(v * F.lit(1000.0)).cast("long")
    return flat.select(*KEYS, whole(F.lit(116.0) * c("fy") - F.lit(16.0)).alias("l"), whole(F.lit(500.0) * (c("fx") - c("fy"))).alias("a"), whole(F.lit(200.0) * (c("fy") - c("fz"))).alias("b_"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, ssim, psnr): the global structural similarity in millionths and the peak signal-to-noise ratio in thousandths of a decibel (999000 if equal)."""
    both = a.join(b.select(*KEYS, *[c(n).alias(f"o{n}") for n in RGB]), list(KEYS))
    la, lb = luma_scaled(c("r"), c("g"), c("b")).cast("long"), luma_scaled(c("or"), c("og"), c("ob")).cast("long")
    squares = sum((c(n) - c(f"o{n}")) * (c(n) - c(f"o{n}")) for n in RGB)
    s = both.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(la).alias("a"), F.sum(lb).alias("b"), F.sum(la * la).alias("aa"), F.sum(lb * lb).alias("bb"), F.sum(la * lb).alias("ab"), F.sum(squares).alias("e"))
    n = c("n").cast("double")
    mean = lambda x, unit: c(x) / n / F.lit(unit)
    s = s.withColumns({"ma": mean("a", 1e4), "mb": mean("b", 1e4)}).withColumns({"va": mean("aa", 1e8) - c("ma") * c("ma"), "vb": mean("bb", 1e8) - c("mb") * c("mb"), "cov": mean("ab", 1e8) - c("ma") * c("mb")})
    c1, c2 = F.lit((0.01 * 255.0) ** 2), F.lit((0.03 * 255.0) ** 2)
    ssim = (F.lit(2.0) * c("ma") * c("mb") + c1) * (F.lit(2.0) * c("cov") + c2) / ((c("ma") * c("ma") + c("mb") * c("mb") + c1) * (c("va") + c("vb") + c2))
    mse = c("e") / n / F.lit(3.0)
    psnr = F.when(c("e") == 0, F.lit(999_000).cast("long")).otherwise(F.rint(F.lit(20_000.0) * F.log10(F.lit(255.0) / F.sqrt(F.when(c("e") > 0, mse)))).cast("long"))
    return s.select("image_id", F.rint(ssim * F.lit(1e6)).cast("long").alias("ssim"), psnr.alias("psnr"))


def seam_verdict(seams: DataFrame, side: int, worst: int = 3) -> DataFrame:
    """(image_id, axis, verdict): a seam where the mean step over the wrap is more than ``worst`` halves of the mean step inside."""
    seam, inner = c("seam_sum") * c("n") * 2, c("inner_sum") * side * worst
    return seams.select("image_id", "axis", F.when(seam > inner, "seam").otherwise("tileable").alias("verdict"))


def fill_route(mask: DataFrame) -> DataFrame:
    """(image_id, share, route): how a hole is filled: local up to an eighth of the image, patches up to a half, else by a model; empty holes need nothing."""
    per = mask.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("m").alias("k"))
    route = F.when(c("k") == 0, "none").when(c("k") * 8 <= c("n"), "local").when(c("k") * 2 <= c("n"), "patch").otherwise("model")
    return per.select("image_id", F.expr("k * 1000 div n").alias("share"), route.alias("route"))

