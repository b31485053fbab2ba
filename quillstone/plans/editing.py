"""Edit stacks, colour spaces, similarity and verdicts on the images of the events table, the list of queries, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators import editing as E
from quillstone.operators import raster as R
from quillstone.plans.raster import _SEAM, LUM, PX, SECOND, _kernel, ch, d, pixels, second, three

RECIPE = E.EditStack().push("sepia", strength=0.5).push("transform", name="flip_horizontal").push("brightness_contrast", brightness=0.05, contrast=0.1).to_recipe()


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.EditStack.from_recipe(RECIPE).apply(pixels(spark, sf_dir))


QUERIES = {
    "edit_stack": stack, "raster_gaussian_blur": lambda s, f: E.gaussian_blur(pixels(s, f)), "raster_auto_gamma": lambda s, f: E.auto_gamma(pixels(s, f)), "raster_lab": lambda s, f: E.lab(pixels(s, f)),
    "raster_similarity": lambda s, f: E.similarity(pixels(s, f), second(s, f)), "raster_seam_verdict": lambda s, f: E.seam_verdict(R.seam(pixels(s, f)), 10), "fill_route": lambda s, f: E.fill_route(R.mask_of(pixels(s, f), 170)),
}

_SCALE = R.contrast_scale(0.1)
_SEP = lambda n: f"({R.SEPIA['rgb'.index(n)][0]} * r + {R.SEPIA['rgb'.index(n)][1]} * g + {R.SEPIA['rgb'.index(n)][2]} * b) / {d(1000.0)}"
_LIN = lambda n: f"(CASE WHEN {n} / {d(255.0)} <= {d(0.04045)} THEN {n} / {d(255.0)} / {d(12.92)} ELSE pow(({n} / {d(255.0)} + {d(0.055)}) / {d(1.055)}, {d(2.4)}) END)"
_XYZ = lambda w, white: f"(lr * {d(w[0])} + lg * {d(w[1])} + lb * {d(w[2])}) / {d(white)}"
_BEND = lambda t: f"CASE WHEN {t} > {d((6.0 / 29.0) ** 3)} THEN pow({t}, {d(1.0 / 3.0)}) ELSE {t} / {d(3.0 * (6.0 / 29.0) ** 2)} + {d(4.0 / 29.0)} END"
_W = lambda x: f"CAST(round_even(({x}) * {d(1000.0)}, 0) AS BIGINT)"
_KERNEL = E.gaussian_kernel()
ORACLES = {
    "edit_stack": f"WITH {PX}, a AS (SELECT image_id, y, 9 - x AS x, {three(lambda n: ch(f'{n} + ({ch(_SEP(n))} - {n}) * {d(0.5)}'))} FROM px) SELECT image_id, y, x, {three(lambda n: ch(f'{d(_SCALE)} * ({n} + {d(0.05 * 255.0)} - {d(128.0)}) + {d(128.0)}'))} FROM a",
    "raster_gaussian_blur": _kernel(_KERNEL, sum(v for row in _KERNEL for v in row)),
    "raster_auto_gamma": f"WITH {PX}, m AS (SELECT image_id, sum({LUM}) / CAST(count(*) AS DOUBLE) / {d(2_550_000.0)} AS m FROM px GROUP BY 1), k AS (SELECT image_id, CASE WHEN m <= 0 OR m >= 1 THEN {d(1.0)} ELSE greatest({d(0.2)}, least({d(5.0)}, {d(math.log(128.0 / 255.0))} / ln(m))) END AS k FROM m) SELECT image_id, y, x, {three(lambda n: ch(f'{d(255.0)} * pow({n} / {d(255.0)}, k)'))} FROM px JOIN k USING (image_id)",
    "raster_lab": f"WITH {PX}, l AS (SELECT image_id, y, x, {_LIN('r')} AS lr, {_LIN('g')} AS lg, {_LIN('b')} AS lb FROM px), t AS (SELECT image_id, y, x, {_XYZ((0.4124564, 0.3575761, 0.1804375), 0.95047)} AS tx, {_XYZ((0.2126729, 0.7151522, 0.0721750), 1.0)} AS ty, {_XYZ((0.0193339, 0.1191920, 0.9503041), 1.08883)} AS tz FROM l), f AS (SELECT image_id, y, x, {_BEND('tx')} AS fx, {_BEND('ty')} AS fy, {_BEND('tz')} AS fz FROM t) SELECT image_id, y, x, {_W(f'{d(116.0)} * fy - {d(16.0)}')} AS l, {_W(f'{d(500.0)} * (fx - fy)')} AS a, {_W(f'{d(200.0)} * (fy - fz)')} AS b_ FROM f",
    "raster_similarity": f"WITH {PX}, {SECOND}, j AS (SELECT image_id, CAST({LUM} AS BIGINT) AS a, CAST(2126 * o_r + 7152 * o_g + 722 * o_b AS BIGINT) AS b, (r - o_r) * (r - o_r) + (g - o_g) * (g - o_g) + (b - o_b) * (b - o_b) AS e FROM px JOIN o USING (image_id, y, x)), s AS (SELECT image_id, CAST(count(*) AS DOUBLE) AS n, sum(e) AS e, CAST(sum(a) AS DOUBLE) / count(*) / {d(1e4)} AS ma, CAST(sum(b) AS DOUBLE) / count(*) / {d(1e4)} AS mb, CAST(sum(a * a) AS DOUBLE) / count(*) / {d(1e8)} AS aa, CAST(sum(b * b) AS DOUBLE) / count(*) / {d(1e8)} AS bb, CAST(sum(a * b) AS DOUBLE) / count(*) / {d(1e8)} AS ab FROM j GROUP BY 1) SELECT image_id, CAST(round_even((2 * ma * mb + {d((0.01 * 255.0) ** 2)}) * (2 * (ab - ma * mb) + {d((0.03 * 255.0) ** 2)}) / ((ma * ma + mb * mb + {d((0.01 * 255.0) ** 2)}) * (aa - ma * ma + (bb - mb * mb) + {d((0.03 * 255.0) ** 2)})) * {d(1e6)}, 0) AS BIGINT) AS ssim, CASE WHEN e = 0 THEN 999000 ELSE CAST(round_even({d(20000.0)} * log10({d(255.0)} / sqrt(CAST(e AS DOUBLE) / n / {d(3.0)})), 0) AS BIGINT) END AS psnr FROM s",
    "raster_seam_verdict": f"SELECT image_id, axis, CASE WHEN seam_sum * n * 2 > inner_sum * 30 THEN 'seam' ELSE 'tileable' END AS verdict FROM ({_SEAM})",
    "fill_route": f"WITH {PX}, m AS (SELECT image_id, count(*) AS n, count(*) FILTER ({LUM} >= 1700000) AS k FROM px GROUP BY 1) SELECT image_id, k * 1000 // n AS share, CASE WHEN k = 0 THEN 'none' WHEN k * 8 <= n THEN 'local' WHEN k * 2 <= n THEN 'patch' ELSE 'model' END AS route FROM m",
}
