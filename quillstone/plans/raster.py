"""Raster queries: the events table read as 10 x 10 images of 100 events each, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import raster as R

SIDE = 10
PALETTE = ((0, 0, 0), (255, 255, 255), (200, 40, 40), (40, 160, 60), (50, 70, 200), (230, 200, 60))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    at = F.col("event_id") % 100
    return e.select(
        F.floor(F.col("event_id") / 100).cast("long").alias("image_id"), F.floor(at / SIDE).cast("int").alias("y"), (at % SIDE).cast("int").alias("x"),
        ((F.col("event_id") * 3 + F.col("user_id") * 7) % 256).cast("int").alias("r"), ((F.col("event_id") * 5 + F.floor("value")) % 256).cast("int").alias("g"),
        ((F.col("event_id") * 11 + F.length("event_type") * 31) % 256).cast("int").alias("b"),
    )


PX = """px AS (SELECT event_id // 100 AS image_id, CAST(event_id % 100 // 10 AS INT) AS y, CAST(event_id % 10 AS INT) AS x,
 CAST((event_id * 3 + user_id * 7) % 256 AS INT) AS r, CAST((event_id * 5 + CAST(floor(value) AS BIGINT)) % 256 AS INT) AS g,
 CAST((event_id * 11 + length(event_type) * 31) % 256 AS INT) AS b FROM events)"""
LUM = "(2126 * r + 7152 * g + 722 * b)"
SIZED = "s AS (SELECT *, max(y) OVER (PARTITION BY image_id) + 1 AS h, max(x) OVER (PARTITION BY image_id) + 1 AS w FROM px)"


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def ch(x: str) -> str:
    return f"CAST(greatest(0, least(255, round_even(CAST({x} AS DOUBLE), 0))) AS INT)"


def three(f) -> str:
    return ", ".join(f"{f(n)} AS {n}" for n in "rgb")


def point(f, extra: str = "px") -> str:
    return f"WITH {PX} SELECT image_id, y, x, {three(f)} FROM {extra}"


def image(op, *args, **kwargs):
    return lambda spark, sf_dir: op(pixels(spark, sf_dir), *args, **kwargs)


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image after the next one, as an overlay for this one; the last images get none."""
    return pixels(spark, sf_dir).withColumn("image_id", F.col("image_id") - 2).where("image_id >= 0")


SECOND = "o AS (SELECT image_id - 2 AS image_id, y, x, r AS o_r, g AS o_g, b AS o_b FROM px)"
LUMA = f"{LUM} / {d(10000.0)}"
_SCALE = R.contrast_scale(0.2)


def blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, over = pixels(spark, sf_dir), second(spark, sf_dir)
    out = None
    for mode in R.BLEND_MODES:
        part = R.composite(base, over, mode, opacity=0.5, offset=(1, 2)).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def _mode_sql(mode: str, n: str) -> str:
    b, s = f"({n} / {d(255.0)})", f"(o_{n} / {d(255.0)})"
    one, two = d(1.0), d(2.0)
    return {
        "over": s, "multiply": f"{b} * {s}", "screen": f"{one} - ({one} - {b}) * ({one} - {s})", "darken": f"least({b}, {s})", "lighten": f"greatest({b}, {s})",
        "overlay": f"CASE WHEN {b} < {d(0.5)} THEN {two} * {b} * {s} ELSE {one} - {two} * ({one} - {b}) * ({one} - {s}) END", "difference": f"abs({b} - {s})", "add": f"least({one}, {b} + {s})",
        "subtract": f"greatest({d(0.0)}, {b} - {s})", "color_dodge": f"CASE WHEN {s} >= {one} THEN {one} ELSE least({one}, {b} / ({one} - {s} + {d(1e-6)})) END", "soft_light": f"({one} - {two} * {s}) * {b} * {b} + {two} * {s} * {b}",
    }[mode]


def _blends_sql() -> str:
    both = f"WITH {PX}, {SECOND}, j AS (SELECT px.*, o_r, o_g, o_b FROM px LEFT JOIN o ON px.image_id = o.image_id AND px.y = o.y + 1 AND px.x = o.x + 2)"
    f = lambda mode: three(lambda n: f"CASE WHEN o_{n} IS NULL THEN {n} ELSE {ch(f'{n} + (({_mode_sql(mode, n)}) * {d(255.0)} - {n}) * {d(0.5)}')} END")
    return both + " UNION ALL ".join(f" SELECT image_id, y, x, {f(m)}, '{m}' AS mode FROM j" for m in R.BLEND_MODES)


def oblong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels of each image, as 5 rows of 20."""
    place = F.col("y") * SIDE + F.col("x")
    return pixels(spark, sf_dir).withColumn("place", place).select("image_id", F.floor(F.col("place") / 20).cast("int").alias("y"), (F.col("place") % 20).cast("int").alias("x"), "r", "g", "b")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, out = oblong(spark, sf_dir), None
    for name in ("flip_horizontal", "flip_vertical", "rotate_90", "rotate_180", "rotate_270"):
        part = R.transform(px, name).withColumn("turn", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_TURNS = {"flip_horizontal": ("y", "19 - x"), "flip_vertical": ("4 - y", "x"), "rotate_90": ("x", "4 - y"), "rotate_180": ("4 - y", "19 - x"), "rotate_270": ("19 - x", "y")}


def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, out = oblong(spark, sf_dir), None
    for i in range(1, 9):
        part = R.auto_orient(px, i).withColumn("orientation", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


_ORIENT = {1: ("y", "x"), 2: ("y", "19 - x"), 3: ("4 - y", "19 - x"), 4: ("4 - y", "x"), 5: ("x", "y"), 6: ("x", "4 - y"), 7: ("19 - x", "4 - y"), 8: ("19 - x", "y")}
_MOVED = lambda table, tag, quote: f"WITH {PX}, ob AS (SELECT image_id, CAST((y * 10 + x) // 20 AS INT) AS y, CAST((y * 10 + x) % 20 AS INT) AS x, r, g, b FROM px)" + " UNION ALL ".join(f" SELECT image_id, CAST({y} AS INT) AS y, CAST({x} AS INT) AS x, r, g, b, {quote}{k}{quote} AS {tag} FROM ob" for k, (y, x) in table.items())


def _kernel(kernel, div: float = 1.0, offset: float = 0.0) -> str:
    k = len(kernel) // 2
    rows = ", ".join(f"({i - k}, {j - k}, {d(float(v))})" for i, row in enumerate(kernel) for j, v in enumerate(row))
    near = f"k(dy, dx, wt) AS (VALUES {rows}), n AS (SELECT s.image_id, s.y, s.x, wt, p.r, p.g, p.b FROM s CROSS JOIN k JOIN px p ON p.image_id = s.image_id AND p.y = greatest(0, least(s.h - 1, s.y + dy)) AND p.x = greatest(0, least(s.w - 1, s.x + dx)))"
    return f"WITH {PX}, {SIZED}, {near} SELECT image_id, y, x, {three(lambda n: ch(f'sum({n} * wt) / {d(div)} + {d(offset)}'))} FROM n GROUP BY image_id, y, x"


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return R.sharpen(px).withColumn("kernel", F.lit("sharpen")).unionByName(R.emboss(px).withColumn("kernel", F.lit("emboss"))).unionByName(R.laplacian(px).withColumn("kernel", F.lit("laplacian")))


_SHARPEN, _EMBOSS, _LAPLACE = [[0, -1, 0], [-1, 5, -1], [0, -1, 0]], [[-2, -1, 0], [-1, 1, 1], [0, 1, 2]], [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
_WINDOW = "SELECT a.image_id, a.y, a.x, {} FROM {} a JOIN {} p ON p.image_id = a.image_id AND abs(p.y - a.y) <= {} AND abs(p.x - a.x) <= {} GROUP BY a.image_id, a.y, a.x"
_MASK = f"m AS (SELECT image_id, y, x, CASE WHEN {LUM} >= 1280000 THEN 1 ELSE 0 END AS m FROM px)"


def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.mask_of(pixels(spark, sf_dir))
    grown, shrunk = R.morph(m, "dilate"), R.morph(m, "erode")
    parts = {"dilate": grown, "erode": shrunk, "open": R.morph(shrunk, "dilate"), "close": R.morph(grown, "erode")}
    out = None
    for k, v in parts.items():
        part = v.withColumn("how", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _morph_sql(f: str, name: str, src: str) -> str:
    return f"{name} AS (" + _WINDOW.format(f"CAST({f}(p.m) AS INT) AS m", src, src, 1, 1) + ")"


_MORPH = f"WITH {PX}, {_MASK}, {_morph_sql('max', 'di', 'm')}, {_morph_sql('min', 'er', 'm')}, {_morph_sql('max', 'op', 'er')}, {_morph_sql('min', 'cl', 'di')} " + " UNION ALL ".join(f"SELECT *, '{k}' AS how FROM {t}" for k, t in (("dilate", "di"), ("erode", "er"), ("open", "op"), ("close", "cl")))
_LOCAL = f"WITH {PX}, l AS (SELECT image_id, y, x, CAST({LUM} AS BIGINT) AS l FROM px) " + _WINDOW.format("CASE WHEN any_value(a.l) * count(*) >= sum(p.l) - 50000 * count(*) THEN 1 ELSE 0 END AS m", "l", "l", 2, 2)
_HIST = f"h0 AS (SELECT image_id, {ch(LUMA)} AS level, count(*) AS n FROM px GROUP BY ALL), h AS (SELECT *, sum(n) OVER u AS wb, sum(n * level) OVER u AS sb, sum(n) OVER t AS total, sum(n * level) OVER t AS total_l FROM h0 WINDOW u AS (PARTITION BY image_id ORDER BY level), t AS (PARTITION BY image_id))"
_OTSU = f"WITH {PX}, {_HIST}, v AS (SELECT image_id, level, CAST(wb * (total - wb) AS DOUBLE) * pow(CAST(sb AS DOUBLE) / wb - CAST(total_l - sb AS DOUBLE) / nullif(total - wb, 0), 2) AS v FROM h) SELECT image_id, CAST(coalesce(first(level ORDER BY v DESC, level) FILTER (v > 0), 128) AS INT) AS level FROM v GROUP BY image_id"
_EQUAL = f"WITH {PX}, {_HIST}, q AS (SELECT image_id, level, CASE WHEN total > least_ THEN {ch(f'(wb - least_) * {d(255.0)} / nullif(total - least_, 0)')} ELSE level END AS t FROM (SELECT *, min(wb) OVER (PARTITION BY image_id) AS least_ FROM h)), j AS (SELECT px.*, q.t, CASE WHEN {LUM} > 0 THEN q.t / nullif({LUMA}, 0) ELSE {d(1.0)} END AS ratio FROM px JOIN q ON q.image_id = px.image_id AND q.level = {ch(LUMA)}) SELECT image_id, y, x, {three(lambda n: ch(f'{n} * ratio'))} FROM j"
_STRETCH = f"WITH {PX}, k AS (SELECT image_id, {LUM} AS l, row_number() OVER (PARTITION BY image_id ORDER BY {LUM}) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM px), e AS (SELECT image_id, max(l) FILTER (i = CAST(floor({d(0.01)} * n) AS BIGINT)) / {d(10000.0)} AS lo, max(l) FILTER (i = least(n - 1, CAST(floor({d(0.99)} * n) AS BIGINT))) / {d(10000.0)} AS hi FROM k GROUP BY image_id) SELECT image_id, y, x, {three(lambda n: f'CASE WHEN hi - lo < 1 THEN {n} ELSE {ch(f'({n} - lo) * {d(255.0)} / (hi - lo)')} END')} FROM px JOIN e USING (image_id)"


def _dist(p, r="r", g="g", b="b") -> str:
    return f"299 * ({r} - {p[0]}) * ({r} - {p[0]}) + 587 * ({g} - {p[1]}) * ({g} - {p[1]}) + 114 * ({b} - {p[2]}) * ({b} - {p[2]})"


def _palette_sql(src: str) -> str:
    rows = ", ".join(f"({i}, {p[0]}, {p[1]}, {p[2]})" for i, p in enumerate(PALETTE))
    dist = "299 * (r - pr) * (r - pr) + 587 * (g - pg) * (g - pg) + 114 * (b - pb) * (b - pb)"
    return f"pal(i, pr, pg, pb) AS (VALUES {rows}), z AS (SELECT image_id, y, x, i, pr, pg, pb, {dist} AS dist, row_number() OVER (PARTITION BY image_id, y, x ORDER BY {dist}, i) AS k FROM {src} CROSS JOIN pal)"


_PICK = "SELECT image_id, y, x, pr AS r, pg AS g, pb AS b FROM z WHERE k = 1"
_BAYER = "[" + ", ".join(d((v / 16.0 - 0.5) * 32.0) for row in R.BAYER for v in row) + "]"
_DITHERED = f"dd AS (SELECT image_id, y, x, {three(lambda n: ch(f'{n} + {_BAYER}[y % 4 * 4 + x % 4 + 1]'))} FROM px)"


def _box(h: int, w: int) -> str:
    lo = lambda i, n, m: f"({i} * {n} // {m})"
    hi = lambda i, n, m: f"greatest({lo(i, n, m)} + 1, ({i} + 1) * {n} // {m})"
    return f"g AS (SELECT DISTINCT image_id, h, w FROM s), t AS (SELECT image_id, h, w, CAST(ty.v AS INT) AS y, CAST(tx.v AS INT) AS x FROM g CROSS JOIN range({h}) ty(v) CROSS JOIN range({w}) tx(v)), box AS (SELECT t.image_id, t.y, t.x, {three(lambda n: ch(f'CAST(sum(p.{n}) AS DOUBLE) / count(*)'))} FROM t JOIN px p ON p.image_id = t.image_id AND p.y >= {lo('t.y', 't.h', h)} AND p.y < {hi('t.y', 't.h', h)} AND p.x >= {lo('t.x', 't.w', w)} AND p.x < {hi('t.x', 't.w', w)} GROUP BY t.image_id, t.y, t.x)"


_NEAREST = f"WITH {PX}, {SIZED}, {_box(7, 13)} SELECT t.image_id, t.y, t.x, p.r, p.g, p.b FROM t JOIN px p ON p.image_id = t.image_id AND p.y = t.y * t.h // 7 AND p.x = t.x * t.w // 13"
_HASHES = "WITH {0}, {1}, {2}, l AS (SELECT image_id, y, x, CAST({3} AS BIGINT) AS l FROM box), "


def _bits_sql(on: str) -> str:
    return f"SELECT image_id, CAST(sum(CASE WHEN NOT ({on}) THEN 0 WHEN y * 8 + x = 0 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (63 - (y * 8 + x))) END) AS BIGINT) AS hash FROM n GROUP BY image_id"


_AHASH = _HASHES.format(PX, SIZED, _box(8, 8), LUM) + "n AS (SELECT *, sum(l) OVER (PARTITION BY image_id) AS t FROM l) " + _bits_sql("l * 64 >= t")
_DHASH = _HASHES.format(PX, SIZED, _box(8, 9), LUM) + "n AS (SELECT * FROM (SELECT *, lead(l) OVER (PARTITION BY image_id, y ORDER BY x) AS nx FROM l) WHERE x < 8) " + _bits_sql("l > nx")
_BILINEAR = f"""WITH {PX}, {SIZED}, g AS (SELECT DISTINCT image_id, h, w FROM s), t AS (SELECT image_id, h, w, CAST(ty.v AS INT) AS y, CAST(tx.v AS INT) AS x, (ty.v + {d(0.5)}) * h / {d(7.0)} - {d(0.5)} AS fy, (tx.v + {d(0.5)}) * w / {d(13.0)} - {d(0.5)} AS fx FROM g CROSS JOIN range(7) ty(v) CROSS JOIN range(13) tx(v)),
 u AS (SELECT *, greatest(0, least(h - 1, CAST(trunc(fy) AS INT))) AS y0, greatest(0, least(w - 1, CAST(trunc(fx) AS INT))) AS x0 FROM t), v AS (SELECT *, least(h - 1, y0 + 1) AS y1, least(w - 1, x0 + 1) AS x1, fy - y0 AS dy, fx - x0 AS dx FROM u)
 SELECT v.image_id, v.y, v.x, {three(lambda n: ch(f'(a.{n} * ({d(1.0)} - dx) + b.{n} * dx) * ({d(1.0)} - dy) + (c.{n} * ({d(1.0)} - dx) + e.{n} * dx) * dy'))} FROM v JOIN px a ON a.image_id = v.image_id AND a.y = y0 AND a.x = x0 JOIN px b ON b.image_id = v.image_id AND b.y = y0 AND b.x = x1 JOIN px c ON c.image_id = v.image_id AND c.y = y1 AND c.x = x0 JOIN px e ON e.image_id = v.image_id AND e.y = y1 AND e.x = x1"""
_SOBEL = f"""WITH {PX}, {SIZED}, k(dy, dx, gx, gy) AS (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,0,0,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)),
 n AS (SELECT s.image_id, s.y, s.x, sum(gx * CAST(2126 * p.r + 7152 * p.g + 722 * p.b AS BIGINT)) AS gx, sum(gy * CAST(2126 * p.r + 7152 * p.g + 722 * p.b AS BIGINT)) AS gy FROM s CROSS JOIN k JOIN px p ON p.image_id = s.image_id AND p.y = greatest(0, least(s.h - 1, s.y + dy)) AND p.x = greatest(0, least(s.w - 1, s.x + dx)) GROUP BY s.image_id, s.y, s.x)
 SELECT image_id, y, x, {three(lambda n: ch(f'sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) / {d(40000.0)}'))} FROM n"""
_HSV_SPAN = "(greatest(r, g, b) - least(r, g, b))"
_HUE = lambda a, b, t: f"({d(6000.0)} * ({a} - {b}) / nullif({_HSV_SPAN}, 0) + {d(t)})"
_HSV = f"""WITH {PX} SELECT image_id, y, x, CAST(round_even(CASE WHEN {_HSV_SPAN} = 0 THEN {d(0.0)} WHEN r = greatest(r, g, b) THEN CASE WHEN g < b THEN {_HUE('g', 'b', 36000.0)} ELSE {_HUE('g', 'b', 36000.0)} - 36000 END WHEN g = greatest(r, g, b) THEN {_HUE('b', 'r', 12000.0)} ELSE {_HUE('r', 'g', 24000.0)} END, 0) AS BIGINT) AS h,
 CAST(round_even(CASE WHEN greatest(r, g, b) = 0 THEN {d(0.0)} ELSE {d(10000.0)} * {_HSV_SPAN} / greatest(r, g, b) END, 0) AS BIGINT) AS s, CAST(round_even({d(10000.0)} * greatest(r, g, b) / 255, 0) AS BIGINT) AS v FROM px"""
_TRIM = f"WITH {PX}, t AS (SELECT * FROM px WHERE image_id % 2 = 0 OR (y > 1 AND x BETWEEN 2 AND 7)), q AS (SELECT image_id, y, x, CASE WHEN y > 1 AND x BETWEEN 2 AND 7 THEN r ELSE 9 END AS r, CASE WHEN y > 1 AND x BETWEEN 2 AND 7 THEN g ELSE 9 END AS g, CASE WHEN y > 1 AND x BETWEEN 2 AND 7 THEN b ELSE 9 END AS b FROM px), bx AS (SELECT image_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM q WHERE abs(r - 9) + abs(g - 9) + abs(b - 9) > 30 GROUP BY image_id) SELECT q.image_id, y - y0 AS y, x - x0 AS x, r, g, b FROM q JOIN bx USING (image_id) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = (F.col("y") > 1) & F.col("x").between(2, 7)
    framed = pixels(spark, sf_dir).select("image_id", "y", "x", *[F.when(inner, F.col(n)).otherwise(9).alias(n) for n in "rgb"])
    return R.trim_uniform(framed, 10.0)


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a pixel taken away, doubled or spoilt, by their number."""
    px = pixels(spark, sf_dir)
    px = px.where("not (image_id % 4 = 1 and y = 5 and x = 5)").withColumn("r", F.expr("case when image_id % 4 = 2 and y = 3 and x = 3 then 300 else r end"))
    return R.problems(px.unionByName(px.where("image_id % 4 = 3 and y = 0 and x = 0")))


_BROKEN = f"WITH {PX} SELECT DISTINCT image_id, CASE image_id % 4 WHEN 1 THEN 'not_rectangular' WHEN 2 THEN 'channel_out_of_range' ELSE 'repeated_pixel' END AS problem FROM px WHERE image_id % 4 > 0"
_SEAM = f"WITH {PX}, {SIZED}, l AS (SELECT image_id, y, x, h, w, CAST({LUM} AS BIGINT) AS l FROM s), " + ", ".join(f"n{a} AS (SELECT *, abs(l - lag(l) OVER (PARTITION BY image_id, {c} ORDER BY {a})) AS step FROM l), e{a} AS (SELECT image_id, {c}, abs(sum(CASE WHEN {a} = 0 THEN l WHEN {a} = {z} - 1 THEN -l END)) AS gap, sum(step) AS steps, count(step) AS n FROM n{a} GROUP BY ALL)" for a, c, z in (("x", "y", "w"), ("y", "x", "h"))) + " " + " UNION ALL ".join(f"SELECT image_id, CAST(sum(gap) AS BIGINT) AS seam_sum, CAST(sum(steps) AS BIGINT) AS inner_sum, CAST(sum(n) AS BIGINT) AS n, '{a}' AS axis FROM e{a} GROUP BY image_id" for a in "xy")
_BORDER = f"WITH {PX}, {SIZED}, e AS (SELECT * FROM s WHERE y < 1 OR x < 1 OR y >= h - 1 OR x >= w - 1), n AS (SELECT image_id, r // 64 AS r, g // 64 AS g, b // 64 AS b, count(*) AS n FROM e GROUP BY ALL) SELECT image_id, first(r ORDER BY n DESC, r, g, b) AS r, first(g ORDER BY n DESC, r, g, b) AS g, first(b ORDER BY n DESC, r, g, b) AS b, CAST(max(n) * 1000000 // sum(n) AS BIGINT) AS share FROM n GROUP BY image_id"


def coarse_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.border_background(pixels(spark, sf_dir).select("image_id", "y", "x", *[F.floor(F.col(n) / 64).cast("int").alias(n) for n in "rgb"]))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("place", F.col("image_id"))
    return R.montage(px, "place", columns=3, tile=SIDE)


QUERIES = {
    "raster_grayscale": image(R.grayscale), "raster_grayscale_blend": image(R.grayscale, 0.6, "average"), "raster_sepia": image(R.sepia), "raster_invert": image(R.invert, 0.25),
    "raster_brightness_contrast": image(R.brightness_contrast, 0.1, 0.2), "raster_saturation": image(R.saturation, 1.5), "raster_tint": image(R.tint, (1.1, 0.9, 0.5)), "raster_threshold": image(R.threshold, 0.5),
    "raster_luma_channel": image(R.extract_channel, "luma"), "raster_hsv": image(R.hsv), "raster_blend_modes": blends, "raster_transforms": turns, "raster_auto_orient": orientations,
    "raster_pad_extent": image(R.pad_extent, 13, 12, (20, 30, 40)), "raster_trim": trimmed, "raster_montage": sheet, "raster_slice_sheet": image(R.slice_sheet, 4, 3), "raster_problems": broken,
    "raster_resample_nearest": image(R.resample_nearest, 7, 13), "raster_resample_box": image(R.resample_box, 4, 3), "raster_resample_bilinear": image(R.resample_bilinear, 7, 13),
    "raster_kernels": kernels, "raster_box_blur": image(R.box_blur), "raster_sobel": image(R.sobel), "raster_morphology": morphology, "raster_local_threshold": image(R.local_threshold),
    "raster_otsu": image(R.otsu), "raster_equalize": image(R.equalize), "raster_contrast_stretch": image(R.contrast_stretch), "raster_compare": lambda s, f: R.compare(pixels(s, f), second(s, f)), "raster_diff": lambda s, f: R.diff_image(pixels(s, f), R.threshold(pixels(s, f))),
    "raster_palette_nearest": image(R.quantize, PALETTE), "raster_ordered_dither": image(R.ordered_dither, PALETTE), "raster_palette_usage": image(R.palette_usage, PALETTE), "raster_average_hash": image(R.average_hash), "raster_difference_hash": image(R.difference_hash),
    "raster_profiles": lambda s, f: R.profile(pixels(s, f), "x").unionByName(R.profile(pixels(s, f), "y")), "raster_content_box": lambda s, f: R.content_box(R.mask_of(pixels(s, f), 200)), "raster_border_background": coarse_border, "raster_seams": image(R.seam),
}

ORACLES = {
    "raster_grayscale": point(lambda n: ch(LUMA)),
    "raster_grayscale_blend": f"WITH {PX}, t AS (SELECT *, {ch(f'(r + g + b) / {d(3.0)}')} AS t FROM px) SELECT image_id, y, x, {three(lambda n: ch(f'{n} + (t - {n}) * {d(0.6)}'))} FROM t",
    "raster_sepia": point(lambda n: ch(f"({R.SEPIA['rgb'.index(n)][0]} * r + {R.SEPIA['rgb'.index(n)][1]} * g + {R.SEPIA['rgb'.index(n)][2]} * b) / {d(1000.0)}")),
    "raster_invert": point(lambda n: ch(f"{n} + (255 - {n} - {n}) * {d(0.25)}")),
    "raster_brightness_contrast": point(lambda n: ch(f"{d(_SCALE)} * ({n} + {d(0.1 * 255.0)} - {d(128.0)}) + {d(128.0)}")),
    "raster_saturation": point(lambda n: ch(f"{LUMA} + ({n} - {LUMA}) * {d(1.5)}")),
    "raster_tint": point(lambda n: ch(f"{n} * {d((1.1, 0.9, 0.5)['rgb'.index(n)])}")),
    "raster_threshold": point(lambda n: f"CASE WHEN {LUMA} / {d(255.0)} >= {d(0.5)} THEN 255 ELSE 0 END"),
    "raster_luma_channel": point(lambda n: ch(LUMA)),
    "raster_hsv": _HSV,
    "raster_blend_modes": _blends_sql(),
    "raster_transforms": _MOVED(_TURNS, "turn", "'"),
    "raster_auto_orient": _MOVED(_ORIENT, "orientation", ""),
    "raster_pad_extent": f"WITH {PX}, g AS (SELECT DISTINCT image_id FROM px) SELECT g.image_id, CAST(ty.v AS INT) AS y, CAST(tx.v AS INT) AS x, coalesce(r, 20) AS r, coalesce(g, 30) AS g, coalesce(b, 40) AS b FROM g CROSS JOIN range(13) ty(v) CROSS JOIN range(12) tx(v) LEFT JOIN px p ON p.image_id = g.image_id AND p.y = ty.v - 1 AND p.x = tx.v - 1",
    "raster_trim": _TRIM,
    "raster_montage": f"WITH {PX} SELECT image_id // 6 AS image_id, CAST(y + image_id % 6 // 3 * 12 + 2 AS INT) AS y, CAST(x + image_id % 6 % 3 * 12 + 2 AS INT) AS x, r, g, b FROM px",
    "raster_slice_sheet": f"WITH {PX} SELECT image_id, CAST(y // 4 * 3 + x // 3 AS INT) AS frame, y % 4 AS y, x % 3 AS x, r, g, b FROM px WHERE y // 4 < 2 AND x // 3 < 3",
    "raster_problems": _BROKEN,
    "raster_resample_nearest": _NEAREST,
    "raster_resample_box": f"WITH {PX}, {SIZED}, {_box(4, 3)} SELECT * FROM box",
    "raster_resample_bilinear": _BILINEAR,
    "raster_kernels": " UNION ALL ".join(f"SELECT *, '{k}' AS kernel FROM ({_kernel(m, 1.0, o)})" for k, m, o in (("sharpen", _SHARPEN, 0.0), ("emboss", _EMBOSS, 128.0), ("laplacian", _LAPLACE, 0.0))),
    "raster_box_blur": _kernel([[1] * 3] * 3, 9.0),
    "raster_sobel": _SOBEL,
    "raster_morphology": _MORPH,
    "raster_local_threshold": _LOCAL,
    "raster_otsu": _OTSU,
    "raster_equalize": _EQUAL,
    "raster_contrast_stretch": _STRETCH,
    "raster_compare": f"WITH {PX}, {SECOND} SELECT image_id, count(*) AS pixels, CAST(sum(abs(r - o_r) + abs(g - o_g) + abs(b - o_b)) AS BIGINT) AS abs_sum, CAST(sum((r - o_r) * (r - o_r) + (g - o_g) * (g - o_g) + (b - o_b) * (b - o_b)) AS BIGINT) AS square_sum, max(greatest(abs(r - o_r), abs(g - o_g), abs(b - o_b))) AS max_delta, count(*) FILTER (r <> o_r OR g <> o_g OR b <> o_b) AS mismatches FROM px JOIN o USING (image_id, y, x) GROUP BY image_id",
    "raster_diff": f"WITH {PX}, t AS (SELECT *, CASE WHEN {LUMA} / {d(255.0)} >= {d(0.5)} THEN 255 ELSE 0 END AS t FROM px) SELECT image_id, y, x, CASE WHEN r = t AND g = t AND b = t THEN r ELSE 255 END AS r, CASE WHEN r = t AND g = t AND b = t THEN g ELSE 0 END AS g, CASE WHEN r = t AND g = t AND b = t THEN b ELSE 0 END AS b FROM t",
    "raster_palette_nearest": f"WITH {PX}, {_palette_sql('px')} {_PICK}",
    "raster_ordered_dither": f"WITH {PX}, {_DITHERED}, {_palette_sql('dd')} {_PICK}",
    "raster_palette_usage": f"WITH {PX}, {_palette_sql('px')} SELECT image_id, i AS entry, count(*) AS pixels, CAST(sum(dist) AS BIGINT) AS distance_sum FROM z WHERE k = 1 GROUP BY image_id, i",
    "raster_average_hash": _AHASH,
    "raster_difference_hash": _DHASH,
    "raster_profiles": f"WITH {PX}" + " UNION ALL ".join(f" SELECT image_id, {a} AS place, CAST(sum({LUM}) AS BIGINT) AS luma_sum, count(*) AS n, '{a}' AS axis FROM px GROUP BY image_id, {a}" for a in "xy"),
    "raster_content_box": f"WITH {PX} SELECT image_id, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, count(*) AS pixels FROM px WHERE {LUM} >= 2000000 GROUP BY image_id",
    "raster_border_background": _BORDER,
    "raster_seams": _SEAM,
}
