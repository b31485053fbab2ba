"""Queries of whole-image features, sheets and sample frames, and the SQL that works them out on its own."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.operators import perception as P
from quillstone.operators import raster as R
from quillstone.plans import raster as S
from quillstone.plans.raster import LUM, PX, SIZED, d, pixels
from quillstone.plans.retrieval import read
from quillstone.plans.signals import centred

c = F.col
FRAME = 32
REFERENCE = (200, 40, 40)
#: Presets of the caller: a name and the features that it is known by.
FILTERS = [("denoise_soft", (0.6, 0.3, 0.4, 0.7, 0.9, 0.5)), ("sharpen_subtle", (0.1, 0.2, 0.05, 0.1, 0.5, 0.1)), ("edge_accentuate", (0.9, 0.6, 0.8, 1.0, 1.0, 0.2)), ("pass_through", (0.3, 0.5, 0.3, 0.4, 0.8, 0.1))]
PATTERNS = [("otsu", (0.5, 0.5, 0.7, 0.8)), ("adaptive_local", (0.4, 0.4, 1.0, 1.0)), ("high_contrast", (0.5, 0.7, 0.33, 0.9)), ("abstain", (0.5, 0.0, 0.0, 0.0))]


def millionths(rows: DataFrame, *keys: str) -> DataFrame:
    """All other columns as whole millionths, rounded half to even."""
    return rows.select(*keys, *[fixed(c(n)).alias(n) for n in rows.columns if n not in keys])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sample_frames(centred(spark, sf_dir), FRAME)


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(c("user_id").alias("series"), F.struct("ts", "event_id").alias("place"), (c("event_type") == "click").alias("stress"), (F.rint(c("value") * 100) + 1).cast("long").alias("duration"))


def filter_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.chosen(P.filtering(pixels(spark, sf_dir)), ["mean_grad", "norm_var", "edge_density", "hf_energy", "dyn_range", "noise_proxy"], FILTERS, 0.4, 0.95)
    return rows.select("image_id", "preset", fixed(c("confidence")).alias("confidence"))


def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.threshold_strategy(P.thresholding(pixels(spark, sf_dir)), PATTERNS)
    return rows.select("image_id", "strategy", fixed(c("confidence")).alias("confidence"))


def hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", (c("p_partkey") * 7 - 400).alias("h"), (c("p_size") * 2).alias("s"), (c("p_partkey") % 101).alias("v"))
    r, g, b = P.hsv_to_rgb(c("h"), c("s") / F.lit(100.0), c("v") / F.lit(100.0))
    return p.select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.presence(R.mask_of(pixels(spark, sf_dir), 225))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", (c("p_partkey") % 48 + 1).cast("long").alias("size"), F.when(c("p_size") % 9 > 0, c("p_size") % 9).cast("long").alias("period"), (c("p_partkey") % 101).alias("strength"))
    n, why = P.cells_of_period(c("size"), c("period"), c("strength"))
    own, refused = P.declared_cells(c("size"), c("period"))
    return p.select("p_partkey", n.alias("period_cells"), why.alias("period_refusal"), own.alias("declared"), refused.alias("declared_refusal"), P.power_of_two(c("size")).alias("extent"))


QUERIES = {
    "feature_flat_color": lambda s, f: millionths(P.flat_color(pixels(s, f)), "image_id"), "feature_tone": lambda s, f: millionths(P.tone(pixels(s, f)), "image_id"),
    "feature_filter": lambda s, f: millionths(P.filtering(pixels(s, f)), "image_id"), "filter_choice": filter_choice, "feature_threshold": lambda s, f: millionths(P.thresholding(pixels(s, f)), "image_id"),
    "threshold_strategy": strategy, "raster_perceptual_hash": lambda s, f: P.perceptual_hash(pixels(s, f)), "raster_delta_e": lambda s, f: P.delta_e(pixels(s, f), REFERENCE), "color_hsv_to_rgb": hues,
    "sheet_presence": presence, "sheet_runs": lambda s, f: P.content_runs(presence(s, f)), "sheet_run_cells": lambda s, f: P.cells_of_runs(presence(s, f)), "sheet_cells": cells,
    "normal_flip": lambda s, f: P.flip_normals(pixels(s, f)), "render_lighting": lambda s, f: millionths(P.lighting(pixels(s, f)), "image_id"),
    "feature_voice": lambda s, f: millionths(P.voice(frames(s, f)), "series", "frame"), "feature_recording": lambda s, f: millionths(P.recording(frames(s, f)), "series", "frame"), "feature_rhythm": lambda s, f: millionths(P.rhythm(syllables(s, f)), "series"),
}


def m(x: str) -> str:
    """Whole millionths of an expression."""
    return f"CAST(round_even(({x}) * {d(1e6)}, 0) AS BIGINT)"


def _out(keys: str, parts: dict[str, str], source: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"{m(x)} AS {n}" for n, x in parts.items()) + f" FROM {source}"


def dev(squares: str, total: str, n: str = "n") -> str:
    mean = f"(CAST({total} AS DOUBLE) / {n})"
    return f"sqrt(greatest({d(0.0)}, CAST({squares} AS DOUBLE) / {n} - {mean} * {mean}))"


def one(x: str) -> str:
    return f"least({d(1.0)}, {x})"


_K = "(greatest(r, g, b) - least(r, g, b))"
_HUGE = "sum(CAST({0} AS HUGEINT) * {0})"
FLAT = f"""fl AS (SELECT image_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum({LUM}) AS BIGINT) AS l, {_HUGE.format(LUM)} AS ll, CAST(sum({_K}) AS BIGINT) AS k, {_HUGE.format(_K)} AS kk, count(DISTINCT (r // 16, g // 16, b // 16)) AS u, greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) AS sp FROM px GROUP BY 1)"""
FLAT_PARTS = {"luma_std": one(f"{dev('ll', 'l')} / {d(2550000.0)} / {d(0.5)}"), "chroma": f"k / n / {d(255.0)}", "chroma_std": one(f"{dev('kk', 'k')} / {d(255.0)} / {d(0.5)}"), "unique_ratio": "u / n", "channel_span": f"sp / {d(255.0)}"}
_TONE = f"""t AS (SELECT image_id, count(*) AS c, CAST(count(*) AS DOUBLE) AS n, list_sort(list({LUM})) AS v, CAST(sum({LUM}) AS BIGINT) AS l, {_HUGE.format(LUM)} AS ll FROM px GROUP BY 1)"""
_W = d(2550000.0)
_AT = lambda p: f"v[CAST(least(c - 1, floor({d(p / 100)} * c)) AS BIGINT) + 1] / {_W}"
_STEPS = f"""st AS (SELECT image_id, {LUM} AS l, abs(lead({LUM}) OVER (PARTITION BY image_id, y ORDER BY x) - {LUM}) AS dx, abs(lead({LUM}) OVER (PARTITION BY image_id, x ORDER BY y) - {LUM}) AS dy FROM px)"""
_FILTER = f"""{_STEPS}, a AS (SELECT image_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l) AS BIGINT) AS l, {_HUGE.format('l')} AS ll, max(l) - min(l) AS sp, CAST(coalesce(sum(dx), 0) + coalesce(sum(dy), 0) AS BIGINT) AS steps, count(dx) + count(dy) AS pairs, count(*) FILTER (dx > 300000 AND dy IS NOT NULL) AS edges, count(*) FILTER (dx IS NOT NULL AND dy IS NOT NULL) AS inside FROM st GROUP BY 1),
 b AS (SELECT image_id, {one(f"steps / {d(10000.0)} / greatest(1, pairs) / {d(64.0)}")} AS mg, {one(f"{dev('ll', 'l')} / {d(1280000.0)}")} AS nv, {one("CAST(edges AS DOUBLE) / greatest(1, inside)")} AS ed, {one(f"sp / {_W}")} AS dr FROM a),
 ft AS (SELECT image_id, mg, nv, ed, {one(f"(mg * {d(1.5)} + ed) / {d(2.0)}")} AS hf, dr, greatest({d(0.0)}, {one(f"(mg - ed * {d(0.8)}) * {d(1.2)}")}) AS np FROM b)"""
_FT = {"mean_grad": "mg", "norm_var": "nv", "edge_density": "ed", "hf_energy": "hf", "dyn_range": "dr", "noise_proxy": "np"}
_THRESH = f"""{_STEPS}, hb AS (SELECT image_id, least(15, l // 160000) AS bin, count(*) AS k FROM st GROUP BY 1, 2),
 h0 AS (SELECT g.image_id, i.v AS bin, coalesce(hb.k, 0) AS k FROM (SELECT DISTINCT image_id FROM px) g CROSS JOIN range(16) i(v) LEFT JOIN hb ON hb.image_id = g.image_id AND hb.bin = i.v),
 h1 AS (SELECT image_id, bin, k > lag(k) OVER w AND k > lead(k) OVER w AS top FROM h0 WINDOW w AS (PARTITION BY image_id ORDER BY bin)), pk AS (SELECT image_id, count(*) FILTER (top) AS peaks FROM h1 GROUP BY 1),
 a AS (SELECT image_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l) AS BIGINT) AS l, {_HUGE.format('l')} AS ll, CAST(coalesce(sum(dx), 0) AS BIGINT) AS sx, count(dx) AS pairs FROM st GROUP BY 1),
 ft AS (SELECT image_id, CAST(l AS DOUBLE) / n / {d(10000.0)} / {d(255.0)} AS nm, {one(f"{dev('ll', 'l')} / {d(1280000.0)}")} AS nv, {one(f"peaks / {d(3.0)}")} AS bi, {one(f"sx / {d(10000.0)} / greatest(1, pairs) / {d(48.0)}")} AS gd FROM a JOIN pk USING (image_id))"""
_TH = {"norm_mean": "nm", "norm_var": "nv", "bimodality": "bi", "grad_density": "gd"}


def _chosen(presets: list, names: list[str], least: float, most: float) -> str:
    far = lambda p: "sqrt(" + " + ".join(f"({n} - {d(v)}) * ({n} - {d(v)})" for n, v in zip(names, p, strict=True)) + ")"
    rows = " UNION ALL ".join(f"SELECT image_id, {names[1]} AS nv, {i} AS i, '{name}' AS preset, {far(p)} AS far FROM ft" for i, (name, p) in enumerate(presets))
    return f"pr AS ({rows}), ch AS (SELECT *, greatest({d(least)}, least({d(most)}, {d(1.0)} - far / {d(2.0)})) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY far, i) AS k FROM pr) WHERE k = 1)"


_COS = "[" + ", ".join("[" + ", ".join(str(round((1 << 15) * math.cos((2 * i + 1) * u * math.pi / 64))) for i in range(32)) + "]" for u in range(8)) + "]"
_PHASH = S._HASHES.format(PX, SIZED, S._box(32, 32), LUM) + f"""co AS (SELECT {_COS} AS t), pa AS (SELECT image_id, y, v.v AS v, CAST(sum(l * t[v.v + 1][x + 1]) AS BIGINT) AS p FROM l CROSS JOIN range(8) v(v) CROSS JOIN co GROUP BY 1, 2, 3),
 fq AS (SELECT image_id, u.v AS u, pa.v, CAST(sum(p * t[u.v + 1][y + 1]) AS BIGINT) AS s FROM pa CROSS JOIN range(8) u(v) CROSS JOIN co GROUP BY 1, 2, 3),
 kf AS (SELECT image_id, u * 8 + v - 1 AS place, (CASE WHEN u = 0 THEN {d(1.0)} / sqrt({d(2.0)}) ELSE {d(1.0)} END) * (CASE WHEN v = 0 THEN {d(1.0)} / sqrt({d(2.0)}) ELSE {d(1.0)} END) * CAST(s AS DOUBLE) AS k FROM fq WHERE u + v > 0),
 md AS (SELECT image_id, list_sort(list(k))[32] AS mid FROM kf GROUP BY 1), hs AS (SELECT image_id, CAST(sum(CASE WHEN k > mid THEN CAST(pow(2, 62 - place) AS BIGINT) ELSE 0 END) AS BIGINT) AS hash FROM kf JOIN md USING (image_id) GROUP BY 1)
 SELECT image_id, hash, lpad(lower(printf('%x', hash)), 16, '0') AS hex FROM hs"""


def _line(n: str) -> str:
    return f"CASE WHEN {n} / {d(255.0)} <= {d(0.04045)} THEN {n} / {d(255.0)} / {d(12.92)} ELSE pow(({n} / {d(255.0)} + {d(0.055)}) / {d(1.055)}, {d(2.4)}) END"


def _lab(source: str) -> str:
    """(image_id, y, x, l, a, b_) in thousandths of a table (image_id, y, x, r, g, b)."""
    sums = {"tx": ((0.4124564, 0.3575761, 0.1804375), 0.95047), "ty": ((0.2126729, 0.7151522, 0.0721750), 1.0), "tz": ((0.0193339, 0.1191920, 0.9503041), 1.08883)}
    t = ", ".join(f"(lr * {d(w[0])} + lg * {d(w[1])} + lb * {d(w[2])}) / {d(white)} AS {n}" for n, (w, white) in sums.items())
    bend = lambda n: f"CASE WHEN {n} > {d((6.0 / 29.0) ** 3)} THEN pow({n}, {d(1.0 / 3.0)}) ELSE {n} / {d(3.0 * (6.0 / 29.0) ** 2)} + {d(4.0 / 29.0)} END"
    whole = lambda x: f"CAST(round_even(({x}) * {d(1000.0)}, 0) AS BIGINT)"
    return f"(SELECT image_id, y, x, {whole(f'{d(116.0)} * fy - {d(16.0)}')} AS l, {whole(f'{d(500.0)} * (fx - fy)')} AS a, {whole(f'{d(200.0)} * (fy - fz)')} AS b_ FROM (SELECT image_id, y, x, {bend('tx')} AS fx, {bend('ty')} AS fy, {bend('tz')} AS fz FROM (SELECT image_id, y, x, {t} FROM (SELECT image_id, y, x, {_line('r')} AS lr, {_line('g')} AS lg, {_line('b')} AS lb FROM {source}))))"


_HSV = f"""p AS (SELECT p_partkey, CAST((((p_partkey * 7 - 400) % 360) + 360) % 360 AS DOUBLE) AS h, least({d(1.0)}, p_size * 2 / {d(100.0)}) AS s, p_partkey % 101 / {d(100.0)} AS v FROM part),
 q AS (SELECT p_partkey, v, v * s AS k, v * s * ({d(1.0)} - abs((h / {d(60.0)}) % {d(2.0)} - {d(1.0)})) AS x, CAST(floor(h / {d(60.0)}) AS INT) AS e FROM p)"""
_HCH = lambda *a: f"CAST(greatest(0, least(255, round_even((CASE e {' '.join(f'WHEN {i} THEN {n}' for i, n in enumerate(a))} END + (v - k)) * {d(255.0)}, 0))) AS INT)"
_PRES = f"{PX}, mk AS (SELECT image_id, y, x, CASE WHEN {LUM} >= 2250000 THEN 1 ELSE 0 END AS m FROM px), pf AS (SELECT image_id, 'x' AS axis, x AS place, max(m) AS present FROM mk GROUP BY 1, 3 UNION ALL SELECT image_id, 'y', y, max(m) FROM mk GROUP BY 1, 3)"
_RUNS = f"{_PRES}, rn AS (SELECT image_id, axis, min(place) AS first, max(place) AS last FROM (SELECT image_id, axis, place, place - row_number() OVER (PARTITION BY image_id, axis ORDER BY place) AS run FROM pf WHERE present = 1) GROUP BY image_id, axis, run)"
SERIES = f"""sm AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS po, greatest(-10000, least(10000, CAST(round_even(value * 100, 0) AS BIGINT) - 10000)) AS v FROM events),
 fr AS (SELECT series, po // {FRAME} AS frame, po % {FRAME} AS i, v FROM sm QUALIFY count(*) OVER (PARTITION BY series, po // {FRAME}) = {FRAME}), nb AS (SELECT *, lag(v) OVER (PARTITION BY series, frame ORDER BY i) AS pv FROM fr),
 lg AS (SELECT a.series, a.frame, b.i - a.i AS lag, CAST(sum(a.v * b.v) AS BIGINT) AS dot FROM fr a JOIN fr b ON a.series = b.series AND a.frame = b.frame AND b.i - a.i BETWEEN 8 AND {FRAME // 2 - 1} GROUP BY 1, 2, 3),
 au AS (SELECT series, frame, CAST(sum(v * v) AS BIGINT) AS ss, count(*) FILTER ((pv >= 0) <> (v >= 0)) AS zc, count(*) FILTER (abs(v - pv) > 800) AS jm, max(abs(v)) AS pk, count(*) FILTER (abs(v) >= 9800) AS cl FROM nb GROUP BY 1, 2),
 qt AS (SELECT series, frame, min(q) AS q FROM (SELECT series, frame, i // 8 AS w, CAST(sum(v * v) AS BIGINT) AS q FROM fr GROUP BY 1, 2, 3) GROUP BY 1, 2),
 pe AS (SELECT series, frame, max(CAST(dot AS DOUBLE) * {d(float(FRAME))} / (({FRAME} - lag) * CAST(ss AS DOUBLE))) AS best FROM lg JOIN au USING (series, frame) GROUP BY 1, 2),
 fe AS (SELECT series, frame, zc, jm, cl, CASE WHEN ss <= 0 THEN {d(0.0)} ELSE greatest({d(0.0)}, {one('best')}) END AS pd, sqrt(CAST(ss AS DOUBLE) / {d(float(FRAME))}) / {d(10000.0)} AS rms, pk / {d(10000.0)} AS pk, sqrt(CAST(q AS DOUBLE) / 8) / {d(10000.0)} AS fl FROM au JOIN pe USING (series, frame) JOIN qt USING (series, frame))"""
_N1 = d(float(FRAME - 1))
VOICE = {"energy": one(f"rms / {d(0.35)}"), "zcr": one(f"zc / {_N1}"), "periodicity": "pd", "crest": f"CASE WHEN rms < {d(1e-8)} THEN {d(0.0)} ELSE {one(f'pk / (greatest(rms, {d(1e-9)}) * {d(8.0)})')} END", "high_ratio": one(f"jm / {_N1}")}
RECORDING = {"energy": one(f"rms / {d(0.5)}"), "clipping": f"cl / {d(float(FRAME))}", "noise_floor": one(f"fl / {d(0.25)}"), "periodicity": "pd", "zcr": one(f"zc / {_N1}")}
RHYTHM = f"""sy AS (SELECT user_id AS series, event_type = 'click' AS st, CAST(round_even(value * 100, 0) AS BIGINT) + 1 AS du, lead(event_type = 'click') OVER w AS nx, row_number() OVER w - 1 AS po FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 rh AS (SELECT series, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (st) AS s, CAST(sum(po) FILTER (st) AS BIGINT) AS lt, count(*) FILTER (NOT st AND nx) AS ia, count(*) FILTER (st AND NOT nx) AS tr, CAST(sum(du) AS BIGINT) AS ds, {_HUGE.format('du')} AS dd, max(du) FILTER (nx IS NULL) AS la FROM sy GROUP BY 1 HAVING count(*) >= 2)"""
RHYTHM_PARTS = {"stress_ratio": "s / n", "iamb_ratio": "ia / (n - 1)", "trochee_ratio": "tr / (n - 1)", "duration_cv": one(f"{dev('dd', 'ds')} / (ds / n)"), "final_lengthening": one(f"la / ({d(2.0)} * (ds / n))"), "late_stress": f"CASE WHEN s > 0 THEN CAST(lt AS DOUBLE) / s / (n - 1) ELSE {d(0.5)} END"}
ORACLES = {
    "feature_flat_color": f"WITH {PX}, {FLAT} {_out('image_id', FLAT_PARTS, 'fl WHERE n >= 4')}",
    "feature_tone": f"WITH {PX}, {_TONE} {_out('image_id', {**{f'p{p}': _AT(p) for p in (5, 25, 50, 75, 95)}, 'mean': f'CAST(l AS DOUBLE) / n / {_W}', 'std': dev('ll', 'l') + f' / {_W}', 'range': f'(v[c] - v[1]) / {_W}'}, 't')}",
    "feature_filter": f"WITH {PX}, {_FILTER} {_out('image_id', _FT, 'ft')}",
    "filter_choice": f"WITH {PX}, {_FILTER}, {_chosen(FILTERS, list(_FT.values()), 0.4, 0.95)} SELECT image_id, preset, {m('conf')} AS confidence FROM ch",
    "feature_threshold": f"WITH {PX}, {_THRESH} {_out('image_id', _TH, 'ft')}",
    "threshold_strategy": f"WITH {PX}, {_THRESH}, {_chosen(PATTERNS, list(_TH.values()), 0.5, 0.96)} SELECT image_id, CASE WHEN nv < {d(0.01)} THEN 'abstain' ELSE preset END AS strategy, CASE WHEN nv < {d(0.01)} OR preset = 'abstain' THEN 0 ELSE {m('conf')} END AS confidence FROM ch",
    "raster_perceptual_hash": _PHASH,
    "raster_delta_e": f"WITH {PX}, one AS (SELECT 0 AS image_id, 0 AS y, 0 AS x, {REFERENCE[0]} AS r, {REFERENCE[1]} AS g, {REFERENCE[2]} AS b), k AS {_lab('one')}, o AS {_lab('px')} SELECT o.image_id, o.y, o.x, CAST(round_even(sqrt(CAST((o.l - k.l) * (o.l - k.l) + (o.a - k.a) * (o.a - k.a) + (o.b_ - k.b_) * (o.b_ - k.b_) AS DOUBLE)), 0) AS BIGINT) AS delta FROM o CROSS JOIN k",
    "color_hsv_to_rgb": f"WITH {_HSV} SELECT p_partkey, {_HCH('k', 'x', '0', '0', 'x', 'k')} AS r, {_HCH('x', 'k', 'k', 'x', '0', '0')} AS g, {_HCH('0', '0', 'x', 'k', 'k', 'x')} AS b FROM q",
    "sheet_presence": f"WITH {_PRES} SELECT * FROM pf",
    "sheet_runs": f"WITH {_RUNS} SELECT * FROM rn",
    "sheet_run_cells": f"""WITH {_RUNS}, z AS (SELECT image_id, axis, count(*) AS size FROM pf GROUP BY 1, 2), j AS (SELECT z.image_id, z.axis, size, count(first) AS n, size // greatest(count(first), 1) AS cell, list((first, last)) FILTER (first IS NOT NULL) AS rs FROM z LEFT JOIN rn USING (image_id, axis) GROUP BY 1, 2, 3),
 w AS (SELECT image_id, axis, n, CASE WHEN n < 2 THEN 'too_few_content_runs' WHEN size % n <> 0 THEN 'run_count_does_not_divide' WHEN cell < 4 THEN 'grid_too_small' WHEN EXISTS (SELECT 1 FROM rn WHERE rn.image_id = j.image_id AND rn.axis = j.axis AND rn.last >= (rn.first // j.cell + 1) * j.cell) THEN 'content_run_crosses_a_cell' ELSE '' END AS refusal FROM j) SELECT image_id, axis, CASE WHEN refusal = '' THEN n END AS cells, refusal FROM w""",
    "sheet_cells": """WITH p AS (SELECT p_partkey, p_partkey % 48 + 1 AS size, CASE WHEN p_size % 9 > 0 THEN p_size % 9 END AS period, p_partkey % 101 AS strength FROM part), q AS (SELECT *, CASE WHEN period IS NULL OR strength < 50 THEN '' WHEN period < 4 THEN 'grid_too_small' WHEN size % period <> 0 THEN 'period_does_not_divide' ELSE '' END AS pr, CASE WHEN period IS NULL THEN 'nothing_declared' WHEN period < 4 THEN 'cell_too_small' WHEN size % period <> 0 THEN 'does_not_divide' ELSE '' END AS dr FROM p)
 SELECT p_partkey, CAST(CASE WHEN period IS NULL OR strength < 50 OR pr <> '' THEN 1 ELSE size // period END AS BIGINT) AS period_cells, pr AS period_refusal, CASE WHEN dr = '' THEN CAST(size // period AS BIGINT) END AS declared, dr AS declared_refusal, (SELECT min(CAST(pow(2, k.v) AS BIGINT)) FROM range(8) k(v) WHERE pow(2, k.v) >= size) AS extent FROM q""",
    "normal_flip": f"WITH {PX} SELECT image_id, y, x, r, 255 - g AS g, b FROM px",
    "render_lighting": f"WITH {PX}, a AS (SELECT image_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER ((r + g + b) * 1000 >= 764235) AS k, CAST(sum({LUM}) AS BIGINT) AS l, {_HUGE.format(LUM)} AS ll FROM px GROUP BY 1) {_out('image_id', {'clipped': 'k / n', 'variation': 'CASE WHEN l <= 0 THEN ' + d(0.0) + ' ELSE ' + one(dev('ll', 'l') + ' / (l / n)') + ' END'}, 'a')}",
    "feature_voice": f"WITH {SERIES} {_out('series, frame', VOICE, 'fe')}",
    "feature_recording": f"WITH {SERIES} {_out('series, frame', RECORDING, 'fe')}",
    "feature_rhythm": f"WITH {RHYTHM} {_out('series', RHYTHM_PARTS, 'rh')}",
}
