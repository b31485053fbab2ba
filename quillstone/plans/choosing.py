"""Chosen filters, thresholds, resampling, tone curves, cutouts and regions on images of three kinds, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.operators import choosing as C
from quillstone.operators import editing as E
from quillstone.operators import perception as P
from quillstone.operators import raster as R
from quillstone.plans import perception as V
from quillstone.plans import raster as S
from quillstone.plans.perception import m
from quillstone.plans.raster import LUM, PALETTE, PX, SIZED, ch, d, pixels, three

c = F.col
#: Patterns of corners (luma) with their weights, exemplars of regions, and layers with weights by rule.
CORNERS = [((0.2, 0.6, 0.2, 0.6), (0.4, 0.1, 0.4, 0.1)), ((0.6, 0.6, 0.2, 0.2), (0.1, 0.1, 0.4, 0.4)), ((0.4, 0.4, 0.4, 0.7), (0.3, 0.3, 0.3, 0.1)), ((0.7, 0.4, 0.4, 0.4), (0.1, 0.3, 0.3, 0.3))]
REGIONS = [("flat_fill", (0.0, 0.3, 0.6, 0.9, 0.4)), ("thin_stroke", (0.0, 0.3, 0.4, 0.5, 0.6)), ("photo_texture", (0.0, 1.0, 0.8, 1.0, 0.0))]
_rule = lambda rows, columns: [[((7 * i + 3 * j + i * j) % 11 - 5) / 4.0 for j in range(columns)] for i in range(rows)]
TONE = [(_rule(3, 8), [0.25, -0.5, 0.125], "relu"), (_rule(4, 3), [0.5, -0.25, 0.0, 0.25], "sigmoid")]
BLEND = [(_rule(3, 4), [0.5, 0.25, 0.125], "relu"), (_rule(2, 3), [-0.25, 0.5], "sigmoid")]


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth image is noise; of the others the edge is light and calm and the inside darker by steps."""
    px = pixels(spark, sf_dir)
    edge = ~(c("y").between(2, 7) & c("x").between(2, 7))
    value = lambda n: F.when(c("image_id") % 4 == 0, c(n)).when(edge, 200 + c(n) % 8).otherwise(F.floor(c(n) / (1 + c("image_id") % 4)).cast("int"))
    return px.select("image_id", "y", "x", *[value(n).alias(n) for n in "rgb"])


def choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = P.filtering(staged(spark, sf_dir))
    return P.chosen(features, features.columns[1:], V.FILTERS, 0.4, 0.95)


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filtered(staged(spark, sf_dir), choice(spark, sf_dir))


def binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = staged(spark, sf_dir)
    return C.binarised(px, P.threshold_strategy(P.thresholding(px), V.PATTERNS))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.millionths(C.tone_curves(staged(spark, sf_dir), TONE), "image_id")


def toned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves as published, in millionths, so that both engines start from the same numbers."""
    exact = curves(spark, sf_dir).select("image_id", *[(c(n) / F.lit(1e6)).alias(n) for n in ("gamma", "lift", "gain")])
    return C.toned(staged(spark, sf_dir), exact)


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.adaptive_filter(staged(spark, sf_dir), BLEND)
    return found.select("image_id", "y", "x", "r", "g", "b", fixed(c("sharp")).alias("sharp"))


def cutouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.cutout(staged(spark, sf_dir))
    return found.select("image_id", "y", "x", "a", fixed(c("distance")).alias("distance"))


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.traceable(C.region_features(R.quantize(staged(spark, sf_dir), PALETTE)), REGIONS)
    return found.select("image_id", "component", "area", "status", "label", *[fixed(c(n)).alias(n) for n in ("unique_ratio", "compactness", "fill_ratio", "chroma", "similarity", "confidence")])


QUERIES = {
    "filter_applied": filters, "threshold_applied": binarised, "resample_patterns": lambda s, f: C.resample_by_pattern(staged(s, f), 7, 13, CORNERS), "tone_curve": curves, "tone_applied": toned,
    "feature_local": lambda s, f: V.millionths(C.local_features(staged(s, f)), "image_id", "y", "x"), "adaptive_filter": blended, "cutout_pixels": cutouts, "cutout_verdict": lambda s, f: C.cutout_verdict(staged(s, f)),
    "cutout_on_white": lambda s, f: C.on_white(C.cutout(staged(s, f)).withColumn("a", F.when(c("a") > 0, 255).otherwise(c("x") * 20))), "region_trace": traced,
}

_IN = "y BETWEEN 2 AND 7 AND x BETWEEN 2 AND 7"
_STAGED = f"{PX.replace('px AS', 'p0 AS', 1)}, px AS (SELECT image_id, y, x, {three(lambda n: f'CAST(CASE WHEN image_id % 4 = 0 THEN {n} WHEN NOT ({_IN}) THEN 200 + {n} % 8 ELSE {n} // (1 + image_id % 4) END AS INT)')} FROM p0)"


def _on(sql: str) -> str:
    """SQL over the plain images as SQL over the staged ones."""
    return sql.replace(PX, _STAGED)


def _net(inputs: list[str], layers: list, source: str, keys: str) -> str:
    """Common tables n1, n2 ... that put a row's inputs through the layers; the outputs are o0, o1 ..."""
    parts, names = [], inputs
    for k, (weights, biases, activation) in enumerate(layers):
        sums = [f"{d(float(b))} + " + " + ".join(f"{d(float(w))} * ({x})" for w, x in zip(row, names, strict=True)) for row, b in zip(weights, biases, strict=True)]
        act = {"relu": lambda x: f"greatest({d(0.0)}, {x})", "sigmoid": lambda x: f"{d(1.0)} / ({d(1.0)} + exp(-({x})))"}[activation]
        out = [f"{'o' if k == len(layers) - 1 else f'h{k}_'}{i}" for i in range(len(sums))]
        parts.append(f"n{k} AS (SELECT {keys}, {', '.join(f'{act(x)} AS {o}' for x, o in zip(sums, out, strict=True))} FROM {source})")
        names, source = out, f"n{k}"
    return ", ".join(parts)


_FT = list(V._FT.values())
_CH = f"WITH {_STAGED}, {V._FILTER}, {V._chosen(V.FILTERS, _FT, 0.4, 0.95)} SELECT image_id, preset FROM ch"
_SHARP = lambda s: [[0, -s, 0], [-s, 1 + 4 * s, -s], [0, -s, 0]]
_SOFT = E.gaussian_kernel(1, 0.8)
_SOFT_SQL = S._kernel(_SOFT, sum(v for row in _SOFT for v in row))
_ACTS = {"denoise_soft": _SOFT_SQL, "sharpen_subtle": S._kernel(_SHARP(0.5)), "edge_accentuate": S._SOBEL, "emboss_texture": S._kernel(S._EMBOSS, 1.0, 128.0), "pass_through": f"WITH {PX} SELECT image_id, y, x, r, g, b FROM px"}
_STRAT = f"WITH {_STAGED}, {V._THRESH}, {V._chosen(V.PATTERNS, list(V._TH.values()), 0.5, 0.96)} SELECT image_id, CASE WHEN nv < {d(0.01)} THEN 'abstain' ELSE preset END AS strategy FROM ch"
_T = [f"({V._AT(p)})" for p in (5, 25, 50, 75, 95)] + [f"(CAST(l AS DOUBLE) / n / {V._W})", f"({V.dev('ll', 'l')} / {V._W})", f"((v[c] - v[1]) / {V._W})"]
_CURVE = f"{_STAGED}, {V._TONE}, {_net(_T, TONE, 't', 'image_id')}, cu AS (SELECT image_id, {m(f'{d(0.5)} + o0 * {d(1.5)}')} AS gamma, {m(f'o1 * {d(0.1)}')} AS lift, {m(f'{d(0.8)} + o2 * {d(0.4)}')} AS gain, {m('o3')} AS pivot FROM n1)"
_LF = f"""l0 AS (SELECT image_id, y, x, CAST({LUM} AS BIGINT) AS l FROM px), l1 AS (SELECT a.image_id, a.y, a.x, any_value(a.l) AS l, CAST(count(*) AS DOUBLE) AS n, CAST(sum(p.l) AS BIGINT) AS s, CAST(sum(p.l * p.l) AS BIGINT) AS ss, CAST(sum(abs(p.l - a.l)) AS BIGINT) AS dd FROM l0 a JOIN l0 p ON p.image_id = a.image_id AND abs(p.y - a.y) <= 1 AND abs(p.x - a.x) <= 1 GROUP BY 1, 2, 3),
 l2 AS (SELECT image_id, y, x, least({d(1.0)}, dd / n / {d(480000.0)}) AS grad_mag, least({d(1.0)}, sqrt(greatest({d(0.0)}, ss / n - (s / n) * (s / n))) / {d(640000.0)}) AS norm_var, least({d(1.0)}, abs(l - s / n) / {d(320000.0)}) AS hf_energy FROM l1),
 lf AS (SELECT *, greatest({d(0.0)}, least({d(1.0)}, norm_var * {d(0.8)} - grad_mag * {d(0.5)})) AS noise_proxy FROM l2)"""
_LN = ["grad_mag", "norm_var", "hf_energy", "noise_proxy"]
_BL = lambda n: ch(f"k.{n} * (o0 / coalesce(nullif(o0 + o1, 0), 1)) + z.{n} * (o1 / coalesce(nullif(o0 + o1, 0), 1))")
_CUT = f"""{_STAGED}, bo AS (SELECT image_id, r, g, b FROM px WHERE NOT ({_IN})), bs AS (SELECT image_id, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'CAST(sum({x}) AS BIGINT) AS s{x}, CAST(sum({x} * {x}) AS BIGINT) AS q{x}' for x in 'rgb')} FROM bo GROUP BY 1),
 sp AS (SELECT image_id, sqrt(greatest({d(0.0)}, ({' + '.join(f'(q{x} / n - (s{x} / n) * (s{x} / n))' for x in 'rgb')}) / {d(3.0)})) / {d(255.0)} AS spread FROM bs),
 nd AS (SELECT px.image_id, px.y, px.x, any_value(px.r) AS r, any_value(px.g) AS g, any_value(px.b) AS b, list_sort(list((px.r - bo.r) * (px.r - bo.r) + (px.g - bo.g) * (px.g - bo.g) + (px.b - bo.b) * (px.b - bo.b)))[1:5] AS k FROM px JOIN bo USING (image_id) GROUP BY 1, 2, 3),
 cu AS (SELECT image_id, y, x, r, g, b, list_sum(list_transform(k, lambda v: sqrt(CAST(v AS DOUBLE)))) / {d(5.0)} AS distance FROM nd)"""
_SHARE = "(k / CAST(n AS DOUBLE))"
_WHITE = lambda n: ch(f"{n} * (a / {d(255.0)}) + {d(255.0)} * ({d(1.0)} - a / {d(255.0)})")
_QUANT = "(SELECT i FROM (VALUES " + ", ".join(f"({i}, {p[0]}, {p[1]}, {p[2]})" for i, p in enumerate(PALETTE)) + ") e(i, er, eg, eb) ORDER BY 299 * (r - er) * (r - er) + 587 * (g - eg) * (g - eg) + 114 * (b - eb) * (b - eb), i LIMIT 1)"
_SPAN = "[" + ", ".join(str(max(p) - min(p)) for p in PALETTE) + "]"
_NAMES = ["luma_std", "unique_ratio", "compactness", "fill_ratio", "chroma"]
_FAR = lambda p: "sqrt(" + " + ".join(f"({n} - {d(float(v))}) * ({n} - {d(float(v))})" for n, v in zip(_NAMES, p, strict=True)) + ")"
_CORNER = S._BILINEAR.rsplit("SELECT", 1)[0]
_JOINED = ", ".join(f"{t}.{n} AS {t}{n}" for t in "abce" for n in "rgb")
_LC = ", ".join(f"(2126 * {t}r + 7152 * {t}g + 722 * {t}b) / {d(10000.0)} / {d(255.0)} AS l{t}" for t in "abce")
_GAP = lambda p: " + ".join(f"(l{t} - {d(v)}) * (l{t} - {d(v)})" for t, v in zip("abce", p, strict=True))
_MIX = lambda n: ch(f"CASE WHEN matched THEN a{n} * z.w[1] + b{n} * z.w[2] + c{n} * z.w[3] + e{n} * z.w[4] ELSE (a{n} * ({d(1.0)} - dx) + b{n} * dx) * ({d(1.0)} - dy) + (c{n} * ({d(1.0)} - dx) + e{n} * dx) * dy END")
_RESAMPLED = f"""{_on(_CORNER)}, jo AS (SELECT v.image_id, v.y, v.x, dx, dy, {_JOINED} FROM v {' '.join(f'JOIN px {t} ON {t}.image_id = v.image_id AND {t}.y = {yy} AND {t}.x = {xx}' for t, yy, xx in (('a', 'y0', 'x0'), ('b', 'y0', 'x1'), ('c', 'y1', 'x0'), ('e', 'y1', 'x1')))}),
 lu AS (SELECT *, {_LC} FROM jo), ne AS (SELECT *, list_sort([{', '.join(f"{{'far': {_GAP(q)}, 'i': {i}, 'w': [{', '.join(d(x) for x in w)}]}}" for i, (q, w) in enumerate(CORNERS))}])[1] AS z FROM lu),
 mt AS (SELECT *, z.far < {d(0.1)} AND (abs(lb - la + le - lc) / {d(2.0)} > {d(0.15)} OR abs(lc - la + le - lb) / {d(2.0)} > {d(0.15)}) AS matched FROM ne)
 SELECT image_id, y, x, {three(_MIX)}, matched FROM mt"""
ORACLES = {
    "filter_applied": " UNION ALL ".join(f"SELECT k.image_id, k.y, k.x, k.r, k.g, k.b FROM ({_on(sql)}) k JOIN ({_CH}) w ON w.image_id = k.image_id AND w.preset = '{name}'" for name, sql in _ACTS.items()),
    "threshold_applied": f"SELECT l.image_id, l.y, l.x, l.m FROM ({_on(S._LOCAL)}) l JOIN ({_STRAT}) w ON w.image_id = l.image_id AND w.strategy = 'adaptive_local' UNION ALL SELECT p.image_id, p.y, p.x, CASE WHEN {LUM} >= o.level * 10000 THEN 1 ELSE 0 END AS m FROM (WITH {_STAGED} SELECT * FROM px) p JOIN ({_on(S._OTSU)}) o USING (image_id) JOIN ({_STRAT}) w ON w.image_id = p.image_id AND w.strategy NOT IN ('adaptive_local', 'abstain')",
    "resample_patterns": _RESAMPLED,
    "tone_curve": f"WITH {_CURVE} SELECT * FROM cu",
    "tone_applied": f"WITH {_CURVE} SELECT px.image_id, y, x, {three(lambda n: ch(f'(pow(px.{n} / {d(255.0)}, {d(1.0)} / (gamma / {d(1e6)})) * (gain / {d(1e6)}) + lift / {d(1e6)}) * {d(255.0)}'))} FROM px JOIN cu USING (image_id)",
    "feature_local": f"WITH {_STAGED}, {_LF} SELECT image_id, y, x, {', '.join(f'{m(n)} AS {n}' for n in _LN)} FROM lf",
    "adaptive_filter": f"WITH {_STAGED}, {_LF}, {_net(_LN, BLEND, 'lf', 'image_id, y, x')} SELECT n1.image_id, n1.y, n1.x, {three(_BL)}, {m('o0 / coalesce(nullif(o0 + o1, 0), 1)')} AS sharp FROM n1 JOIN ({_on(S._kernel(_SHARP(0.8)))}) k ON k.image_id = n1.image_id AND k.y = n1.y AND k.x = n1.x JOIN ({_on(_SOFT_SQL)}) z ON z.image_id = n1.image_id AND z.y = n1.y AND z.x = n1.x",
    "cutout_pixels": f"WITH {_CUT} SELECT image_id, y, x, CASE WHEN distance >= {d(48.0)} THEN 255 ELSE 0 END AS a, {m('distance')} AS distance FROM cu",
    "cutout_verdict": f"WITH {_CUT}, f AS (SELECT image_id, count(*) AS n, count(*) FILTER (distance >= {d(48.0)}) AS k, CAST(sum({m('distance')}) AS BIGINT) AS dd FROM cu GROUP BY 1), v AS (SELECT *, CASE WHEN spread > {d(0.22)} THEN 'busy_border' WHEN {_SHARE} < {d(0.02)} OR {_SHARE} > {d(0.92)} THEN 'implausible_foreground' ELSE '' END AS reason FROM f JOIN sp USING (image_id)) SELECT image_id, CASE WHEN reason = '' THEN 'suggest' ELSE 'abstain' END AS status, reason, CASE WHEN reason <> 'busy_border' THEN {m(_SHARE)} END AS foreground, {m('spread')} AS spread, CASE WHEN reason = '' THEN {m(f'greatest({d(0.0)}, least({d(0.95)}, {d(0.55)} + (dd / {d(1e6)} / n - {d(48.0)}) / {d(255.0)} + ({d(0.22)} - spread)))')} ELSE 0 END AS confidence FROM v",
    "cutout_on_white": f"WITH {_CUT}, w AS (SELECT *, CASE WHEN distance >= {d(48.0)} THEN 255 ELSE x * 20 END AS a FROM cu) SELECT image_id, y, x, {three(_WHITE)} FROM w",
    "region_trace": f"""WITH RECURSIVE {_STAGED}, q AS (SELECT image_id, y, x, {_QUANT} AS e FROM px),
 re AS (SELECT image_id, y, x, e, y * 10 + x AS s FROM q UNION SELECT n.image_id, n.y, n.x, n.e, re.s FROM re JOIN q n ON n.image_id = re.image_id AND n.e = re.e AND abs(n.y - re.y) + abs(n.x - re.x) = 1),
 co AS (SELECT image_id, y, x, e, CAST(min(s) AS BIGINT) AS component FROM re GROUP BY 1, 2, 3, 4),
 si AS (SELECT a.image_id, a.y, a.x, count(*) AS k FROM q a JOIN q n ON n.image_id = a.image_id AND n.e = a.e AND abs(n.y - a.y) + abs(n.x - a.x) = 1 GROUP BY 1, 2, 3),
 ag AS (SELECT image_id, component, count(*) AS area, count(*) * 4 - CAST(coalesce(sum(k), 0) AS BIGINT) AS outline, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box, any_value(e) AS e FROM co LEFT JOIN si USING (image_id, y, x) GROUP BY 1, 2),
 fe AS (SELECT image_id, component, area, {d(0.0)} AS luma_std, {d(1.0)} / area AS unique_ratio, least({d(1.0)}, {d(4.0 * math.pi)} * area / (outline * outline)) AS compactness, least({d(1.0)}, area / CAST(box AS DOUBLE)) AS fill_ratio, {_SPAN}[e + 1] / {d(255.0)} AS chroma FROM ag),
 be AS (SELECT *, list_sort([{', '.join(f"{{'far': {_FAR(p)}, 'i': {i}, 'name': '{n}'}}" for i, (n, p) in enumerate(REGIONS))}])[1] AS z FROM fe), si2 AS (SELECT *, greatest({d(0.0)}, {d(1.0)} - z.far / {d(math.sqrt(5))}) AS similarity FROM be)
 SELECT image_id, component, area, CASE WHEN similarity >= {d(0.55)} AND z.name <> 'photo_texture' THEN 'suggest' ELSE 'abstain' END AS status, z.name AS label, {', '.join(f'{m(n)} AS {n}' for n in _NAMES[1:])}, {m('similarity')} AS similarity, {m(f"CASE WHEN similarity >= {d(0.55)} AND z.name <> 'photo_texture' THEN least({d(0.96)}, similarity) ELSE similarity END")} AS confidence FROM si2""",
}
