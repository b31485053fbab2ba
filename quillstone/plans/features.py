"""Feature, selection and contract queries, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import features as X
from quillstone.operators import raster as R
from quillstone.plans import retrieval
from quillstone.plans.raster import LUM, PX, SIZED, d, pixels
from quillstone.plans.retrieval import read

c = F.col
STAR = ((0, 5), (9, 8), (3, 0), (3, 9), (9, 2))
PATH = ((1, 1), (4, 5), (8, 8))
SPECS = ("50%", "150%x25%", "40", "x30", "64x64", "64x64!", "64x64^", "20x20>", "200x200>", "200x200<", "10x10<", "big", "")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mask_of(pixels(spark, sf_dir), 140)


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = mask(spark, sf_dir)
    return m, m.withColumn("image_id", c("image_id") - 1).where("image_id >= 0")


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.phase(X.loop(*pairs(spark, sf_dir)))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, out = pixels(spark, sf_dir), None
    for name, part in (("rectangle", X.rectangle(px, 2, 3, 7, 9)), ("ellipse", X.ellipse(px, 5, 4, 4, 3)), ("polygon", X.polygon(px, STAR)), ("brush", X.brush(px, PATH, 2))):
        part = part.withColumn("shape", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def feathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return X.blend(px, R.invert(px), X.feather(X.rectangle(px, 2, 3, 7, 9)))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", (c("p_size") + 10).alias("w"), (c("p_partkey") % 90 + 5).alias("h"))
    spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (c("p_partkey") % len(SPECS) + 1).cast("int"))
    return p.withColumn("z", X.geometry(spec, c("w"), c("h"))).select("p_partkey", c("z.w").alias("w"), c("z.h").alias("h"))


def prosody(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return X.syllables(e.select(c("user_id").alias("series"), F.struct("ts", "event_id").alias("place"), (c("event_type") == "click").alias("stress"), F.rint(c("value") * 100).cast("long").alias("duration")))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = retrieval.QUERIES["knn_quality_vote"](spark, sf_dir).withColumn("output", c("label"))
    w = retrieval.some_verdicts(spark, sf_dir).withColumn("output", c("top_id").cast("string"))
    cols = ["query_id", "output", "confidence", "status", "reason"]
    return X.contract_violations(X.results(v.select(cols), "quality-vote").unionByName(X.results(w.select(cols), "lexical")))


QUERIES = {
    "feature_anchor": lambda s, f: X.anchor(mask(s, f)), "feature_loop": loops, "feature_mask_report": lambda s, f: X.mask_report(mask(s, f)), "feature_region": lambda s, f: X.region(pixels(s, f), 2, 1, 8, 7), "feature_anomaly": lambda s, f: X.anomaly(pixels(s, f)),
    "feature_histogram_peaks": lambda s, f: X.histogram_peaks(pixels(s, f)), "feature_prosody": prosody, "selection_shapes": selections, "selection_feather": feathered, "geometry_sizes": sizes, "result_contract": contract,
}

_M = f"m AS (SELECT image_id, y, x, CASE WHEN {LUM} >= 1400000 THEN 1 ELSE 0 END AS m FROM px)"
_EDGE = "(y = 0 OR x = 0 OR y = h - 1 OR x = w - 1)"


def _polygon() -> str:
    parts = []
    for (ay, ax), (by, bx) in zip(STAR, [*STAR[1:], STAR[0]], strict=True):
        if ay == by:
            continue
        if ay > by:
            ay, ax, by, bx = by, bx, ay, ax
        parts.append(f"CASE WHEN 2*y+1 >= {2 * ay} AND 2*y+1 < {2 * by} AND (2*x+1 - {2 * ax}) * {2 * (by - ay)} < (2*y+1 - {2 * ay}) * {2 * (bx - ax)} THEN 1 ELSE 0 END")
    return f"({' + '.join(parts)}) % 2 = 1"


_SHAPES = {"rectangle": "y >= 2 AND y < 7 AND x >= 3 AND x < 9", "ellipse": "(y - 5) * (y - 5) * 9 + (x - 4) * (x - 4) * 16 <= 144", "polygon": _polygon(), "brush": " OR ".join(f"(y - {y}) * (y - {y}) + (x - {x}) * (x - {x}) <= 4" for y, x in PATH)}


def _size_sql() -> str:
    rnd = lambda a, b: f"greatest(1, (2 * {a} + {b}) // (2 * {b}))"
    arms = {"50%": (rnd("w * 50", "100"), rnd("h * 50", "100")), "150%x25%": (rnd("w * 150", "100"), rnd("h * 25", "100")), "40": ("40", rnd("h * 40", "w")), "x30": (rnd("w * 30", "h"), "30"), "64x64!": ("64", "64"), "big": ("NULL", "NULL"), "": ("NULL", "NULL")}
    byw, byh = lambda n: (str(n), rnd(f"h * {n}", "w")), lambda n: (rnd(f"w * {n}", "h"), str(n))
    pick = lambda n, i, fill=False: f"CASE WHEN w > h THEN {(byh if fill else byw)(n)[i]} ELSE {(byw if fill else byh)(n)[i]} END"
    # in a square box the image is wider if w > h; equal sides give the same size either way
    arms |= {"64x64": (pick(64, 0), pick(64, 1)), "64x64^": (pick(64, 0, True), pick(64, 1, True))}
    for n, flag, keep in ((20, ">", "w <= 20 AND h <= 20"), (200, ">", "w <= 200 AND h <= 200"), (200, "<", "w > 200 OR h > 200"), (10, "<", "w > 10 OR h > 10")):
        arms[f"{n}x{n}{flag}"] = tuple(f"CASE WHEN {keep} THEN {own} ELSE {pick(n, i)} END" for i, own in enumerate("wh"))
    case = lambda i: "CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN {arms[s][i]}" for k, s in enumerate(SPECS)) + " END"
    return f"WITH p AS (SELECT p_partkey, p_size + 10 AS w, p_partkey % 90 + 5 AS h FROM part) SELECT p_partkey, CAST({case(0)} AS INT) AS w, CAST({case(1)} AS INT) AS h FROM p"


ORACLES = {
    "feature_anchor": f"WITH {PX}, {_M}, o AS (SELECT * FROM m WHERE m = 1), b AS (SELECT image_id, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, count(*) AS pixels, CAST(sum(y) AS BIGINT) AS y_sum, CAST(sum(x) AS BIGINT) AS x_sum FROM o GROUP BY 1) SELECT b.image_id, pixels, y0, x0, y1, x1, y_sum, x_sum, (SELECT count(*) FROM o WHERE o.image_id = b.image_id AND (o.y - y0 + 1) * 4 > 3 * (y1 - y0 + 1)) AS bottom, (SELECT count(*) FROM o JOIN o t ON t.image_id = o.image_id AND t.y = o.y AND t.x = b.x0 + b.x1 - o.x WHERE o.image_id = b.image_id) AS mirrored FROM b",
    "feature_loop": f"WITH {PX}, {_M}, n AS (SELECT image_id - 1 AS image_id, y, x, m FROM m WHERE image_id > 0), j AS (SELECT image_id, y, x, coalesce(m.m, 0) AS a, coalesce(n.m, 0) AS b FROM m FULL JOIN n USING (image_id, y, x)), g AS (SELECT image_id, count(*) FILTER (a = 1 AND b = 1) AS common, count(*) FILTER (a = 0 AND b = 1) AS added, count(*) FILTER (a = 1 AND b = 0) AS removed, CAST(sum(y * (b - a)) AS BIGINT) AS dy, CAST(sum(x * (b - a)) AS BIGINT) AS dx FROM j GROUP BY 1), h AS (SELECT *, CASE WHEN common + added + removed = 0 THEN 0 ELSE (added + removed) * 1000 // (common + added + removed) END AS change FROM g) SELECT *, CASE WHEN change <= 30 THEN 'hold' WHEN change >= 300 THEN 'impact' WHEN added >= removed THEN 'build' ELSE 'recover' END AS verdict FROM h",
    "feature_mask_report": f"WITH {PX}, {_M}, s AS (SELECT *, max(y) OVER (PARTITION BY image_id) + 1 AS h, max(x) OVER (PARTITION BY image_id) + 1 AS w, lead(m) OVER (PARTITION BY image_id, y ORDER BY x) AS e, lead(m) OVER (PARTITION BY image_id, x ORDER BY y) AS f FROM m), g AS (SELECT image_id, count(*) AS pixels, CAST(sum(m) AS BIGINT) AS set, count(*) FILTER ({_EDGE} AND m = 1) AS on_border, count(*) FILTER (e <> m) + count(*) FILTER (f <> m) AS edges FROM s GROUP BY 1) SELECT *, CASE WHEN set = 0 THEN 'empty' WHEN set * 100 > pixels * 95 THEN 'full' WHEN on_border * 2 > set THEN 'bleeds' ELSE 'safe' END AS verdict FROM g",
    "feature_region": f"WITH {PX} SELECT image_id, count(*) AS pixels, CAST(sum({LUM}) AS BIGINT) AS luma_sum, count(DISTINCT r * 65536 + g * 256 + b) AS colours, CAST(sum(greatest(r, g, b) - least(r, g, b)) AS BIGINT) AS chroma_sum FROM px WHERE y >= 2 AND y < 8 AND x >= 1 AND x < 7 GROUP BY 1",
    "feature_anomaly": f"WITH {PX}, {SIZED} SELECT image_id, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS r_sum, CAST(sum(g) AS BIGINT) AS g_sum, CAST(sum(b) AS BIGINT) AS b_sum, CAST(sum({LUM}) AS BIGINT) AS luma_sum, CAST(sum(({LUM} // 100) * ({LUM} // 100)) AS BIGINT) AS luma_squares, count(*) FILTER ({LUM} < 640000) AS dark, CAST(sum({LUM}) FILTER ({_EDGE}) AS BIGINT) AS border_sum, count(*) FILTER ({_EDGE}) AS border, CAST(sum(greatest(r, g, b) - least(r, g, b)) AS BIGINT) AS chroma_sum FROM s GROUP BY 1",
    "feature_histogram_peaks": f"WITH {PX}, k AS (SELECT DISTINCT image_id, b.v AS bin FROM px CROSS JOIN range(16) b(v)), n AS (SELECT image_id, least(15, {LUM} * 16 // 2560000) AS bin, count(*) AS n FROM px GROUP BY 1, 2), h AS (SELECT image_id, bin, coalesce(n, 0) AS n, coalesce(lag(coalesce(n, 0)) OVER w, 0) AS a, coalesce(lead(coalesce(n, 0)) OVER w, 0) AS z FROM k LEFT JOIN n USING (image_id, bin) WINDOW w AS (PARTITION BY image_id ORDER BY bin)) SELECT image_id, count(*) FILTER (n > a AND n > z) AS peaks, count(*) FILTER (n > 0) AS filled FROM h GROUP BY 1",
    "feature_prosody": "WITH s AS (SELECT user_id AS series, event_type = 'click' AS st, CAST(round_even(value * 100, 0) AS BIGINT) AS du, lead(event_type = 'click') OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT series, count(*) AS syllables, count(*) FILTER (st) AS stressed, count(*) FILTER (NOT st AND nx) AS iambs, count(*) FILTER (st AND NOT nx) AS trochees, CAST(sum(du) AS BIGINT) AS duration_sum, CAST(sum(du * du) AS BIGINT) AS duration_squares, max(du) FILTER (nx IS NULL) AS final FROM s GROUP BY 1",
    "selection_shapes": f"WITH {PX}" + " UNION ALL ".join(f" SELECT image_id, y, x, CASE WHEN {v} THEN 1 ELSE 0 END AS m, '{k}' AS shape FROM px" for k, v in _SHAPES.items()),
    "selection_feather": f"WITH {PX}, {SIZED}, k(dy, dx) AS (SELECT a.v, b.v FROM range(-1, 2) a(v) CROSS JOIN range(-1, 2) b(v)), w AS (SELECT image_id, y, x, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, CAST(sum(CASE WHEN greatest(0, least(h - 1, y + dy)) BETWEEN 2 AND 6 AND greatest(0, least(w - 1, x + dx)) BETWEEN 3 AND 8 THEN 1 ELSE 0 END) AS BIGINT) * 10000 // 9 AS wt FROM s CROSS JOIN k GROUP BY 1, 2, 3) SELECT image_id, y, x, " + ", ".join(f"CAST(round_even({n} + (255 - {n} - {n}) * wt / {d(10000.0)}, 0) AS INT) AS {n}" for n in "rgb") + " FROM w",
    "geometry_sizes": _size_sql(),
    "result_contract": "SELECT count(*) FILTER (doc_id < 0) AS violations, count(*) FILTER (doc_id % 50 = 0) + (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE doc_id % 50 = 0) AS results FROM documents",
}
