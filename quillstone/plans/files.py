"""Drawings, point clouds, training, warping and texture periods over the base tables, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import kernels as K
from quillstone.operators import raster as R
from quillstone.operators import signals as S
from quillstone.operators import training as T
from quillstone.plans.raster import LUM, PX, pixels
from quillstone.plans.retrieval import _doc_features, read
from quillstone.sources import drawings as D
from quillstone.sources import points as P

c = F.col
#: Labelled examples that a network is trained on, by number of document.
EXAMPLES, SEEDS = 600, (5, 17, 29)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    m = k % 3
    return read(spark, sf_dir, "part").select(
        F.floor(k / 50).cast("long").alias("drawing_id"), (k % 50).cast("int").alias("ordinal"), F.element_at(F.array(*[F.lit(x) for x in D.KINDS]), (m + 1).cast("int")).alias("kind"), F.concat(F.lit("L"), (k % 4).cast("string")).alias("layer"),
        (k * 37 % 1000 - 500).alias("a"), (k * 91 % 1000).alias("b"), F.when(m < 2, k * 53 % 700 + 1).alias("c"), F.when(m == 0, k * 71 % 300).alias("d"), F.when(m == 2, c("p_name")).alias("label"),
    )


def svg_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.to_svg(entities(spark, sf_dir)).select("drawing_id", F.sha2("svg", 256).alias("digest"), F.length("svg").cast("long").alias("size"))


def svg_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_svg(D.to_svg(entities(spark, sf_dir))).select(*D.COLUMNS)


def dxf_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_dxf(D.to_dxf(entities(spark, sf_dir))).select(*D.COLUMNS)


def drawing_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    broken = e.withColumn("kind", F.when(c("a") % 11 == 0, "spline").otherwise(c("kind"))).withColumn("c", F.when(c("b") % 7 == 0, 0).otherwise(c("c"))).withColumn("label", F.when(c("b") % 5 == 0, "").otherwise(c("label")))
    return D.problems(broken, e.where("layer <> 'L3'").select("drawing_id", "layer").distinct())


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return P.reports(P.clouds(e.select(c("user_id").alias("cloud"), c("event_id").alias("place"), (c("event_id") % 100).cast("double").alias("x"), c("value").alias("y"), F.length("event_type").cast("double").alias("z"))))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether networks of three seeds tell good documents from bad on features that are held out."""
    rows = _doc_features(spark, sf_dir).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES).select("v", "label").collect()  # a bounded sample
    x = np.array([r["v"] for r in rows], dtype=float) / 1e6
    y = np.array([int(r["label"]) for r in rows])
    return T.by_seed(spark, x, y, 6, 2, SEEDS).select("seed", "parameters", (c("accuracy") >= 0.9).alias("passed"))


def warp_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of images against the next row: distances that are negative, unlike from the other side, or above the straight pairing's."""
    rows = pixels(spark, sf_dir).groupBy("image_id", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "r"))), lambda z: z["r"]).alias("s"))
    near = rows.join(rows.select("image_id", (c("y") - 1).alias("y"), c("s").alias("t")), ["image_id", "y"])

    def run(batches):
        for batch in batches:
            wrong = []
            for a, b in zip(batch["s"], batch["t"], strict=True):
                one, other = K.warp(a, b), K.warp(b, a)
                wrong.append(int(one < 0 or abs(one - other) > 1e-9 or one > sum(abs(int(p) - int(q)) for p, q in zip(a, b, strict=True)) / len(a) + 1e-9 or K.warp(a, a) != 0))
            yield batch[["image_id"]].assign(wrong=wrong)

    return near.select("image_id", "s", "t").mapInPandas(run, "image_id long, wrong int").agg(F.sum("wrong").alias("violations"), F.count("*").alias("pairs"))


def texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period of each image's columns: the lag at which the luma of columns, less 128, goes best with itself."""
    p = R.profile(pixels(spark, sf_dir), "x")
    series = p.select(c("image_id").alias("series"), c("place"), (F.expr("luma_sum div n") - 1_280_000).alias("v"))
    return S.period(S.autocorrelation(series, 5)).withColumnRenamed("series", "image_id")


QUERIES = {"drawing_svg": svg_text, "drawing_svg_back": svg_back, "drawing_dxf_back": dxf_back, "drawing_problems": drawing_problems, "points_ply": clouds, "training_seeds": training, "kernel_warp": warp_violations, "texture_period": texture}

_E = "e AS (SELECT p_partkey // 50 AS drawing_id, CAST(p_partkey % 50 AS INT) AS ordinal, ['line', 'circle', 'text'][p_partkey % 3 + 1] AS kind, 'L' || p_partkey % 4 AS layer, p_partkey * 37 % 1000 - 500 AS a, p_partkey * 91 % 1000 AS b, CASE WHEN p_partkey % 3 < 2 THEN p_partkey * 53 % 700 + 1 END AS c, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 71 % 300 END AS d, CASE WHEN p_partkey % 3 = 2 THEN p_name END AS label FROM part)"
_LINE = """CASE kind WHEN 'line' THEN '<line class="' || layer || '" x1="' || a || '" y1="' || b || '" x2="' || c || '" y2="' || d || '"/>' WHEN 'circle' THEN '<circle class="' || layer || '" cx="' || a || '" cy="' || b || '" r="' || c || '"/>' ELSE '<text class="' || layer || '" x="' || a || '" y="' || b || '">' || label || '</text>' END || chr(10)"""
ORACLES = {
    "drawing_svg": f"""WITH {_E}, t AS (SELECT drawing_id, '<svg xmlns="http://www.w3.org/2000/svg">' || chr(10) || string_agg({_LINE}, '' ORDER BY ordinal) || '</svg>' || chr(10) AS svg FROM e GROUP BY drawing_id) SELECT drawing_id, sha256(svg) AS digest, length(svg) AS size FROM t""",
    "drawing_svg_back": f"WITH {_E} SELECT * FROM e",
    "drawing_dxf_back": f"WITH {_E} SELECT * FROM e",
    "drawing_problems": f"WITH {_E}, k AS (SELECT drawing_id, ordinal, layer, CASE WHEN a % 11 = 0 THEN 'spline' ELSE kind END AS kind, CASE WHEN b % 7 = 0 THEN 0 ELSE c END AS c, CASE WHEN b % 5 = 0 THEN '' ELSE label END AS label FROM e), p AS (SELECT drawing_id, ordinal, CASE WHEN kind = 'spline' THEN 'unknown_kind' WHEN layer = 'L3' THEN 'unknown_layer' WHEN kind = 'circle' AND coalesce(c, 0) <= 0 THEN 'no_radius' WHEN kind = 'text' AND coalesce(label, '') = '' THEN 'no_label' END AS problem FROM k) SELECT * FROM p WHERE problem IS NOT NULL",
    "points_ply": "SELECT user_id AS cloud, 'vertex' AS element, count(*) AS points, 12 AS stride, count(*) * 12 + length('ply' || chr(10) || 'format binary_little_endian 1.0' || chr(10) || 'element vertex ' || count(*) || chr(10) || 'property float x' || chr(10) || 'property float y' || chr(10) || 'property float z' || chr(10) || 'end_header' || chr(10)) AS bytes, true AS restored FROM events GROUP BY user_id",
    "training_seeds": f"SELECT seed, 44 AS parameters, true AS passed FROM (VALUES {', '.join(f'({s})' for s in SEEDS)}) s(seed)",
    "kernel_warp": f"WITH {PX} SELECT CAST(count(*) FILTER (r < 0) AS BIGINT) AS violations, count(DISTINCT (image_id, y)) - count(DISTINCT image_id) AS pairs FROM px",
    "texture_period": f"WITH {PX}, s AS (SELECT image_id AS series, x AS i, CAST(sum({LUM}) // count(*) - 1280000 AS BIGINT) AS v FROM px GROUP BY 1, 2), lg AS (SELECT a.series, k.v AS lag, sum(a.v * b.v) AS p, count(*) AS n FROM s a CROSS JOIN range(1, 6) k(v) JOIN s b ON a.series = b.series AND b.i = a.i + k.v GROUP BY ALL), m AS (SELECT series, lag, CAST(trunc(CAST(p AS DECIMAL(38, 0)) / n) AS BIGINT) AS m FROM lg) SELECT series AS image_id, CAST(CASE WHEN max(m) > 0 THEN first(lag ORDER BY m DESC, lag) ELSE 0 END AS INT) AS period FROM m GROUP BY series",
}
