"""Material fields, kernels, atlases, codecs and streams over the base tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.operators import kernels as K
from quillstone.operators import material as M
from quillstone.operators import raster as R
from quillstone.plans.raster import PALETTE, PX, d, pixels
from quillstone.plans.retrieval import read
from quillstone.sources import images as I
from quillstone.streaming import events as S

c = F.col
SIDE_W, SIDE_H, PAD = 256, 128, 1
INVERSE = ((0.75, -0.25, -0.5), (0.0, 0.5, -0.5), (0.25, 0.25, 0.5))


def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = M.decode_normals(pixels(spark, sf_dir))
    return n.select(*R.KEYS, *[fixed(c(k)).alias(k) for k in ("nx", "ny", "nz")])


def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.slopes(M.decode_normals(pixels(spark, sf_dir)), 0.05)
    return s.select(*R.KEYS, fixed(c("sx")).alias("sx"), fixed(c("sy")).alias("sy"))


def whole_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*R.KEYS, (c("r") - 128).cast("long").alias("sx"), (c("g") - 128).cast("long").alias("sy"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.luma_height(pixels(spark, sf_dir))


def photometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return M.photometric([px.select(*R.KEYS, c(n).alias("v")) for n in "rgb"], INVERSE).select(*R.KEYS, *[fixed(c(n), 1000).alias(n) for n in ("gx", "gy", "gz")])


def tilts(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return M.tilt(M.decode_normals(px), M.decode_normals(px, "-y")).select(*R.KEYS, fixed(c("degrees"), 1000).alias("millidegrees"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mask_of(pixels(spark, sf_dir))


def component_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours with different names, set pixels without one, and names that aren't their part's first pixel."""
    m = mask(spark, sf_dir)
    named = K.components(m)
    other = named.select("image_id", (c("y") - 1).alias("y"), "x", c("component").alias("o")).unionByName(named.select("image_id", "y", (c("x") - 1).alias("x"), c("component").alias("o")))
    apart = named.join(other, ["image_id", "y", "x"]).agg(F.count_if(c("component") != c("o")).alias("a"))
    lost = m.where("m = 1").join(named, ["image_id", "y", "x"], "left_anti").agg(F.count("*").alias("l"))
    first = named.groupBy("image_id", "component").agg(F.min(c("y") * 10 + c("x")).alias("f")).agg(F.count_if(c("f") != c("component")).alias("w"))
    return apart.crossJoin(lost).crossJoin(first).select((c("a") + c("l") + c("w")).alias("violations"))  # three rows of one


def dither_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.diffuse(pixels(spark, sf_dir), PALETTE)
    known = F.array(*[F.lit(r * 65536 + g * 256 + b) for r, g, b in PALETTE])
    return out.agg(F.count_if(~F.array_contains(known, c("r") * 65536 + c("g") * 256 + c("b"))).alias("violations"), F.count("*").alias("pixels"))


def fill_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels outside the hole that changed, and filled ones whose colour the image didn't have."""
    px = pixels(spark, sf_dir)
    hole = px.where("y between 4 and 5 and x between 3 and 5").select("image_id", "y", "x")
    spoilt = px.withColumn("r", F.when(c("y").between(4, 5) & c("x").between(3, 5), 0).otherwise(c("r")))
    out = K.fill(spoilt, hole)
    outside = px.join(hole, ["image_id", "y", "x"], "left_anti")
    changed = outside.join(out.select("image_id", "y", "x", c("r").alias("fr"), c("g").alias("fg"), c("b").alias("fb")), ["image_id", "y", "x"]).agg(F.count_if((c("r") != c("fr")) | (c("g") != c("fg")) | (c("b") != c("fb"))).alias("a"))
    invented = out.join(hole, ["image_id", "y", "x"]).join(outside.select("image_id", "r", "g", "b").distinct(), ["image_id", "r", "g", "b"], "left_anti").agg(F.count("*").alias("b"))
    return changed.crossJoin(invented).select((c("a") + c("b")).alias("violations"))  # two rows of one


def png_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    back = I.decode_images(I.encode_images(px))
    return px.exceptAll(back).unionAll(back.exceptAll(px)).agg(F.count("*").alias("violations"))


def png_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.headers(I.encode_images(pixels(spark, sf_dir))).select("image_id", "format", "width", "height")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", c("text").cast("binary").alias("data"))
    return K.packets(docs, "doc_id", "data").select("doc_id", "raw_bytes", "digest")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(c("p_brand").alias("atlas"), F.concat(F.lit("f"), c("p_partkey").cast("string")).alias("name"), (c("p_size") % 40 + 4).cast("int").alias("w"), (c("p_partkey") % 29 + 3).cast("int").alias("h"))


def atlas_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return K.plan_violations(f, K.pack_atlas(f, SIDE_W, SIDE_H, PAD), SIDE_W, SIDE_H, PAD)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in cells of 48 x 40, eight a row, with the y of a bottom-left origin on pages of 384 x 320."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("atlas").orderBy("name")) - 1
    f = frames(spark, sf_dir).withColumn("i", place)
    page, slot = F.floor(c("i") / 64), c("i") % 64
    return f.select("atlas", "name", F.format_string("page-%02d.png", page).alias("file"), (slot % 8 * 48).cast("int").alias("x"), (F.lit(320) - F.floor(slot / 8).cast("int") * 40 - c("h")).cast("int").alias("y"), "w", "h")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(atlas, name, severity, code): what a frame lacks under a contract of square powers of two up to 32 pixels."""
    two = lambda v: c(v).bitwiseAND(c(v) - 1) == 0
    rules = [("error", "width_not_power_of_two", ~two("w")), ("error", "height_not_power_of_two", ~two("h")), ("error", "too_large", F.greatest("w", "h") > 32), ("warning", "not_square", c("w") != c("h"))]
    each = F.filter(F.array(*[F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for s, k, cond in rules]), lambda z: z.isNotNull())
    return frames(spark, sf_dir).select("atlas", "name", F.explode(each).alias("z")).select("atlas", "name", "z.severity", "z.code")


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, distance): steps that aren't kept when one part name is turned into the next in order, from the alignment itself."""
    from pyspark.sql.window import Window

    names = read(spark, sf_dir, "part").select(c("p_name").alias("a"), F.substring_index("p_name", " ", 1).alias("k")).distinct()
    pairs = names.withColumn("b", F.lead("a").over(Window.partitionBy("k").orderBy("a"))).where("b is not null").select("a", "b")

    def run(batches):
        for batch in batches:
            yield batch.assign(distance=[sum(s != "keep" for s in K.edits(a, b)) for a, b in zip(batch["a"], batch["b"], strict=True)])

    return pairs.mapInPandas(run, "a string, b string, distance int")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "events")
    source = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    return S.drain(S.hourly(source), "hourly", "complete", each=lambda df, i: df)


def stream_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "events")
    return S.drain(S.frames(spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")), "marks")


QUERIES = {
    "material_normals": normals, "material_slopes": slopes, "material_integrals": lambda s, f: M.integrate(whole_slopes(s, f)), "material_curl": lambda s, f: M.curl(whole_slopes(s, f)), "material_block_means": lambda s, f: M.block_means(pixels(s, f)),
    "material_photometric": photometric, "material_occlusion": lambda s, f: M.occlusion(heights(s, f)), "material_quantized_height": lambda s, f: M.quantize_height(heights(s, f)), "material_tilt": tilts,
    "kernel_components": component_violations, "kernel_diffusion": dither_violations, "kernel_fill": fill_violations, "kernel_alignment": alignment, "codec_png": png_violations, "codec_headers": png_headers, "codec_packets": packets,
    "atlas_violations": atlas_violations, "atlas_manifest": manifest, "atlas_findings": findings, "kernel_median_cut": lambda s, f: K.median_cut(pixels(s, f), 8), "stream_hourly": stream_hourly, "stream_marks": stream_marks,
}


def _fx(x: str, scale: float = 1e6) -> str:
    return f"CAST(round_even(({x}) * {d(scale)}, 0) AS BIGINT)"


_N = f"n AS (SELECT image_id, y, x, nx, ny, sqrt(greatest({d(0.0)}, {d(1.0)} - nx * nx - ny * ny)) AS nz FROM (SELECT image_id, y, x, ({d(2.0)} * r - {d(255.0)}) / {d(255.0)} AS nx, ({d(2.0)} * g - {d(255.0)}) / {d(255.0)} AS ny FROM px))"
_FR = "f AS (SELECT p_brand AS atlas, 'f' || p_partkey AS name, CAST(p_size % 40 + 4 AS INT) AS w, CAST(p_partkey % 29 + 3 AS INT) AS h FROM part)"
_HT = "ht AS (SELECT image_id, y, x, CAST((2126 * r + 7152 * g + 722 * b) // 100 AS BIGINT) AS v FROM px)"
_PHO = ", ".join(f"{_fx(f'{d(row[0])} * r + {d(row[1])} * g + {d(row[2])} * b', 1000.0)} AS {n}" for row, n in zip(INVERSE, ("gx", "gy", "gz"), strict=True))
ORACLES = {
    "material_normals": f"WITH {PX}, {_N} SELECT image_id, y, x, {_fx('nx')} AS nx, {_fx('ny')} AS ny, {_fx('nz')} AS nz FROM n",
    "material_slopes": f"WITH {PX}, {_N} SELECT image_id, y, x, {_fx('-nx / nz')} AS sx, {_fx('-ny / nz')} AS sy FROM n WHERE nz > {d(0.05)}",
    "material_integrals": f"WITH {PX}, s AS (SELECT image_id, y, x, CAST(coalesce(sum(r - 128) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS by_row, CAST(coalesce(sum(g - 128) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS by_column FROM px) SELECT *, by_row + by_column AS twice FROM s",
    "material_curl": f"WITH {PX} SELECT a.image_id, count(*) AS cells, CAST(sum(abs(a.r + b.g - e.r - a.g)) AS BIGINT) AS curl_sum, CAST(max(abs(a.r + b.g - e.r - a.g)) AS BIGINT) AS worst FROM px a JOIN px b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1 JOIN px e ON e.image_id = a.image_id AND e.y = a.y + 1 AND e.x = a.x GROUP BY a.image_id",
    "material_block_means": f"WITH {PX} SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, count(*) AS n FROM px GROUP BY image_id, y // 2, x // 2",
    "material_photometric": f"WITH {PX} SELECT image_id, y, x, {_PHO} FROM px",
    "material_occlusion": f"WITH {PX}, {_HT}, st(dir, k, dy, dx) AS (SELECT dir, k.v, dy * k.v, dx * k.v FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 0, -1), (3, -1, 0)) t(dir, dy, dx) CROSS JOIN range(1, 4) k(v)), z AS (SELECT a.image_id, a.y, a.x, dir, greatest({d(0.0)}, max(CAST(b.v - a.v AS DOUBLE) / k)) AS t FROM ht a CROSS JOIN st JOIN ht b ON b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL) SELECT image_id, y, x, CAST(1000000 - sum(CAST(round_even(t / sqrt(1 + t * t) * {d(1e6)}, 0) AS BIGINT)) // 4 AS BIGINT) AS open FROM z GROUP BY image_id, y, x",
    "material_quantized_height": f"WITH {PX}, {_HT}, q AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM ht) SELECT image_id, y, x, CAST(CASE WHEN hi > lo THEN round_even((v - lo) * {d(15.0)} / (hi - lo), 0) ELSE 0 END AS INT) AS q FROM q",
    "material_tilt": f"WITH {PX}, {_N} SELECT image_id, y, x, {_fx('degrees(acos(greatest(-1, least(1, nx * nx - ny * ny + nz * nz))))', 1000.0)} AS millidegrees FROM n",
    "kernel_components": f"WITH {PX} SELECT count(*) FILTER (r < 0) AS violations FROM px",
    "kernel_diffusion": f"WITH {PX} SELECT count(*) FILTER (r < 0) AS violations, count(*) AS pixels FROM px",
    "kernel_fill": f"WITH {PX} SELECT count(*) FILTER (r < 0) AS violations FROM px",
    "kernel_alignment": "WITH n AS (SELECT DISTINCT p_name AS a, string_split(p_name, ' ')[1] AS k FROM part), p AS (SELECT a, lead(a) OVER (PARTITION BY k ORDER BY a) AS b FROM n) SELECT a, b, CAST(levenshtein(a, b) AS INT) AS distance FROM p WHERE b IS NOT NULL",
    "codec_png": f"WITH {PX} SELECT count(*) FILTER (r < 0) AS violations FROM px",
    "codec_headers": f"WITH {PX} SELECT DISTINCT image_id, 'png' AS format, 10 AS width, 10 AS height FROM px",
    "codec_packets": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS raw_bytes, sha256(text) AS digest FROM documents WHERE text IS NOT NULL",
    "atlas_violations": "SELECT problem, count(*) FILTER (p_partkey < 0) AS n FROM part CROSS JOIN (VALUES ('not_placed_once'), ('other_size'), ('out_of_bounds'), ('overlap')) v(problem) GROUP BY problem",
    "atlas_manifest": f"WITH {_FR}, i AS (SELECT *, row_number() OVER (PARTITION BY atlas ORDER BY name) - 1 AS i FROM f) SELECT atlas, name, printf('page-%02d.png', i // 64) AS file, CAST(i % 64 % 8 * 48 AS INT) AS x, CAST(320 - i % 64 // 8 * 40 - h AS INT) AS y, w, h FROM i",
    "atlas_findings": f"WITH {_FR} SELECT atlas, name, 'error' AS severity, 'width_not_power_of_two' AS code FROM f WHERE w & (w - 1) <> 0 UNION ALL SELECT atlas, name, 'error', 'height_not_power_of_two' FROM f WHERE h & (h - 1) <> 0 UNION ALL SELECT atlas, name, 'error', 'too_large' FROM f WHERE greatest(w, h) > 32 UNION ALL SELECT atlas, name, 'warning', 'not_square' FROM f WHERE w <> h",
    "stream_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS value_sum FROM events GROUP BY 1, 2",
    "stream_marks": "SELECT event_id, upper(event_type) AS kind, value >= 100 AS loud FROM events",
}
