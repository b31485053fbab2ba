"""Phones from parts and suppliers, cases that are no grid, and retrieval without stop words, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.operators import cases as K
from quillstone.operators import neighbours as N
from quillstone.operators import phones as H
from quillstone.operators.rules import EVIDENCE
from quillstone.plans import rules
from quillstone.plans.raster import d
from quillstone.plans.retrieval import _LEX, _lexical_sides, read

c = F.col
#: Feature i of key k is k * STEPS[i] % 21 twentieths, and unknown where (k + i) % 4 = 0.
STEPS = (3, 5, 8, 11, 13, 17, 19, 23)


def _features(key: str) -> Column:
    value = lambda i, m: F.when((c(key) + i) % 4 != 0, (c(key) * m % 21) / F.lit(20.0))
    return F.create_map(*[x for i, (n, m) in enumerate(zip(H.FEATURES, STEPS, strict=True)) for x in (F.lit(n), value(i, m))])


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as phones of five languages, with a symbol for each set of features but for every 61st, and evidence by remainders."""
    p = read(spark, sf_dir, "part")
    evidence = F.when(c("p_partkey") % 31 == 0, "inferred").when(c("p_partkey") % 7 == 0, "reconstructed").otherwise("attested")
    return p.select(c("p_partkey").alias("id"), (c("p_partkey") % 5).alias("language_id"), F.concat(F.lit("p"), F.when(c("p_partkey") % 61 == 0, 99).otherwise(c("p_partkey") % 21)).alias("ipa"), evidence.alias("evidence"), _features("p_partkey").alias("features"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as queries; every third has the features of the part of its own number."""
    s = read(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"))
    return s.select("id", (c("id") % 5).alias("language_id"), F.when(c("id") % 3 == 0, c("id")).otherwise(c("id") * 37 + 11).alias("k")).withColumn("features", _features("k")).drop("k")


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.retrieve(speakers(spark, sf_dir), inventory(spark, sf_dir))


def _whole(key: str) -> Column:
    return F.array(*[(c(key) * m % 21) / F.lit(20.0) for m in STEPS[:5]])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records; some lack a source, a known evidence or a feature in range."""
    p = read(spark, sf_dir, "part").withColumn("k", c("p_partkey"))
    evidence = F.when(c("k") % 13 == 0, "Guessed").when(c("k") % 7 == 0, "Reconstructed").otherwise("ATTESTED")
    source = F.when(c("k") % 17 == 0, "").otherwise("table")
    v = F.when(c("k") % 19 == 0, F.array(F.lit(1.5))).otherwise(_whole("k"))
    rows = p.select(c("k").alias("record"), F.concat(F.lit("p"), F.when(c("k") % 211 == 0, 99).otherwise(c("k") % 21)).alias("symbol"), F.concat(F.lit("l"), c("k") % 5).alias("language"), v.alias("v"), evidence.alias("evidence"), source.alias("source"))
    return H.registered(rows)


def _askers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"))
    return s.select("id", F.concat(F.lit("l"), c("id") % 5).alias("language"), F.when(c("id") % 3 == 0, c("id")).otherwise(c("id") * 37 + 11).alias("k")).withColumn("v", F.transform(_whole("k"), lambda x: F.when(c("id") % 7 == 0, x / 2).otherwise(x))).drop("k")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("problem IS NULL").drop("problem", "source")


# ---- cases
#: 90 cases of normal gravity at places by rule, and one in ten of them off by a hundredth.
PLACES = [(float(i * 37 % 91), float(i * 7919 % 20001)) for i in range(90)]
SCALES, DOMAIN = (90.0, 20000.0), ((0.0, 90.0), (0.0, 18000.0))


def _table() -> list[tuple[tuple[float, float], float]]:
    return [((a, b), 9.78 + 0.05 * (a / 90.0) - 3e-6 * b + (0.1 if i % 10 == 0 else 0.0)) for i, (a, b) in enumerate(PLACES)]


def idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gravity at the parts' places from irregular cases; some cases don't agree with their neighbours."""
    rows = rules.places(spark, sf_dir).select("p_partkey", F.abs("lat").alias("lat"), "alt")
    found = K.inverse_distance(rows, ["lat", "alt"], SCALES, _table(), DOMAIN)
    return found.select("p_partkey", "status", "reason", fixed(c("value")).alias("value"), c("support").cast("long").alias("support"), fixed(c("error")).alias("error"), fixed(c("confidence")).alias("confidence"))


# ---- stop words
def _profiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries, memory = _lexical_sides(spark, sf_dir)
    return tuple(side.withColumn("tokens", N.content(c("tokens"), "fr-en")) for side in (queries, memory))


def stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical retrieval on content words only."""
    return N.lexical(*_profiled(spark, sf_dir))


QUERIES = {
    "phone_retrieve": phones, "phone_register": lambda s, f: records(s, f).select("record", "evidence", F.coalesce("problem", F.lit("")).alias("problem")), "phone_nearest": lambda s, f: H.nearest_records(_askers(s, f), _memory(s, f), 4, "reconstructed"),
    "phone_reconstruct": lambda s, f: H.reconstruct(_askers(s, f), _memory(s, f)), "case_idw": idw, "lexical_stopword_profile": stopwords,
}

_FEATURE = lambda k: "[" + ", ".join(f"CASE WHEN ({k} + {i}) % 4 <> 0 THEN CAST(round_even({k} * {m} % 21 / {d(20.0)} * 1e6, 0) AS BIGINT) END" for i, m in enumerate(STEPS)) + "]"
_VECTOR = lambda k: "[" + ", ".join(f"CAST(round_even({k} * {m} % 21 / {d(20.0)} * 1e6, 0) AS BIGINT)" for m in STEPS[:5]) + "]"
_ASK = "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE s_suppkey * 37 + 11 END"
_DIFF = lambda n: f"list_filter(list_transform(range(1, {n + 1}), lambda i: (q.v[i] - m.v[i]) * (q.v[i] - m.v[i])), lambda x: x IS NOT NULL)"
_SAME = " AND ".join(f"qv[{i}] IS NOT DISTINCT FROM mv[{i}]" for i in range(1, 9))
_PHONE = f"""m AS (SELECT p_partkey AS phone, p_partkey % 5 AS l, 'p' || CASE WHEN p_partkey % 61 = 0 THEN 99 ELSE p_partkey % 21 END AS ipa, CASE WHEN p_partkey % 31 = 0 THEN 3 WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END AS e, {_FEATURE('p_partkey')} AS v FROM part),
 q AS (SELECT s_suppkey AS id, s_suppkey % 5 AS l, {_FEATURE(f'({_ASK})')} AS v FROM supplier),
 p0 AS (SELECT id, phone, ipa, e, q.v AS qv, m.v AS mv, {_DIFF(8)} AS g FROM q JOIN m USING (l)),
 p1 AS (SELECT id, phone, ipa, e, {_SAME} AS same, CAST(round_even(greatest({d(0.0)}, {d(1.0)} - sqrt(CAST(list_sum(g) AS DOUBLE)) / {d(1e6)} / sqrt(CAST(len(g) AS DOUBLE))) * 1e6, 0) AS BIGINT) AS sim FROM p0 WHERE len(g) >= 3),
 p2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, phone) AS k, max(sim) OVER (PARTITION BY id) AS top FROM p1 WHERE sim >= 500000),
 r AS (SELECT q.id, count(k) FILTER (k <= 5) AS n, CAST(sum(sim) FILTER (k <= 5) AS BIGINT) AS total, max(e) FILTER (k <= 5) AS e, min(ipa) FILTER (k = 1) AS ipa, bool_or(same) FILTER (k = 1) AS same, count(DISTINCT ipa) FILTER (sim = top) AS ways FROM q LEFT JOIN p2 USING (id) GROUP BY q.id),
 z AS (SELECT *, CASE WHEN n < 3 THEN 'too_few_similar_phones' WHEN ways > 1 THEN 'ambiguous_nearest_phones' ELSE '' END AS reason FROM r)"""
_RECORDS = f"""r0 AS (SELECT p_partkey AS record, 'p' || CASE WHEN p_partkey % 211 = 0 THEN 99 ELSE p_partkey % 21 END AS symbol, 'l' || p_partkey % 5 AS language, {_VECTOR('p_partkey')} AS v, CASE WHEN p_partkey % 13 = 0 THEN 'guessed' WHEN p_partkey % 7 = 0 THEN 'reconstructed' ELSE 'attested' END AS evidence,
 CASE WHEN p_partkey % 17 = 0 THEN 'needs symbol, language and source' WHEN p_partkey % 13 = 0 THEN 'unknown evidence' WHEN p_partkey % 19 = 0 THEN 'features must be from 0 to 1' ELSE '' END AS problem FROM part),
 q AS (SELECT s_suppkey AS id, 'l' || s_suppkey % 5 AS language, list_transform({_VECTOR(f'({_ASK})')}, lambda x: CASE WHEN s_suppkey % 7 = 0 THEN x // 2 ELSE x END) AS v FROM supplier),
 d0 AS (SELECT id, record, symbol, evidence, sqrt(CAST(list_sum({_DIFF(5)}) AS DOUBLE)) / {d(1e6)} AS d FROM q JOIN r0 m USING (language) WHERE problem = ''),
 d1 AS (SELECT id, record, symbol, evidence, CAST(round_even(d * 1e4, 0) AS BIGINT) AS distance, CAST(round_even(greatest({d(0.0)}, {d(1.0)} - d / {d(2.0)}) * 1e4, 0) AS BIGINT) AS confidence FROM d0),
 n AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, record) AS INT) AS place, symbol, evidence, distance, confidence FROM d1)"""
_X, _Y = f"lat / {d(90.0)}", f"alt / {d(20000.0)}"
_CASES = f"cs AS (SELECT i, CAST(i * 37 % 91 AS DOUBLE) / {d(90.0)} AS a, CAST(i * 7919 % 20001 AS DOUBLE) / {d(20000.0)} AS b, {d(9.78)} + {d(0.05)} * (CAST(i * 37 % 91 AS DOUBLE) / {d(90.0)}) - {d(3e-6)} * CAST(i * 7919 % 20001 AS DOUBLE) + CASE WHEN i % 10 = 0 THEN {d(0.1)} ELSE {d(0.0)} END AS output FROM range(90) r(i))"
_TOTAL = lambda x, at: f"list_sum(list_transform(list_slice({x}, {at}, 4), lambda z: z))"
_M = lambda x: f"CAST(round_even(({x}) * 1e6, 0) AS BIGINT)"
_IDW = f"""{rules._PL}, {_CASES}, f0 AS (SELECT p_partkey, alt <= 18000 AS inside, i, output, sqrt((abs(lat) / {d(90.0)} - a) * (abs(lat) / {d(90.0)} - a) + (alt / {d(20000.0)} - b) * (alt / {d(20000.0)} - b)) AS far FROM pl CROSS JOIN cs),
 f1 AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY far, i) AS k FROM f0), f2 AS (SELECT *, {d(1.0)} / (greatest(far, {d(1e-6)}) * greatest(far, {d(1e-6)})) AS w FROM f1 WHERE k <= 4),
 f3 AS (SELECT p_partkey, any_value(inside) AS inside, list(w ORDER BY k) FILTER (far <= {d(0.25)}) AS w, list(w * output ORDER BY k) FILTER (far <= {d(0.25)}) AS v, min(output) FILTER (k = 1) AS held FROM f2 GROUP BY 1),
 f4 AS (SELECT p_partkey, inside, coalesce(len(w), 0) AS n, {_TOTAL('v', 1)} / {_TOTAL('w', 1)} AS value, CASE WHEN inside AND len(w) >= 3 THEN abs({_TOTAL('v', 2)} / {_TOTAL('w', 2)} - held) / greatest(abs(held), {d(1e-12)}) END AS err FROM f3),
 f5 AS (SELECT *, CASE WHEN NOT inside THEN 'out_of_domain' WHEN n < 3 THEN 'insufficient_neighbor_support' WHEN err > {d(0.002)} THEN 'neighbors_inconsistent' ELSE '' END AS reason FROM f4)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(N.PROFILES["fr-en"])) + "]"
_LEX2 = _LEX.replace("{}", "34").replace("list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))", f"list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), lambda t: NOT list_contains({_STOP}, t))")
ORACLES = {
    "phone_retrieve": f"WITH {_PHONE} SELECT id, CASE WHEN reason = '' THEN 'suggest' ELSE 'abstain' END AS status, reason, CASE WHEN reason = '' THEN ipa END AS ipa, CASE WHEN n < 3 THEN 'speculative' WHEN reason <> '' OR e = 1 AND NOT same THEN 'inferred' ELSE {list(EVIDENCE)!r}[e] END AS evidence, reason = '' AND e = 1 AND same AS certified, n AS neighbours, CASE WHEN reason = '' THEN least(950000, total // n) ELSE 0 END AS strength FROM z",
    "phone_register": f"WITH {_RECORDS} SELECT record, evidence, problem FROM r0",
    "phone_nearest": f"WITH {_RECORDS} SELECT * FROM n WHERE place <= 4",
    "phone_reconstruct": f"WITH {_RECORDS}, t AS (SELECT id, min(symbol) FILTER (place = 1) AS symbol, min(evidence) FILTER (place = 1) AS e, min(distance) AS distance, min(confidence) FILTER (place = 1) AS confidence, list(struct_pack(s := symbol, d := distance)) AS a FROM n WHERE place <= 3 GROUP BY id), u AS (SELECT q.id, t.symbol, e, distance, confidence, t.id IS NULL OR len(list_distinct(list_transform(list_filter(a, lambda z: z.d = distance), lambda z: z.s))) > 1 AS none FROM q LEFT JOIN t USING (id)) SELECT id, CASE WHEN none THEN '?' ELSE symbol END AS symbol, CASE WHEN none THEN 'speculative' WHEN distance = 0 AND e = 'attested' THEN 'attested' WHEN confidence > 8500 THEN 'inferred' ELSE 'speculative' END AS evidence, CASE WHEN none THEN 0 ELSE confidence END AS confidence FROM u",
    "case_idw": f"WITH {_IDW} SELECT p_partkey, CASE WHEN reason = '' THEN 'suggest' ELSE 'abstain' END AS status, reason, CASE WHEN reason = '' THEN {_M('value')} END AS value, CASE WHEN inside THEN n ELSE 0 END AS support, {_M('err')} AS error, CASE WHEN reason = '' THEN {_M(f'greatest({d(0.0)}, least({d(0.9)}, {d(1.0)} - {d(100.0)} * err))')} ELSE 0 END AS confidence FROM f5",
    "lexical_stopword_profile": f"WITH {_LEX2} SELECT * FROM t WHERE rank <= 5",
}
