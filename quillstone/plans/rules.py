"""Cascades, ledgers, metrics, text features, physics and case tables over the base tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import physics as P
from quillstone.functions.numeric import fixed
from quillstone.operators import neighbours as N
from quillstone.operators import rules as R
from quillstone.operators import texts as X
from quillstone.plans.retrieval import EVERY, read

c = F.col


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ---- tasks from customers: shares in hundredths, by arithmetic on the key
def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    p = lambda m: (k * m % 101).cast("long")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), c("c_mktsegment").alias("family"), (k % 17 == 0).alias("secret"), (k % 19 == 0).alias("deploy"), (k % 23 == 0).alias("destroy"), p(7).alias("mutation"), p(13).alias("criticality"),
        F.element_at(F.array(*[F.lit(x) for x in ("run_tests", "", "escalate", "edit", " git_status ")]), (c("c_nationkey") % 5 + 1).cast("int")).alias("requested"),
        p(11).alias("reversible"), p(17).alias("blast"), p(29).alias("backup"), p(31).alias("scope"), p(37).alias("protected"), p(41).alias("idempotent"), p(43).alias("failures"),
    )


_CU = "cu AS (SELECT c_custkey AS id, c_mktsegment AS family, c_custkey % 17 = 0 AS secret, c_custkey % 19 = 0 AS deploy, c_custkey % 23 = 0 AS destroy, ['run_tests', '', 'escalate', 'edit', ' git_status '][c_nationkey % 5 + 1] AS requested, " + ", ".join(f"c_custkey * {m} % 101 AS {n}" for m, n in ((7, "mutation"), (13, "criticality"), (11, "reversible"), (17, "blast"), (29, "backup"), (31, "scope"), (37, "protected"), (41, "idempotent"), (43, "failures"))) + " FROM customer)"
_RISK = "28 * (100 - reversible) + 20 * blast + 18 * (100 - backup) + 14 * scope + 10 * protected + 5 * (100 - idempotent) + 5 * failures"
_LABEL = f"CASE WHEN protected >= 50 AND backup < 50 THEN 'dangerous' WHEN {_RISK} >= 4500 THEN 'dangerous' WHEN {_RISK} >= 2500 THEN 'review' ELSE 'safe' END"


def risk(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("risk", R.risk_score(c("reversible"), c("blast"), c("backup"), c("scope"), c("protected"), c("idempotent"), c("failures")))
    return rows.withColumn("label", R.risk_label(c("risk"), c("protected"), c("backup")))


def tool_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    reason = R.veto(c("secret"), c("deploy"), c("destroy"), c("mutation"), c("criticality"), c("requested"))
    return rows.select("id", F.coalesce(reason, F.lit("")).alias("reason"), F.when(reason.isNotNull(), "escalate").when(c("requested") == "", "retrieve").otherwise(c("requested")).alias("next"))


def consequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth customer: the rule's risk label against the vote of verified precedents of its segment."""
    rows = risk(customers(spark, sf_dir)).select("id", c("family").alias("key"), "label", F.array("reversible", "blast", "backup", "scope", "protected").alias("v"))
    queries = rows.where(c("id") % EVERY == 0)
    near = N.nearest(queries, rows, 5, 5)
    known = rows.where(c("id") % 3 != 0).select("id", "label")  # verified precedents
    votes = N.vote(near, known, queries.select(c("id").alias("query_id")), 5, 100.0, minimum=0.5, cap=0.9)
    both = queries.select(c("id").alias("query_id"), c("label").alias("baseline")).join(votes.select("query_id", c("label").alias("precedent"), "neighbours"), "query_id")
    return both.select("query_id", "baseline", "precedent", "neighbours", R.agreement(c("baseline"), c("precedent")).alias("status"))


_CONS = f"""WITH {_CU}, r AS (SELECT id, family, {_LABEL} AS label, [reversible, blast, backup, scope, protected] AS v FROM cu),
 n AS (SELECT * FROM (SELECT q.id AS query_id, m.id, m.label, CAST(list_sum(list_transform(range(1, 6), lambda i: (q.v[i] - m.v[i]) * (q.v[i] - m.v[i]))) AS BIGINT) AS d2, row_number() OVER (PARTITION BY q.id ORDER BY d2, m.id) AS k FROM r q JOIN r m ON q.family = m.family AND q.id <> m.id WHERE q.id % 50 = 0) WHERE k <= 5),
 s AS (SELECT query_id, count(*) AS n, min(label) AS lo, max(label) AS hi FROM n WHERE id % 3 <> 0 AND CAST(floor(greatest({d(0.0)}, {d(1.0)} - sqrt(CAST(d2 AS DOUBLE)) / {d(100.0 * 5**0.5)}) * 1000000) AS BIGINT) >= 500000 GROUP BY query_id),
 a AS (SELECT r.id AS query_id, label AS baseline, CASE WHEN n >= 3 AND lo = hi THEN lo END AS precedent, coalesce(n, 0) AS neighbours FROM r LEFT JOIN s ON s.query_id = r.id WHERE r.id % 50 = 0)
 SELECT *, CASE WHEN precedent IS NULL THEN 'abstain:no_precedent' WHEN precedent <> baseline THEN 'abstain:tiers_disagree' ELSE 'suggest:' || baseline END AS status FROM a"""

TOOLS = [("t1", 0, ["text"], ["fast", "open"], 50, 70), ("t2", 0, ["text", "code"], ["open"], 40, 60), ("t3", 1, ["text", "code"], ["fast", "exact"], 200, 80), ("t4", 1, ["image"], ["exact"], 400, 75), ("t5", 2, ["text", "code", "image"], ["exact", "deep"], 900, 95), ("t6", 2, ["code"], ["deep", "fast"], 700, 90)]


def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = c("o_orderkey")
    modality = F.when(c("o_orderstatus") == "O", "text").when(c("o_orderstatus") == "F", "code").otherwise("image")
    tags = F.filter(F.array(F.when(k % 2 == 0, "fast"), F.when(k % 3 == 0, "exact"), F.when(k % 5 == 0, "deep"), F.when(k % 7 == 0, "open")), lambda x: x.isNotNull())
    tasks = o.select(k.alias("task_id"), modality.alias("modality"), tags.alias("tags"), (k * 37 % 1000).alias("max_latency"))
    return R.route(tasks, spark.createDataFrame(TOOLS, "tool_id string, tier int, modalities array<string>, tags array<string>, latency int, success int"))


_ROUTE = "WITH tl(tool_id, tier, ms, tg, latency, success) AS (VALUES " + ", ".join(f"('{a}', {b}, {e!r}, {f!r}, {g}, {h})" for a, b, e, f, g, h in TOOLS) + """), tk AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'text' WHEN 'F' THEN 'code' ELSE 'image' END AS modality, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'fast' END, CASE WHEN o_orderkey % 3 = 0 THEN 'exact' END, CASE WHEN o_orderkey % 5 = 0 THEN 'deep' END, CASE WHEN o_orderkey % 7 = 0 THEN 'open' END], lambda x: x IS NOT NULL) AS tags, o_orderkey * 37 % 1000 AS ml FROM orders),
 f AS (SELECT task_id, tool_id, tier, success, CAST(len(list_intersect(tags, tg)) AS INT) AS overlap FROM tk JOIN tl ON list_contains(ms, modality) AND latency <= ml), r AS (SELECT *, row_number() OVER w AS k, first_value(tier) OVER w AS best FROM f WINDOW w AS (PARTITION BY task_id ORDER BY overlap DESC, tier, success DESC, tool_id)),
 g AS (SELECT task_id, max(tool_id) FILTER (k = 1) AS tool_id, max(tier) FILTER (k = 1) AS tier, max(overlap) FILTER (k = 1) AS overlap, arg_min(tier, k) FILTER (tier <> best) AS fallback_tier FROM r GROUP BY task_id) SELECT task_id, tool_id, tier, overlap, fallback_tier FROM tk LEFT JOIN g USING (task_id)"""


# ---- ledgers
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", "value")
    return R.latest(e, ["event_type", "user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id", fixed(c("value"), 100).alias("value"))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame([(x,) for x in ("view", "click", "purchase", "signup", "error", "refund")], "family string")
    return R.readiness(ledger(spark, sf_dir), "event_type", families, 100)


def weighted_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest records of each family as one quality: a mean weighted by recency, in bands."""
    rows = ledger(spark, sf_dir).withColumn("w", c("event_id") % 7 + 1)
    mean = F.expr("sum(value * w) div sum(w)")
    per = rows.groupBy("event_type").agg(F.count("*").alias("records"), mean.alias("mean"))
    return per.withColumn("verdict", F.when(c("mean") < 2500, "poor").when(c("mean") < 4500, "fair").when(c("mean") < 6000, "good").otherwise("excellent"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_groups(docs(spark, sf_dir), "doc_id", c("text"), F.octet_length("text").cast("long"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in R.EVIDENCE]), F.when(c("doc_id") % 101 == 0, 4).when(c("doc_id") % 37 == 0, 3).when(c("doc_id") % 11 == 0, 2).otherwise(1))
    return R.weakest(docs(spark, sf_dir).select((c("doc_id") % 97).alias("bundle"), kind.alias("evidence")), "bundle", "evidence")


# ---- metrics: a score from the variety of words against the quality label
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0))
    rows = docs(spark, sf_dir).select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.floor(F.size(F.array_distinct(words)).cast("long") * 1000 / F.greatest(F.size(words), F.lit(1))).cast("long").alias("score"), c("quality").alias("label"))


_SC = "sc AS (SELECT doc_id, CAST(len(list_distinct(w)) * 1000 // greatest(len(w), 1) AS BIGINT) AS score, quality AS label FROM (SELECT d.doc_id, quality, regexp_extract_all(text, '[^ \\n]+') AS w FROM documents d JOIN labels USING (doc_id)))"
_PRED = "pr AS (SELECT label, CASE WHEN score >= 500 THEN 1 ELSE 0 END AS predicted FROM sc)"
GRID = (0.25, 0.5, 1.0, 2.0, 4.0)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("label", F.when(c("score") >= 500, 1).otherwise(0).alias("predicted"))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "part").select((F.lit(90000) + c("p_partkey") % 1000 * 10).alias("predicted"), fixed(c("p_retailprice"), 100).alias("truth"))
    return R.regression(pairs)


# ---- texts
def text_features(table: str, key: list[str], features, column: str = "text"):
    return lambda spark, sf_dir: read(spark, sf_dir, table).select(*key, *[v.alias(k) for k, v in features(c(column)).items()])


def _share(x: str, whole: int) -> str:
    return f"CAST(least(1000000, ({x}) * 1000000 // {whole}) AS BIGINT)"


def broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "props")
    m = c("event_id") % 8
    raw = F.when(m == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(m == 1, F.replace("props", F.lit("}"), F.lit(",}"))).when(m == 2, F.regexp_replace("props", ": ([0-9]+)", ': "$1"')).when(m == 3, F.lit("{}")).when(m == 4, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(m == 5, F.lit("no object here")).when(m == 6, F.regexp_replace("props", ": ([0-9]+)", ': "x$1"')).otherwise(c("props"))
    out = X.enforce_int(e.withColumn("raw", raw), "raw", "k", 10, 80)
    return out.select("event_id", "valid", "value", "repaired", "coerced", "clamped", "error")


_JSON = """WITH e AS (SELECT event_id, event_id % 8 AS m, CAST(regexp_extract(props, ': ([0-9]+)', 1) AS BIGINT) AS k FROM events)
 SELECT event_id, m NOT IN (3, 5, 6) AS valid, CASE WHEN m NOT IN (3, 5, 6) THEN least(80, greatest(10, k)) END AS value, m IN (0, 1, 4) AS repaired, m = 2 AS coerced, m NOT IN (3, 5, 6) AND (k < 10 OR k > 80) AS clamped, CASE m WHEN 5 THEN 'syntax' WHEN 3 THEN 'missing' WHEN 6 THEN 'type' ELSE '' END AS error FROM e"""


# ---- physics and case tables, over parts
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    return read(spark, sf_dir, "part").select(k, (k * 7 % 181 - 90).alias("lat"), (k * 389 % 20001).alias("alt"), (k * 13 % 97 + 1).alias("q"))


_PL = "pl AS (SELECT p_partkey, p_partkey * 7 % 181 - 90 AS lat, p_partkey * 389 % 20001 AS alt, p_partkey * 13 % 97 + 1 AS q FROM part)"


def _fx(x: str, scale: float = 1e6) -> str:
    return f"CAST(round_even(({x}) * {d(scale)}, 0) AS BIGINT)"


_S2 = "pow(sin(radians(CAST(lat AS DOUBLE))), 2)"
_H = "CAST(alt AS DOUBLE)"
_GRAV = f"{d(P.G_EQUATOR)} * (1 + {d(P.G_K)} * {_S2}) / sqrt(1 - {d(P.E2)} * {_S2}) + (-({d(P.FREE_LINEAR)} - {d(P.FREE_LATITUDE)} * {_S2}) * {_H} + {d(P.FREE_QUADRATIC)} * {_H} * {_H}) * {d(P.MGAL)}"
_TEMP = f"(CASE WHEN alt <= 11000 THEN {d(P.T0)} - {d(P.LAPSE)} * {_H} ELSE {d(P.T1)} END)"
_PRES = f"(CASE WHEN alt <= 11000 THEN {d(P.P0)} * pow({_TEMP} / {d(P.T0)}, {d(P.EXPONENT)}) ELSE {d(P.P1)} * exp({d(-P.G0)} * ({_H} - 11000) / {d(P.R_AIR * P.T1)}) END)"


def physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select(
        "p_partkey", fixed(P.gravity(c("lat"), c("alt"))).alias("gravity"), fixed(P.temperature(c("alt")), 1e3).alias("temperature"), fixed(P.pressure(c("alt")), 1e3).alias("pressure"), fixed(P.density(c("alt"))).alias("density"),
        fixed(P.hydrostatic(c("q"), F.lit(1025.0)), 1e3).alias("hydrostatic"), fixed(P.dynamic_pressure(F.lit(1.225), c("q")), 1e3).alias("dynamic"), fixed(P.weight(c("q")), 1e4).alias("weight"),
        fixed(P.apex_height(c("q")), 1e4).alias("apex_height"), fixed(P.apex_time(c("q")), 1e4).alias("apex_time"), fixed(P.launch_speed(c("q")), 1e4).alias("launch_speed"),
    )


_PHYS = f"WITH {_PL} SELECT p_partkey, {_fx(_GRAV)} AS gravity, {_fx(_TEMP, 1e3)} AS temperature, {_fx(_PRES, 1e3)} AS pressure, {_fx(f'{_PRES} / ({d(P.R_AIR)} * {_TEMP})')} AS density, {_fx(f'{d(1025.0)} * {d(P.G0)} * q', 1e3)} AS hydrostatic, {_fx(f'{d(0.5)} * {d(1.225)} * q * q', 1e3)} AS dynamic, {_fx(f'q * {d(P.G0)}', 1e4)} AS weight, {_fx(f'CAST(q AS DOUBLE) * q / {d(2.0 * P.G0)}', 1e4)} AS apex_height, {_fx(f'q / {d(P.G0)}', 1e4)} AS apex_time, {_fx(f'sqrt({d(2.0 * P.G0)} * q)', 1e4)} AS launch_speed FROM pl"
PAIRS = (("km", "m"), ("km/h", "m/s"), ("kn", "km/h"), ("degC", "K"), ("K", "degC"), ("bar", "hPa"), ("deg", "rad"), ("mgal", "m/s2"))


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = c("q").cast("double")
    each = F.array(*[F.struct(F.lit(f"{a}>{b}").alias("units"), fixed(P.convert(value, a, b)).alias("value")) for a, b in PAIRS])
    return places(spark, sf_dir).select("p_partkey", F.explode(each).alias("z")).select("p_partkey", "z.units", "z.value")


def _conv(a: str, b: str) -> str:
    return f"SELECT p_partkey, '{a}>{b}' AS units, {_fx(f'(CAST(q AS DOUBLE) * {d(P.UNITS[a][1])} + {d(P.UNITS[a][2])} - {d(P.UNITS[b][2])}) / {d(P.UNITS[b][1])}')} AS value FROM pl"


def bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure between the two cases of a 500 m table that enclose an altitude: equi-joins on the case, then a straight line."""
    cases = spark.range(42).select((c("id") * 500).alias("at"), fixed(P.pressure(F.least(F.lit(20000), c("id") * 500)), 100).alias("p"))
    rows = places(spark, sf_dir).withColumn("at", F.expr("alt div 500 * 500"))
    low = rows.join(F.broadcast(cases), "at").withColumn("next", c("at") + 500)  # 42 rows
    both = low.join(F.broadcast(cases.select(c("at").alias("next"), c("p").alias("p2"))), "next")
    return both.select("p_partkey", (c("p") + F.floor((c("p2") - c("p")) * (c("alt") - c("at")) / 500)).alias("pressure"))


_CASES = f"cs AS (SELECT alt0 AS a, {_fx(_PRES, 100.0)} AS p FROM (SELECT i * 500 AS alt0, least(20000, i * 500) AS alt FROM range(42) r(i)))"


def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gravity from the four corners of a 10 degree by 2 km table."""
    corner = lambda lat, alt: fixed(P.gravity(lat, alt))
    grid = spark.range(11 * 12).select((c("id") % 11 * 10).alias("la"), F.floor(c("id") / 11).cast("long").alias("ha")).select("la", (c("ha") * 2000).alias("ha"))
    grid = grid.withColumn("g", corner(F.least(F.lit(90), c("la")), F.least(F.lit(20000), c("ha"))))
    rows = places(spark, sf_dir).withColumn("l", F.abs("lat")).withColumns({"la": F.expr("l div 10 * 10"), "ha": F.expr("alt div 2000 * 2000")})
    for tag, dl, dh in (("a", 0, 0), ("b", 10, 0), ("e", 0, 2000), ("f", 10, 2000)):
        part = F.broadcast(grid.select((c("la") - dl).alias("la"), (c("ha") - dh).alias("ha"), c("g").alias(tag)))  # 132 rows
        rows = rows.join(part, ["la", "ha"])
    x, y = c("l") - c("la"), c("alt") - c("ha")
    value = F.floor(((c("a") * (10 - x) + c("b") * x) * (2000 - y) + (c("e") * (10 - x) + c("f") * x) * y) / 20000)
    return rows.select("p_partkey", value.cast("long").alias("gravity"))


_GRID = f"gr AS (SELECT la, ha, {_fx(_GRAV)} AS g FROM (SELECT i % 11 * 10 AS la, i // 11 * 2000 AS ha, least(90, i % 11 * 10) AS lat, least(20000, i // 11 * 2000) AS alt FROM range(132) r(i)))"
_BIL = f"WITH {_PL}, {_GRID}, x AS (SELECT p_partkey, abs(lat) % 10 AS x, alt % 2000 AS y, abs(lat) // 10 * 10 AS la, alt // 2000 * 2000 AS ha FROM pl) SELECT p_partkey, CAST(((a.g * (10 - x) + b.g * x) * (2000 - y) + (e.g * (10 - x) + f.g * x) * y) // 20000 AS BIGINT) AS gravity FROM x JOIN gr a ON a.la = x.la AND a.ha = x.ha JOIN gr b ON b.la = x.la + 10 AND b.ha = x.ha JOIN gr e ON e.la = x.la AND e.ha = x.ha + 2000 JOIN gr f ON f.la = x.la + 10 AND f.ha = x.ha + 2000"

# ---- a small network with whole-number weights
W1, B1 = ((3, -2, 1, 4), (-1, 5, -3, 2), (2, 2, -4, -1)), (100, -50, 20)
W2, B2 = ((2, -1, 3), (-2, 4, 1)), (10, -10)


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four embedding components through a 4-3-2 network: hidden values held at zero, a label if the outputs are apart."""
    from quillstone.operators.network import forward

    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x.cast("double") * 1000).cast("long")).alias("x"))
    out = rows.withColumn("o", forward(c("x"), ((W1, B1, "relu"), (W2, B2, "linear"))))
    gap = F.abs(c("o")[0] - c("o")[1])
    return out.select("vec_id", c("o")[0].alias("o1"), c("o")[1].alias("o2"), F.when(gap < 300, "abstain").when(c("o")[0] > c("o")[1], "first").otherwise("second").alias("label"))


_HID = ", ".join(f"greatest(0, {b} + " + " + ".join(f"{w} * x[{i + 1}]" for i, w in enumerate(row)) + f") AS h{j}" for j, (row, b) in enumerate(zip(W1, B1, strict=True)))
_OUT = ", ".join(f"{b} + " + " + ".join(f"{w} * h{i}" for i, w in enumerate(row)) + f" AS o{j + 1}" for j, (row, b) in enumerate(zip(W2, B2, strict=True)))
_NET = f"WITH x AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT)) AS x FROM embeddings), h AS (SELECT vec_id, {_HID} FROM x), o AS (SELECT vec_id, {_OUT} FROM h) SELECT *, CASE WHEN abs(o1 - o2) < 300 THEN 'abstain' WHEN o1 > o2 THEN 'first' ELSE 'second' END AS label FROM o"

QUERIES = {
    "tool_veto": tool_veto, "risk_label": lambda s, f: risk(customers(s, f)).select("id", "risk", "label"), "consequence_agreement": consequence, "tier_router": router,
    "ledger_latest": ledger, "ledger_readiness": readiness, "ledger_weighted_verdict": weighted_verdict, "duplicate_groups": duplicate_groups,
    "alias_violations": lambda s, f: R.alias_violations(docs(s, f), duplicate_groups(s, f), "doc_id", "text", None), "evidence_weakest": evidence,
    "reliability_bins": lambda s, f: R.reliability(scored(s, f)), "calibration_error": lambda s, f: R.calibration(scored(s, f)), "confusion_matrix": lambda s, f: R.confusion(predicted(s, f)), "classification_gate": lambda s, f: R.gate(predicted(s, f)),
    "regression_metrics": regression, "temperature_grid": lambda s, f: R.temperature(scored(s, f), GRID),
    "error_text_features": text_features("conversations", ["conv_id", "turn"], X.error_features), "effort_features": text_features("documents", ["doc_id"], X.effort_features), "compressibility_features": text_features("documents", ["doc_id"], X.compressibility_features),
    "json_adapter": broken_json, "physics_reference": physics, "unit_conversion": conversions, "case_bracket": bracket, "case_bilinear": bilinear, "network_forward": network,
}

_KW = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN 1 ELSE 0 END AS {k}" for k, ws in X.ERROR_WORDS.items())
_LATEST = "la AS (SELECT event_type, user_id, event_id, CAST(round_even(value * 100, 0) AS BIGINT) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)"
_GROUPS = "SELECT sha256(text) AS digest, min(doc_id) AS canonical, count(*) AS copies, CAST(strlen(text) * (count(*) - 1) AS BIGINT) AS bytes_saved FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1"
ORACLES = {
    "tool_veto": f"WITH {_CU}, v AS (SELECT id, requested, CASE WHEN secret OR deploy OR destroy THEN 'sensitive_or_destructive_task' WHEN mutation >= 50 THEN 'mutation_is_outside_the_closed_catalog' WHEN criticality >= 85 THEN 'critical_task_requires_escalation' WHEN requested = '' THEN '' WHEN trim(requested) NOT IN ('none', 'inspect_files', 'run_tests', 'git_status', 'escalate') THEN 'unknown_requested_tool' WHEN requested = 'escalate' THEN 'caller_requested_escalation' ELSE '' END AS reason FROM cu) SELECT id, reason, CASE WHEN reason <> '' THEN 'escalate' WHEN requested = '' THEN 'retrieve' ELSE requested END AS next FROM v",
    "risk_label": f"WITH {_CU} SELECT id, {_RISK} AS risk, {_LABEL} AS label FROM cu",
    "consequence_agreement": _CONS,
    "tier_router": _ROUTE,
    "ledger_latest": f"WITH {_LATEST} SELECT * FROM la",
    "ledger_readiness": f"WITH {_LATEST} SELECT family, count(event_id) AS records, count(event_id) >= 100 AS ready FROM (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('refund')) f(family) LEFT JOIN la ON la.event_type = family GROUP BY family",
    "ledger_weighted_verdict": f"WITH {_LATEST}, g AS (SELECT event_type, count(*) AS records, CAST(sum(value * (event_id % 7 + 1)) // sum(event_id % 7 + 1) AS BIGINT) AS mean FROM la GROUP BY 1) SELECT *, CASE WHEN mean < 2500 THEN 'poor' WHEN mean < 4500 THEN 'fair' WHEN mean < 6000 THEN 'good' ELSE 'excellent' END AS verdict FROM g",
    "duplicate_groups": _GROUPS,
    "alias_violations": f"WITH g AS ({_GROUPS}) SELECT count(*) FILTER (canonical IS NULL) AS violations FROM g",
    "evidence_weakest": f"WITH e AS (SELECT doc_id % 97 AS bundle, max(CASE WHEN doc_id % 101 = 0 THEN 4 WHEN doc_id % 37 = 0 THEN 3 WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END) AS r FROM documents GROUP BY 1) SELECT bundle, {list(R.EVIDENCE)!r}[r] AS evidence, r = 1 AS certified FROM e",
    "reliability_bins": f"WITH {_SC} SELECT CAST(least(9, score * 10 // 1000) AS INT) AS bin, count(*) AS samples, CAST(sum(score) AS BIGINT) AS confidence_sum, CAST(sum(label) AS BIGINT) AS hits FROM sc GROUP BY 1",
    "calibration_error": f"WITH {_SC}, b AS (SELECT least(9, score * 10 // 1000) AS bin, count(*) AS n, sum(score) AS s, sum(label) AS h FROM sc GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(sum(abs(h * 1000 - s)) AS BIGINT) AS ece, (SELECT CAST(sum((score - 1000 * label) * (score - 1000 * label)) AS BIGINT) FROM sc) AS brier FROM b",
    "confusion_matrix": f"WITH {_SC}, {_PRED} SELECT label, predicted, count(*) AS n FROM pr GROUP BY 1, 2",
    "classification_gate": f"WITH {_SC}, {_PRED}, g AS (SELECT label, count(*) AS support, count(*) FILTER (label = predicted) AS hits FROM pr GROUP BY 1) SELECT label, support, hits, concat_ws(',', CASE WHEN support < 10 THEN 'insufficient_support' END, CASE WHEN hits * 1000 < support * 900 THEN 'recall_below_threshold' END) AS reasons FROM g UNION ALL SELECT NULL, CAST(sum(support) AS BIGINT), CAST(sum(hits) AS BIGINT), CASE WHEN sum(hits) * 1000 < sum(support) * 950 THEN 'accuracy_below_threshold' ELSE '' END FROM g",
    "regression_metrics": "WITH p AS (SELECT 90000 + p_partkey % 1000 * 10 - CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS e FROM part) SELECT count(*) AS samples, CAST(sum(e * e) AS BIGINT) AS square_sum, max(abs(e)) AS worst, CAST(sum(e) AS BIGINT) AS bias_sum FROM p",
    "temperature_grid": f"WITH {_SC}, p AS (SELECT label, least({d(0.999)}, greatest({d(0.001)}, score / {d(1000.0)})) AS p FROM sc), z AS (SELECT CASE WHEN label = 1 THEN -ln(p / (1 - p)) ELSE ln(p / (1 - p)) END AS z FROM p) SELECT t, CAST(sum(CAST(round_even(ln(1 + exp(z / t)) * 1e6, 0) AS BIGINT)) AS BIGINT) AS loss FROM z CROSS JOIN (VALUES {', '.join(f'({d(t)})' for t in GRID)}) g(t) GROUP BY t",
    "error_text_features": f"SELECT conv_id, turn, {_share('length(text)', 2000)} AS message_length, CASE WHEN regexp_matches(lower(text), '{X.TRACE}') THEN 1 ELSE 0 END AS has_traceback, {_share('length(text) - length(replace(text, chr(10), {}))'.format(chr(39) * 2), 100)} AS line_count, CASE WHEN contains(lower(text), 'did you mean') THEN 1 ELSE 0 END AS has_suggestion, {_KW} FROM conversations",
    "effort_features": f"SELECT doc_id, {_share('length(text)', 102400)} AS file_size, {_share('len(regexp_extract_all(text, {}))'.format(chr(39) + '[^ \\t\\r\\n]+' + chr(39)), 2000)} AS tokens, CASE WHEN regexp_matches(text, '{X.CODE}') THEN 1 ELSE 0 END AS is_code FROM documents",
    "compressibility_features": f"WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, {_share('length(text)', 102400)} AS raw_length, CAST((len(l) - len(list_distinct(l))) * 1000000 // len(l) AS BIGINT) AS repetition, CASE WHEN regexp_matches(text, '(?s)^\\s*[\\[{{].*[\\]}}]\\s*$') OR regexp_matches(text, '\\|.*\\|') THEN 1 ELSE 0 END AS structure FROM l",
    "json_adapter": _JSON,
    "physics_reference": _PHYS,
    "unit_conversion": f"WITH {_PL} " + " UNION ALL ".join(_conv(a, b) for a, b in PAIRS),
    "case_bracket": f"WITH {_PL}, {_CASES} SELECT p_partkey, CAST(l.p + floor(CAST((h.p - l.p) * (alt - l.a) AS DOUBLE) / 500) AS BIGINT) AS pressure FROM pl JOIN cs l ON l.a = alt // 500 * 500 JOIN cs h ON h.a = l.a + 500",
    "case_bilinear": _BIL,
    "network_forward": _NET,
}
