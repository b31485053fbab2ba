"""Model inputs by name and calibrated probabilities over the base tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import fixed
from quillstone.operators import values as V
from quillstone.plans.raster import d
from quillstone.plans.retrieval import read

c = F.col
LABELS = ["keep", "drop", "ask"]
KINDS = ("audit", "fix", "optimize", "analyze", "report", "design", "research", "deploy", "ask", "simple", "explain", "other")
SECTIONS = ("code", "doc", "log", "mixed", "table")
LENGTHS = ("short", "medium", "long", "any")


def _of(names: tuple[str, ...], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (c(by) % len(names) + 1).cast("int"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of the builders, by arithmetic on parts: shares in hundredths, sizes, names."""
    p = read(spark, sf_dir, "part")
    share = lambda m: (c("p_partkey") * m % 101) / F.lit(100.0)
    return p.select(
        "p_partkey", share(7).alias("a"), share(13).alias("b"), share(29).alias("e"), share(31).alias("f"), (c("p_partkey") * 977 % 200_000).alias("size"), (c("p_size") % 30).alias("n"),
        _of(KINDS, "p_partkey").alias("kind"), _of(SECTIONS, "p_size").alias("section"), _of(LENGTHS, "p_size").alias("length"), (c("p_partkey") % 3 == 0).alias("yes"), (c("p_partkey") % 4 == 0).alias("also"),
    )


_BUILT = {
    "context_pruning": lambda: V.context_pruning(c("size"), c("n"), c("section"), c("a"), c("b")), "skip_agent": lambda: V.skip_agent(c("a"), c("b"), c("kind"), c("e"), c("f")),
    "cloud_escalation": lambda: V.cloud_escalation(c("a"), c("kind"), c("b"), c("e"), c("f")), "response_length": lambda: V.response_length(c("kind"), c("kind"), c("a"), c("length")),
    "tool_call": lambda: V.tool_call(c("yes"), c("also"), c("kind"), c("a"), c("b")), "semantic_cache": lambda: V.semantic_cache(c("a"), c("kind"), c("b"), c("size")),
    "binary_router": lambda: V.binary_router(c("a"), c("b"), c("yes")),
}


def built(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parts(spark, sf_dir).withColumn("v", _BUILT[name]())
        return rows.select("p_partkey", *[fixed(c(f"v.{n}")).alias(n) for n in rows.schema["v"].dataType.names])

    return run


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three probabilities of each part at a temperature from 0.5 to 3, the label and its confidence."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.array(*[(c("p_partkey") * k % 97 + 1).cast("double") for k in (5, 11, 23)]).alias("w"), ((c("p_size") % 6 + 1) / F.lit(2.0)).alias("t"))
    total = F.get("w", F.lit(0)) + F.get("w", F.lit(1)) + F.get("w", F.lit(2))
    p = p.withColumn("p", F.transform("w", lambda x: x / total)).withColumn("q", V.temperature(c("p"), c("t"))).withColumn("best", V.decided(c("q"), LABELS))
    return p.select("p_partkey", *[fixed(F.get("q", F.lit(i))).alias(f"q{i}") for i in range(3)], c("best.label").alias("label"), fixed(c("best.confidence")).alias("confidence"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs of the tool-call model in its order, as one list."""
    names = ["has_code", "has_files", "tool_history", "query_type", "criticality", "budget_ratio", "time_ratio"]
    rows = parts(spark, sf_dir).withColumn("v", V.ordered(_BUILT["tool_call"](), names))
    return rows.select("p_partkey", F.array_join(F.transform("v", lambda x: fixed(x).cast("string")), ",").alias("vector"))


QUERIES = {**{f"values_{n}": built(n) for n in _BUILT}, "values_ordered": ordered, "temperature_applied": calibrated}


def _pick(names: tuple[str, ...], by: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][{by} % {len(names)} + 1]"


_S = lambda k: f"p_partkey * {k} % 101 / {d(100.0)}"
_P = f"""p AS (SELECT p_partkey, {_S(7)} AS a, {_S(13)} AS b, {_S(29)} AS e, {_S(31)} AS f, p_partkey * 977 % 200000 AS size, p_size % 30 AS n, {_pick(KINDS, 'p_partkey')} AS kind, {_pick(SECTIONS, 'p_size')} AS section, {_pick(LENGTHS, 'p_size')} AS length, p_partkey % 3 = 0 AS yes, p_partkey % 4 = 0 AS also FROM part)"""
_NUMBERS = {
    "sections": "CASE section WHEN 'code' THEN 0 WHEN 'doc' THEN 0.33 WHEN 'log' THEN 0.66 ELSE 1 END", "skip": "CASE kind WHEN 'fix' THEN 0.33 WHEN 'optimize' THEN 0.66 WHEN 'analyze' THEN 1 ELSE 0 END",
    "task": "CASE kind WHEN 'audit' THEN 0 WHEN 'fix' THEN 0.25 WHEN 'design' THEN 0.75 WHEN 'research' THEN 1 ELSE 0.5 END", "reply": "CASE kind WHEN 'simple' THEN 0 WHEN 'analyze' THEN 0.66 WHEN 'design' THEN 1 ELSE 0.33 END",
    "agent": "CASE kind WHEN 'audit' THEN 0 WHEN 'report' THEN 0.66 WHEN 'analyze' THEN 1 ELSE 0.33 END", "pref": "CASE length WHEN 'short' THEN 0 WHEN 'long' THEN 1 ELSE 0.5 END",
    "call": "CASE kind WHEN 'fix' THEN 0.33 WHEN 'audit' THEN 0.66 WHEN 'deploy' THEN 1 ELSE 0 END", "cache": "CASE kind WHEN 'fix' THEN 0.33 WHEN 'report' THEN 0.66 WHEN 'analyze' THEN 1 ELSE 0 END",
}
_SQL = {
    "context_pruning": {"total_size": f"least(size / {d(102400.0)}, 1)", "num_sections": f"least(n / {d(20.0)}, 1)", "section_types": _NUMBERS["sections"], "usage_freq": "a", "query_similarity": "b", "section_density": "0.5"},
    "skip_agent": {"fingerprint_match": "a", "project_hash_match": "b", "agent_type": _NUMBERS["skip"], "cache_history": "e", "semantic_distance": "0.5", "criticality": "f", "recent_skip_rate": "0.5"},
    "cloud_escalation": {"effort_score": "a", "task_type": _NUMBERS["task"], "local_fail_history": "b", "criticality": "e", "budget_remaining": "f", "time_pressure": "0.5", "local_model_quality": "0.5"},
    "response_length": {"query_type": _NUMBERS["reply"], "agent_type": _NUMBERS["agent"], "criticality": "a", "history_avg_length": "0.5", "user_pref": _NUMBERS["pref"], "query_complexity": "0.5"},
    "tool_call": {"has_code": "CAST(yes AS INT)", "has_files": "CAST(also AS INT)", "tool_history": "0.5", "query_type": _NUMBERS["call"], "criticality": "a", "budget_ratio": "b", "time_ratio": "1"},
    "semantic_cache": {"cache_density": "a", "query_embedding_norm": "0.5", "avg_distance": "0.5", "agent_type": _NUMBERS["cache"], "pattern_frequency": "0.5", "cache_hit_history": "b", "query_length": f"least(size / {d(2000.0)}, 1)"},
    "binary_router": {"complexity": "a", "budget_ratio": "b", "has_local_model": "CAST(yes AS INT)"},
}
_M = lambda x: f"CAST(round_even(CAST({x} AS DOUBLE) * {d(1e6)}, 0) AS BIGINT)"
ORACLES = {f"values_{n}": f"WITH {_P} SELECT p_partkey, " + ", ".join(f"{_M(x)} AS {k}" for k, x in cols.items()) + " FROM p" for n, cols in _SQL.items()}
ORACLES["values_ordered"] = f"WITH {_P} SELECT p_partkey, concat_ws(',', " + ", ".join(_M(x) for x in _SQL["tool_call"].values()) + ") AS vector FROM p"
ORACLES["temperature_applied"] = f"""WITH w AS (SELECT p_partkey, [CAST(p_partkey * 5 % 97 + 1 AS DOUBLE), p_partkey * 11 % 97 + 1, p_partkey * 23 % 97 + 1] AS w, (p_size % 6 + 1) / {d(2.0)} AS t FROM part), p AS (SELECT p_partkey, t, list_transform(w, lambda x: x / (w[1] + w[2] + w[3])) AS p FROM w),
 l AS (SELECT p_partkey, t, p, list_transform(p, lambda x: ln(greatest(x, {d(1e-12)})) / t) AS l FROM p), e AS (SELECT p_partkey, t, p, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l), q AS (SELECT p_partkey, CASE WHEN t = 1 THEN p ELSE list_transform(e, lambda x: x / (e[1] + e[2] + e[3])) END AS q FROM e)
 SELECT p_partkey, {_M('q[1]')} AS q0, {_M('q[2]')} AS q1, {_M('q[3]')} AS q2, ['keep', 'drop', 'ask'][list_position(q, list_max(q))] AS label, {_M('list_max(q)')} AS confidence FROM q"""
