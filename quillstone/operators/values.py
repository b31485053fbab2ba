"""Inputs of the small models, each built from named values as one struct column, and the temperature of their probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numbers that stand for names, and the number of any other name.
SECTIONS = ({"code": 0.0, "doc": 0.33, "log": 0.66, "mixed": 1.0}, 1.0)
SKIP_AGENTS = ({"audit": 0.0, "fix": 0.33, "optimize": 0.66, "analyze": 1.0}, 0.0)
TASKS = ({"audit": 0.0, "fix": 0.25, "analyze": 0.5, "design": 0.75, "research": 1.0}, 0.5)
REPLIES = ({"simple": 0.0, "explain": 0.33, "analyze": 0.66, "design": 1.0}, 0.33)
REPLY_AGENTS = ({"audit": 0.0, "fix": 0.33, "report": 0.66, "analyze": 1.0}, 0.33)
LENGTHS = ({"short": 0.0, "medium": 0.5, "long": 1.0}, 0.5)
CALLS = ({"ask": 0.0, "fix": 0.33, "audit": 0.66, "deploy": 1.0}, 0.0)
CACHE_AGENTS = ({"audit": 0.0, "fix": 0.33, "report": 0.66, "analyze": 1.0}, 0.0)
#: Probabilities are at least this before their logarithm is taken.
LEAST = 1e-12


def named(x: Column, table: tuple[dict[str, float], float]) -> Column:
    """The number that stands for a name."""
    out = F.lit(table[1])
    for name, value in table[0].items():
        out = F.when(x == name, F.lit(value)).otherwise(out)
    return out


def _share(x: Column, whole: float) -> Column:
    return F.least(x.cast("double") / F.lit(whole), F.lit(1.0))


def _vector(**parts: Column | float) -> Column:
    return F.struct(*[(p if isinstance(p, Column) else F.lit(p)).cast("double").alias(n) for n, p in parts.items()])


def context_pruning(total_size: Column, num_sections: Column, section_types: Column, usage_freq: Column, query_similarity: Column) -> Column:
    return _vector(total_size=_share(total_size, 102_400.0), num_sections=_share(num_sections, 20.0), section_types=named(section_types, SECTIONS), usage_freq=usage_freq, query_similarity=query_similarity, section_density=0.5)


def skip_agent(fingerprint_match: Column, project_hash_match: Column, agent_type: Column, cache_history: Column, criticality: Column) -> Column:
    return _vector(fingerprint_match=fingerprint_match, project_hash_match=project_hash_match, agent_type=named(agent_type, SKIP_AGENTS), cache_history=cache_history, semantic_distance=0.5, criticality=criticality, recent_skip_rate=0.5)


def cloud_escalation(effort_score: Column, task_type: Column, local_fail_history: Column, criticality: Column, budget_remaining: Column) -> Column:
    return _vector(effort_score=effort_score, task_type=named(task_type, TASKS), local_fail_history=local_fail_history, criticality=criticality, budget_remaining=budget_remaining, time_pressure=0.5, local_model_quality=0.5)


def response_length(query_type: Column, agent_type: Column, criticality: Column, user_pref: Column) -> Column:
    return _vector(query_type=named(query_type, REPLIES), agent_type=named(agent_type, REPLY_AGENTS), criticality=criticality, history_avg_length=0.5, user_pref=named(user_pref, LENGTHS), query_complexity=0.5)


def tool_call(has_code: Column, has_files: Column, query_type: Column, criticality: Column, budget_ratio: Column) -> Column:
    return _vector(has_code=has_code, has_files=has_files, tool_history=0.5, query_type=named(query_type, CALLS), criticality=criticality, budget_ratio=budget_ratio, time_ratio=1.0)


def semantic_cache(cache_density: Column, agent_type: Column, cache_hit_history: Column, query_length: Column) -> Column:
    return _vector(cache_density=cache_density, query_embedding_norm=0.5, avg_distance=0.5, agent_type=named(agent_type, CACHE_AGENTS), pattern_frequency=0.5, cache_hit_history=cache_hit_history, query_length=_share(query_length, 2000.0))


def binary_router(complexity: Column, budget_ratio: Column, has_local: Column) -> Column:
    return _vector(complexity=complexity, budget_ratio=budget_ratio, has_local_model=has_local)


def ordered(vector: Column, names: list[str]) -> Column:
    """A struct's values as an array in the order of ``names``; an unknown value or one that isn't finite is an error, never 0."""

    def one(n: str) -> Column:
        x = vector[n].cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.raise_error(F.lit(f"feature {n} is unknown or not finite")).cast("double"))

    return F.array(*map(one, names))


def temperature(probabilities: Column, t: Column) -> Column:
    """Probabilities at temperature ``t``: the softmax of their logarithms over ``t``. A temperature that isn't positive, or a probability outside of 0 to 1, is an error."""
    fine = (t > 0) & (t < float("inf")) & F.forall(probabilities, lambda p: p.isNotNull() & (p >= 0) & (p <= 1))
    logs = F.transform(probabilities, lambda p: F.ln(F.greatest(p, F.lit(LEAST))) / t)
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    scaled = F.when(t == 1.0, probabilities).otherwise(F.transform(powers, lambda e: e / total))
    return F.when(fine, scaled).otherwise(F.raise_error(F.lit("temperature or probabilities out of range")).cast("array<double>"))


def decided(probabilities: Column, labels: list[str]) -> Column:
    """(label, confidence) of the greatest probability; the first of equal ones."""
    best = F.array_max(F.transform(probabilities, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    return F.struct(F.element_at(F.array(*map(F.lit, labels)), (F.lit(1) - best["i"]).cast("int")).alias("label"), best["p"].alias("confidence"))
