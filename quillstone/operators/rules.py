"""Rule cascades, routing, ledgers, evidence, calibration and gates: conditional columns and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
#: Evidence from the strongest to the weakest kind.
EVIDENCE = ("attested", "reconstructed", "inferred", "speculative")
# The closed catalogue of tools.
CATALOG = ("none", "inspect_files", "run_tests", "git_status", "escalate")


def veto(mentions_secret: Column, mentions_deploy: Column, mentions_destruction: Column, wants_mutation: Column, criticality: Column, requested: Column, catalog: Sequence[str] = CATALOG) -> Column:
    """The first reason to refuse a task before any model is asked, or null. Shares are in hundredths; a requested name is trimmed."""
    tool = F.trim(requested)
    return (
        F.when(mentions_secret | mentions_deploy | mentions_destruction, "sensitive_or_destructive_task")
        .when(wants_mutation >= 50, "mutation_is_outside_the_closed_catalog")
        .when(criticality >= 85, "critical_task_requires_escalation")
        .when(requested.isNull() | (requested == ""), None)
        .when(~tool.isin(*catalog), "unknown_requested_tool")
        .when(tool == "escalate", "caller_requested_escalation")
    )


def risk_score(reversible: Column, blast: Column, backup: Column, scope: Column, protected: Column, idempotent: Column, failures: Column) -> Column:
    """The weighted risk in ten-thousandths, from shares in hundredths."""
    return 28 * (100 - reversible) + 20 * blast + 18 * (100 - backup) + 14 * scope + 10 * protected + 5 * (100 - idempotent) + 5 * failures


def risk_label(score: Column, protected: Column, backup: Column, review: int = 2500, dangerous: int = 4500) -> Column:
    return F.when((protected >= 50) & (backup < 50), "dangerous").when(score >= dangerous, "dangerous").when(score >= review, "review").otherwise("safe")


def agreement(baseline: Column, precedent: Column) -> Column:
    """The label on which both tiers agree, as a status: an absent or other precedent abstains."""
    return F.when(precedent.isNull(), "abstain:no_precedent").when(precedent != baseline, "abstain:tiers_disagree").otherwise(F.concat(F.lit("suggest:"), baseline))


def route(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """(task_id, tool_id, tier, overlap, fallback_tier): the best tool that a task may use, and the first other tier among the rest.

    tasks (task_id, modality, tags, max_latency), tools (tool_id, tier, modalities, tags, latency, success). A tool qualifies by modality and
    latency; order is by most shared tags, lowest tier, highest success, then id. Tasks without a tool have nulls.
    """
    fits = tasks.withColumn("m", c("modality")).join(tools.withColumn("m", F.explode("modalities")).withColumnRenamed("tags", "own"), "m").where(c("latency") <= c("max_latency"))
    fits = fits.withColumn("overlap", F.size(F.array_intersect("tags", "own")))
    order = Window.partitionBy("task_id").orderBy(F.desc("overlap"), "tier", F.desc("success"), "tool_id")
    ranked = fits.withColumns({"rank": F.row_number().over(order), "best": F.first("tier").over(order)})
    per = ranked.groupBy("task_id").agg(
        F.max(F.when(c("rank") == 1, c("tool_id"))).alias("tool_id"), F.max(F.when(c("rank") == 1, c("tier"))).alias("tier"), F.max(F.when(c("rank") == 1, c("overlap"))).alias("overlap"), F.min_by("tier", F.when(c("tier") != c("best"), c("rank"))).alias("fallback_tier")
    )
    return tasks.select("task_id").join(per, "task_id", "left")


def latest(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record for each of ``keys`` in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def readiness(records: DataFrame, family: str, families: DataFrame, fewest: int) -> DataFrame:
    """(family, records, ready) of every family, those without a record too."""
    counts = records.groupBy(c(family).alias("family")).agg(F.count("*").alias("records"))
    return families.join(counts, "family", "left").select("family", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) >= fewest).alias("ready"))


def weakest(rows: DataFrame, group: str, evidence: str) -> DataFrame:
    """(group, evidence, certified): the weakest evidence of each group; only attested evidence certifies."""
    rank = F.array_position(F.array(*[F.lit(e) for e in EVIDENCE]), c(evidence))
    per = rows.groupBy(group).agg(F.max(rank).alias("r"))
    return per.select(group, F.element_at(F.array(*[F.lit(e) for e in EVIDENCE]), c("r").cast("int")).alias("evidence"), (c("r") == 1).alias("certified"))


def duplicate_groups(rows: DataFrame, key: str, content: Column, size: Column) -> DataFrame:
    """(digest, canonical, copies, bytes_saved) of contents that more than one row has; the smallest key is canonical."""
    per = rows.select(c(key), F.sha2(content, 256).alias("digest"), size.alias("size")).where("digest is not null").groupBy("digest", "size").agg(F.min(key).alias("canonical"), F.count("*").alias("copies"))
    return per.where("copies > 1").select("digest", "canonical", "copies", (c("size") * (c("copies") - 1)).alias("bytes_saved"))


def alias_violations(rows: DataFrame, groups: DataFrame, key: str, content: str, digest_size: Column) -> DataFrame:
    """(violations): rows whose content differs from that of their group's canonical row, and copies that no group has counted."""
    named = rows.select(c(key), c(content), F.sha2(c(content), 256).alias("digest"))
    members = named.join(groups.select("digest", "canonical", "copies"), "digest")
    canon = rows.select(c(key).alias("canonical"), c(content).alias("original"))
    wrong = members.join(canon, "canonical").agg(F.count_if(~c(content).eqNullSafe(c("original"))).alias("n"))
    counts = members.groupBy("digest", "copies").agg(F.count("*").alias("seen")).agg(F.count_if(c("seen") != c("copies")).alias("m"))
    return wrong.crossJoin(counts).select((c("n") + c("m")).alias("violations"))  # two rows of one


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, samples, confidence_sum, hits): equal-width bins of a score in thousandths against a 0/1 label."""
    at = F.least(F.lit(bins - 1), F.expr(f"score * {bins} div 1000")).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.count("*").alias("samples"), F.sum("score").alias("confidence_sum"), F.sum("label").alias("hits"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(samples, ece, brier): expected calibration error in thousandths times samples, and the sum of squared errors in millionths."""
    per = reliability(scored, bins)
    ece = per.agg(F.sum("samples").alias("samples"), F.sum(F.abs(c("hits") * 1000 - c("confidence_sum"))).alias("ece"))
    brier = scored.agg(F.sum((c("score") - 1000 * c("label")) * (c("score") - 1000 * c("label"))).alias("brier"))
    return ece.crossJoin(brier)  # two rows of one


def confusion(predicted: DataFrame) -> DataFrame:
    """(label, predicted, n)."""
    return predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def gate(predicted: DataFrame, accuracy: int = 950, recall: int = 900, support: int = 10) -> DataFrame:
    """(label, support, hits, reasons): what each class lacks, thresholds in thousandths; label null is the whole."""
    per = predicted.groupBy("label").agg(F.count("*").alias("support"), F.count_if(c("label") == c("predicted")).alias("hits"))
    classes = per.withColumn("reasons", F.concat_ws(",", F.when(c("support") < support, "insufficient_support"), F.when(c("hits") * 1000 < c("support") * recall, "recall_below_threshold")))
    whole = per.agg(F.lit(None).cast("int").alias("label"), F.sum("support").alias("support"), F.sum("hits").alias("hits")).withColumn("reasons", F.concat_ws(",", F.when(c("hits") * 1000 < c("support") * accuracy, "accuracy_below_threshold")))
    return classes.select("label", "support", "hits", "reasons").unionByName(whole)


def regression(pairs: DataFrame) -> DataFrame:
    """(samples, square_sum, worst, bias_sum) of integer predictions and truths."""
    e = c("predicted") - c("truth")
    return pairs.agg(F.count("*").alias("samples"), F.sum(e * e).alias("square_sum"), F.max(F.abs(e)).alias("worst"), F.sum(e).alias("bias_sum"))


def temperature(scored: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(t, loss): the negative log likelihood in millionths of each temperature for two-class scores in thousandths."""
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), c("score") / F.lit(1000.0)))
    logit = F.ln(p / (F.lit(1.0) - p))
    rows = scored.withColumn("z", F.when(c("label") == 1, -logit).otherwise(logit)).withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    return rows.groupBy("t").agg(F.sum(F.rint(F.log1p(F.exp(c("z") / c("t"))) * 1e6).cast("long")).alias("loss"))
