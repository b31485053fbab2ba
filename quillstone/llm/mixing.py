"""Mixing sources to target weights by entropy balancing.

The mix keeps every document near one copy in relative entropy, ``sum(r log r - r + 1)``, subject to one token
constraint per source, ``sum(r * size) = target``, and ``0 <= r <= 3``. The dual of that convex problem has one
multiplier per source and its optimum tilts every document exponentially: ``r = min(cap, exp(lambda * x))`` with
``x`` the document's size over the mean size of its source. Newton iterations on ``log(sum)`` find the
multipliers; they run as Spark aggregates over the exact histogram (source, size, documents), since equal sizes
share a rate. The rates are then rounded to whole copies by systematic sampling along the sizes, so that a
source's words miss its target by about one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, make_room, running_sum, table

#: Repeating weights of the sources in the order of their names.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is copied more often, no target exceeds this many times its source.
CAP = 3
#: Relative miss of the token constraints at which the iterations end, and their greatest number.
TOLERANCE, ROUNDS = 1e-7, 60
#: Steps of Newton's method in one Spark job.
STEPS = 3
SALTS = 64


def words(text: Column) -> Column:
    """Number of runs of characters that are neither space nor tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, none above ``cap`` times its source.

    With ``level`` words per unit of weight a source gets ``min(cap * size, weight * level)``; the level at which
    all targets add up to all words is found from the sources in order of ``cap * size / weight``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(rest)).withColumn("place", F.row_number().over(order))
    # the first source, in that order, that is not capped fixes the level of all later ones
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", F.col("level").alias("at")))).over(whole)
    rows = rows.withColumn("at", level["at"])
    return rows.select("source", "source_size", F.coalesce(F.least(cap * F.col("source_size").cast("double"), F.col("weight") * F.col("at")), F.lit(0.0)).alias("target"))


def _newton(hist: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One guarded Newton step for every source: state (source, ..., lam, lo, hi, miss)."""
    joined = hist.join(state, hist.source.eqNullSafe(state.source)).drop(hist.source)
    tilt = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(60.0)))
    mass = F.col("docs") * F.col("size")
    g = joined.groupBy("source", "source_size", "target", "lam", "lo", "hi").agg(
        F.sum(mass * F.least(F.lit(float(cap)), tilt)).alias("f"),
        F.sum(F.when(tilt < cap, mass * F.col("x") * tilt).otherwise(0.0)).alias("slope"),
    )
    lo = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
    hi = F.when(F.col("f") < F.col("target"), F.col("hi")).otherwise(F.col("lam"))
    g = g.withColumns({"lo2": lo, "hi2": hi, "miss": F.abs(F.try_divide(F.col("f"), F.col("target")) - 1)})
    step = F.col("lam") - F.ln(F.try_divide(F.col("f"), F.col("target"))) * F.try_divide(F.col("f"), F.col("slope"))
    step = F.when((step > F.col("lo2")) & (step < F.col("hi2")), step).otherwise((F.col("lo2") + F.col("hi2")) / 2)
    done = F.col("miss") <= TOLERANCE
    return g.select("source", "source_size", "target", F.when(done, F.col("lam")).otherwise(step).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "miss")


def mix_sources(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (an int from 0 to ``cap``); all columns stay.

    ``size`` is an expression over ``docs`` (a count; null counts as 0). A null source is a source of its own.
    Very long texts are large sizes and no more. Documents of size 0 keep one copy and add no words; a source without words has target 0. Equal rows may
    differ in copies, but their number with each is fixed. ``key`` and the size alone decide, so reruns agree;
    repeated keys are separate documents. An empty table gives an empty table. Columns of ``docs`` that bear a
    result's name are kept under that name plus an underscore. Names that begin with ``__qs_`` are the operator's own.
    """
    src = "__qs_source"
    docs = docs.withColumns({"__qs_size": F.coalesce(size.cast("long"), F.lit(0).cast("long")), src: F.col(source).cast("string"), "__qs_key": F.col(key)})
    docs, key = make_room(docs, "size", "source_size", "target", "rate", "copies").withColumnRenamed("__qs_size", "size"), "__qs_key"
    hist = durable(docs.groupBy(F.col(src).alias("source"), "size").agg(F.count("*").alias("docs")), "mix-hist")
    per = hist.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("docs"))).alias("with_words"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    goal = targets(per.select("source", "source_size"), weights, cap)
    mean = F.try_divide(F.col("source_size"), F.col("with_words"))
    per = durable(goal.join(per.drop("source_size").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("mean", mean), "mix-sources")
    grows = F.col("target") > F.col("source_size")
    full = F.col("target") >= cap * F.col("source_size") * (1 - TOLERANCE)
    top = F.ln(F.lit(float(cap))) * F.col("mean") / F.col("least")
    state = per.select("source", "source_size", "target", F.when(full, top).otherwise(0.0).alias("lam"), F.when(grows, 0.0).otherwise(-1e12).alias("lo"), F.when(grows, top).otherwise(0.0).alias("hi"), F.lit(None).cast("double").alias("miss"))
    positive = hist.where("size > 0").join(per.select(F.col("source").alias("s"), "mean"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "docs", (F.col("size") / F.col("mean")).alias("x"))
    fixed = durable(state.where(full | (F.col("target") <= 0)), "mix-fixed")
    open_ = durable(state.where(~full & (F.col("target") > 0)), "mix-state")
    for _ in range(math.ceil(ROUNDS / STEPS)):
        if open_.where(f"miss is null or miss > {TOLERANCE}").isEmpty():
            break
        for _ in range(STEPS):
            open_ = _newton(positive, open_, cap)
        open_ = durable(open_, "mix-state")
    solved = open_.union(fixed).select(F.col("source").alias("s"), "lam", "source_size", "target").join(per.select(F.col("source").alias("s2"), "mean"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    rated = hist.join(solved, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("target") >= cap * F.col("source_size") * (1 - TOLERANCE), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(60.0)))))
    rated = rated.withColumn("rate", rate).withColumn("mass", F.col("docs") * F.col("rate"))
    # systematic rounding along the sizes: rows of one size get the whole numbers that their stretch of rates passes
    band = F.when(F.col("size") <= 0, 0).otherwise(F.least(F.lit(255), F.floor(F.sqrt(F.col("size").cast("double")))))
    rated = running_sum(rated, ["source"], ["size"], F.col("mass"), "before", band, 256)
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    total = F.floor(F.col("before") + F.col("mass") + offset) - F.floor(F.col("before") + offset)
    total = F.when(F.col("size") == 0, F.col("docs")).otherwise(F.greatest(F.lit(0), F.least(F.col("docs") * cap, total)))
    plan = rated.select(F.col("source").alias("__qs_s"), F.col("size").alias("__qs_n"), "source_size", "target", "rate", F.floor(total / F.col("docs")).alias("__qs_least"), F.pmod(total, F.col("docs")).alias("__qs_more"))
    plan = durable(plan, "mix-plan")
    rows = docs.join(plan, docs[src].eqNullSafe(F.col("__qs_s")) & (F.col("size") == F.col("__qs_n"))).drop("__qs_s", "__qs_n")
    salt = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(SALTS))
    ranked = running_sum(rows, [src, "size"], [F.xxhash64(F.col(key), F.lit(11)), F.col(key)], F.lit(1), "__qs_rank", salt, SALTS)
    copies = (F.col("__qs_least") + F.when(F.col("__qs_rank") < F.col("__qs_more"), 1).otherwise(0)).cast("int")
    return ranked.withColumn("copies", copies).drop("__qs_least", "__qs_more", "__qs_rank", "__qs_key", src)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = durable(table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("words")), "mix-docs")
    mixed = mix_sources(docs, F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
