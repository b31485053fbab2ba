"""Phone inventories: retrieval by articulatory features that may be missing, and by vectors of one length with their evidence.

Features are doubles from 0 to 1; distances are worked out on millionths as whole numbers, so equal distances are equal in every engine.
Both searches join on the language, so a query never meets another language's phones; an inventory is bounded by the phones of a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.numeric import fixed
from quillstone.operators.rules import EVIDENCE

c = F.col
# The names a phone may have features for.
FEATURES = ("voicing", "manner", "place", "height", "backness", "rounding", "f1", "f2")
SHARED, FEWEST, MIN_SIMILARITY, CAP = 3, 3, 0.5, 950_000


def _strength(name: Column) -> Column:
    """1 for attested to 4 for speculative; anything else counts as speculative."""
    return F.coalesce(*[F.when(name == e, i + 1) for i, e in enumerate(EVIDENCE)], F.lit(len(EVIDENCE)))


def problems(items: DataFrame) -> DataFrame:
    """(id, problem) of inventory rows that must not be used: names missing, unknown evidence, features unknown, out of range or absent altogether."""
    blank = lambda n: F.coalesce(F.trim(c(n)), F.lit("")) == ""
    value = F.map_filter("features", lambda _, v: v.isNotNull())
    out = F.exists(F.map_values(value), lambda v: F.isnan(v) | (v < 0) | (v > 1))
    problem = (
        F.when(blank("id") | blank("ipa") | blank("language_id") | blank("source"), "needs id, ipa, language_id and source")
        .when(~F.coalesce(c("evidence").isin(*EVIDENCE), F.lit(False)), "unknown evidence")
        .when(F.exists(F.map_keys("features"), lambda k: ~k.isin(*FEATURES)), "unknown feature")
        .when(c("features").isNull() | (F.size(value) == 0), "no feature")
        .when(out, "feature out of range")
    )
    return items.select("id", problem.alias("problem")).where("problem is not null")


def _vector() -> Column:
    """The features in millionths in their order, unknown ones null."""
    return F.array(*[fixed(c("features")[n]) for n in FEATURES])


def _pairs(queries: DataFrame, inventory: DataFrame, least: float, k: int) -> DataFrame:
    """Each different (language_id, qv) with the different vectors of its language that share at least three features and are similar enough.

    A vector of the inventory comes with its ``k`` smallest phones, and the least and greatest ipa of all of its phones: equal phones are equally far from any query.
    """
    m = inventory.select("language_id", c("id").alias("phone"), "ipa", _strength(c("evidence")).alias("e"), _vector().alias("mv"))
    place = F.row_number().over(Window.partitionBy("language_id", "mv").orderBy("phone"))
    first = m.withColumn("n", place).where(c("n") <= k).groupBy("language_id", "mv").agg(F.array_sort(F.collect_list(F.struct("phone", "ipa", "e"))).alias("phones"))  # k rows
    named = m.groupBy("language_id", "mv").agg(F.min("ipa").alias("low"), F.max("ipa").alias("high"))
    kinds = first.join(named, ["language_id", "mv"])
    both = queries.select("language_id", _vector().alias("qv")).distinct().join(kinds, "language_id")
    gap = [c("qv")[i] - c("mv")[i] for i in range(len(FEATURES))]
    both = both.withColumn("shared", sum((g.isNotNull().cast("int") for g in gap), F.lit(0))).where(c("shared") >= SHARED)
    d2 = sum((F.coalesce(g * g, F.lit(0)) for g in gap), F.lit(0).cast("long"))
    sim = F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(d2.cast("double")) / F.lit(1e6) / F.sqrt(c("shared").cast("double")))
    same = F.lit(True)
    for i in range(len(FEATURES)):
        same = same & c("qv")[i].eqNullSafe(c("mv")[i])
    return both.select("language_id", "qv", "phones", "low", "high", same.alias("same"), fixed(sim).alias("sim")).where(c("sim") >= int(least * 1_000_000))


def retrieve(queries: DataFrame, inventory: DataFrame, k: int = 5, least: float = MIN_SIMILARITY) -> DataFrame:
    """(id, status, reason, ipa, evidence, certified, neighbours, strength): the most similar phone of a query's language.

    ``queries`` is (id, language_id, features), ``inventory`` also ipa, evidence; features are maps of names to doubles, missing names are unknown
    and not 0. Fewer than three similar phones abstain, and so do different phones of the greatest similarity. Evidence is the weakest of the
    neighbours; only an equal set of features with attested neighbours is certified, other attested ones are inferred. Ties go to the smaller id.
    Equal features are compared once: phones and queries meet as the different vectors of a language.
    """
    key = ["language_id", "qv"]
    pairs = _pairs(queries, inventory, least, k)
    top = pairs.groupBy(*key, "sim").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy(*key).agg(F.max(F.struct("sim", "low", "high")).alias("top"))
    # the k nearest phones are among those of the k nearest vectors, in order of their smallest phones
    kind = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("sim"), c("phones")[0]["phone"]))
    near = pairs.withColumn("kind", kind).where(c("kind") <= k).select(*key, "same", "sim", F.explode("phones").alias("p")).select(*key, "same", "sim", "p.*")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("sim"), "phone"))
    near = near.withColumn("place", place).where(c("place") <= k)
    per = near.groupBy(*key).agg(F.count("*").alias("n"), F.sum("sim").alias("total"), F.max("e").alias("e"), F.min_by(F.struct("ipa", "same"), "place").alias("first")).join(top, key)
    found = queries.select("id", "language_id", _vector().alias("qv")).join(per, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    reason = F.when(c("n") < FEWEST, "too_few_similar_phones").when(c("top.low") != c("top.high"), "ambiguous_nearest_phones").otherwise("")
    found = found.withColumn("reason", reason)
    ok = c("reason") == ""
    sure = (c("e") == 1) & c("first.same")
    evidence = F.when(c("n") < FEWEST, "speculative").when(~ok, "inferred").when((c("e") == 1) & ~sure, "inferred").otherwise(F.element_at(F.array(*map(F.lit, EVIDENCE)), c("e")))
    return found.select(
        "id", F.when(ok, "suggest").otherwise("abstain").alias("status"), "reason", F.when(ok, c("first.ipa")).alias("ipa"), evidence.alias("evidence"), F.coalesce(ok & sure, F.lit(False)).alias("certified"),
        c("n").alias("neighbours"), F.when(ok, F.least(F.lit(CAP).cast("long"), F.expr("total div n"))).otherwise(F.lit(0).cast("long")).alias("strength"),
    )


def registered(records: DataFrame) -> DataFrame:
    """``records`` (symbol, language, v, evidence, source) with evidence in lower case and problem: null where a record may enter a memory."""
    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    bad = c("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    rows = records.withColumn("evidence", F.lower("evidence"))
    known = F.coalesce(c("evidence").isin(*EVIDENCE), F.lit(False))
    return rows.withColumn("problem", F.when(blank("symbol") | blank("language") | blank("source"), "needs symbol, language and source").when(~known, "unknown evidence").when(bad, "features must be from 0 to 1"))


def nearest_records(queries: DataFrame, memory: DataFrame, k: int = 3, least_evidence: str = "speculative") -> DataFrame:
    """(id, place, symbol, evidence, distance, confidence): the ``k`` records of a query's language nearest to it, in ten thousandths.

    ``queries`` is (id, language, v), ``memory`` (record, language, symbol, evidence, v); only evidence of at least ``least_evidence`` counts. Vectors of
    different lengths stop the query. Ties in distance, as rounded, go to the smaller record.
    """
    if k < 1:
        raise ValueError("k must be a positive integer")
    whole = lambda n: F.transform(n, lambda x: fixed(x))
    m = memory.where(_strength(c("evidence")) <= EVIDENCE.index(least_evidence) + 1).select("language", "record", "symbol", "evidence", whole("v").alias("mv"))
    both = queries.select("id", "language", whole("v").alias("qv")).join(m, "language")
    d2 = F.aggregate(F.zip_with("qv", "mv", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    d2 = F.when(F.size("qv") == F.size("mv"), d2).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("long"))
    both = both.withColumn("d", F.sqrt(d2.cast("double")) / F.lit(1e6))
    near = both.select("id", "record", "symbol", "evidence", fixed(c("d"), 1e4).alias("distance"), fixed(F.greatest(F.lit(0.0), F.lit(1.0) - c("d") / F.lit(2.0)), 1e4).alias("confidence"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "record"))
    return near.withColumn("place", place).where(c("place") <= k).select("id", "place", "symbol", "evidence", "distance", "confidence")


def reconstruct(queries: DataFrame, memory: DataFrame, k: int = 3) -> DataFrame:
    """(id, symbol, evidence, confidence): the nearest record's symbol, '?' where none is near or different symbols are equally near.

    Evidence is attested only for a distance of 0 from an attested record, inferred above a confidence of 0.85, else speculative.
    """
    near = nearest_records(queries, memory, k)
    first = near.groupBy("id").agg(F.min_by(F.struct("symbol", "evidence", "distance", "confidence"), "place").alias("f"), F.collect_list(F.struct("symbol", "distance")).alias("all"))  # k rows
    tie = F.exists("all", lambda z: (z["distance"] == c("f.distance")) & (z["symbol"] != c("f.symbol")))
    found = queries.select("id").join(first, "id", "left")
    none = c("f").isNull() | tie
    evidence = F.when(none, "speculative").when((c("f.distance") == 0) & (c("f.evidence") == "attested"), "attested").when(c("f.confidence") > 8500, "inferred").otherwise("speculative")
    return found.select("id", F.when(none, "?").otherwise(c("f.symbol")).alias("symbol"), evidence.alias("evidence"), F.when(none, F.lit(0).cast("long")).otherwise(c("f.confidence")).alias("confidence"))
