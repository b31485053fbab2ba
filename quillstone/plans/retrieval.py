"""Retrieval queries over documents, embeddings and parts, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import neighbours as N

#: Queries are the rows whose id is divisible by this, against all rows.
EVERY = 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lexical_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    weight = F.when(F.col("quality") == 1, 1000).when(F.col("quality") == 0, 400).otherwise(200)
    memory = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), N.tokens(F.col("text")).alias("tokens"), weight.alias("weight"))
    return memory.where(F.col("id") % EVERY == 0), memory


def _lexical_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all documents for every document."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), N.tokens(F.col("text")).alias("tokens"))
    weights = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 1000).when(F.col("quality") == 0, 400).otherwise(200).alias("weight"))
    return N.lexical_each(docs, weights, 200)


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical_every(spark, sf_dir)


def lexical_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, memory = _lexical_sides(spark, sf_dir)
    return N.lexical(queries, memory, k=3, num=15)


def lexical_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every document."""
    labels = read(spark, sf_dir, "labels").select("doc_id")
    queries = read(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"))
    return N.lexical_verdict(_lexical_every(spark, sf_dir), queries)


def some_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for the documents whose id is divisible by EVERY, as the SQL of result_contract counts them."""
    queries, memory = _lexical_sides(spark, sf_dir)
    return N.lexical_verdict(N.lexical(queries, memory), queries)


_LEX = """m AS (SELECT d.doc_id AS id, lang AS domain, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tokens, CASE quality WHEN 1 THEN 1000 WHEN 0 THEN 400 ELSE 200 END AS weight FROM documents d LEFT JOIN labels USING (doc_id)),
 p AS (SELECT q.id AS query_id, m.id, m.weight, len(list_intersect(q.tokens, m.tokens)) AS sh, len(q.tokens) + len(m.tokens) AS su FROM m q JOIN m ON q.domain = m.domain AND q.id <> m.id WHERE q.id % 50 = 0),
 f AS (SELECT query_id, id, sh * 1000000 // (su - sh) AS sim, sh * 1000 * weight // (su - sh) AS score FROM p WHERE sh > 0 AND sh * 100 >= (su - sh) * {}),
 t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, id) AS INT) AS rank, id, sim, score FROM f)"""

#: The same where every row asks.
_LEX_EACH = _LEX.replace(" WHERE q.id % 50 = 0", "")


def _doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, v): four features of labelled documents, in millionths."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id")
    words = F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0))
    lines = F.split("text", "\n")
    part = lambda a, b: F.expr("0") if a is None else F.floor(a.cast("long") * 1_000_000 / F.greatest(b, F.lit(1))).cast("long")
    v = F.array(
        (F.least(F.length("text"), F.lit(5000)) * 200).cast("long"), part(F.size(F.array_distinct(words)), F.size(words)), part(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        part(F.length("text") - F.length(F.regexp_replace("text", "[^\\p{L}]", "")), F.length("text")),
    )
    return docs.select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label"), v.alias("v")).withColumn("key", F.lit("all"))


_DOCF = """d0 AS (SELECT d.doc_id AS id, CAST(quality AS VARCHAR) AS label, text, regexp_extract_all(text, '[^ \\n]+') AS w, string_split(text, chr(10)) AS l FROM documents d JOIN labels USING (doc_id)),
 m AS (SELECT id, label, [CAST(least(length(text), 5000) * 200 AS BIGINT), len(list_distinct(w)) * 1000000 // greatest(len(w), 1), (len(l) - len(list_distinct(l))) * 1000000 // len(l), (length(text) - length(regexp_replace(text, '[^\\p{L}]', '', 'g'))) * 1000000 // greatest(length(text), 1)] AS v FROM d0)"""
_EMBF = """m AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS v FROM embeddings)"""
_NEAR = """n AS (SELECT query_id, rank, id, label, d2 FROM (SELECT q.id AS query_id, m.id, m.label, CAST(list_sum(list_transform(range(1, len(m.v) + 1), lambda i: (q.v[i] - m.v[i]) * (q.v[i] - m.v[i]))) AS BIGINT) AS d2, row_number() OVER (PARTITION BY q.id ORDER BY d2, m.id) AS rank FROM m q JOIN m ON q.id <> m.id WHERE q.id % 50 = 0) WHERE rank <= {})"""
_VOTE = """s AS (SELECT *, CAST(floor(greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - sqrt(CAST(d2 AS DOUBLE)) / CAST({scale!r} AS DOUBLE)) * 1000000) AS BIGINT) AS sim FROM n),
 p AS (SELECT query_id, count(*) AS n, min(label) AS lo, max(label) AS hi, CAST(sum(sim) AS BIGINT) AS total FROM s WHERE sim >= {least} GROUP BY query_id),
 a AS (SELECT q.id AS query_id, coalesce(n, 0) AS n, lo, hi, total, CASE WHEN coalesce(n, 0) < 3 THEN 'too_few_similar' WHEN lo <> hi THEN 'mixed_labels' ELSE '' END AS reason FROM (SELECT id FROM m WHERE id % 50 = 0) q LEFT JOIN p ON p.query_id = q.id)
 SELECT query_id, CASE WHEN reason = '' THEN 'suggest' ELSE 'abstain' END AS status, reason, CASE WHEN reason = '' THEN lo END AS label, n AS neighbours, CASE WHEN reason = '' THEN least(950000, total // n) ELSE 0 END AS confidence FROM a"""


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long")).alias("v"), F.lit("all").alias("key"))


def _voted(memory: DataFrame, width: int, scale: float, least: float = N.MIN_SIMILARITY) -> DataFrame:
    queries = memory.where(F.col("id") % EVERY == 0)
    near = N.nearest(queries, memory, 5, width)
    return N.vote(near, memory.select("id", "label"), queries.select(F.col("id").alias("query_id")), width, scale, least)


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mean similarity of the five nearest embeddings falls below the space's own level: novel, in_space or unsupported."""
    memory = _embeddings(spark, sf_dir)
    near = N.nearest(memory.where(F.col("id") % EVERY == 0), memory, 5, 64)
    sim = F.floor(F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(F.col("d2").cast("double")) / F.lit(8000.0)) * 1_000_000).cast("long")
    per = near.withColumn("sim", sim).groupBy("query_id").agg(F.count_if(F.col("sim") >= 400_000).alias("n"), F.sum(F.when(F.col("sim") >= 400_000, F.col("sim"))).alias("total"))
    mean = F.expr("total div greatest(n, 1)")
    return per.select("query_id", F.when(F.col("n") < 3, "unsupported").when(mean < 860_000, "novel").otherwise("in_space").alias("verdict"), mean.alias("mean_similarity"))


def one_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = _embeddings(spark, sf_dir)
    return N.nearest(memory.where(F.col("id") % EVERY == 0), memory, 1, 64).select("query_id", "id", "d2")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_name").distinct()
    return p.select(F.col("p_name").alias("form"), F.element_at(F.split("p_name", " "), -1).alias("family"))


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = names(spark, sf_dir)
    return N.edit_neighbours(forms, forms)


def exact_then_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the names of brands 1 to 12: found once, found often, or the nearest by edit distance."""
    parts = read(spark, sf_dir, "part")
    memory = parts.where(F.substring_index("p_brand", "#", -1).cast("int") <= 12).groupBy(F.col("p_name").alias("form")).agg(F.count("*").alias("n"))
    queries = names(spark, sf_dir)
    near = N.edit_neighbours(queries, memory.select("form", F.element_at(F.split("form", " "), -1).alias("family")), 1).select("query", F.col("form").alias("nearest"))
    both = queries.join(memory, "form", "left").join(near, F.col("form") == F.col("query"), "left")
    status = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(F.col("nearest").isNotNull(), "fuzzy").otherwise("unknown")
    return both.select("form", status.alias("status"), F.when(status == "fuzzy", F.col("nearest")).otherwise(F.when(F.col("n") >= 1, F.col("form"))).alias("match"), F.coalesce("n", F.lit(0)).alias("matches"))


def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pairs whose 60-bit digests differ in three bits at most."""
    h = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("hash"))
    return N.hamming_neighbours(h.where(F.col("id") % EVERY == 0), h, bits=60)


def cognates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that parts of different types share, with the smallest other type: labelled sets across groups."""
    p = read(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    per = p.groupBy("p_name").agg(F.count("*").alias("types"), F.min("p_type").alias("first"), F.max("p_type").alias("last"))
    both = p.join(per.where("types > 1"), "p_name")
    return both.select("p_name", "p_type", "types", F.when(F.col("p_type") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other"))


QUERIES = {
    "lexical_topk": lexical_topk, "lexical_loose": lexical_loose, "lexical_verdict": lexical_verdict, "knn_quality_vote": lambda s, f: _voted(_doc_features(s, f), 4, 1e6),
    "knn_vote_embeddings": lambda s, f: _voted(_embeddings(s, f), 64, 1e3), "knn_novelty": novelty, "knn_one_nearest": one_nearest, "edit_distance_knn": edit_distance, "exact_then_fuzzy_lookup": exact_then_fuzzy,
    "hamming_knn": hamming, "cognate_sets": cognates,
}

_EDIT = "x AS (SELECT DISTINCT p_name AS form, string_split(p_name, ' ')[-1] AS family FROM part)"
ORACLES = {
    "lexical_topk": f"WITH {_LEX_EACH.replace("{}", "34")} SELECT * FROM t WHERE rank <= 5",
    "lexical_loose": f"WITH {_LEX.replace("{}", "15")} SELECT * FROM t WHERE rank <= 3",
    "lexical_verdict": f"WITH {_LEX_EACH.replace("{}", "34")}, g AS (SELECT query_id, count(*) AS n, min(id) FILTER (rank = 1) AS top, max(sim) AS sim FROM t WHERE rank <= 5 GROUP BY query_id) SELECT m.id AS query_id, CASE WHEN n >= 2 THEN 'suggest' ELSE 'abstain' END AS status, CASE WHEN n IS NULL THEN 'no_similar_memories' WHEN n < 2 THEN 'too_few_similar_memories' ELSE '' END AS reason, CASE WHEN n >= 2 THEN top END AS top_id, coalesce(n, 0) AS neighbours, CASE WHEN n >= 2 THEN least(950000, sim) ELSE 0 END AS confidence FROM m LEFT JOIN g ON g.query_id = m.id",
    "knn_quality_vote": f"WITH {_DOCF}, {_NEAR.format(5)}, " + _VOTE.format(scale=1e6 * 4**0.5, least=700000),
    "knn_vote_embeddings": f"WITH {_EMBF}, {_NEAR.format(5)}, " + _VOTE.format(scale=1e3 * 64**0.5, least=700000),
    "knn_novelty": f"WITH {_EMBF}, {_NEAR.format(5)}, s AS (SELECT *, CAST(floor(greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - sqrt(CAST(d2 AS DOUBLE)) / CAST(8000 AS DOUBLE)) * 1000000) AS BIGINT) AS sim FROM n), p AS (SELECT query_id, count(*) FILTER (sim >= 400000) AS n, CAST(sum(sim) FILTER (sim >= 400000) AS BIGINT) AS total FROM s GROUP BY query_id) SELECT query_id, CASE WHEN n < 3 THEN 'unsupported' WHEN total // greatest(n, 1) < 860000 THEN 'novel' ELSE 'in_space' END AS verdict, total // greatest(n, 1) AS mean_similarity FROM p",
    "knn_one_nearest": f"WITH {_EMBF}, {_NEAR.format(1)} SELECT query_id, id, d2 FROM n",
    "edit_distance_knn": f"WITH {_EDIT} SELECT query, CAST(rank AS INT) AS rank, form, distance, sim FROM (SELECT a.form AS query, b.form, CAST(levenshtein(a.form, b.form) AS INT) AS distance, 1000000 - CAST(levenshtein(a.form, b.form) * 1000000 // greatest(length(a.form), length(b.form)) AS BIGINT) AS sim, row_number() OVER (PARTITION BY a.form ORDER BY levenshtein(a.form, b.form), b.form) AS rank FROM x a JOIN x b ON a.family = b.family AND a.form <> b.form) WHERE rank <= 3",
    "exact_then_fuzzy_lookup": f"WITH {_EDIT}, mem AS (SELECT p_name AS form, count(*) AS n FROM part WHERE CAST(string_split(p_brand, '#')[-1] AS INT) <= 12 GROUP BY 1), nr AS (SELECT x.form AS query, first(mem.form ORDER BY levenshtein(x.form, mem.form), mem.form) AS nearest FROM x JOIN mem ON string_split(mem.form, ' ')[-1] = x.family AND mem.form <> x.form GROUP BY 1) SELECT x.form, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' WHEN nearest IS NOT NULL THEN 'fuzzy' ELSE 'unknown' END AS status, CASE WHEN n >= 1 THEN x.form ELSE nearest END AS match, coalesce(n, 0) AS matches FROM x LEFT JOIN mem USING (form) LEFT JOIN nr ON nr.query = x.form",
    "hamming_knn": "WITH h AS (SELECT doc_id AS id, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS hash FROM documents) SELECT * FROM (SELECT q.id AS query_id, g.id, CAST(bit_count(xor(q.hash, g.hash)) AS INT) AS distance, 'duplicate' AS verdict FROM h q JOIN h g ON q.id <> g.id AND q.id % 50 = 0) WHERE distance <= 3",
    "cognate_sets": "WITH p AS (SELECT DISTINCT p_name, p_type FROM part), g AS (SELECT p_name, count(*) AS types, min(p_type) AS lo, max(p_type) AS hi FROM p GROUP BY 1) SELECT p_name, p_type, types, CASE WHEN p_type = lo THEN hi ELSE lo END AS other FROM p JOIN g USING (p_name) WHERE types > 1",
}
