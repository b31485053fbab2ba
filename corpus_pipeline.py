"""A training-data pipeline over ``documents``: each stage is an operator of quillstone.llm, applied to what the last one kept.

quality   documents that the line CRF rejects go
near      one document of each class of near duplicates stays
pii       personal data in the texts is replaced by its kind
mix       documents are repeated or left out until sources have their target weights
encode    texts become token ids, with the text that the ids decode to as a check
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, mixing, neardup, pii, quality
from quillstone.llm.common import durable, table
from quillstone.llm.language import remainder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.3. The model is learned from the labelled documents of the whole table, as for op9."""
    model = quality.learn(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), lambda name: remainder(name, 5) != 0)
    return _columns(quality.score(docs, model).where(F.col("predicted") == 1), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; null texts and texts without words all stay."""
    return neardup.deduplicate(docs)


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew; null texts stay null."""
    hidden = pii.redact(docs)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return _columns(hidden, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's weight asks for; documents without words stay once."""
    mixed = mixing.mix_sources(docs.withColumn("__qs_words", mixing.words(F.col("text"))), F.col("__qs_words"))
    # a clash of names would have renamed a column of docs; the originals come first in any case
    kept = mixed.columns[: len(docs.columns)]
    repeated = mixed.where("copies > 0").withColumn("__qs_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, docs.columns, strict=True)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of each document, and whether the ids decode to its text."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), bpe.public_path())
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, under their names: operators put results last and rename what clashes in place."""
    return found.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(found.columns, docs.columns)])  # noqa: B905


STAGES = [("quality", keep_quality), ("near", drop_near_duplicates), ("pii", hide_pii), ("mix", mix), ("encode", encode)]
#: No SQL states a trained model, MinHash and byte-pair encoding; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"pipeline-{name}")
    return docs
