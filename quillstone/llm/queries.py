"""The queries of this subpackage and the SQL that gives the same rows, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language, licenses, mixing, neardup, oracles, pii, quality, sharding, topk, vectordup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_top_k": topk.op2,
        "op3_pii": pii.op3,
        "op4_near_duplicates": neardup.op4,
        "op5_language": language.op5,
        "op6_near_vectors": vectordup.op6,
        "op7_licenses": licenses.op7,
        "op8_bpe": bpe.op8,
        "op9_quality": quality.op9,
        "op10_shards": sharding.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_top_k": oracles.TOP_K,
        "op4_near_duplicates": oracles.NEAR_DUPLICATES,
        "op6_near_vectors": oracles.NEAR_VECTORS,
        "op7_licenses": oracles.licences(),
    }
