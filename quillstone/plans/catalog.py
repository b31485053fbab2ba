"""Every registered query by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import choosing, editing, features, fields, files, models, normals, perception, phones, preview, raster, retrieval, rules, signals, specialists, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (retrieval, rules, signals, raster, fields, features, files, editing, perception, values, specialists, phones, choosing, models, preview, normals):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
