"""The queries of this package: every operator over its whole table, and SQL where it can tell."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("linededup", "syncmers", "jaccard", "fmindex", "models", "language_models", "packing", "chat", "permuterm", "pivots", "imi")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for m in MODULES:
        found |= importlib.import_module(f"riskloom.llm.query_{m}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"riskloom.llm.query_{m}"), "SQL", {})
    return found
