"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.queries import table
from riskloom.llm.syncmers import edited_fingerprints


def fingerprinting(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


QUERIES = {"op2_fingerprints": fingerprinting}
