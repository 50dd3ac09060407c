"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.jaccard import similarity_join
from riskloom.llm.queries import table


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_join(table(spark, folder, "documents"))


QUERIES = {"op3_jaccard_join": jaccard_join}
