"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.permuterm import spelling_variants
from riskloom.llm.queries import table


def spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"op11_spelling_variants": spelling}
