"""Query of operator 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.linededup import remove_repeated_lines
from riskloom.llm.queries import table


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"op1_line_dedup": line_dedup}
