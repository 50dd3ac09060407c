"""Query of operator 9."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.packing import pack
from riskloom.llm.queries import table

# The ranks of byte_bpe_50k.json in a form that encodes faster; the ids are the same.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


QUERIES = {"op9_packing": packing}
