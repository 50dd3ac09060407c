"""Queries of operators 5 and 8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import language, toxicity
from riskloom.llm.queries import table


def part(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    # the ids of the learned rows are few by a parameter, so they go to the texts, not the texts to them
    chosen = table(spark, folder, "labels").select("doc_id", "toxic").where("toxic is not null").where(part(5) != 0)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARNED)
    model = toxicity.fit(docs.join(F.broadcast(chosen), "doc_id"), LEARNED)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(part(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "flagged")


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    names, net = language.fit(docs.where(part(5) != 0))
    return language.predict(docs.select("doc_id", "text"), names, net).select(
        "doc_id", F.coalesce(part(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


LEARNED = 12_000
QUERIES = {"op5_toxicity": toxic_documents, "op8_language": languages}
