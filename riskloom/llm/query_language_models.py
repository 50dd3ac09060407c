"""Queries of operators 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import kneser_ney, pitman_yor
from riskloom.llm.queries import table
from riskloom.session import cut_lineage

_c = F.col


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from all rows of quality 1."""
    ids = labels.where("quality = 1 and doc_id is not null").select(_c("doc_id").cast("string").alias("id")).distinct()
    scores = cut_lineage(kneser_ney.perplexities(docs, F.lit(True), _c("lang"), ids))
    return kneser_ney.judged(scores, ids)


def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return quality_scores(docs, table(spark, folder, "labels")).select(_c("id").cast("long").alias("doc_id"), "lang", "n_symbols", "perplexity", "limit", "rejected")


def text_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(_c("doc_id").cast("string").cast("binary")) % 7 == 2
    return pitman_yor.text_log_probabilities(docs, ~held_out).select(
        _c("id").cast("long").alias("doc_id"), (~_c("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


QUERIES = {"op6_text_scores": text_scores, "op7_quality": quality}
