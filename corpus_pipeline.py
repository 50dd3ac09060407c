"""A training-data pipeline over `documents`, stage by stage.

Every stage takes (spark, docs, folder) and returns the rows it keeps; all but the last return the
columns of documents, with `n_chars` after the change.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.fmindex import decontaminate
from riskloom.llm.jaccard import similarity_join
from riskloom.llm.linededup import remove_repeated_lines
from riskloom.llm.packing import pack
from riskloom.llm.query_language_models import quality_scores
from riskloom.llm.query_packing import RANKS
from riskloom.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is beyond the limit of their language go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    gone = cut_lineage(quality_scores(docs.select("doc_id", "text", "lang"), labels).where("rejected").select(F.col("row_key").alias("__key")).distinct())
    return docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(gone, "__key", "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; so does a document of which nothing else is left."""
    return _measured(remove_repeated_lines(docs).where("n_removed = 0 or length(trim(text)) > 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    found = similarity_join(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.expr("doc_id <=> class_id")).alias("__kept"))
    gone = cut_lineage(found.where("not __kept").select("__id"))  # few, and their size is known: texts need no shuffle
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; fewer benchmark words are cut out of the text."""
    found = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated")
    return _measured(found.withColumn("text", F.coalesce("clean_text", "text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return pack(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No stage but the fourth can be told in SQL: the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
