"""Readers and writers of loan tables, bank statements and reports."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import scalars as X

# ---- fixed values -----------------------------------------------------------------
TEXT_MARKS = ("description", "notes", "title", "text", "comment")
STATEMENT_ALIASES = {
    "date": ("Date", "Transaction Date", "Txn Date"),
    "description": ("Description", "Narration", "Details"),
    "debit": ("Debit", "Withdrawal Amt"),
    "credit": ("Credit", "Deposit Amt"),
    "balance": ("Balance", "Running Balance"),
    "account": ("Account No", "Account Number"),
}
UPI_ALIASES = {
    "date": ("Date", "Transaction Date", "Txn Date"),
    "vpa": ("UPI ID", "VPA", "Receiver"),
    "amount": ("Amount", "Txn Amount"),
    "status": ("Status", "Txn Status"),
    "note": ("Note", "Description", "Remarks"),
    "account": ("From Account", "Account"),
}
UPI_DONE = ("SUCCESS", "COMPLETED")
# ---- end of fixed values ----------------------------------------------------------

_c = F.col


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Reader by suffix: CSV with header, or Parquet. Give a schema for large CSV data, as
    inference reads them twice."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind == ".parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    raise ValueError(f"unsupported file format: {kind or path}")


def read_external(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV reference data."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(m in c.lower() for m in TEXT_MARKS)]


def read_dir(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Every CSV and Parquet file of a folder, stacked by column name."""
    parts = []
    for kind in ("parquet", "csv"):
        reader = spark.read.option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True)
        if kind == "csv":
            reader = reader.option("header", True)
        if schema is not None:
            reader = reader.schema(schema)
        try:
            parts.append(reader.parquet(path) if kind == "parquet" else reader.csv(path))
        except Exception as e:  # no file of this kind: nothing to infer a schema from
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    if not parts:
        raise ValueError(f"no CSV or Parquet files in {path}")
    out = parts[0]
    for p in parts[1:]:
        if schema is None:
            # Text columns of inferred CSV take the type the Parquet files have.
            types = dict(out.dtypes)
            p = p.select(*[_c(f"`{c}`").try_cast(types[c]).alias(c) if c in types else _c(f"`{c}`") for c in p.columns])
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def file_inventory(df: DataFrame) -> DataFrame:
    """Rows and columns per file of a DataFrame that was read from files."""
    return df.groupBy(F.element_at(F.split(_c("_metadata.file_path"), "/"), -1).alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")
    )


def _alias(df: DataFrame, names: Sequence[str], default: str | None) -> Column:
    """First of the header names that is there and not empty."""
    have = {c.lower(): c for c in df.columns}
    found = [F.nullif(_c(f"`{have[n.lower()]}`").cast("string"), F.lit("")) for n in names if n.lower() in have]
    return F.trim(F.coalesce(*found, F.lit(default)))


def normalize_statement(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Bank-statement rows to transactions; rows without date or amount are dropped."""
    a = {k: v for k, v in STATEMENT_ALIASES.items()}
    rows = df.select(
        *keep,
        X.parse_date(_alias(df, a["date"], None)).alias("transaction_date"),
        F.coalesce(_alias(df, a["description"], ""), F.lit("")).alias("description"),
        X.safe_number(_alias(df, a["debit"], "0")).alias("debit"),
        X.safe_number(_alias(df, a["credit"], "0")).alias("credit"),
        X.safe_number(_alias(df, a["balance"], "0")).alias("balance_after"),
        _alias(df, a["account"], "UNKNOWN").alias("account_id"),
    ).where(_c("transaction_date").isNotNull() & ((_c("credit") > 0) | (_c("debit") > 0)))
    is_credit = _c("credit") > 0
    return rows.select(
        *keep,
        "account_id",
        "transaction_date",
        F.when(is_credit, "credit").otherwise("debit").alias("transaction_type"),
        F.when(is_credit, _c("credit")).otherwise(_c("debit")).alias("amount"),
        "balance_after",
        X.infer_category(_c("description")).alias("category"),
        "description",
        X.infer_channel(_c("description")).alias("channel"),
        X.is_recurring(_c("description")).alias("is_recurring"),
    )


def normalize_upi(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """UPI export rows to transactions; only completed ones with a positive amount."""
    a = UPI_ALIASES
    rows = df.select(
        *keep,
        X.parse_date(_alias(df, a["date"], None)).alias("transaction_date"),
        _alias(df, a["vpa"], "").alias("merchant_name"),
        X.safe_number(_alias(df, a["amount"], "0")).alias("amount"),
        F.upper(_alias(df, a["status"], "SUCCESS")).alias("status"),
        F.coalesce(_alias(df, a["note"], ""), F.lit("")).alias("description"),
        _alias(df, a["account"], "UPI_DEFAULT").alias("account_id"),
    ).where(_c("status").isin(*UPI_DONE) & _c("transaction_date").isNotNull() & (_c("amount") > 0))
    return rows.select(
        *keep,
        "account_id",
        "transaction_date",
        F.when(F.lower("description").contains("received"), "credit").otherwise("debit").alias("transaction_type"),
        "amount",
        F.lit(0.0).alias("balance_after"),
        X.infer_category(F.concat_ws(" ", "description", "merchant_name")).alias("category"),
        "merchant_name",
        "description",
        F.lit("UPI").alias("channel"),
    )


def write_processed(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write Parquet, return the manifest of the files written."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return file_inventory(df.sparkSession.read.parquet(path))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
