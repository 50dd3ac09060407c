"""Experiment runs kept as three tables: runs, run_params, run_metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_c = F.col


def runs_compare(runs: DataFrame, params: DataFrame, metrics: DataFrame, names: Mapping[str, Sequence[str]], n: int = 10) -> DataFrame:
    """The last n runs with parameters and metrics as columns.

    Runs are limited first; `names` lists the columns, so the pivots need no extra pass.
    """
    last = runs.orderBy(_c("start_time").desc()).limit(n)

    def wide(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        mine = df.where(_c("key").isin(*keys)).join(last.select("run_id"), "run_id", "left_semi")
        return mine.groupBy("run_id").pivot("key", list(keys)).agg(F.max("value"))

    return (
        last.withColumn("duration_ms", _c("end_time") - _c("start_time"))
        .drop("end_time")
        .join(wide(params, names["params"]), "run_id", "left")
        .join(wide(metrics, names["metrics"]), "run_id", "left")
    )


def best_run(metrics: DataFrame, metric: str) -> DataFrame:
    """Run with the highest value of the metric (the lowest id among equals): one row."""
    best = metrics.where(_c("key") == metric).agg(F.max(F.struct(_c("value"), -_c("run_id"))).alias("b"))
    return best.select((-_c("b")[best.schema["b"].dataType.fieldNames()[1]]).alias("run_id"), _c("b.value").alias("value"))


def promote(metrics: DataFrame, metric: str, run_id: int) -> DataFrame:
    """Whether this run is the best one, or the first with that metric."""
    best = best_run(metrics, metric)
    return best.select((_c("run_id").isNull() | (_c("run_id") == run_id)).alias("promote"))


def latest_version(versions: DataFrame, stage: str = "production") -> DataFrame:
    """Highest integer version of each model name, moved to a stage."""
    return versions.groupBy("name").agg(F.max(_c("version").cast("int")).alias("version")).withColumn("stage", F.lit(stage))


def log_run(
    spark: SparkSession, folder: str, run_id: int, run_name: str, params: Mapping[str, object],
    metrics: Mapping[str, float], start_time: int, end_time: int | None, status: str = "FINISHED",
    tags: Mapping[str, str] | None = None,
) -> None:
    """Append one run; metrics that are not finite are left out."""
    spark.createDataFrame(
        [(run_id, run_name, status, start_time, end_time)],
        "run_id bigint, run_name string, status string, start_time bigint, end_time bigint",
    ).write.mode("append").parquet(f"{folder}/runs")
    rows = [(run_id, k, str(v)) for k, v in params.items()]
    spark.createDataFrame(rows, "run_id bigint, key string, value string").write.mode("append").parquet(f"{folder}/run_params")
    values = spark.createDataFrame([(run_id, k, float(v)) for k, v in metrics.items()], "run_id bigint, key string, value double")
    append_metrics(values, folder)
    spark.createDataFrame(
        [(run_id, k, v) for k, v in (tags or {}).items()], "run_id bigint, key string, value string"
    ).write.mode("append").parquet(f"{folder}/run_tags")


def finite(metrics: DataFrame) -> DataFrame:
    v = _c("value")
    return metrics.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def append_metrics(metrics: DataFrame, folder: str) -> None:
    finite(metrics).write.mode("append").parquet(f"{folder}/run_metrics")
