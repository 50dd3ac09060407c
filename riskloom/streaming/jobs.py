"""Structured Streaming forms of scoring, velocity, drift, dedupe, sessions and enrichment.

The operators take a streaming (or batch) DataFrame and return one; `run_to_table` drives a
stream over what is available and reads the result back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.loan import serving_features
from riskloom.operators.pricing import heuristic_score
from riskloom.operators.quality import Rule, scoring_rules, validate
from riskloom.session import scratch_dir

_c = F.col


def file_stream(spark: SparkSession, folder: str, file: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the Parquet files of a folder that match a pattern."""
    schema = spark.read.option("pathGlobFilter", file).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need an instant: local timestamps are read in the session zone."""
    return df.withColumn(ts, _c(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_score(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Validate, add serving features, score; rows with errors keep them and no score."""
    checked = validate(df, rules if rules is not None else scoring_rules())
    scored = heuristic_score(serving_features(checked))
    ok = F.size("errors") == 0
    return scored.withColumns(
        {c: F.when(ok, _c(c)) for c in ("probability", "risk_category")}
    )


def write_split(stream: DataFrame, valid: str, quarantine: str, checkpoint: str) -> None:
    """Valid rows and rows with errors to two tables, one pass per batch; a batch that is
    repeated after a failure overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(F.size("errors") == 0).write.mode("overwrite").parquet(f"{valid}/batch={number}")
        batch.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        batch.unpersist()

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_velocity(
    df: DataFrame, ts: str, keys: Sequence[str], value: str, size: str = "1 day", slide: str | None = None,
    large: float = 100.0, delay: str = "1 day",
) -> DataFrame:
    """Counts, sums and large rows per window; rows later than the delay are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = event_time(df, ts, delay).groupBy(w.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.count(F.when(_c(value) > large, 1)).alias("large_n")
    )
    return out.select(
        _c("w.start").cast("timestamp_ntz").alias("window_start"), _c("w.end").cast("timestamp_ntz").alias("window_end"), *keys, "n", "total", "large_n"
    )


DEDUPE_STATE = "kept_keys array<string>, kept_times array<bigint>, keys array<string>, times array<bigint>, ids array<bigint>"


def stream_dedupe(
    df: DataFrame, ts: str, keys: Sequence[str], row_id: str, within: str = "30 minutes", delay: str = "30 minutes", groups: int = 1 << 14
) -> DataFrame:
    """Drop a row whose key was kept at most `within` before, by event time.

    A row waits until the watermark has passed it, then the waiting rows of its key are taken by
    (time, `row_id`): the result is the same however the rows fall into batches. Keys are dealt to
    `groups` by hash, as a call for each key costs far more than its rows. State of a group: the
    time last kept of each key and the rows inside the delay; a key's expires `within` after its
    last kept row. Rows later than the delay or without a time are dropped. `row_id` is an
    integer; keys are of types that their strings give back.
    """
    span = int(pd.Timedelta(within).total_seconds() * 1e6)

    def step(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept_keys, kept_times, names, times, ids = state.get if state.exists else ([], [], [], [], [])
        kept = dict(zip(kept_keys, kept_times))
        rows = list(zip(times, ids, names))
        if not state.hasTimedOut:
            for new in chunks:
                rows += zip(new["us"].tolist(), new["id"].tolist(), new["key"].tolist())
        mark = state.getCurrentWatermarkMs()
        out, wait = [], []
        for t, i, k in sorted(rows):
            if t // 1000 >= mark:
                wait.append((t, i, k))
            elif k not in kept or t - kept[k] > span:
                kept[k] = t
                out.append((k, t, i))
        waiting = {k for _, _, k in wait}
        kept = {k: t for k, t in kept.items() if k in waiting or (t + span) // 1000 >= mark}
        if wait or kept:
            state.update((list(kept), list(kept.values()), [k for _, _, k in wait], [t for t, _, _ in wait], [i for _, i, _ in wait]))
            due = [t // 1000 for t, _, _ in wait[:1]] + [(t + span) // 1000 + 1 for k, t in kept.items() if k not in waiting]
            state.setTimeoutTimestamp(max(min(due), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "id"])

    timed = event_time(df.where(_c(ts).isNotNull()), ts, delay)
    kinds = {k: timed.schema[k].dataType.simpleString() for k in keys}
    plain = [(_c(k) + F.lit(0).cast(kinds[k]) if kinds[k] in ("float", "double") else _c(k)).cast("string") for k in keys]  # no negative zero
    slim = timed.select(F.to_json(F.array(*plain)).alias("key"), ts, F.unix_micros(ts).alias("us"), _c(row_id).cast("bigint").alias("id"))
    kept_rows = slim.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInPandasWithState(
        step, "key string, us bigint, id bigint", DEDUPE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    values = F.from_json("key", "array<string>")
    return kept_rows.select(
        *[values[j].cast(kinds[k]).alias(k) for j, k in enumerate(keys)], F.timestamp_micros("us").cast("timestamp_ntz").alias(ts), _c("id").alias(row_id)
    )


def stream_sessions(df: DataFrame, ts: str, key: str, value: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of activity per key."""
    out = event_time(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )
    return out.select(
        key, _c("w.start").cast("timestamp_ntz").alias("session_start"), _c("w.end").cast("timestamp_ntz").alias("session_end"), "n", "total"
    )


def stream_enrich(df: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """Left join with a static table of account features."""
    return df.join(static, on, "left")


DRIFT_OUT = "key string, n bigint, mean_error double, page_hinkley double, ph_drift boolean, ddm_level string"
DRIFT_STATE = "n bigint, total double, ph double, ph_min double, wrong bigint, p_min double, s_min double, ph_hit boolean, level string"


def stream_drift(df: DataFrame, key: str, ts: str, label: str, pred: str, delta: float = 0.005, threshold: float = 50.0) -> DataFrame:
    """Online Page-Hinkley (against the running mean) and DDM per key.

    The state of a key is nine numbers. Both tests depend on order, so the rows of one key
    are taken in time order within each batch; a hot source is split by using a finer key.
    """

    def step(key_values: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, ph, low, wrong, p_min, s_min, hit, level = (
            state.get if state.exists else (0, 0.0, 0.0, 0.0, 0, float("inf"), float("inf"), False, "stable")
        )
        rows = pd.concat(list(chunks)).sort_values([ts, pred])
        for y, p in zip(rows[label], rows[pred]):
            err = abs(y - p)
            n += 1
            total += err
            ph += err - total / n - delta
            low = min(low, ph)
            hit = hit or ph - low > threshold
            wrong += int((p >= 0.5) != (y == 1))
            rate = wrong / n
            s = (rate * (1 - rate) / n) ** 0.5
            if n > 30:
                if rate + s < p_min + s_min:
                    p_min, s_min = rate, s
                if rate + s > p_min + 3 * s_min:
                    level = "drift"
                elif rate + s > p_min + 2 * s_min and level == "stable":
                    level = "warning"
        state.update((n, total, ph, low, wrong, p_min, s_min, hit, level))
        yield pd.DataFrame(
            {"key": [str(key_values[0])], "n": [n], "mean_error": [total / n], "page_hinkley": [ph - low], "ph_drift": [hit], "ddm_level": [level]}
        )

    slim = df.select(key, ts, _c(label).cast("double").alias(label), _c(pred).cast("double").alias(pred))
    return slim.groupBy(key).applyInPandasWithState(step, DRIFT_OUT, DRIFT_STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over the available data into a table and read it.

    In update mode every batch appends its changed rows.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/riskloom/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(
            lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
        )
    q.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
