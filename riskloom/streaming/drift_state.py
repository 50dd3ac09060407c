"""Online drift tests per key with typed state, event-time timers and expiry (ST3).

`drift_monitor` runs Page-Hinkley (against the running mean) and DDM per key in a
`transformWithStateInPandas` processor. Rows of a key are kept in a list state until the
watermark passes them and are then taken in event-time order (ties: prediction, then label), so
the order is that of the events, whatever files or batches they came in; only the rows inside the
watermark delay are ever held, never the whole key of a batch. The statistics are a typed value
state of ten fields. A key that sees no row for `timeout` after its last one has its state
removed by a timer; a later row starts it afresh (the same holds inside one batch: a row more than
`timeout` after the one before restarts the key, so expiry does not depend on batching).

`run_bounded` drives such a stream over a finite input: once all files are read, an end-of-input
marker (a row with a NULL key at the largest timestamp) moves the watermark past every row, the
timers fire, and nothing waits undecided. `drift_batch` is the same computation as a batch job
(windows by key), the twin that SQL checks.

Output rows: key, n, mean_error, page_hinkley (sum minus its running minimum), ph_drift (the
difference passed `threshold` at some row), ddm_level (stable, warning or drift; DDM starts after
30 rows and never returns to stable). The stream emits a row per key each time rows are decided;
the last one per key is its state. Rows with a NULL key, time, label or prediction take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.session import scratch_dir

_c = F.col
OUT = "key string, n long, mean_error double, page_hinkley double, ph_drift boolean, ddm_level string"
STATS = "n long, total double, ph double, low double, wrong long, p_min double, s_min double, hit boolean, level string, last long"
END = "9999-12-31 00:00:00"
#: The watermark of a union follows its latest source (the end marker); typed state lives in RocksDB.
SETTINGS = {
    "spark.sql.streaming.multipleWatermarkPolicy": "max",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def start_stats() -> tuple:
    return (0, 0.0, 0.0, 0.0, 0, float("inf"), float("inf"), False, "stable", None)


def advance(stats: tuple, rows: list[tuple[int, float, float]], delta: float, threshold: float, timeout: int) -> tuple:
    """The statistics after `rows` (time in ms, label, prediction), taken in the order given; a
    row more than `timeout` after the one before starts the key afresh."""
    n, total, ph, low, wrong, p_min, s_min, hit, level, last = stats
    for t, y, p in rows:
        if last is not None and t - last > timeout:
            n, total, ph, low, wrong, p_min, s_min, hit, level, last = start_stats()
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
        last = t if last is None else max(last, t)
    return (n, total, ph, low, wrong, p_min, s_min, hit, level, last)


class DriftProcessor(StatefulProcessor):
    """Page-Hinkley and DDM per key; see the module text."""

    def __init__(self, delta: float, threshold: float, timeout_ms: int):
        self.delta, self.threshold, self.timeout = delta, threshold, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stats = handle.getValueState("stats", STATS)
        self.pending = handle.getListState("pending", "t long, y double, p double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for chunk in rows:
            if len(chunk):
                self.pending.appendList(list(zip(chunk["t_ms"].astype("int64").tolist(), chunk["y_value"].tolist(), chunk["p_value"].tolist())))
                top = int(chunk["t_ms"].max())
                latest = top if latest is None else max(latest, top)
        if latest is not None:
            self.handle.registerTimer(latest)
            self.handle.registerTimer(latest + self.timeout)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.pending.get()) if self.pending.exists() else []
        due = sorted((r for r in waiting if r[0] <= mark), key=lambda r: (r[0], r[2], r[1]))
        stats = self.stats.get() if self.stats.exists() else start_stats()
        if due:
            stats = advance(tuple(stats), due, self.delta, self.threshold, self.timeout)
            self.stats.update(stats)
            rest = [r for r in waiting if r[0] > mark]
            self.pending.put(rest) if rest else self.pending.clear()
            n, total, ph, low, _, _, _, hit, level, _ = stats
            yield pd.DataFrame({"key": [str(key[0])], "n": [n], "mean_error": [total / n], "page_hinkley": [ph - low], "ph_drift": [hit], "ddm_level": [level]})
        elif not waiting and stats[9] is not None and expiredTimerInfo.getExpiryTimeInMs() >= stats[9] + self.timeout:
            self.stats.clear()

    def close(self) -> None:
        pass


def drift_monitor(df: DataFrame, key: str, ts: str, label: str, pred: str, delay: str = "1 hour", delta: float = 0.005, threshold: float = 50.0, timeout_ms: int = 30 * 86_400_000) -> DataFrame:
    """The stream of per-key drift rows (a streaming or batch DataFrame with a timestamp `ts`)."""
    slim = df.select(
        _c(key).alias("group_key"), _c(ts).cast("timestamp").alias(ts), F.unix_millis(_c(ts).cast("timestamp")).alias("t_ms"),
        _c(label).cast("double").alias("y_value"), _c(pred).cast("double").alias("p_value"),
    )
    # one condition that names the event time, so that it is not pushed below the watermark,
    # which must see the end-of-input marker (a row with a NULL key)
    taken = F.when(_c(ts).isNotNull(), F.expr("group_key is not null and y_value is not null and p_value is not null"))
    slim = slim.withWatermark(ts, delay).where(F.coalesce(taken, F.lit(False)))
    return slim.groupBy("group_key").transformWithStateInPandas(DriftProcessor(delta, threshold, timeout_ms), OUT, "Update", "EventTime")


def run_bounded(source: DataFrame, build, ts: str) -> DataFrame:
    """Run `build(stream)` over a finite streaming `source` and then over an end-of-input marker
    (every column NULL, `ts` at the end of time), from one checkpoint; read all emitted rows."""
    spark = source.sparkSession
    base = f"{scratch_dir(spark)}/riskloom/bounded-{uuid.uuid4().hex}"
    marker = spark.createDataFrame([], source.schema)
    marker.write.parquet(f"{base}/end")
    ends = spark.readStream.schema(source.schema).parquet(f"{base}/end")
    keep = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = build(source.unionByName(ends))
        for step in ("data", "end"):
            if step == "end":
                row = {f.name: None for f in source.schema.fields}
                spark.createDataFrame([row], source.schema).withColumn(ts, F.lit(END).cast(source.schema[ts].dataType)).write.mode("append").parquet(f"{base}/end")
            q = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
            q.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def last_rows(emitted: DataFrame) -> DataFrame:
    """The last emitted row of each key (rows only grow, so: the largest n)."""
    return emitted.groupBy("key").agg(F.max_by(F.struct("n", "mean_error", "page_hinkley", "ph_drift", "ddm_level"), "n").alias("s")).select("key", "s.*")


def drift_batch(df: DataFrame, key: str, ts: str, label: str, pred: str, delta: float = 0.005, threshold: float = 50.0, timeout_ms: int = 30 * 86_400_000) -> DataFrame:
    """The same per-key result over a whole table, by running windows in event order over the
    last run of rows of each key without a gap of more than `timeout_ms`."""
    rows = df.select(
        _c(key).cast("string").alias("key"), _c(ts).cast("timestamp").alias("__ts"), _c(label).cast("double").alias("__y"), _c(pred).cast("double").alias("__p"),
    ).where("key is not null and __ts is not null and __y is not null and __p is not null")
    first = Window.partitionBy("key").orderBy("__ts", "__p", "__y")
    gap = F.unix_millis("__ts") - F.unix_millis(F.lag("__ts").over(first)) > timeout_ms
    rows = rows.withColumn("__run", F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__last", F.max("__run").over(Window.partitionBy("key"))).where(_c("__run") == _c("__last"))
    order = Window.partitionBy("key").orderBy("__ts", "__p", "__y")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__e", F.abs(_c("__y") - _c("__p"))).withColumn("__n", F.row_number().over(order))
    rows = rows.withColumn("__total", F.sum("__e").over(upto)).withColumn("__wrong", F.sum(((_c("__p") >= 0.5) != (_c("__y") == 1)).cast("long")).over(upto))
    rows = rows.withColumn("__ph", F.sum(_c("__e") - _c("__total") / _c("__n") - F.lit(delta)).over(upto))
    rows = rows.withColumn("__low", F.least(F.lit(0.0), F.min("__ph").over(upto)))
    rate = _c("__wrong") / _c("__n")
    rows = rows.withColumn("__rs", F.when(_c("__n") > 30, rate + F.sqrt(rate * (1 - rate) / _c("__n")))).withColumn("__s", F.sqrt(rate * (1 - rate) / _c("__n")))
    rows = rows.withColumn("__m", F.min("__rs").over(upto)).withColumn("__sm", F.min_by("__s", F.when(_c("__rs").isNotNull(), F.struct("__rs", "__n"))).over(upto))
    rows = rows.withColumn("__drift", _c("__rs") > _c("__m") + 2 * _c("__sm")).withColumn("__warn", _c("__rs") > _c("__m") + _c("__sm"))
    return rows.groupBy("key").agg(
        F.max("__n").cast("long").alias("n"), (F.max_by("__total", "__n") / F.max("__n")).alias("mean_error"),
        F.max_by(_c("__ph") - _c("__low"), "__n").alias("page_hinkley"), F.max(_c("__ph") - _c("__low") > threshold).alias("ph_drift"),
        F.when(F.max("__drift"), "drift").when(F.max("__warn"), "warning").otherwise("stable").alias("ddm_level"),
    )
