"""Streams give the same rows however the input falls into batches."""

import datetime as dt
import random

import pytest

from riskloom.streaming import jobs as J

START = dt.datetime(2024, 1, 1)


def rows():
    rnd = random.Random(7)
    data = [(i, START + dt.timedelta(minutes=rnd.randint(0, 600)), "hot" if i % 3 == 0 else f"k{i % 9}") for i in range(300)]
    data += [(300, START + dt.timedelta(minutes=30), None), (301, START + dt.timedelta(minutes=60), None)]
    # Close to time order: later files hold rows a few minutes older than those before.
    return sorted(data, key=lambda d: d[1] + dt.timedelta(minutes=rnd.randint(-8, 8)))


def kept(data, minutes=30):
    mark = max(d[1] for d in data) - dt.timedelta(minutes=minutes)
    last, out = {}, set()
    for i, ts, k in sorted(data, key=lambda d: (d[1], d[0])):
        if ts < mark and (k not in last or ts - last[k] > dt.timedelta(minutes=minutes)):
            last[k] = ts
            out.add(i)
    return out


@pytest.mark.parametrize("files, per_batch", [(1, None), (2, 1), (8, 1), (8, 3)])
def test_dedupe_by_event_time(spark, tmp_path, files, per_batch):
    data = rows()
    size = -(-len(data) // files)
    for f in range(files):
        part = spark.createDataFrame(data[f * size : (f + 1) * size], "id bigint, ts timestamp_ntz, k string")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.file_stream(spark, str(tmp_path / "in"), "*.parquet", per_batch)
    got = [r.id for r in J.run_to_table(J.stream_dedupe(stream, "ts", ["k"], "id")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == kept(data)


@pytest.mark.parametrize("groups", [1, 3])
def test_dedupe_with_many_keys_in_a_group(spark, tmp_path, groups):
    """Keys of several types, also null ones, that share a call and its state."""
    rnd = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    keys = [(None, "a", 0.0), (None, None, 0.0), (1 << 60, "a", 0.5), ((1 << 60) + 1, "a", 0.5), (3, '["x', None), (3, "", 2.5)]
    data = [(i, start + dt.timedelta(minutes=rnd.randint(0, 600), microseconds=rnd.randint(0, 9)), *rnd.choice(keys)) for i in range(400)]
    data.sort(key=lambda r: r[1])
    for f in range(4):
        part = spark.createDataFrame(data[f * 100 : (f + 1) * 100], "id bigint, ts timestamp_ntz, a bigint, b string, c double")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.file_stream(spark, str(tmp_path / "in"), "*.parquet", 4)
    got = J.run_to_table(J.stream_dedupe(stream, "ts", ["a", "b", "c"], "id", groups=groups))
    assert got.schema.simpleString() == "struct<a:bigint,b:string,c:double,ts:timestamp_ntz,id:bigint>"
    last = max(r[1] for r in data) - dt.timedelta(minutes=30)
    want = set()
    for key in keys:
        before = None
        for i, t, *_ in sorted((r for r in data if r[2:] == key), key=lambda r: (r[1], r[0])):
            ms = dt.timedelta(milliseconds=1)
            if (t - start) // ms < (last - start) // ms and (before is None or t - before > dt.timedelta(minutes=30)):
                before = t
                want.add((*key, t, i))
    assert len(want) > 50 and got.count() == len(want) and {tuple(r) for r in got.collect()} == want


def _drift_rows(spark, folder):
    from pyspark.sql import functions as F

    return spark.read.parquet(f"{folder}/events.parquet").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5 == 0).cast("int").alias("label"), (F.col("event_id") % 7 / 7.0).alias("pred")
    )


@pytest.mark.parametrize("files", [1, 2, 5])
def test_drift_stream_equals_its_batch_twin(spark, tmp_path, files):
    from pyspark.sql import functions as F

    from riskloom.streaming import drift_state as D
    from riskloom.streaming.jobs import file_stream

    rows = _drift_rows(spark, "/root/testdata/sf0.001")
    cuts = list(rows.select(F.percentile_approx(F.unix_micros("ts"), [i / files for i in range(1, files)])).first()[0]) if files > 1 else []
    edges = [None, *cuts, None]
    for i in range(files):
        part = rows
        if edges[i] is not None:
            part = part.where(F.unix_micros("ts") > edges[i])
        if edges[i + 1] is not None:
            part = part.where(F.unix_micros("ts") <= edges[i + 1])
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            f.rename(tmp_path / "in" / f"part{i}.parquet")
    source = file_stream(spark, str(tmp_path / "in"), "part*.parquet", files_per_batch=1)
    got = D.last_rows(D.run_bounded(source, lambda s: D.drift_monitor(s, "user_id", "ts", "label", "pred", threshold=5.0), "ts")).collect()
    want = D.drift_batch(rows, "user_id", "ts", "label", "pred", threshold=5.0).collect()
    key = lambda r: r.key
    assert len(got) == len(want) > 0
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (g.key, g.n, g.ph_drift, g.ddm_level) == (w.key, w.n, w.ph_drift, w.ddm_level)
        assert g.mean_error == pytest.approx(w.mean_error, abs=1e-12) and g.page_hinkley == pytest.approx(w.page_hinkley, abs=1e-9)


def test_drift_state_expires(spark, tmp_path):
    import datetime as dt

    from riskloom.streaming import drift_state as D
    from riskloom.streaming.jobs import file_stream

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=i), 1, 0.9) for i in range(40)] + [("a", t0 + dt.timedelta(days=40, minutes=i), 0, 0.2) for i in range(3)]
    rows += [("b", t0 + dt.timedelta(days=i), 1, 0.4) for i in range(0, 50, 10)] + [(None, t0, 1, 0.5), ("c", None, 1, 0.5), ("c", t0, None, 0.5)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, label int, pred double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = file_stream(spark, f"{tmp_path}/in", "*.parquet")
    got = {r.key: r for r in D.last_rows(D.run_bounded(source, lambda s: D.drift_monitor(s, "user_id", "ts", "label", "pred", timeout_ms=30 * 86_400_000), "ts")).collect()}
    assert got["a"].n == 3 and got["a"].mean_error == pytest.approx(0.2)
    assert got["b"].n == 5 and "c" not in got and set(got) == {"a", "b"}


def test_drift_batch_of_nothing(spark):
    from riskloom.streaming import drift_state as D

    empty = spark.createDataFrame([], "user_id long, ts timestamp, label int, pred double")
    assert D.drift_batch(empty, "user_id", "ts", "label", "pred").count() == 0
