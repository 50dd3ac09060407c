"""Distributed scans against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import scan as S


def rows(n=400, seed=1):
    rnd = random.Random(seed)
    # A third of the rows share one group and one value.
    return [("hot" if i % 3 == 0 else f"g{i % 7}", 5.0 if i % 3 == 1 else rnd.choice([0.5, 1.5, rnd.random() * 10]), i) for i in range(n)]


def test_running_sums_equal_a_loop(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, i bigint")
    per = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r.g, r.v): (r.n_run, r.n_all, r.nxt) for r in S.running_sums(per, "v", ["n"], by=["g"], next_as="nxt").collect()}
    for g in {d[0] for d in data}:
        values = sorted({d[1] for d in data if d[0] == g})
        seen = 0
        for k, v in enumerate(values):
            seen += sum(1 for d in data if d[0] == g and d[1] == v)
            nxt = values[k + 1] if k + 1 < len(values) else None
            assert got[(g, v)] == (seen, sum(1 for d in data if d[0] == g), nxt)


def test_quantiles_interpolate(spark):
    import numpy as np

    data = rows()
    got = {r.g: r.q90 for r in S.quantiles(spark.createDataFrame(data, "g string, v double, i bigint"), "v", [0.9], by=["g"]).collect()}
    for g, q in got.items():
        assert q == pytest.approx(float(np.quantile([d[1] for d in data if d[0] == g], 0.9)))


@pytest.mark.parametrize("descending", [False, True])
def test_row_ranks_with_a_heavy_value(spark, descending):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, i bigint")
    got = {r.i: r.k for r in S.row_ranks(df, "v", "i", "k", descending=descending).collect()}
    order = sorted(data, key=lambda d: ((-d[1] if descending else d[1]), d[2]))
    assert got == {d[2]: k + 1 for k, d in enumerate(order)}


@pytest.mark.parametrize("descending", [False, True])
def test_row_ranks_with_many_heavy_values_nulls_and_nans(spark, descending):
    rnd = random.Random(5)
    data = [(rnd.choice([None, float("nan"), *[k / 100 for k in range(100)]]) if i % 3 else None, i) for i in range(3000)]
    df = spark.createDataFrame(data, "v double, i bigint").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r.i: r.k for r in S.row_ranks(df, "v", "i", "k", descending=descending).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

    def place(d):  # NULL first and NaN last, turned round when descending
        rank = (0, 0.0) if d[0] is None else (2, 0.0) if d[0] != d[0] else (1, d[0])
        return (*[-x if descending else x for x in rank], d[1])

    assert got == {d[1]: k + 1 for k, d in enumerate(sorted(data, key=place))}


def test_running_min_of_structs(spark):
    rnd = random.Random(3)
    data = [(i, rnd.randint(0, 50)) for i in range(200)]
    df = spark.createDataFrame(data, "i bigint, x int")
    out = S.running_min(df, "i", F.struct("x", "i"), "m").orderBy("i").collect()
    best = None
    for r in out:
        here = (r.x, r.i)
        best = here if best is None or here < best else best
        assert (r.m.x, r.m.i) == best


def test_null_keys_are_kept(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert sorted((r.v, r.w) for r in S.join_null_safe(a, b, ["k"]).collect()) == [(1, 10), (2, 20)]
