"""Operator 13 against all pairs: links never below the threshold, recall of the index, and
components and counts exactly where all links are found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.pivots import near_duplicates

DATA = "/root/testdata/check_s/embeddings.parquet"


def brute(rows, threshold=0.9):
    ids = [r[0] for r in rows]
    ok = [i for i, (v, e) in enumerate(rows) if v is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)]
    dims = {len(rows[i][1]) for i in ok}
    assert len(dims) <= 1
    y = np.array([rows[i][1] for i in ok], dtype=np.float64).reshape(len(ok), -1)
    y /= np.linalg.norm(y, axis=1, keepdims=True) if len(ok) else 1
    s = y @ y.T
    np.fill_diagonal(s, -2)
    link = s >= threshold
    n = np.zeros(len(rows), dtype=int)
    n[ok] = link.sum(1)
    par = list(range(len(rows)))

    def f(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in zip(*np.nonzero(link)):
        ra, rb = f(ok[a]), f(ok[b])
        par[max(ra, rb)] = min(ra, rb)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[f(i)] = min(least.get(f(i), ids[i]), ids[i])
    return [(ids[i], int(n[i]), least.get(f(i), ids[i])) for i in range(len(rows))]


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.read.parquet(DATA).where("vec_id < 4000")
    return [(r.vec_id, list(r.embedding)) for r in df.orderBy("vec_id").collect()]


def test_against_all_pairs(spark, sample):
    odd = [(90001, None), (90002, [0.0] * 64), (90003, [float("nan")] + [1.0] * 63), (90004, [None] + [1.0] * 63), (None, [1.0] * 64), (90005, [1.0] * 64), (90005, [1.0] * 64), (90006, [2.0] * 64)]
    rows = sample + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("n_links", F.lit(7)).withColumn("__unit", F.lit(1))
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in near_duplicates(df, rows_per_pivot=32).collect())
    want = sorted((v if v is not None else -1, n, c if c is not None else -1, v == c if v is not None else True) for v, n, c in brute([(v, None if e is None else [float(x) if x is not None else None for x in np.array(e, dtype=object)]) for v, e in rows]))
    linked = sum(w[1] for w in want)
    assert linked > 1000
    found = sum(g[1] for g in got)
    assert found <= linked and found / linked >= 0.9
    assert sum(g == w for g, w in zip(got, want)) / len(want) >= 0.97
    assert {g[0]: g for g in got}[90006][1:3] == (2, 90005)


def test_empty_and_lone(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_duplicates(spark.createDataFrame([(1, None), (2, [1.0, 0.0])], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]
