"""Operator 12 against a plain scan of all rows: every row of the result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import imi
from riskloom.llm.imi import cell_order, hard_negatives

DATA = "/root/testdata/check_h/embeddings.parquet"


def plain(rows, every=100):
    ok = [(v, (l + 1) % 10 if v % 7 == 0 else l, np.floor(256 * np.array(e, dtype=np.float64)).astype(np.int64))
          for v, e, l in rows if v is not None and l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, (a, al, aq) in enumerate(ok):
        if a % every:
            continue
        sc = [(int(aq @ q), v, l) for j, (v, l, q) in enumerate(ok) if j != i]
        pos = sorted([(-s, v) for s, v, l in sc if l == al])[:5]
        for ps, p in pos:
            ps = -ps
            negs = sorted([(-s, v) for s, v, l in sc if l != al and 30 * ps <= 100 * s <= 90 * ps])[:10]
            out += [(a, p, r + 1, v, ps, -s) for r, (s, v) in enumerate(negs)]
    return sorted(out)


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.read.parquet(DATA).where("vec_id < 3000")
    return [(r.vec_id, list(r.embedding), r.label) for r in df.orderBy("vec_id").collect()]


def test_against_plain(spark, sample):
    odd = [(90000, None, 1), (90100, [float("inf")] * 64, 1), (90200, [0.1] * 64, None), (None, [0.1] * 64, 1), (90300, sample[5][1], sample[5][2]), (90300, sample[5][1], sample[5][2]), (90400, [0.2] * 64, 3)]
    rows = sample + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)).withColumn("__rid", F.lit(2))
    got = sorted(tuple(r) for r in hard_negatives(df, rows_per_cell=8).collect())
    assert got == plain([(v, None if e is None else [float(x) for x in np.array(e, dtype=np.float32)], l) for v, e, l in rows])
    assert len(got) > 100


def test_heap_order():
    u1, u2 = np.array([3.0, 1.0, 2.0]), np.array([0.5, 2.5, 1.0])
    order = list(cell_order(u1, u2, set(range(9)), 3))
    bounds = [b for _, b in order]
    assert bounds == sorted(bounds, reverse=True) and len(order) == 9
    assert [c for c, _ in cell_order(u1, u2, {4, 2}, 3)] == [2, 4]


def test_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives(spark.createDataFrame([(100, [1.0, 2.0], 1)], schema)).count() == 0


def vectors(n, scale=1.0, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x[: n // 3] = x[0]  # one cell of many copies
    x[n // 3 : n // 2] = x[n // 3] + 0.05 * x[n // 3 : n // 2]
    return [(i, [float(v) for v in np.float32(scale * x[i])], i % 3) for i in range(n)]


def negatives_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in hard_negatives(df, every=20, **kw).collect())


@pytest.mark.parametrize("scale", [1.0, 40.0, 1e4])
def test_shelves_and_groups(spark, scale):
    """Parts of a large code, several codes a shelf, several groups of anchors, vectors of every width."""
    rows = vectors(900, scale)
    got = negatives_of(spark, rows, rows_per_cell=8, block_rows=50, shelf_rows=100, group_anchors=10)
    assert got == plain(rows, every=20) and len(got) > 100


def test_shelves():
    got = imi.shelves({0: 5, 1: 4, 2: 25, 3: 1, 4: 10}, 10)
    assert {c: list(x) for c, x in got.items()} == {0: [0], 1: [0], 2: [1, 2, 3], 3: [4], 4: [5]}


def test_sample_is_of_smallest_hash(spark):
    """However many rows lie below a hash: the first in order of hash and row."""
    rows = spark.createDataFrame([(i // 50 if i < 600 else i, [i // 50 if i < 600 else i], i) for i in range(900)], "vec_id long, q array<long>, __rid long")
    want = rows.orderBy(F.xxhash64("vec_id", "q"), "__rid").collect()
    for size in (1, 7, 200, 899, 2000):
        assert [list(q) for q in imi.sampled(rows, size)] == [r.q for r in want[:size]]


def test_driver_gets_no_rows_of_every_task(spark, monkeypatch):
    """No sorted rows are collected from every task, and neither rows nor anchors are broadcast."""
    rows, kind, plans = vectors(400), type(spark.range(1)), []

    def told(f):
        def run(df, *a, **b):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return f(df, *a, **b)

        return run

    for name in ("collect", "toArrow", "toPandas"):
        monkeypatch.setattr(kind, name, told(getattr(kind, name)))
    collected = negatives_of(spark, rows) and list(plans)
    assert collected and not any("TakeOrderedAndProject" in p for p in collected)
    plans.clear()
    monkeypatch.setattr(imi, "cut_lineage", told(imi.cut_lineage))
    assert negatives_of(spark, rows) == plain(rows, every=20)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
