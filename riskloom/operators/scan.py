"""Ordered computations without a single-task window.

A running total over a whole table needs an order over all rows. A window without
`partitionBy` would put them on one task, and a window per key would do the same for a
key that holds a third of the table. Both are avoided in the same way:

1. cut the order column at quantiles of the *whole* table (`cut_points`, one pass with a
   bounded sketch), so that every slice holds about 1/n of all rows, whatever the key;
2. total each (key, slice) with ordinary partial aggregation;
3. turn those totals into offsets: a window per key, over at most one row per slice;
4. run the window inside (key, slice) and add the offset.

There is one path for every size: no row count is taken to choose a plan. NULL and NaN
order values never enter the cut points; NULL rows come first and NaN rows last, in slices
of their own, as in Spark's ascending order.

The cut points are literals of the plan, so a task that is run again after a lost
executor puts every row into the same slice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = "__slice"
# Slice of the rows without an order value: before all others.
NULL_SLICE = -1.0


def slice_count(spark: SparkSession) -> int:
    """Number of slices: one per shuffle partition."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _number(value: str) -> Column:
    return F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))


def cut_points(df: DataFrame, value: str, slices: int | None = None) -> list[float]:
    """Values that cut the rows of `df` into slices of about equal size (repeats are kept)."""
    n = slices or slice_count(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(_number(value), probs, max(1000, 20 * n)).alias("q")).first()
    return sorted(row["q"] or [])


def with_slice(df: DataFrame, value: str, cuts: Sequence[float], out: str = SLICE) -> DataFrame:
    """Add the slice number of `value`: bisection over the cut points, in the JVM."""
    edges = sorted(set(cuts))
    if not edges:
        return df.withColumn(out, F.when(F.col(value).isNull(), NULL_SLICE).when(F.isnan(F.col(value).cast("double")), 1.0).otherwise(0.0))
    key = f"{out}_key"
    cutter = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol=key, outputCol=out, handleInvalid="keep"
    )
    placed = cutter.transform(df.withColumn(key, F.col(value).cast("double"))).drop(key)
    return placed.withColumn(out, F.when(F.col(value).isNull(), NULL_SLICE).otherwise(F.col(out)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _attach(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        # One row per slice.
        return rows.join(F.broadcast(offsets), SLICE)
    return join_null_safe(rows, offsets, [*by, SLICE])


def running_sums(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
    tie: Sequence[str] = (),
    next_as: str | None = None,
) -> DataFrame:
    """Add `<s>_run` (inclusive running sum along `order`) and `<s>_all` (total) per `by`, and
    with `next_as` the next row's `order` value (NULL on the last row).

    Rows should be unique per (by, order, tie). Heavy values of `order` should be
    grouped first; `row_ranks` handles rows that cannot be grouped.
    """
    cuts = cut_points(df, order) if cuts is None else cuts
    rows = with_slice(df, order, cuts)
    firsts = [F.min(order).alias("__first")] if next_as else []
    totals = rows.groupBy(*by, SLICE).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums], *firsts)
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by,
        SLICE,
        *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(whole).alias(f"{s}_all") for s in sums],
        *([F.lead("__first").over(Window.partitionBy(*by).orderBy(SLICE)).alias("__after")] if next_as else []),
    )
    inside = (
        Window.partitionBy(*by, SLICE).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    lead = F.lead(order).over(Window.partitionBy(*by, SLICE).orderBy(order, *tie))
    local = rows.select(
        "*", *[F.sum(s).over(inside).alias(f"__l_{s}") for s in sums], *([lead.alias("__lead")] if next_as else [])
    )
    out = _attach(local, offsets, by)
    return out.select(
        *df.columns,
        *[(F.col(f"__l_{s}") + F.col(f"__o_{s}")).alias(f"{s}_run") for s in sums],
        *[f"{s}_all" for s in sums],
        *([F.coalesce("__lead", "__after").alias(next_as)] if next_as else []),
    )


def running_min(
    df: DataFrame,
    order: str,
    value: Column,
    out: str,
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
    largest: bool = False,
) -> DataFrame:
    """Add the inclusive running minimum (or maximum) of `value`, any orderable type; rows
    with equal `order` see each other."""
    pick, join = (F.max, F.greatest) if largest else (F.min, F.least)
    cuts = cut_points(df, order) if cuts is None else cuts
    rows = with_slice(df.withColumn("__v", value), order, cuts)
    lows = rows.groupBy(*by, SLICE).agg(pick("__v").alias("__low"))
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lows.select(*by, SLICE, pick("__low").over(before).alias("__floor"))
    inside = Window.partitionBy(*by, SLICE).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__m", pick("__v").over(inside))
    return _attach(local, offsets, by).select(*df.columns, join("__m", "__floor").alias(out))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, rank) table: ranks from 1, equal values share their mean rank."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    run = running_sums(counts, value, ["__c"], cuts=cut_points(df, value))
    return run.select(value, (F.col("__c_run") - (F.col("__c") - 1) / 2).alias(out))


def row_ranks(df: DataFrame, order: str, tie: str, out: str, descending: bool = False) -> DataFrame:
    """Number the rows from 1 by (`order`, `tie`) over the whole table.

    `order` and `tie` are numeric, `tie` unique among equal `order` values. A value that
    repeats k times among the cut points fills k slices or more; it gets a slice of its own,
    cut again into k + 1 pieces by `tie`, and so does NULL. There are thus at most 4n pieces.
    """
    n = slice_count(df.sparkSession)
    first = cut_points(df, order, n)
    missing = df.agg(F.avg(F.col(order).isNull().cast("double"))).first()[0] or 0.0
    repeats = {v: k for v, k in Counter(first).items() if k > 1}
    if missing > 0:
        repeats[None] = int(missing * n) + 1
    sign = F.lit(-1.0) if descending else F.lit(1.0)
    rows = with_slice(df, order, first).withColumn("__part", F.lit(1))
    if repeats:
        rows = with_slice(rows, tie, cut_points(df, tie, n), out="__sub")
        # At most one row per cut point.
        heavy = df.sparkSession.createDataFrame([(v, k + 1) for v, k in repeats.items()], "__heavy double, __pieces int")
        rows = rows.join(F.broadcast(heavy), F.col(order).cast("double").eqNullSafe(F.col("__heavy")), "left")
        # A heavy value is the lower edge of its slice: in ascending order it comes first.
        rows = rows.withColumn("__part", F.when(F.col("__pieces").isNull(), 1).otherwise(0))
        rows = rows.withColumn("__sub", F.when(F.col("__part") == 0, F.floor(F.col("__sub") * F.col("__pieces") / n)).otherwise(0))
    else:
        rows = rows.withColumn("__sub", F.lit(0))
    cells = [SLICE, "__part", "__sub"]
    sizes = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.col(SLICE) * sign, F.col("__part") * sign, "__sub").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(*cells, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    key = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*cells).orderBy(key, tie)
    numbered = rows.withColumn("__k", F.row_number().over(inside))
    # At most 4n rows.
    return numbered.join(F.broadcast(starts), cells).select(
        *df.columns, (F.col("__k") + F.col("__start")).cast("bigint").alias(out)
    )


def melt(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Columns to rows, as doubles; NaN becomes NULL."""
    pairs = [F.struct(F.lit(c).alias(name), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(value)) for c in cols]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("__p")).select(*keep, f"__p.{name}", f"__p.{value}")


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per `by` group.

    `percentile` keeps every distinct value of a group in one task's memory; this counts
    distinct values, takes running counts by slices and picks the rows at the wanted
    positions with a partial aggregate.
    """
    names = names or [f"q{round(p * 100)}" for p in probs]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    run = running_sums(counts, value, ["__c"], by=by, cuts=cut_points(df, value) if cuts is None else cuts)
    aggs = []
    for p, name in zip(probs, names):
        pos = (F.col("__c_all") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        start = F.col("__c_run") - F.col("__c")

        def at(k: Column) -> Column:
            return F.max(F.when((start <= k) & (k < F.col("__c_run")), F.col(value).cast("double")))

        aggs += [at(lo).alias(f"__lo_{name}"), at(hi).alias(f"__hi_{name}"), F.max(pos - lo).alias(f"__w_{name}")]
    picked = run.groupBy(*by).agg(*aggs)
    return picked.select(
        *by,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n)
            for n in names
        ],
    )


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns as Python numbers: one small row per column."""
    long = melt(df, [], cols)
    names = [f"q{i}" for i in range(len(probs))]
    rows = quantiles(long, "value", probs, by=["feature"], names=names).collect()
    found = {r["feature"]: [r[n] for n in names] for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in cols}
