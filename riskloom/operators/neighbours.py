"""k nearest neighbours by random projections (locality-sensitive hashing), for SMOTE.

Each of `tables` hash tables keys a row by `width`-wide cells of `projections` random directions
(E2LSH). A bucket with more than `max_bucket` rows is cut again by one further random direction at
half the width, level by level; what is still too large after `levels` levels (rows nearly equal
to each other) is cut by a hash of the key into parts of `max_bucket` rows. Inside a final bucket
all pairs are measured (at most `max_bucket` - 1 a row and table), and the k nearest of each row
over all tables are kept by an aggregate of (distance, key) structs. No bucket, however hot, is
one task or one group of more than `max_bucket` rows; the work is at most rows x tables x
max_bucket distances.

Distances are Euclidean on the columns as given (scale them first). Rows with a NULL key or a
NULL or NaN column take no part. Ties are broken by the smaller key. Result: key, `neighbours`
array<struct<distance double, key>> sorted by distance, at most k long (a row alone in all its
buckets has an empty list). Keys are meant to be unique; a repeated key is one point per row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

_c = F.col


def _projection(cols: Sequence[str], direction: np.ndarray, offset: float, width: float) -> Column:
    dot = F.lit(float(offset))
    for c, a in zip(cols, direction):
        dot = dot + F.lit(float(a)) * _c(c).cast("double")
    return F.floor(dot / F.lit(width)).cast("long")


def nearest_neighbours(
    df: DataFrame, key: str, cols: Sequence[str], k: int = 5, tables: int = 4, projections: int = 2,
    width: float = 1.0, max_bucket: int = 64, levels: int = 8, seed: int = 7,
) -> DataFrame:
    rng = np.random.default_rng(seed)
    full = _c(key).isNotNull()
    for c in cols:
        full &= _c(c).isNotNull() & ~F.isnan(_c(c).cast("double"))
    rows = df.where(full).select(_c(key).alias("__k"), *[_c(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)])
    xs = [f"__x{i}" for i in range(len(cols))]
    keyed = []
    for t in range(tables):
        parts = [_projection(xs, rng.normal(size=len(cols)), rng.uniform(0, width), width) for _ in range(projections)]
        keyed.append(rows.select("*", F.lit(t).alias("__t"), F.array(*parts).alias("__b")))
    b = keyed[0]
    for more in keyed[1:]:
        b = b.unionByName(more)
    for level in range(levels + 1):
        sizes = b.groupBy("__t", "__b").agg(F.count(F.lit(1)).alias("__n")).where(_c("__n") > max_bucket)
        if sizes.limit(1).count() == 0:
            break
        w = width / 2 ** (level + 1)
        extra = _projection(xs, rng.normal(size=len(cols)), rng.uniform(0, w), w) if level < levels else F.pmod(F.xxhash64("__k", F.lit(seed)), F.ceil(_c("__n") / max_bucket)).cast("long")
        b = b.join(sizes, ["__t", "__b"], "left").select(*[c for c in b.columns if c != "__b"], F.when(_c("__n").isNotNull(), F.concat("__b", F.array(extra))).otherwise(_c("__b")).alias("__b"))
        b = cut_lineage(b)
    left = b.select("__t", "__b", "__k", F.array(*xs).alias("__v"))
    right = left.select("__t", "__b", _c("__k").alias("__o"), _c("__v").alias("__ov"))
    dist = F.sqrt(F.aggregate(F.zip_with("__v", "__ov", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))
    pairs = left.join(right, ["__t", "__b"]).where(_c("__k") != _c("__o")).select("__k", F.struct(dist.alias("distance"), _c("__o").alias("key")).alias("__p"))
    best = pairs.groupBy("__k").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list("__p"))), 1, k).alias("neighbours"))
    return rows.select("__k").join(best, "__k", "left").select(
        _c("__k").alias(key), F.coalesce("neighbours", F.array().cast(best.schema["neighbours"].dataType)).alias("neighbours")
    )
