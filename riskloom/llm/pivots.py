"""Embedding near-duplicates through a pivot-permutation index (operator 13).

Every usable vector is described by the ordered list of its `prefix` nearest reference points
(pivots, by cosine). Vectors whose two nearest pivots agree are put under the first of them in
id order (the leader); a member within half the link angle of its leader joins the leader's unit,
and by the triangle inequality on the sphere all members of a unit are linked to each other. Units
are indexed in inverted lists, one per pivot of their prefix; inside a list, leaders that share
at least `min_shared` pivots are compared exactly, and a pair is taken up only in the list of its
smallest shared pivot, so no pair is found twice and no candidate rows are written. Two units are
linked completely when their leaders' angle plus both radii stays within the link angle, not at
all when even the closest members would be too far, and otherwise member by member. A group of
thousands of near copies is then one unit: its links are counted, not listed.

Sizes: the number of pivots is ceil(usable vectors / `rows_per_pivot`), at most `max_pivots`
(their broadcast is at most max_pivots x dimension x 8 bytes). A long list is cut into blocks of
`block` units by a hash, and block pairs are compared in tasks of their own, so no task holds more
than two blocks. Pivots are a bounded sample: the usable vectors of smallest hash.

Result, one row per input row: vec_id, n_links (other rows linked directly, cosine >= `threshold`
in double precision), component_id (smallest vec_id reachable by links, itself included), kept
(vec_id = component_id). Rows whose vector is null, zero, of another length than the pivots, or
holds a null or non-finite component, and rows with a null vec_id, link with nothing (n_links 0,
component_id their vec_id, kept true). Repeated rows are vectors of their own (two equal rows link).
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

_c = F.col
EPS = 1e-9


def usable(emb: DataFrame) -> DataFrame:
    """__rid, vec_id, __y (unit vector in double precision) or null where the row takes no part."""
    e = _c("embedding")
    ok = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.when(ok & (norm > 0) & _c("vec_id").isNotNull(), F.transform(e, lambda x: x.cast("double") / norm))
    return emb.select(F.monotonically_increasing_id().alias("__rid"), "vec_id", unit.alias("__y"))


def _prefixes(pivots: np.ndarray, prefix: int) -> callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 1024):
                g = f.iloc[lo : lo + 1024]
                y = np.stack(g["__y"].to_numpy())
                order = np.argsort(-(y @ pivots.T), axis=1, kind="stable")[:, :prefix]
                yield pd.DataFrame({"__rid": g["__rid"].to_numpy(), "__prefix": list(order.astype(np.int32))})

    return run


def _linked_units(threshold: float, min_shared: int) -> callable:
    """Compare the leaders of one block pair of one pivot list."""
    theta = math.acos(threshold)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        pivot, b1, b2 = (int(k) for k in key)
        f = f.drop_duplicates("__unit")
        y = np.stack(f["__y"].to_numpy())
        rad = f["__radius"].to_numpy()
        blk, unit = f["__block"].to_numpy(), f["__unit"].to_numpy()
        pre = [set(p.tolist()) for p in f["__prefix"]]
        cos = np.clip(y @ y.T, -1.0, 1.0)
        ang = np.arccos(cos)
        i, j = np.nonzero((ang - rad[:, None] - rad[None, :] <= theta + EPS) & (unit[:, None] < unit[None, :]) & (((blk[:, None] == b1) & (blk[None, :] == b2)) | ((blk[:, None] == b2) & (blk[None, :] == b1))))
        rows = []
        for a, b in zip(i, j):
            shared = pre[a] & pre[b]
            if len(shared) >= min_shared and min(shared) == pivot:
                full = ang[a, b] + rad[a] + rad[b] <= theta - EPS
                rows.append((int(unit[a]), int(unit[b]), bool(full), len(shared)))
        return pd.DataFrame(rows, columns=["__a", "__b", "__full", "__shared"])

    return run


def near_duplicates(emb: DataFrame, threshold: float = 0.9, rows_per_pivot: int = 64, max_pivots: int = 4096, prefix: int = 4, min_shared: int = 1, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept: see the module text."""
    spark = emb.sparkSession
    rows = cut_lineage(usable(emb))
    good = rows.where(_c("__y").isNotNull())
    n = good.count()
    pivots = good.orderBy(F.xxhash64("__y", "vec_id"), "__rid").limit(max(1, min(max_pivots, math.ceil(n / rows_per_pivot)))).select("__y").collect()
    piv = np.array([r[0] for r in pivots], dtype=np.float64).reshape(len(pivots), -1) if pivots else np.zeros((0, 0))
    dim = piv.shape[1]
    good = good.where(F.size("__y") == dim)
    half = math.cos(math.acos(threshold) / 2) + EPS

    placed = good.select("__rid", "__y").mapInPandas(_prefixes(piv, prefix), "__rid long, __prefix array<int>") if len(pivots) else spark.createDataFrame([], "__rid long, __prefix array<int>")
    members = good.join(placed, "__rid").withColumn("__key", F.slice("__prefix", 1, 2))
    leaders = members.groupBy("__key").agg(F.min_by(F.struct("__rid", "__y"), F.struct("vec_id", "__rid")).alias("__lead"))
    dot = F.aggregate(F.zip_with("__y", "__lead.__y", lambda x, z: x * z), F.lit(0.0), lambda a, x: a + x)
    members = members.join(leaders, "__key").select(
        "__rid", "vec_id", "__y", "__prefix", F.when(dot >= half, _c("__lead.__rid")).otherwise(_c("__rid")).alias("__unit"), F.when(dot >= half, dot).otherwise(F.lit(1.0)).alias("__cos")
    )
    members = cut_lineage(members)
    units = members.groupBy("__unit").agg(F.count(F.lit(1)).alias("__size"), F.min("vec_id").alias("__least"), F.max(F.acos(F.least(_c("__cos"), F.lit(1.0)))).alias("__radius"))
    units = cut_lineage(units.join(members.select(_c("__rid").alias("__unit"), "__y", "__prefix"), "__unit"))

    lists = units.select("__unit", "__y", "__radius", "__prefix", F.explode(F.slice("__prefix", 1, prefix)).alias("__pivot"))
    sizes = lists.groupBy("__pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__blocks"))
    lists = lists.join(F.broadcast(sizes), "__pivot").withColumn("__block", F.pmod(F.xxhash64("__unit"), _c("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), _c("__blocks") - 1))
    paired = lists.select("*", other.alias("__other")).select(
        "__pivot", "__unit", "__y", "__radius", "__prefix", "__block", F.least("__block", "__other").alias("__b1"), F.greatest("__block", "__other").alias("__b2")
    )
    found = paired.groupBy("__pivot", "__b1", "__b2").applyInPandas(_linked_units(threshold, min_shared), "__a long, __b long, __full boolean, __shared int")
    found = cut_lineage(found)

    part = found.where(~_c("__full")).select("__a", "__b")
    ma = members.select(_c("__unit").alias("__a"), _c("__rid").alias("__ra"), _c("__y").alias("__ya"))
    mb = members.select(_c("__unit").alias("__b"), _c("__rid").alias("__rb"), _c("__y").alias("__yb"))
    dot2 = F.aggregate(F.zip_with("__ya", "__yb", lambda x, z: x * z), F.lit(0.0), lambda a, x: a + x)
    exact = part.join(ma, "__a").join(mb, "__b").where(dot2 >= threshold).select("__a", "__b", "__ra", "__rb")
    exact = cut_lineage(exact)

    size_of = units.select("__unit", "__size")
    full = found.where("__full").select("__a", "__b")
    full_both = full.select(_c("__a").alias("__unit"), _c("__b").alias("__o")).unionByName(full.select(_c("__b").alias("__unit"), _c("__a").alias("__o")))
    from_full = full_both.join(size_of.withColumnRenamed("__unit", "__o").withColumnRenamed("__size", "__osize"), "__o").groupBy("__unit").agg(F.sum("__osize").alias("__from_full"))
    from_exact = exact.select(_c("__ra").alias("__rid")).unionAll(exact.select(_c("__rb").alias("__rid"))).groupBy("__rid").agg(F.count(F.lit(1)).alias("__from_exact"))

    edges = full.unionByName(exact.select("__a", "__b")).distinct()
    comp = components(edges, units.select("__unit", "__least"))
    out = (
        members.select("__rid", "__unit")
        .join(size_of, "__unit")
        .join(from_full, "__unit", "left")
        .join(from_exact, "__rid", "left")
        .join(comp, "__unit", "left")
        .select("__rid", (_c("__size") - 1 + F.coalesce("__from_full", F.lit(0)) + F.coalesce("__from_exact", F.lit(0))).cast("long").alias("n_links"), "__component")
    )
    res = rows.join(out, "__rid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("__component", "vec_id").cast("long").alias("component_id")
    )
    return res.withColumn("kept", F.coalesce(_c("vec_id") == _c("component_id"), F.lit(True)))


def components(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(__unit, __component): the least `__least` of each connected part of the unit graph, for
    every unit (a unit without edges is a part of its own). Minimum labels spread over the edges,
    then each label jumps to its label's label; rounds end when no label moves."""
    both = edges.select(_c("__a").alias("__u"), _c("__b").alias("__v")).unionByName(edges.select(_c("__b").alias("__u"), _c("__a").alias("__v")))
    both = cut_lineage(both)
    lab = cut_lineage(both.select(_c("__u").alias("__unit")).distinct().withColumn("__label", _c("__unit")))
    while True:
        spread = both.join(lab.withColumnRenamed("__unit", "__v"), "__v").groupBy(_c("__u").alias("__unit")).agg(F.min("__label").alias("__near"))
        step = lab.join(spread, "__unit", "left").select("__unit", F.least("__label", F.coalesce("__near", "__label")).alias("__label"))
        jump = step.alias("s").join(step.alias("t"), _c("s.__label") == _c("t.__unit"), "left").select(
            _c("s.__unit"), F.least(_c("s.__label"), F.coalesce(_c("t.__label"), _c("s.__label"))).alias("__label")
        )
        moved = cut_lineage(jump.join(lab.withColumnRenamed("__label", "__was"), "__unit").withColumn("__moved", _c("__label") != _c("__was")))
        lab = moved.select("__unit", "__label")
        if not moved.where("__moved").limit(1).count():
            break
    least = lab.join(units, "__unit").groupBy("__label").agg(F.min("__least").alias("__component"))
    return units.join(lab, "__unit", "left").join(least, "__label", "left").select("__unit", F.coalesce("__component", "__least").alias("__component"))
