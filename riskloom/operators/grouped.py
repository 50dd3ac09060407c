"""One logistic model per group, all groups at once (iteratively reweighted least squares).

Each round is one scan of the rows: they meet the current coefficients of their group (a join on
the group key), and one aggregation by group sums the gradient and the (d + 1) x (d + 1) curvature
of the weighted, L2-penalised log-loss as plain SQL sums, partially per partition before the
shuffle, so a group that holds a third of all rows is summed by every task. Each group's Newton
step is then one small solve, done for all groups in numpy inside Spark tasks. There is no scan
per group and no limit on the number of groups; the driver only reads the largest change of any
coefficient to stop.

Objective of a group g with n_g rows: (1 / W_g) sum_i w_i (log(1 + e^eta_i) - y_i eta_i) +
(1 / (2 c n_g)) |beta|^2 (the intercept is not penalised), eta = b0 + x . beta; with `balanced`
weights w = n_g / (k_g n_{g,y}) as `prep.class_weights` per group, else 1. This is MLlib's
`LogisticRegression(regParam=1/(c n_g), standardization=False)` on the group's rows.

Rows with a NULL label take no part; NULL features count as 0; a NULL group is a group of its own.
Groups with fewer than `least_rows` rows or only one class get no model (`fitted` false, NULL
coefficients), as no finite optimum exists for them. Result: group, intercept, coefficients
(array in the order of `features`), rows, rounds, fitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

_c = F.col


def _solve(d: int, c: float) -> callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            beta = np.stack(f["__beta"].to_numpy()).astype(np.float64)
            s = f["__sw"].to_numpy()[:, None]
            g = np.stack(f["__g"].to_numpy()) / s
            h = np.zeros((len(f), d + 1, d + 1))
            iu = np.triu_indices(d + 1)
            h[:, iu[0], iu[1]] = np.stack(f["__h"].to_numpy())
            h = h + np.triu(h, 1).transpose(0, 2, 1)
            h /= s[:, :, None]
            lam = 1.0 / (c * f["__n"].to_numpy())
            pen = np.ones(d + 1)
            pen[0] = 0
            g = g + lam[:, None] * pen[None, :] * beta
            h = h + lam[:, None, None] * np.diag(pen)[None, :, :]
            step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            new = beta - step
            yield pd.DataFrame({"__key": f["__key"], "__beta": list(new), "__move": np.abs(step).max(1)})

    return run


def fit_logistic_groups(
    df: DataFrame, group: str, features: Sequence[str], y: str = "y", c: float = 1.0, balanced: bool = True,
    least_rows: int = 100, max_rounds: int = 100, tol: float = 1e-10,
) -> DataFrame:
    d = len(features)
    xs = [f"__x{j}" for j in range(d)]
    rows = df.where(_c(y).isNotNull()).select(
        _c(group).alias("__key"), _c(y).cast("double").alias("__y"), *[F.coalesce(_c(f).cast("double"), F.lit(0.0)).alias(x) for f, x in zip(features, xs)]
    )
    counts = rows.groupBy("__key", "__y").agg(F.count(F.lit(1)).alias("__ny"))
    sizes = counts.groupBy("__key").agg(F.sum("__ny").alias("__n"), F.count(F.lit(1)).alias("__k"))
    per = sizes.withColumnRenamed("__key", "__ks")
    weights = counts.join(per, _c("__key").eqNullSafe(_c("__ks"))).select(
        "__key", "__y", (_c("__n") / (_c("__k") * _c("__ny")) if balanced else F.lit(1.0)).alias("__w")
    )
    rows = cut_lineage(_weighted(rows, weights))
    groups = cut_lineage(sizes.select("__key", "__n", ((_c("__n") >= least_rows) & (_c("__k") == 2)).alias("__ok")))
    beta = cut_lineage(groups.where("__ok").select("__key", F.array_repeat(F.lit(0.0), d + 1).alias("__beta")))
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        joined = rows.join(beta.withColumnRenamed("__key", "__kb"), _c("__key").eqNullSafe(_c("__kb")))
        eta = _c("__beta")[0]
        for j, x in enumerate(xs):
            eta = eta + _c("__beta")[j + 1] * _c(x)
        p = 1.0 / (1.0 + F.exp(-eta))
        joined = joined.select("__key", "__w", "__y", *xs, p.alias("__p"))
        ones = [F.lit(1.0), *[_c(x) for x in xs]]
        grad = [F.sum(_c("__w") * (_c("__p") - _c("__y")) * v) for v in ones]
        curv = [F.sum(_c("__w") * _c("__p") * (1 - _c("__p")) * ones[a] * ones[b]) for a in range(d + 1) for b in range(a, d + 1)]
        sums = joined.groupBy("__key").agg(F.sum("__w").alias("__sw"), F.array(*grad).alias("__g"), F.array(*curv).alias("__h"))
        sums = sums.join(beta.withColumnRenamed("__key", "__kb"), sums["__key"].eqNullSafe(_c("__kb")))
        sums = sums.join(groups.select(_c("__key").alias("__kg"), "__n"), _c("__key").eqNullSafe(_c("__kg")))
        beta = cut_lineage(sums.select("__key", "__beta", "__sw", "__g", "__h", "__n").mapInPandas(_solve(d, c), f"__key {rows.schema['__key'].dataType.simpleString()}, __beta array<double>, __move double"))
        move = beta.agg(F.max("__move")).first()[0]
        beta = beta.select("__key", "__beta")
        if move is None or move < tol:
            break
    out = groups.join(beta.withColumnRenamed("__key", "__kb"), _c("__key").eqNullSafe(_c("__kb")), "left").select(
        _c("__key").alias(group), _c("__beta")[0].alias("intercept"), F.slice("__beta", 2, d).alias("coefficients"), _c("__n").alias("rows"),
        F.lit(rounds).alias("rounds"), _c("__ok").alias("fitted"),
    )
    return out


def _weighted(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with their class weight (one row per group and class on the other side)."""
    w = weights.select(_c("__key").alias("__kw"), _c("__y").alias("__yw"), "__w")
    cond = _c("__key").eqNullSafe(_c("__kw")) & (_c("__y") == _c("__yw"))
    return rows.join(w, cond).select("__key", "__y", "__w", *[c for c in rows.columns if c.startswith("__x")])


def score_groups(df: DataFrame, models: DataFrame, group: str, features: Sequence[str], out: str = "p") -> DataFrame:
    """P(y = 1) from the model of each row's group; NULL where the group has none."""
    m = models.select(_c(group).alias("__key"), "intercept", "coefficients")
    eta = _c("intercept")
    for j, f in enumerate(features):
        eta = eta + _c("coefficients")[j] * F.coalesce(_c(f).cast("double"), F.lit(0.0))
    joined = df.join(m, df[group].eqNullSafe(m["__key"]), "left")
    return joined.select(*[df[c] for c in df.columns], (1.0 / (1.0 + F.exp(-eta))).alias(out))
