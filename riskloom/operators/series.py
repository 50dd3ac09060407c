"""Trends over monthly series, concentration, transitions and survival.

A monthly series has at most one row per key and month, so windows per key are short; what
works on single transactions reduces them to days or months first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.pricing import emi
from riskloom.operators.scan import column_quantiles, join_null_safe, running_min, running_sums
from riskloom.operators.account import _day_pass, _over, is_income, is_spend

_c = F.col


def month_index(ts: Column) -> Column:
    """Months since year 0: a number that ranges of months can be taken on."""
    return (F.year(ts) * 12 + F.month(ts)).cast("int")


def monthly_series(txn: DataFrame, key: str = "account_id") -> DataFrame:
    """(key, m, credit, spend, net, income, salary, n, balance) per month that occurs."""
    m = month_index(_c("transaction_date"))
    credit = F.coalesce(F.sum(F.when(_c("transaction_type") == "credit", _c("amount"))), F.lit(0.0))
    spend = F.coalesce(F.sum(F.when(is_spend(), _c("amount"))), F.lit(0.0))
    return txn.groupBy(key, m.alias("m")).agg(
        credit.alias("credit"),
        spend.alias("spend"),
        (credit - spend).alias("net"),
        F.coalesce(F.sum(F.when(is_income(), _c("amount"))), F.lit(0.0)).alias("income"),
        F.avg("balance_after").alias("balance"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when((_c("transaction_type") == "emi_payment") & (_c("verification_status") == "failed"), 1)).alias("bounces"),
    )


def _last(key: str, n: int) -> Window:
    return Window.partitionBy(key).orderBy("m").rangeBetween(-(n - 1), 0)


ROLLING = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
}


def rolling_stat(df: DataFrame, key: str, value: str, n: int, fn: str) -> DataFrame:
    """Statistic over the last n months (months that are missing are not filled)."""
    return df.withColumn(f"{value}_{fn}_{n}m", ROLLING[fn](value).over(_last(key, n)))


def trend_slope(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    w = _last(key, n)
    return df.withColumn(f"{value}_slope_{n}m", F.when(F.count(value).over(w) >= 2, F.regr_slope(_c(value), _c("m").cast("double")).over(w)))


def change_over(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Difference and ratio to the value n months ago, and the change of that difference. A
    range frame finds the month by its number, so gaps in the series do not shift it."""
    at = lambda k: F.first(value).over(Window.partitionBy(key).orderBy("m").rangeBetween(-k, -k))
    diff = _c(value) - at(n)
    return df.withColumns(
        {
            f"{value}_diff_{n}m": diff,
            f"{value}_ratio_{n}m": F.try_divide(_c(value), at(n)),
            f"{value}_accel_{n}m": diff - (at(n) - at(2 * n)),
        }
    )


def variation(df: DataFrame, key: str, value: str) -> DataFrame:
    """Spread of a series, one row per key."""
    v = _c(value)
    mean, sd = F.avg(v), F.coalesce(F.stddev_samp(v), F.lit(0.0))
    stats = df.groupBy(key).agg(
        F.try_divide(sd, F.abs(mean)).alias("cv"),
        F.greatest(F.least(1 - _over(sd, F.abs(mean)), F.lit(1.0)), F.lit(0.0)).alias("stability_index"),
        F.try_divide(F.max(v) - F.min(v), F.max(v)).alias("peak_to_trough"),
        F.count(F.when(v == 0, 1)).alias("zero_months"),
        F.try_divide(F.min(v), F.max(v)).alias("weakest_to_best"),
        F.max_by(v, _c("m")).alias("last_value"),
        F.count(F.lit(1)).alias("months"),
    )
    rank = F.percent_rank().over(Window.partitionBy(key).orderBy(value))
    own = df.select(key, "m", rank.alias("r")).groupBy(key).agg(F.max_by("r", "m").alias("percentile_in_history"))
    return join_null_safe(stats, own, [key])


def max_drawdown(df: DataFrame, key: str, value: str) -> DataFrame:
    """Largest fall from a running peak, absolute and relative."""
    w = Window.partitionBy(key).orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = df.select(key, value, F.max(value).over(w).alias("peak"))
    return peak.groupBy(key).agg(
        F.max(_c("peak") - _c(value)).alias("max_drawdown"),
        F.max(F.when(_c("peak") > 0, (_c("peak") - _c(value)) / _c("peak"))).alias("max_drawdown_share"),
    )


def runs(df: DataFrame, key: str, cond: Column) -> DataFrame:
    """Longest and mean run of consecutive months that meet the condition."""
    hit = df.where(cond).select(key, "m")
    island = _c("m") - F.row_number().over(Window.partitionBy(key).orderBy("m"))
    length = hit.withColumn("g", island).groupBy(key, "g").agg(F.count(F.lit(1)).alias("len"))
    found = length.groupBy(key).agg(
        F.max("len").alias("longest_run"), F.avg("len").alias("mean_run"), F.count(F.lit(1)).alias("runs")
    )
    every = join_null_safe(df.select(key).distinct(), found, [key], "left")
    return every.fillna(0, ["longest_run", "runs"]).fillna(0.0, ["mean_run"])


def diversity(df: DataFrame, key: str, category: str, weight: Column | None = None) -> DataFrame:
    """Entropy and Herfindahl index of the category shares, from pre-aggregated counts."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    c = df.groupBy(key, category).agg(w.cast("double").alias("w"))
    share = F.try_divide(_c("w"), F.sum("w").over(Window.partitionBy(key)))
    s = c.select(key, share.alias("p"))
    return s.groupBy(key).agg(
        F.sum(F.when(_c("p") > 0, -_c("p") * F.log("p")).otherwise(F.lit(0.0))).alias("entropy"),
        F.sum(_c("p") * _c("p")).alias("herfindahl"),
    )


def as_of(features: DataFrame, snapshots: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Latest feature value at or before each snapshot time.

    Both tables are stacked and the running maximum of (time, value) is taken per key, by
    slices of time, so a key with many rows is spread over tasks.
    """
    f = features.select(key, F.unix_micros(_c(at).cast("timestamp")).alias("__t"), _c(value).alias("__value"), F.lit(None).cast("bigint").alias("__snap"))
    s = snapshots.select(
        key, F.unix_micros(_c(at).cast("timestamp")).alias("__t"), F.lit(None).cast(f.schema["__value"].dataType).alias("__value"), _c("snapshot_id").cast("bigint").alias("__snap")
    )
    both = f.unionByName(s)
    seen = F.when(_c("__snap").isNull(), F.struct("__t", "__value"))
    last = running_min(both, "__t", seen, "__last", by=[key], largest=True)
    return last.where(_c("__snap").isNotNull()).select(
        _c("__snap").alias("snapshot_id"), key, _c("__last.__value").alias(value),
        F.timestamp_micros(_c("__last.__t")).cast("timestamp_ntz").alias("feature_time"),
    )


def range_counts(events: DataFrame, key: str, at: str, days: int = 30, least: int = 3, out: str = "n_in_range") -> DataFrame:
    """For every event, the events of its key in the `days` ending at it (both ends included, ties
    counted), and `spike` when they are at least `least` (e.g. 3 bureau inquiries in 30 days).

    No window spans a key: a running count per key comes from the sliced scan (`running_sums` on
    one row per key and instant), and the count before the range from an as-of lookup of that
    running count just before t - days (`running_min` with `largest`, by slices of time); the
    count in the range is their difference. A key with a third of all events is spread over the
    slices. Rows with a NULL time are not counted and get NULL; a NULL key is a key of its own.
    """
    span = days * 86_400_000_000
    t = F.unix_micros(_c(at).cast("timestamp"))
    timed = events.where(_c(at).isNotNull())
    per = timed.groupBy(key, t.alias("__t")).agg(F.count(F.lit(1)).alias("__c"))
    run = running_sums(per.withColumn("__o", _c("__t").cast("double")), "__o", ["__c"], by=[key]).select(key, "__t", "__o", "__c_run")
    asks = run.select(key, "__t", (_c("__t").cast("double") - span - 0.5).alias("__o"), F.lit(None).cast("long").alias("__c_run"), F.lit(True).alias("__ask"))
    both = run.select(key, "__t", "__o", "__c_run", F.lit(False).alias("__ask")).unionByName(asks)
    seen = running_min(both, "__o", F.when(~_c("__ask"), _c("__c_run")), "__before", by=[key], largest=True)
    before = seen.where("__ask").select(key, "__t", F.coalesce("__before", F.lit(0)).alias("__before"))
    counts = join_null_safe(run, before, [key, "__t"]).select(key, "__t", (_c("__c_run") - _c("__before")).alias(out))
    tagged = events.withColumn("__t", t)
    return join_null_safe(tagged, counts, [key, "__t"], "left").withColumn("spike", _c(out) >= least).drop("__t")


def ratio_features(txn: DataFrame, key: str = "account_id") -> DataFrame:
    """Shares and flags over an account's rows: one aggregate."""
    spend = lambda cond: F.coalesce(F.sum(F.when(is_spend() & cond, _c("amount"))), F.lit(0.0))
    yes = F.lit(True)
    credit = F.coalesce(F.sum(F.when(_c("transaction_type") == "credit", _c("amount"))), F.lit(0.0))
    due = F.coalesce(F.sum(F.when(_c("transaction_type") == "emi_payment", _c("amount"))), F.lit(0.0))
    medical = _c("category") == "medical"
    return txn.groupBy(key).agg(
        F.try_divide(due, credit).alias("emi_to_credit"),
        F.try_divide(credit, spend(yes)).alias("coverage"),
        F.try_divide(spend(_c("channel").isin("CASH", "ATM")), spend(yes)).alias("cash_share"),
        F.try_divide(spend(_c("channel").isin("UPI", "IMPS", "NEFT", "RTGS", "CARD")), spend(yes)).alias("digital_share"),
        F.coalesce(F.max(F.when(is_spend() & medical, _c("amount"))) > 3 * F.avg(F.when(is_spend() & medical, _c("amount"))), F.lit(False)).alias("medical_spike"),
        # Eleven categories at most: the set is bounded.
        F.size(F.collect_set(F.when(is_income(), _c("category")))).alias("income_sources"),
    )


def emi_rate_shock(df: DataFrame, shock: float = 0.02, key: str = "loan_id") -> DataFrame:
    """Instalment at the contract rate and at a shifted rate."""
    p, r, n = _c("principal"), _c("annual_rate"), _c("tenure_months")
    out = df.select(key, emi(p, r, n).alias("emi_base"), emi(p, r + shock, n).alias("emi_shocked"))
    return out.withColumn("increase", F.try_divide(_c("emi_shocked") - _c("emi_base"), _c("emi_base")))


def timing(txn: DataFrame, key: str = "account_id") -> DataFrame:
    """Regularity in time, from (account, day) rows."""
    days = _day_pass(txn)
    w = Window.partitionBy(key).orderBy("day")
    later_emi = F.min(F.when(_c("emi").isNotNull(), _c("day"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    gap = F.date_diff(_c("day"), F.lag("day").over(w))
    d = days.select(
        key, "day", "n", "credit",
        F.dayofmonth("day").alias("dom"),
        F.when(_c("salary").isNotNull(), F.date_diff(later_emi, _c("day"))).alias("salary_gap"),
        gap.alias("gap"),
    )
    in_quarter_end = F.month("day").isin(3, 6, 9, 12)
    return d.groupBy(key).agg(
        F.coalesce(F.var_samp(F.when(_c("credit").isNotNull(), _c("dom"))), F.lit(0.0)).alias("credit_day_variance"),
        F.avg("salary_gap").alias("salary_to_emi_days"),
        (F.sum(F.when(in_quarter_end, _c("n")).otherwise(0)) / F.sum("n")).alias("quarter_end_share"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("longest_dormancy"),
        F.date_diff(F.max("day"), F.min("day")).alias("tenure_days"),
    )


def modal_day(txn: DataFrame, key: str = "account_id") -> DataFrame:
    """Most frequent day of month with a credit; the earlier day among equals."""
    c = txn.where(_c("transaction_type") == "credit").groupBy(key, F.dayofmonth("transaction_date").alias("d")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return c.groupBy(key).agg(F.max_by("d", F.struct(_c("n"), -_c("d"))).alias("modal_credit_day"))


def cross_terms(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": _c(a) * _c(b) for a, b in pairs})


def neighbor_rate(df: DataFrame, group: str, y: str) -> DataFrame:
    """Rate of the others that share the attribute, own row left out. The group sums are
    pre-aggregated and joined back; no group is collected."""
    g = df.groupBy(group).agg(F.sum(y).alias("__s"), F.count(F.lit(1)).alias("__n"))
    j = join_null_safe(df, g, [group], "left")
    others = _c("__s") - _c(y)
    return j.withColumns(
        {
            f"{group}_neighbor_rate": F.try_divide(others.cast("double"), _c("__n") - 1),
            f"{group}_any_neighbor": others > 0,
        }
    ).drop("__s", "__n")


def early_warning(series: DataFrame, key: str = "account_id") -> DataFrame:
    """Monthly warning flags: balance down over 30 % in three months, spend above 70 % of
    credit, three or more bounces in the last month, first bounce, irregular income."""
    by = Window.partitionBy(key).orderBy("m")
    before = F.first("balance").over(by.rangeBetween(-3, -3))
    bounced = F.sum("bounces").over(by.rowsBetween(Window.unboundedPreceding, -1))
    mean = F.avg("income").over(by.rangeBetween(-6, -1))
    flags = {
        "balance_drop": F.coalesce((before > 0) & (_c("balance") < before * 0.7), F.lit(False)),
        "high_utilization": F.coalesce((_c("credit") > 0) & (_c("spend") > _c("credit") * 0.7), F.lit(False)),
        "bounce_spike": _c("bounces") >= 3,
        "first_bounce": (_c("bounces") > 0) & (F.coalesce(bounced, F.lit(0)) == 0),
        "irregular_income": F.coalesce(F.abs(_c("income") - mean) > mean * 0.5, F.lit(False)),
    }
    out = series.withColumns(flags)
    total = sum((_c(f).cast("int") for f in flags), F.lit(0))
    return out.withColumn("warning_count", total)


def transitions(df: DataFrame, key: str, state: str) -> DataFrame:
    """State-transition counts and shares between consecutive rows of a series."""
    prev = F.lag(state).over(Window.partitionBy(key).orderBy("m"))
    c = df.select(prev.alias("from_state"), _c(state).alias("to_state")).where("from_state is not null")
    n = c.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", _c("n") / F.sum("n").over(Window.partitionBy("from_state")))


def concentration(df: DataFrame, segment: str, exposure: str, loss: str) -> DataFrame:
    """Exposure, share and expected loss per segment with the total row, from one rollup."""
    r = df.rollup(segment).agg(
        F.grouping(segment).alias("is_total"), F.sum(exposure).alias("exposure"), F.sum(loss).alias("expected_loss"),
        F.count(F.lit(1)).alias("loans"),
    )
    # One row per segment.
    w = Window.partitionBy(F.lit(0))
    total = F.max(F.when(_c("is_total") == 1, _c("exposure"))).over(w)
    s = r.withColumn("share", _c("exposure") / total)
    hhi = F.sum(F.when(_c("is_total") == 0, _c("share") * _c("share"))).over(w)
    return s.select(F.coalesce(segment, F.lit("ALL")).alias("segment"), "exposure", "expected_loss", "loans", "share", hhi.alias("hhi"))


def concentration_sets(
    df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], exposure: str, loss: str,
    shocks_bps: Sequence[int] = (0, 100, 200, 300), elasticity: float = 0.1, top_n: int = 5,
) -> DataFrame:
    """Concentration at several levels at once, under a grid of rate shocks.

    One aggregation over GROUPING SETS (`sets`, each a list of `dims`; [] is the whole book)
    gives exposure, loans and expected loss per cell; a cell of a level is named by the dims of
    its set joined with ',' ('ALL' for []). Each row's loss is stressed before summing: a shock of
    s basis points raises it by `elasticity` x s / 100 of itself, never above the row's exposure.
    Per level and shock: share of the level's exposure, the level's HHI (sum of squared shares),
    and the rank of the cell by exposure (ties: keys in order), `top` for the first `top_n`.
    Rows with a NULL exposure count as loans with no exposure; a NULL key is a cell of its own.
    The shock grid is exploded before the partial aggregation, so the shuffle holds cells x
    shocks rows per partition, whatever the size of the book.
    """
    bits = {d: 1 << (len(dims) - i) for i, d in enumerate(dims)}  # the lowest bit is shock_bps, always grouped
    name = F.lit(None).cast("string")
    for level in sets:
        mask = sum(b for d, b in bits.items() if d not in level)
        name = F.when(F.grouping_id() == mask, F.lit(",".join(level) or "ALL")).otherwise(name)
    x, l = F.coalesce(_c(exposure).cast("double"), F.lit(0.0)), F.coalesce(_c(loss).cast("double"), F.lit(0.0))
    rows = df.select(*dims, x.alias("__x"), l.alias("__l"), F.explode(F.array(*[F.lit(int(s)) for s in shocks_bps])).alias("shock_bps"))
    stressed = F.least(_c("__x"), _c("__l") * (1 + elasticity * _c("shock_bps") / 100.0))
    cells = rows.groupingSets([[*level, "shock_bps"] for level in sets], *dims, "shock_bps").agg(
        name.alias("level"), F.sum("__x").alias("exposure"), F.count(F.lit(1)).alias("loans"), F.sum(stressed).alias("expected_loss"),
    )
    w = Window.partitionBy("level", "shock_bps")
    share = _c("exposure") / F.sum("exposure").over(w)
    ranked = cells.withColumn("share", share).withColumn("hhi", F.sum(share * share).over(w))
    order = Window.partitionBy("level", "shock_bps").orderBy(F.desc("exposure"), *[F.asc_nulls_first(d) for d in dims])
    ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.select("level", *dims, "shock_bps", "exposure", "loans", "expected_loss", "share", "hhi", "rank", (_c("rank") <= top_n).alias("top"))


def temporal_split(df: DataFrame, at: str, train: int = 18, valid: int = 4, test: int = 2) -> DataFrame:
    """train / validate / test by months since the first month of the table."""
    first = df.agg(F.min(month_index(_c(at)))).scalar()
    k = month_index(_c(at)) - first + 1
    part = (
        F.when(k <= train, "train").when(k <= train + valid, "validate").when(k <= train + valid + test, "test").otherwise("later")
    )
    return df.withColumn("part", part)


def feature_select(df: DataFrame, features: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """Variance and mutual information with the label, on equal-width bins."""
    lo_hi = df.agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features]).first()
    cells = []
    for f in features:
        lo, hi = float(lo_hi[f"lo_{f}"]), float(lo_hi[f"hi_{f}"])
        cell = F.least(F.floor((_c(f) - lo) / ((hi - lo) or 1.0) * bins), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(f).alias("feature"), cell.alias("bin"), _c(f).cast("double").alias("value")))
    long = df.select(_c(y).alias("y"), F.explode(F.array(*cells)).alias("c")).select("y", "c.feature", "c.bin", "c.value")
    joint = long.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = lambda *k: Window.partitionBy("feature", *k)
    p = joint.select(
        "feature",
        (_c("n") / F.sum("n").over(per())).alias("pxy"),
        (F.sum("n").over(per("bin")) / F.sum("n").over(per())).alias("px"),
        (F.sum("n").over(per("y")) / F.sum("n").over(per())).alias("py"),
    )
    mi = p.groupBy("feature").agg(F.sum(_c("pxy") * F.log(_c("pxy") / (_c("px") * _c("py")))).alias("mutual_information"))
    var = long.groupBy("feature").agg(F.var_pop("value").alias("variance"))
    return mi.join(var, "feature")


def kaplan_meier(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Survival curve per group. Rows are counted per (group, time) first; the windows run
    over distinct times."""
    c = df.groupBy(by, time).agg(F.sum(event).alias("events"), F.count(F.lit(1)).alias("leaving"))
    down = Window.partitionBy(by).orderBy(_c(time).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(by).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = c.withColumn("at_risk", F.sum("leaving").over(down))
    step = 1 - _c("events") / _c("at_risk")
    # A step to 0 stays at 0; the product is a sum of logarithms.
    logs = F.sum(F.when(step > 0, F.log(step)).otherwise(F.lit(-math.inf))).over(up)
    return r.select(by, time, "events", "at_risk", F.exp(logs).alias("survival"))


def survival_regression(df: DataFrame, time: str, event: str, features: Sequence[str]) -> DataFrame:
    """Accelerated failure time regression: coefficient per feature."""
    v = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        df.select(_c(time).cast("double").alias("label"), _c(event).cast("double").alias("censor"), *[_c(f).cast("double").alias(f) for f in features])
    )
    m = AFTSurvivalRegression().fit(v)
    rows = [("intercept", float(m.intercept)), ("scale", float(m.scale))] + [(f, float(x)) for f, x in zip(features, m.coefficients)]
    return df.sparkSession.createDataFrame(rows, "term string, value double")


def value_bands(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    return column_quantiles(df, [value], probs)[value]
