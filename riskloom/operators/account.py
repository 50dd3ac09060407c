"""Transaction features, one row per account.

Rows are reduced to (account, month) and (account, day) sums first, with partial
aggregation; what follows works on those small series. Medians and percentiles over single
transactions sort an account's values in one array, or go through `quantiles` if they are many,
so that an account with a third of all rows is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import clip
from riskloom.operators.scan import join_null_safe, melt, quantiles
from riskloom.session import cut_lineage

# ---- fixed values -----------------------------------------------------------------
INCOME_CATEGORIES = ("salary", "business", "transfer")
SPEND_TYPES = ("debit", "emi_payment", "fee")
ESSENTIAL = ("groceries", "rent", "utilities", "medical", "education")
DISCRETIONARY = ("entertainment", "other")
CATEGORIES = (
    "salary", "groceries", "rent", "entertainment", "business", "utilities", "medical", "education", "transfer",
    "investment", "other",
)
CHANNELS = ("NEFT", "RTGS", "UPI", "IMPS", "CHEQUE", "CASH", "ATM", "CARD")
LOW_BALANCE = 1000
TINY = 1e-8
BUSY_ROWS = 1 << 16  # rows of an account that are sorted in one array
# ---- end of fixed values ----------------------------------------------------------

KEY = "account_id"
_c = F.col


def is_income() -> Column:
    return (_c("transaction_type") == "credit") & _c("category").isin(*INCOME_CATEGORIES)


def is_spend() -> Column:
    return _c("transaction_type").isin(*SPEND_TYPES)


def _month() -> Column:
    return F.date_trunc("month", _c("transaction_date"))


def _sum(cond: Column, value: Column | None = None) -> Column:
    """Conditional sum, NULL when no row matches."""
    return F.sum(F.when(cond, _c("amount") if value is None else value))


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _zero(x: Column, value: float | int = 0.0) -> Column:
    return F.coalesce(x, F.lit(value))


def _over(num: Column, den: Column) -> Column:
    """num / (den + tiny), as the reference guards its divisions."""
    return num / (den + F.lit(TINY))


def accounts(txn: DataFrame) -> DataFrame:
    return txn.select(KEY).distinct()


def monthly(txn: DataFrame) -> DataFrame:
    """The base of all monthly features: one row per account and month."""
    spend, income = is_spend(), is_income()
    card = (_c("transaction_type") == "debit") & _c("channel").isin("CARD", "UPI")
    return (
        txn.withColumn("month", _month())
        .groupBy(KEY, "month")
        .agg(
            _sum(income).alias("income"),
            F.coalesce(_sum(income & (_c("category") == "salary")), F.lit(0.0)).alias("salary"),
            _sum(_c("transaction_type") == "credit").alias("credit"),
            _sum(spend).alias("spend"),
            _count(spend).alias("spend_n"),
            _sum(card).alias("card"),
            _sum(_c("transaction_type") == "emi_payment").alias("emi"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def _from_monthly_income(m: DataFrame) -> DataFrame:
    inc = m.where(_c("income").isNotNull())
    w = Window.partitionBy(KEY)
    ranked = inc.select(
        KEY,
        "income",
        "salary",
        F.row_number().over(w.orderBy("month")).alias("k"),
        F.count(F.lit(1)).over(w).alias("months"),
    )
    half = F.floor(_c("months") / 2)
    per = ranked.groupBy(KEY).agg(
        F.avg("income").alias("avg_monthly_income"),
        F.expr("percentile(income, 0.5)").alias("median_monthly_income"),
        F.max("income").alias("max_monthly_income"),
        F.min("income").alias("min_monthly_income"),
        _zero(F.stddev_samp("income")).alias("income_std"),
        F.avg(F.when(_c("k") <= half, _c("income"))).alias("__first"),
        F.avg(F.when(_c("k") > half, _c("income"))).alias("__second"),
        F.avg(_over(_c("salary"), _c("income"))).alias("salary_consistency"),
        F.sum("income").alias("total_income"),
        F.count(F.lit(1)).alias("num_income_months"),
    )
    stability = clip(1 - _over(_c("income_std"), _c("avg_monthly_income")), 0, 1)
    return per.select(
        KEY,
        "avg_monthly_income",
        "median_monthly_income",
        "max_monthly_income",
        "min_monthly_income",
        "income_std",
        F.when(_c("avg_monthly_income") > 0, stability).otherwise(F.lit(0.0)).alias("income_stability"),
        F.when(_c("num_income_months") >= 2, _over(_c("__second") - _c("__first"), _c("__first")))
        .otherwise(F.lit(0.0))
        .alias("income_growth_rate"),
        "salary_consistency",
        "total_income",
        "num_income_months",
    )


INCOME_COLUMNS = (
    "avg_monthly_income", "median_monthly_income", "max_monthly_income", "min_monthly_income", "income_std",
    "income_stability", "income_growth_rate", "salary_consistency", "total_income", "num_income_months",
)
SPENDING_COLUMNS = (
    "avg_monthly_spend", "median_monthly_spend", "max_monthly_spend", "spend_std", "total_spend", "num_spend_txns",
    "essential_spend_ratio", "discretionary_spend_ratio", "essential_spend_total",
    *[f"spend_category_{c}" for c in CATEGORIES], *[f"spend_category_{c}_pct" for c in CATEGORIES],
)
EMI_COLUMNS = (
    "total_emi_count", "total_emi_amount", "avg_monthly_emi", "max_monthly_emi", "emi_to_income_ratio",
    "total_emi_to_income_ratio", "max_consecutive_emi", "on_time_payment_rate", "missed_payment_count",
)
BALANCE_COLUMNS = (
    "avg_balance", "median_balance", "min_balance", "max_balance", "balance_std", "balance_range",
    "negative_balance_days", "negative_balance_pct", "low_balance_days", "low_balance_pct", "balance_volatility",
)
CASH_FLOW_COLUMNS = (
    "avg_monthly_cash_flow", "total_cash_flow", "cash_flow_std", "cash_flow_volatility", "positive_cash_flow_months",
    "negative_cash_flow_months", "cash_flow_to_income_ratio", "cash_flow_trend", "cash_flow_seasonal_volatility",
)
UTILIZATION_COLUMNS = (
    "total_card_spend", "card_spend_pct", "credit_utilization_to_income", "avg_monthly_total_spend", "spend_to_income_ratio",
)
VELOCITY_COLUMNS = (
    "avg_monthly_txn_count", "max_monthly_txn_count", "total_txn_count", "txn_count_std", "avg_weekly_txn_count",
    "large_txn_count", "large_txn_pct", "max_single_txn", "avg_txn_size", "unusual_activity_days",
)
BEHAVIORAL_COLUMNS = (
    "spending_regularity", "unique_merchant_count", "merchant_diversity", "txn_hour_mean", "txn_hour_std",
    "night_txn_pct", "weekend_txn_pct", "month_end_spend_pct", *[f"channel_{c}_pct" for c in CHANNELS],
)
ALL_COLUMNS = (
    *INCOME_COLUMNS, *SPENDING_COLUMNS, *EMI_COLUMNS, *BALANCE_COLUMNS, *CASH_FLOW_COLUMNS, *UTILIZATION_COLUMNS,
    *VELOCITY_COLUMNS, *BEHAVIORAL_COLUMNS,
)
COUNT_COLUMNS = {
    "num_income_months", "num_spend_txns", "total_emi_count", "max_consecutive_emi", "missed_payment_count",
    "negative_balance_days", "low_balance_days", "positive_cash_flow_months", "negative_cash_flow_months",
    "max_monthly_txn_count", "total_txn_count", "large_txn_count", "unusual_activity_days", "unique_merchant_count",
}


def _fill(base: DataFrame, part: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every account of `base`; accounts without rows in `part` get the default record."""
    joined = join_null_safe(base, part, [KEY], "left")
    return joined.select(KEY, *[_default(c) for c in cols])


def _default(c: str) -> Column:
    if c == "on_time_payment_rate":
        return _zero(_c(c), 1.0).alias(c)
    if c in COUNT_COLUMNS:
        return _zero(_c(c), 0).cast("bigint").alias(c)
    return _zero(_c(c)).alias(c)


def income_features(txn: DataFrame) -> DataFrame:
    return _fill(accounts(txn), _from_monthly_income(monthly(txn)), INCOME_COLUMNS)


def _spend_totals(txn: DataFrame) -> DataFrame:
    spend = is_spend()
    totals = txn.groupBy(KEY).agg(
        _sum(spend).alias("total_spend"),
        _count(spend).alias("num_spend_txns"),
        _zero(_sum(spend & _c("category").isin(*ESSENTIAL))).alias("essential_spend_total"),
        _zero(_sum(spend & _c("category").isin(*DISCRETIONARY))).alias("__discretionary"),
        *[_zero(_sum(spend & (_c("category") == c))).alias(f"spend_category_{c}") for c in CATEGORIES],
    )
    both = _c("essential_spend_total") + _c("__discretionary")
    return totals.withColumns(
        {
            "essential_spend_ratio": _over(_c("essential_spend_total"), both),
            "discretionary_spend_ratio": _over(_c("__discretionary"), both),
            **{
                f"spend_category_{c}_pct": _over(_c(f"spend_category_{c}"), _zero(_c("total_spend")))
                for c in CATEGORIES
            },
        }
    ).drop("__discretionary")


def _spend_months(m: DataFrame) -> DataFrame:
    return m.where(_c("spend").isNotNull()).groupBy(KEY).agg(
        F.avg("spend").alias("avg_monthly_spend"),
        F.expr("percentile(spend, 0.5)").alias("median_monthly_spend"),
        F.max("spend").alias("max_monthly_spend"),
        _zero(F.stddev_samp("spend")).alias("spend_std"),
    )


def spending_features(txn: DataFrame) -> DataFrame:
    both = join_null_safe(_spend_totals(txn), _spend_months(monthly(txn)), [KEY], "left")
    return both.select(KEY, *[_default(c) for c in SPENDING_COLUMNS])


def _emi_totals(txn: DataFrame) -> DataFrame:
    emi = txn.where(_c("transaction_type") == "emi_payment")
    totals = emi.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_emi_count"),
        F.sum("amount").alias("total_emi_amount"),
        F.avg(F.when(_c("verification_status") == "verified", 1.0).otherwise(0.0)).alias("on_time_payment_rate"),
    )
    # Distinct (loan, month) pairs first: the count per loan is then a plain count.
    loans = (
        emi.where(_c("loan_id").isNotNull())
        .select(KEY, "loan_id", _month().alias("month"))
        .distinct()
        .groupBy(KEY, "loan_id")
        .agg(F.count(F.lit(1)).alias("months"))
        .groupBy(KEY)
        .agg(F.max("months").alias("max_consecutive_emi"))
    )
    return join_null_safe(totals, loans, [KEY], "left")


def _emi_months(m: DataFrame) -> DataFrame:
    return m.where(_c("emi").isNotNull()).groupBy(KEY).agg(
        F.avg("emi").alias("avg_monthly_emi"),
        F.max("emi").alias("max_monthly_emi"),
        F.count(F.lit(1)).alias("__emi_months"),
    )


def _emi_ratios(df: DataFrame) -> DataFrame:
    """Needs totals, months and income of the account side by side; no EMI leaves the defaults."""
    has = _c("total_emi_count").isNotNull()
    gap = _zero(_c("max_consecutive_emi"), 0) - _zero(_c("__emi_months"), 0)
    return df.withColumns(
        {
            "emi_to_income_ratio": F.when(has, _over(_c("avg_monthly_emi"), _zero(_c("avg_monthly_income")))),
            "total_emi_to_income_ratio": F.when(has, _over(_c("total_emi_amount"), _zero(_c("total_income")))),
            "missed_payment_count": F.when(has, F.greatest(gap, F.lit(0))),
        }
    )


def _side_by_side(base: DataFrame, *parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: join_null_safe(a, b, [KEY], "left"), parts, base)


def emi_features(txn: DataFrame) -> DataFrame:
    m = monthly(txn)
    wide = _side_by_side(accounts(txn), _from_monthly_income(m), _emi_totals(txn), _emi_months(m))
    return _emi_ratios(wide).select(KEY, *[_default(c) for c in EMI_COLUMNS])


def _balance_moments(txn: DataFrame) -> DataFrame:
    b = _c("balance_after")
    sums = txn.where(b.isNotNull()).groupBy(KEY).agg(
        F.avg(b).alias("avg_balance"),
        F.min(b).alias("min_balance"),
        F.max(b).alias("max_balance"),
        _zero(F.stddev_samp(b)).alias("balance_std"),
        _count(b < 0).alias("negative_balance_days"),
        F.avg(F.when(b < 0, 1.0).otherwise(0.0)).alias("negative_balance_pct"),
        _count(b < LOW_BALANCE).alias("low_balance_days"),
        F.avg(F.when(b < LOW_BALANCE, 1.0).otherwise(0.0)).alias("low_balance_pct"),
    )
    return sums.withColumns(
        {
            "balance_range": _c("max_balance") - _c("min_balance"),
            "balance_volatility": _over(_c("balance_std"), F.abs(_c("avg_balance"))),
        }
    )


def _row_quantiles(txn: DataFrame, wanted: dict[str, tuple[str, float]], large: str | None = None) -> DataFrame:
    """Quantiles over the single rows of an account: {name: (column, probability)}; and, if `large`
    names one of them, `large_txn_count`, the rows above it.

    The values of an account are one sorted array, so rows are shuffled once. The values of an
    account of more than `BUSY_ROWS` rows are counted and cut into slices instead."""
    cols = sorted({c for c, _ in wanted.values()})
    rows = txn.select(KEY, *cols)
    busy = cut_lineage(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n")).where(_c("__n") > BUSY_ROWS).select(KEY, F.lit(True).alias("__busy")))
    if busy.isEmpty():
        return _array_quantiles(rows, wanted, large)
    rows = join_null_safe(rows, busy, [KEY], "left")
    some = rows.where("__busy").drop("__busy")
    sliced = _slice_quantiles(some, wanted)
    if large:
        sliced = join_null_safe(sliced, _large(some, wanted[large][0], sliced.select(KEY, large), large), [KEY], "left")
    return _array_quantiles(rows.where("__busy is null").drop("__busy"), wanted, large).unionByName(sliced)


def _array_quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float]], large: str | None) -> DataFrame:
    cols = sorted({c for c, _ in wanted.values()})
    value = lambda c: F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))
    per = rows.groupBy(KEY).agg(
        *[F.collect_list(value(c)).alias(f"__v_{c}") for c in cols],
        *[_count(F.isnan(_c(c).cast("double"))).alias(f"__nan_{c}") for c in cols],
    )
    per = per.withColumns({f"__v_{c}": F.array_sort(f"__v_{c}") for c in cols})

    def at(c: str, p: float) -> Column:
        """Linear interpolation between the two rows around the position."""
        pos = (F.size(f"__v_{c}") - 1) * F.lit(float(p))
        low, high = F.get(f"__v_{c}", F.floor(pos).cast("int")), F.get(f"__v_{c}", F.ceil(pos).cast("int"))
        return low + (high - low) * (pos - F.floor(pos))

    per = per.withColumns({name: at(c, p) for name, (c, p) in wanted.items()})
    out = [KEY, *wanted]
    if large:
        c = wanted[large][0]
        above = F.size(F.filter(f"__v_{c}", lambda x: x > _c(large))) + _c(f"__nan_{c}")
        per = per.withColumn("large_txn_count", F.when(_c(large).isNull(), F.lit(0)).otherwise(above).cast("long"))
        out.append("large_txn_count")
    return per.select(*out)


def _slice_quantiles(txn: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    cols = sorted({c for c, _ in wanted.values()})
    long = melt(txn, [KEY], cols)
    probs = sorted({p for _, p in wanted.values()})
    q = quantiles(long, "value", probs, by=[KEY, "feature"], names=[f"p{i}" for i in range(len(probs))])
    return q.groupBy(KEY).agg(
        *[
            F.max(F.when(_c("feature") == c, _c(f"p{probs.index(p)}"))).alias(name)
            for name, (c, p) in wanted.items()
        ]
    )


def balance_features(txn: DataFrame) -> DataFrame:
    med = _row_quantiles(txn, {"median_balance": ("balance_after", 0.5)})
    return _fill(accounts(txn), join_null_safe(_balance_moments(txn), med, [KEY], "left"), BALANCE_COLUMNS)


def _cash_flow(m: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy("month")
    net = m.where(_c("credit").isNotNull() | _c("spend").isNotNull()).select(
        KEY,
        "month",
        _zero(_c("credit")).alias("credit"),
        (_zero(_c("credit")) - _zero(_c("spend"))).alias("net"),
    )
    steps = net.select(
        KEY,
        "credit",
        "net",
        (F.row_number().over(w) - 1).cast("double").alias("k"),
        F.abs(_c("net") - F.lag("net").over(w)).alias("step"),
    )
    per = steps.groupBy(KEY).agg(
        F.avg("net").alias("avg_monthly_cash_flow"),
        F.sum("net").alias("total_cash_flow"),
        _zero(F.stddev_samp("net")).alias("cash_flow_std"),
        _count(_c("net") > 0).alias("positive_cash_flow_months"),
        _count(_c("net") < 0).alias("negative_cash_flow_months"),
        F.avg("credit").alias("__credit"),
        F.regr_slope("net", "k").alias("__slope"),
        F.stddev_pop("step").alias("__steps"),
        F.count(F.lit(1)).alias("__n"),
    )
    return per.withColumns(
        {
            "cash_flow_volatility": _over(_c("cash_flow_std"), F.abs(_c("avg_monthly_cash_flow"))),
            "cash_flow_to_income_ratio": _over(_c("avg_monthly_cash_flow"), _c("__credit")),
            "cash_flow_trend": F.when(_c("__n") >= 3, _c("__slope")).otherwise(F.lit(0.0)),
            "cash_flow_seasonal_volatility": F.when(_c("__n") > 3, _c("__steps")).otherwise(F.lit(0.0)),
        }
    ).drop("__credit", "__slope", "__steps", "__n")


def cash_flow_features(txn: DataFrame) -> DataFrame:
    return _fill(accounts(txn), _cash_flow(monthly(txn)), CASH_FLOW_COLUMNS)


def _card_totals(m: DataFrame) -> DataFrame:
    return m.groupBy(KEY).agg(
        _zero(F.sum("card")).alias("total_card_spend"),
        _zero(F.sum("spend")).alias("__all_spend"),
        _zero(F.avg("spend")).alias("avg_monthly_total_spend"),
    )


def _card_ratios(df: DataFrame) -> DataFrame:
    income = _zero(_c("avg_monthly_income"))
    has_spend = _c("avg_monthly_total_spend") > 0
    return df.withColumns(
        {
            "card_spend_pct": _over(_c("total_card_spend"), _c("__all_spend")),
            "credit_utilization_to_income": _over(_c("total_card_spend"), income),
            "spend_to_income_ratio": F.when(has_spend, _over(_c("avg_monthly_total_spend"), income)).otherwise(
                F.lit(0.0)
            ),
        }
    )


def credit_utilization(txn: DataFrame) -> DataFrame:
    m = monthly(txn)
    wide = _side_by_side(accounts(txn), _from_monthly_income(m), _card_totals(m))
    return _card_ratios(wide).select(KEY, *[_default(c) for c in UTILIZATION_COLUMNS])


def _count_months(m: DataFrame) -> DataFrame:
    return m.groupBy(KEY).agg(
        F.avg("n").alias("avg_monthly_txn_count"),
        F.max("n").alias("max_monthly_txn_count"),
        F.sum("n").alias("total_txn_count"),
        _zero(F.stddev_samp("n")).alias("txn_count_std"),
    )


def _count_days(txn: DataFrame) -> DataFrame:
    return _day_stats(
        txn.groupBy(KEY, F.date_trunc("day", _c("transaction_date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    )


def _day_stats(days: DataFrame) -> DataFrame:
    """Weekly mean and unusual days, from (account, day) counts in one window and aggregate."""
    w = Window.partitionBy(KEY)
    week = F.date_trunc("week", _c("day"))
    spread = days.select(
        KEY, "n", week.alias("week"), F.avg("n").over(w).alias("m"), F.stddev_samp("n").over(w).alias("s")
    )
    odd = (_zero(_c("s")) > 0) & (_c("n") > _c("m") + 2 * _c("s"))
    per_week = spread.groupBy(KEY, "week").agg(F.sum("n").alias("n"), _count(odd).alias("odd"))
    return per_week.groupBy(KEY).agg(
        F.avg("n").alias("avg_weekly_txn_count"), F.sum("odd").alias("unusual_activity_days")
    )


def _sizes(txn: DataFrame) -> DataFrame:
    return txn.groupBy(KEY).agg(F.max("amount").alias("max_single_txn"), F.avg("amount").alias("avg_txn_size"))


def _large(txn: DataFrame, column: str, limits: DataFrame, limit: str) -> DataFrame:
    """Rows above the account's own limit: amounts are counted before they meet the limit, so
    a busy account sends its distinct amounts, already reduced."""
    amounts = txn.groupBy(KEY, column).agg(F.count(F.lit(1)).alias("__c"))
    hit = join_null_safe(amounts, limits, [KEY])
    return hit.groupBy(KEY).agg(
        F.sum(F.when(_c(column) > _c(limit), _c("__c")).otherwise(0)).alias("large_txn_count")
    )


def _velocity(txn: DataFrame, m: DataFrame, large: DataFrame) -> DataFrame:
    wide = _side_by_side(_count_months(m), _count_days(txn), _sizes(txn), large)
    return wide.withColumn("large_txn_pct", _over(_zero(_c("large_txn_count"), 0).cast("double"), _c("total_txn_count")))


def velocity_features(txn: DataFrame) -> DataFrame:
    large = _row_quantiles(txn, {"__p90": ("amount", 0.9)}, large="__p90").select(KEY, "large_txn_count")
    return _velocity(txn, monthly(txn), large).select(KEY, *[_default(c) for c in VELOCITY_COLUMNS])


def _regularity(m: DataFrame) -> DataFrame:
    s = m.where(_c("spend_n") > 0).groupBy(KEY).agg(
        F.avg("spend_n").alias("__m"), _zero(F.stddev_samp("spend_n")).alias("__s")
    )
    return s.select(KEY, clip(1 - _over(_c("__s"), _c("__m")), 0, 1).alias("spending_regularity"))


def _habits(txn: DataFrame) -> DataFrame:
    hour = F.hour("transaction_date")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    with_channel = F.count("channel")
    return txn.groupBy(KEY).agg(
        F.avg(hour).alias("txn_hour_mean"),
        _zero(F.stddev_samp(hour)).alias("txn_hour_std"),
        share((hour >= 22) | (hour <= 5)).alias("night_txn_pct"),
        share(F.weekday("transaction_date") >= 5).alias("weekend_txn_pct"),
        F.avg(
            F.when(is_spend(), F.when(F.dayofmonth("transaction_date") >= 25, 1.0).otherwise(0.0))
        ).alias("month_end_spend_pct"),
        *[
            _zero(F.try_divide(_count(_c("channel") == c).cast("double"), with_channel)).alias(f"channel_{c}_pct")
            for c in CHANNELS
        ],
    )


def _merchants(txn: DataFrame) -> DataFrame:
    """Distinct merchants in two steps, both with partial aggregation."""
    per = txn.where(_c("merchant_name").isNotNull()).groupBy(KEY, "merchant_name").agg(F.count(F.lit(1)).alias("__c"))
    sums = per.groupBy(KEY).agg(F.count(F.lit(1)).alias("unique_merchant_count"), F.sum("__c").alias("__with"))
    return sums.select(
        KEY,
        "unique_merchant_count",
        _over(_c("unique_merchant_count").cast("double"), _c("__with")).alias("merchant_diversity"),
    )


def behavioral_features(txn: DataFrame) -> DataFrame:
    wide = _side_by_side(_habits(txn), _merchants(txn), _regularity(monthly(txn)))
    return wide.select(KEY, *[_default(c) for c in BEHAVIORAL_COLUMNS])


def _account_pass(txn: DataFrame) -> DataFrame:
    """Everything that is one aggregate over the rows of an account."""
    emi = _c("transaction_type") == "emi_payment"
    spend, b, hour = is_spend(), _c("balance_after"), F.hour("transaction_date")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    base = txn.groupBy(KEY).agg(
        _sum(spend).alias("total_spend"),
        _count(spend).alias("num_spend_txns"),
        _zero(_sum(spend & _c("category").isin(*ESSENTIAL))).alias("essential_spend_total"),
        _zero(_sum(spend & _c("category").isin(*DISCRETIONARY))).alias("__discretionary"),
        *[_zero(_sum(spend & (_c("category") == c))).alias(f"spend_category_{c}") for c in CATEGORIES],
        F.nullif(_count(emi), F.lit(0)).alias("total_emi_count"),
        _sum(emi).alias("total_emi_amount"),
        F.avg(F.when(emi, F.when(_c("verification_status") == "verified", 1.0).otherwise(0.0))).alias(
            "on_time_payment_rate"
        ),
        F.avg(b).alias("avg_balance"),
        F.min(b).alias("min_balance"),
        F.max(b).alias("max_balance"),
        _zero(F.stddev_samp(b)).alias("balance_std"),
        _count(b < 0).alias("negative_balance_days"),
        F.avg(F.when(b.isNotNull(), F.when(b < 0, 1.0).otherwise(0.0))).alias("negative_balance_pct"),
        _count(b < LOW_BALANCE).alias("low_balance_days"),
        F.avg(F.when(b.isNotNull(), F.when(b < LOW_BALANCE, 1.0).otherwise(0.0))).alias("low_balance_pct"),
        F.max("amount").alias("max_single_txn"),
        F.avg("amount").alias("avg_txn_size"),
        F.avg(hour).alias("txn_hour_mean"),
        _zero(F.stddev_samp(hour)).alias("txn_hour_std"),
        share((hour >= 22) | (hour <= 5)).alias("night_txn_pct"),
        share(F.weekday("transaction_date") >= 5).alias("weekend_txn_pct"),
        F.avg(F.when(spend, F.when(F.dayofmonth("transaction_date") >= 25, 1.0).otherwise(0.0))).alias(
            "month_end_spend_pct"
        ),
        F.count("channel").alias("__with_channel"),
        *[_count(_c("channel") == c).alias(f"__n_{c}") for c in CHANNELS],
    )
    both = _c("essential_spend_total") + _c("__discretionary")
    return base.withColumns(
        {
            "essential_spend_ratio": _over(_c("essential_spend_total"), both),
            "discretionary_spend_ratio": _over(_c("__discretionary"), both),
            **{
                f"spend_category_{c}_pct": _over(_c(f"spend_category_{c}"), _zero(_c("total_spend"))) for c in CATEGORIES
            },
            "balance_range": _c("max_balance") - _c("min_balance"),
            "balance_volatility": _over(_c("balance_std"), F.abs(_c("avg_balance"))),
            **{
                f"channel_{c}_pct": _zero(F.try_divide(_c(f"__n_{c}").cast("double"), _c("__with_channel")))
                for c in CHANNELS
            },
        }
    )


def _day_pass(txn: DataFrame) -> DataFrame:
    """(account, day) sums that months and weeks are summed from."""
    spend, income = is_spend(), is_income()
    card = (_c("transaction_type") == "debit") & _c("channel").isin("CARD", "UPI")
    return txn.groupBy(KEY, F.date_trunc("day", _c("transaction_date")).alias("day")).agg(
        _sum(income).alias("income"),
        _sum(income & (_c("category") == "salary")).alias("salary"),
        _sum(_c("transaction_type") == "credit").alias("credit"),
        _sum(spend).alias("spend"),
        _count(spend).alias("spend_n"),
        _sum(card).alias("card"),
        _sum(_c("transaction_type") == "emi_payment").alias("emi"),
        F.count(F.lit(1)).alias("n"),
    )


def _month_pass(days: DataFrame) -> DataFrame:
    """All monthly statistics from one window and one aggregate per account."""
    m = days.groupBy(KEY, F.date_trunc("month", _c("day")).alias("month")).agg(
        *[F.sum(c).alias(c) for c in ("income", "salary", "credit", "spend", "spend_n", "card", "emi", "n")]
    )
    w = Window.partitionBy(KEY)
    up = w.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    flows = _c("credit").isNotNull() | _c("spend").isNotNull()
    net = F.when(flows, _zero(_c("credit")) - _zero(_c("spend")))
    s = m.withColumn("net", net).withColumns(
        {
            "k": F.count("income").over(up),
            "months": F.count("income").over(w),
            "flow_k": F.when(flows, (F.count("net").over(up) - 1).cast("double")),
            "step": F.abs(_c("net") - F.last("net", ignorenulls=True).over(before)),
            "flow_credit": F.when(flows, _zero(_c("credit"))),
            "income_rank": F.row_number().over(w.orderBy(_c("income").asc_nulls_last())),
            "spend_rank": F.row_number().over(w.orderBy(_c("spend").asc_nulls_last())),
            "spend_months": F.count("spend").over(w),
        }
    )

    def middle(value: str, rank: str, count: str) -> Column:
        """Median as the mean of the one or two middle rows."""
        return F.avg(F.when((_c(rank) >= _c(count) / 2) & (_c(rank) <= _c(count) / 2 + 1), _c(value)))

    half = F.floor(_c("months") / 2)
    spend_n = F.when(_c("spend_n") > 0, _c("spend_n"))
    per = s.groupBy(KEY).agg(
        F.avg("income").alias("avg_monthly_income"),
        middle("income", "income_rank", "months").alias("median_monthly_income"),
        F.max("income").alias("max_monthly_income"),
        F.min("income").alias("min_monthly_income"),
        _zero(F.stddev_samp("income")).alias("income_std"),
        F.avg(F.when(_c("income").isNotNull() & (_c("k") <= half), _c("income"))).alias("__first"),
        F.avg(F.when(_c("income").isNotNull() & (_c("k") > half), _c("income"))).alias("__second"),
        F.avg(F.when(_c("income").isNotNull(), _over(_zero(_c("salary")), _c("income")))).alias("salary_consistency"),
        F.sum("income").alias("total_income"),
        F.count("income").alias("num_income_months"),
        F.avg("spend").alias("avg_monthly_spend"),
        middle("spend", "spend_rank", "spend_months").alias("median_monthly_spend"),
        F.max("spend").alias("max_monthly_spend"),
        _zero(F.stddev_samp("spend")).alias("spend_std"),
        F.avg("emi").alias("avg_monthly_emi"),
        F.max("emi").alias("max_monthly_emi"),
        F.count("emi").alias("__emi_months"),
        F.avg("net").alias("avg_monthly_cash_flow"),
        F.sum("net").alias("total_cash_flow"),
        _zero(F.stddev_samp("net")).alias("cash_flow_std"),
        _count(_c("net") > 0).alias("positive_cash_flow_months"),
        _count(_c("net") < 0).alias("negative_cash_flow_months"),
        F.avg("flow_credit").alias("__credit"),
        F.regr_slope("net", "flow_k").alias("__slope"),
        F.stddev_pop("step").alias("__steps"),
        F.count("net").alias("__flow_n"),
        _zero(F.sum("card")).alias("total_card_spend"),
        _zero(F.sum("spend")).alias("__all_spend"),
        _zero(F.avg("spend")).alias("avg_monthly_total_spend"),
        F.avg("n").alias("avg_monthly_txn_count"),
        F.max("n").alias("max_monthly_txn_count"),
        F.sum("n").alias("total_txn_count"),
        _zero(F.stddev_samp("n")).alias("txn_count_std"),
        F.avg(spend_n).alias("__spend_m"),
        _zero(F.stddev_samp(spend_n)).alias("__spend_s"),
    )
    stability = clip(1 - _over(_c("income_std"), _c("avg_monthly_income")), 0, 1)
    growth = _over(_c("__second") - _c("__first"), _c("__first"))
    return per.withColumns(
        {
            "income_stability": F.when(_c("avg_monthly_income") > 0, stability).otherwise(F.lit(0.0)),
            "income_growth_rate": F.when(_c("num_income_months") >= 2, growth).otherwise(F.lit(0.0)),
            "cash_flow_volatility": _over(_c("cash_flow_std"), F.abs(_c("avg_monthly_cash_flow"))),
            "cash_flow_to_income_ratio": _over(_c("avg_monthly_cash_flow"), _c("__credit")),
            "cash_flow_trend": F.when(_c("__flow_n") >= 3, _c("__slope")).otherwise(F.lit(0.0)),
            "cash_flow_seasonal_volatility": F.when(_c("__flow_n") > 3, _c("__steps")).otherwise(F.lit(0.0)),
            "spending_regularity": clip(1 - _over(_c("__spend_s"), _c("__spend_m")), 0, 1),
        }
    )


def transaction_features(txn: DataFrame) -> DataFrame:
    """All groups in one job: one account pass, one day pass that months and weeks are summed
    from, the distinct pairs, and the row quantiles. All joins are on the account, which the
    parts are already partitioned by."""
    days = _day_pass(txn)
    q = _row_quantiles(txn, {"median_balance": ("balance_after", 0.5), "__p90": ("amount", 0.9)}, large="__p90")
    emi_loans = (
        txn.where((_c("transaction_type") == "emi_payment") & _c("loan_id").isNotNull())
        .select(KEY, "loan_id", _month().alias("month"))
        .distinct()
        .groupBy(KEY, "loan_id")
        .agg(F.count(F.lit(1)).alias("months"))
        .groupBy(KEY)
        .agg(F.max("months").alias("max_consecutive_emi"))
    )
    wide = _side_by_side(
        _account_pass(txn), _month_pass(days), _day_stats(days), emi_loans, _merchants(txn), q
    )
    wide = wide.withColumn(
        "large_txn_pct", _over(_zero(_c("large_txn_count"), 0).cast("double"), _c("total_txn_count"))
    )
    return _card_ratios(_emi_ratios(wide)).select(KEY, *[_default(c) for c in ALL_COLUMNS])


def window_history(txn: DataFrame, days: int, reference: Column) -> DataFrame:
    """Transactions of the last `days` days before the reference time."""
    start = reference - F.make_dt_interval(F.lit(days))
    return txn.where((_c("transaction_date") >= start) & (_c("transaction_date") <= reference))
