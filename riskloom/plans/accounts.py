"""Account features on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import account as A
from riskloom.plans.registry import case
from riskloom.plans.tables import Tables
from riskloom.session import cut_lineage

ALL = "(select distinct account_id from transactions)"
SPEND = "transaction_type in ('debit', 'emi_payment', 'fee')"
INCOME = "transaction_type = 'credit' and category in ('salary', 'business', 'transfer')"

INCOME_CTE = f"""inc as (select account_id, date_trunc('month', transaction_date) as mon, sum(amount) as v,
    sum(case when category = 'salary' then amount else 0e0 end) as sal from transactions where {INCOME} group by 1, 2),
  incr as (select *, row_number() over (partition by account_id order by mon) as k, count(*) over (partition by account_id) as n from inc),
  income as (select account_id, avg(v) as avg_monthly_income, median(v) as median_monthly_income, max(v) as max_monthly_income,
    min(v) as min_monthly_income, coalesce(stddev_samp(v), 0e0) as income_std,
    least(greatest(1 - coalesce(stddev_samp(v), 0e0) / (avg(v) + 1e-8), 0e0), 1e0) as income_stability,
    case when count(*) >= 2 then (avg(case when k > n // 2 then v end) - avg(case when k <= n // 2 then v end)) / (avg(case when k <= n // 2 then v end) + 1e-8) else 0e0 end as income_growth_rate,
    avg(sal / (v + 1e-8)) as salary_consistency, sum(v) as total_income, count(*) as num_income_months from incr group by account_id)"""


def pick(cols, rel: str) -> str:
    out = []
    for c in cols:
        d = "1e0" if c == "on_time_payment_rate" else "0" if c in A.COUNT_COLUMNS else "0e0"
        x = f"coalesce({rel}.{c}, {d})"
        out.append(f"cast({x} as bigint) as {c}" if c in A.COUNT_COLUMNS else f"{x} as {c}")
    return ", ".join(out)


def doubles(cols, money=()) -> dict[str, str]:
    d = [c for c in cols if c not in A.COUNT_COLUMNS]
    return {"r6": " ".join(c for c in d if c not in money), "r2": " ".join(c for c in d if c in money)}


INCOME_MONEY = ("avg_monthly_income", "median_monthly_income", "max_monthly_income", "min_monthly_income", "income_std", "total_income")


@case(
    "t1_income_features",
    f"with {INCOME_CTE} select a.account_id, {pick(A.INCOME_COLUMNS, 'i')} from {ALL} a left join income i on a.account_id = i.account_id",
    **doubles(A.INCOME_COLUMNS, INCOME_MONEY),
)
def _(t: Tables):
    return A.income_features(t.transactions)


SPEND_CTE = f"""spm as (select account_id, date_trunc('month', transaction_date) as mon, sum(amount) as v from transactions where {SPEND} group by 1, 2),
  sp1 as (select account_id, avg(v) as avg_monthly_spend, median(v) as median_monthly_spend, max(v) as max_monthly_spend,
    coalesce(stddev_samp(v), 0e0) as spend_std from spm group by account_id),
  sp2 as (select account_id, sum(amount) as total_spend, count(*) as num_spend_txns,
    sum(case when category in ('groceries', 'rent', 'utilities', 'medical', 'education') then amount else 0e0 end) as ess,
    sum(case when category in ('entertainment', 'other') then amount else 0e0 end) as dis,
    {", ".join(f"sum(case when category = '{c}' then amount else 0e0 end) as spend_category_{c}" for c in A.CATEGORIES)}
    from transactions where {SPEND} group by account_id),
  spending as (select sp2.account_id, avg_monthly_spend, median_monthly_spend, max_monthly_spend, spend_std, total_spend, num_spend_txns,
    ess / (ess + dis + 1e-8) as essential_spend_ratio, dis / (ess + dis + 1e-8) as discretionary_spend_ratio, ess as essential_spend_total,
    {", ".join(f"spend_category_{c}" for c in A.CATEGORIES)},
    {", ".join(f"spend_category_{c} / (total_spend + 1e-8) as spend_category_{c}_pct" for c in A.CATEGORIES)}
    from sp2 join sp1 on sp1.account_id = sp2.account_id)"""
SPEND_MONEY = (
    "avg_monthly_spend", "median_monthly_spend", "max_monthly_spend", "spend_std", "total_spend", "essential_spend_total",
    *[f"spend_category_{c}" for c in A.CATEGORIES],
)


@case(
    "t2_spending_features",
    f"with {SPEND_CTE} select a.account_id, {pick(A.SPENDING_COLUMNS, 's')} from {ALL} a left join spending s on a.account_id = s.account_id",
    **doubles(A.SPENDING_COLUMNS, SPEND_MONEY),
)
def _(t: Tables):
    return A.spending_features(t.transactions)


EMI_CTE = """emm as (select account_id, date_trunc('month', transaction_date) as mon, sum(amount) as v from transactions where transaction_type = 'emi_payment' group by 1, 2),
  em1 as (select account_id, avg(v) as avg_monthly_emi, max(v) as max_monthly_emi, count(*) as months from emm group by account_id),
  em2 as (select account_id, count(*) as total_emi_count, sum(amount) as total_emi_amount,
    avg(case when verification_status = 'verified' then 1e0 else 0e0 end) as on_time_payment_rate from transactions where transaction_type = 'emi_payment' group by account_id),
  em3 as (select account_id, max(c) as max_consecutive_emi from (select account_id, loan_id, count(distinct date_trunc('month', transaction_date)) as c
    from transactions where transaction_type = 'emi_payment' and loan_id is not null group by 1, 2) z group by account_id),
  emi as (select em2.account_id, total_emi_count, total_emi_amount, avg_monthly_emi, max_monthly_emi, on_time_payment_rate,
    avg_monthly_emi / (coalesce(i.avg_monthly_income, 0e0) + 1e-8) as emi_to_income_ratio,
    total_emi_amount / (coalesce(i.total_income, 0e0) + 1e-8) as total_emi_to_income_ratio, coalesce(max_consecutive_emi, 0) as max_consecutive_emi,
    greatest(coalesce(max_consecutive_emi, 0) - months, 0) as missed_payment_count
    from em2 join em1 on em1.account_id = em2.account_id left join em3 on em3.account_id = em2.account_id left join income i on i.account_id = em2.account_id)"""
EMI_MONEY = ("total_emi_amount", "avg_monthly_emi", "max_monthly_emi", "emi_to_income_ratio", "total_emi_to_income_ratio")


@case(
    "t3_emi_features",
    f"with {INCOME_CTE}, {EMI_CTE} select a.account_id, {pick(A.EMI_COLUMNS, 'e')} from {ALL} a left join emi e on a.account_id = e.account_id",
    **doubles(A.EMI_COLUMNS, EMI_MONEY),
)
def _(t: Tables):
    return A.emi_features(t.transactions)


BALANCE_CTE = """balance as (select account_id, avg(balance_after) as avg_balance, median(balance_after) as median_balance, min(balance_after) as min_balance,
    max(balance_after) as max_balance, coalesce(stddev_samp(balance_after), 0e0) as balance_std, max(balance_after) - min(balance_after) as balance_range,
    count(case when balance_after < 0 then 1 end) as negative_balance_days, avg(case when balance_after < 0 then 1e0 else 0e0 end) as negative_balance_pct,
    count(case when balance_after < 1000 then 1 end) as low_balance_days, avg(case when balance_after < 1000 then 1e0 else 0e0 end) as low_balance_pct,
    coalesce(stddev_samp(balance_after), 0e0) / (abs(avg(balance_after)) + 1e-8) as balance_volatility from transactions group by account_id)"""
BALANCE_MONEY = ("avg_balance", "median_balance", "min_balance", "max_balance", "balance_std", "balance_range")


@case(
    "t4_balance_features",
    f"with {BALANCE_CTE} select a.account_id, {pick(A.BALANCE_COLUMNS, 'b')} from {ALL} a left join balance b on a.account_id = b.account_id",
    **doubles(A.BALANCE_COLUMNS, BALANCE_MONEY),
)
def _(t: Tables):
    return A.balance_features(t.transactions)


CASH_CTE = f"""cfm as (select account_id, date_trunc('month', transaction_date) as mon, sum(case when transaction_type = 'credit' then amount else 0e0 end) as cr,
    sum(case when transaction_type = 'credit' then amount when {SPEND} then -amount else 0e0 end) as net from transactions
    where transaction_type = 'credit' or {SPEND} group by 1, 2),
  cfk as (select *, cast(row_number() over w - 1 as double) as k, abs(net - lag(net) over w) as step from cfm window w as (partition by account_id order by mon)),
  cash as (select account_id, avg(net) as avg_monthly_cash_flow, sum(net) as total_cash_flow, coalesce(stddev_samp(net), 0e0) as cash_flow_std,
    coalesce(stddev_samp(net), 0e0) / (abs(avg(net)) + 1e-8) as cash_flow_volatility, count(case when net > 0 then 1 end) as positive_cash_flow_months,
    count(case when net < 0 then 1 end) as negative_cash_flow_months, avg(net) / (avg(cr) + 1e-8) as cash_flow_to_income_ratio,
    case when count(*) >= 3 then regr_slope(net, k) else 0e0 end as cash_flow_trend,
    case when count(*) > 3 then stddev_pop(step) else 0e0 end as cash_flow_seasonal_volatility from cfk group by account_id)"""
CASH_MONEY = ("avg_monthly_cash_flow", "total_cash_flow", "cash_flow_std", "cash_flow_trend", "cash_flow_seasonal_volatility", "cash_flow_to_income_ratio")


@case(
    "t5_cash_flow_features",
    f"with {CASH_CTE} select a.account_id, {pick(A.CASH_FLOW_COLUMNS, 'c')} from {ALL} a left join cash c on a.account_id = c.account_id",
    r6="",
    r4="cash_flow_volatility",
    r2=" ".join(CASH_MONEY),
)
def _(t: Tables):
    return A.cash_flow_features(t.transactions)


UTIL_CTE = f"""utm as (select account_id, date_trunc('month', transaction_date) as mon, sum(case when {SPEND} then amount end) as sp,
    sum(case when transaction_type = 'debit' and channel in ('CARD', 'UPI') then amount end) as card from transactions group by 1, 2),
  utl as (select account_id, coalesce(sum(card), 0e0) as total_card_spend, coalesce(sum(sp), 0e0) as sp, coalesce(avg(sp), 0e0) as avg_monthly_total_spend from utm group by account_id),
  util as (select utl.account_id, total_card_spend, total_card_spend / (sp + 1e-8) as card_spend_pct,
    total_card_spend / (coalesce(i.avg_monthly_income, 0e0) + 1e-8) as credit_utilization_to_income, avg_monthly_total_spend,
    case when avg_monthly_total_spend > 0 then avg_monthly_total_spend / (coalesce(i.avg_monthly_income, 0e0) + 1e-8) else 0e0 end as spend_to_income_ratio
    from utl left join income i on i.account_id = utl.account_id)"""
UTIL_MONEY = ("total_card_spend", "credit_utilization_to_income", "avg_monthly_total_spend", "spend_to_income_ratio")


@case(
    "t6_credit_utilization",
    f"with {INCOME_CTE}, {UTIL_CTE} select a.account_id, {pick(A.UTILIZATION_COLUMNS, 'u')} from {ALL} a left join util u on a.account_id = u.account_id",
    **doubles(A.UTILIZATION_COLUMNS, UTIL_MONEY),
)
def _(t: Tables):
    return A.credit_utilization(t.transactions)


def velocity_cte(src: str) -> str:
    return f"""vm as (select account_id, date_trunc('month', transaction_date) as mon, count(*) as n from {src} group by 1, 2),
  v1 as (select account_id, avg(n) as avg_monthly_txn_count, max(n) as max_monthly_txn_count, cast(sum(n) as bigint) as total_txn_count, coalesce(stddev_samp(n), 0e0) as txn_count_std from vm group by account_id),
  v2 as (select account_id, avg(n) as avg_weekly_txn_count from (select account_id, date_trunc('week', transaction_date) as wk, count(*) as n from {src} group by 1, 2) z group by account_id),
  vp as (select account_id, quantile_cont(amount, 0.9) as p90, max(amount) as max_single_txn, avg(amount) as avg_txn_size from {src} group by account_id),
  v3 as (select x.account_id, count(*) as large_txn_count from {src} x join vp on vp.account_id = x.account_id where x.amount > vp.p90 group by x.account_id),
  vd as (select account_id, cast(transaction_date as date) as d, count(*) as n from {src} group by 1, 2),
  vs as (select account_id, avg(n) as m, stddev_samp(n) as s from vd group by account_id),
  v4 as (select vd.account_id, count(*) as unusual_activity_days from vd join vs on vs.account_id = vd.account_id where vs.s > 0 and vd.n > vs.m + 2 * vs.s group by vd.account_id),
  velocity as (select v1.account_id, avg_monthly_txn_count, max_monthly_txn_count, total_txn_count, txn_count_std, avg_weekly_txn_count, large_txn_count,
    coalesce(large_txn_count, 0) / (total_txn_count + 1e-8) as large_txn_pct, max_single_txn, avg_txn_size, unusual_activity_days
    from v1 join v2 on v1.account_id = v2.account_id join vp on v1.account_id = vp.account_id left join v3 on v1.account_id = v3.account_id left join v4 on v1.account_id = v4.account_id)"""


VELOCITY_MONEY = ("max_single_txn", "avg_txn_size")


@case(
    "t7_velocity_features",
    f"with {velocity_cte('transactions')} select account_id, {pick(A.VELOCITY_COLUMNS, 'velocity')} from velocity",
    **doubles(A.VELOCITY_COLUMNS, VELOCITY_MONEY),
)
def _(t: Tables):
    return A.velocity_features(cut_lineage(t.transactions))


def behavior_cte(src: str) -> str:
    return f"""bm as (select account_id, date_trunc('month', transaction_date) as mon, count(*) as n from {src} where {SPEND} group by 1, 2),
  b1 as (select account_id, least(greatest(1 - coalesce(stddev_samp(n), 0e0) / (avg(n) + 1e-8), 0e0), 1e0) as spending_regularity from bm group by account_id),
  b2 as (select account_id, count(distinct merchant_name) as unique_merchant_count, count(distinct merchant_name) / (count(merchant_name) + 1e-8) as merchant_diversity,
    avg(extract(hour from transaction_date)) as txn_hour_mean, coalesce(stddev_samp(extract(hour from transaction_date)), 0e0) as txn_hour_std,
    avg(case when extract(hour from transaction_date) >= 22 or extract(hour from transaction_date) <= 5 then 1e0 else 0e0 end) as night_txn_pct,
    avg(case when extract(isodow from transaction_date) >= 6 then 1e0 else 0e0 end) as weekend_txn_pct,
    avg(case when {SPEND} then case when extract(day from transaction_date) >= 25 then 1e0 else 0e0 end end) as month_end_spend_pct,
    {", ".join(f"count(case when channel = '{c}' then 1 end) / cast(count(channel) as double) as channel_{c}_pct" for c in A.CHANNELS)} from {src} group by account_id),
  behavior as (select b2.*, b1.spending_regularity from b2 left join b1 on b1.account_id = b2.account_id)"""


@case(
    "t8_behavioral_features",
    f"with {behavior_cte('transactions')} select account_id, {pick(A.BEHAVIORAL_COLUMNS, 'behavior')} from behavior",
    **doubles(A.BEHAVIORAL_COLUMNS),
)
def _(t: Tables):
    return A.behavioral_features(t.transactions)


@case(
    "t8_behavioral_events",
    f"with {behavior_cte('events_txn')} select account_id, {pick(A.BEHAVIORAL_COLUMNS, 'behavior')} from behavior",
    **doubles(A.BEHAVIORAL_COLUMNS),
)
def _(t: Tables):
    return A.behavioral_features(t.events_txn)


ALL_MONEY = {*INCOME_MONEY, *SPEND_MONEY, *EMI_MONEY, *BALANCE_MONEY, *CASH_MONEY, *UTIL_MONEY, *VELOCITY_MONEY}
_ALL_D = doubles([c for c in A.ALL_COLUMNS if c != "cash_flow_volatility"], ALL_MONEY)


@case(
    "t9_transaction_features",
    f"""with {INCOME_CTE}, {SPEND_CTE}, {EMI_CTE}, {BALANCE_CTE}, {CASH_CTE}, {UTIL_CTE}, {velocity_cte('transactions')}, {behavior_cte('transactions')}
    select a.account_id, {pick(A.INCOME_COLUMNS, 'i')}, {pick(A.SPENDING_COLUMNS, 's')}, {pick(A.EMI_COLUMNS, 'e')}, {pick(A.BALANCE_COLUMNS, 'b')},
      {pick(A.CASH_FLOW_COLUMNS, 'c')}, {pick(A.UTILIZATION_COLUMNS, 'u')}, {pick(A.VELOCITY_COLUMNS, 'v')}, {pick(A.BEHAVIORAL_COLUMNS, 'h')}
    from {ALL} a left join income i on a.account_id = i.account_id left join spending s on a.account_id = s.account_id
    left join emi e on a.account_id = e.account_id left join balance b on a.account_id = b.account_id left join cash c on a.account_id = c.account_id
    left join util u on a.account_id = u.account_id left join velocity v on a.account_id = v.account_id left join behavior h on a.account_id = h.account_id""",
    r4="cash_flow_volatility",
    **_ALL_D,
)
def _(t: Tables):
    # The view joins three tables: joined once, read by every pass.
    return A.transaction_features(cut_lineage(t.transactions))


@case(
    "t10_window_history",
    """select account_id, count(*) as n, max(transaction_date) as last_date from transactions
    where transaction_date >= timestamp '1998-06-01' - interval 180 day and transaction_date <= timestamp '1998-06-01' group by account_id""",
)
def _(t: Tables):
    ref = F.lit("1998-06-01").cast("timestamp_ntz")
    recent = A.window_history(t.transactions, 180, ref)
    return recent.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.max("transaction_date").alias("last_date"))
