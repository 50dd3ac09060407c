"""Series, concentration and survival queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import pricing as R
from riskloom.operators import series as S
from riskloom.operators.loan import default_label
from riskloom.plans.accounts import INCOME, SPEND
from riskloom.plans.loans import LABEL
from riskloom.plans.registry import case
from riskloom.plans.tables import Tables
from riskloom.session import cut_lineage

SERIES = f"""ms as (select account_id, cast(extract(year from transaction_date) * 12 + extract(month from transaction_date) as int) as m,
    coalesce(sum(case when transaction_type = 'credit' then amount end), 0e0) as credit, coalesce(sum(case when {SPEND} then amount end), 0e0) as spend,
    coalesce(sum(case when {INCOME} then amount end), 0e0) as income, avg(balance_after) as balance, count(*) as n,
    count(case when transaction_type = 'emi_payment' and verification_status = 'failed' then 1 end) as bounces from transactions group by 1, 2),
  sr as (select *, credit - spend as net from ms)"""


def series(t: Tables):
    return S.monthly_series(t.transactions)


def win(n: int) -> str:
    return f"(partition by account_id order by m range between {n - 1} preceding and current row)"


@case(
    "g1_rolling_stat",
    f"""with {SERIES} select account_id, m, avg(spend) over w as spend_mean_6m, stddev_samp(spend) over w as spend_std_6m, max(spend) over w as spend_max_6m, count(spend) over w as spend_count_6m
    from sr window w as {win(6)}""",
    r2="spend_mean_6m spend_std_6m spend_max_6m",
)
def _(t: Tables):
    df = series(t)
    for fn in ("mean", "std", "max", "count"):
        df = S.rolling_stat(df, "account_id", "spend", 6, fn)
    return df.select("account_id", "m", "spend_mean_6m", "spend_std_6m", "spend_max_6m", "spend_count_6m")


@case("g2_trend_slope", f"with {SERIES} select account_id, m, case when count(*) over w >= 2 then regr_slope(balance, cast(m as double)) over w end as balance_slope_12m from sr window w as {win(12)}", r2="balance_slope_12m")
def _(t: Tables):
    return S.trend_slope(series(t), "account_id", "balance", 12).select("account_id", "m", "balance_slope_12m")


@case(
    "g3_change_over",
    f"""with {SERIES} select a.account_id, a.m, a.balance - b.balance as balance_diff_3m, case when b.balance <> 0 then a.balance / b.balance end as balance_ratio_3m,
      (a.balance - b.balance) - (b.balance - c.balance) as balance_accel_3m from sr a left join sr b on a.account_id = b.account_id and b.m = a.m - 3 left join sr c on a.account_id = c.account_id and c.m = a.m - 6""",
    r2="balance_diff_3m balance_accel_3m",
    r4="balance_ratio_3m",
)
def _(t: Tables):
    return S.change_over(series(t), "account_id", "balance", 3).select("account_id", "m", "balance_diff_3m", "balance_ratio_3m", "balance_accel_3m")


@case(
    "g4_variation",
    f"""with {SERIES}, r as (select account_id, m, percent_rank() over (partition by account_id order by balance) as r from sr)
    select s.account_id, coalesce(stddev_samp(balance), 0e0) / abs(avg(balance)) as cv, greatest(least(1 - coalesce(stddev_samp(balance), 0e0) / (abs(avg(balance)) + 1e-8), 1e0), 0e0) as stability_index,
      case when max(balance) <> 0 then (max(balance) - min(balance)) / max(balance) end as peak_to_trough, count(case when balance = 0 then 1 end) as zero_months, case when max(balance) <> 0 then min(balance) / max(balance) end as weakest_to_best,
      max_by(balance, s.m) as last_value, count(*) as months, max_by(r.r, s.m) as percentile_in_history from sr s join r on r.account_id = s.account_id and r.m = s.m group by s.account_id""",
    r6="cv stability_index peak_to_trough weakest_to_best percentile_in_history",
    r2="last_value",
)
def _(t: Tables):
    return S.variation(series(t), "account_id", "balance")


@case(
    "g5_max_drawdown",
    f"""with {SERIES}, p as (select account_id, balance, max(balance) over (partition by account_id order by m) as peak from sr)
    select account_id, max(peak - balance) as max_drawdown, max(case when peak > 0 then (peak - balance) / peak end) as max_drawdown_share from p group by account_id""",
    r2="max_drawdown",
    r6="max_drawdown_share",
)
def _(t: Tables):
    return S.max_drawdown(series(t), "account_id", "balance")


@case(
    "g6_runs",
    f"""with {SERIES}, h as (select account_id, m - row_number() over (partition by account_id order by m) as g from sr where net < 0),
    l as (select account_id, g, count(*) as len from h group by 1, 2), f as (select account_id, max(len) as longest_run, avg(len) as mean_run, count(*) as runs from l group by 1)
    select a.account_id, coalesce(longest_run, 0) as longest_run, coalesce(mean_run, 0e0) as mean_run, coalesce(runs, 0) as runs from (select distinct account_id from sr) a left join f on f.account_id = a.account_id""",
    r6="mean_run",
)
def _(t: Tables):
    return S.runs(series(t), "account_id", F.col("net") < 0)


@case(
    "g7_diversity",
    """with c as (select account_id, category, count(*) as w from transactions group by 1, 2), s as (select account_id, w / cast(sum(w) over (partition by account_id) as double) as p from c)
    select account_id, sum(-p * ln(p)) as entropy, sum(p * p) as herfindahl from s group by account_id""",
    r6="entropy herfindahl",
)
def _(t: Tables):
    return S.diversity(t.transactions, "account_id", "category")


FEATURES = "select o_custkey as account_id, o_orderdate as seen_at, max(o_totalprice) as amount from orders group by 1, 2"
SNAPS = "select event_id as snapshot_id, user_id as account_id, timestamp '1994-01-01 00:00:00' + (event_id % 1500) * interval '1' day as seen_at from events"


@case(
    "g8_as_of",
    f"""with f as ({FEATURES}), s as ({SNAPS}) select s.snapshot_id, s.account_id, f.amount, f.seen_at as feature_time from s asof left join f on s.account_id = f.account_id and s.seen_at >= f.seen_at""",
    r2="amount",
)
def _(t: Tables):
    f = t.orders.groupBy(F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("seen_at")).agg(F.max("o_totalprice").alias("amount"))
    start = F.lit("1994-01-01 00:00:00").cast("timestamp_ntz")
    s = t.events.select(
        F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("account_id"),
        (start + F.make_dt_interval((F.col("event_id") % 1500).cast("int"))).alias("seen_at"),
    )
    return S.as_of(f, s, "account_id", "seen_at", "amount")


@case(
    "g9_ratio_features",
    f"""with x as (select account_id, coalesce(sum(case when transaction_type = 'emi_payment' then amount end), 0e0) as due, coalesce(sum(case when transaction_type = 'credit' then amount end), 0e0) as cr,
      coalesce(sum(case when {SPEND} then amount end), 0e0) as sp, coalesce(sum(case when {SPEND} and channel in ('CASH', 'ATM') then amount end), 0e0) as cash,
      coalesce(sum(case when {SPEND} and channel in ('UPI', 'IMPS', 'NEFT', 'RTGS', 'CARD') then amount end), 0e0) as dig,
      coalesce(max(case when {SPEND} and category = 'medical' then amount end) > 3 * avg(case when {SPEND} and category = 'medical' then amount end), false) as medical_spike,
      cast(count(distinct case when {INCOME} then category end) as int) as income_sources from transactions group by 1)
    select account_id, case when cr <> 0 then due / cr end as emi_to_credit, case when sp <> 0 then cr / sp end as coverage, case when sp <> 0 then cash / sp end as cash_share, case when sp <> 0 then dig / sp end as digital_share, medical_spike, income_sources from x""",
    r6="emi_to_credit coverage cash_share digital_share",
)
def _(t: Tables):
    return S.ratio_features(t.transactions)


@case(
    "g9_emi_rate_shock",
    """with b as (select loan_id, loan_amount as p, interest_rate / 1e2 as r, tenure_months as n from loans),
    e as (select loan_id, p * (r / 12) * power(1 + r / 12, n) / (power(1 + r / 12, n) - 1) as a, p * ((r + 2e-2) / 12) * power(1 + (r + 2e-2) / 12, n) / (power(1 + (r + 2e-2) / 12, n) - 1) as b from b)
    select loan_id, a as emi_base, b as emi_shocked, (b - a) / a as increase from e""",
    r4="emi_base emi_shocked",
    r6="increase",
)
def _(t: Tables):
    df = t.loans.select("loan_id", F.col("loan_amount").alias("principal"), (F.col("interest_rate") / 100.0).alias("annual_rate"), "tenure_months")
    return S.emi_rate_shock(df)


@case(
    "g10_timing",
    f"""with d as (select account_id, cast(transaction_date as date) as day, count(*) as n, count(case when transaction_type = 'credit' then 1 end) as c,
      count(case when {INCOME} and category = 'salary' then 1 end) as s, count(case when transaction_type = 'emi_payment' then 1 end) as e from transactions group by 1, 2),
    x as (select *, min(case when e > 0 then day end) over (partition by account_id order by day rows between current row and unbounded following) as nxt, lag(day) over (partition by account_id order by day) as prev from d)
    select account_id, coalesce(var_samp(case when c > 0 then extract(day from day) end), 0e0) as credit_day_variance, avg(case when s > 0 then date_diff('day', day, nxt) end) as salary_to_emi_days,
      sum(case when extract(month from day) in (3, 6, 9, 12) then n else 0 end) / cast(sum(n) as double) as quarter_end_share, cast(coalesce(max(date_diff('day', prev, day)), 0) as int) as longest_dormancy,
      cast(date_diff('day', min(day), max(day)) as int) as tenure_days from x group by account_id""",
    r6="credit_day_variance salary_to_emi_days quarter_end_share",
)
def _(t: Tables):
    return S.timing(t.transactions)


@case(
    "g10_modal_day",
    """with c as (select account_id, cast(extract(day from transaction_date) as int) as d, count(*) as n from transactions where transaction_type = 'credit' group by 1, 2)
    select account_id, d as modal_credit_day from (select *, row_number() over (partition by account_id order by n desc, d) as k from c) z where k = 1""",
)
def _(t: Tables):
    return S.modal_day(t.transactions)


@case(
    "g11_cross_terms",
    "select loan_id, debt_to_income * interest_rate as debt_to_income_x_interest_rate, credit_score * employment_length as credit_score_x_employment_length from loans",
    r6="debt_to_income_x_interest_rate",
)
def _(t: Tables):
    out = S.cross_terms(t.loans, [("debt_to_income", "interest_rate"), ("credit_score", "employment_length")])
    return out.select("loan_id", "debt_to_income_x_interest_rate", "credit_score_x_employment_length")


@case(
    "g12_neighbor_rate",
    f"""with l as (select loan_id, customer_id, {LABEL} as y from loans), g as (select customer_id, sum(y) as s, count(*) as n from l group by 1)
    select loan_id, l.customer_id, y, case when n > 1 then (s - y) / cast(n - 1 as double) end as customer_id_neighbor_rate, s - y > 0 as customer_id_any_neighbor from l join g on g.customer_id = l.customer_id""",
    r6="customer_id_neighbor_rate",
)
def _(t: Tables):
    df = default_label(t.loans, out="y").select("loan_id", "customer_id", "y")
    return S.neighbor_rate(df, "customer_id", "y")


@case(
    "g13_early_warning",
    f"""with {SERIES}, x as (select sr.*, b.balance as before, coalesce(sum(sr.bounces) over (partition by sr.account_id order by sr.m rows between unbounded preceding and 1 preceding), 0) as earlier,
      avg(sr.income) over (partition by sr.account_id order by sr.m range between 6 preceding and 1 preceding) as mean from sr left join sr b on b.account_id = sr.account_id and b.m = sr.m - 3),
    f as (select account_id, m, coalesce(before > 0 and balance < before * 7e-1, false) as balance_drop, coalesce(credit > 0 and spend > credit * 7e-1, false) as high_utilization, bounces >= 3 as bounce_spike,
      bounces > 0 and earlier = 0 as first_bounce, coalesce(abs(income - mean) > mean * 5e-1, false) as irregular_income from x)
    select *, balance_drop::int + high_utilization::int + bounce_spike::int + first_bounce::int + irregular_income::int as warning_count from f""",
)
def _(t: Tables):
    return S.early_warning(series(t)).drop("credit", "spend", "net", "income", "balance", "n", "bounces")


STATE = "case when net > 0 then 'current' when net > -5e4 then 'late' else 'default' end"


@case(
    "g14_transitions",
    f"""with {SERIES}, s as (select account_id, {STATE} as st, lag({STATE}) over (partition by account_id order by m) as pv from sr), n as (select pv as from_state, st as to_state, count(*) as n from s where pv is not null group by 1, 2)
    select *, n / cast(sum(n) over (partition by from_state) as double) as share from n""",
    r6="share",
)
def _(t: Tables):
    net = F.col("net")
    df = series(t).withColumn("state", F.when(net > 0, "current").when(net > -50000.0, "late").otherwise("default"))
    return S.transitions(df, "account_id", "state")


@case(
    "g13_inquiry_spike",
    """select event_id, user_id, ts, count(*) over (partition by user_id order by ts range between interval 30 days preceding and current row) as n_in_range,
      count(*) over (partition by user_id order by ts range between interval 30 days preceding and current row) >= 3 as spike
    from events where event_type = 'error' and ts is not null""",
)
def _(t: Tables):
    errors = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return S.range_counts(errors, "user_id", "ts").where("ts is not null")


@case(
    "g15_concentration_sets",
    """with l as (
      select loan_type, borrower_segment, risk_grade, coalesce(loan_amount::double, 0) as x,
        coalesce(loan_amount * 1e-1 * (case when loan_type in ('mortgage', 'auto') then 25e-2 else 45e-2 end), 0) as el
      from loans
    ),
    s as (select l.*, v.shock_bps from l, (values (0), (100), (200), (300)) v(shock_bps)),
    c as (
      select case grouping(loan_type, borrower_segment, risk_grade, shock_bps) when 6 then 'loan_type' when 10 then 'borrower_segment'
          when 12 then 'risk_grade' when 2 then 'loan_type,borrower_segment' when 14 then 'ALL' end as level,
        loan_type, borrower_segment, risk_grade, shock_bps, sum(x) as exposure, count(*) as loans,
        sum(least(x, el * (1 + 1e-1 * shock_bps / 1e2))) as expected_loss
      from s group by grouping sets ((loan_type, shock_bps), (borrower_segment, shock_bps), (risk_grade, shock_bps), (loan_type, borrower_segment, shock_bps), (shock_bps))
    ),
    r as (select *, exposure / sum(exposure) over (partition by level, shock_bps) as share from c),
    k as (
      select *, sum(share * share) over (partition by level, shock_bps) as hhi,
        row_number() over (partition by level, shock_bps order by exposure desc, loan_type nulls first, borrower_segment nulls first, risk_grade nulls first) as rank
      from r
    )
    select *, rank <= 5 as top from k""",
    r2="exposure expected_loss",
    r6="share hhi",
)
def _(t: Tables):
    lgd = F.when(F.col("loan_type").isin("mortgage", "auto"), 0.25).otherwise(0.45)
    df = t.loans.withColumn("el", F.col("loan_amount") * 0.1 * lgd)
    dims = ["loan_type", "borrower_segment", "risk_grade"]
    sets = [["loan_type"], ["borrower_segment"], ["risk_grade"], ["loan_type", "borrower_segment"], []]
    return S.concentration_sets(df, dims, sets, "loan_amount", "el")


@case(
    "g15_concentration",
    """with l as (select loan_type, loan_amount, loan_amount * 1e-1 * (case when loan_type in ('mortgage', 'auto') then 25e-2 else 45e-2 end) as el from loans),
    r as (select coalesce(loan_type, 'ALL') as segment, sum(loan_amount) as exposure, sum(el) as expected_loss, count(*) as loans from l group by rollup (loan_type)),
    t as (select exposure as total from r where segment = 'ALL')
    select r.*, exposure / total as share, (select sum(power(exposure / total, 2)) from r, t where segment <> 'ALL') as hhi from r, t""",
    r2="exposure expected_loss",
    r6="share hhi",
)
def _(t: Tables):
    lgd = F.when(F.col("loan_type").isin("mortgage", "auto"), 0.25).otherwise(0.45)
    df = t.loans.withColumn("el", F.col("loan_amount") * 0.1 * lgd)
    return S.concentration(df, "loan_type", "loan_amount", "el")


@case("g24_kaplan_meier", f"""with l as (select risk_grade, months_since_issue as t, {LABEL} as e from loans), c as (select risk_grade, t, sum(e) as events, count(*) as leaving from l group by 1, 2),
    r as (select *, sum(leaving) over (partition by risk_grade order by t desc) as at_risk from c)
    select risk_grade, t as months_since_issue, cast(events as bigint) as events, cast(at_risk as bigint) as at_risk, exp(sum(ln(1 - events / cast(at_risk as double))) over (partition by risk_grade order by t)) as survival from r""", r6="survival")
def _(t: Tables):
    return S.kaplan_meier(default_label(t.loans, out="e"), "months_since_issue", "e", "risk_grade")


@case("g24_survival_regression")
def _(t: Tables):
    df = cut_lineage(default_label(t.loans, out="e").select("months_since_issue", "e", "debt_to_income", "total_credit_utilization"))
    return S.survival_regression(df, "months_since_issue", "e", ["debt_to_income", "total_credit_utilization"])


@case(
    "g25_temporal_split",
    """with k as (select extract(year from issue_date) * 12 + extract(month from issue_date) - (select min(extract(year from issue_date) * 12 + extract(month from issue_date)) from loans) + 1 as k from loans)
    select case when k <= 18 then 'train' when k <= 22 then 'validate' when k <= 24 then 'test' else 'later' end as part, count(*) as n from k group by 1""",
)
def _(t: Tables):
    return S.temporal_split(t.loans, "issue_date").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@case(
    "g27_feature_select",
    f"""with l as (select {LABEL} as y, unnest(['credit_score', 'months_since_issue', 'debt_to_income']) as feature, unnest([credit_score::double, months_since_issue::double, debt_to_income]) as v from loans),
    r as (select feature, min(v) as lo, max(v) as hi, var_pop(v) as variance from l group by 1),
    j as (select l.feature, least(floor((v - lo) / (hi - lo) * 10), 9) as b, y, cast(count(*) as double) as n from l join r on r.feature = l.feature group by 1, 2, 3),
    p as (select feature, n / sum(n) over (partition by feature) as pxy, sum(n) over (partition by feature, b) / sum(n) over (partition by feature) as px, sum(n) over (partition by feature, y) / sum(n) over (partition by feature) as py from j)
    select p.feature, sum(pxy * ln(pxy / (px * py))) as mutual_information, max(variance) as variance from p join r on r.feature = p.feature group by 1""",
    r6="mutual_information",
    r4="variance",
)
def _(t: Tables):
    return S.feature_select(default_label(t.loans, out="y"), ["credit_score", "months_since_issue", "debt_to_income"], "y")
