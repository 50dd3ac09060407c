"""Pricing and rule queries on the loan view."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import pricing as R
from riskloom.plans.registry import case, money
from riskloom.plans.tables import Tables

SCORE = """greatest(least(5e-1 - (credit_score - 650) / 1e3 + (case when debt_to_income = 0 then 3e-1 else debt_to_income end) * 2e-1
    - least(annual_income / 5e5, 1e-1) + num_derogatory_records * 5e-2, 99e-2), 1e-2)"""
SCORED = f"sl as (select *, {money(SCORE, 4)} as pd, {SCORE} as praw from loans)"


def priced(t: Tables):
    s = R.heuristic_score(t.loans)
    return s.withColumns(
        {"default_prob": F.col("probability"), "segment": F.col("borrower_segment"), "dti": F.col("debt_to_income")}
    )


RATE = f"""{SCORED}, ra as (select *, pd * 25e-1 as risk_premium,
    case borrower_segment when 'prime' then -15e-3 when 'near_prime' then 0e0 when 'subprime' then 3e-2 when 'deep_subprime' then 6e-2 else 0e0 end as segment_adjustment,
    case loan_type when 'mortgage' then -2e-2 when 'auto' then -1e-2 when 'business' then 5e-3 when 'personal' then 1e-2 when 'student' then -5e-3 when 'credit_card' then 2e-2 else 0e0 end as loan_type_adjustment,
    case when credit_score >= 750 then -1e-2 when credit_score >= 700 then -5e-3 when credit_score >= 650 then 0e0 when credit_score >= 600 then 1e-2 else 2e-2 end as credit_score_adjustment,
    case when debt_to_income <= 2e-1 then -5e-3 when debt_to_income <= 35e-2 then 0e0 when debt_to_income <= 5e-1 then 5e-3 else 15e-3 end as dti_adjustment,
    case when loan_amount > 500000 then -5e-3 when loan_amount < 50000 then 5e-3 else 0e0 end as loan_size_adjustment,
    case when tenure_months <= 12 then 5e-3 when tenure_months <= 60 then 0e0 else 3e-3 end as tenure_adjustment from sl),
  rb as (select *, greatest(least(65e-3 + 2e-2 + 15e-3 + risk_premium + segment_adjustment + loan_type_adjustment + credit_score_adjustment + dti_adjustment + loan_size_adjustment + tenure_adjustment, 28e-2), 5e-2) as raw_rate from ra),
  rc as (select *, {money('raw_rate', 6)} as recommended_rate, {money('greatest(least(raw_rate - 15e-3, 28e-2), 5e-2)', 6)} as rate_min, {money('greatest(least(raw_rate + 15e-3, 28e-2), 5e-2)', 6)} as rate_max from rb)"""
RATE_COLS = "risk_premium segment_adjustment loan_type_adjustment credit_score_adjustment dti_adjustment loan_size_adjustment tenure_adjustment recommended_rate rate_min rate_max"


@case("r1_risk_adjusted_rate", f"with {RATE} select loan_id, {RATE_COLS.replace(' ', ', ')} from rc", r6=RATE_COLS)
def _(t: Tables):
    return R.risk_adjusted_rate(priced(t)).select("loan_id", *RATE_COLS.split())


LGD = "case when loan_type in ('mortgage', 'auto') then 25e-2 else 45e-2 end"


@case(
    "r2_expected_loss",
    f"with {SCORED} select loan_id, {money(f'pd * ({LGD}) * loan_amount')} as expected_loss, pd * ({LGD}) as expected_loss_rate from sl",
    r2="expected_loss",
    r6="expected_loss_rate",
)
def _(t: Tables):
    lgd = F.when(F.col("loan_type").isin("mortgage", "auto"), 0.25).otherwise(0.45)
    return priced(t).select(
        "loan_id",
        R.expected_loss(F.col("default_prob"), lgd, F.col("loan_amount")).alias("expected_loss"),
        (F.col("default_prob") * lgd).alias("expected_loss_rate"),
    )


@case(
    "r3_risk_margin",
    f"with {SCORED} select loan_id, {money(f'pd * ({LGD}) * loan_amount')} * 1e-1 + 3e-2 as risk_margin from sl",
    r4="risk_margin",
)
def _(t: Tables):
    lgd = F.when(F.col("loan_type").isin("mortgage", "auto"), 0.25).otherwise(0.45)
    loss = R.expected_loss(F.col("default_prob"), lgd, F.col("loan_amount"))
    return priced(t).select("loan_id", R.risk_margin(loss).alias("risk_margin"))


def emi_sql(p: str, r: str, n: str) -> str:
    return f"""(case when {p} <= 0 then 0e0 when {n} <= 0 then {p} when {r} <= 0 then {p} / {n}
      else {p} * ({r} / 12e0) * power(1 + {r} / 12e0, {n}) / (power(1 + {r} / 12e0, {n}) - 1) end)"""


BASE = "lo as (select loan_id, case when loan_id % 50 = 0 then 0e0 else loan_amount end as principal, case when loan_id % 20 = 0 then 0e0 else interest_rate / 1e2 end as annual_rate, case when loan_id % 99 = 0 then 0 else tenure_months end as tenure_months from loans)"


def base(t: Tables):
    k = F.col("loan_id")
    return t.loans.select(
        "loan_id",
        F.when(k % 50 == 0, 0.0).otherwise(F.col("loan_amount")).alias("principal"),
        F.when(k % 20 == 0, 0.0).otherwise(F.col("interest_rate") / 100.0).alias("annual_rate"),
        F.when(k % 99 == 0, 0).otherwise(F.col("tenure_months")).alias("tenure_months"),
    )


EMI = emi_sql("principal", "annual_rate", "tenure_months")


def prn():
    return F.col("principal"), F.col("annual_rate"), F.col("tenure_months")


@case("r4_emi", f"with {BASE} select loan_id, {EMI} as emi from lo", r4="emi")
def _(t: Tables):
    return base(t).select("loan_id", R.emi(*prn()).alias("emi"))


AMORT = f"""{BASE}, le as (select *, {EMI} as e, unnest(range(1, tenure_months + 1)) as month from lo),
  lb as (select *, case when annual_rate > 0 then principal * power(1 + annual_rate / 12e0, month - 1) - e * (power(1 + annual_rate / 12e0, month - 1) - 1) / (annual_rate / 12e0) else principal - e * (month - 1) end as b,
    case when annual_rate > 0 then annual_rate / 12e0 else 0e0 end as i from le),
  lp as (select loan_id, cast(month as int) as month, b, b * i as interest, least(e - b * i, b) as paid from lb),
  lq as (select loan_id, month, {money('paid + interest')} as emi, {money('paid')} as principal, {money('interest')} as interest, {money('greatest(b - paid, 0e0)')} as balance from lp)"""


DEC = "cast(sum(cast({} as decimal(18, 2))) as double) as {}"
CUM = """lw as (select *, sum(interest) over w as cumulative_interest, sum(principal) over w as cumulative_principal from lq window w as (partition by loan_id order by month))"""


def dec(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c)


# A schedule has about sixty rows per loan; the queries sum it by loan and by month.
@case(
    "r5_amortization",
    f"""with {AMORT}, {CUM} select loan_id, count(*) as months, {DEC.format("emi", "emi")}, {DEC.format("principal", "principal")}, {DEC.format("interest", "interest")},
      max(cumulative_interest) as cumulative_interest, max(cumulative_principal) as cumulative_principal, min(balance) as last_balance from lw group by loan_id""",
    r2="emi principal interest cumulative_interest cumulative_principal last_balance",
)
def _(t: Tables):
    return R.amortization(base(t)).groupBy("loan_id").agg(
        F.count(F.lit(1)).alias("months"),
        dec("emi"),
        dec("principal"),
        dec("interest"),
        F.max("cumulative_interest").alias("cumulative_interest"),
        F.max("cumulative_principal").alias("cumulative_principal"),
        F.min("balance").alias("last_balance"),
    )


@case(
    "r5_amortization_by_month",
    f"""with {AMORT}, {CUM} select month, count(*) as loans, avg(emi) as emi, avg(interest) as interest, avg(balance) as balance,
      avg(cumulative_principal) as cumulative_principal from lw group by month""",
    r2="emi interest balance cumulative_principal",
)
def _(t: Tables):
    return R.amortization(base(t)).groupBy("month").agg(
        F.count(F.lit(1)).alias("loans"),
        *[F.avg(c).alias(c) for c in ("emi", "interest", "balance", "cumulative_principal")],
    )


@case("r6_total_interest", f"with {BASE} select loan_id, {money(EMI + ' * tenure_months - principal')} as total_interest from lo", r2="total_interest")
def _(t: Tables):
    return base(t).select("loan_id", R.total_interest(*prn()).alias("total_interest"))


PREPAY = f"""pb as (select loan_id, loan_amount as principal, interest_rate / 1e2 as annual_rate, tenure_months, loan_amount * 25e-2 as prepayment_amount, cast(loan_id % 24 as int) as prepayment_month from loans),
  p1 as (select *, {EMI} as e, {money(EMI + ' * tenure_months - principal')} as ti, least(prepayment_month, tenure_months) as k, tenure_months - prepayment_month as rest from pb),
  p2 as (select *, greatest(principal * power(1 + annual_rate / 12e0, k) - e * (power(1 + annual_rate / 12e0, k) - 1) / (annual_rate / 12e0) - prepayment_amount, 0e0) as nb from p1),
  p3 as (select *, case when nb <= 0 or rest <= 0 then 0e0 else {emi_sql('nb', 'annual_rate', 'rest')} end as ne from p2),
  p4 as (select *, case when nb <= 0 or rest <= 0 then ti else greatest({money('ne * rest - nb')} + (e * prepayment_month - principal + nb - prepayment_amount), 0e0) end as ni,
    case when nb <= 0 or rest <= 0 then prepayment_month else tenure_months end as nt from p3)"""
PREPAY_COLS = "old_emi old_total_interest new_emi new_total_interest new_total_payment remaining_balance interest_saved monthly_emi_reduction"


@case(
    "r7_prepayment_impact",
    f"""with {PREPAY} select loan_id, {money('e')} as old_emi, ti as old_total_interest, {money('ne')} as new_emi, nt as new_tenure_months, {money('ni')} as new_total_interest,
      {money('ni + principal - prepayment_amount')} as new_total_payment, {money('nb')} as remaining_balance, {money('ti - ni')} as interest_saved, greatest(tenure_months - nt, 0) as tenure_reduction_months,
      {money('case when ne > 0 then e - ne else e end')} as monthly_emi_reduction from p4""",
    r2=PREPAY_COLS,
)
def _(t: Tables):
    df = t.loans.select(
        "loan_id",
        F.col("loan_amount").alias("principal"),
        (F.col("interest_rate") / 100.0).alias("annual_rate"),
        "tenure_months",
        (F.col("loan_amount") * 0.25).alias("prepayment_amount"),
        (F.col("loan_id") % 24).cast("int").alias("prepayment_month"),
    )
    return R.prepayment_impact(df).select("loan_id", *PREPAY_COLS.split(), "new_tenure_months", "tenure_reduction_months")


FULL = f"""{RATE}, rd as (select *, {LGD} as lgd, recommended_rate as optimal_rate, greatest(least(recommended_rate - 5e-3, 28e-2), 5e-2) as competitive_rate,
    greatest(least(recommended_rate - 2e-2, 28e-2), 5e-2) as minimum_acceptable_rate, {money(f'pd * ({LGD}) * loan_amount')} as expected_loss from rc),
  re as (select *, {emi_sql('loan_amount', 'optimal_rate', 'tenure_months')} as e1, {emi_sql('loan_amount', 'competitive_rate', 'tenure_months')} as e2,
    {emi_sql('loan_amount', 'minimum_acceptable_rate', 'tenure_months')} as e3, loan_amount * recommended_rate * (tenure_months / 12e0) as inc from rd),
  rf as (select loan_id, lgd, optimal_rate, competitive_rate, minimum_acceptable_rate, expected_loss, e1 as emi_optimal, e2 as emi_competitive, e3 as emi_minimum,
    e1 * tenure_months - loan_amount as total_interest_optimal, e2 * tenure_months - loan_amount as total_interest_competitive, e3 * tenure_months - loan_amount as total_interest_minimum,
    inc as interest_income, loan_amount * 3e-2 as operating_cost, inc - expected_loss - loan_amount * 3e-2 as expected_profit,
    (inc - expected_loss - loan_amount * 3e-2) / greatest(loan_amount, 1e0) as risk_adjusted_return, expected_loss * 1e-1 + 3e-2 as risk_margin, pd, praw, recommended_rate, rate_min, rate_max, risk_premium from re)"""
FULL_R6 = "lgd optimal_rate competitive_rate minimum_acceptable_rate"
FULL_R2 = "expected_loss emi_optimal emi_competitive emi_minimum total_interest_optimal total_interest_competitive total_interest_minimum interest_income expected_profit"


@case(
    "r8_recommend_pricing",
    f"with {FULL} select loan_id, {FULL_R6.replace(' ', ', ')}, {', '.join(f'{money(c)} as {c}' for c in FULL_R2.split())}, {money('operating_cost')} as operating_cost, {money('risk_adjusted_return', 6)} as risk_adjusted_return, risk_margin from rf",
    r6=FULL_R6,
    r4="risk_adjusted_return risk_margin",
    r2=FULL_R2 + " operating_cost",
)
def _(t: Tables):
    return R.recommend_pricing(priced(t)).select(
        "loan_id", *FULL_R6.split(), *FULL_R2.split(), "operating_cost", "risk_adjusted_return", "risk_margin"
    )


@case(
    "r9_pricing_report",
    f"""with {FULL}, lo as (select loan_id, loan_amount as principal, recommended_rate as annual_rate, tenure_months from re),
    le as (select *, {EMI} as e, unnest(range(1, least(tenure_months, 12) + 1)) as month from lo),
    lb as (select *, principal * power(1 + annual_rate / 12e0, month - 1) - e * (power(1 + annual_rate / 12e0, month - 1) - 1) / (annual_rate / 12e0) as b, annual_rate / 12e0 as i from le)
    select loan_id, count(*) as months, sum({money('e')}) as emi, sum({money('least(e - b * i, b)')}) as principal, min({money('greatest(b - least(e - b * i, b), 0e0)')}) as balance from lb group by loan_id""",
    r2="emi principal balance",
)
def _(t: Tables):
    # explode_outer: an inner explode makes the optimizer push a filter on the whole schedule
    # expression down through every step of the pricing chain.
    rows = R.pricing_report(priced(t)).select("loan_id", F.explode_outer("schedule").alias("s"))
    return rows.groupBy("loan_id").agg(
        F.count(F.lit(1)).alias("months"), F.sum("s.emi").alias("emi"), F.sum("s.principal").alias("principal"),
        F.min("s.balance").alias("balance"),
    )


COMPETITORS = {"alpha": 0.105, "beta": 0.14, "gamma": 0.19, "delta": 0.22}


@case(
    "r10_market_comparison",
    f"""with {RATE} select loan_id, recommended_rate, 16375e-5 as market_mean, 165e-3 as market_median, 105e-3 as market_min, 22e-2 as market_max,
      1 + (recommended_rate <= 105e-3)::int + (recommended_rate <= 14e-2)::int + (recommended_rate <= 19e-2)::int + (recommended_rate <= 22e-2)::int as rank,
      (1 + (recommended_rate <= 105e-3)::int + (recommended_rate <= 14e-2)::int + (recommended_rate <= 19e-2)::int + (recommended_rate <= 22e-2)::int) / 5e0 * 100 as percentile,
      recommended_rate - 16375e-5 as difference_from_mean, recommended_rate - 105e-3 as difference_alpha, recommended_rate - 14e-2 as difference_beta,
      recommended_rate - 19e-2 as difference_gamma, recommended_rate - 22e-2 as difference_delta,
      case when recommended_rate < 16375e-5 then 'competitive' else 'above_market' end as market_assessment from rc""",
    r4="recommended_rate market_mean market_median market_min market_max percentile difference_from_mean difference_alpha difference_beta difference_gamma difference_delta",
)
def _(t: Tables):
    rated = R.risk_adjusted_rate(priced(t)).select("loan_id", "recommended_rate")
    return R.market_comparison(rated, COMPETITORS)


@case(
    "r11_heuristic_score",
    f"""with {SCORED} select loan_id, pd as probability, case when praw < 3e-1 then 'low_risk' when praw < 6e-1 then 'medium_risk' else 'high_risk' end as risk_category from sl""",
    r4="probability",
)
def _(t: Tables):
    return R.heuristic_score(t.loans).select("loan_id", "probability", "risk_category")


@case(
    "r12_process_loans",
    f"""with {FULL} select loan_id, pd as probability, optimal_rate, case when pd < 5e-1 then 'approve' else 'decline' end as decision, 'prediction,pricing,submission' as steps from rf""",
    r4="probability",
    r6="optimal_rate",
)
def _(t: Tables):
    return R.process_loans(t.loans).select("loan_id", "probability", "optimal_rate", "decision", "steps")
