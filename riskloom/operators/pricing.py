"""Risk-based pricing, instalments and amortization as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import clip, first_match, risk_band3

_c = F.col
PART_ROWS = 1 << 18  # rows of a schedule that one task sorts
MOST_PARTS = 20_000  # what the driver can keep track of; beyond it parts grow


@dataclass(frozen=True)
class RateCard:
    """Rates and adjustments of the pricing rule (fixed values as defaults)."""

    repo_rate: float = 0.065
    bank_spread: float = 0.02
    risk_spread_base: float = 0.015
    min_rate: float = 0.05
    max_rate: float = 0.28
    segments: Mapping[str, float] = field(
        default_factory=lambda: {"prime": -0.015, "near_prime": 0.0, "subprime": 0.03, "deep_subprime": 0.06}
    )
    loan_types: Mapping[str, float] = field(
        default_factory=lambda: {
            "mortgage": -0.02, "auto": -0.01, "business": 0.005, "personal": 0.01, "student": -0.005, "credit_card": 0.02,
        }
    )

    @property
    def base_rate(self) -> float:
        return self.repo_rate + self.bank_spread + self.risk_spread_base


CARD = RateCard()


def risk_adjusted_rate(df: DataFrame, card: RateCard = CARD) -> DataFrame:
    """Rate, its range and all parts, from default_prob, loan_type, segment, loan_amount,
    tenure_months, credit_score and dti."""
    score, dti, amount, tenure = _c("credit_score"), _c("dti"), _c("loan_amount"), _c("tenure_months")
    by_name = lambda col, table: first_match([(_c(col) == k, v) for k, v in table.items()], 0.0)
    parts = df.withColumns(
        {
            "risk_premium": _c("default_prob") * 2.5,
            "segment_adjustment": by_name("segment", card.segments),
            "loan_type_adjustment": by_name("loan_type", card.loan_types),
            "credit_score_adjustment": first_match(
                [(score >= 750, -0.01), (score >= 700, -0.005), (score >= 650, 0.0), (score >= 600, 0.01)], 0.02
            ),
            "dti_adjustment": first_match([(dti <= 0.2, -0.005), (dti <= 0.35, 0.0), (dti <= 0.5, 0.005)], 0.015),
            "loan_size_adjustment": first_match([(amount > 500000, -0.005), (amount < 50000, 0.005)], 0.0),
            "tenure_adjustment": first_match([(tenure <= 12, 0.005), (tenure <= 60, 0.0)], 0.003),
        }
    )
    total = (
        F.lit(card.base_rate)
        + _c("risk_premium")
        + _c("segment_adjustment")
        + _c("loan_type_adjustment")
        + _c("credit_score_adjustment")
        + _c("dti_adjustment")
        + _c("loan_size_adjustment")
        + _c("tenure_adjustment")
    )
    limit = lambda x: clip(x, card.min_rate, card.max_rate)
    rated = parts.withColumn("__rate", limit(total))
    return rated.withColumns(
        {
            "recommended_rate": F.round("__rate", 6),
            "rate_min": F.round(limit(_c("__rate") - 0.015), 6),
            "rate_max": F.round(limit(_c("__rate") + 0.015), 6),
        }
    ).drop("__rate")


def expected_loss(pd: Column, lgd: Column, ead: Column) -> Column:
    """PD · LGD · EAD, in cents."""
    return F.round(pd * lgd * ead, 2)


def risk_margin(loss: Column, operating_cost: Column | float = 0.03) -> Column:
    cost = F.lit(operating_cost) if isinstance(operating_cost, float) else operating_cost
    return F.round(loss * 0.1 + cost, 6)


def emi(principal: Column, annual_rate: Column, months: Column) -> Column:
    """Monthly instalment of an annuity; the plain cases first."""
    i = annual_rate / 12.0
    growth = F.pow(1 + i, months)
    return (
        F.when(principal <= 0, F.lit(0.0))
        .when(months <= 0, principal)
        .when(annual_rate <= 0, principal / months)
        .otherwise(principal * i * growth / (growth - 1))
    )


def balance_after(principal: Column, annual_rate: Column, instalment: Column, paid: Column) -> Column:
    """Balance after `paid` instalments, in closed form."""
    i = annual_rate / 12.0
    growth = F.pow(1 + i, paid)
    return F.when(annual_rate > 0, principal * growth - instalment * (growth - 1) / i).otherwise(
        principal - instalment * paid
    )


def amortization(df: DataFrame, key: str = "loan_id", months_limit: int | None = None) -> DataFrame:
    """One row per loan and month, from principal, annual_rate, tenure_months.

    Loans are distributed by key before they are expanded, so the cumulative window finds
    its rows in place and the expanded rows are not shuffled. The number of parts follows the
    expanded rows, which are many times the loans: a part is sorted in memory, without spills.
    """
    last = _c("tenure_months") if months_limit is None else F.least("tenure_months", F.lit(months_limit))
    loans = df.select(
        key,
        _c("principal").cast("double").alias("principal_0"),
        _c("annual_rate").alias("rate"),
        "tenure_months",
        emi(_c("principal"), _c("annual_rate"), _c("tenure_months")).alias("emi_0"),
    ).where(last >= 1)
    loans = loans.repartition(_parts(loans.agg(F.sum(last.cast("long"))).first()[0] or 0), key)
    rows = loans.withColumn("month", F.explode(F.sequence(F.lit(1), last)))
    before = balance_after(_c("principal_0"), _c("rate"), _c("emi_0"), _c("month") - 1)
    monthly = F.when(_c("rate") > 0, _c("rate") / 12.0).otherwise(F.lit(0.0))
    rows = rows.withColumn("__b", before).withColumn("__i", _c("__b") * monthly)
    paid = F.least(_c("emi_0") - _c("__i"), _c("__b"))
    rows = rows.select(
        key,
        "month",
        F.round(paid + _c("__i"), 2).alias("emi"),
        F.round(paid, 2).alias("principal"),
        F.round("__i", 2).alias("interest"),
        F.round(F.greatest(_c("__b") - paid, F.lit(0.0)), 2).alias("balance"),
    )
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns(
        {
            "cumulative_interest": F.round(F.sum("interest").over(w), 2),
            "cumulative_principal": F.round(F.sum("principal").over(w), 2),
        }
    )


def _parts(rows: int) -> int:
    return min(rows // PART_ROWS + 1, MOST_PARTS)


def total_interest(principal: Column, annual_rate: Column, months: Column) -> Column:
    return F.round(emi(principal, annual_rate, months) * months - principal, 2)


def prepayment_impact(df: DataFrame) -> DataFrame:
    """Old and new instalment after a prepayment, from principal, annual_rate, tenure_months,
    prepayment_amount, prepayment_month."""
    p, r, n = _c("principal"), _c("annual_rate"), _c("tenure_months")
    amount, month = _c("prepayment_amount"), _c("prepayment_month")
    a = df.withColumns({"old_emi": emi(p, r, n), "old_total_interest": total_interest(p, r, n)})
    left = balance_after(p, r, _c("old_emi"), F.least(month, n))
    a = a.withColumn("new_balance", F.greatest(left - amount, F.lit(0.0)))
    rest = n - month
    over = (_c("new_balance") <= 0) | (rest <= 0)
    interest = total_interest(_c("new_balance"), r, rest) + (_c("old_emi") * month - p + _c("new_balance") - amount)
    a = a.withColumns(
        {
            "new_emi": F.when(over, F.lit(0.0)).otherwise(emi(_c("new_balance"), r, rest)),
            "new_tenure_months": F.when(over, month).otherwise(n),
            "new_total_interest": F.when(over, _c("old_total_interest")).otherwise(F.greatest(interest, F.lit(0.0))),
        }
    )
    drop = F.when(_c("new_emi") > 0, _c("old_emi") - _c("new_emi")).otherwise(_c("old_emi"))
    return a.withColumns(
        {
            "interest_saved": F.round(_c("old_total_interest") - _c("new_total_interest"), 2),
            "tenure_reduction_months": F.greatest(n - _c("new_tenure_months"), F.lit(0)),
            "monthly_emi_reduction": F.round(drop, 2),
            "old_emi": F.round("old_emi", 2),
            "new_emi": F.round("new_emi", 2),
            "new_total_payment": F.round(_c("new_total_interest") + p - amount, 2),
            "new_total_interest": F.round("new_total_interest", 2),
            "remaining_balance": F.round("new_balance", 2),
        }
    ).drop("new_balance")


def recommend_pricing(df: DataFrame, card: RateCard = CARD, operating_cost: float = 0.03) -> DataFrame:
    """Three rates with their instalments, expected loss and profit, on top of the rate parts.

    `lgd` is used when the column exists; otherwise .25 for secured loans and .45 for others.
    """
    rated = risk_adjusted_rate(df, card)
    if "lgd" not in df.columns:
        rated = rated.withColumn("lgd", F.when(_c("loan_type").isin("mortgage", "auto"), 0.25).otherwise(0.45))
    amount, months = _c("loan_amount"), _c("tenure_months")
    limit = lambda x: clip(x, card.min_rate, card.max_rate)
    rates = rated.withColumns(
        {
            "optimal_rate": _c("recommended_rate"),
            "competitive_rate": limit(_c("recommended_rate") - 0.005),
            "minimum_acceptable_rate": limit(_c("recommended_rate") - 0.02),
            "expected_loss": expected_loss(_c("default_prob"), _c("lgd"), amount),
            "expected_loss_rate": F.round(_c("default_prob") * _c("lgd"), 6),
            "operating_cost": amount * operating_cost,
        }
    )
    plans = {"optimal": "optimal_rate", "competitive": "competitive_rate", "minimum": "minimum_acceptable_rate"}
    raw = rates.withColumns({f"__emi_{k}": emi(amount, _c(r), months) for k, r in plans.items()})
    income = amount * _c("optimal_rate") * (months / 12.0)
    profit = income - _c("expected_loss") - _c("operating_cost")
    return raw.withColumns(
        {
            **{f"emi_{k}": F.round(f"__emi_{k}", 2) for k in plans},
            **{f"total_interest_{k}": F.round(_c(f"__emi_{k}") * months - amount, 2) for k in plans},
            **{f"total_payment_{k}": F.round(_c(f"__emi_{k}") * months, 2) for k in plans},
            "interest_income": F.round(income, 2),
            "expected_profit": F.round(profit, 2),
            "risk_adjusted_return": F.round(profit / F.greatest(amount, F.lit(1.0)), 6),
            "risk_margin": risk_margin(_c("expected_loss"), operating_cost),
            "competitive_rate": F.round("competitive_rate", 6),
            "minimum_acceptable_rate": F.round("minimum_acceptable_rate", 6),
            "operating_cost": F.round("operating_cost", 2),
        }
    ).drop(*[f"__emi_{k}" for k in plans])


def pricing_report(df: DataFrame, key: str = "loan_id", months: int = 12) -> DataFrame:
    """Pricing with the first schedule rows as an array, built inside the row."""
    priced = recommend_pricing(df)
    p, r, n = _c("loan_amount").cast("double"), _c("optimal_rate"), _c("tenure_months")
    e = emi(p, r, n)

    def line(m: Column) -> Column:
        b = balance_after(p, r, _c("__e"), m - 1)
        i = b * F.when(r > 0, r / 12.0).otherwise(F.lit(0.0))
        paid = F.least(_c("__e") - i, b)
        return F.struct(
            m.alias("month"),
            F.round(paid + i, 2).alias("emi"),
            F.round(paid, 2).alias("principal"),
            F.round(i, 2).alias("interest"),
            F.round(F.greatest(b - paid, F.lit(0.0)), 2).alias("balance"),
        )

    rows = F.transform(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(months)), F.lit(1))), line)
    return priced.withColumn("__e", e).withColumn("schedule", F.when(n >= 1, rows)).drop("__e")


def market_comparison(df: DataFrame, competitors: Mapping[str, float], rate: str = "recommended_rate") -> DataFrame:
    """Position among competitor rates; the competitor list is a parameter, so it is folded
    into literals."""
    values = sorted(competitors.values())
    n = len(values)
    mean = sum(values) / n if n else 0.0
    mid = (values[(n - 1) // 2] + values[n // 2]) / 2 if n else 0.0
    ours = _c(rate)
    at_least = F.lit(1)
    for v in values:
        at_least = at_least + F.when(ours <= v, 1).otherwise(0)
    return df.withColumns(
        {
            "market_mean": F.lit(round(mean, 6)),
            "market_median": F.lit(round(mid, 6)),
            "market_min": F.lit(values[0] if n else 0.0),
            "market_max": F.lit(values[-1] if n else 0.0),
            "rank": at_least,
            "percentile": F.round(at_least / (n + 1) * 100, 2),
            "difference_from_mean": F.round(ours - mean, 6),
            **{f"difference_{k}": F.round(ours - v, 6) for k, v in competitors.items()},
            "market_assessment": F.when(ours < mean, "competitive").otherwise("above_market"),
        }
    )


def heuristic_score(df: DataFrame) -> DataFrame:
    """Closed-form default probability without a model; missing or zero inputs get defaults."""
    have = set(df.columns)

    def value(name: str, default: float) -> Column:
        if name not in have:
            return F.lit(default)
        return F.when(_c(name).isNull() | (_c(name) == 0), F.lit(default)).otherwise(_c(name).cast("double"))

    score, dti, income = value("credit_score", 650.0), value("debt_to_income", 0.3), value("annual_income", 50000.0)
    marks = F.coalesce(_c("num_derogatory_records").cast("double"), F.lit(0.0)) if "num_derogatory_records" in have else F.lit(0.0)
    raw = 0.5 - (score - 650) / 1000 + dti * 0.2 - F.least(income / 500000, F.lit(0.1)) + marks * 0.05
    p = F.greatest(F.least(raw, F.lit(0.99)), F.lit(0.01))
    return df.withColumns({"probability": F.round(p, 4), "risk_category": risk_band3(p)})


def process_loans(df: DataFrame) -> DataFrame:
    """Validate, score, price and decide, with the list of steps done per row."""
    from riskloom.operators.quality import scoring_rules, validate

    checked = validate(df, scoring_rules())
    scored = heuristic_score(checked)
    priced = recommend_pricing(
        scored.withColumns(
            {"default_prob": _c("probability"), "segment": _c("borrower_segment"), "dti": _c("debt_to_income")}
        )
    )
    ok = F.size("errors") == 0
    decision = F.when(~ok, "invalid").when(_c("probability") < 0.5, "approve").otherwise("decline")
    steps = F.when(ok, F.array(F.lit("prediction"), F.lit("pricing"), F.lit("submission"))).otherwise(
        F.array(F.lit("validation_failed"))
    )
    return priced.withColumns({"decision": decision, "steps": F.array_join(steps, ",")})
