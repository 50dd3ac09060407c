"""Loan features: ratios, flags, interactions, buckets, group statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import first_match, flag, ratio
from riskloom.operators.scan import cut_points, join_null_safe, melt, quantiles
from riskloom.session import cut_lineage

# ---- fixed values -----------------------------------------------------------------
DEFAULT_STATUSES = (
    "Charged Off", "Default", "Late (16-30 days)", "Late (31-120 days)", "In Grace Period",
    "Default Registered", "Defaulted",
)
LOAN_AGE_EDGES = (0, 6, 12, 24, 36, 60)
HISTORY_EDGES = (0, 12, 24, 60, 120, 360)
GROUP_PREFIXES = {"loan_type": "lt_", "borrower_segment": "seg_", "risk_grade": "rg_"}
GROUP_COLUMNS = ("loan_amount", "interest_rate", "credit_score", "debt_to_income")
# ---- end of fixed values ----------------------------------------------------------

RISK_FLAGS = (
    "high_dti", "low_credit_score", "high_utilization", "short_credit_history", "many_delinquencies",
    "recent_delinquency", "high_collections", "high_derogatory", "new_borrower",
)


def default_label(df: DataFrame, horizon: int = 12, out: str = "default_status") -> DataFrame:
    """1 if the status is a default status within the horizon, otherwise 0."""
    bad = (F.col("months_since_issue") <= horizon) & F.col("loan_status").isin(*DEFAULT_STATUSES)
    return df.withColumn(out, flag(bad))


def financial_ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "loan_to_income": ratio(c("loan_amount"), c("annual_income")),
            "installment_to_income": ratio(c("installment_amount") * 12, c("annual_income")),
            "revolving_utilization": ratio(c("total_revolving_bal"), c("total_revolving_credit_limit")),
            "balance_to_credit_limit": ratio(c("total_current_balance"), c("total_revolving_credit_limit")),
            "income_per_account": ratio(c("annual_income"), c("total_acc")),
            "debt_burden_score": c("debt_to_income") * c("total_credit_utilization"),
            "credit_efficiency": ratio(c("total_acc"), c("open_credit_lines")),
        }
    )


def risk_indicators(df: DataFrame) -> DataFrame:
    c = F.col
    tests = (
        c("debt_to_income") > 0.43,
        c("credit_score") < 620,
        c("total_credit_utilization") > 0.75,
        c("months_since_first_credit_line") < 24,
        c("delinquency_2yrs") > 2,
        c("months_since_last_delinquency") < 6,
        c("num_collections_12m") > 0,
        c("num_derogatory_records") > 1,
        c("employment_length") <= 1,
    )
    flagged = df.withColumns({name: flag(t) for name, t in zip(RISK_FLAGS, tests)})
    return flagged.withColumn("risk_score_sum", reduce(lambda a, b: a + b, [c(f) for f in RISK_FLAGS]))


def interactions(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "credit_x_income": c("credit_score") * c("annual_income"),
            "dti_x_utilization": c("debt_to_income") * c("total_credit_utilization"),
            "loan_x_interest": c("loan_amount") * c("interest_rate"),
            "income_stability": c("employment_length") * c("annual_income"),
            "credit_momentum": ratio(c("credit_score"), c("months_since_last_delinquency")),
            "debt_capacity": F.when(
                c("debt_to_income") > 0, c("annual_income") * (1 - c("debt_to_income"))
            ).otherwise(F.lit(0.0)),
        }
    )


def right_closed_bucket(x: Column, edges: Sequence[float]) -> Column:
    """Index of (e[i], e[i+1]] as a double; NULL outside."""
    bands = [((x > lo) & (x <= hi), float(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return first_match(bands, None)


def temporal_buckets(df: DataFrame) -> DataFrame:
    age, history = F.col("months_since_issue"), F.col("months_since_first_credit_line")
    return df.withColumns(
        {
            "loan_age": age,
            "loan_age_bucket": right_closed_bucket(age, LOAN_AGE_EDGES),
            "credit_history_length": history,
            "credit_history_bucket": right_closed_bucket(history, HISTORY_EDGES),
        }
    )


def group_tables(df: DataFrame, prefixes: Mapping[str, str], cols: Sequence[str]) -> dict[str, DataFrame]:
    """Mean, sample deviation and exact median per group, one small table per key.

    The medians of all keys come from one pass: each row is listed under (key, group).
    """
    groups = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("group")) for k in prefixes])
    listed = df.select(F.explode(groups).alias("g"), *cols).select("g.key", "g.group", *cols)
    long = melt(listed, ["key", "group"], cols)
    # The value distribution does not depend on the keys, so neither do the cut points.
    cuts = cut_points(melt(df, [], cols), "value")
    medians = quantiles(long, "value", [0.5], by=["key", "group", "feature"], names=["m"], cuts=cuts)
    # One row per group and column, read once per key below: kept as a written table.
    medians = cut_lineage(medians)
    out = {}
    for key, prefix in prefixes.items():
        moments = df.groupBy(key).agg(
            *[F.avg(c).alias(f"{prefix}{c}_mean") for c in cols],
            *[F.stddev_samp(c).alias(f"{prefix}{c}_std") for c in cols],
        )
        mine = (
            medians.where(F.col("key") == key)
            .groupBy(F.col("group").alias(key))
            .agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"{prefix}{c}_median") for c in cols])
        )
        out[key] = join_null_safe(moments, mine.withColumn(key, F.col(key).cast(df.schema[key].dataType)), [key], "left")
    return out


def group_stats(
    df: DataFrame,
    prefixes: Mapping[str, str] = GROUP_PREFIXES,
    cols: Sequence[str] = GROUP_COLUMNS,
) -> DataFrame:
    """Join the group statistics back to every row.

    The group tables are small for low-cardinality keys; the join strategy is left to the
    size Spark sees at run time, so a key with many groups still works.
    """
    out = df
    for key, table in group_tables(df, prefixes, cols).items():
        out = join_null_safe(out, table, [key], "left")
    return out


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """All products of 2..degree factors of `cols`, NULL as 0; linear terms are left out."""
    terms = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            names = [f"{c}^{combo.count(c)}" if combo.count(c) > 1 else c for c in dict.fromkeys(combo)]
            terms["poly_" + " ".join(names)] = reduce(
                lambda a, b: a * b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in combo]
            )
    return df.withColumns(terms)


def loan_type_features(df: DataFrame) -> DataFrame:
    c = F.col
    is_type = lambda t: c("loan_type") == t
    return df.withColumns(
        {
            "home_equity_ratio": F.when(is_type("mortgage"), ratio(c("loan_amount"), c("annual_income") * 4)),
            "auto_loan_burden": F.when(
                is_type("auto"), ratio(c("installment_amount") * 12, c("annual_income"))
            ),
            "business_risk_score": F.when(
                is_type("business"), c("debt_to_income") * (1 + c("delinquency_2yrs"))
            ),
        }
    )


def loan_features(df: DataFrame, keep_null: Sequence[str] = ()) -> DataFrame:
    """All loan features; remaining NULL, NaN and infinite numbers become 0."""
    from riskloom.operators.prep import replace_nonfinite

    wide = temporal_buckets(interactions(risk_indicators(financial_ratios(df))))
    return replace_nonfinite(group_stats(loan_type_features(wide)), skip=keep_null)


def serving_features(df: DataFrame) -> DataFrame:
    """The short feature set used for scoring a single application."""
    c = F.col
    out = df.withColumns(
        {
            "loan_to_income": c("loan_amount") / F.greatest(c("annual_income"), F.lit(1.0)),
            "debt_burden_score": c("debt_to_income") * c("total_credit_utilization"),
            "high_dti": flag(c("debt_to_income") > 0.43),
            "low_credit_score": flag(c("credit_score") < 620),
            "high_utilization": flag(c("total_credit_utilization") > 0.75),
        }
    )
    return out.withColumn(
        "risk_score_sum",
        c("high_dti")
        + c("low_credit_score")
        + c("high_utilization")
        + flag(c("num_collections_12m") > 0)
        + flag(c("num_derogatory_records") > 1),
    )


def align_columns(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the columns a model expects, in order; missing columns and NULL are 0."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in have else F.lit(0.0).alias(n) for n in names]
    return df.select(*keep, *cols)
