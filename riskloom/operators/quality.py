"""Row rules, quarantine and table profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prep import numeric_columns
from riskloom.operators.scan import column_quantiles

# ---- fixed values -----------------------------------------------------------------
TRANSACTION_TYPES = ("credit", "debit", "emi_payment", "interest", "fee")
TRANSACTION_CATEGORIES = (
    "salary", "groceries", "rent", "entertainment", "business", "utilities", "medical", "education", "transfer",
    "investment", "other",
)
CHANNELS = ("NEFT", "RTGS", "UPI", "IMPS", "CHEQUE", "CASH", "ATM", "CARD")
VERIFICATION_STATES = ("verified", "pending", "failed")
LOAN_TYPES = ("personal", "mortgage", "auto", "business", "student", "credit_card")
APPLICATION_FIELDS = (
    "customer_id", "loan_amount", "interest_rate", "loan_type", "tenure_months", "employment_status", "annual_income",
)
SCORING_FIELDS = (
    "loan_amount", "interest_rate", "annual_income", "debt_to_income", "credit_score", "employment_length",
)
REQUEST_RANGES = {
    "age": (18, 120), "income": (0, None), "employment_length": (0, None), "loan_amount": (0, None),
    "interest_rate": (0, 100), "term_months": (1, None), "debt_to_income": (0, None), "credit_score": (300, 850),
    "num_credit_lines": (0, None), "num_derogatory_marks": (0, None), "revolving_utilization": (0, 2),
    "total_accounts": (0, None), "months_since_last_delinquency": (0, None),
}
DECISIONS = ("approved", "rejected", "conditional", "manual_review")
ACCOUNT_FIELDS = ("bank_code", "account_number", "ifsc_code")
CONSENT_TYPES = (
    "deposit", "term_deposit", "recurring_deposit", "mutual_fund", "insurance", "government_scheme", "equity", "bond",
    "debt",
)
NULL_LIMIT, DUPLICATE_LIMIT, OUTLIER_LIMIT = 0.5, 0.3, 0.05
# ---- end of fixed values ----------------------------------------------------------

_c = F.col


@dataclass(frozen=True)
class Rule:
    """A row passes when `ok` is true; with `optional`, NULL passes as well."""

    message: str
    ok: Column
    optional: bool = False

    def failed(self) -> Column:
        return ~F.coalesce(self.ok, F.lit(self.optional))


def validate(df: DataFrame, rules: Sequence[Rule], out: str = "errors") -> DataFrame:
    """Add the messages of the failed rules."""
    found = F.array(*[F.when(r.failed(), F.lit(r.message)) for r in rules])
    return df.withColumn(out, F.array_compact(found))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with errors)."""
    checked = validate(df, rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def required(names: Sequence[str]) -> list[Rule]:
    return [Rule(f"Missing required field: {n}", _c(n).isNotNull()) for n in names]


def between(name: str, lo: float | None, hi: float | None, message: str, optional: bool = True) -> Rule:
    tests = [_c(name) >= lo] if lo is not None else []
    tests += [_c(name) <= hi] if hi is not None else []
    return Rule(message, reduce(lambda a, b: a & b, tests), optional)


def transaction_rules() -> list[Rule]:
    return [
        *required(["account_id", "transaction_date"]),
        Rule("amount must be at least 0", _c("amount") >= 0),
        Rule("only INR is supported", F.upper("currency") == "INR"),
        Rule("unknown transaction_type", _c("transaction_type").isin(*TRANSACTION_TYPES)),
        Rule("unknown category", _c("category").isin(*TRANSACTION_CATEGORIES)),
        Rule("unknown channel", _c("channel").isin(*CHANNELS)),
        Rule("unknown verification_status", _c("verification_status").isin(*VERIFICATION_STATES)),
    ]


def application_rules() -> list[Rule]:
    return [
        *required(APPLICATION_FIELDS),
        Rule("Loan amount must be positive", _c("loan_amount") > 0, optional=True),
        Rule("Interest rate must be between 0 and 50 percent", (_c("interest_rate") > 0) & (_c("interest_rate") <= 50), True),
        Rule("Invalid loan_type", _c("loan_type").isin(*LOAN_TYPES), optional=True),
    ]


def scoring_rules() -> list[Rule]:
    return [
        *required(SCORING_FIELDS),
        between("credit_score", 300, 850, "Credit score out of range"),
        between("debt_to_income", 0, 1, "DTI out of range"),
    ]


def request_rules(columns: Sequence[str]) -> list[Rule]:
    """Range rules of the request fields the table has."""
    return [
        between(n, lo, hi, f"{n} out of range") for n, (lo, hi) in REQUEST_RANGES.items() if n in set(columns)
    ]


def decision_rules() -> list[Rule]:
    return [
        Rule("Invalid decision", F.lower("decision").isin(*DECISIONS)),
        between("rate", 0, 50, "Interest rate must be between 0 and 50 percent", optional=False),
    ]


def disbursement_rules() -> list[Rule]:
    return [
        Rule("Disbursement amount must be positive", _c("amount") > 0),
        *[Rule(f"Missing account details: {n}", _c(n).isNotNull()) for n in ACCOUNT_FIELDS],
    ]


def repayment_rules() -> list[Rule]:
    return [
        Rule("Principal must be positive", _c("principal") > 0),
        Rule("Interest rate must be between 0 and 50 percent", (_c("rate") > 0) & (_c("rate") <= 50)),
        between("tenure", 1, 360, "Tenure must be between 1 and 360 months", optional=False),
    ]


def consent_rules() -> list[Rule]:
    allowed = F.array(*[F.lit(t) for t in CONSENT_TYPES])
    return [
        Rule("Invalid data_types", F.size(F.array_except(_c("data_types"), allowed)) == 0),
        Rule("Purpose must have at least 3 characters", F.length("purpose") >= 3),
    ]


def _missing(df: DataFrame, name: str) -> Column:
    c = _c(f"`{name}`")
    return (c.isNull() | F.isnan(c)) if dict(df.dtypes)[name] in ("double", "float") else c.isNull()


def null_profile(df: DataFrame, limit: float = NULL_LIMIT) -> DataFrame:
    """Null share per column, and the mean over columns with its verdict: one aggregate."""
    cols = df.columns
    shares = df.agg(*[F.avg(F.when(_missing(df, c), 1.0).otherwise(0.0)).alias(f"s{i}") for i, c in enumerate(cols)])
    mean = reduce(lambda a, b: a + b, [_c(f"s{i}") for i in range(len(cols))]) / len(cols)
    pairs = [F.struct(F.lit(c).alias("column"), _c(f"s{i}").alias("null_share")) for i, c in enumerate(cols)]
    return shares.select(F.explode(F.array(*pairs)).alias("r"), mean.alias("mean_null_share")).select(
        "r.column", "r.null_share", "mean_null_share", (_c("mean_null_share") < limit).alias("passed")
    )


def duplicate_share(df: DataFrame, limit: float = DUPLICATE_LIMIT) -> DataFrame:
    """Share of rows equal to an earlier row. Equal rows are counted with partial aggregation,
    so many copies of one row do not meet in one task."""
    groups = df.groupBy(*[_c(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    s = groups.agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
    share = 1 - _c("distinct_rows") / _c("rows")
    return s.withColumn("duplicate_share", F.coalesce(share, F.lit(0.0))).withColumn(
        "passed", _c("duplicate_share") < limit
    )


def target_distribution(df: DataFrame, y: str) -> DataFrame:
    """Share per class and the ratio of the largest to the smallest."""
    counts = df.where(_c(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    t = counts.agg(F.struct(F.sum("n").alias("n"), F.max("n").alias("hi"), F.min("n").alias("lo")).alias("t")).scalar()
    return counts.select(
        y, "n", (_c("n") / t["n"]).alias("share"), (t["hi"] / t["lo"]).alias("imbalance_ratio")
    )


def outlier_share(df: DataFrame, cols: Sequence[str], limit: float = OUTLIER_LIMIT) -> DataFrame:
    """Share of rows outside [p1, p99] per column. The bounds are two numbers per column."""
    bounds = column_quantiles(df, cols, [0.01, 0.99])
    outside = lambda c: F.when((_c(c) < bounds[c][0]) | (_c(c) > bounds[c][1]), 1.0).otherwise(0.0)
    known = [c for c in cols if bounds[c][0] is not None]
    shares = df.agg(*[F.avg(outside(c)).alias(f"s{i}") for i, c in enumerate(known)])
    pairs = [
        F.struct(
            F.lit(c).alias("column"), F.lit(bounds[c][0]).alias("p1"), F.lit(bounds[c][1]).alias("p99"),
            _c(f"s{i}").alias("outlier_share"),
        )
        for i, c in enumerate(known)
    ]
    return shares.select(F.explode(F.array(*pairs)).alias("r")).select(
        "r.*", (_c("r.outlier_share") <= limit).alias("passed")
    )


def dataset_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, columns, mean absolute value, mean sample deviation, null share: one aggregate."""
    cols = list(cols if cols is not None else numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.avg(F.abs(_c(c).cast("double"))).alias(f"a{i}"),
            F.stddev_samp(c).alias(f"d{i}"),
            F.avg(F.when(_missing(df, c), 1.0).otherwise(0.0)).alias(f"n{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("n_samples"), *aggs)
    mean = lambda p: reduce(lambda a, b: a + b, [_c(f"{p}{i}") for i in range(len(cols))]) / len(cols)
    return row.select(
        "n_samples", F.lit(len(cols)).alias("n_features"), mean("a").alias("mean_abs"), mean("d").alias("std"),
        mean("n").alias("null_pct"),
    )


def validation_report(df: DataFrame, y: str | None = None, numeric: Sequence[str] | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """(check, passed, value) rows; failed outlier checks only, as they are many."""
    nulls = null_profile(df).agg(
        F.lit("null_percentage").alias("check"), F.max("passed").alias("passed"), F.max("mean_null_share").alias("value")
    )
    dups = duplicate_share(df).select(F.lit("duplicate_check").alias("check"), "passed", _c("duplicate_share").alias("value"))
    cols = list(numeric if numeric is not None else numeric_columns(df, skip))
    out = outlier_share(df, cols).where(~_c("passed")).select(
        F.concat(F.lit("outlier_"), "column").alias("check"), "passed", _c("outlier_share").alias("value")
    )
    rows = nulls.unionByName(dups).unionByName(out)
    if y is not None:
        balance = target_distribution(df, y).agg(
            F.lit("target_distribution").alias("check"), F.lit(True).alias("passed"),
            F.round(F.max("imbalance_ratio"), 2).alias("value"),
        )
        rows = rows.unionByName(balance)
    overall = rows.agg(F.lit("overall").alias("check"), F.min("passed").alias("passed"), F.count(F.lit(1)).cast("double").alias("value"))
    return rows.unionByName(overall)
