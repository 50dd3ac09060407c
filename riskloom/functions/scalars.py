"""Scalar column expressions: parsing, keyword inference, risk classes, hashing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------------
# Date patterns in order of preference, and the same in strptime form.
DATE_PATTERNS = (
    "d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "d-MMM-yyyy",
)
STRPTIME_PATTERNS = (
    "%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d", "%m/%d/%Y", "%d %b %Y", "%d %B %Y", "%Y/%m/%d", "%d-%b-%Y",
)
CATEGORY_KEYWORDS = {
    "salary": ("salary", "payroll", "wages", "stipend"),
    "groceries": ("grocery", "supermarket", "bigbasket", "blinkit", "zepto", "dmart"),
    "rent": ("rent", "housing", "maintenance", "society"),
    "entertainment": ("movie", "netflix", "hotstar", "prime", "bookmyshow", "zomato", "swiggy"),
    "business": ("business", "invoice", "vendor", "supplier", "payment to"),
    "utilities": ("electric", "water", "gas", "broadband", "jio", "airtel", "vi ", "bsnl"),
    "medical": ("hospital", "pharmacy", "medical", "doctor", "health", "clinic"),
    "education": ("school", "college", "university", "tuition", "education", "course"),
    "transfer": ("transfer", "neft", "imps", "rtgs", "upi", "sent to", "received from"),
    "investment": ("mutual fund", "sip", "stock", "trading", "zerodha", "groww", "fdsip"),
}
CHANNEL_KEYWORDS = {
    "UPI": ("upi", "bhim", "gpay", "phonepe", "paytm"),
    "NEFT": ("neft",),
    "RTGS": ("rtgs",),
    "IMPS": ("imps",),
    "CHEQUE": ("cheque", "chq", "cts"),
    "CASH": ("cash", "counter"),
    "ATM": ("atm",),
    "CARD": ("card", "pos", "swipe", "chip"),
}
RECURRING_KEYWORDS = (
    "emi", "auto-debit", "standing instruction", "recurring", "sip", "subscription", "monthly", "annual", "quarterly",
)
FEATURE_GROUPS = {
    "credit_characteristics": ("credit", "score", "utilization"),
    "financial_ratios": ("ratio", "dti", "income", "balance"),
    "loan_attributes": ("loan", "installment", "interest"),
    "demographic": ("home", "employment", "addr", "segment"),
    "behavioral": ("delinqu", "collection", "derogatory"),
    "text_derived": ("tfidf", "tf_", "text"),
    "temporal": ("date", "month", "year", "time"),
}
ACTIONS = (
    "APPROVE - Standard terms",
    "APPROVE - Enhanced monitoring recommended",
    "REVIEW - Additional documentation required",
    "CONDITIONAL - Higher interest rate / collateral required",
    "DECLINE - High default risk",
)
RISK_CLASSES = ("Very Low", "Low", "Medium", "High", "Very High")
RISK_EDGES = (0.1, 0.25, 0.5, 0.75)
# ---- end of fixed values ----------------------------------------------------------


def first_match(conditions: Sequence[tuple[Column, object]], default: object) -> Column:
    """CASE WHEN over ordered (condition, value) pairs."""
    (head, value), *rest = conditions
    chain = F.when(head, F.lit(value))
    for cond, v in rest:
        chain = chain.when(cond, F.lit(v))
    return chain.otherwise(F.lit(default))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_keyword(text: Column, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """Name of the first group with a keyword in `text`, ignoring case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_match([(contains_any(low, words), name) for name, words in groups.items()], default)


def parse_date(s: Column) -> Column:
    """First pattern that parses, day-first before month-first; otherwise NULL."""
    s = F.trim(s)
    tries = [F.try_to_timestamp(s, F.lit(p)) for p in DATE_PATTERNS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def safe_number(s: Column) -> Column:
    """Digits, '.', '-' of the text as a number; 0 if that is none."""
    return F.coalesce(F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def infer_category(description: Column) -> Column:
    return first_keyword(description, CATEGORY_KEYWORDS, "other")


def infer_channel(description: Column) -> Column:
    return first_keyword(description, CHANNEL_KEYWORDS, "NEFT")


def is_recurring(description: Column) -> Column:
    return contains_any(F.lower(F.coalesce(description, F.lit(""))), RECURRING_KEYWORDS)


def festival_multiplier(month: Column) -> Column:
    return first_match(
        [
            (month.isin(10, 11), 1.4),
            (month.isin(11, 12, 1, 2, 3), 1.2),
            (month.isin(4, 5, 6), 1.15),
            (month.isin(12), 1.1),
        ],
        1.0,
    )


def banded(p: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Left-closed bands: the first edge above `p` names the band; NULL stays NULL."""
    bands = first_match([(p < e, n) for e, n in zip(edges, names)], names[-1])
    return F.when(p.isNotNull(), bands)


def risk_category(p: Column) -> Column:
    return banded(p, RISK_EDGES, RISK_CLASSES)


def risk_category_cut(p: Column) -> Column:
    """Right-closed form: 0 and values outside (0, 1] have no class."""
    inside = (p > 0) & (p <= 1)
    return F.when(inside, first_match([(p <= e, n) for e, n in zip(RISK_EDGES, RISK_CLASSES)], RISK_CLASSES[-1]))


def risk_band3(p: Column) -> Column:
    return banded(p, (0.3, 0.6), ("low_risk", "medium_risk", "high_risk"))


def recommended_action(p: Column) -> Column:
    return banded(p, RISK_EDGES, ACTIONS)


def officer_action(p: Column) -> Column:
    return banded(
        p,
        (0.3, 0.6),
        (
            "APPROVE – Low risk applicant",
            "REVIEW – Moderate risk, consider additional documentation",
            "DECLINE – High risk applicant",
        ),
    )


def executive_action(p: Column) -> Column:
    return banded(p, (0.3, 0.6), ("Approve", "Review further", "Decline"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def row_hash(**fields: Column) -> Column:
    """16 hex digits of SHA-256 over the JSON of the fields in name order."""
    doc = F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})
    return F.left(F.sha2(doc, 256), F.lit(16))


def flatten_struct(column: str, schema: T.StructType, sep: str = "/") -> Column:
    """Nested struct to a map of joined key paths and string values."""

    def leaves(path: str, key: str, node: T.StructType) -> list[Column]:
        out: list[Column] = []
        for f in node.fields:
            k = f"{key}{sep}{f.name}" if key else f.name
            if isinstance(f.dataType, T.StructType):
                out += leaves(f"{path}.`{f.name}`", k, f.dataType)
            else:
                out += [F.lit(k), F.col(f"{path}.`{f.name}`").cast("string")]
        return out

    return F.create_map(*leaves(f"`{column}`", "", schema))


def psi_class(x: Column) -> Column:
    return banded(x, (0.1, 0.2), ("stable", "moderate", "significant"))


def feature_category(name: Column) -> Column:
    return first_keyword(name, FEATURE_GROUPS, "other")


def humanize(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def ratio(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """num / den where den is positive, otherwise a constant; safe under ANSI mode."""
    return F.coalesce(F.when(den > 0, F.try_divide(num.cast("double"), den.cast("double"))), F.lit(otherwise))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Limit x to [lo, hi]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))))


def flag(cond: Column) -> Column:
    """1 if true, otherwise 0 (also for NULL)."""
    return F.when(cond, 1).otherwise(0)
