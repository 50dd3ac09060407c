"""Text cleaning, counts and a small sentiment lexicon."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import contains_any, flag

# ---- fixed values -----------------------------------------------------------------
FINANCIAL_TERMS = (
    "income", "debt", "credit", "loan", "payment", "interest", "balance", "default", "risk", "score",
)
RISK_KEYWORDS = (
    "struggle", "difficulty", "hardship", "late", "missed", "overdue", "delinquent", "past due",
)
# ---- end of fixed values ----------------------------------------------------------

# Own word scores: (polarity, subjectivity).
LEXICON: dict[str, tuple[float, float]] = {
    "good": (0.7, 0.6), "great": (0.8, 0.75), "excellent": (1.0, 1.0), "stable": (0.4, 0.3),
    "strong": (0.5, 0.5), "growth": (0.4, 0.3), "profit": (0.5, 0.3), "improve": (0.4, 0.4),
    "bad": (-0.7, 0.65), "poor": (-0.5, 0.6), "weak": (-0.4, 0.5), "loss": (-0.5, 0.3),
    "late": (-0.3, 0.5), "default": (-0.6, 0.3), "hardship": (-0.7, 0.6), "struggle": (-0.6, 0.6),
    "difficult": (-0.5, 0.7), "missed": (-0.4, 0.4), "overdue": (-0.5, 0.3), "stress": (-0.5, 0.5),
}


def clean_text(s: Column) -> Column:
    low = F.lower(F.coalesce(s, F.lit("")))
    letters = F.regexp_replace(low, r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def word_list(s: Column) -> Column:
    """Words split at white space, without empty ones."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), r"\s+"), lambda w: w != "")


def text_stats(s: Column) -> dict[str, Column]:
    """Counts over the raw text, named as the feature columns."""
    t = F.coalesce(s, F.lit(""))
    low = F.lower(t)
    words = F.size(word_list(t))
    in_words = F.length(F.regexp_replace(t, r"\s+", ""))
    return {
        "text_length": F.length(t),
        "word_count": words,
        "avg_word_length": F.when(words > 0, in_words / words).otherwise(F.lit(0.0)),
        "num_uppercase": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "num_special_chars": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")),
        "has_financial_terms": flag(contains_any(low, FINANCIAL_TERMS)),
        "risk_keywords_count": reduce(lambda a, b: a + b, [flag(low.contains(k)) for k in RISK_KEYWORDS]),
    }


def combine_text(cols: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def sentiment(s: Column) -> Column:
    """Struct (polarity, subjectivity): mean over the lexicon words of the text.

    The lexicon is a map literal, so the text is scored in place, without a shuffle of
    exploded words.
    """
    words = F.filter(F.split(clean_text(s), " "), lambda w: w.isin(*LEXICON))

    def mean_of(part: int) -> Column:
        scores = F.create_map(*[F.lit(x) for w, v in LEXICON.items() for x in (w, v[part])])
        total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.element_at(scores, w))
        return F.when(F.size(words) > 0, total / F.size(words)).otherwise(F.lit(0.0))

    return F.named_struct(F.lit("polarity"), mean_of(0), F.lit("subjectivity"), mean_of(1))


def text_features(df: DataFrame, cols: Sequence[str], prefix: str = "tf_") -> DataFrame:
    """Joined text columns, counted on the raw text and scored; one column per feature."""
    whole = combine_text(cols)
    scored = df.withColumn("__s", sentiment(whole))
    out = scored.select(
        *df.columns,
        *[c.alias(f"{prefix}{n}") for n, c in text_stats(whole).items()],
        F.col("__s.polarity").alias(f"{prefix}sentiment_score"),
        F.col("__s.subjectivity").alias(f"{prefix}subjectivity"),
    )
    return out
