"""Text features over documents: terms, phrases, entities, readability, chunks, retrieval.

Whole texts are processed. Work inside one text is array expressions; only term counts and
corpus statistics are shuffled, after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import contains_any
from riskloom.functions.text import sentiment, word_list
from riskloom.session import cut_lineage

_c = F.col

# ---- fixed values -----------------------------------------------------------------
RISK_PHRASES = (
    ("inability to meet financial obligations", "financial_distress", "high"),
    ("cash flow difficulties", "financial_distress", "high"),
    ("working capital shortage", "financial_distress", "high"),
    ("unable to service debt", "financial_distress", "high"),
    ("losses for consecutive quarters", "financial_distress", "high"),
    ("negative net worth", "financial_distress", "high"),
    ("key management departure", "operational", "medium"),
    ("customer concentration risk", "operational", "medium"),
    ("supply chain disruption", "operational", "medium"),
    ("regulatory non-compliance", "operational", "medium"),
    ("sarfaesi notice issued", "legal", "high"),
    ("drt proceedings initiated", "legal", "high"),
    ("criminal complaint filed", "legal", "high"),
    ("garnishee order", "legal", "high"),
    ("material uncertainty related to going concern", "going_concern", "critical"),
    ("requires debt restructuring for survival", "going_concern", "critical"),
)
NEGATIONS = (" no ", " not ", " never ", " without ")
CONDITIONS = (" if ", " may ", " could ", " unless ")
HISTORY = (" previously ", " has since ", " in the past ", " formerly ")
ENTITY_PATTERNS = {
    "amount": r"(?:₹|Rs\.?|INR|\$|€)\s?\d[\d,]*(?:\.\d+)?",
    "percent": r"\d+(?:\.\d+)?\s?%",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b",
    "phone": r"\+\d{1,3}[ -]?\(?\d{2,5}\)?[ -]\d{3,5}(?:[ -]\d{3,5})?",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "gst": r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z]\w\b",
    "legal_section": r"[Ss]ection \d+(?:\(\d+\))?",
}
# ---- end of fixed values ----------------------------------------------------------

ASPECTS = {
    "revenue": ("revenue", "sales", "growth"),
    "management": ("management", "director", "promoter"),
    "market": ("market", "competitor", "share"),
    "regulatory": ("regulation", "compliance", "penalty"),
    "liquidity": ("liquidity", "cash", "reserve"),
}
TOKEN = r"[\p{L}\p{N}_]{2,}"


def english_stop_words() -> list[str]:
    return sorted(StopWordsRemover.loadDefaultStopWords("english"))


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    if not stop:
        return words
    return F.filter(words, lambda w: ~w.isin(*stop))


def one_two_grams(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def tfidf(df: DataFrame, key: str, text: str, terms: int = 50, least_docs: int = 2, stop: Sequence[str] | None = None) -> DataFrame:
    """(key, term, weight) of the most frequent 1- and 2-grams: smooth idf, rows of length one.

    A 2-gram is not more frequent than its first word, and comes after it in a tie: so only the
    2-grams that begin with one of the most frequent words are counted. Terms are ranked by their
    number among those in `least_docs` rows, and their keys counted exactly for the first ones; a
    term whose rows have fewer keys leaves its place to the next.
    """
    words = cut_lineage(df.select(key, tokens(_c(text), english_stop_words() if stop is None else stop).alias("words")))
    wanted = terms
    while True:
        first = _most_frequent(words, "words", least_docs, wanted)
        starts = [r["term"] for r in first.select("term").collect()]
        words_and_pairs = words.select(key, "words", _pairs_from(_c("words"), starts).alias("pairs"))
        top = first.unionByName(_most_frequent(words_and_pairs, "pairs", least_docs, wanted)).orderBy(_c("total").desc(), "term").limit(wanted).collect()
        chosen = F.filter(F.concat("words", "pairs"), lambda g: g.isin([r["term"] for r in top]))
        counts = cut_lineage(words_and_pairs.select(key, F.explode(chosen).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
        docs = {r["term"]: r["docs"] for r in counts.groupBy("term").agg(F.count(F.lit(1)).alias("docs")).collect()}
        kept = [r["term"] for r in top if docs[r["term"]] >= least_docs][:terms]
        if len(kept) == terms or len(top) < wanted:
            break
        wanted *= 2
    n = df.agg(F.count(F.lit(1))).scalar()
    vocabulary = df.sparkSession.createDataFrame([(t, docs[t]) for t in kept], "term string, docs long")
    raw = counts.join(F.broadcast(vocabulary), "term").select(
        key, "term", (_c("tf") * (F.log((1 + n) / (1 + _c("docs"))) + 1)).alias("w")
    )
    norm = F.sqrt(F.sum(_c("w") * _c("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (_c("w") / norm).alias("weight"))


def _pairs_from(words: Column, starts: Sequence[str]) -> Column:
    """The 2-grams that begin with one of these words."""
    later = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_compact(F.zip_with(F.slice(words, F.lit(1), F.size(later)), later, lambda a, b: F.when(a.isin(list(starts)), F.concat_ws(" ", a, b))))


def _most_frequent(rows: DataFrame, grams: str, least_rows: int, n: int) -> DataFrame:
    """(term, total) of the n most frequent of an array column, among those in enough rows."""
    every = rows.select(F.explode(grams).alias("term"), F.lit(1).alias("total"), F.lit(0).alias("rows"))
    once = rows.select(F.explode(F.array_distinct(grams)).alias("term"), F.lit(0).alias("total"), F.lit(1).alias("rows"))
    sums = every.unionByName(once).groupBy("term").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    return sums.where(_c("rows") >= least_rows).orderBy(_c("total").desc(), "term").limit(n).select("term", "total")


def sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def risk_phrases(df: DataFrame, key: str, text: str, phrases: Sequence[tuple[str, str, str]] = RISK_PHRASES) -> DataFrame:
    """Dictionary phrases per sentence with category and severity, and whether negation,
    condition or history words occur within two sentences around."""
    s = df.select(key, sentences(_c(text)).alias("ss"))
    rows = s.select(key, "ss", F.posexplode("ss").alias("pos", "sentence"))
    entry = lambda p: F.struct(*[F.lit(v).alias(n) for n, v in zip(("phrase", "category", "severity"), p)])
    low = F.lower("sentence")
    found = F.array_compact(F.array(*[F.when(low.contains(p[0]), entry(p)) for p in phrases]))
    first = F.greatest(_c("pos") - 1, F.lit(1))
    around = F.concat(F.lit(" "), F.lower(F.array_join(F.slice("ss", first, _c("pos") + 4 - first), " ")), F.lit(" "))
    hits = rows.select(key, "pos", around.alias("around"), F.explode_outer(found).alias("h")).where(_c("h").isNotNull())
    return hits.select(
        key, "pos", "h.phrase", "h.category", "h.severity",
        contains_any(_c("around"), NEGATIONS).alias("negated"),
        contains_any(_c("around"), CONDITIONS).alias("conditional"),
        contains_any(_c("around"), HISTORY).alias("historical"),
    )


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value) of every entity found by pattern."""


    def found(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    every = F.concat(*[found(k, p) for k, p in ENTITY_PATTERNS.items()])
    return df.select(key, F.explode(every).alias("e")).select(key, "e.kind", "e.value")


def specificity(text: Column) -> Column:
    """Entities per word."""
    n = reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in ENTITY_PATTERNS.values()])
    words = F.size(word_list(text))
    return F.when(words > 0, n / words).otherwise(F.lit(0.0))


def readability(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words, sentences, words per sentence, long-word share, and a grade-level index."""
    words = word_list(_c(text))
    base = df.select(
        key,
        F.size(words).alias("words"),
        F.size(sentences(_c(text))).alias("sentences"),
        F.size(F.filter(words, lambda w: F.length(w) > 6)).alias("long_words"),
    )
    per, share = F.try_divide(_c("words"), _c("sentences")), F.try_divide(_c("long_words"), _c("words"))
    return base.select(
        key, "words", "sentences", "long_words", per.alias("words_per_sentence"), share.alias("long_word_share"),
        (per + 100 * share).alias("lix"),
    )


def term_density(df: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """Share of words that are terms of a list."""
    words = tokens(_c(text))
    hit = F.size(F.filter(words, lambda w: w.isin(*terms)))
    return df.select(key, F.when(F.size(words) > 0, hit / F.size(words)).otherwise(F.lit(0.0)).alias("term_density"))


def aspect_sentiment(df: DataFrame, key: str, text: str, aspects: Mapping[str, Sequence[str]] = ASPECTS) -> DataFrame:
    """Mean and volatility of sentence sentiment per text and aspect."""
    s = df.select(key, F.explode(sentences(_c(text))).alias("sentence"))
    about = F.array_compact(F.array(*[F.when(contains_any(F.lower("sentence"), w), F.lit(a)) for a, w in aspects.items()]))
    rows = s.select(key, F.explode(about).alias("aspect"), sentiment(_c("sentence")).alias("s")).select(
        key, "aspect", _c("s.polarity").alias("v")
    )
    return rows.groupBy(key, "aspect").agg(
        F.count(F.lit(1)).alias("sentences"), F.avg("v").alias("mean_sentiment"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("volatility")
    )


def chunk(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 128, keep: Sequence[str] = ()) -> DataFrame:
    """Overlapping token chunks with their position."""
    step = size - overlap
    words = df.select(key, *keep, word_list(_c(text)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.ceil((F.size("words") - overlap) / step) - 1, F.lit(0)).cast("int")
    rows = words.select(key, *keep, "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.slice("words", _c("chunk") * step + 1, F.lit(size))
    return rows.select(key, *keep, "chunk", F.size(part).alias("tokens"), F.array_join(part, " ").alias("content"))


def bm25(df: DataFrame, key: str, text: str, query: Sequence[str], k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Top-k texts for a query. Texts are reduced to the counts of the query terms in place, so
    only their statistics are shuffled."""
    words = df.select(key, text).select(key, tokens(_c(text)).alias("words"))
    size = F.size("words")
    # Kept as a table: a few numbers per text, read by the statistics and the scores.
    counts = cut_lineage(
        words.select(
            key, size.alias("len"), *[(size - F.size(F.array_remove("words", q))).alias(f"q{i}") for i, q in enumerate(query)]
        )
    )
    stats = counts.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"),
            *[F.count(F.when(_c(f"q{i}") > 0, 1)).alias(f"d{i}") for i in range(len(query))],
        ).alias("s")
    ).scalar()
    score = F.lit(0.0)
    for i in range(len(query)):
        d = stats[f"d{i}"]
        idf = F.log(1 + (stats["n"] - d + 0.5) / (d + 0.5))
        tf = _c(f"q{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * _c("len") / stats["avg"]))
    return counts.select(key, score.alias("score")).where(_c("score") > 0).orderBy(_c("score").desc(), key).limit(k)


def dense_topk(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 10) -> DataFrame:
    """Top-k rows by cosine similarity to a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    size = F.sqrt(total(F.transform(v, lambda x: x * x)))
    norm = sum(x * x for x in query) ** 0.5
    return df.select(key, F.try_divide(dot, size * norm).alias("score")).orderBy(_c("score").desc(), key).limit(k)


def hybrid_rank(a: DataFrame, b: DataFrame, key: str, k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two top-k lists (both are short)."""
    rank = lambda df: df.select(key, (1.0 / (c + F.row_number().over(Window.orderBy(_c("score").desc(), key)))).alias("r"))
    both = rank(a).unionByName(rank(b)).groupBy(key).agg(F.sum("r").alias("score"))
    return both.orderBy(_c("score").desc(), key).limit(k)


def topics(df: DataFrame, key: str, text: str, k: int = 5, vocabulary: int = 1000, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(topic, term, weight) of the ten strongest terms per topic."""
    words = df.select(key, tokens(_c(text), english_stop_words()).alias("words"))
    cv = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2).fit(words)
    lda = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online").fit(cv.transform(words))
    vocab = F.array(*[F.lit(w) for w in cv.vocabulary])
    t = lda.describeTopics(10).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("z"))
    return t.select("topic", F.element_at(vocab, _c("z.termIndices") + 1).alias("term"), _c("z.termWeights").alias("weight"))
