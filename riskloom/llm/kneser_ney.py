"""Quality by perplexity under an interpolated modified Kneser-Ney model (operator 7).

The model counts n-grams of bytes (see `grams`) of trusted texts: rows marked by a boolean column,
four fifths of which are learned from. Longer n-grams back off to continuation counts; the three
discounts of each length come from its counts of counts over all shards. A text's perplexity is
per byte. The fifth of the trusted texts that was not learned from gives, per language, a high
quantile of perplexity; texts beyond it are rejected.

Special cases: a null or empty text has one symbol, the end, and is judged like any other; a
language without trusted texts (also the null one) takes the quantiles over all trusted texts;
without any trusted text nothing is rejected; repeated rows give a row each; an empty table gives
no rows; columns other than doc_id, text, the mark and the language are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.grams import ORDER, Levels, chunk_grams, encode, gram_counts, marked, per_shard, score

_c = F.col


def continuation(levels: Levels, n: np.ndarray) -> dict[int, np.ndarray]:
    """Counts at each length: texts at the longest, distinct bytes before it at the others."""
    a = {ORDER: n}
    for k in range(ORDER, 3, -1):
        a[k - 1] = np.bincount(levels.up[k], a[k] > 0, len(levels.keys[k - 1])).astype(np.int64)
    return a


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more."""
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


def interpolated(a: np.ndarray, context: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Probabilities of one length from those of the length below."""
    n = context.max() + 1 if len(context) else 0
    cut = d[np.minimum(a, 3)]
    total = np.bincount(context, a, n)
    free = np.bincount(context, cut, n)
    some = total[context] > 0
    base = np.maximum(total[context], 1)
    return np.where(some, (a - cut + free[context] * lower) / base, lower)


def short_table(pairs: np.ndarray) -> np.ndarray:
    """Probabilities at length 2 (256 contexts x 256 bytes) from their continuation counts."""
    def d_of(a):
        return discounts(*(float((a == r).sum()) for r in (1, 2, 3, 4)))

    single = (pairs.reshape(256, 256) > 0).sum(0)
    one = interpolated(single, np.zeros(256, np.int64), np.full(256, 1 / 256), d_of(single))
    return interpolated(pairs, np.repeat(np.arange(256), 256), np.tile(one, 256), d_of(pairs))


def shard_statistics(counts: DataFrame) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Continuation counts at length 2, and counts of counts (1..4) by length. Bounded results."""

    def work(levels: Levels, n: np.ndarray, shard: int) -> pd.DataFrame:
        a = continuation(levels, n)
        pairs = np.bincount(levels.pairs[a[3] > 0], minlength=1)
        at = np.flatnonzero(pairs)
        rows = [pd.DataFrame({"level": 2, "at": at, "n": pairs[at]})]
        rows += [pd.DataFrame({"level": k, "at": [1, 2, 3, 4], "n": [int((a[k] == r).sum()) for r in (1, 2, 3, 4)]}) for k in a]
        return pd.concat(rows)

    found = per_shard(counts, work, "level int, at long, n long").groupBy("level", "at").agg(F.sum("n").alias("n")).collect()
    pairs, of = np.zeros(1 << 16, np.int64), {k: [0] * 4 for k in range(3, ORDER + 1)}
    for r in found:
        if r["level"] == 2:
            pairs[r["at"]] = r["n"]
        else:
            of[r["level"]][r["at"] - 1] = r["n"]
    return pairs, of


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(key, value): log10 probability of the newest byte of each n-gram after the others."""
    pairs, of = shard_statistics(counts)
    two, d = short_table(pairs), {k: discounts(*x) for k, x in of.items()}

    def work(levels: Levels, n: np.ndarray, shard: int) -> pd.DataFrame:
        a = continuation(levels, n)
        p = two[levels.pairs]
        for k in range(3, ORDER + 1):
            p = interpolated(a[k], levels.context[k], p if k == 3 else p[levels.up[k]], d[k])
        return pd.DataFrame({"key": levels.keys[ORDER].astype(np.int64), "value": np.log10(p)})

    return per_shard(counts, work, "key long, value double")


def perplexities(docs: DataFrame, trusted: Column, lang: Column, trusted_ids: DataFrame | None = None) -> DataFrame:
    """row_key (hash of doc_id and text), id, lang, trained, n_symbols and perplexity per text.
    `trusted_ids` (id as string, distinct) narrows the trusted rows to those with these ids."""
    aside = F.pmod(F.xxhash64("text"), F.lit(5)) == 0  # copies of a text fall on one side
    chunks = encode(docs, trusted & ~aside, lang)
    if trusted_ids is not None:
        chunks = marked(chunks, trusted_ids)
    grams = chunk_grams(chunks)
    rows = score(chunks, grams, log_probabilities(gram_counts(chunks, grams)))
    return rows.select("row_key", "id", "lang", "trained", "n_symbols", F.pow(F.lit(10.0), -_c("log_p") / _c("n_symbols")).alias("perplexity"))


def judged(scores: DataFrame, trusted_ids: DataFrame, high: float = 0.99) -> DataFrame:
    """The scores with the `limit` of their language and `rejected`. `trusted_ids` has the id
    (as string) of every trusted row; `scores` should be a written table."""
    held = scores.where(~_c("trained")).join(trusted_ids.select("id").distinct(), "id", "left_semi")
    cut = F.percentile_approx("perplexity", high, 10_000).alias("limit")
    by = held.groupBy(F.coalesce("lang", F.lit("")).alias("__lang")).agg(cut, F.count(F.lit(1)).alias("__n")).where("__n >= 50")
    every = held.agg(cut).first()["limit"]
    rows = scores.join(by.drop("__n"), F.coalesce(scores["lang"], F.lit("")) == by["__lang"], "left").drop("__lang")
    return rows.withColumn("limit", F.coalesce("limit", F.lit(every).cast("double"))).withColumn(
        "rejected", F.coalesce(_c("perplexity") > _c("limit"), F.lit(False))
    )
