"""Log probability of texts under a hierarchical Pitman-Yor model (operator 6).

Tokens are words (parts between white space, A-Z in lower case) and the end of a text; all tokens
unseen in training are one more dish, as in the add-one unigram base. A token's context is the
whole token before it (the end of a text before the first one): one restaurant for each distinct
token that stands before another. The parent of all of them is the root, whose base serves all
V + 1 dishes alike. The customers of a context are the training counts of its pairs; each table
there is a customer of the root.

Gibbs sampling: in a sweep, the customers of each dish of each restaurant leave and are seated
again, given the other dishes' tables and the parent's probabilities. The first 8 customers of a
dish are seated one by one, later ones in groups that grow by an eighth, with the probabilities
of the group's beginning. The root is seated given the contexts' tables, then the contexts given
the root, then both again; predictive probabilities are averaged over the last sweeps of the
contexts but the first. Customers and tables of a restaurant are always those of the same sample,
so the dishes of a context add up to one. Discounts come from counts of counts,
d = n1 / (n1 + 2 n2); the strength is 1. Random numbers are seeded by bucket, so a task that runs
again gives the same values.

Data flow: pairs are dealt to buckets by the hash of the context, so a restaurant is whole in its
bucket, and the dishes of the root are dealt to shards by the hash of the word. Buckets and shards
exchange packed numbers in an order that both know (customers of the root up, customers and tables
of the root down); the words' hashes are sent once, later rows carry the words' shards. A chunk of texts asks buckets for its distinct
pairs and gets counts and tables back, from which it computes the probabilities. The driver sees
only sums over the whole model. Every group has the fixed size of a chunk or the share of a bucket
or shard; a context with very many different words after it is one restaurant, in one bucket.

Special cases: a null or empty text has one token, the end; without training rows all tokens are
unseen and have probability 1; repeated rows give a row each; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.grams import LOW, PairTable, about, chunk_pairs, deltas, encode_tokens, neighbours, planes, renumbered, tokens_of, undeltas, unplanes
from riskloom.session import cut_lineage

_c = F.col
STRENGTH = 1.0
SWEEPS = 4
ALONE = 8  # customers of a dish that are seated one by one
CHUNK = 16 << 20


def seat(customers: np.ndarray, tables: np.ndarray, total: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables: each dish's customers leave and come back, given the other dishes'
    tables. `total` are the tables of the dish's whole restaurant."""
    others = np.maximum(total - tables, 0)
    new = np.minimum(customers, 1)
    seated = new.copy()
    open_ = np.flatnonzero(customers > 1)
    while len(open_):
        t, k = new[open_], seated[open_]
        group = np.minimum(np.maximum(1, k // ALONE), customers[open_] - k)
        fresh = (STRENGTH + discount * (others[open_] + t)) * parent[open_]
        new[open_] = t + rng.binomial(group, fresh / (fresh + k - discount * t))
        seated[open_] = k + group
        open_ = open_[seated[open_] < customers[open_]]
    return new


def chance(own: np.ndarray, tables: np.ndarray, customers, all_tables, parent: np.ndarray, discount: float) -> np.ndarray:
    """Probability of dishes with `own` customers and these tables, in restaurants of so many
    `customers` and `all_tables`."""
    return (own - discount * tables + (STRENGTH + discount * all_tables) * parent) / (STRENGTH + customers)


@dataclass
class Totals:
    """Sums over the whole model: training tokens and distinct ones, the discounts of contexts
    and root, and customers and tables of the root."""

    tokens: int
    types: int
    context_discount: float
    root_discount: float
    customers: int
    tables: int

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words at the root."""
        return chance(customers, tables, self.customers, self.tables, np.full(len(customers), 1 / (self.types + 1)), self.root_discount)


class Contexts:
    """The restaurants of a bucket."""

    def __init__(self, table: PairTable):
        self.size = len(table.hashes)
        self.context, self.word = table.pairs >> 32, table.pairs & LOW
        self.customers, self.tables = table.counts, np.minimum(table.counts, 1)

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sums over each restaurant, by the number of its token."""
        return np.bincount(self.context, x, self.size).astype(np.int64)

    def of_words(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, x, self.size).astype(np.int64)

    def sweep(self, root: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        self.tables = seat(self.customers, self.tables, self.total(self.tables)[self.context], root[self.word], discount, rng)


MERGED = "bucket int, chunk long, hashes binary, words binary, pairs binary, counts binary, once long, twice long"


def merge_pairs(pairs: DataFrame, shards: int) -> DataFrame:
    """Per bucket a row with chunk -1: its tokens (hashes, and as words their shards), pairs and
    training counts; and per chunk the places of that chunk's tokens and pairs among them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        parts = [PairTable.unpacked(*x) for x in zip(pdf["words"], pdf["pairs"], pdf["counts"], strict=True)]
        v = PairTable.merged(parts)
        hashes, *packed = v.packed()
        rows = [(bucket, -1, hashes, planes(shard_of(v.hashes, shards).astype(np.int32)), *packed, int((v.counts == 1).sum()), int((v.counts == 2).sum()))]
        for chunk, p in zip(pdf["chunk"], parts, strict=True):
            number = np.searchsorted(v.hashes, p.hashes)
            rows.append((bucket, int(chunk), None, deltas(number), deltas(np.searchsorted(v.pairs, renumbered(p.pairs, number))), None, 0, 0))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MERGED.split(", ")])

    return cut_lineage(pairs.groupBy("bucket").applyInPandas(run, MERGED))


def table_of(row) -> tuple[PairTable, np.ndarray]:
    """The tokens, pairs and counts of a bucket, and the shards of its tokens, which alone go with
    the rows that are shuffled: there the tokens have no hashes but zeros."""
    shard = unplanes(row["words"], np.int32)
    hashes = row.get("hashes")
    return PairTable.unpacked(planes(np.zeros(len(shard), np.uint64)) if hashes is None else hashes, row["pairs"], row["counts"]), shard


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes % np.uint64(shards)).astype(np.int64)


ROOT = "shard int, n binary, customers binary, buckets array<int>, places array<binary>, tokens long, types long, all_customers long, once long, twice long"


def root_row(shard: int, n: np.ndarray, customers: np.ndarray, buckets: list, places: list) -> pd.DataFrame:
    sums = [int(x) for x in (n.sum(), (n > 0).sum(), customers.sum(), (customers == 1).sum(), (customers == 2).sum())]
    return pd.DataFrame([(shard, planes(n), planes(customers), buckets, places, *sums)], columns=[x.split()[0] for x in ROOT.split(", ")])


def root_words(own: DataFrame) -> DataFrame:
    """One row per shard: training counts of its words, in how many contexts each stands (their
    first tables), and the places of each bucket's words among them."""

    def asked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                table, shard = table_of(row)
                rest = Contexts(table)
                n, customers = rest.of_words(rest.customers), rest.of_words(rest.tables)
                mine = [(int(s), np.flatnonzero(shard == s)) for s in np.unique(shard)]
                yield pd.DataFrame([(s, row["bucket"], planes(table.hashes[i]), planes(n[i]), planes(customers[i])) for s, i in mine], columns=["shard", "bucket", "words", "n", "customers"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [unplanes(x, np.uint64) for x in pdf["words"]]
        value, back = np.unique(np.concatenate(words), return_inverse=True)
        total = lambda c: np.bincount(back, np.concatenate([unplanes(x, np.int64) for x in pdf[c]]), len(value)).astype(np.int64)
        return root_row(int(pdf["shard"].iloc[0]), total("n"), total("customers"), pdf["bucket"].tolist(), [deltas(np.searchsorted(value, w)) for w in words])

    rows = own.mapInPandas(asked, "shard int, bucket int, words binary, n binary, customers binary")
    return cut_lineage(rows.groupBy("shard").applyInPandas(merge, ROOT))


def seated_root(root: DataFrame, before: Totals | None, pairs_once: int, pairs_twice: int, round_: int) -> tuple[DataFrame, Totals]:
    """The root seated anew: per bucket and shard the training counts, customers and tables of the
    bucket's words; and the sums over the model."""
    s = root.agg(*(F.sum(x).alias(x) for x in ("tokens", "types", "all_customers", "once", "twice"))).first()
    n = {k: s[k] or 0 for k in s.asDict()}
    ratio = lambda n1, n2: float(min(max(n1 / (n1 + 2 * n2), 0.05), 0.95)) if n1 else 0.5
    tables = before.tables if before else n["types"]
    totals = Totals(n["tokens"], n["types"], ratio(pairs_once, pairs_twice), ratio(n["once"], n["twice"]), n["all_customers"], tables)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                counts, customers = unplanes(row["n"], np.int64), unplanes(row["customers"], np.int64)
                rng = np.random.default_rng([round_, int(row["shard"])])
                at = np.minimum(customers, 1)
                for _ in range(SWEEPS):
                    at = seat(customers, at, np.full(len(at), totals.tables), np.full(len(at), 1 / (totals.types + 1)), totals.root_discount, rng)
                rows = [(-1, row["shard"], None, None, None, int(at.sum()))]
                for bucket, place in zip(row["buckets"], row["places"], strict=True):
                    i = undeltas(place)
                    rows.append((bucket, row["shard"], planes(counts[i]), planes(customers[i]), planes(at[i]), 0))
                yield pd.DataFrame(rows, columns=["bucket", "shard", "n", "customers", "tables", "all_tables"])

    told = cut_lineage(root.mapInPandas(run, "bucket int, shard int, n binary, customers binary, tables binary, all_tables long"))
    totals.tables = told.where("bucket < 0").agg(F.sum("all_tables")).first()[0] or 0
    return told.where("bucket >= 0").select(_c("bucket").alias("of"), "shard", "n", "customers", "tables"), totals


def told_words(shard: np.ndarray, told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts, customers and tables at the root of a bucket's words."""
    out = np.zeros((3, len(shard)), np.int64)
    for s, *found in zip(told["shard"], told["n"], told["customers"], told["tables"], strict=True):
        mine = shard == s
        for k, x in enumerate(found):
            out[k, mine] = unplanes(x, np.int64)
    return out[0], out[1], out[2]


def seated_contexts(own: DataFrame, told: DataFrame, totals: Totals, root: DataFrame) -> DataFrame:
    """The rows of the root with new customers: the tables of the contexts after a round of sweeps."""

    def run(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        table, shard = table_of(own.iloc[0])
        rest = Contexts(table)
        _, customers, tables = told_words(shard, told)
        rng = np.random.default_rng([2, int(own["bucket"].iloc[0])])
        for _ in range(SWEEPS):
            rest.sweep(totals.root(customers, tables), totals.context_discount, rng)
        new = rest.of_words(rest.tables)
        rows = [(int(s), int(own["bucket"].iloc[0]), planes(new[shard == s])) for s in np.unique(shard)]
        return pd.DataFrame(rows, columns=["at", "bucket", "customers"])

    def merge(key: tuple, root: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        row = root.iloc[0]
        n = unplanes(row["n"], np.int64)
        customers = np.zeros(len(n), np.int64)
        places = dict(zip(row["buckets"], row["places"], strict=True))
        for bucket, x in zip(new["bucket"], new["customers"], strict=True):
            customers[undeltas(places[bucket])] += unplanes(x, np.int64)
        return root_row(int(row["shard"]), n, customers, row["buckets"], row["places"])

    new = own.drop("hashes").groupBy("bucket").cogroup(told.groupBy("of")).applyInPandas(run, "at int, bucket int, customers binary")
    return cut_lineage(root.groupBy("shard").cogroup(new.groupBy("at")).applyInPandas(merge, ROOT))


ANSWER = "chunk long, bucket int, counts binary, tables binary, context_customers binary, context_tables binary, n binary, customers binary, root_tables binary"


def answer_chunks(merged: DataFrame, told: DataFrame, totals: Totals) -> DataFrame:
    """Per chunk and bucket: training count and tables (summed over the samples) of its pairs, and
    of its tokens the same as contexts, their training counts, and their place at the root."""

    def run(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        table, shard = table_of(rows[rows["chunk"] < 0].iloc[0])
        rest = Contexts(table)
        n, customers, root_tables = told_words(shard, told)
        root = totals.root(customers, root_tables)
        rng = np.random.default_rng([4, int(rows["bucket"].iloc[0])])
        tables = np.zeros(len(rest.context), np.int64)
        for sweep in range(SWEEPS):
            rest.sweep(root, totals.context_discount, rng)
            if sweep:
                tables += rest.tables
        of_tokens = (rest.total(rest.customers), rest.total(tables), n, customers, root_tables)
        out = []
        for _, asked in rows[rows["chunk"] >= 0].iterrows():
            pair, word = undeltas(asked["pairs"]), undeltas(asked["words"])
            out.append((asked["chunk"], asked["bucket"], planes(rest.customers[pair]), planes(tables[pair]), *(planes(x[word]) for x in of_tokens)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWER.split(", ")])

    return merged.drop("hashes").groupBy("bucket").cogroup(told.groupBy("of")).applyInPandas(run, ANSWER)


SUMS = "row_key long, id string, lang string, trained boolean, n_tokens long, n_known long, log_counts double, log_p double"


def add_up(texts: DataFrame, answered: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """Sums over the tokens of each text."""

    def run(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        t = own.iloc[0]
        tokens, n_tokens = tokens_of(t)
        pairs, where = np.unique(neighbours(tokens), return_inverse=True)
        table = PairTable(unplanes(t["places"], np.int32).astype(np.uint64), pairs, pairs)  # buckets stand for the hashes
        logs, counts = np.zeros(len(pairs)), np.zeros(len(table.hashes), np.int64)
        answer = got.set_index("bucket")
        for bucket, mine, used in table.buckets(buckets):
            own_n, own_t, ctx_n, ctx_t, n, customers, tables = (unplanes(answer.at[bucket, x.split()[0]], np.int64) for x in ANSWER.split(", ")[2:])
            at = table.part(mine, used).pairs
            context, samples = at >> 32, SWEEPS - 1
            p = chance(own_n, own_t / samples, ctx_n[context], ctx_t[context] / samples, totals.root(customers, tables)[at & LOW], totals.context_discount)
            logs[mine], counts[used] = np.log10(p), n
        begin = np.cumsum(n_tokens) - n_tokens
        counts = counts[tokens]
        per = lambda x: np.add.reduceat(x, begin)
        return pd.DataFrame({**about(t), "n_tokens": n_tokens, "n_known": per((counts > 0).astype(np.int64)), "log_counts": per(np.log10(counts + 1.0)), "log_p": per(logs[where])})

    return texts.drop("hashes").groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(run, SUMS)


def text_log_probabilities(docs: DataFrame, train: Column) -> DataFrame:
    """id, trained, n_tokens, n_known, train_tokens, base_score, score (log10 of the probability of
    the text) and perplexity per token, learned from the rows where `train` holds."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * shards  # pairs are many more than words
    chunks = encode_tokens(docs, train, buckets, CHUNK)
    merged = merge_pairs(chunk_pairs(chunks, buckets), shards)
    own = merged.where("chunk < 0")
    pairs = own.agg(F.sum("once"), F.sum("twice")).first()
    once, twice = pairs[0] or 0, pairs[1] or 0
    root = root_words(own)
    told, totals = seated_root(root, None, once, twice, 1)
    root = seated_contexts(own, told, totals, root)
    told, totals = seated_root(root, totals, once, twice, 3)
    n, v = totals.tokens, totals.types
    return add_up(chunks, answer_chunks(merged, told, totals), totals, buckets).select(
        "id", "trained", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (_c("log_counts") - _c("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), _c("log_p").alias("score"),
        F.pow(F.lit(10.0), -_c("log_p") / _c("n_tokens")).alias("perplexity"),
    )
