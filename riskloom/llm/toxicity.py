"""Toxicity by a convolutional text classifier over hashed words (operator 5).

Words are hashed into 2^20 buckets; a bucket found in fewer than `least_texts` of the learned rows
has the symbol of rare words, so the network can't learn single texts by heart.

Fit: at most `most_rows` labelled rows (those with the smallest hash of their id) are collected
as word numbers; four fifths train the network, one fifth sets the thresholds: one over all
languages, by which scores are shifted so that 0.5 decides, and one per language for `flagged`
(languages with few toxic rows keep 0.5). Language is no input of a score.

Application: whole texts, max pooling over all words; no shuffle.

Special cases: a null or empty text is scored as a text without words; rows without a label are
not learned from; an empty set of labels, or one class only, gives that class's share as every
score; repeated rows are scored alike; result columns replace columns of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.bytetext import WORD_BYTES, blocks, lower, mix, owners, runs, span_hashes
from riskloom.llm.convnet import ConvNet

_c = F.col
BUCKETS = 1 << 20
RARE = 1
WIDTHS, FILTERS, DIM = (1, 2, 3), 16, 16


def word_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the words."""
    small = lower(data)
    first, last = runs(WORD_BYTES[small])
    return first, (mix(span_hashes(small, first, last)) % np.uint64(BUCKETS)).astype(np.int64)


def laid_out(first: np.ndarray, numbers: np.ndarray, starts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers with `gap` zeros after each text; starts and sizes."""
    row = owners(starts, first)
    sizes = np.bincount(row, minlength=len(starts)) if len(first) else np.zeros(len(starts), np.int64)
    at = np.cumsum(sizes + gap) - sizes - gap
    ids = np.zeros(int((sizes + gap).sum()) + gap, np.int64)
    ids[np.arange(len(first)) + row * gap] = numbers
    return ids, at, sizes


@dataclass
class ToxicityModel:
    net: ConvNet | None
    symbol: np.ndarray | None = None  # of each bucket
    shift: float = 0.0
    share: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def scores(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tables=None) -> np.ndarray:
        if self.net is None:
            return np.full(len(starts), self.share)
        p = np.clip(self.net.probabilities(self.net.pooled(ids, starts, sizes, tables))[:, 1].astype(float), 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-(np.log(p / (1 - p)) - self.shift)))


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut (score >= cut means toxic) with the highest F1, halfway to the next lower score."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[1:] == s[:-1]] = -1
    i = int(f1.argmax())
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0.0)) / 2)


def odds(words: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Log ratio of the shares of toxic and of other texts that hold each symbol: where training
    starts from, as max pooling alone finds rare words slowly."""
    seen = np.zeros((2, n))
    for i in rows:
        seen[labels[i], np.unique(words[i])] += 1
    total = np.array([[(labels[rows] == k).sum()] for k in (0, 1)])
    share = np.log((seen + 0.5) / (total + 1))
    out = share[1] - share[0]
    out[: RARE + 1] = 0
    return out


def fit(labelled: DataFrame, most_rows: int = 12_000, most_bytes: int = 96 << 20, epochs: int = 6, least_texts: int = 5) -> ToxicityModel:
    """Fit on rows with text, lang and toxic (0 or 1): the `most_rows` with the smallest hash of
    doc_id, as far as their texts hold `most_bytes`."""
    rows = labelled.where("toxic is not null").select("doc_id", "text", "lang", "toxic")

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            first, numbers = word_numbers(block.data)
            cut = np.searchsorted(first, np.append(block.starts, len(block.data)))
            words = [numbers[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("lang"), block.rows.column("toxic").cast(pa.int32()), pa.array(words, pa.binary())], ["lang", "toxic", "words"]
            )

    found, used = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).mapInArrow(coded, "lang string, toxic int, words binary").toLocalIterator():
        used += len(r["words"])
        if used > most_bytes:
            break
        found.append((r["lang"], r["toxic"], np.frombuffer(r["words"], "<u4")))
    labels = np.array([t for _, t, _ in found], np.int64)
    if len(found) < 10 or labels.min() == labels.max():
        return ToxicityModel(None, share=float(labels.mean()) if len(found) else 0.0)
    words = [w for *_, w in found]
    aside = np.array([zlib.crc32(w.tobytes()) % 5 == 0 for w in words])  # copies of a text fall on one side
    train = np.flatnonzero(~aside)
    weights = np.where(labels == 1, min(4.0, 0.5 / max(labels.mean(), 1e-3)), 1.0).astype(np.float32)
    seen = np.zeros(BUCKETS, np.int64)
    for i in train:
        seen[np.unique(words[i])] += 1
    symbol = np.full(BUCKETS, RARE, np.int32)
    common = np.flatnonzero(seen >= least_texts)
    symbol[common] = np.arange(len(common)) + RARE + 1
    words = [symbol[w] for w in words]
    net = ConvNet.new(len(common) + RARE + 1, DIM, WIDTHS, FILTERS, 2)
    net.embedding *= 0.3
    net.embedding[:, 0] = odds(words, labels, train, len(net.embedding)) / 4
    net.filters[0][0, 0, :2] = 1, -1  # max pooling then sees the most and the least toxic word from the start
    net.fit([words[i] for i in train], labels[train], weights[train], epochs)
    model = ToxicityModel(net, symbol)
    tables = net.tables()
    known, truth, langs = [], labels[aside], [found[i][0] for i in np.flatnonzero(aside)]
    for i in np.flatnonzero(aside):
        ids = np.concatenate((words[i].astype(np.int64), np.zeros(3 * net.reach, np.int64)))
        known.append(model.scores(ids, np.array([0]), np.array([len(words[i])]), tables)[0])
    known = np.array(known)
    if truth.any() and not truth.all():
        cut = min(max(best_cut(known, truth), 1e-6), 1 - 1e-6)
        model.shift = float(np.log(cut / (1 - cut)))
        moved = 1 / (1 + np.exp(-(np.log(np.clip(known, 1e-9, 1 - 1e-9) / np.clip(1 - known, 1e-9, 1)) - model.shift)))
        for lang in {x for x in langs if x is not None}:
            of = np.array([x == lang for x in langs])
            if truth[of].sum() >= 20:
                model.thresholds[lang] = best_cut(moved[of], truth[of])
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents with score, predicted (score >= 0.5) and flagged (score >= the threshold of
    the document's language)."""
    kept = docs.drop("score", "predicted", "flagged")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS symbols, of which the learned rows bound how many have weights
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = m.net.tables() if m.net else None
        gap = m.net.reach if m.net else 1
        for block in blocks(batches, limit=1 << 20):
            first, numbers = word_numbers(block.data)
            ids, at, sizes = laid_out(first, m.symbol[numbers] if m.net else numbers, block.starts, gap)
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(m.scores(ids, at, sizes, tables))], [*block.rows.schema.names, "score"])

    scored = kept.mapInArrow(run, schema)
    cut = F.lit(0.5)
    if "lang" in kept.columns:
        for lang, t in sorted(model.thresholds.items()):
            cut = F.when(_c("lang") == lang, t).otherwise(cut)
    return scored.withColumn("predicted", (_c("score") >= 0.5).cast("int")).withColumn("flagged", _c("score") >= cut)
