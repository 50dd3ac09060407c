"""Language identification by a convolutional network over bytes (operator 8).

Texts (A-Z in lower case) are cut into windows of `WINDOW` bytes, the last one padded; the
network gives the class probabilities of every window, and a text takes the class with the
largest mean of their logarithms. All windows of the whole text count; no shuffle.

Fit: about `per_language` labelled documents of each language (those with small hashes of their
id), each with up to `windows` of its windows; the languages are the values found there.

Special cases: a null text, or one without any letter, is `und` with score 0; rows without a
language are not learned from; without any labelled row every text is `und`; repeated rows are
predicted alike; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.bytetext import blocks, lower
from riskloom.llm.convnet import ConvNet

_c = F.col
WINDOW = 192
WIDTHS, FILTERS, DIM = (2, 3, 4), 16, 8


def windows_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some texts, one row each, and the text of every row."""
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    begin = starts[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < (starts + sizes)[text][:, None]
    return np.where(inside, lower(data)[np.minimum(at, len(data) - 1)], 0), text


def fit(labelled: DataFrame, per_language: int = 1500, windows: int = 4, epochs: int = 4) -> tuple[list[str], ConvNet | None]:
    """Fit on rows with text and lang."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return [], None
    names = sorted(counts)
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.coalesce(*[F.when(_c("lang") == x, int(1_000_000 * min(1.0, per_language / counts[x]))) for x in names])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=1 << 20):
            w, text = windows_of(block.data, block.starts, block.sizes)
            langs = block.rows.column("lang").to_pylist()
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            n = np.bincount(text, minlength=len(langs))[text]
            take = np.flatnonzero((rank * windows) // np.maximum(n, 1) != ((rank - 1) * windows) // np.maximum(n, 1)) if len(text) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[text[i]] for i in take], pa.string()), pa.array([w[i].astype(np.uint8).tobytes() for i in take], pa.binary())], ["lang", "window"]
            )

    found = rows.where(spot < share).mapInArrow(cut, "lang string, window binary").limit(2 * per_language * windows * len(names)).collect()
    if not found:
        return [], None
    labels = np.array([names.index(r["lang"]) for r in found])
    sequences = [np.frombuffer(r["window"], np.uint8) for r in found]
    weights = (len(labels) / len(names) / np.maximum(np.bincount(labels, minlength=len(names)), 1))[labels].astype(np.float32)
    net = ConvNet.new(256, DIM, WIDTHS, FILTERS, len(names))
    return names, net.fit(sequences, labels, weights, epochs, drop=0.1)


def predict(docs: DataFrame, names: list[str], net: ConvNet | None) -> DataFrame:
    """The documents with lang_pred and score (the probability of that language)."""
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: 256 symbols
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model else None
        for block in blocks(batches, limit=1 << 19):
            n = len(block.sizes)
            logs = np.zeros((n, max(1, len(names))))
            if model:
                w, text = windows_of(block.data, block.starts, block.sizes)
                for a in range(0, len(w), 2048):  # a text may be longer than a block
                    part = w[a : a + 2048]
                    ids = np.concatenate((part, np.zeros((len(part), model.reach), part.dtype)), 1)
                    first = np.arange(len(part)) * ids.shape[1]
                    p = model.probabilities(model.pooled(ids.ravel(), first, np.full(len(part), WINDOW), tables))
                    np.add.at(logs, text[a : a + 2048], np.log(p + 1e-12))
                logs /= np.maximum(np.bincount(text, minlength=n), 1)[:, None]
            best = logs.argmax(1)
            p = np.exp(logs - logs.max(1, keepdims=True))
            score = p.max(1) / p.sum(1)
            pred = [names[i] if names else "und" for i in best]
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(pred, pa.string()), pa.array(score)], [*block.rows.schema.names, "lang_pred", "score"])

    known = F.coalesce(_c("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(names))
    return (
        kept.mapInArrow(run, schema)
        .withColumn("score", F.when(known, _c("score")).otherwise(0.0))
        .withColumn("lang_pred", F.when(known, _c("lang_pred")).otherwise("und"))
    )
