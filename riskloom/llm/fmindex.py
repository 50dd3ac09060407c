"""Benchmark decontamination with an FM-index per shard of the documents (operator 4).

A shard is some megabytes of texts inside a task. Its words are numbered by the benchmark's
vocabulary; a word outside it cannot be part of an occurrence, so the text is indexed as runs of
vocabulary words, each closed by a separator of its own, and runs shorter than the shortest
window are left out. The index of a shard is the Burrows-Wheeler transform of those runs (suffixes
sorted by prefix doubling), a wavelet matrix for ranks, and suffix positions sampled every
`sample` words and at each run's start. All windows are searched backward at once; occurrences
are located by walking to the next sample; hit words are merged into spans.

Windows: `width` consecutive words of an item; an item of fewer words, but not none, is one
window. Words are lower-cased (A-Z) runs of digits, letters a-z and characters beyond ASCII.

The benchmark is a query set searched in blocks: items are collected and broadcast in parts of at
most `part_bytes` of text (a longer item is a part of its own), and a task holds one part at a
time, so its size is bounded however many items there are. Documents are never shuffled.

Special cases: a null or empty text has no words and no hits; a null or wordless item has no
windows; repeated items count as items of their own, repeated documents give a row each; an empty
benchmark finds nothing, an empty table of documents gives no rows; result columns replace
columns of the same name, all other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.bytetext import WORD_BYTES, Block, blocks, lower, owners, runs, span_hashes

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("clean_text", T.StringType()),
    ]
)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words."""
    small = lower(data)
    first, last = runs(WORD_BYTES[small])
    return first, last, span_hashes(small, first, last)


@dataclass
class Windows:
    """Distinct windows of some items: word numbers from the last word to the first, and the
    items of each window as slices of `items`."""

    names: list[str]
    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 1


def windows_of(items: list[tuple[str, str]], width: int) -> Windows:
    texts = [text.encode() for _, text in items]
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.cumsum([0] + [len(x) + 1 for x in texts])[:-1]
    first, _, hashes = words_of(joined)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    number = number + 1
    count = np.bincount(owners(starts, first), minlength=len(items)) if len(first) else np.zeros(len(items), np.int64)
    begin = np.cumsum(count) - count
    found: dict[bytes, list[int]] = {}
    for i, (b, n) in enumerate(zip(begin, count, strict=True)):
        for a in range(b, b + max(1, n - width + 1) if n else b):
            one = number[a : min(a + width, b + n)].astype("<i4").tobytes()
            of = found.setdefault(one, [])
            if not of or of[-1] != i:
                of.append(i)
    lengths = np.array([len(x) // 4 for x in found], np.int64)
    symbols = np.zeros((len(found), width), np.int64)
    for row, x in enumerate(found):
        one = np.frombuffer(x, "<i4")[::-1]
        symbols[row, : len(one)] = one
    per = np.array([len(x) for x in found.values()], np.int64)
    return Windows(
        [name for name, _ in items], vocabulary, symbols, lengths,
        np.concatenate(([0], np.cumsum(per))), np.array([i for x in found.values() for i in x], np.int64),
    )


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Positions of the sorted suffixes, by prefix doubling over the suffixes that still tie."""
    n = len(seq)
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = seq + 1
    order = np.argsort(rank[:n], kind="stable")
    step = 0
    while True:
        key = rank[order] if step == 0 else None
        if step:
            # only groups with ties are sorted again
            group = rank[order]
            tie = np.zeros(n, bool)
            same = group[1:] == group[:-1]
            tie[1:] |= same
            tie[:-1] |= same
            rows = np.flatnonzero(tie)
            if len(rows) == 0:
                return order
            members = order[rows]
            after = rank[np.minimum(members + step, n)]
            sub = np.lexsort((after, group[rows]))
            order[rows] = members[sub]
            fresh = np.ones(n, bool)
            fresh[1:] = group[1:] != group[:-1]
            again = rows[1:][(group[rows][1:] == group[rows][:-1]) & (after[sub][1:] == after[sub][:-1])]
            fresh[rows] = True
            fresh[again] = False
        else:
            fresh = np.ones(n, bool)
            fresh[1:] = key[1:] != key[:-1]
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
        step = max(1, step * 2)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit of the symbols per level."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros, self.before = [], []
        for level in range(self.bits - 1, -1, -1):
            one = ((seq >> level) & 1).astype(bool)
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(~one, out=count[1:])
            self.before.append(count)
            self.zeros.append(int(count[-1]))
            seq = np.concatenate((seq[~one], seq[one]))
        self.origin = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            zeros = self.before[k][at]
            at = np.where((symbols >> level) & 1, self.zeros[k] + at - zeros, zeros)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position `at`."""
        return self._walk(symbols, at) - self.origin[symbols]


class FmIndex:
    """Index of a sequence of numbers 1..n_symbols - 1 with 0 as separator (at the end of each run)."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 16):
        separators = seq == 0
        apart = int(separators.sum())
        distinct = np.where(separators, np.cumsum(separators) - 1, seq + apart - 1)
        order = suffix_order(distinct)
        self.last = seq[order - 1]  # the first position is preceded by the last separator
        self.ranks = WaveletMatrix(self.last, n_symbols)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=n_symbols))))[:-1]
        # a walk ends at a sampled row, at the latest where a run starts
        kept = (order % sample == 0) | (self.last == 0)
        self.sampled = np.where(kept, order, -1)
        self.size = len(seq)

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search: (windows found, first row, end row). Row i of `symbols` holds a window
        from its last word to its first."""
        who = np.arange(len(lengths))
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.size, np.int64)
        done = []
        for step in range(symbols.shape[1] + 1):
            over = lengths[who] == step
            if over.any():
                done.append((who[over], low[over], high[over]))
                who, low, high = who[~over], low[~over], high[~over]
            if len(who) == 0 or step == symbols.shape[1]:
                break
            c = symbols[who, step]
            low, high = self.begin[c] + self.ranks.rank(c, low), self.begin[c] + self.ranks.rank(c, high)
            some = low < high
            who, low, high = who[some], low[some], high[some]
        if not done:
            return who[:0], low[:0], high[:0]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out, steps, open_ = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(open_):
            here = self.sampled[at]
            found = here >= 0
            out[open_[found]] = here[found] + steps[open_[found]]
            open_, at = open_[~found], at[~found]
            steps[open_] += 1
            c = self.last[at]
            at = self.begin[c] + self.ranks.rank(c, at)
        return out


def occurrences(hashes: np.ndarray, row_of: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every occurrence of a window among the words of a shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(windows.lengths) == 0 or len(hashes) == 0:
        return none
    slot = np.minimum(np.searchsorted(windows.vocabulary, hashes), len(windows.vocabulary) - 1)
    known = windows.vocabulary[slot] == hashes
    place = np.flatnonzero(known)
    if len(place) == 0:
        return none
    joint = np.ones(len(place), bool)
    joint[1:] = (place[1:] != place[:-1] + 1) | (row_of[place[1:]] != row_of[place[:-1]])
    run = np.cumsum(joint) - 1
    length = np.bincount(run)
    keep = (length >= windows.shortest)[run]
    place, joint = place[keep], joint[keep]
    if len(place) == 0:
        return none
    # runs with a separator after each
    at = np.arange(len(place)) + np.cumsum(joint) - 1
    seq = np.zeros(at[-1] + 2, np.int64)
    seq[at] = slot[place] + 1
    back = np.full(len(seq), -1, np.int64)
    back[at] = place
    index = FmIndex(seq, len(windows.vocabulary) + 1)
    who, low, high = index.search(windows.symbols, windows.lengths)
    n = high - low
    rows = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    return back[index.locate(rows)], np.repeat(who, n)


def hit_rows(block: Block, parts: Iterable[Windows]) -> dict[str, list]:
    """The result columns for the texts of a block."""
    first, last, hashes = words_of(block.data)
    row_of = owners(block.starts, first)
    n = len(block.sizes)
    change = np.zeros(len(first) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for windows in parts:
        place, window = occurrences(hashes, row_of, windows)
        np.add.at(change, place, 1)
        np.add.at(change, place + windows.lengths[window], -1)
        for row, w in np.unique(np.stack((row_of[place], window), 1), axis=0) if len(place) else ():
            items.setdefault(int(row), set()).update(windows.names[i] for i in windows.items[windows.first[w] : windows.first[w + 1]])
    hit = np.cumsum(change)[:-1] > 0
    n_words = np.bincount(row_of, minlength=n) if len(first) else np.zeros(n, np.int64)
    n_hit = np.bincount(row_of[hit], minlength=n) if hit.any() else np.zeros(n, np.int64)
    spans: list[list[dict]] = [[] for _ in range(n)]
    clean: list[str | None] = [None] * n
    flag = hit.copy()
    edge = np.flatnonzero(row_of[1:] != row_of[:-1]) + 1 if len(first) else np.zeros(0, np.int64)
    starts = np.flatnonzero(flag & ~np.concatenate(([False], flag[:-1]))) if len(flag) else np.zeros(0, np.int64)
    starts = np.union1d(starts, edge[flag[edge]]) if len(edge) else starts
    stops = np.flatnonzero(flag & ~np.concatenate((flag[1:], [False]))) if len(flag) else np.zeros(0, np.int64)
    stops = np.union1d(stops, edge[flag[edge - 1]] - 1) if len(edge) else stops
    cut: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(starts, stops, strict=True):
        cut.setdefault(int(row_of[a]), []).append((int(first[a] - block.starts[row_of[a]]), int(last[b] - block.starts[row_of[a]])))
    for row, found in cut.items():
        text = block.data[block.starts[row] : block.starts[row] + block.sizes[row]].tobytes()
        spans[row] = [{"start": a, "stop": b} for a, b in found]
        keep, at = [], 0
        for a, b in found:
            keep.append(text[at:a])
            at = b
        clean[row] = b"".join([*keep, text[at:]]).decode()
    return {"n_words": n_words, "n_hit": n_hit, "item_ids": [sorted(items.get(i, ())) for i in range(n)], "spans": spans, "clean_text": clean}


def benchmark_parts(benchmark: DataFrame, width: int, part_bytes: int) -> list:
    """Broadcast windows of the items, in parts of at most `part_bytes` of text."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null").toLocalIterator()
    parts, held, size = [], [], 0
    for r in rows:
        if held and size + len(r["text"]) * 4 > part_bytes:
            parts.append(spark.sparkContext.broadcast(windows_of(held, width)))
            held, size = [], 0
        held.append((r["item"], r["text"]))
        size += len(r["text"]) * 4
    return parts + ([spark.sparkContext.broadcast(windows_of(held, width))] if held else [])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, shard_bytes: int = 8 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """The documents with n_words, n_hit, item_ids (sorted as strings), spans (byte offsets of hit
    words, merged), clean_text (the text without them, null where nothing is hit) and
    contaminated (n_hit > 0 and 20 n_hit >= n_words)."""
    names = [x.name for x in RESULT]
    kept = docs.drop(*names, "contaminated")
    parts = benchmark_parts(benchmark, width, part_bytes)
    schema = T.StructType([*kept.schema.fields, *RESULT.fields])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for block in blocks(batches, limit=shard_bytes):
            found = hit_rows(block, (p.value for p in parts))
            columns = [pa.array(found[f.name], to_arrow_type(f.dataType)) for f in RESULT]
            yield pa.RecordBatch.from_arrays([*block.rows.columns, *columns], [*block.rows.schema.names, *names])

    return kept.mapInArrow(search, schema).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def items_digest(item_ids: list[str]) -> str:
    """The digest of a list of items, as the query gives it."""
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
