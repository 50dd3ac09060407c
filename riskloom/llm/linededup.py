"""Removal of repeated runs of lines by winnowing (operator 1).

A line ends at a newline or after a word that ends in `.`, `!` or `?`; blank ones don't count, and
white space around a line is no part of it. Windows are runs of lines with at least `words` words
(parts between white space) that are as short as possible seen from their first or from their
last line; every run of at least `words` words is a union of windows.

1. Each window selects the line with the smallest hash: its fingerprint. A run that stands in two
   places has the same windows there, so it shares a fingerprint for certain. Fingerprints are
   counted by place.
2. Windows whose fingerprint stands in more than one place are joined by their whole content:
   this extends a match from the fingerprint to both sides, window by window, exactly (by a 64-bit
   hash of the lines' 64-bit hashes).
3. The first place (smallest doc_id, then text hash, then position) of a window stays; the lines
   of all later ones go. A later window that overlaps the first one in the same text loses only
   what lies beyond it.

No pairs are made: places meet in counts and minima, and the join goes to one row per window, so a
passage that stands everywhere is an ordinary skewed key that Spark splits.

Special cases: null and empty texts stay as they are; rows with the same doc_id and text are one
document and are cut alike; a null doc_id comes first; an empty table gives no rows; the columns
n_words, n_removed and removed replace columns of the same name, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.bytetext import SPACE_BYTES, Block, blocks, owners, runs, span_hashes
from riskloom.session import cut_lineage

_c = F.col
STOPS = np.zeros(256, bool)
STOPS[[ord(x) for x in ".!?"]] = True
NEWLINE = 10


class Lines:
    """The lines of a block."""

    def __init__(self, block: Block):
        first, last = runs(~SPACE_BYTES[block.data])
        breaks = np.concatenate(([0], np.cumsum(block.data == NEWLINE)))
        new = np.ones(len(first), bool)
        new[1:] = (breaks[first[1:]] != breaks[last[:-1]]) | STOPS[block.data[last[:-1] - 1]]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(first)) - 1 if len(head) else head
        self.begin, self.end = first[head], last[tail]
        self.words = tail - head + 1
        self.text = owners(block.starts, self.begin)
        self.n_words = np.bincount(self.text, self.words, len(block.sizes)).astype(np.int64)


class Windows(Lines):
    """The lines of a block and their windows."""

    def __init__(self, block: Block, words: int):
        super().__init__(block)
        self.hashes = span_hashes(block.data, self.begin, self.end)
        total = np.concatenate(([0], np.cumsum(self.words)))
        n = len(self.begin)
        a = np.arange(n)
        until = np.searchsorted(total[1:], total[:-1] + words)
        fits = until < n
        fits[fits] = self.text[until[fits]] == self.text[fits]
        since = np.searchsorted(total, total[1:] - words, "right") - 1
        back = since >= 0
        back[back] = self.text[since[back]] == self.text[back]
        both = np.unique(np.concatenate((a[fits] * (n + 1) + until[fits], since[back] * (n + 1) + a[back])))
        self.first, self.last = both // (n + 1), both % (n + 1)
        # the line with the smallest hash in each window; among equal ones the first
        order = np.argsort(self.hashes, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = a
        levels = [rank]
        while len(levels[-1]) > (1 << (len(levels) - 1)) and (1 << len(levels)) <= (self.last - self.first).max(initial=0) + 1:
            reach = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-reach], levels[-1][reach:]))
        size = self.last - self.first + 1
        level = np.frexp(size)[1] - 1
        least = np.empty(len(size), np.int64)
        for k in np.unique(level):
            rows = np.flatnonzero(level == k)
            least[rows] = np.minimum(levels[k][self.first[rows]], levels[k][self.last[rows] - (1 << int(k)) + 1])
        self.chosen = order[least] if len(least) else least


def _counted(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lines = Windows(block, words)
            value, n = np.unique(lines.hashes[np.unique(lines.chosen)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["__print", "__n"])

    return run


def _placed(words: int):
    """A row per fingerprint and text: the windows that chose it, packed (hash, start, end)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lines = Windows(block, words)
            if not len(lines.first):
                continue
            text, chosen = lines.text[lines.first], lines.chosen
            order = np.argsort(chosen, kind="stable")
            packed = np.zeros(len(order), np.dtype([("hash", "<u8"), ("start", "<i4"), ("end", "<i4")]))
            packed["hash"] = span_hashes(lines.hashes, lines.first, lines.last + 1)[order]
            packed["start"] = (lines.begin[lines.first] - block.starts[text])[order]
            packed["end"] = (lines.end[lines.last] - block.starts[text])[order]
            cut = np.flatnonzero(np.diff(chosen[order], prepend=-1))
            line = chosen[order][cut]
            raw = pa.py_buffer(packed.tobytes())
            offsets = pa.py_buffer((np.append(cut, len(order)) * 16).astype(np.int32).tobytes())
            rows = block.rows.select(["__id", "__key"]).take(pa.array(lines.text[line]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines.hashes[line].view(np.int64)), rows.column("__id"), rows.column("__key"), pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, offsets, raw])],
                ["__print", "__id", "__key", "__windows"],
            )

    return run


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        found = b.column("__windows").to_pylist()
        packed = np.frombuffer(b"".join(found), np.dtype([("hash", "<u8"), ("start", "<i4"), ("end", "<i4")]))
        n = np.array([len(x) // 16 for x in found])
        rows = b.select(["__id", "__key"]).take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(packed["hash"].view(np.int64)), rows.column("__id"), rows.column("__key"), pa.array(packed["start"]), pa.array(packed["end"])],
            ["__window", "__id", "__key", "__start", "__end"],
        )


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ]
)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_type

    for block in blocks(batches):
        names = block.rows.schema.names
        spans = block.rows.column("__spans").to_pylist()
        lines = Lines(block)
        fresh, source = [], np.arange(len(spans))  # texts that change, and where each row's text comes from
        removed, gone = [], np.zeros(len(spans), np.int64)
        at = np.searchsorted(lines.text, np.arange(len(spans) + 1))
        for row, found in enumerate(spans):
            if not found:
                removed.append([])
                continue
            text = block.data[block.starts[row] : block.starts[row] + block.sizes[row]].tobytes()
            begin = lines.begin[at[row] : at[row + 1]] - block.starts[row]
            mine: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in found):
                if mine and s[0] <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], s[1])
                else:
                    mine.append(list(s))
            keep, here = [], 0
            for a, b in mine:
                i, j = np.searchsorted(begin, [a, b])
                a = int(begin[i]) if i < len(begin) else len(text)  # a clipped window begins at its next line
                gone[row] += lines.words[at[row] + i : at[row] + j].sum()
                keep.append(text[here:a])
                here = int(begin[j]) if j < len(begin) else len(text)
            source[row] = len(spans) + len(fresh)
            fresh.append(b"".join([*keep, text[here:]]).decode())
            removed.append([{"start": a, "stop": b} for a, b in mine])
        old = block.rows.column("text")
        fresh = pa.concat_arrays([old, pa.array(fresh, old.type)]).take(pa.array(source)) if fresh else old
        columns = [fresh if n == "text" else block.rows.column(n) for n in names if n != "__spans"]
        out = [pa.array(lines.n_words), pa.array(gone), pa.array(removed, to_arrow_type(RESULT["removed"].dataType))]
        yield pa.RecordBatch.from_arrays([*columns, *out], [*(n for n in names if n != "__spans"), *RESULT.names])


def remove_repeated_lines(docs: DataFrame, words: int = 50) -> DataFrame:
    """The documents with later repeats of runs of at least `words` words removed from `text`, and
    n_words (before), n_removed (words), removed (byte offsets in the old text)."""
    kept = docs.drop(*RESULT.names)
    keyed = kept.withColumn("__key", F.xxhash64("doc_id", "text"))
    slim = keyed.select(_c("doc_id").cast("long").alias("__id"), "__key", "text")
    prints = slim.mapInArrow(_counted(words), "__print long, __n long").groupBy("__print").agg(F.sum("__n").alias("__n"))
    repeated = prints.where("__n > 1").select("__print")
    places = slim.mapInArrow(_placed(words), "__print long, __id long, __key long, __windows binary").join(repeated, "__print", "left_semi")
    windows = cut_lineage(places.mapInArrow(_unpacked, "__window long, __id long, __key long, __start int, __end int"))
    place = F.struct("__id", "__key", "__start", "__end")
    firsts = windows.groupBy("__window").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    same_text = _c("__id").eqNullSafe(_c("__first.__id")) & (_c("__key") == _c("__first.__key"))
    later = windows.join(firsts, "__window").where(~(same_text & (_c("__start") == _c("__first.__start"))))
    start = F.when(same_text, F.greatest("__start", "__first.__end")).otherwise(_c("__start"))
    spans = later.select("__key", start.alias("start"), _c("__end").alias("end")).where("start < end")
    spans = spans.groupBy("__key").agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    schema = T.StructType([*kept.schema.fields, *RESULT.fields])
    return keyed.join(spans, "__key", "left").drop("__key").mapInArrow(_cut, schema)
