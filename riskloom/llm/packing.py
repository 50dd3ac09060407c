"""Packing of tokenized documents into sequences (operator 9): shortest-pack-first over the
histogram of lengths.

1. Tasks tokenize whole texts and cut them into pieces of at most `size` ids: full pieces first,
   the rest last. Only (document, start, length, checksum) is kept, in a written table, so that
   ranks cannot change when a task runs again; the ids can be kept as well.
2. The histogram of piece lengths has at most `size` rows, so the plan is made on the driver:
   lengths are placed longest first, each into the packs with the smallest sum that still have
   room; patterns (lists of lengths) carry counts, never single pieces.
3. Every piece gets its rank among the pieces of its length: a row number inside (shard, length)
   plus the counts of the shards before. No length is ever in one task, however common it is.
   The rank names the pattern, its copy and the place in it.

Special cases: a null or empty text is one piece with the end id alone; very long texts become
many pieces; repeated rows are packed as rows of their own; an empty table gives no rows; other
columns are left out of the result, whatever their names. Pieces with equal keys are
interchangeable (ranks go by doc_id, nulls first, then start, then checksum).
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.bytetext import SPACE_BYTES, blocks, span_hashes
from riskloom.session import cut_lineage

_c = F.col
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
# Characters beyond ASCII that count as white space, as UTF-8.
WIDE_SPACES = [chr(x).encode() for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
WIDE = [*WIDE_SPACES, b"\x1c", b"\x1d", b"\x1e", b"\x1f"]
SPACE = re.compile(rb"[\x09-\x0d ]")
NEWLINE = 10


class Encoder:
    """Byte-level BPE of whole blocks. Words are encoded once per task and then copied.

    A text is cut before a single space, and around a single newline, that stand between other
    characters: the tokenizer's pattern always begins a new part there, so the ids of the parts
    are the ids of the text.
    """

    def __init__(self, ranks_path: str, pattern: str, most_words: int = 2_000_000):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.most_words = most_words
        self.break_id = ranks[b"\n"]
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Encode words: plain ones in one call, with newlines between, the others alone."""
        plain = np.array([w != b" " and not SPACE.search(w, w[:1] == b" ") for w in words], bool)
        n, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        coded, base = [self.flat], len(self.flat)
        if plain.any():
            ids = np.asarray(self.coder.encode_ordinary(b"\n".join(words[i] for i in np.flatnonzero(plain)).decode()), np.uint32)
            between = ids == self.break_id
            if int(between.sum()) != int(plain.sum()) - 1:
                raise ValueError("a word's ids hold a newline")
            stops = np.append(np.flatnonzero(between), len(ids))
            n[plain] = np.diff(stops, prepend=-1) - 1
            at[plain] = base + stops - n[plain] - np.arange(len(stops))
            coded.append(ids[~between])
            base += len(coded[-1])
        for i in np.flatnonzero(~plain):
            coded.append(np.asarray(self.coder.encode_ordinary(words[i].decode()), np.uint32))
            n[i], at[i] = len(coded[-1]), base
            base += len(coded[-1])
        self.flat = np.concatenate(coded)
        order = np.argsort(all_keys := np.concatenate((self.keys, keys)), kind="stable")
        self.keys, self.at, self.n = all_keys[order], np.concatenate((self.at, at))[order], np.concatenate((self.n, n))[order]

    def encode(self, block) -> list[np.ndarray]:
        """The ids of each text of the block."""
        raw = block.data.tobytes()
        if any(x in raw for x in WIDE):
            return [np.asarray(self.coder.encode_ordinary(raw[a : a + n].decode()), np.uint32) for a, n in zip(block.starts, block.sizes, strict=True)]
        d = block.data
        space = SPACE_BYTES[d]
        lone = np.zeros(len(d), bool)
        lone[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
        ends = block.starts + block.sizes  # the newline after each text
        lone[ends] = lone[np.minimum(block.starts, len(d) - 1)] = False
        begin = lone & ((d == 32) | (d == NEWLINE))
        begin[1:] |= begin[:-1] & (d[:-1] == NEWLINE)
        begin[block.starts] = True
        begin[ends] = True
        first = np.flatnonzero(begin)
        last = np.concatenate((first[1:], [len(d)]))
        hashes = span_hashes(d, first, last)
        closing = np.zeros(len(d), bool)
        closing[ends] = True
        closing = closing[first]
        words, where = np.unique(hashes[~closing], return_index=True)
        known = np.zeros(len(words), bool)
        if len(self.keys):
            known = self.keys[np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)] == words
        if not known.all():
            if len(self.keys) + len(words) > self.most_words:
                self.forget()
                known[:] = False
            new = where[~known]
            a, b = first[~closing][new], last[~closing][new]
            self.learn(words[~known], [raw[i:j] for i, j in zip(a, b, strict=True)])
        n, at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        slot = np.searchsorted(self.keys, hashes[~closing])
        n[~closing], at[~closing] = self.n[slot], self.at[slot]
        total = np.concatenate(([0], np.cumsum(n)))
        source = np.arange(total[-1]) + np.repeat(at - total[:-1], n)
        ids = self.flat[source]
        stops = total[:-1][closing]
        return np.split(ids, stops[:-1]) if len(stops) else []


def piece_batches(batches: Iterable[pa.RecordBatch], ranks_path: str, pattern: str, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(ranks_path, pattern)
    for block in blocks(batches, limit=2 << 20):
        keys = block.rows.column(block.rows.schema.get_field_index("doc_id")).to_pylist()
        out = []
        for key, ids in zip(keys, encoder.encode(block), strict=True):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for a in range(0, len(ids), size):
                part = ids[a : a + size].tobytes()
                out.append((key, a, len(part) // 4, zlib.crc32(part), len(ids), *([part] if with_ids else [])))
        columns = list(zip(*out, strict=True))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.binary()) for c in columns[5:]]
        yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Packing patterns (lengths in order of placement) with counts."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    most: list[int] = []  # heap of the room left, largest first

    def put(left: int, pattern: list[int], count: int) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(most, -left)
        room[left].append((pattern, count))

    full: list[tuple[list[int], int]] = []
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if most and -most[0] >= length:
                left = -most[0]
                pattern, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    heapq.heappop(most)
                used = min(n, count)
                if used < count:
                    put(left, pattern, count - used)
            else:
                left, pattern, used = size, [], n
            n -= used
            if left == length:
                full.append(([*pattern, length], used))
            else:
                put(left - length, [*pattern, length], used)
    return full + [x for left in sorted(room) for x in room[left]]


class Places:
    """Rank among the pieces of a length -> sequence and place in it."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for pattern, count in patterns:
            at = 0
            for length in pattern:
                slots.setdefault(length, []).append((base, at, count))
                at += length
            base += count
        self.by = {}
        for length, found in slots.items():
            base_of, at_of, count_of = (np.array(x, np.int64) for x in zip(*found, strict=True))
            self.by[length] = (np.cumsum(count_of) - count_of, base_of, at_of)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(part):
                first, base, at = self.by[int(lengths[part[0]])]
                slot = np.searchsorted(first, ranks[part], "right") - 1
                sequence[part] = base[slot] + ranks[part] - first[slot]
                offset[part] = at[slot]
        return sequence, offset


def pack(docs: DataFrame, ranks_path: str, pattern: str, size: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids], sequence_id, offset.

    `ids` are little-endian unsigned 32-bit values. `ranks_path` is a file of byte ranks that
    every executor can open (it comes with the tokenizer, not with the data).
    """
    spark = docs.sparkSession
    schema = PIECES + (", ids binary" if with_ids else "")
    pieces = cut_lineage(
        docs.select("doc_id", "text").mapInArrow(lambda it: piece_batches(it, ranks_path, pattern, size, end_id, with_ids), schema)
    )
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    counts = cut_lineage(pieces.groupBy("length", "__shard").agg(F.count(F.lit(1)).alias("__n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `size` rows
    places = Places(shortest_pack_first(histogram, size))
    before = counts.select(
        "length", "__shard",
        (F.sum("__n").over(Window.partitionBy("length").orderBy("__shard")) - _c("__n")).alias("__before"),
    )
    inside = F.row_number().over(Window.partitionBy("__shard", "length").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = pieces.withColumn("__rank", inside).join(before, ["__shard", "length"]).withColumn("__rank", _c("__rank") + _c("__before") - 1)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.find(np.asarray(b.column("length")), np.asarray(b.column("__rank")))
            kept = [n for n in b.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    names = [x.name for x in pieces.schema if not x.name.startswith("__")]
    return ranked.select(*names, "__rank").mapInArrow(placed, schema + ", sequence_id long, offset long")
