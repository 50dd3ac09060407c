"""Joins of documents with sharded tables of n-grams or word pairs, shared by the two language models.

Texts are taken as byte sequences: A-Z in lower case, white space runs as one space, none at the
ends, then the end symbol (a newline, which also fills the contexts before a text). An n-gram of
`ORDER` bytes is one 40-bit number, its newest byte lowest, so it is exact and its shorter forms
are its low bytes.

1. `encode` (one pass, no shuffle): tasks cut their texts into chunks and write them packed;
   `encode_tokens` writes numbers of words in place of texts.
   `marked` brings the ids of a table to the chunks as one bit a text, so no text is moved for it.
2. `chunk_grams` gives the distinct n-grams of each chunk with their counts in training texts,
   `chunk_pairs` its distinct pairs of neighbouring words, by bucket of the first.
3. `gram_counts`: one row per n-gram over all chunks.
4. A model gives each n-gram its log probability, shard by shard. A shard holds all n-grams whose
   two newest context bytes fall into it, so contexts of two bytes and more stand beside their
   parents; what is shorter has at most 256 x 256 entries and is made on the driver.
5. `score`: log probabilities are joined back to the chunks that asked for them, and each chunk
   adds them up per text. Every join is keyed by n-gram or chunk; nothing grows in one task but
   with the fixed size of a chunk or with the number of possible bytes.
"""

from __future__ import annotations

import bz2
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bytetext import BASE, SPACE_BYTES, Block, blocks, lower, owners, runs, span_hashes
from riskloom.session import cut_lineage

_c = F.col
ORDER = 5
END = 10
CHUNK_BYTES = 32 << 20
MERGED_AT = 1 << 19
ABOUT = "ids array<string>, langs array<string>, row_keys array<long>, trained array<boolean>"
CHUNKS = f"chunk long, data binary, sizes binary, {ABOUT}"
TOKEN_CHUNKS = f"chunk long, hashes binary, places binary, counts binary, tokens binary, sizes binary, {ABOUT}"
LOW = 0xFFFFFFFF


def normal_bytes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The byte sequences of a block's texts in a row, and their lengths (with the end symbol)."""
    d = lower(block.data)
    solid = ~SPACE_BYTES[d]
    first, last = runs(solid)
    row = owners(block.starts, first)
    keep = solid
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    keep[last[inner]] = True
    d[last[inner]] = 32
    ends = block.starts + block.sizes
    keep[ends] = True
    d[ends] = END
    total = np.cumsum(keep)
    return d[keep], np.diff(total[ends], prepend=0)


def gram_keys(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte."""
    key = data.astype(np.uint64)
    for j in range(1, ORDER):
        key[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * j)
    # the first bytes of a text have end symbols before them, not the text before
    begin = np.cumsum(sizes) - sizes
    for p in range(min(ORDER - 1, int(sizes.max(initial=0)))):
        at = begin[sizes > p] + p
        low = np.uint64((1 << 8 * (p + 1)) - 1)
        ends = np.uint64(sum(END << 8 * j for j in range(p + 1, ORDER)))
        key[at] = key[at] & low | ends
    return key


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens: words, and an empty one for the end of each text."""
    first, last = runs((data != 32) & (data != END))
    ends = np.flatnonzero(data == END)
    a, b = np.concatenate((first, ends)), np.concatenate((last, ends))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def deltas(x: np.ndarray) -> bytes:
    """Rising numbers, packed by their steps (each below 2^32)."""
    return planes(np.diff(x, prepend=0).astype(np.uint32))


def undeltas(x: bytes) -> np.ndarray:
    return np.cumsum(unplanes(x, np.uint32).astype(np.int64))


@dataclass
class PairTable:
    """Distinct pairs of neighbouring tokens.

    `hashes` are the distinct tokens, rising; `pairs` are (number of the token before << 32 |
    number of the token), rising; `counts` belong to the pairs. The end of a text has the hash 0
    and is also what stands before the first token of a text."""

    hashes: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counted: np.ndarray) -> PairTable:
        """From the tokens of whole texts; `counted` are the weights of the tokens."""
        value, back = np.unique(hashes, return_inverse=True)
        return cls(value, *with_counts(neighbours(back), counted))

    @classmethod
    def merged(cls, parts: list[PairTable]) -> PairTable:
        value, back = np.unique(np.concatenate([p.hashes for p in parts]), return_inverse=True)
        base = np.cumsum([0] + [len(p.hashes) for p in parts])
        pairs = [renumbered(p.pairs, back[b:]) for b, p in zip(base[:-1], parts, strict=True)]
        return cls(value, *summed(pairs, [p.counts for p in parts]))

    @classmethod
    def unpacked(cls, hashes: bytes, pairs: bytes, counts: bytes) -> PairTable:
        x = unplanes(pairs, np.int64)
        return cls(unplanes(hashes, np.uint64), np.cumsum(x >> 32) << 32 | x & LOW, unplanes(counts, np.int64))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return planes(self.hashes), planes(np.diff(self.pairs >> 32, prepend=0) << 32 | self.pairs & LOW), planes(self.counts)

    def buckets(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, numbers of its pairs, numbers of its tokens): pairs are dealt by the hash of
        the token before."""
        place = (self.hashes % np.uint64(buckets)).astype(np.int64)[self.pairs >> 32]
        order = np.argsort(place, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            used = np.zeros(len(self.hashes), bool)
            used[self.pairs[mine] >> 32] = used[self.pairs[mine] & LOW] = True
            yield int(place[mine[0]]), mine, np.flatnonzero(used)

    def part(self, mine: np.ndarray, used: np.ndarray) -> PairTable:
        number = np.zeros(len(self.hashes), np.int64)
        number[used] = np.arange(len(used))
        return PairTable(self.hashes[used], renumbered(self.pairs[mine], number), self.counts[mine])


def neighbours(numbers: np.ndarray) -> np.ndarray:
    """The pair that ends at each token of whole texts."""
    return np.concatenate(([0], numbers[:-1])) << 32 | numbers


def renumbered(pairs: np.ndarray, number: np.ndarray) -> np.ndarray:
    return number[pairs >> 32] << 32 | number[pairs & LOW]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
    return every[first], np.add.reduceat(np.concatenate(counts)[order], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def with_counts(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how many of each are trained."""
    value, n = np.unique(keys, return_counts=True)
    if trained.all():
        return value, n
    if not trained.any():
        return value, np.zeros(len(value), np.int64)
    some, m = np.unique(keys[trained], return_counts=True)
    out = np.zeros(len(value), np.int64)
    out[np.searchsorted(value, some)] = m
    return value, out


def shrink(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x.tobytes())


def grow(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def planes(x: np.ndarray) -> bytes:
    """Numbers packed byte by byte: all lowest bytes first, all highest last."""
    return shrink(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)


def unplanes(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(grow(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _encoder(chunk_bytes: int, schema: str, packer: Callable) -> Callable:
    """`packer` makes two functions for a task: `part` gives what is kept of a block and its bytes,
    `whole` the packed columns of a chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        part, whole = packer()
        held: list[tuple] = []
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            chunk = (task << 24) | made
            made += 1
            row = [chunk, *whole([h[0] for h in held]), *(sum((h[1][k] for h in held), []) for k in range(4))]
            held.clear()
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.int64(), *[pa.binary()] * (len(names) - 5), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names)

        size = 0
        for block in blocks(batches):
            kept, n = part(block)
            column = lambda n, b=block: b.rows.column(b.rows.schema.get_field_index(n)).to_pylist()
            held.append((kept, (column("__id"), column("__lang"), column("__key"), column("__train"))))
            size += n
            if size >= chunk_bytes:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _byte_packer() -> tuple[Callable, Callable]:
    """Bytes are packed as they come: a task holds no chunk of plain text."""
    stream = bz2.BZ2Compressor()

    def part(block: Block) -> tuple[tuple, int]:
        data, sizes = normal_bytes(block)
        return (stream.compress(data), sizes.astype(np.int32)), len(data)

    def whole(parts: list[tuple]) -> tuple:
        nonlocal stream
        packed = b"".join([*(p for p, _ in parts), stream.flush()])
        stream = bz2.BZ2Compressor()
        return packed, shrink(np.concatenate([n for _, n in parts]))

    return part, whole


def _part_tokens(block: Block) -> tuple[tuple, int]:
    data, sizes = normal_bytes(block)
    value, back = np.unique(token_hashes(data, sizes), return_inverse=True)
    return (value, back.astype(np.int32), token_counts(data, sizes)), len(data)


def _packed_tokens(buckets: int) -> Callable:
    def run(parts: list[tuple]) -> tuple:
        value, number = np.unique(np.concatenate([v for v, _, _ in parts]), return_inverse=True)
        base = np.cumsum([0] + [len(v) for v, _, _ in parts])
        tokens = np.concatenate([number[a:][back] for a, (_, back, _) in zip(base[:-1], parts, strict=True)])
        counts = np.bincount(tokens, minlength=len(value))
        sizes = np.concatenate([n for _, _, n in parts])
        return planes(value), planes((value % np.uint64(buckets)).astype(np.int32)), planes(counts), planes(ranks(counts)[tokens].astype(np.uint32)), shrink(sizes.astype(np.int32))

    return run


def ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each token when the most frequent come first."""
    out = np.empty(len(counts), np.int64)
    out[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return out


def tokens_of(row) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a chunk by their numbers among its distinct ones, and those of each text."""
    order = np.argsort(-unplanes(row["counts"], np.int64), kind="stable")
    return order[unplanes(row["tokens"], np.uint32)], grow(row["sizes"], np.int32).astype(np.int64)


def token_counts(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of each text: its words and the end."""
    begin = np.cumsum(sizes) - sizes
    return np.add.reduceat((data == 32).astype(np.int64), begin) + 1 + (sizes > 1)


def encode(docs: DataFrame, train, lang=None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the chunks of `docs`; `train` is a boolean column, `lang` a string column."""
    return cut_lineage(_rows(docs, train, lang).mapInArrow(_encoder(chunk_bytes, CHUNKS, _byte_packer), CHUNKS))


def encode_tokens(docs: DataFrame, train, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the chunks of `docs` as token numbers, the most frequent lowest: the hashes of a
    chunk's distinct tokens (rising), their buckets and counts, and the tokens of its texts."""
    return cut_lineage(_rows(docs, train).mapInArrow(_encoder(chunk_bytes, TOKEN_CHUNKS, lambda: (_part_tokens, _packed_tokens(buckets))), TOKEN_CHUNKS))


def _rows(docs: DataFrame, train, lang=None) -> DataFrame:
    return docs.select(
        _c("doc_id").cast("string").alias("__id"), (F.lit(None).cast("string") if lang is None else lang).alias("__lang"),
        F.xxhash64("doc_id", "text").alias("__key"), F.coalesce(train, F.lit(False)).alias("__train"), "text",
    )


def marked(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks with `trained` only where the id is also in `ids` (distinct, as strings). Ids
    alone are joined; a chunk gets them back as an array of booleans."""
    texts = chunks.select("chunk", F.posexplode("ids").alias("place", "id")).join(ids.select("id", F.lit(True).alias("found")), "id", "left")
    found = texts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("found", F.lit(False)).alias("found")))).alias("f"))
    bits = cut_lineage(found.select("chunk", _c("f.found").alias("found")))
    return chunks.join(bits, "chunk").withColumn("trained", F.zip_with("trained", "found", lambda a, b: a & b)).drop("found")


def _chunk_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in chunk_rows(batches):
        data, sizes = text_of(row)
        trained = np.array(row["trained"], bool)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j, a, b in text_groups(sizes, 1 << 20):
            parts.append(with_counts(gram_keys(data[a:b], sizes[i:j]), np.repeat(trained[i:j], sizes[i:j])))
            if sum(len(k) for k, _ in parts[1:]) > max(MERGED_AT, len(parts[0][0])):
                parts = [summed(*zip(*parts, strict=True))]
        keys, counts = summed(*zip(*parts, strict=True))
        arrays = [pa.array([row["chunk"]], pa.int64()), pa.array([keys.astype(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["chunk", "keys", "counts"])


def chunk_grams(chunks: DataFrame) -> DataFrame:
    """(chunk, keys, counts): the distinct n-grams of each chunk and their training counts."""
    return cut_lineage(chunks.select("chunk", "data", "sizes", "trained").mapInArrow(_chunk_grams, "chunk long, keys array<long>, counts array<long>"))


def chunk_pairs(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, words, pairs, counts): the packed `PairTable` of each chunk and bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chunk_rows(batches):
            tokens, n = tokens_of(row)
            table = PairTable(unplanes(row["hashes"], np.uint64), *with_counts(neighbours(tokens), np.repeat(np.array(row["trained"], bool), n)))
            rows = [(row["chunk"], b, *table.part(mine, used).packed()) for b, mine, used in table.buckets(buckets)]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "bucket", "words", "pairs", "counts"])

    return chunks.select("chunk", "hashes", "counts", "tokens", "sizes", "trained").mapInArrow(run, "chunk long, bucket int, words binary, pairs binary, counts binary")


def gram_counts(chunks: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """(key, n, shard): training counts of all n-grams of all texts, also those with none."""
    grams = chunk_grams(chunks) if grams is None else grams
    pairs = grams.select(F.explode(F.arrays_zip("keys", "counts")).alias("p"))
    shards = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = pairs.groupBy(_c("p.keys").alias("key")).agg(F.sum("p.counts").alias("n"))
    near = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    return cut_lineage(total.withColumn("shard", F.pmod(F.hash(near), F.lit(shards))))


@dataclass
class Levels:
    """The n-grams of a shard at lengths ORDER..3, as numbers within each length.

    `up[k]` is the entry of length k - 1 below each entry of length k, `context[k]` the number of
    its context, `pairs` the 16-bit number of each entry of length 3 at length 2."""

    keys: dict[int, np.ndarray]
    up: dict[int, np.ndarray]
    context: dict[int, np.ndarray]
    pairs: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> Levels:
        by, up, context = {ORDER: keys.astype(np.uint64)}, {}, {}
        for k in range(ORDER, 2, -1):
            context[k] = np.unique(by[k] >> np.uint64(8), return_inverse=True)[1]
            if k > 3:
                by[k - 1], up[k] = np.unique(by[k] & np.uint64((1 << 8 * (k - 1)) - 1), return_inverse=True)
        return cls(by, up, context, (by[3] & np.uint64(0xFFFF)).astype(np.int64))


def per_shard(counts: DataFrame, work: Callable[[Levels, np.ndarray, int], pd.DataFrame], schema: str) -> DataFrame:
    """Apply `work(levels, counts, shard)` to every shard; keys come sorted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        return work(Levels.of(pdf["key"].to_numpy()), pdf["n"].to_numpy(), int(pdf["shard"].iloc[0]))

    return counts.groupBy("shard").applyInPandas(run, schema)


SUMS = "row_key long, id string, lang string, trained boolean, n_symbols long, log_p double"


def text_groups(sizes: np.ndarray, step: int = 2 << 20) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, first byte, last byte), ends exclusive, of groups of about `step` bytes."""
    stop = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        a = int(stop[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(stop, a + step, "right")))
        yield first, last, a, int(stop[last - 1])
        first = last


class GramIndex:
    """Places of n-grams among sorted distinct ones: one probe of a hash table, and a bisection
    where another n-gram has taken the slot."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, (4 * len(keys)).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * BASE) >> self.shift

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each n-gram, and where in `wanted` those stand that are not there."""
        at = self.slots[self._slot(wanted)]
        other = np.flatnonzero(self.keys[at] != wanted)
        at[other] = np.minimum(np.searchsorted(self.keys, wanted[other]), len(self.keys) - 1)
        return at, other[self.keys[at[other]] != wanted[other]]


def looked_up(data: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of the n-grams of each text; `values` in the order of the distinct n-grams."""
    groups = list(text_groups(sizes))
    index = None
    for i, j, a, b in groups:
        keys = gram_keys(data[a:b], sizes[i:j])
        if index is None:
            index = GramIndex(np.unique(keys))
        elif len(new := index.places(keys)[1]):
            index = GramIndex(np.union1d(index.keys, keys[new]))
    out = np.zeros(len(sizes))
    for i, j, a, b in groups:
        out[i:j] = np.add.reduceat(values[index.places(gram_keys(data[a:b], sizes[i:j]))[0]], np.cumsum(sizes[i:j]) - sizes[i:j])
    return out


def token_hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of every token, made some texts at a time."""
    return np.concatenate([span_hashes(data[a:b], *tokens(data[a:b])) for _, _, a, b in text_groups(sizes, 1 << 20)])


def answers(asking: DataFrame, by: str, values: DataFrame) -> DataFrame:
    """(asker, places, values), asker being the column `by`: the values of the n-grams that each
    row of `asking` lists, with their places in the list."""
    rows = asking.select(_c(by).alias("asker"), F.posexplode("keys").alias("place", "key")).join(values.select("key", _c("value").cast("float")), "key")
    return rows.groupBy("asker").agg(F.collect_list(F.struct("place", "value")).alias("p")).select("asker", _c("p.place").alias("places"), _c("p.value").alias("values"))


def chunk_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def text_of(row) -> tuple[np.ndarray, np.ndarray]:
    """The byte sequences of a chunk and their lengths."""
    return np.frombuffer(bz2.decompress(row["data"]), np.uint8), grow(row["sizes"], np.int32).astype(np.int64)


def about(texts: pd.Series) -> dict:
    return {"row_key": texts["row_keys"], "id": texts["ids"], "lang": texts["langs"], "trained": texts["trained"]}


def _summing(key: tuple, texts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
    if not len(texts):
        return pd.DataFrame(columns=[x.split()[0] for x in SUMS.split(", ")])
    t = texts.iloc[0]
    data, sizes = text_of(t)
    values = np.zeros(len(got["values"].iloc[0]))
    values[got["places"].iloc[0]] = got["values"].iloc[0]
    return pd.DataFrame({**about(t), "n_symbols": sizes, "log_p": looked_up(data, sizes, values)})


def score(chunks: DataFrame, grams: DataFrame, values: DataFrame) -> DataFrame:
    """The sum of the values of each text's n-grams, one row for each row of the documents.
    `values` has key and value for every n-gram of `grams`."""
    got = answers(grams, "chunk", values)
    return chunks.groupBy("chunk").cogroup(got.groupBy("asker")).applyInPandas(_summing, SUMS)
