"""Positional document fingerprints from closed syncmers (operator 2).

A k-mer of code points is an anchor if the smallest hash among its s-mers stands at its first or
last s-mer: a property of the k-mer alone, so equal passages have equal anchors whatever stands
around them, and two anchors are never more than k - s apart. A text is taken with k - 1
sentinels at both ends, so that short texts have anchors as well.

A fingerprint is the base64 text of three bytes per anchor: 18 bits of its hash and 6 bits of its
distance to the anchor before. It covers the whole text (about 4 characters per 8 code points).
Likeness of two fingerprints: anchors with equal hashes are paired by order of occurrence, a pair
counts if the next or last pair before has the same shift (the only pair of two texts always
counts), and the share is 2 pairs / (anchors + anchors). Two empty fingerprints are alike.

Special cases: a null text is empty; an empty text has an empty fingerprint; repeated rows and
equal ids are rows of their own, ordered by id (null first), then hash of the text; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bytetext import BASE, blocks, mix, owners

_c = F.col
K, S = 24, 8
SENTINEL = 0x110000
HASH_BITS, GAP_BITS = 18, 6


def power_hashes(values: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of every run of 2^i values, by doubling."""
    out, size, factor = {1: mix(values.astype(np.uint64) * BASE)}, 1, BASE
    with np.errstate(over="ignore"):
        while size < max(sizes):
            h = out[size]
            out[2 * size] = h[:-size] * factor + h[size:] if len(h) > size else h[:0]
            size, factor = 2 * size, factor * factor
    return out


def anchors(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the anchors of texts that stand in `points` with K - 1 sentinels
    before, between and after."""
    h = power_hashes(points, (16,))
    small = mix(h[S])
    with np.errstate(over="ignore"):
        eight = np.uint64(pow(int(BASE), 8, 2**64))
        n = len(points) - K + 1
        whole = h[16][:n] * eight + h[8][16 : 16 + n]
    low, reach = small, 1
    while reach * 2 <= K - S + 1:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = K - S + 1 - reach
    least = np.minimum(low[:n], low[rest : rest + n])
    at = np.flatnonzero((small[:n] == least) | (small[K - S : K - S + n] == least))
    first = starts - (K - 1)
    text = owners(first, at)
    real = sizes[text] > 0
    text, at = text[real], at[real]
    return text, at - first[text], mix(whole[at]) >> np.uint64(64 - HASH_BITS)


def lay_out(pieces: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (lists of code point arrays) with sentinels between: points, starts, sizes."""
    pad = np.full(K - 1, SENTINEL, np.uint32)
    sizes = np.array([sum(len(x) for x in p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + K - 1) - sizes
    return np.concatenate([pad, *(y for p in pieces for y in (*p, pad))]), starts, sizes


def encode(text: np.ndarray, position: np.ndarray, hashes: np.ndarray, n: int) -> list[str]:
    """The fingerprints of n texts."""
    gap = np.diff(position, prepend=0)
    begin = np.ones(len(text), bool)
    begin[1:] = text[1:] != text[:-1]
    gap[begin] = position[begin]
    code = (hashes.astype(np.int64) << GAP_BITS) | gap
    raw = np.stack((code >> 16, code >> 8 & 255, code & 255), 1).astype(np.uint8).tobytes()
    ends = 3 * np.cumsum(np.bincount(text, minlength=n))
    return [base64.b64encode(raw[a:b]).decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a fingerprint."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 3).astype(np.int64)
    code = raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]
    return np.cumsum(code & (1 << GAP_BITS) - 1), (code >> GAP_BITS).astype(np.uint64)


def occurrence_keys(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of (text, hash, how many equal ones came before)."""
    key = mix(mix(text.astype(np.uint64)) ^ hashes)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return mix(key + rank.astype(np.uint64) * BASE)


def likenesses(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Likeness of text i of `a` and text i of `b`, for n texts."""
    ta, pa_, ha = a
    tb, pb, hb = b
    _, ia, ib = np.intersect1d(occurrence_keys(ta, ha), occurrence_keys(tb, hb), return_indices=True)
    order = np.lexsort((pa_[ia], ta[ia]))
    ia, ib = ia[order], ib[order]
    t, shift = ta[ia], pb[ib] - pa_[ia]
    alike = np.zeros(len(t), bool)
    if len(t) > 1:
        with_next = (t[1:] == t[:-1]) & (shift[1:] == shift[:-1])
        alike[1:] |= with_next
        alike[:-1] |= with_next
    na, nb = np.bincount(ta, minlength=n), np.bincount(tb, minlength=n)
    pairs = np.bincount(t, minlength=n)
    alike |= (pairs == 1)[t] & (na == 1)[t] & (nb == 1)[t]
    both = na + nb
    return np.where(both > 0, 2 * np.bincount(t[alike], minlength=n) / np.maximum(both, 1), 1.0)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    sides = [(np.zeros(len(p), np.int64), p, h) for p, h in map(decode, (a, b))]
    return float(likenesses(sides[0], sides[1], 1)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=1 << 20):
            points, cut = code_points(block)
            laid = lay_out([[points[a:b]] for a, b in cut])
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("doc_id"), pa.array(encode(*anchors(*laid), len(cut)))], ["doc_id", "fingerprint"]
            )

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def code_points(block) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The code points of a block and the (start, end) of each text among them."""
    points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    return points, list(zip(before[block.starts].tolist(), before[block.starts + block.sizes].tolist(), strict=True))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _against_next(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is compared with the row after it in the same bucket."""
    held: pa.RecordBatch | None = None
    for block in blocks(_carried(batches), limit=1 << 20):
        rows = block.rows
        if held is not None:
            joined = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
            block = next(blocks([joined], limit=1 << 62))
            rows = block.rows
        held = rows.slice(rows.num_rows - 1)
        n = rows.num_rows - 1
        bucket, guest = np.asarray(rows.column("__bucket")), rows.column("__guest").to_numpy(zero_copy_only=False)
        wanted = (bucket[1:] == bucket[:-1]) & ~guest[:-1]
        if not wanted.any():
            continue
        points, cut = code_points(block)
        lay = [points[a:b] for a, b in cut]
        edited = []
        for i in range(n):
            gone = len(lay[i]) // 4
            edited.append([lay[i][: len(lay[i]) - gone], lay[i + 1][:gone]])
        own = anchors(*lay_out([[x] for x in lay]))
        other = anchors(*lay_out(edited))
        prints, edits = encode(*own, n + 1), encode(*other, n)
        inner, after = own[0] < n, own[0] > 0
        mine = tuple(x[inner] for x in own)
        following = (own[0][after] - 1, own[1][after], own[2][after])
        near_edited, near_next = likenesses(mine, other, n), likenesses(mine, following, n)
        digests = [hashlib.sha256(b"".join(p.tobytes() for p in e).decode("utf-32-le").encode()).hexdigest() if w else None for e, w in zip(edited, wanted, strict=True)]
        columns = [
            rows.column("doc_id").slice(0, n), pa.array(np.array([b - a for a, b in cut[:-1]], np.int64)), pa.array(digests, pa.string()),
            pa.array(prints[:-1]), pa.array(edits), pa.array(near_edited), pa.array(near_next),
        ]
        names = [x.split()[0] for x in EDITED.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(wanted))


def _carried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield b


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form: the last quarter of its code points
    replaced by the beginning of the next text by doc_id (after the last: the first).

    Rows are cut into buckets at quantiles of doc_id over the whole table. The first row of each
    bucket is also sent to the bucket before, as its last neighbour, so texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(_c("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    splits = [-float("inf"), *sorted({float(x) for x in cuts or [0]}), float("inf")]
    place = Bucketizer(splits=splits, inputCol="__at", outputCol="__bucket", handleInvalid="keep")
    put = place.transform(rows.withColumn("__at", F.coalesce(_c("doc_id").cast("double"), F.lit(-float("inf"))))).withColumn(
        "__bucket", _c("__bucket").cast("int")
    ).withColumn("__hash", F.xxhash64("text"))
    firsts = put.groupBy("__bucket").agg(F.min(F.struct("doc_id", "__hash")).alias("f")).orderBy("__bucket").collect()  # a row per bucket
    before = [(r["__bucket"], r["f"]["doc_id"], r["f"]["__hash"], firsts[i - 1]["__bucket"]) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(before, "__bucket int, __first long, __first_hash long, __to int")
    is_first = _c("doc_id").eqNullSafe(_c("__first")) & (_c("__hash") == _c("__first_hash"))
    stay = F.struct(_c("__bucket").alias("__bucket"), F.lit(False).alias("__guest"))
    go = F.struct(_c("__to").alias("__bucket"), F.lit(True).alias("__guest"))
    sent = put.join(F.broadcast(heads), "__bucket").select(
        "doc_id", "text", "__hash", F.inline(F.when(is_first, F.array(stay, go)).otherwise(F.array(stay)))
    )
    ordered = sent.repartition(parts, "__bucket").sortWithinPartitions("__bucket", "__guest", "doc_id", "__hash")
    return ordered.select("doc_id", "text", "__bucket", "__guest").mapInArrow(_against_next, EDITED)
