"""Set similarity join on word n-grams by chosen paths (operator 3).

Documents are sets of hashed word n-grams (a text of fewer words, but not none, has one n-gram of
all its words). Equal sets form one class, and only classes are joined.

1. Each class has a MinHash signature of `COORDINATES` places; two classes agree at a place with
   probability J, their Jaccard similarity.
2. Chosen paths: a run starts with all classes in one node; a node chooses each place with
   probability 1 / (threshold x COORDINATES) and splits on it: classes with the same value there
   go on together. Nodes of at most `LEAF` classes are not split again, nor any below depth
   `DEPTH`. A pair at the threshold stays together down to depth d with probability s_d, where
   s_0 = 1 and s_d = 1 - exp(-s_(d-1)); runs are repeated until 1 - (1 - s_DEPTH)^runs reaches the
   target recall. Leaves with the same members are compared once.
3. Inside a leaf, classes whose signatures agree in `LOOSE` of the places or more are linked, each
   to one other. In large leaves, classes that agree in `LEADER` of the places are first linked to
   a leader; leaders are linked if they agree in `LOOSE` of the places less their radii (the number
   of differing places is a metric, so no pair of their members is lost). A leaf of more than
   `DEALT` classes is dealt into blocks, and only the leaders of two blocks meet, in a task for
   each two. A leaf gives at most one link a class. Linked classes form candidate groups.
4. Exact check: every pair of a candidate group is compared by its true sets, as sparse matrix
   products. A large group is dealt into blocks and its pairs of blocks are separate tasks. Only
   the number of links of each class, and one link to its cluster, leave a task - never pairs.
5. Clusters of exact links, over the blocks, give the class id: the smallest doc_id.

Result: doc_id, class_id, n_links (other documents with J >= threshold, equal ones among them).

Special cases: a null text, or one without words, has no n-grams, no links, and is its own class;
repeated rows count as documents; a null doc_id comes first among ids; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bytetext import blocks, mix, owners, span_hashes
from riskloom.llm.fmindex import words_of
from riskloom.operators.graph import components
from riskloom.session import cut_lineage

_c = F.col
COORDINATES = 128
LEAF, DEPTH = 64, 3
LOOSE = 0.6  # five standard deviations of the estimate below 0.8
LEADER, DEALT = 0.9, 2048
BLOCK_ROWS, BLOCK_BYTES = 1500, 16 << 20
FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))


def runs_for(recall: float) -> int:
    """Runs that a pair at the threshold needs for this probability of being found."""
    stay = 1.0
    for _ in range(DEPTH):
        stay = 1 - math.exp(-stay)
    return math.ceil(math.log(1 - recall) / math.log(1 - stay))


def shingle_sets(block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of the block's texts, and where each text's begin (n + 1 offsets)."""
    first, _, words = words_of(block.data)
    count = np.bincount(owners(block.starts, first), minlength=len(block.sizes)) if len(first) else np.zeros(len(block.sizes), np.int64)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(n)), n)
    begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(count) - count, n)
    grams = span_hashes(words, begin, begin + np.minimum(count, width)[text])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def minima(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48-bit MinHash values of each non-empty set (rows of empty sets are 0)."""
    out = np.zeros((len(at) - 1, COORDINATES), np.uint64)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        for j in range(COORDINATES):
            out[some, j] = np.minimum.reduceat((grams * FACTORS[j] + OFFSETS[j]) >> np.uint64(16), at[some])
    return out


def children(node: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for the places that each row's node chooses, by the row's value there."""
    chance = np.uint64(int(2**64 / (threshold * COORDINATES)))
    spot = mix(node)[:, None] ^ mix(np.arange(77, 77 + COORDINATES, dtype=np.uint64))[None, :]
    one, place = np.nonzero(mix(spot) < chance)
    return one, mix(spot[one, place] + mix(values[one, place] + np.uint64(1)))


def _signed(width: int, threshold: float, runs: int):
    """Signatures, and the nodes after the first split of every run, by whole MinHash values: there
    all documents meet, so a shorter value would bring unlike ones together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = mix(np.arange(runs, dtype=np.uint64))
        for block in blocks(batches):
            grams, at = shingle_sets(block, width)
            least = minima(grams, at)
            keys = [hashlib.blake2b(grams[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            nodes: list[list[np.ndarray]] = []
            for one in start:
                row, child = children(np.full(len(least), one), least, threshold)
                nodes.append(np.split(child.view(np.int64), np.searchsorted(row, np.arange(1, len(least)))))
            signed = (mix(least) >> np.uint64(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("id"), block.rows.column("row"), pa.array(keys, pa.binary()), pa.array(np.diff(at)), pa.array([x.tobytes() for x in signed], pa.binary()),
                    pa.array([np.concatenate(x) for x in zip(*nodes, strict=True)], pa.list_(pa.int64())),
                ],
                ["id", "row", "key", "n_grams", "signature", "nodes"],
            )

    return run


def signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), COORDINATES)


def _split(threshold: float):
    """The next nodes of (node, key, signature) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                b = batch.slice(first, 4096)
                row, child = children(np.asarray(b.column("node")).view(np.uint64), signature_rows(b.column("signature")).astype(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("key").take(pa.array(row))], ["node", "key"])

    return run


def groups_of(batches: Iterable[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches; many small groups come in one table, no
    group is in two."""
    held: list[pa.RecordBatch] = []

    def last_group(b: pa.RecordBatch) -> int:
        edge = np.zeros(b.num_rows, bool)
        for name in by:
            x = np.asarray(b.column(name))
            edge[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(edge)
        return int(at[-1]) if len(at) else 0

    for b in batches:
        if not b.num_rows:
            continue
        cut = last_group(b)
        changed = bool(held) and any(held[-1].column(n)[-1] != b.column(n)[0] for n in by)
        if changed:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def slices(table: pa.Table, by: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    edge = np.ones(table.num_rows, bool)
    if table.num_rows:
        edge[1:] = False
        for name in by:
            x = table.column(name).to_numpy()
            edge[1:] |= x[1:] != x[:-1]
    at = [*np.flatnonzero(edge).tolist(), table.num_rows]
    yield from zip(at[:-1], at[1:], strict=True)


def clusters(linked: np.ndarray) -> np.ndarray:
    """The smallest number in each part of a graph, given as a symmetric boolean matrix."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        new = label.copy()
        for i in range(0, len(linked), 256):
            new[i : i + 256] = np.minimum(label[i : i + 256], np.where(linked[i : i + 256], label[None, :], np.int32(len(label))).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of equal places between rows of a and rows of b."""
    if len(a) * len(b) <= LEAF * LEAF:
        return (a[:, None, :] == b[None, :, :]).sum(2, dtype=np.uint8)
    out = np.zeros((len(a), len(b)), np.uint8)
    mine, other = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for x, y in zip(mine, other, strict=True):
        out += x[:, None] == y[None, :]
    return out


def close(signed: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which leaders may have members that agree in `LOOSE` of the places: those that agree in at
    most the sum of their radii less."""
    return agreement(signed, signed).astype(np.int16) >= math.ceil(LOOSE * COORDINATES) - radius[:, None] - radius[None, :]


def linked_to(signed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row another row of its cluster (or itself); the leaders, and their radii: the most
    places in which one of a leader's rows differs from it."""
    if len(signed) <= LEAF:
        every, none = np.arange(len(signed)), np.zeros(len(signed), np.int16)
        return clusters(close(signed, none)), every, none
    leaders, radii = [], []
    mine = np.full(len(signed), -1)
    free = np.arange(len(signed))
    while len(free):
        same = (signed[free] == signed[free[0]]).sum(1)
        near = same >= LEADER * COORDINATES
        mine[free[near]] = free[0]
        leaders.append(free[0])
        radii.append(COORDINATES - same[near].min())
        free = free[~near]
    at, radius = np.array(leaders), np.array(radii, np.int16)
    mine[at] = at[clusters(close(signed[at], radius))]
    return mine, at, radius


def _linking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside blocks; of a node that was dealt into several, also the leaders of each block."""
    by = ("node", "block")
    for table in groups_of(batches, by):
        key, parts = table.column("key").to_pylist(), table.column("parts").to_numpy()
        signed = signature_rows(table.column("signature").combine_chunks())
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        out: list[tuple] = []
        for a, b in slices(table, by):
            if b - a == 2 and parts[a] == 1:
                if (signed[a] == signed[a + 1]).mean() >= LOOSE:
                    out.append((key[a], key[a + 1], None, None, None, None, None))
                continue
            to, leaders, radius = linked_to(signed[a:b])
            out += [(key[a + i], key[a + j], None, None, None, None, None) for i, j in enumerate(to.tolist()) if i != j]
            if parts[a] > 1:
                out += [(key[a + i], None, int(node[a]), int(block[a]), int(parts[a]), r, signed[a + i].tobytes()) for i, r in zip(leaders.tolist(), radius.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), LINK_TYPES, strict=True)], schema=LINK_TYPES)


def _linking_leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the leaders of two blocks of a node."""
    by = ("node", "low", "high")
    for table in groups_of(batches, by):
        key, block, radius = table.column("key").to_pylist(), table.column("block").to_numpy(), table.column("radius").to_numpy().astype(np.int16)
        signed = signature_rows(table.column("signature").combine_chunks())
        out: list[tuple] = []
        for a, b in slices(table, by):
            linked = close(signed[a:b], radius[a:b]) & (block[a:b, None] != block[None, a:b])
            out += [(key[a + i], key[a + j]) for i, j in enumerate(clusters(linked).tolist()) if i != j]
        if out:
            src, dst = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])


LINK_TYPES = pa.schema([("src", pa.binary()), ("dst", pa.binary()), ("node", pa.int64()), ("block", pa.int32()), ("parts", pa.int32()), ("radius", pa.int16()), ("signature", pa.binary())])
LINKS = "src binary, dst binary, node long, block int, parts int, radius short, signature binary"


def candidate_groups(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, group) of the classes that are linked to another; `classes` has key, signature, nodes."""
    signed = classes.select("key", "signature")
    nodes = classes.select(F.explode("nodes").alias("node"), "key")
    links: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        nodes = cut_lineage(nodes) if depth > 1 else nodes
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("members")).where("n > 1")
        small = F.lit(True) if depth == DEPTH else _c("n") <= LEAF
        leaves = sizes.where(small).groupBy("n", "members").agg(F.min("node").alias("node")).select("node", "n")
        rows = nodes.join(leaves, "node").join(signed, "key").withColumn("parts", F.ceil(_c("n") / DEALT).cast("int"))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), "parts").cast("int")).select("node", "block", "parts", "key", "signature")
        links.append(dealt.repartition("node", "block").sortWithinPartitions("node", "block", "key").mapInArrow(_linking, LINKS))
        if depth < DEPTH:
            large = sizes.where(~small).select("node")
            nodes = nodes.join(large, "node").join(signed, "key").select("node", "key", "signature").mapInArrow(_split(threshold), "node long, key binary")
    found = cut_lineage(links[0].unionByName(links[1]).unionByName(links[2]))
    # leaders of a node of several blocks: each block meets every other once
    leaders = found.where("dst is null").withColumn("other", F.explode(F.sequence(F.lit(0), _c("parts") - 1))).where("other != block")
    paired = leaders.select("node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), _c("src").alias("key"), "block", "radius", "signature")
    across = cut_lineage(paired.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "key").mapInArrow(_linking_leaders, "src binary, dst binary"))
    edges = found.where("dst is not null").select("src", "dst").unionByName(across)
    return components(edges).select(_c("node").alias("key"), _c("component").alias("group"))


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices; n-grams that one set or
    all sets have need none."""
    m = len(sets)
    value, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    every = int((n == m).sum())
    out = np.full((m, m), every, np.int64)
    wanted = np.flatnonzero((n > 1) & (n < m))
    number = np.full(len(value), -1, np.int64)
    number[wanted] = np.arange(len(wanted))
    at = number[column]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    step = max(256, (8 << 20) // m)
    for first in range(0, len(wanted), step):
        a, b = np.searchsorted(at, [first, first + step])
        one = np.zeros((m, min(step, len(wanted) - first)), np.float32)
        one[row[a:b], at[a:b] - first] = 1
        out += np.rint(one @ one.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _checking(threshold: float):
    by = ("part",)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, by):
            key, raw = table.column("key").to_pylist(), table.column("grams")
            side, weight = table.column("side").to_numpy(), table.column("n").to_numpy()
            out: list[tuple] = []
            for a, b in slices(table, by):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in range(a, b)]
                size = np.array([len(s) for s in sets])
                both = shared(sets)
                alike = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(alike, False)
                if (side[a:b] != 0).any():  # two blocks: only pairs across
                    alike &= side[a:b, None] != side[None, a:b]
                total = alike @ weight[a:b]
                label = clusters(alike)
                out += [(key[a + i], int(total[i]), key[a + j]) for i, j in enumerate(label.tolist()) if total[i]]
            if out:
                src, n, dst = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(n, pa.int64()), pa.array(dst, pa.binary())], ["src", "links", "dst"])

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            grams, at = shingle_sets(block, width)
            names = [n for n in block.rows.schema.names if n != "text"]
            packed = pa.array([grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(block.rows.column(n) for n in names), packed], [*names, "grams"])

    return run


def similarity_join(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, class_id, n_links."""
    rows = docs.select(_c("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    signed = cut_lineage(rows.mapInArrow(_signed(width, threshold, runs_for(recall)), "id long, row long, key binary, n_grams long, signature binary, nodes array<long>"))
    classes = cut_lineage(
        signed.where("key is not null").groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row")).alias("first"), F.first("n_grams").alias("n_grams"), F.first("signature").alias("signature"), F.first("nodes").alias("nodes")
        )
    )
    groups = cut_lineage(candidate_groups(classes, threshold).join(classes.drop("signature", "nodes"), "key"))
    parts = groups.groupBy("group").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_grams") * 8 / BLOCK_BYTES)).cast("int").alias("parts")
    )
    members = groups.join(parts, "group").withColumn("mine", F.pmod(F.xxhash64("key"), _c("parts")).cast("int"))
    texts = rows.select("row", "text").join(members.select(_c("first.row").alias("row"), "key", "n", "group", "parts", "mine"), "row").dropDuplicates(["key"])
    sets = texts.drop("row").mapInArrow(_sets(width), "key binary, n long, group binary, parts int, mine int, grams binary")
    # each block meets itself, and every other block of its group once
    other = F.explode(F.sequence(F.lit(0), _c("parts") - 1))
    paired = sets.withColumn("other", other).select(
        F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"),
        "key", "n", F.when(_c("mine") == _c("other"), 0).when(_c("mine") < _c("other"), 1).otherwise(2).alias("side"), "grams",
    )
    checked = cut_lineage(paired.repartition("part").sortWithinPartitions("part").mapInArrow(_checking(threshold), "src binary, links long, dst binary"))
    links = checked.groupBy(_c("src").alias("key")).agg(F.sum("links").alias("links"))
    found = components(checked.where("src != dst").select("src", "dst")).select(_c("node").alias("key"), _c("component").alias("cluster"))
    first = found.join(classes.select("key", "first"), "key").groupBy("cluster").agg(F.min("first").alias("lowest"))
    known = (
        classes.select("key", "n", _c("first.id").alias("own"))
        .join(links, "key", "left")
        .join(found.join(first, "cluster").select("key", "lowest"), "key", "left")
        .select("key", F.when(_c("lowest").isNull(), _c("own")).otherwise(_c("lowest.id")).alias("class_id"), (_c("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return signed.select("id", "key").join(known, "key", "left").select(
        _c("id").alias("doc_id"), F.when(_c("n_links").isNull(), _c("id")).otherwise(_c("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
