"""Hard-negative mining through an inverted multi-index (operator 12).

Vectors are quantised to integers (floor(256 x)); a row's score against an anchor is the integer
inner product. The two halves of the space each get a codebook (k-means on a bounded sample of
rows), and every row lies in the cell (centroid of its first half, centroid of its second half).
Each codebook entry also has a radius: the largest distance of its rows from it. For an anchor q,
no row of cell (i, j) can score above

    bound(i, j) = q1 . c1_i + |q1| r1_i + q2 . c2_j + |q2| r2_j,

a sum of two half-scores, so cells can be visited in descending bound order by the multi-sequence
heap over the two sorted half lists, without looking at all cells.

An anchor visits its first cells in heap order and scores the rows of their shelves exactly (a
shelf holds whole first-half codes, or a part of a large one; rows of its other cells can only add
candidates). Its positives (the first `positives` rows of its label, itself excluded) are certain
once the last of them scores above the best bound of the shelves left out; each positive's window of
negatives (different label, 30 p <= 100 n <= 90 p, first `negatives` by score) is certain once its
last negative scores above that bound, or once the bound falls below the window. Anchors that are
not yet certain are taken again with four times as many cells, or with all once a round leaves
every anchor uncertain. So the result is exact; the index only decides how much is read.

Ranking: higher scores first, ties by smaller vec_id. Labels first become (label + 1) % 10 where
vec_id is divisible by 7. Anchors are rows whose vec_id is divisible by `every`.

Sizes: the codebooks have k = ceil(sqrt(rows / `rows_per_cell`)) entries (2 to `max_codes`), fitted
on the `sample_rows` rows of smallest hash. The driver gets these, taken by the executors (a limit that
is collected sends as many rows from every task), 2 k centroids and the filled cells (k^2 at most).
Nothing else is collected, and rows and anchors are never broadcast: joins of anchors ask for
sort-merge, as files of small integers are far smaller than their rows in memory. Vectors travel as
packed integers of the width they need. A round sends one row per anchor and shelf, and the
rows once per group of `group_anchors` anchors. A task scores a group against a shelf, block by block
of `block_rows` rows, each a matrix product in memory, and only the candidates that can reach the
result leave it. There are about 64 shelves, more only if they would exceed `shelf_rows` rows.

Special cases: rows with a null label, a null vector, any null or non-finite component, a null
vec_id, or a vector of another length than the sample's take no part; an anchor without positives
gives no rows, and a positive without negatives in its window gives none; repeated rows are rows of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

_c = F.col
NONE = -1e300
NO_BROADCAST = "merge"
SHELVES, CHUNK = 64, 256
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(emb: DataFrame) -> DataFrame:
    """vec_id, label (after the shift), q (array<long>) of the rows that take part."""
    e = _c("embedding")
    ok = e.isNotNull() & _c("label").isNotNull() & _c("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    label = F.when(_c("vec_id") % 7 == 0, F.pmod(_c("label") + 1, F.lit(10))).otherwise(_c("label")).cast("long")
    q = F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return emb.where(ok).select(_c("vec_id").cast("long").alias("vec_id"), label.alias("label"), q.alias("q"))


def kmeans(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Lloyd's rounds from the first k distinct rows; an empty centroid keeps its place."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:k]].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, c)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (-2 * x @ c.T + (c * c).sum(1)[None, :]).argmin(1)


def sampled(rows: DataFrame, size: int) -> list[np.ndarray]:
    """The vectors of the `size` rows of smallest hash, in that order. Executors sort the rows below a
    hash that about twice as many rows lie below, and the driver reads the few that stay."""
    keyed = rows.select(F.xxhash64("vec_id", "q").alias("h"), "__rid", "q")
    share = 2 * size / max(1, rows.count())
    while True:
        some = keyed if share >= 1 else keyed.where(_c("h") < int(share * 2**64) - 2**63)
        first = cut_lineage(some.orderBy("h", "__rid").limit(size))
        if share >= 1 or first.count() >= size:
            break
        share *= 4
    t = first.toArrow()
    at = np.lexsort((t["__rid"].to_numpy(), t["h"].to_numpy()))
    if not len(at):
        return []
    q = t["q"].combine_chunks()
    flat, ends = q.values.to_numpy(), q.offsets.to_numpy()
    return [flat[ends[i] : ends[i + 1]] for i in at]


def _floats(column: pa.ChunkedArray | pa.Array, kind: str, dim: int, to: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), dim).astype(to)


def _assign(c1: np.ndarray, c2: np.ndarray, half: int, dim: int, kind: str) -> callable:
    """Rows with their vector packed, their cell and their distances from its centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(b), dim)
            x = q.astype(np.float64)
            i, j = _nearest(x[:, :half], c1), _nearest(x[:, half:], c2)
            d1 = np.linalg.norm(x[:, :half] - c1[i], axis=1)
            d2 = np.linalg.norm(x[:, half:] - c2[j], axis=1)
            packed = pa.array([v.tobytes() for v in q.astype(kind)], pa.binary())
            cols = [b.column("__rid"), b.column("vec_id"), b.column("label"), packed, i.astype(np.int32), j.astype(np.int32), d1, d2]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["__rid", "vec_id", "label", "q", "c1", "c2", "d1", "d2"])

    return run


def cell_order(u1: np.ndarray, u2: np.ndarray, filled: set[int], k: int) -> Iterator[tuple[int, float]]:
    """(cell, bound) of the filled cells in descending bound order: the multi-sequence heap."""
    i1, i2 = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
    heap, seen = [(-(u1[i1[0]] + u2[i2[0]]), 0, 0)], {(0, 0)}
    while heap:
        neg, a, b = heapq.heappop(heap)
        cell = int(i1[a]) * k + int(i2[b])
        if cell in filled:
            yield cell, -neg
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < k and y < k and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(u1[i1[x]] + u2[i2[y]]), x, y))


def shelves(counts: dict[int, int], rows: int) -> dict[int, range]:
    """The shelves of each code: small codes share one, a code of more than `rows` rows has several."""
    out, last, used = {}, -1, rows
    for code, n in sorted(counts.items()):
        parts = math.ceil(n / rows)
        if parts > 1:
            out[code], last, used = range(last + 1, last + 1 + parts), last + parts, rows
        else:
            if used + n > rows:
                last, used = last + 1, 0
            out[code], used = range(last, last + 1), used + n
    return out


def _visits(c1, r1, c2, r2, filled: set[int], shelf: dict[int, range], budget: int | None, half: int, kind: str) -> callable:
    """Per anchor, the shelves of the first `budget` filled cells in heap order (None: of all), and the
    best bound of a cell in the shelves left out."""
    k = len(c1)
    every = sorted({x for xs in shelf.values() for x in xs})
    cells = np.zeros((k, k), dtype=bool)
    cells.flat[sorted(filled)] = True
    first = np.array([shelf[i][0] if i in shelf else -1 for i in range(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, nexts = [], []
            for q in _floats(b.column("aq"), kind, c1.shape[1] + c2.shape[1], "float64"):
                if budget is None:
                    taken.append(every)
                    nexts.append(NONE)
                    continue
                q1, q2 = q[:half], q[half:]
                slack = 1e-6 * (1 + np.abs(q).sum())
                u1 = c1 @ q1 + np.linalg.norm(q1) * r1 + slack
                u2 = c2 @ q2 + np.linalg.norm(q2) * r2 + slack
                codes = {cell // k for (cell, _), _ in zip(cell_order(u1, u2, filled, k), range(budget))}
                mine = sorted({x for c in codes for x in shelf[c]})
                left = (first >= 0) & ~np.isin(first, mine)
                taken.append(mine)
                nexts.append(float((u1[left] + np.where(cells[left], u2, NONE).max(1)).max()) if left.any() else NONE)
            yield pa.RecordBatch.from_arrays(
                [b.column("__arid"), b.column("anchor_id"), b.column("alabel"), b.column("aq"), pa.array(taken, pa.list_(pa.int32())), pa.array(nexts, pa.float64())],
                names=["__arid", "anchor_id", "alabel", "aq", "shelves", "next"],
            )

    return run


def hard_negatives(emb: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, rows_per_cell: int = 32, max_codes: int = 256, sample_rows: int = 20000, block_rows: int = 1024, first_cells: int = 8, shelf_rows: int = 1 << 18, group_anchors: int = 98304) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = emb.sparkSession
    rows = cut_lineage(prepared(emb).withColumn("__rid", F.monotonically_increasing_id()))
    sample = sampled(rows, sample_rows)
    if not sample:
        return spark.createDataFrame([], OUT)
    dim = len(sample[0])
    x = np.array([q for q in sample if len(q) == dim], dtype=np.float64)
    rows = rows.where(F.size("q") == dim)
    half = dim // 2
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, least, most, norm = rows.agg(F.count(F.lit(1)), F.min(F.array_min("q")), F.max(F.array_max("q")), F.max(square)).first()
    kind = next((t for t in ("int16", "int32") if least is None or np.iinfo(t).min <= least and most <= np.iinfo(t).max), "int64")
    number = "float32" if norm < 1 << 24 else "float64"  # integers below 2^24 (2^53): every sum of a product is exact
    k = max(2, min(max_codes, math.ceil(math.sqrt(n / rows_per_cell))))
    c1, c2 = _filled(kmeans(x[:, :half], k), k), _filled(kmeans(x[:, half:], k), k)

    placed = cut_lineage(rows.select("__rid", "vec_id", "label", "q").mapInArrow(_assign(c1, c2, half, dim, kind), "__rid long, vec_id long, label long, q binary, c1 int, c2 int, d1 double, d2 double"))
    r1, r2 = np.zeros(k), np.zeros(k)
    counts = {}
    for r in placed.groupBy("c1").agg(F.max("d1"), F.count(F.lit(1))).collect():
        r1[r[0]], counts[int(r[0])] = r[1], int(r[2])
    for r in placed.groupBy("c2").agg(F.max("d2")).collect():
        r2[r[0]] = r[1]
    filled = {int(r[0]) for r in placed.select((_c("c1") * k + _c("c2")).alias("cell")).distinct().collect()}
    shelf = shelves(counts, max(block_rows, min(shelf_rows, math.ceil(n / SHELVES))))
    start = F.array(*[F.lit(shelf[i][0] if i in shelf else 0) for i in range(k)])[_c("c1")]
    parts = F.array(*[F.lit(len(shelf[i]) if i in shelf else 1) for i in range(k)])[_c("c1")]
    table = placed.select((start + F.pmod(F.xxhash64("__rid"), parts)).cast("int").alias("shelf"), "__rid", "vec_id", "label", "q")

    todo = cut_lineage(placed.where(_c("vec_id") % every == 0).select(_c("__rid").alias("__arid"), _c("vec_id").alias("anchor_id"), _c("label").alias("alabel"), _c("q").alias("aq")))
    done, budget, open_ = [], first_cells, todo.count()
    score = dict(kind=kind, dim=dim, number=number, block_rows=block_rows, positives=positives, negatives=negatives, low=low, high=high)
    while open_ or not done:
        plan = todo.mapInArrow(_visits(c1, r1, c2, r2, filled, shelf, budget, half, kind), "__arid long, anchor_id long, alabel long, aq binary, shelves array<int>, next double")
        groups = max(1, math.ceil(open_ / group_anchors))
        tasks = 2 * groups * max(x[-1] + 1 for x in shelf.values())
        found, certain = _round(cut_lineage(plan), table, groups, tasks, score)
        done.append(cut_lineage(found.join(certain.hint(NO_BROADCAST), "__arid", "left_semi").drop("__arid")))
        todo = cut_lineage(todo.join(certain.hint(NO_BROADCAST), "__arid", "left_anti"))
        before, open_ = open_, todo.count()
        budget = budget * 4 if open_ < before and budget else None
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _runs(sorted_values: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the runs of equal values, cut at `most`."""
    ends = np.append(np.nonzero(np.diff(sorted_values))[0] + 1, len(sorted_values)) if len(sorted_values) else []
    a = 0
    for b in ends:
        for i in range(a, b, most):
            yield i, min(b, i + most)
        a = b


def _ranks(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values."""
    new = np.append(True, groups[1:] != groups[:-1])
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(new, at, 0))


class _Best:
    """Of an anchor chunk, the rows that are among the first `keep` of a window: `add` takes scores of
    a block, `low` is what a score has to reach to be looked at. Windows are (anchors x windows)."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, keep: int, number: str, ids: np.ndarray):
        self.lo, self.hi, self.keep, self.number, self.ids = lo, hi, keep, number, ids
        self.held, self.n = [], 0
        self.i, self.j, self.s = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.top = hi.max(1).astype(number)[:, None]
        self.cut = lo.copy()
        self._low()

    def _low(self) -> None:
        self.low = np.where(self.cut <= self.hi, self.cut, np.iinfo(np.int64).max // 2).min(1).astype(self.number)[:, None]

    def start(self, score: np.ndarray) -> None:
        """For a window without limits: of the first block, only scores among its `keep` + 1 best
        matter (one of them may be the anchor's own)."""
        if score.shape[1] > self.keep:
            self.low = np.partition(score, -self.keep - 1, axis=1)[:, -self.keep - 1 : -self.keep]

    def add(self, score: np.ndarray, j0: int, ok: callable) -> None:
        at = np.flatnonzero((score >= self.low) & (score <= self.top))
        if not len(at):
            return
        i, j = np.divmod(at, score.shape[1])
        s, j = score.ravel()[at], j + j0
        good = ok(i, j)
        self.held.append((i[good], j[good], np.rint(s[good]).astype(np.int64)))
        self.n += int(good.sum())
        if self.n > 16 * self.keep * len(self.lo):
            self.settle()

    def settle(self) -> None:
        """Keep what is among the first of a window; ties go to the smaller vec_id."""
        i, j, s = (np.concatenate([x, *(h[c] for h in self.held)]) for c, x in enumerate((self.i, self.j, self.s)))
        at = np.lexsort((self.ids[j], -s, i))
        i, j, s = i[at], j[at], s[at]
        stay = np.zeros(len(i), dtype=bool)
        for m in range(self.lo.shape[1]):
            w = np.flatnonzero((s >= self.lo[i, m]) & (s <= self.hi[i, m]))
            if len(w):
                rank = _ranks(i[w])
                stay[w[rank < self.keep]] = True
                last = w[rank == self.keep - 1]
                self.cut[i[last], m] = s[last]
        self.i, self.j, self.s, self.held, self.n = i[stay], j[stay], s[stay], [], 0
        self._low()


def _scored(phase: str, kind: str, dim: int, number: str, block_rows: int, positives: int, negatives: int, low: int, high: int) -> callable:
    """Score a group of anchors against the rows of a shelf, block by block, and keep only what can
    reach the result: per anchor the first `positives` rows of its label ("pos"), or the rows that are
    among the first `negatives` of the window of one of its positives ("neg"). Rows and anchors are put
    in order of label, so that a chunk of anchors skips its own label's rows, or reads no others."""

    def run(key: tuple, visits: pa.Table, rows: pa.Table) -> pa.Table:
        empty = np.zeros(0, dtype=np.int64)
        out = [(empty, empty, empty)]
        if len(visits) and len(rows):
            rows = rows.take(np.argsort(rows["label"].to_numpy(), kind="stable"))
            visits = visits.take(np.argsort(visits["alabel"].to_numpy(), kind="stable"))
            rid, ids, lab = (rows[c].to_numpy() for c in ("__rid", "vec_id", "label"))
            arid, alab = visits["__arid"].to_numpy(), visits["alabel"].to_numpy()
            q, a = _floats(rows["q"], kind, dim, number), _floats(visits["aq"], kind, dim, number)
            del rows
            if phase == "neg":
                lists = [np.array(p, dtype=np.int64) for p in visits["pscores"].to_pylist()]
                width = max(len(p) for p in lists)
                real = np.arange(width)[None, :] < np.array([len(p) for p in lists])[:, None]
                ps = np.zeros((len(lists), width), dtype=np.int64)
                ps[real] = np.concatenate(lists)
                los, his = np.where(real, -(-low * ps // 100), 1), np.where(real, high * ps // 100, 0)
            far = np.iinfo(np.int64).max // 4
            for x, y in _runs(alab, CHUNK):
                n = y - x
                mine = slice(np.searchsorted(lab, alab[x], "left"), np.searchsorted(lab, alab[x], "right"))
                if phase == "pos":
                    best = _Best(np.full((n, 1), -far), np.full((n, 1), far), positives, number, ids)
                    spans = [(mine.start, mine.stop)]
                else:
                    best = _Best(los[x:y], his[x:y], negatives, number, ids)
                    spans = [(0, mine.start), (mine.stop, len(lab))]
                for u, v in spans:
                    for j in range(u, v, block_rows):
                        z = min(v, j + block_rows)
                        product = a[x:y] @ q[j:z].T
                        if phase == "pos" and j == u:
                            best.start(product)
                        best.add(product, j, lambda i, r, x=x: rid[r] != arid[x + i])
                best.settle()
                out.append((arid[x + best.i], ids[best.j], best.s))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"__arid": cols[0], "row_id": cols[1], "score": cols[2]})

    return run


def _filled(c: np.ndarray, k: int) -> np.ndarray:
    """k centroids: a codebook of fewer distinct rows is filled with far points no row is near."""
    return np.vstack([c, np.full((k - len(c), c.shape[1]), 1e12)]) if len(c) < k else c


def _round(plan: DataFrame, table: DataFrame, groups: int, tasks: int, score: dict) -> tuple[DataFrame, DataFrame]:
    """(result rows, certain anchors) from the shelves visited so far and the bound of the others."""
    keys, found_rows = ["shelf", "group"], "__arid long, row_id long, score long"
    positives, negatives, low = score["positives"], score["negatives"], score["low"]
    rows = table.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, *keys)

    def against(visits: DataFrame, phase: str, *extra: str) -> DataFrame:
        group = F.pmod(F.xxhash64("__arid"), F.lit(groups)).cast("int").alias("group")
        sent = visits.select(F.explode("shelves").alias("shelf"), group, "__arid", "alabel", "aq", *extra).repartition(tasks, *keys)
        return sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_scored(phase, **score), found_rows)

    order = Window.partitionBy("__arid").orderBy(_c("score").desc(), "row_id")
    pos = against(plan, "pos").withColumn("__r", F.row_number().over(order)).where(_c("__r") <= positives)
    pos = cut_lineage(pos.select("__arid", _c("row_id").alias("positive_id"), _c("score").alias("positive_score")))
    lists = pos.groupBy("__arid").agg(F.collect_list("positive_score").alias("pscores"))
    near = against(plan.join(lists.hint(NO_BROADCAST), "__arid"), "neg", "pscores").select("__arid", _c("row_id").alias("negative_id"), _c("score").alias("negative_score"))
    inside = (low * _c("positive_score") <= 100 * _c("negative_score")) & (100 * _c("negative_score") <= score["high"] * _c("positive_score"))
    neg = near.join(pos.hint(NO_BROADCAST), "__arid").where(inside).drop("positive_score")
    w2 = Window.partitionBy("__arid", "positive_id").orderBy(_c("negative_score").desc(), "negative_id")
    neg = neg.withColumn("rank", F.row_number().over(w2)).where(_c("rank") <= negatives)
    found = neg.join(pos.hint(NO_BROADCAST), ["__arid", "positive_id"]).join(plan.select("__arid", "anchor_id").hint(NO_BROADCAST), "__arid")
    found = cut_lineage(found.select("__arid", "anchor_id", "positive_id", _c("rank").cast("int"), "negative_id", "positive_score", "negative_score"))
    bounds = plan.select("__arid", "next").hint(NO_BROADCAST)
    exhausted = _c("next") <= NONE
    pos_state = pos.groupBy("__arid").agg(F.count(F.lit(1)).alias("__np"), F.min("positive_score").alias("__last"))
    sure_pos = bounds.join(pos_state, "__arid", "left").where(exhausted | ((_c("__np") == positives) & (_c("__last") > _c("next"))))
    win_state = found.groupBy("__arid", "positive_id").agg(F.count(F.lit(1)).alias("__nn"), F.min("negative_score").alias("__tail"))
    windows = pos.hint(NO_BROADCAST).join(win_state, ["__arid", "positive_id"], "left").join(bounds, "__arid")
    sure = exhausted | ((F.coalesce("__nn", F.lit(0)) == negatives) & (_c("__tail") > _c("next"))) | (100 * _c("next") < low * _c("positive_score"))
    certain = sure_pos.select("__arid").join(windows.where(~sure).select("__arid").hint(NO_BROADCAST), "__arid", "left_anti")
    return found, cut_lineage(certain)
