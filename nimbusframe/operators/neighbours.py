"""Nearest neighbours: sources dealt into blocks of bounded size, each searched by a tree in numpy.

A tree is balanced: node i of a level has the children 2i and 2i + 1 in the next, and leaves are slices of
the ordered points. Distances to boxes and points are summed in the same order, so that rounding never puts a
point nearer than the box that holds it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources of a block and targets of a task's piece, about; points drawn for each block to place the cuts, which shape blocks but not results.
BLOCK, PIECE, DRAWN = 30_000, 30_000, 64
#: Most pairs of targets and nodes or points held at once.
PAIRS = 2_000_000

Boxes = list[tuple[np.ndarray, np.ndarray]]


def squares(parts: list[np.ndarray]) -> np.ndarray:
    total = 0.0
    for p in parts:
        total = total + p * p
    return total


def gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to its box."""
    return squares([np.maximum(np.maximum(low[:, c] - q[:, c], q[:, c] - high[:, c]), 0.0) for c in range(q.shape[1])])


def upwards(low: np.ndarray, high: np.ndarray) -> Boxes:
    """The boxes of every level from the root to the leaves given."""
    levels = [(low, high)]
    while len(low) > 1:
        low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
        levels.insert(0, (low, high))
    return levels


def ordered(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The order of points by leaves of at most ``leaf``, where each leaf begins, and by level the axis and place of each node's cut."""
    m = len(points)
    order, cuts, splits = np.arange(m), np.array([0, m]), []
    while (np.diff(cuts) > leaf).any():
        n = len(cuts) - 1
        node, p = np.repeat(np.arange(n), np.diff(cuts)), points[order]
        axis = (np.maximum.reduceat(p, cuts[:-1]) - np.minimum.reduceat(p, cuts[:-1])).argmax(1)
        along = p[np.arange(m), axis[node]]
        turn = np.lexsort((along, node))
        order, along = order[turn], along[turn]
        cuts = m * np.arange(2 * n + 1) // (2 * n)
        splits.append((axis, along[cuts[1:-1:2]]))
    return order, cuts, splits


def placed(q: np.ndarray, splits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf on whose side of the cuts each point lies."""
    node, at = np.zeros(len(q), dtype=np.int64), np.arange(len(q))
    for axis, cut in splits:
        node = 2 * node + (q[at, axis[node]] >= cut[node])
    return node


def reached(boxes: Boxes, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of points and leaves that are no farther than the points' bounds; None if they are too many to hold."""
    t, node = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
    for level, (low, high) in enumerate(boxes):
        if level:
            t, node = np.repeat(t, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
        near = gaps(q[t], low[node], high[node])
        keep = np.isfinite(near) & (near <= bound[t])
        t, node = t[keep], node[keep]
        if len(t) > PAIRS // 8 and len(q) > 1:
            return None
    return t, node


class Tree:
    """Sources of one block. Of those at the same place only the k with the smallest ids are kept."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int) -> None:
        turn = np.lexsort((ids, *points.T))
        ids, points = ids[turn], points[turn]
        if len(ids) > k:
            later = np.concatenate([np.zeros(k, dtype=bool), (points[k:] == points[:-k]).all(1)])
            ids, points = ids[~later], points[~later]
        self.k, (order, self.cuts, _) = k, ordered(points, max(24, 2 * k))
        self.ids, self.points = ids[order], points[order]
        self.boxes = upwards(np.minimum.reduceat(self.points, self.cuts[:-1]), np.maximum.reduceat(self.points, self.cuts[:-1]))
        self.width = int(np.diff(self.cuts).max())

    def distances(self, q: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the leaf's points and their squared distances, one row for each q; infinite past the leaf's end."""
        at = self.cuts[leaf][:, None] + np.arange(self.width)
        over = at >= self.cuts[leaf + 1][:, None]
        at[over] = 0
        d2 = squares([q[:, c][:, None] - self.points[:, c][at] for c in range(q.shape[1])])
        d2[over] = np.inf
        return at, d2

    def search(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many each point has, and their ids and squared distances in order: the k nearest within the bounds, ties by id."""
        parts = [self._search(q[s : s + 4096], bound[s : s + 4096]) for s in range(0, len(q), 4096)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _search(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = np.zeros(len(q), dtype=np.int64)
        for low, high in self.boxes[1:]:
            node = 2 * node
            node = node + (gaps(q, low[node + 1], high[node + 1]) < gaps(q, low[node], high[node]))
        if self.width >= self.k:
            bound = np.minimum(bound, np.partition(self.distances(q, node)[1], self.k - 1, axis=1)[:, self.k - 1])
        pairs = reached(self.boxes, q, bound)
        if pairs is None or len(q) > 1 and len(pairs[0]) * self.width > PAIRS:
            h = len(q) // 2
            return tuple(np.concatenate(x) for x in zip(self._search(q[:h], bound[:h]), self._search(q[h:], bound[h:]), strict=True))
        t, leaf = pairs
        at, d2 = self.distances(q[t], leaf)
        keep = np.isfinite(d2) & (d2 <= bound[t][:, None])
        t, ids, d2 = np.broadcast_to(t[:, None], d2.shape)[keep], self.ids[at[keep]], d2[keep]
        turn = np.lexsort((ids, d2, t))
        t, ids, d2 = t[turn], ids[turn], d2[turn]
        n = np.bincount(t, minlength=len(q))
        keep = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) < self.k
        return np.minimum(n, self.k), ids[keep], d2[keep]


def lists(n: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def columns(t: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in names], 1).astype(float)


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the data: by a shuffle, whatever Spark takes their size for."""
    return left.join(right.hint("merge"), on, how)


def by_block(targets: DataFrame, sources: DataFrame, visits: dict[int, int], search, schema: str) -> DataFrame:
    """``search`` on the targets and sources of each block; targets, and copies of the block's sources, are dealt into pieces. visits: targets by block."""
    pieces = {b: -(-n // PIECE) for b, n in visits.items()}
    count = F.get(F.lit([pieces.get(b, 0) for b in range(max(pieces) + 1)]), F.col("block"))
    t = targets.withColumn("piece", F.pmod(F.hash("trg_id"), count))
    s = sources.where(count > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    n = sum(pieces.values())
    deal = lambda df: df.repartition(n, "block", "piece").groupBy("block", "piece")
    return deal(t).cogroup(deal(s)).applyInArrow(search, schema)


def nearest_in_blocks(trg: DataFrame, src: DataFrame, k: int, dims: tuple[str, ...], n: int, store) -> DataFrame:
    """trg_id, rank, src_id, d2 for points without missing coordinates; n counts the sources, ``store`` cuts a lineage.

    A target is searched in the block whose side of the cuts it is on, which bounds how far its k-th neighbour is; then in the
    other blocks whose boxes are within that. So a target looks at few blocks, however far it is from all sources.
    """
    names = list(dims)
    tid, sid = (df.schema[c].dataType.simpleString() for df, c in ((trg, "trg_id"), (src, "src_id")))
    depth = max(0, int(np.ceil(np.log2(n / BLOCK))))
    splits: list[tuple[np.ndarray, np.ndarray]] = []
    if depth:
        drawn = columns(src.select(*names).sample(min(1.0, DRAWN * 2**depth / n), seed=1).toArrow(), names)
        splits = ordered(drawn, -(-len(drawn) // 2**depth))[2]

    @F.pandas_udf("int")
    def side(*values: pd.Series) -> pd.Series:
        return pd.Series(placed(np.stack([v.to_numpy(float) for v in values], 1), splits))

    block: Column = side(*names) if splits else F.lit(0)
    src, trg = src.withColumn("block", block), trg.withColumn("block", block)
    ends = [f(c).alias(f"{a}_{c}") for c in names for a, f in (("low", F.min), ("high", F.max))]
    held = src.groupBy("block").agg(F.count("*").alias("n"), *ends).collect()
    if max(r["n"] for r in held) > 4 * BLOCK:  # many at one place, which no cut parts
        src = src.withColumn("__k", F.row_number().over(Window.partitionBy(*names).orderBy("src_id"))).where(F.col("__k") <= k).drop("__k")
        held = src.groupBy("block").agg(F.count("*").alias("n"), *ends).collect()
    low, high, size = np.full((2 ** len(splits), len(names)), np.inf), np.full((2 ** len(splits), len(names)), -np.inf), np.zeros(2 ** len(splits), dtype=np.int64)
    for r in held:
        size[r["block"]], low[r["block"]], high[r["block"]] = r["n"], [r[f"low_{c}"] for c in names], [r[f"high_{c}"] for c in names]
    boxes, full = upwards(low, high), np.flatnonzero(size)

    def enough(q: np.ndarray) -> np.ndarray:
        """A squared distance within which the boxes have k sources."""
        out = np.full(len(q), np.inf)
        for i in range(0, len(q), 512):
            p = q[i : i + 512]
            far = squares([np.maximum(np.abs(p[:, c][:, None] - low[full, c]), np.abs(p[:, c][:, None] - high[full, c])) for c in range(len(names))])
            turn = far.argsort(1)
            sums = size[full][turn].cumsum(1)
            out[i : i + 512] = np.where(sums[:, -1] >= k, np.take_along_axis(far, np.take_along_axis(turn, (sums >= k).argmax(1)[:, None], 1), 1)[:, 0], np.inf)
        return out

    def others(q: np.ndarray, bound: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = reached(boxes, q, bound)
        if pairs is None:
            h = len(q) // 2
            return tuple(np.concatenate(x) for x in zip(others(q[:h], bound[:h], own), others(q[h:], bound[h:], own), strict=True))
        t, b = (x[pairs[1] != own] for x in pairs)
        return np.bincount(t, minlength=len(q)), b[np.argsort(t, kind="stable")]

    def home(t: pa.Table, s: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c: pa.array([], kind) for c, kind in (("trg_id", t.schema.field("trg_id").type), *[(c, pa.float64()) for c in names], ("bound", pa.float64()), ("ids", pa.list_(s.schema.field("src_id").type)), ("d2s", pa.list_(pa.float64())), ("others", pa.list_(pa.int32())))})
        q, bound = columns(t, names), np.full(t.num_rows, np.inf)
        n, ids, d2 = np.zeros(len(q), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if s.num_rows:
            n, ids, d2 = Tree(s.column("src_id").to_numpy(), columns(s, names), k).search(q, bound)
        bound[n == k] = d2[np.cumsum(n)[n == k] - 1]
        if len(full) > 1:
            bound[n < k] = enough(q[n < k])
            m, b = others(q, bound, t.column("block")[0].as_py())
        else:
            m, b = np.zeros(len(q), dtype=np.int64), np.zeros(0, dtype=np.int32)
        return pa.table({"trg_id": t.column("trg_id"), **{c: q[:, i] for i, c in enumerate(names)}, "bound": bound, "ids": lists(n, ids).cast(pa.list_(s.schema.field("src_id").type)), "d2s": lists(n, d2), "others": lists(m, b.astype(np.int32))})

    def away(t: pa.Table, s: pa.Table) -> pa.Table:
        n, ids, d2 = np.zeros(t.num_rows, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if t.num_rows and s.num_rows:
            n, ids, d2 = Tree(s.column("src_id").to_numpy(), columns(s, names), k).search(columns(t, names), t.column("bound").to_numpy())
        return pa.table({"trg_id": t.column("trg_id"), "ids": lists(n, ids).cast(pa.list_(s.schema.field("src_id").type)), "d2s": lists(n, d2)})

    spread = lambda df: df.select("trg_id", F.posexplode(F.arrays_zip("ids", "d2s")).alias("p", "c")).select("trg_id", (F.col("p") + 1).alias("rank"), F.col("c.ids").alias("src_id"), F.col("c.d2s").alias("d2"))
    visits = {r["block"]: r["n"] for r in trg.groupBy("block").agg(F.count("*").alias("n")).collect()}
    found = by_block(trg, src, visits, home, f"trg_id {tid}, {', '.join(f'{c} double' for c in names)}, bound double, ids array<{sid}>, d2s array<double>, others array<int>")
    if len(full) < 2 and set(visits) <= set(full.tolist()):
        return spread(found)
    found = store(found)
    more = found.where("size(others) > 0")
    there = more.select("trg_id", *names, "bound", F.explode("others").alias("block"))
    visits = {r["block"]: r["n"] for r in there.groupBy("block").agg(F.count("*").alias("n")).collect()}
    if not visits:
        return spread(found)
    also = by_block(there, src, visits, away, f"trg_id {tid}, ids array<{sid}>, d2s array<double>")
    both = spread(more).unionByName(spread(also)).withColumn("rank", F.row_number().over(Window.partitionBy("trg_id").orderBy("d2", "src_id"))).where(F.col("rank") <= k)
    return spread(found.where("size(others) = 0")).unionByName(both)
