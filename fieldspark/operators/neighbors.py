"""Spatial search: range joins on a grid, nearest neighbours, and the ordered distance filter.

Catalyst plans a distance predicate as a nested loop; here both sides get grid cells of the search radius, so the join is an
equi-join on cells, followed by the exact predicate. No side is broadcast, however small Spark takes it to be (a merge join is asked for).
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..geometry import axes
from ..plans.tables import written

LEAST_DISTANCE = 1.0842021724855044e-19
LEAF = 64  # points of a leaf
TILE = 1_000_000  # distances at once


def squared(a: str, b: str, on: list[str]) -> Column:
    return sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in on), F.lit(0.0))


def range_join(a: DataFrame, b: DataFrame, radius: float, on: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Pairs (a.id as id, b.id as other, distance) within the radius, both ends included. carry: columns of either side that the
    pairs keep, with a and b before their names, so that pairs needn't be joined back to the points."""
    on = on or axes(a)
    if radius < 0:
        raise ValueError("the radius must not be negative")
    size, carry = radius if radius > 0 else 1.0, carry or []
    more = [c for c in carry if c not in on]
    left = a.select("id", *(F.col(c).cast("double").alias(c) for c in on), *more).dropna(subset=["id", *on])
    right = b.select("id", *(F.col(c).cast("double").alias(c) for c in on), *more).dropna(subset=["id", *on])
    cell = [F.floor(F.col(c) / size) for c in on]
    right = right.withColumn("cell", F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cell))))
    steps = F.array(*(F.struct(*((cell[i] + s).alias(f"c{i}") for i, s in enumerate(d))) for d in product((-1, 0, 1), repeat=len(on))))
    left = left.withColumn("cell", F.explode(steps))
    out = left.alias("a").join(right.hint("merge").alias("b"), F.col("a.cell") == F.col("b.cell")).withColumn("distance", F.sqrt(squared("a", "b", on)))
    kept = [F.col(f"{s}.{c}").alias(s + c) for s in "ab" for c in carry]
    return out.where(F.col("distance") <= radius).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), "distance", *kept)


def knn_join(a: DataFrame, b: DataFrame, k: int, on: list[str] | None = None, radius: float | None = None) -> DataFrame:
    """For each a its k nearest rows of b: id, rank, other, distance; ties go to the smaller id.

    The radius starts at the spacing of b and doubles for the rows that don't have k neighbours yet.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    on = on or axes(a)
    b = b.select("id", *(F.col(c).cast("double").alias(c) for c in on)).dropna()
    a = a.select("id", *(F.col(c).cast("double").alias(c) for c in on)).dropna()
    s = b.agg(F.count(F.lit(1)), *(F.min(c) for c in on), *(F.max(c) for c in on)).first()
    q = a.agg(*(F.min(c) for c in on), *(F.max(c) for c in on)).first()
    n, d = s[0], len(on)
    schema = "id long, rank int, other long, distance double"
    if not n or q[0] is None:
        return a.sparkSession.createDataFrame([], schema)
    width = np.array(s[1 + d :]) - np.array(s[1 : 1 + d])
    far = float(np.linalg.norm(np.maximum(s[1 + d :], q[d:]) - np.minimum(s[1 : 1 + d], q[:d]))) or 1.0
    wide = width[width > 0]
    r = radius or (float(np.prod(wide) * 2 * min(k, n) / n) ** (1 / len(wide)) if len(wide) else far)
    todo, out, want = a, None, min(k, n)
    w = Window.partitionBy("id").orderBy("distance", "other")
    while True:
        r = min(max(r, far / n / 1e3), far * 1.0000001)
        near = range_join(todo, b, r, on).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        near = written(near.select("id", "rank", "other", "distance"), a.sparkSession)
        full = near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= want).select("id")
        done = near.join(full, "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        todo = written(todo.join(full, "id", "left_anti"), a.sparkSession)
        if todo.isEmpty():
            return out
        r *= 2


def nearest(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    return knn_join(a, b, 1, on).drop("rank")


def pairs_within(points: DataFrame, most: float, on: list[str] | None = None) -> DataFrame:
    """Unordered pairs (id < other) at most so far apart."""
    return range_join(points, points, most, on).where("id < other")


def distance_filter(points: DataFrame, distance: float, order: str = "id", indices: DataFrame | None = None, on: list[str] | None = None, per_block: int = 20_000, most_rounds: int = 1000) -> DataFrame:
    """In the given order, rows that have no earlier kept row within the distance.

    A row is removed once an earlier neighbour is kept, and kept once all of them are removed. Space is cut into blocks of about
    per_block rows; a task follows the order through its whole block as far as other blocks' verdicts are known, so a round
    settles chains of any length inside a block and only chains from block to block take further rounds. The first open row
    of the order is settled in every round; beyond most_rounds an error is raised, never a partial result returned.
    indices: ids that may be kept (all by default); order: an integer column, unique by row. Rows with a null coordinate have no neighbours.
    """
    if distance < LEAST_DISTANCE:
        raise ValueError(f"the distance must be {LEAST_DISTANCE} or more")
    spark, on = points.sparkSession, on or axes(points)
    mine = points if indices is None else points.join(indices.select("id"), "id", "left_semi")
    mine = mine.select("id", F.col(order).cast("long").alias("rank"), *(F.col(c).cast("double").alias(c) for c in on))
    s = mine.agg(F.count(F.lit(1)), *(F.min(c) for c in on), *(F.max(c) for c in on)).first()
    if not s[0] or s[1] is None:
        return points.join(mine.select("id"), "id", "left_semi")
    width = [max(hi - lo, distance) for lo, hi in zip(s[1 : 1 + len(on)], s[1 + len(on) :], strict=True)]
    edge = max(float(np.prod(width) * per_block / s[0]) ** (1 / len(on)), distance)
    mine = mine.withColumn("block", F.xxhash64(*(F.floor(F.col(c) / edge) for c in on)))
    near = range_join(mine, mine, distance, on, ["rank", "block"]).where("brank < arank")
    early = written(near.select(F.col("ablock").alias("block"), "id", F.col("arank").alias("rank"), "other"), spark)
    known = [written(mine.select("id").join(early.select("id").distinct(), "id", "left_anti").select("id", F.lit(True).alias("kept")), spark)]
    for _ in range(most_rounds):
        told = reduce(DataFrame.unionByName, known)
        left = early.join(told.select("id"), "id", "left_anti").join(told.select(F.col("id").alias("other"), "kept"), "other", "left")
        new = written(left.select("block", "id", "rank", "other", "kept").groupBy("block").applyInArrow(_settle, "id long, kept boolean"), spark)
        if new.isEmpty():
            return points.join(told.where("kept").select("id"), "id", "left_semi")
        known.append(new)
        if len(known) > 20:
            known = [written(reduce(DataFrame.unionByName, known), spark)]
    raise RuntimeError(f"the distance filter did not settle in {most_rounds} rounds; larger blocks (per_block) take fewer")


def _settle(table: pa.Table) -> pa.Table:
    """The verdicts of one block that follow from what is known, in order."""
    ids, other, rank = (table.column(c).to_numpy() for c in ("id", "other", "rank"))
    kept = table.column("kept").to_pylist()
    order, said = np.argsort(rank, kind="stable"), {}
    for rows in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
        near = [said.get(o) if k is None else k for o, k in zip(other[rows].tolist(), (kept[r] for r in rows), strict=True)]
        if True in near:
            said[int(ids[rows[0]])] = False
        elif None not in near:
            said[int(ids[rows[0]])] = True
    return pa.table({"id": pa.array(said.keys(), pa.int64()), "kept": pa.array(said.values(), pa.bool_())})


def unique(points: DataFrame, distance: float = LEAST_DISTANCE, order: str = "id", on: list[str] | None = None) -> DataFrame:
    """Rows apart from each other; exact duplicates alone need no search."""
    on = on or axes(points)
    if distance <= LEAST_DISTANCE:
        first = points.groupBy(*on).agg(F.min(order).alias(order)).select(order)
        return points.join(first, order, "left_semi")
    return distance_filter(points, distance, order, on=on)


def greedy_filter(x: np.ndarray, distance: float) -> np.ndarray:
    """The same over an array in memory: indices kept, in order. A kept row strikes out those near it, so only kept rows search."""
    if not len(x):
        return np.zeros(0, int)
    size = max(distance, 1e-300)
    cell, of = np.unique(np.floor(x / size).astype(np.int64), axis=0, return_inverse=True)
    of = of.ravel()
    rows = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(cell)))[:-1])
    cells = dict(zip(map(tuple, cell.tolist()), rows, strict=True))
    around, names = list(product((-1, 0, 1), repeat=x.shape[1])), cell.tolist()
    struck, out = np.zeros(len(x), bool), []
    for i in range(len(x)):
        if not struck[i]:
            out.append(i)
            for s in around:
                near = cells.get(tuple(a + b for a, b in zip(names[of[i]], s, strict=True)))
                if near is not None:
                    struck[near[((x[near] - x[i]) ** 2).sum(1) <= distance * distance]] = True
    return np.array(out, int)


class Blocks:
    """Points in memory, halved along the longest axis down to leaves; those that aren't finite are left out. Searches are exact; they
    are meant for rows that lie together."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.flatnonzero(np.isfinite(x).all(1))
        low, high, parts, ends, todo = [], [], [], [], [(0, len(self.order), -1, 0)] * bool(len(self.order))
        while todo:
            a, b, above, side = todo.pop()
            i = self.order[a:b]
            if above >= 0:
                parts[above][side] = len(parts)
            low.append(x[i].min(0)), high.append(x[i].max(0)), parts.append([-1, -1]), ends.append((a, b))
            if b - a > LEAF:
                k = (b - a) // 2
                self.order[a:b] = i[np.argpartition(x[i, int((high[-1] - low[-1]).argmax())], k)]
                todo += [(a, a + k, len(parts) - 1, 0), (a + k, b, len(parts) - 1, 1)]
        self.low, self.high, self.parts, self.ends = (np.array(t) for t in (low, high, parts, ends))

    def _within(self, p: np.ndarray, r2: np.ndarray) -> np.ndarray:
        """Points, in order, of the leaves that the box around p, widened by the largest radius, meets."""
        low, high, most = p.min(0), p.max(0), r2.max() * (1 + 1e-9)
        node, leaves = np.zeros(1, int), []
        while len(node):
            gap = np.maximum(np.maximum(self.low[node] - high, low - self.high[node]), 0)
            node = node[(gap * gap).sum(1) <= most]
            end = self.parts[node, 0] < 0
            leaves.append(node[end])
            node = self.parts[node[~end]].ravel()
        found = [self.order[a:b] for a, b in self.ends[np.concatenate(leaves)]]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, int)

    def _squares(self, p: np.ndarray, i: np.ndarray) -> np.ndarray:
        return ((p[:, None] - self.x[i]) ** 2).sum(2)

    def nearest(self, p: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each p the nearest point (ties: the first) and its squared distance, where that is at most r2; else -1 and infinity."""
        i = self._within(p, r2)
        if len(p) > 1 and len(i) * len(p) > TILE:
            halves = [self.nearest(p[h], r2[h]) for h in np.array_split(np.arange(len(p)), 2)]
            return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
        if not len(i):
            return np.full(len(p), -1), np.full(len(p), np.inf)
        d = self._squares(p, i)
        k = d.argmin(1)
        best = d[np.arange(len(p)), k]
        return np.where(best <= r2, i[k], -1), np.where(best <= r2, best, np.inf)

    def reach(self, p: np.ndarray, k: int) -> np.ndarray:
        """For each p the distance to its k-th nearest point."""
        far = max(float(((self.high[0] - self.low[0]) ** 2).sum()), 1e-300)
        r2 = np.full(1, far * (k / len(self.x)) ** 2 * 1e-6)
        while len(i := self._within(p, r2)) < k:
            r2 = r2 * 4
        step = max(1, TILE // len(i))  # the k-th nearest of some points bounds that of all
        bound = np.concatenate([np.partition(self._squares(p[a : a + step], i), k - 1, 1)[:, k - 1] for a in range(0, len(p), step)])
        return self._reach(p, k, bound)

    def _reach(self, p: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
        i = self._within(p, bound)
        if len(p) > 1 and len(i) * len(p) > TILE:
            return np.concatenate([self._reach(p[h], k, bound[h]) for h in np.array_split(np.arange(len(p)), 2)])
        return np.sqrt(np.partition(self._squares(p, i), k - 1, 1)[:, k - 1])
