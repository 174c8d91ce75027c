"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, by k-means fitted on a bounded sample; a cell is a pair of centroids. The centroids of a
half number the square root of the table's rows, so there are about as many cells as rows, until `centroids` caps them. A query
walks the cells in the order of summed squared distance with a heap until they hold `wanted` entries; all entries up to that distance are
reranked by the exact Euclidean distance of the original vectors, in double precision. Every vector is indexed.

wanted comes from a calibration on the table itself: the true neighbours of `probes` evenly hashed rows are found among all rows (one
pass with these few vectors, partial best lists for each task), and wanted is the number of entries before and with their cells that
covers `recall` of them. Clustered vectors thus cost a few cells; vectors without structure cost a large share of the table whatever the index.

Entries lie by their first centroid. A query goes once to each first centroid that it visits, with its distance bound, and looks there
into the second centroids within the bound. First centroids with more than most_entries entries are salted, and those
with more than most_queries questions copy their entries for each batch of questions, so no task holds more than both.
Ties go to the smaller vec_id.

Bounds (parameters): most sampled vectors, probes, centroids for each half. Sizes by cell (centroids squared at most) and by first
centroid go to the driver, and so do the probes' neighbours.
Left out, as queries and as candidates: vectors that are null or zero, hold null or non-finite components, or have another
length than most sampled ones. A null vec_id takes no part either. Repeated vec_ids are candidates each; a query's own rows (same vec_id) are
not. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

RESULT = "query_id bigint, vec_id bigint, score double"


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.where(F.coalesce(fine, F.lit(False)))


def kmeans(x: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    r = np.random.default_rng(1)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        of = nearest(x, c)
        for j in range(len(c)):
            if (of == j).any():
                c[j] = x[of == j].mean(0)
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[k : k + 4096], c).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def walk(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[float, int]]:
    """Summed distance and cell, by summed distance: a heap over the rows of two sorted lists, each at its next column."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, first, second = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    n, heap = len(b), [(a[0] + b[0], 0, 0)]
    while heap:
        at, i, j = heap[0]
        yield at, first[i] * n + second[j]
        if j + 1 < n:
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


class Index:
    def __init__(self, sample: np.ndarray, total: int, centroids: int):
        self.half = max(1, sample.shape[1] // 2)
        per = max(1, min(centroids, int(round(total**0.5)), len(sample)))
        self.c1, self.c2 = kmeans(sample[:, : self.half], per), kmeans(sample[:, self.half :], per if sample.shape[1] > 1 else 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.c1) * len(self.c2) + nearest(x[:, self.half :], self.c2)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(x[:, : self.half], self.c1), squares(x[:, self.half :], self.c2)

    def bound(self, d1: np.ndarray, d2: np.ndarray, sizes: list[int], wanted: float) -> float:
        """The summed distance up to which the cells hold so many entries."""
        got, at = 0, 0.0
        for at, cell in walk(d1, d2):
            got += sizes[cell]
            if got >= wanted:
                break
        return at


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, dim)


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest, ties to the smaller id. x is in the order of ids."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    d[ids == own] = np.inf
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        near = np.arange(len(d))
    near = near[np.argsort(d[near], kind="stable")][:k]
    near = near[d[near] < np.inf]
    return near, d[near]


def calibrated(stored: DataFrame, index: Index, probes: list, sizes: np.ndarray, k: int, recall: float, dim: int) -> float:
    """The number of entries that holds so much of the probes' true neighbours."""
    ids, x = [p[0] for p in probes], np.array([p[1] for p in probes], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in ids]
        for b in batches:
            v, own, cell = vectors_of(b.column("v"), dim), b.column("vec_id").to_numpy(), b.column("cell").to_numpy()
            order = np.argsort(own, kind="stable")
            v, own, cell = v[order], own[order], cell[order]
            for i, q in enumerate(x if len(v) else ()):
                near, d = best(v, own, q, ids[i], k)
                held[i] = sorted([*held[i], *zip(d.tolist(), own[near].tolist(), cell[near].tolist(), strict=True)])[:k]
        rows = [(i, *r) for i, h in enumerate(held) for r in h]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int32()))], names=["probe", "score", "vec_id", "cell"])

    near = stored.mapInArrow(run, "probe int, score double, vec_id bigint, cell int")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", "vec_id"))
    need = []
    d1, d2 = index.distances(x)
    found: dict[int, list[int]] = {}
    for r in near.withColumn("rank", rank).where(F.col("rank") <= k).select("probe", "cell").collect():  # probes x k
        found.setdefault(r.probe, []).append(r.cell)
    for i, cells in found.items():
        flat = (d1[i][:, None] + d2[i]).ravel()
        need += [int(sizes[flat <= flat[c]].sum()) for c in cells]
    return float(np.quantile(need, recall)) * 1.05 + k if need else float(k)


def search(vectors: DataFrame, queries: Column, k: int = 10, vector: str = "embedding", most: int = 8000, probes: int = 100, centroids: int = 512, recall: float = 0.95, most_entries: int = 20_000, most_queries: int = 5_000) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors that the condition chooses, its k nearest other rows, nearest first."""
    spark = vectors.sparkSession
    ok = usable(vectors, vector)
    dims = ok.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, total = dims.d, dims.n
    ok = ok.where(F.size("v") == dim)
    u = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30))
    rows = ok.where(u <= int(min(1.0, 1.2 * most / total) * (1 << 30))).orderBy(u, "vec_id").limit(most).toArrow()
    if not rows.num_rows:
        rows = ok.limit(most).toArrow()
    sample = np.array(rows.column("v").to_pylist(), float)
    index = Index(sample, total, centroids)
    shared = spark.sparkContext.broadcast(index)  # at most 2 x centroids half vectors

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors_of(b.column("v"), dim)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(shared.value.cells(x) if len(x) else [], pa.int32())], names=["vec_id", "v", "cell"])

    stored = written(ok.mapInArrow(entries, "vec_id bigint, v array<double>, cell int"), spark, "entries")
    counted = {r.cell: r.n for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most centroids squared
    sizes = np.zeros(len(index.c1) * len(index.c2), int)
    sizes[list(counted)] = list(counted.values())
    chosen = list(zip(rows.column("vec_id").to_pylist(), rows.column("v").to_pylist(), strict=True))[:probes]
    wanted = calibrated(stored, index, chosen, sizes, k, recall, dim)
    limits = spark.sparkContext.broadcast((sizes.tolist(), wanted))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 64) for at in range(0, b.num_rows, 64)):
                d1, d2 = shared.value.distances(vectors_of(part.column("v"), dim))
                far = [shared.value.bound(x, y, *limits.value) for x, y in zip(d1, d2, strict=True)]
                left = np.array(far)[:, None] * (1 + 1e-12) + 1e-12 - d1  # the cell at the bound itself stays in
                row, c1 = np.nonzero(left >= d2.min(1)[:, None])
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row)), pa.array(c1, pa.int32()), pa.array(left[row, c1])], names=["vec_id", "v", "first", "bound"])

    questions = written(ok.where(queries).mapInArrow(asked, "vec_id bigint, v array<double>, first int, bound double"), spark, "questions")
    stored = stored.withColumn("first", F.floor(F.col("cell") / len(index.c2)).cast("int"))
    spread = stored.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / most_entries).cast("int").alias("parts"))
    spread = spread.join(questions.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / most_queries).cast("int").alias("turns")), "first")
    spread = F.broadcast(_few(spark, spread))
    salt, turn = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("parts")).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("turns")).cast("int")
    mine = stored.join(spread, "first").select("first", "vec_id", "v", "cell", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    theirs = questions.join(spread, "first").select("first", "vec_id", "v", "bound", turn.alias("turn"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))

    def rank(own: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and queries.num_rows:
            second = own.column("cell").to_numpy() % len(shared.value.c2)
            ids = own.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids, second = vectors_of(own.column("v").combine_chunks(), dim)[order], ids[order], second[order]
            q, asks = vectors_of(queries.column("v").combine_chunks(), dim), queries.column("vec_id").to_numpy()
            bound = queries.column("bound").to_numpy()
            for at in range(0, len(q), 256):
                near = shared.value.distances(q[at : at + 256])[1] <= bound[at : at + 256, None]
                for i, inside in enumerate(near, at):
                    here = np.flatnonzero(inside[second])
                    if len(here):
                        got, d = best(x[here], ids[here], q[i], asks[i], k)
                        out.append((np.full(len(got), asks[i]), ids[here[got]], d))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        return pa.Table.from_arrays([pa.array(p, t) for p, t in zip(parts, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    by = ["first", "salt", "turn"]
    found = mine.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(rank, RESULT)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _few(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """At most centroids rows, as a table of their own."""
    return spark.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)
