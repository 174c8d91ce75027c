"""Near-duplicates: an inverted join on MinHash signature coordinates, confirmed on full shingle sets.

1. Each document's shingle set gives a signature of COORDINATES minima. Documents with the same set become one (its smallest id).
2. A set is posted under the (coordinate, value) pairs of its first PREFIX coordinates. A pair of sets with a similarity of 0.75
   or more shares none of them with a probability of 4e-9; the later coordinates are skipped when posting.
3. First round: in each list, sets go to the first leader that is near; these pairs, at most one for each posting, are confirmed on
   the full sets, and links merge into components. So copies of one text never become all their pairs.
4. Second round: in each list that still holds several components, collisions are counted for the pairs across components, and
   those with `least` coordinates in common (more than four standard deviations below 0.75) are candidates. A prefix filter leaves out what
   can't be one: with a set's coordinates in the order of their frequency in the list, any two that agree in `least` places share one of
   the COORDINATES - least + 1 rarest. A pair belongs to the list of its first common coordinate and is skipped in the others. Only the sets
   with a candidate send their texts to the list's task, which confirms on full sets and returns no pairs but the links that join two
   components there (a forest, so fewer rows than sets). No pair of different components with `least` matches stays untried.

A list whose sets or shingles are beyond most_list or most_shingles doesn't meet in one task. Its sets are posted anew under each of
their rarest coordinates that others of the list have too, which by the same prefix filter keeps every candidate; what is still too long
is cut into blocks, and each pair of blocks is a task. Results don't depend on these sizes.

Nulls: a null or empty text has an empty set and no links. A null doc_id has no links and no component (kept). Rows that share a
doc_id are linked if their sets are. Very long texts are read whole. Ties keep the smallest id. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, buffers, mix, settled, slices, trim, window_hashes, word_hashes, words, written
from .components import components

WORDS = 5
COORDINATES, PREFIX = 128, 14
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
PRINTS = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>, sig binary, print bigint"
PRINT_ROWS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary()), ("print", pa.int64())])
PAIRS = "a bigint, b bigint"
PAIR_ROWS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles."""
    data, offs = buffers(texts)
    s, e, ptr = words(data, offs)
    h = word_hashes(data, s, e, lower=True)
    w, out = window_hashes(h, WORDS), []
    for a, b in zip(ptr[:-1], ptr[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(w[a : b - WORDS + 1]))
        else:
            out.append(window_hashes(np.concatenate((h[a:b], np.full(WORDS - (b - a), b - a, U))), WORDS) if b > a else np.zeros(0, U))
    return out


def signature(x: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, ((x[at : at + 4096, None] * _FACTORS) >> U(32)).min(0).astype(np.uint32), out=out)
    return out


def prints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(PREFIX, dtype=U) << U(32)
        for b in slices(batches):
            rows = []
            for doc_id, own, x in zip(b.column("doc_id").to_pylist(), b.column("print").to_pylist(), shingle_sets(b.column("text")), strict=True):
                if len(x):
                    s = signature(x)
                    keys = (s[:PREFIX].astype(U) | place).astype(np.int64)
                    rows.append((doc_id, len(x), int(x.sum().astype(np.int64)), int(mix(x).sum().astype(np.int64)), keys, s.tobytes(), own))
                else:
                    rows.append((doc_id, 0, 0, 0, [], b"", own))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PRINT_ROWS.types, strict=True)], schema=PRINT_ROWS)
        trim()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(run, PRINTS)


def posted(sets: DataFrame, most_list: int, most_shingles: int) -> DataFrame:
    """key, coord, set_id, parts, sig: the posting lists of two sets and more; parts: how many tasks' worth of sets they hold."""
    one = sets.select("set_id", "n_shingles", F.explode("keys").alias("key"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / most_list), F.ceil(F.sum("n_shingles") / most_shingles)).cast("int")
    sizes = one.groupBy("key").agg(F.count(F.lit(1)).alias("size"), parts.alias("parts")).where("size > 1").drop("size")
    one = one.select("set_id", "key").join(sizes, "key")
    return one.select("key", F.shiftright("key", 32).cast("int").alias("coord"), "set_id", "parts").join(sets.select("set_id", "n_shingles", "sig"), "set_id")


def signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint32).reshape(-1, COORDINATES)


def groups(table: pa.Table, key: str) -> list[np.ndarray]:
    """Row numbers by key, in the order of set_id."""
    k = table.column(key).to_numpy()
    order = np.lexsort((table.column("set_id").to_numpy(), k))
    return np.split(order, np.flatnonzero(np.diff(k[order])) + 1) if len(order) else []


def led(lists: DataFrame, buckets: int, near: int) -> DataFrame:
    """a, b: members of a list and a leader that is near. A list's parts have leaders of their own."""

    def run(table: pa.Table) -> pa.Table:
        ids, sig = table.column("set_id").to_numpy(), signatures(table.column("sig"))
        found = [np.zeros((0, 2), np.int64)]
        for left in groups(table, "unit"):
            for _ in range(64):  # what is left by then waits for the second round
                if len(left) < 2:
                    break
                ok = (sig[left[1:]] == sig[left[0]]).sum(1) >= near
                found.append(np.stack((np.full(ok.sum(), ids[left[0]]), ids[left[1:][ok]]), 1))
                left = left[1:][~ok]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=PAIR_ROWS)

    unit = F.xxhash64("key", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    rows = lists.select(unit.alias("unit"), "set_id", "sig")
    return rows.groupBy(F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(buckets)).alias("bucket")).applyInArrow(run, PAIRS).distinct()


def active(sig: np.ndarray, least: int) -> np.ndarray:
    """Which sets share one of their rarest coordinates with another one of the list."""
    keep = COORDINATES - least + 1
    freq = np.empty(sig.shape, np.int32)
    for c in range(COORDINATES):
        _, inv, n = np.unique(sig[:, c], return_inverse=True, return_counts=True)
        freq[:, c] = n[inv]
    return np.partition(freq, keep - 1, axis=1)[:, keep - 1] > 1


def across(sig: np.ndarray, comp: np.ndarray, side: np.ndarray, coord: int, least: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components with enough matches, for which coord is the first common coordinate. side: where two blocks
    meet, 0 and 1, and only pairs of both count; else 0."""
    if len(comp) < 2 or (comp == comp[0]).all():
        return
    at = np.flatnonzero(active(sig, least))
    if len(at) < 2:
        return
    _, inv, size = np.unique(comp[at], return_inverse=True, return_counts=True)
    small = at[inv != size.argmax()]  # each pair has a set outside the largest component
    rank = np.full(len(comp), -1)
    rank[small] = np.arange(len(small))
    two = side.any() and not side.all()
    half = COORDINATES // 2
    low = (sig & 255).astype(np.uint8)  # compared first: what agrees in fewer lowest bytes can't agree in enough numbers
    for k in range(0, len(small), step):
        a = small[k : k + step]
        for j in range(0, len(at), 4096):
            b = at[j : j + 4096]
            ok = (comp[a][:, None] != comp[b]) & ((rank[b] < 0)[None, :] | (rank[a][:, None] < rank[b]))
            if two:
                ok &= side[a][:, None] != side[b]
            p, q, seen = np.ascontiguousarray(low[a].T), np.ascontiguousarray(low[b].T), np.zeros((len(a), len(b)), np.uint8)
            for c in range(COORDINATES):
                if c == half and not (ok & (seen >= max(0, least - half))).any():
                    break
                seen += p[c][:, None] == q[c]
            x, y = np.nonzero((seen >= least) & ok)
            for j in range(0, len(x), 100_000):
                u, v = a[x[j : j + 100_000]], b[y[j : j + 100_000]]
                same = sig[u] == sig[v]
                fine = (same.sum(1) >= least) & ~same[:, :coord].any(1)
                if fine.any():
                    yield u[fine], v[fine]


def units(lists: DataFrame, most_list: int, most_shingles: int, least: int) -> DataFrame:
    """unit, coord, side, set_id, component, sig, n_shingles: the lists of several components, in groups that a task can hold."""
    open_ = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    lists = lists.join(open_, "key")
    cols = ["coord", "set_id", "component", "sig", "n_shingles"]
    small = lists.where("parts = 1").select(F.col("key").alias("unit"), F.lit(0).alias("side"), *cols)
    long = lists.where("parts > 1")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000)):
                token = signatures(part.column("sig")).astype(np.int64) | (np.arange(COORDINATES) << 32)
                row = pa.array(np.repeat(np.arange(part.num_rows), COORDINATES))
                yield pa.RecordBatch.from_arrays([part.column("key").take(row), part.column("set_id").take(row), pa.array(token.ravel())], names=["key", "set_id", "token"])

    tokens = long.select("key", "set_id", "sig").mapInArrow(spread, "key bigint, set_id bigint, token bigint")
    often = tokens.groupBy("key", "token").agg(F.count(F.lit(1)).alias("n"))
    rare = tokens.join(often, ["key", "token"]).groupBy("key", "set_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, COORDINATES - least + 1).alias("rare"))
    rare = rare.select("key", "set_id", F.explode(F.filter("rare", lambda x: x["n"] > 1)).alias("x")).select("key", "set_id", F.xxhash64("key", "x.token").alias("list"))
    again = rare.join(long, ["key", "set_id"])
    parts = F.greatest(F.ceil(F.count(F.lit(1)) * 2 / most_list), F.ceil(F.sum("n_shingles") * 2 / most_shingles)).cast("int")
    sizes = again.groupBy("list").agg(parts.alias("blocks"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = sizes.where("lo < hi").select("list", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")).alias("blocks"))
    again = again.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(5)), F.col("blocks")).cast("int"))
    again = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))
    return small.unionByName(again.select(unit.alias("unit"), (F.col("own") > F.col("other")).cast("int").alias("side"), *cols))


def joined(rows: DataFrame, texts: DataFrame, least: int, most_broadcast: int) -> DataFrame:
    """a, b: confirmed links between components, for each unit a forest. rows: a written table of units()."""

    def members(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        sig, comp, side, coord = signatures(table.column("sig")), *(table.column(c).to_numpy() for c in ("component", "side", "coord"))
        return [(m, sig[m], comp[m], side[m], int(coord[m[0]])) for m in groups(table, "unit")]

    def asked(table: pa.Table) -> pa.Table:
        need = np.zeros(table.num_rows, bool)
        for m, *unit in members(table):
            for a, b in across(*unit, least):
                need[m[a]] = need[m[b]] = True
        return table.select(["unit", "set_id", "component", "side", "coord", "sig", "n_shingles"]).filter(pa.array(need))

    def confirm(table: pa.Table) -> pa.Table:
        ids, sets, out = table.column("set_id").to_numpy(), [], []
        for b in slices(table.to_batches()):
            sets += shingle_sets(b.column("text"))
        for m, *unit in members(table):
            own = [sets[k] for k in m]
            size = np.array([len(x) for x in own])
            _, flat = np.unique(np.concatenate(own), return_inverse=True)  # shingles by number
            end = np.cumsum(size)
            kinds, root = np.unique(unit[1], return_inverse=True)
            up = np.arange(len(kinds))

            def find(x: int, up: np.ndarray = up) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            mark = np.zeros(int(flat.max()) + 1, bool)
            for a, b in across(*unit, least):
                for x in np.unique(a):
                    y = b[a == x]
                    here = find(root[x])
                    tops = np.array([find(r) for r in root[y]])
                    y = y[(tops != here) & (100 * np.minimum(size[y], size[x]) >= 75 * np.maximum(size[y], size[x]))]
                    if not len(y):
                        continue
                    mine = flat[end[x] - size[x] : end[x]]
                    mark[mine] = True
                    at = np.cumsum(size[y]) - size[y]
                    all_ = np.arange(int(size[y].sum())) + np.repeat(end[y] - size[y] - at, size[y])
                    both = np.add.reduceat(mark[flat[all_]].astype(np.int64), at)
                    mark[mine] = False
                    for z in y[100 * both >= 75 * (size[x] + size[y] - both)]:
                        u, v = find(root[x]), find(root[z])
                        if u != v:
                            up[v] = u
                            out.append((int(ids[m[x]]), int(ids[m[z]])))
            own = flat = mark = None
        sets = None
        trim()
        return pa.Table.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=PAIR_ROWS)

    spark = rows.sparkSession
    kinds = "unit bigint, set_id bigint, component bigint, side int, coord int, sig binary, n_shingles bigint"
    buckets = int((rows.agg(F.count(F.lit(1))).first()[0] or 0) // 4_000) + 16
    need = rows.groupBy(F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(buckets)).alias("bucket")).applyInArrow(asked, kinds)
    need = written(need, spark, "asked")
    n, total = need.agg(F.countDistinct("set_id"), F.sum("n_shingles")).first()
    found = texts_of(need.select("set_id").distinct(), n, texts, most_broadcast)
    buckets = int((total or 0) // 1_500_000) + 16
    rows = need.join(found, "set_id").withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit(2)), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(confirm, PAIRS)


def texts_of(ids: DataFrame, n: int, texts: DataFrame, most_broadcast: int) -> DataFrame:
    """set_id, text of the n ids: a written table."""
    return written(texts.join(F.broadcast(ids) if n <= most_broadcast else ids, "set_id", "left_semi"), ids.sparkSession, "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, most_broadcast: int) -> DataFrame:
    """a, b, linked: whether 100 * intersection >= 75 * union, on the full sets. pairs is a written table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    need = texts_of(ids, ids.count(), texts, most_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ta", 1 << 20):
            memo: dict[int, np.ndarray] = {}
            for ids, texts in ((b.column("a"), b.column("ta")), (b.column("b"), b.column("tb"))):
                ids = ids.to_numpy()
                _, first = np.unique(ids, return_index=True)
                first = first[[int(ids[k]) not in memo for k in first]]
                memo |= dict(zip(ids[first].tolist(), shingle_sets(texts.take(pa.array(first))), strict=True))
            out = []
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                p, q = memo[x], memo[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= 75 * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    out = pairs.select("a", "b").join(need.select(F.col("set_id").alias("b"), F.col("text").alias("tb")), "b").join(need.select(F.col("set_id").alias("a"), F.col("text").alias("ta")), "a")
    return out.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, linked boolean")


def near_duplicates(docs: DataFrame, near: int = 90, least: int = 75, most_list: int = 4096, most_shingles: int = 4_000_000, most_broadcast: int = 2_000_000, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. near, least: matching coordinates, of COORDINATES.

    by_text: also print, xxhash64 of the text, which tells rows apart that share a doc_id.
    """
    return settled(lambda: _near_duplicates(docs, near, least, most_list, most_shingles, most_broadcast, by_text), docs.sparkSession, "near")


def _near_duplicates(docs: DataFrame, near: int, least: int, most_list: int, most_shingles: int, most_broadcast: int, by_text: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = written(prints(docs), spark, "prints")
    full = own.where("n_shingles > 0 and doc_id is not null")
    repeated = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    # rows may share a doc_id, which then can't stand for one set
    set_id = F.xxhash64("n_shingles", "d1", "d2") if repeated else F.col("low")
    sets = full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    sets = written(sets.withColumn("set_id", set_id), spark, "sets")
    lists = written(posted(sets, most_list, most_shingles), spark, "lists")
    texts = _texts_of_sets(docs, sets) if repeated else docs.withColumnRenamed("doc_id", "set_id")
    pairs = written(led(lists, max(16, lists.count() // 20_000), near), spark, "pairs")
    links = written(confirmed(pairs, texts, most_broadcast), spark, "confirmed").where("linked").select("a", "b")
    comp = components(links)
    now = lists.join(comp.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    more = joined(written(units(now, most_list, most_shingles, least), spark, "units"), texts, least, most_broadcast)
    comp = components(written(links.unionByName(more), spark, "linked"))
    named = sets.select("n_shingles", "d1", "d2", "set_id", "low")
    named = named.join(comp.withColumnRenamed("node", "set_id"), "set_id", "left").select("n_shingles", "d1", "d2", "low", F.coalesce("component", "set_id").alias("component"))
    if repeated:  # a component goes by its smallest doc_id
        lows = named.groupBy("component").agg(F.min("low").alias("smallest"))
        named = named.join(lows, "component").withColumn("component", F.col("smallest"))
    named = named.select("n_shingles", "d1", "d2", "component")
    out = own.select("doc_id", "n_shingles", "d1", "d2", "print").join(named, ["n_shingles", "d1", "d2"], "left")
    whole = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), "print").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), *["print"] * by_text)


def _texts_of_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id, text where doc_ids repeat: of the rows with that very set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = shingle_sets(b.column("text"))
            sums = [pa.array([int(f(v).sum().astype(np.int64)) if len(v) else 0 for v in x], pa.int64()) for f in (lambda v: v, mix)]
            yield pa.RecordBatch.from_arrays([b.column("text"), pa.array([len(v) for v in x], pa.int64()), *sums], names=["text", "n_shingles", "d1", "d2"])

    key = ["n_shingles", "d1", "d2"]
    rows = docs.mapInArrow(run, "text string, n_shingles bigint, d1 bigint, d2 bigint").where("n_shingles > 0")
    return rows.groupBy(key).agg(F.min("text").alias("text")).join(sets.select("set_id", *key), key).select("set_id", "text")
