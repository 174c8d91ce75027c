"""Substring deduplication with a log-structured index of window fingerprints.

Documents come in batches, in the order of doc_id. The index is a set of immutable runs; a run holds, for each bucket of the
hash space, the sorted fingerprints of windows seen before. A batch's windows are sorted the same way and merge-joined with the
runs bucket by bucket, so a window's verdict ("begins earlier somewhere") needs neither document ids nor texts in the index.
A match counts once a second fingerprint, made from the bytes with other parameters, agrees too (64 and 16 bits). New fingerprints become a run;
runs are merged once there are more than max_runs.

Fingerprints travel as blobs: one sorted, compressed array for each (bucket, block), where a block is a range of doc_id with a
bounded amount of text. Each map task drops repeats inside a block first, so a passage that a third of all documents share
reaches a bucket once for each block, and no task collects a key's rows.

Nulls: a null text has no words (n_words 0, kept_text ""). A null doc_id counts as later than any other. Rows that share a
doc_id keep the order of their texts, and are cut into blocks by the beginnings of these. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U, buffers, covered, delete, inside, joined, pack, pack_rows, shared_dir, slices, swept, trim, unpack, unpack_rows, window_hashes, word_hashes, words

LAST = (1 << 63) - 1
#: Bytes of a text that place it among the rows of its doc_id, and the most blocks that one doc_id is cut into.
BEGINNING, MOST_PIECES = 32, 10_000
OUT = "kind string, bucket int, block int, blob binary"
ROWS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
RESULT_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


class Blocks:
    """Ranges of rows in the order of doc_id and text: the upper doc_ids, and for doc_ids that fill more than one block the beginnings of
    texts that part them. Null comes last."""

    def __init__(self, bounds: list[int], parts: dict[int, list[bytes]]):
        self.bounds, self.parts = np.array(bounds, np.int64), parts
        more = np.zeros(len(bounds) + 2, np.int64)
        for doc_id, p in parts.items():
            more[np.searchsorted(self.bounds, doc_id, "left") + 1] += len(p)
        self.first = (np.arange(len(more)) + np.cumsum(more))[:-1]

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """The block of each row (doc_id, text)."""
        ids = _ids(batch)
        out = self.first[np.searchsorted(self.bounds, ids, "left")]
        for k in np.flatnonzero(np.isin(ids, list(self.parts))) if self.parts else ():
            p, text = self.parts[int(ids[k])], batch.column("text")[int(k)].as_py()
            out[k] += len(p) if text is None else bisect.bisect_left(p, text[:BEGINNING].encode()[:BEGINNING])
        return out


def _parts(docs: DataFrame, pieces: dict[int, int], rows: int) -> dict[int, list[bytes]]:
    """Beginnings of texts that cut the rows of each doc_id into about so many pieces; texts that begin alike stay together."""
    spark = docs.sparkSession
    hot = F.broadcast(spark.createDataFrame([(i,) for i in pieces], "hot bigint"))  # doc_ids that fill blocks: fewer than the blocks
    mine = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("hot"), F.substring(F.col("text").cast("binary"), 1, BEGINNING).alias("start"))
    rate = min(1.0, 40 * sum(pieces.values()) / max(rows, 1))
    seen: dict[int, list[bytes]] = {}
    for r in mine.where((F.rand(7) < rate) & F.col("start").isNotNull()).join(hot, "hot").collect():  # about 40 of each piece
        seen.setdefault(r.hot, []).append(bytes(r.start))
    out = {i: sorted({sorted(s)[len(s) * k // pieces[i]] for k in range(1, pieces[i])}) for i, s in seen.items()}
    return {i: p for i, p in out.items() if p}


def layout(docs: DataFrame, block_bytes: int, batches: int) -> tuple[Blocks, int, int]:
    """The blocks, the number of buckets, the number of ranges of doc_id.

    One pass over ids and lengths. The bounds come from a quantile sketch: uneven blocks cost balance, never rows. Blocks keep their
    size up to a million of them, whose bounds the driver can hold.
    """
    none = F.col("doc_id").isNull()
    n, size, nulls, theirs = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text")), F.count(F.when(none, 1)), F.sum(F.when(none, F.octet_length("text")))).first()
    blocks = int(min(1_000_000, max(batches, (size or 0) // block_bytes + 1)))
    steps = [k / blocks for k in range(1, blocks)]
    qs = docs.agg(F.percentile_approx("doc_id", steps, max(50_000, 4 * blocks))).first()[0] if steps and n else []
    often = Counter(q for q in qs or [] if q < LAST)
    bounds = sorted(often)
    pieces = {i: min(k, MOST_PIECES) for i, k in often.items() if k > 1}
    if nulls and (theirs or 0) > block_bytes:
        pieces[LAST] = min(int(theirs // block_bytes) + 1, MOST_PIECES)
    held = int(n * sum(often[i] for i in pieces if i < LAST) / blocks) + nulls
    buckets = 1 << max(6, int((size or 0) // (24 << 20)).bit_length())
    return Blocks(bounds, _parts(docs, pieces, held) if pieces else {}), buckets, len(bounds) + 1


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("doc_id"), LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _prints(texts: pa.Array, window: int):
    data, offs = buffers(texts)
    s, e, ptr = words(data, offs)
    ok = np.flatnonzero(inside(ptr, window))
    full, check = (window_hashes(word_hashes(data, s, e, seed=k), window)[ok] for k in (0, 1))
    return ok, full, check.astype(np.uint16), ptr


def _unique(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (fingerprint, check) pairs."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    same = np.empty(len(h), bool)
    if len(h):
        same[0], same[1:] = False, h[1:] == h[:-1]
        tied = same & np.concatenate(([False], c[1:] != c[:-1]))
        if tied.any():  # one fingerprint, two checks: a false match between 64-bit hashes
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    return h[~same], c[~same]


def _cut(h: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    at = np.searchsorted(h >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    return [(int(k), slice(int(at[k]), int(at[k + 1]))) for k in np.flatnonzero(np.diff(at))]


def fingerprints(docs: DataFrame, blocks: Blocks, bits: int, window: int) -> DataFrame:
    """Blobs of the distinct window fingerprints of each block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            for block, parts in sorted(held.items()):
                h, c = _unique(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                rows = [("new", k, block, pack(h[s], c[s])) for k, s in _cut(h, bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), ROWS.types, strict=True)], schema=ROWS)
            held.clear()

        for b in slices(batches):
            ok, h, c, ptr = _prints(b.column("text"), window)
            of = blocks.of(b)[np.searchsorted(ptr, ok, "right") - 1]
            for block in np.unique(of):
                held.setdefault(int(block), []).append((h[of == block], c[of == block]))
            size += len(ok)
            if size > 1_200_000:
                yield from flush()
                size = 0
        yield from flush()
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def _merge(table: pa.Table) -> pa.Table:
    """One bucket: the runs and the blocks of a new batch, merged in order. Says per block what began earlier, and what is new."""
    bucket = table.column("bucket")[0].as_py()
    parts = sorted(zip(table.column("block").to_pylist(), range(table.num_rows), strict=True))
    hs, cs, bs = [], [], []
    for block, i in parts:  # runs have block -1
        h, c = unpack(table.column("blob")[i].as_py(), "u2")
        hs.append(h), cs.append(c), bs.append(np.full(len(h), block, np.int32))
    h, c, b = map(np.concatenate, (hs, cs, bs))
    order = np.argsort(h, kind="stable")  # earlier blocks stay first
    h, c, b = h[order], c[order], b[order]
    seen = np.zeros(len(h), bool)
    seen[1:] = h[1:] == h[:-1]
    if (seen[1:] & (c[1:] != c[:-1])).any():  # verification tells windows apart that share 64 bits
        order = np.lexsort((b, c, h))
        h, c, b = h[order], c[order], b[order]
        seen[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    starts = np.maximum.accumulate(np.where(seen, 0, np.arange(len(h))))
    hit = seen & (b[starts] < b)  # repeats inside a block are the block's own affair
    rows = []
    for block in np.unique(b[hit]):
        m = hit & (b == block)
        x, y = _unique(h[m], c[m])
        rows.append(("hit", bucket, int(block), pack(x, y)))
    m = ~seen & (b >= 0)
    if m.any():
        rows.append(("run", bucket, -1, pack(h[m], c[m])))
    del hs, cs, bs, h, c, b, order, seen, hit, starts
    trim()
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(ROWS.types)], schema=ROWS)


def _union(table: pa.Table) -> pa.Table:
    parts = [unpack(x.as_py(), "u2") for x in table.column("blob")]
    h, c = _unique(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(("run", table.column("bucket")[0].as_py(), -1, pack(h, c)), ROWS.types, strict=True)], schema=ROWS)


class FingerprintIndex:
    """Sorted immutable runs in a folder that all executors share."""

    def __init__(self, spark: SparkSession, bits: int, max_runs: int = 4, path: str | None = None):
        self.spark, self.bits, self.max_runs, self.path, self.runs, self.hits, self.made = spark, bits, max_runs, path or shared_dir(spark), [], [], 0

    def _table(self, paths: list[str], kind: str) -> DataFrame | None:
        if not paths:
            return None
        df = self.spark.read.schema(OUT).parquet(*[f"{p}/kind={kind}" for p in paths])
        return df.select(F.lit(kind).alias("kind"), "bucket", "block", "blob")

    def add(self, new: DataFrame, keep: bool = True) -> None:
        """Merge-join a batch's blobs with the runs. keep: whether its own fingerprints become a run, for later batches."""
        old = self._table(self.runs, "run")
        out = (new if old is None else new.unionByName(old)).groupBy("bucket").applyInArrow(_merge, OUT)
        path = f"{self.path}/batch-{self.made}"
        self.made += 1
        (out if keep else out.where("kind = 'hit'")).write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = {s.getPath().getName() for s in fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)}
        self.hits += [path] * ("kind=hit" in there)
        self.runs += [path] * ("kind=run" in there)
        if len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        path = f"{self.path}/compacted-{self.made}"
        self.made += 1
        self._table(self.runs, "run").groupBy("bucket").applyInArrow(_union, OUT).write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
        self.drop_runs()
        self.runs = [path]

    def drop_runs(self) -> None:
        """Deletes the runs, which no verdict needs once it is written."""
        for path in self.runs:
            delete(self.spark, f"{path}/kind=run")
        self.runs = []
        swept(self.spark)

    def found(self) -> DataFrame:
        """Per block, blobs of the windows that begin in an earlier block or batch."""
        df = self._table(self.hits, "hit")
        return df if df is not None else self.spark.createDataFrame([], OUT)


def _resolve(window: int, schema: pa.Schema):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        found = [unpack(x.as_py(), "u2") for x in hits.column("blob")]
        late, late_c = _unique(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, U), np.zeros(0, np.uint16))
        rows = pa.concat_tables([unpack_rows(x.as_py()) for x in docs.column("blob")])
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()  # nulls last
        pieces, hs, cs, base = [], [], [], 0
        for b in slices(rows.to_batches()):
            ok, h, c, ptr = _prints(b.column("text"), window)
            pieces.append((b, ok, ptr))
            hs.append(h), cs.append(c)
            base += len(ok)
        h, c = np.concatenate(hs), np.concatenate(cs)
        # a window that began earlier in this block
        order = np.argsort(h, kind="stable")
        sh, sc = h[order], c[order]
        again = np.zeros(len(h), bool)
        again[1:] = sh[1:] == sh[:-1]
        if (again[1:] & (sc[1:] != sc[:-1])).any():
            order = np.lexsort((np.arange(len(h)), c, h))
            sh, sc = h[order], c[order]
            again[1:] = (sh[1:] == sh[:-1]) & (sc[1:] == sc[:-1])
        dup = np.zeros(len(h), bool)
        dup[order[again]] = True
        if len(late):
            at = np.searchsorted(late, sh)
            near = np.minimum(at, len(late) - 1)
            match = (late[near] == sh) & (late_c[near] == sc)
            for step in range(1, 4):  # the few fingerprints that come with more than one check
                near2 = np.minimum(at + step, len(late) - 1)
                more = (late[near2] == sh) & (late_c[near2] == sc)
                if not more.any():
                    break
                match |= more
            dup[order[match]] = True
        out, at = [], 0
        for b, ok, ptr in pieces:
            d = dup[at : at + len(ok)]
            at += len(ok)
            data, offs = buffers(b.column("text"))
            s, e, _ = words(data, offs)
            gone = covered(ok[d], window, len(s))
            n = np.diff(ptr)
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(gone)))
            out.append(pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(total[ptr[1:]] - total[ptr[:-1]], pa.int64()), joined(data, s, e, ptr, ~gone), *(b.column(c) for c in schema.names[4:])], schema=schema))
        del rows, pieces, hs, cs, h, c, sh, sc, order
        trim()
        return pa.Table.from_batches(out, schema)

    return run


def blocks_of(docs: DataFrame, blocks: Blocks, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents by block, as compressed Arrow rows: a task's documents of a block are one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            for block, parts in sorted(held.items()):
                blob = pack_rows(pa.Table.from_batches(parts).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([blob], pa.binary())], names=["block", "blob"])
            held.clear()

        for b in slices(batches):
            of = blocks.of(b)
            for block in np.unique(of):
                held.setdefault(int(block), []).append(b.filter(pa.array(of == block)))
            size += b.nbytes
            if size > 12 << 20:
                yield from flush()
                size = 0
        yield from flush()
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text")).mapInArrow(run, "block int, blob binary")


def deduplicate(docs: DataFrame, window: int = 20, batches: int = 2, block_bytes: int = 6 << 20, max_runs: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document without the words of windows that also start earlier.

    carry: further columns of docs that the result keeps (text: as it was). The documents go through the index in so many batches, as they would over days. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    blocks, buckets, n = layout(docs, block_bytes, batches)
    bounds = blocks.bounds.tolist()
    bits = buckets.bit_length() - 1
    index = FingerprintIndex(spark, bits, max_runs)
    batches = min(batches, n)
    for g in range(batches):
        part = docs
        lo, hi = g * n // batches, (g + 1) * n // batches
        if lo:
            part = part.where((F.col("doc_id") > bounds[lo - 1]) | F.col("doc_id").isNull()) if hi == n else part.where(F.col("doc_id") > bounds[lo - 1])
        if hi < n:
            part = part.where(F.col("doc_id") <= bounds[hi - 1])
        index.add(fingerprints(part, blocks, bits, window), keep=g < batches - 1)
    index.drop_runs()
    extra = docs.select(*carry).schema
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    rows = pa.schema([*RESULT_ROWS, *to_arrow_schema(extra)])
    return blocks_of(docs, blocks, carry).groupBy("block").cogroup(index.found().groupBy("block")).applyInArrow(_resolve(window, rows), RESULT + kinds)
