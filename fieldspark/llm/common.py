"""Shared pieces of the text operators: vectorised words and hashes over Arrow buffers, blobs of sorted keys, the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: A word is a maximal run of bytes other than these: [^\x20\x09-\x0D]+.
SPACES = (9, 10, 11, 12, 13, 32)
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
#: Bytes of text that are worked on at once, so that temporary arrays stay small.
STEP = 2 << 20

U = np.uint64
_P, _Q, _R = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The lowest k bytes of a number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def inverse(p: np.uint64) -> np.uint64:
    """Of an odd number, modulo 2**64."""
    return U(pow(int(p), -1, 1 << 64))


def powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so many bytes in the column, one row at least."""
    for b in batches:
        i = b.schema.get_field_index(column)
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            yield b.slice(at, to - at)
            at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word; for each text the number of words before it (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    before[-1], before[:-1] = True, ~word[1:]
    ends = np.flatnonzero(word & (before | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64 bits for each word; with lower, A-Z count as a-z. Hashes of other seeds are independent.

    A word is read in blocks of eight bytes, each mixed by a bijection that its place chooses, so words of up to eight bytes never
    collide with those of their length, and no algebra of the text carries over to longer ones.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    key = mix(np.arange(2 * seed + 1, 2 * seed + 3, dtype=U) * _Q)
    out = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + key[0])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        first = np.cumsum(more) - more
        k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(starts[long], more) + 8 * k
        left = np.repeat(ends[long], more) - at
        blocks = mix((eight[at] & _MASKS[np.minimum(left, 8)]) ^ mix(k.astype(U) * _R + key[1]))
        out[long] += np.add.reduceat(blocks, first)
    return mix(out + size.astype(U) * _R)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each n consecutive elements; len(h) - n + 1 of them, over text bounds too (see inside())."""
    if len(h) < n:
        return np.zeros(0, U)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(h * powers(_Q, len(h)))))
    return mix((sums[n:] - sums[:-n]) * powers(inverse(_Q), len(h) - n + 1))


def inside(ptr: np.ndarray, n: int) -> np.ndarray:
    """Of all windows, whether they lie in one text."""
    total = int(ptr[-1])
    if total < n:
        return np.zeros(0, bool)
    last = np.repeat(ptr[1:], np.diff(ptr))
    return np.arange(total - n + 1) + n <= last[: total - n + 1]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total elements lie in a window of n that begins at one of the starts."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + n, total), -1)
    return np.cumsum(d[:-1]) > 0


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ptr: np.ndarray, keep: np.ndarray) -> pa.Array:
    """For each text its kept words with one space between."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[keep]
    s, size = starts[keep], (ends - starts)[keep] + 1
    if len(size):
        last = np.empty(len(doc), bool)
        last[-1], last[:-1] = True, doc[1:] != doc[:-1]
        size[last] -= 1
    offs = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    per = np.zeros(len(ptr), np.int64)
    np.add.at(per, doc + 1, size)
    at = np.repeat(s - offs[:-1], size) + np.arange(int(offs[-1]))
    out = data[np.minimum(at, max(len(data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    if len(size):
        out[offs[1:][~last] - 1] = 32
    return pa.LargeStringArray.from_buffers(len(ptr) - 1, pa.py_buffer(np.cumsum(per)), pa.py_buffer(out)).cast(pa.string())


def pack(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 64-bit keys, and arrays that go with them, as a compressed blob: gaps, split into planes of bytes."""
    planes = [len(keys).to_bytes(8, "little")]
    for k, a in enumerate((keys, *more)):
        a = np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if not k else a)
        planes.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *more: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k, kind in enumerate(("u8", *more)):
        size = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(-1) if n else np.zeros(0, kind)
        out.append(np.cumsum(a, dtype=a.dtype) if not k else a)
        at += n * size
    return out


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives freed memory back to the system at the end of a task or group: a Python worker waits for its next task with all that it keeps."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pack_rows(rows: pa.RecordBatch | pa.Table) -> bytes:
    """Rows as a compressed Arrow stream: whole groups of documents go through a shuffle as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(rows)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one serves a local master and nothing else."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fieldspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/fieldspark/{uuid.uuid4().hex}"


#: The folders that written() has made inside settled(), by thread.
_SCOPE = threading.local()


def written(df: DataFrame, spark: SparkSession, name: str = "t", codec: str = "zstd") -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage and survives lost executors."""
    folder = shared_dir(spark)
    if (made := getattr(_SCOPE, "made", None)) is not None:
        made.append(folder)
    path = f"{folder}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more, sooner than settled() would."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        delete(table.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """Lets Spark find the shuffles that no frame needs any more; it deletes their files once its frames are collected as garbage."""
    gc.collect()
    told = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(2):  # once more for what the listeners of Spark's own still held
        # Py4J tells the JVM of Python's garbage from a thread of its own, about a second later; before that the JVM keeps the frames
        end = time.monotonic() + 3
        while told and time.monotonic() < end:
            time.sleep(0.05)
        time.sleep(0.2)  # the last one is on its way
        spark.sparkContext._jvm.System.gc()


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """The frame that make() gives, as a written table. The tables that make() wrote on the way are deleted, as nothing else refers to them."""
    outer, made = getattr(_SCOPE, "made", None), []
    _SCOPE.made = made
    try:
        df = make()
        _SCOPE.made = outer
        return written(df, spark, name)
    finally:
        _SCOPE.made = outer
        for folder in made:
            delete(spark, folder)
        df = None
        swept(spark)
