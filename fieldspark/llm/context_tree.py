"""Language-model scores by context-tree weighting over bytes, learned from all training documents.

A text is read as bytes: its words (A-Z in lower case) with one space between, then an end byte. Each byte is eight binary
decisions; each decision has its own context tree over the last DEPTH bytes, whose nodes carry Krichevsky-Trofimov estimates. As a
KT block probability depends on counts alone, the weighted probabilities follow bottom-up from the counts of all training
documents, gathered by two exchanges of sorted blobs:

1. Every block of documents (a doc_id range with a bounded amount of text) sends its distinct (context, byte) keys with their
   training counts to the shard of the two nearest context bytes, which holds whole subtrees from depth 2 on; the commonest pairs
   (MOST_SPLIT at most, found in a sample) are cut by the third byte, with subtrees from depth 3 on. The shard adds up counts, weighs its
   subtrees and reports sums for the depths above: at most 65,535 + 255 * MOST_SPLIT nodes, added up by Spark and sent to all. Which pairs
   are cut changes no result.
2. With those, each shard answers every block with the log probability of the block's keys; the block then scores its texts.

A context that training never saw leaves the mixture to the depths that it did see. Words go the same way, with plain counts,
for the add-one unigram base score. No table of the corpus ever goes to the driver or to all executors.

Nulls: a null text is empty and has one token, its end. A null doc_id comes after all others, and is held out or not as the
caller says. Repeated rows count as often as they occur. Without training documents every bit has probability 1/2, and the base
is that of N = V = 0. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, buffers, joined, mix, pack, pack_rows, slices, unpack, unpack_rows, word_hashes, words, written
from .substring_dedup import Blocks, layout

DEPTH = 6
MOST_SPLIT = 256
END = 10  # never inside a word
END_WORD = U(0x5851F42D4C957F2D)
SENT = "kind string, shard int, block int, blob binary"
SENT_ROWS = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
STATE = "kind string, shard int, block int, blob binary, node long, n0 long, n1 long, s double"
STATE_ROWS = pa.schema([*SENT_ROWS, ("node", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64()), ("s", pa.float64())])
RESULT = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, sum_log10 double, score double, n_bytes bigint"
RESULT_ROWS = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("sum_log10", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series after a shift by 8."""
    z = x + 8.0
    r = 1 / (z * z)
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z
    for k in range(8):
        out -= np.log(x + k)
    return out


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives any one sequence with so many zeros and ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def prepare(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, byte) keys of all texts, nearest context byte first; offsets; word hashes with ends; offsets."""
    data, offs = buffers(texts)
    s, e, ptr = words(data, offs)
    text, to = buffers(joined(data, s, e, ptr, np.ones(len(s), bool)))
    n = np.diff(to)
    # depth ends before each text, and its own end behind it
    wide = np.full(len(text) + (depth + 1) * len(n), END, np.uint8)
    at = np.arange(len(text)) + np.repeat((depth + 1) * np.arange(len(n)) + depth, n)
    wide[at] = LOWER[text]
    place = np.insert(at, to[1:], (to[1:] + (depth + 1) * np.arange(1, len(n) + 1) - 1))
    to = to + np.arange(len(to))
    x = wide.astype(U)
    key = x.copy()
    for j in range(1, depth + 1):
        key[j:] |= x[:-j] << U(8 * (depth + 1 - j))
    key = key[place]
    h = np.insert(word_hashes(data, s, e, lower=True), ptr[1:], END_WORD)
    return key, to, h, ptr + np.arange(len(ptr))


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _sum_marked(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _sum() for keys below 2**63 that count once or not: the mark rides in the lowest bit, so that the keys are sorted in place."""
    x = (keys << U(1)) | train
    x.sort()
    if not len(x):
        return x, np.zeros(0, np.uint32)
    keys = x >> U(1)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat((x & U(1)).astype(np.uint32), first)


def _look(keys: np.ndarray, values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The values of keys that are all there; queries go in sorted order, which spares the caches."""
    order = np.argsort(query)
    out = np.empty(len(query), values.dtype)
    out[order] = values[np.searchsorted(keys, query[order])]
    return out


def _shard(kind: str, keys: np.ndarray, bits: int, depth: int, split: np.ndarray) -> np.ndarray:
    top = keys
    if kind == "gram":
        top, deep = keys >> U(8 * (depth - 1)), _deep(keys, depth, split)
        top[deep] = keys[deep] >> U(8 * (depth - 2)) | U(1 << 63)
    return (mix(top) >> U(64 - bits)).astype(np.int64)


def _deep(keys: np.ndarray, depth: int, split: np.ndarray) -> np.ndarray:
    """Whether a key's two nearest bytes are a pair that is cut by the third byte."""
    hot = np.zeros(1 << 16, bool)
    hot[split] = True
    return hot[(keys >> U(8 * (depth - 1))).astype(np.int64)]


def hot_pairs(docs: DataFrame, bits: int, depth: int, sample_bytes: int = 4 << 20) -> np.ndarray:
    """Pairs of nearest bytes that hold more keys than a quarter of a shard's share, in a sample of about so many bytes."""
    if depth < 3:
        return np.zeros(0, np.int64)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = np.bincount((np.unique(prepare(b.column("text"), depth)[0]) >> U(8 * (depth - 1))).astype(np.int64))
            pair = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(n[pair], pa.int64())], names=["pair", "n"])

    n = docs.where(F.rand(11) < sample_bytes / size).select("text").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    n = {r.pair: r.n for r in n.collect()}  # 65,536 pairs at most
    least = sum(n.values()) / (4 << bits)
    return np.array(sorted(sorted((p for p in n if n[p] > least), key=lambda p: (-n[p], p))[:MOST_SPLIT]), np.int64)


def gather(docs: DataFrame, blocks: Blocks, bits: int, depth: int, split: np.ndarray) -> DataFrame:
    """Distinct keys and words of each block with their training counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def shrink():
            for k, parts in held.items():
                held[k] = [_sum(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            return sum(len(p[0][0]) for p in held.values())

        def flush():
            shrink()
            for (kind, block), [(keys, counts)] in sorted(held.items()):
                of = _shard(kind, keys, bits, depth, split)
                order = np.argsort(of, kind="stable")
                at = np.searchsorted(of[order], np.arange((1 << bits) + 1))
                rows = [(kind, s, block, pack(keys[order[at[s] : at[s + 1]]], counts[order[at[s] : at[s + 1]]])) for s in range(1 << bits) if at[s] < at[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), SENT_ROWS.types, strict=True)], schema=SENT_ROWS)
            held.clear()

        for b in slices(batches):
            key, to, h, at = prepare(b.column("text"), depth)
            train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            of = blocks.of(b)
            for block in np.unique(of):
                for kind, k, ptr in (("gram", key, to), ("word", h, at)):
                    n = np.diff(ptr)
                    mine = np.repeat(of == block, n)
                    seen = np.repeat(train, n)
                    k, seen = (k, seen) if mine.all() else (k[mine], seen[mine])
                    part = _sum_marked(k, seen) if kind == "gram" else _sum(k, seen.astype(np.uint32))
                    held.setdefault((kind, int(block)), []).append(part)
                    size += len(part[0])
            if size > 3_000_000:
                size = shrink()
                if size > 2_400_000:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, SENT)


class Forest:
    """Weighted context trees of one shard: depths low..depth, for each of the eight decisions."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, depth: int):
        self.low, self.depth, self.nodes = low, depth, {}
        seen = counts > 0
        keys, counts = keys[seen], counts[seen].astype(np.int64)
        byte, ctx = keys & U(255), keys >> U(8)
        for i in range(8):
            below = None
            for d in range(depth, low - 1, -1):
                node = ((ctx >> U(8 * (depth - d))) << U(8)) | (U(1) << U(i)) | (byte >> U(8 - i))
                u, inv = np.unique(node, return_inverse=True)
                bit = (byte >> U(7 - i)) & U(1)
                n1 = np.bincount(inv, counts * bit.astype(np.int64), len(u))
                n0 = np.bincount(inv, counts, len(u)) - n1
                kt = kt_block(n0, n1)
                if below is None:
                    pw, stop = kt, np.ones(len(u))
                else:
                    child, cpw = below
                    inner = np.bincount(np.searchsorted(u, ((child >> U(16)) << U(8)) | (child & U(255))), cpw, len(u))
                    pw = np.logaddexp(kt, inner) - np.log(2)
                    stop = np.exp(kt - np.log(2) - pw)
                self.nodes[d, i] = (u, n0, n1, stop)
                below = u, pw
            self.nodes["sum", i] = below

    def top(self) -> Iterator[tuple[int, int, int, float]]:
        """For the nodes one depth above low: node, zeros, ones, sum of the children's log weighted probabilities."""
        for i in range(8):
            u, pw = self.nodes["sum", i]
            _, n0, n1, _ = self.nodes[self.low, i]
            up, inv = np.unique(((u >> U(16)) << U(8)) | (u & U(255)), return_inverse=True)
            yield from zip(up.tolist(), np.bincount(inv, n0, len(up)).astype(int).tolist(), np.bincount(inv, n1, len(up)).astype(int).tolist(), np.bincount(inv, pw, len(up)).tolist(), strict=True)

    def log_p(self, keys: np.ndarray, upper: Upper | None) -> np.ndarray:
        """Natural log of the probability of each key's byte after its context."""
        byte, ctx = keys & U(255), keys >> U(8)
        out = np.zeros(len(keys))
        for i in range(8):
            bit = ((byte >> U(7 - i)) & U(1)).astype(bool)
            tail = (U(1) << U(i)) | (byte >> U(8 - i))
            p = np.full(len(keys), -1.0)  # not seen so deep
            for d in range(self.depth, -1, -1):
                node = ((ctx >> U(8 * (self.depth - d))) << U(8)) | tail
                u, n0, n1, stop = self.nodes[d, i] if d >= self.low else upper.nodes[d]
                if not len(u):
                    continue
                at = np.minimum(np.searchsorted(u, node), len(u) - 1)
                here = u[at] == node
                kt = (np.where(bit, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
                w = np.where(p < 0, 1.0, stop[at])
                p = np.where(here, w * kt + (1 - w) * np.maximum(p, 0), p)
            out += np.log(np.where(p < 0, 0.5, p))
        return out


class Upper:
    """Depths 0 and 1, and depth 2 below the pairs that are cut, from what the shards report (depth, node, zeros, ones, sum of the children's
    log weighted probabilities): at most 255 + 65,280 + 255 * MOST_SPLIT nodes."""

    def __init__(self, rows: list[tuple[int, int, int, int, float]]):
        rows = sorted(rows)
        self.nodes = {}
        u, n0, n1, pw = np.zeros(0, U), *np.zeros((3, 0))
        for d in (2, 1, 0):
            own = [r[1:] for r in rows if r[0] == d]
            up = np.concatenate((((u >> U(16)) << U(8)) | (u & U(255)), np.array([r[0] for r in own], U)))
            u, inv = np.unique(up, return_inverse=True)
            n0, n1, s = (np.bincount(inv, np.concatenate((x, np.array([r[k] for r in own], float))), len(u)) for k, x in ((1, n0), (2, n1), (3, pw)))
            kt = kt_block(n0, n1)
            pw = np.logaddexp(kt, s) - np.log(2)
            self.nodes[d] = (u, n0, n1, np.exp(kt - np.log(2) - pw))


def _weigh(depth: int, split: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        parts = [unpack(x.as_py(), "u4") for x in table.column("blob")]
        blocks = np.array(table.column("block").to_pylist())
        keys, counts = _sum(*(np.concatenate(x) for x in zip(*((k, c.astype(np.int64)) for k, c in parts), strict=True)))
        rows = []
        if kind == "gram":
            for low, m in _lows(keys, depth, split):
                rows += [("top", shard, low - 1, None, *x) for x in Forest(keys[m], counts[m], low, depth).top()]
            rows.append(("keys", shard, -1, pack(keys, counts), None, None, None, None))
            rows += [("keys", shard, int(block), pack(k), None, None, None, None) for block, (k, _) in zip(blocks, parts, strict=True)]
        else:
            for block in np.unique(blocks):
                own = np.unique(np.concatenate([parts[i][0] for i in np.flatnonzero(blocks == block)]))
                rows.append(("word", shard, int(block), pack(own, counts[np.searchsorted(keys, own)]), None, None, None, None))
            rows.append(("total", shard, 0, None, None, int(counts.sum()), int((counts > 0).sum()), None))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), STATE_ROWS.types, strict=True)], schema=STATE_ROWS)

    return run


def _lows(keys: np.ndarray, depth: int, split: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The depth from which a shard holds subtrees, with the places of its keys."""
    deep = _deep(keys, depth, split)
    return [(2, np.flatnonzero(~deep)), *[(3, np.flatnonzero(deep))] * bool(len(split))]


def _score(depth: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return RESULT_ROWS.empty_table()
        known: dict[str, list] = {"gram": [], "word": []}
        for kind, blob in zip(told.column("kind").to_pylist(), told.column("blob"), strict=True):
            known[kind].append(unpack(blob.as_py(), "f4" if kind == "gram" else "i8"))
        tables = {}
        for kind, parts in known.items():
            k, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(k)
            tables[kind] = k[order], v[order]
        out = []
        for blob in docs.column("blob"):
            for b in slices(unpack_rows(blob.as_py()).to_batches()):
                key, to, h, at = prepare(b.column("text"), depth)
                k, v = tables["gram"]
                logp = np.concatenate((np.zeros(1), np.cumsum(_look(k, v, key).astype(np.float64))))
                k, v = tables["word"]
                c = _look(k, v, h)
                per = lambda x, p: np.diff(np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))[p])
                out.append(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("train"), pa.array(np.diff(at), pa.int64()), pa.array(per((c > 0).astype(np.int64), at), pa.int64()), pa.array(per(np.log10(c + 1.0), at), pa.float64()), pa.array(np.diff(logp[to]) / np.log(10), pa.float64()), pa.array(np.diff(to), pa.int64())], schema=RESULT_ROWS))
        return pa.Table.from_batches(out, RESULT_ROWS)

    return run


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = 12 << 20, split: list[int] | None = None) -> DataFrame:
    """docs: doc_id, text, train. Returns doc_id, train, n_tokens, n_known, train_tokens, base_score, score, code_length (bits a byte).

    split: pairs of nearest bytes (the nearest times 256, and the next) that are cut; by default those of hot_pairs().
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("train").cast("boolean"), F.lit(False)).alias("train"))
    blocks, buckets, _ = layout(docs, block_bytes, 1)
    bits = buckets.bit_length() - 1
    cut = hot_pairs(docs, bits, depth) if split is None else np.array(split, np.int64)
    state = gather(docs, blocks, bits, depth, cut).groupBy("kind", "shard").applyInArrow(_weigh(depth, cut), STATE)
    state = written(state, spark, "state", "snappy")
    n, v = state.where("kind = 'total'").agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    upper = spark.sparkContext.broadcast(Upper([tuple(r) for r in state.where("kind = 'top'").groupBy("block", "node").agg(F.sum("n0"), F.sum("n1"), F.sum("s")).collect()]))

    def answer(table: pa.Table) -> pa.Table:
        shard, blocks = table.column("shard")[0].as_py(), np.array(table.column("block").to_pylist())
        keys, counts = unpack(table.column("blob")[int(np.argmin(blocks))].as_py(), "i8")  # block -1
        logp = np.empty(len(keys), np.float32)
        for low, m in _lows(keys, depth, cut):
            forest = Forest(keys[m], counts[m], low, depth)
            for at in range(0, len(m), 200_000):
                logp[m[at : at + 200_000]] = forest.log_p(keys[m[at : at + 200_000]], upper.value)
        rows = []
        for block in np.unique(blocks[blocks >= 0]):
            own = np.unique(np.concatenate([unpack(table.column("blob")[int(j)].as_py())[0] for j in np.flatnonzero(blocks == block)]))
            rows.append(("gram", shard, int(block), pack(own, logp[np.searchsorted(keys, own)])))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), SENT_ROWS.types, strict=True)], schema=SENT_ROWS)

    told = state.where("kind = 'keys'").select("shard", "block", "blob").groupBy("shard").applyInArrow(answer, SENT)
    told = told.unionByName(state.where("kind = 'word'").select("kind", "shard", "block", "blob"))
    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            for block, parts in sorted(held.items()):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack_rows(pa.Table.from_batches(parts).combine_chunks())], pa.binary())], names=["block", "blob"])
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

    out = docs.mapInArrow(by_block, "block int, blob binary").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(depth), RESULT)
    return out.select(
        "doc_id", "train", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("sum_log10") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
        (F.col("score") * (-float(np.log2(10))) / F.col("n_bytes")).alias("code_length"),
    )
