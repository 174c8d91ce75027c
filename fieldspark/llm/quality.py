"""Quality classifier: perplexity under an interpolated modified Kneser-Ney word model of trusted text, cut at language quantiles.

The model (three discounts an order) is counted over the n-grams of trusted documents, on executors: those of the highest order as sorted
blobs in a grid of shards (see blocks), those of the orders below, which are far fewer at order 2, as rows. Its order is 2
by default, as order 3 told labelled documents apart no better (area under the curve 0.913 for both on 13,000 documents). An interpolated model is a sum over an n-gram's suffixes once it is written in logarithms: with v(w) = log p(w | context) - log weight of
the context - log p of the suffix, a text's log probability is its length times that of an unseen word, plus v of each n-gram
that the model has, plus the log weight of each context that it has. So one value for each key is all that scoring needs, whatever
the order, and the join of documents with the counts is one equality join:

1. Each map task sends its texts' distinct n-gram hashes, sorted, with the documents that hold them, to the shard of the hash. A
   bitmap of fixed size with the model's hashes drops most of what the model doesn't have before it travels; no result changes.
2. A shard merge-joins the requests with its values and answers with one sum for each document of the task. Requests of about
   group_bytes of text (more in proportion to the shards) meet in one group of shards, so a frequent word's requests stay bounded; each
   group gets the values once. Shards grow in number with the model.
3. The shards' sums of a task add up to its documents' log probabilities.

Shards are filled and documents are scored in rounds, each of which deletes what travelled in it; every row is in one round. So rows are
read once for each round: docs must give the same rows each time.

A language's threshold is a quantile of the perplexities of its trusted documents outside the model's half, plus a margin in
log space; the threshold of all languages serves one with too few. Trusted documents in the model's half are scored by a model that holds them.

Every trusted document counts once: a hash of doc_id parts them into those that the model learns and those that set the thresholds.
There is no bound on either; counts and joins cover all rows. A null or empty text has one token, its end; it is kept, as are all documents
when nothing is trusted. Very long texts are read whole. A null lang counts as a language of its own. Rows that share a doc_id are scored
one by one. Ties at the threshold are kept. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, buffers, discard, mix, pack, pack_rows, settled, slices, swept, trim, unpack, unpack_rows, word_hashes, words, written

ORDER = 2
START, END = U(0x2545F4914F6CDD1D), U(0x5851F42D4C957F2D)
#: The bitmap has 2**26 places (8 MB), cut into as many pieces as there are shards: 2**5, more so that a shard keeps about SHARD_KEYS keys.
BITMAP, LEAST_BITS, MOST_BITS, SHARD_KEYS = 26, 5, 14, 600_000
#: What travels is made, used and deleted in rounds, so that a share of it is on disk at a time: of this many bytes (a key has 16), in MOST_ROUNDS at most.
ROUND_BYTES, MOST_ROUNDS = 32 << 20, 4
#: So many n-grams of the highest order leave a task together; repeats among them are dropped first.
BLOCK_GRAMS = 1_500_000
BLOCKS = "shard int, grams binary"
BLOCK_ROWS = pa.schema([("shard", pa.int32()), ("grams", pa.binary())])
GRAMS = "k int, key bigint, ctx bigint, tail bigint, n bigint"
GRAM_ROWS = pa.schema([("k", pa.int32()), *((c, pa.int64()) for c in ("key", "ctx", "tail", "n"))])
SENT = "grp int, shard int, part bigint, docs bigint, keys binary, refs binary"
SENT_ROWS = pa.schema([("grp", pa.int32()), ("shard", pa.int32()), ("part", pa.int64()), ("docs", pa.int64()), ("keys", pa.binary()), ("refs", pa.binary())])
SUMS = "part bigint, meta boolean, blob binary"
SUM_ROWS = pa.schema([("part", pa.int64()), ("meta", pa.bool_()), ("blob", pa.binary())])
RESULT = "doc_id bigint, lang string, print bigint, n_tokens bigint, log_sum double"
ROWS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("print", pa.int64()), ("n_tokens", pa.int64()), ("log_sum", pa.float64())])


def prefix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * U(0x9E3779B97F4A7C15) + w)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words with its start (once) and end; offsets."""
    data, offs = buffers(texts)
    s, e, ptr = words(data, offs)
    h = word_hashes(data, s, e)
    n = len(offs) - 1
    h = np.insert(h, np.stack((ptr[:-1], ptr[1:]), 1).ravel(), np.tile(np.array([START, END], U), n))
    return h, ptr + 2 * np.arange(n + 1)


def before(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens before each place."""
    ctx = np.zeros(len(at), U)
    for j in range(k, 0, -1):
        ctx = prefix(ctx, h[at - j])
    return ctx


def ngrams(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token but the starts that has k - 1 tokens before it: place, hash of its k-gram, hash of the k - 1 before."""
    place = np.arange(len(h)) - np.repeat(ptr[:-1], np.diff(ptr))
    at = np.flatnonzero(place >= max(1, k - 1))
    ctx = before(h, at, k - 1)
    return at, prefix(ctx, h[at]), ctx


def counted(docs: DataFrame, levels: range) -> DataFrame:
    """k, key, ctx, tail (the n-gram without its first token), n: the n-grams of these levels and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, ptr = token_hashes(b.column("text"))
            for k in levels:
                at, key, ctx = ngrams(h, ptr, k)
                u, first, n = np.unique(key, return_index=True, return_counts=True)
                tail = prefix(before(h, at[first], k - 2), h[at[first]]) if k > 1 else np.zeros(len(u), U)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k), pa.int32()), *(pa.array(x.astype(np.int64)) for x in (u, ctx[first], tail, n))], schema=GRAM_ROWS)
        trim()

    return docs.select("text").mapInArrow(run, GRAMS).groupBy("k", "key").agg(F.first("ctx").alias("ctx"), F.first("tail").alias("tail"), F.sum("n").alias("n"))


def summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """n-grams (context, last word, context without its first token, number) of all parts, each once, by context."""
    ctx, word, sub, n = map(np.concatenate, zip(*parts, strict=True))
    key = prefix(ctx, word)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    n = np.add.reduceat(n[order], at) if len(at) else n
    at = order[at]
    by = np.argsort(ctx[at])
    at = at[by]
    return [ctx[at], word[at], sub[at], n[by]]


def grams(blob: pa.BinaryScalar) -> list[np.ndarray]:
    return unpack(blob.as_py(), "u8", "u8", "u8")


def blocks(docs: DataFrame, order: int) -> DataFrame:
    """shard, grams (see summed): the n-grams of the highest order, one blob a shard, in number as the text.

    Shards are cells of a grid: the context chooses the row, the last word the column. So the n-grams of a frequent context or word are
    spread over a row or a column, and a shard meets only a part of all contexts and words.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits_of = min(MOST_BITS, max(LEAST_BITS, (size // (6 * SHARD_KEYS)).bit_length()))  # of six bytes a word
    rows, columns = 1 << (bits_of + 1) // 2, 1 << bits_of // 2

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        shard = ((found[0] >> U(32)) * U(rows) >> U(32)) * U(columns) + ((found[1] >> U(32)) * U(columns) >> U(32))
        by = np.argsort(shard.astype(np.uint16), kind="stable")  # contexts stay in order
        found, cut = [x[by] for x in found], np.searchsorted(shard[by], np.arange(rows * columns + 1, dtype=U))
        out = [(s, pack(*(x[a:b] for x in found))) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), BLOCK_ROWS.types, strict=True)], schema=BLOCK_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches):
            h, ptr = token_hashes(b.column("text"))
            at, _, ctx = ngrams(h, ptr, order)
            if not len(at):
                continue
            held.append(summed([[ctx, h[at], before(h, at, order - 2), np.ones(len(at), U)]]))
            size += len(held[-1][0])
            if size > BLOCK_GRAMS:
                yield sent(summed(held))
                size = 0
                held.clear()
        if held:
            yield sent(summed(held))
        held.clear()
        trim()

    def merged(table: pa.Table) -> pa.Table:
        out = pack(*summed([grams(x) for x in table.column("grams")]))
        trim()
        return pa.Table.from_arrays([table.column("shard").slice(0, 1), pa.chunked_array([pa.array([out], pa.binary())])], schema=BLOCK_ROWS)

    return docs.select("text").mapInArrow(run, BLOCKS).groupBy("shard").applyInArrow(merged, BLOCKS)


def of_blocks(top: DataFrame, make: Callable[[list[np.ndarray]], Iterable[np.ndarray]], schema: str) -> DataFrame:
    """The columns that make() gives for the n-grams of each shard, after the shard's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("grams"), strict=True):
                columns = [x.view(np.int64) if x.dtype == U else x for x in make(grams(blob))]
                columns = [np.full(len(columns[0]), shard, np.int32), *columns]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[c.split()[0] for c in schema.split(", ")])
        trim()

    return top.mapInArrow(run, schema)


def discounts(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, U(3)).astype(np.int64)]


def _tails(found: list[np.ndarray]) -> Iterable[np.ndarray]:
    return np.unique(prefix(found[2], found[1]), return_counts=True)


def _sizes(found: list[np.ndarray]) -> Iterable[np.ndarray]:
    return np.array([[len(found[3]), int(found[3].sum()), *((found[3] == x).sum() for x in (1, 2, 3, 4))]], np.int64).T


def train(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, float] | None:
    """(key, value) of the model of docs' texts, a written table, and the log probability of a word without any key. None without texts."""
    spark, unseen = docs.sparkSession, []

    def make() -> DataFrame:
        values, *unseen[:] = _train(docs, order) or (spark.createDataFrame([], "key bigint, value double"),)
        return values

    values = settled(make, spark, "model")
    return (values, *unseen) if unseen else None


def _train(docs: DataFrame, order: int) -> tuple[DataFrame, float] | None:
    spark = docs.sparkSession
    # the highest order in blocks, the orders below as rows; of every word's continuations there is one, so words aren't counted
    top = settled(lambda: blocks(written(docs.select("text"), spark, "trusted"), order), spark, "top") if order > 1 else None
    raw = written(counted(docs, range(min(order, 2), max(order, 2))), spark, "grams") if order != 2 else None
    # continuation counts below the highest order; n-grams that only begin texts keep theirs
    if top is None:
        lower = raw.select("k", "key", "ctx", "tail", F.col("n").alias("c"))
    else:
        tails = of_blocks(top, _tails, "shard int, key bigint, m bigint").select(F.lit(order - 1).alias("k"), "key", "m")
        if raw is not None:
            tails = tails.unionByName(raw.groupBy((F.col("k") - 1).alias("k"), F.col("tail").alias("key")).agg(F.count(F.lit(1)).alias("m")))
        tails = tails.groupBy("k", "key").agg(F.sum("m").alias("m"))
        none = F.lit(0).cast("long")
        lower = tails.where("k = 1").select("k", "key", none.alias("ctx"), none.alias("tail"), F.col("m").alias("c"))
        if raw is not None:
            lower = lower.unionByName(raw.join(tails, ["k", "key"], "left").select("k", "key", "ctx", "tail", F.coalesce("m", "n").alias("c")))
    lower = written(lower, spark, "counts")
    swept(spark)
    levels = {r.k: r.asDict() for r in lower.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.sum("c").alias("total"), *(F.sum((F.col("c") == x).cast("long")).alias(f"n{x}") for x in (1, 2, 3, 4))).collect()}  # one row an order
    if not levels:
        return None
    if top is not None:
        names = ("size", "total", "n1", "n2", "n3", "n4")
        sizes = of_blocks(top, _sizes, "shard int, " + ", ".join(f"{c} bigint" for c in names))
        levels[order] = sizes.agg(*(F.sum(c).alias(c) for c in names)).first().asDict()
    off, of = F.lit(0.0), {}
    for k, r in levels.items():
        n = [max(r[f"n{x}"], 1) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = of[k] = np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.1, [0.9, 1.9, 2.9]).tolist()
        off = F.when(F.col("k") == k, F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).otherwise(off)
    lower = lower.withColumn("off", off)
    taken = F.sum(F.least("off", F.col("c").cast("double")))
    gamma = lower.where("k = 1").agg(taken).first()[0] / levels[1]["total"]
    unseen = gamma / (levels[1]["size"] + 1)
    rest = F.greatest(F.col("c") - F.col("off"), F.lit(0.0))
    low = lower.where("k = 1").select("key", (rest / float(levels[1]["total"]) + unseen).alias("p"))
    values = low.select("key", (F.log("p") - float(np.log(unseen))).alias("value"))
    for k in range(2, order):
        rows = lower.where(F.col("k") == k)
        weight = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (taken / F.sum("c")).alias("gamma"))
        weight = written(weight, spark, "weights")
        rows = rows.join(weight, "ctx").select("key", "tail", "gamma", (rest / F.col("total")).alias("own"))
        joined = rows.join(low.select(F.col("key").alias("tail"), F.col("p").alias("below")), "tail").withColumn("p", F.col("own") + F.col("gamma") * F.col("below"))
        joined = written(joined.select("key", "gamma", "below", "p"), spark, "order")
        values = values.unionByName(weight.select(F.col("ctx").alias("key"), F.log("gamma").alias("value"))).unionByName(joined.select("key", (F.log("p") - F.log("gamma") - F.log("below")).alias("value")))
        low = joined.select("key", "p")
    if top is None:
        return values, float(np.log(unseen))
    mine, weight = _top_values(top, low, of[order])
    values = values.unionByName(weight).groupBy("key").agg(F.sum("value").alias("value"))  # n-grams below the highest order are contexts too
    return values.unionByName(mine), float(np.log(unseen))


def _top_values(top: DataFrame, low: DataFrame, d: list[float]) -> tuple[DataFrame, DataFrame]:
    """(key, value) of the n-grams of the highest order, and of their contexts. low: key, p of the order below.

    A shard asks for what is discounted in each of its contexts, over all shards, and for the p of each of its n-grams' tails.
    """
    spark = top.sparkSession

    def contexts(found: list[np.ndarray]) -> Iterable[np.ndarray]:
        u, at = np.unique(found[0], return_index=True)  # by context, so its first place
        return u, np.add.reduceat(found[3], at), np.add.reduceat(discounts(found[3], d), at)

    def valued(top: pa.Table, told: pa.Table) -> pa.Table:
        ctx, word, sub, n = grams(top.column("grams")[0])
        side, keys, x = (told.column(c).to_numpy() for c in ("side", "key", "x"))
        denominator = np.ones(len(ctx))
        for k, asked in enumerate((ctx, prefix(sub, word))):
            key, known = keys[side == k].view(U), x[side == k]
            by = np.argsort(key)
            denominator *= known[by][np.searchsorted(key[by], asked)]
        off = discounts(n, d)
        out = pa.table({"key": pa.array(prefix(ctx, word).view(np.int64)), "value": pa.array(np.log1p((n - off) / denominator))})
        del ctx, word, sub, n, off, denominator
        trim()
        return out

    asks = of_blocks(top, contexts, "shard int, key bigint, total bigint, taken double")
    weight = written(asks.groupBy("key").agg(F.sum("total").alias("total"), F.sum("taken").alias("taken")), spark, "weights")
    told = asks.select("shard", "key").join(weight.select("key", F.col("taken").alias("x")), "key").withColumn("side", F.lit(0))
    tails = of_blocks(top, _tails, "shard int, key bigint, m bigint").select("shard", "key").join(low.select("key", F.col("p").alias("x")), "key").withColumn("side", F.lit(1))
    told = written(told.unionByName(tails), spark, "told")
    swept(spark)
    mine = top.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(valued, "key bigint, value double")
    return mine, weight.select("key", F.log(F.col("taken") / F.col("total")).alias("value"))


def bitmap(places: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, bool)
    bits[places] = True
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits, bitorder="little").tobytes())


def whole(pieces: dict[int, bytes], bits_of: int) -> np.ndarray:
    """The bitmap of 2**BITMAP places of 2**bits_of pieces; a piece that isn't there is empty."""
    empty = np.zeros(1 << (BITMAP - bits_of - 3), np.uint8)
    return np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(pieces[s]), np.uint8) if s in pieces else empty for s in range(1 << bits_of)])


def holds(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & 1 > 0


def sifted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs without most of those that aren't trusted (a bitmap of doc_id's hashes), so that their texts don't travel to the join."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITMAP)

    def run(table: pa.Table) -> pa.Table:
        places = table.column("place").to_numpy() & (1 << BITMAP - LEAST_BITS) - 1
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([bitmap(places, 1 << BITMAP - LEAST_BITS)])})

    rows = trusted.select(place.alias("place"), F.shiftright(place, BITMAP - LEAST_BITS).cast("int").alias("piece"))
    pieces = rows.groupBy("piece").applyInArrow(run, "piece int, bits binary").collect()  # 2**BITMAP bits in all
    shared = docs.sparkSession.sparkContext.broadcast(whole({r.piece: r.bits for r in pieces}, LEAST_BITS))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(holds(shared.value, b.column("place").to_numpy().view(U))))
            yield b.select(["doc_id", "text"])

    return docs.where("doc_id is not null").select("doc_id", "text", place.alias("place")).mapInArrow(sift, "doc_id bigint, text string")


def shards(values: DataFrame, bits_of: int) -> DataFrame:
    """shard (the first bits_of bits of a key), keys (sorted hashes with their values), bits (the shard's piece of the bitmap): written tables."""

    def run(table: pa.Table) -> pa.Table:
        key, value = table.column("key").to_numpy().view(U), table.column("value").to_numpy()
        order = np.argsort(key)
        bits = bitmap((key >> U(64 - BITMAP)) & U((1 << BITMAP - bits_of) - 1), 1 << BITMAP - bits_of)
        return pa.table({"shard": pa.array(table.column("shard").to_pylist()[:1], pa.int32()), "keys": pa.array([pack(key[order], value[order])], pa.binary()), "bits": pa.array([bits], pa.binary())})

    shard = F.shiftrightunsigned("key", 64 - bits_of).cast("int")
    rows = values.select("key", "value", shard.alias("shard"))
    return in_rounds(lambda part: part.groupBy("shard").applyInArrow(run, "shard int, keys binary, bits binary"), rows, F.col("shard"), 16 * rows.count(), "values")


def rounds_of(size: int) -> int:
    return min(MOST_ROUNDS, int(size // ROUND_BYTES) + 1)


def in_rounds(make: Callable[[DataFrame], DataFrame], rows: DataFrame, by: Column, size: int, name: str) -> DataFrame:
    """What make() gives of all rows, as written tables: of the rows of a round at a time, chosen by the number by."""
    out, n = None, rounds_of(size)
    for k in range(n):
        done = settled(lambda k=k: make(rows.where(F.pmod(by, F.lit(n)) == k)), rows.sparkSession, name)
        out = done if out is None else out.unionByName(done)
    return out


def requests(docs: DataFrame, bits: np.ndarray, bits_of: int, groups: int, order: int) -> DataFrame:
    """For each map task's part of the documents and each shard the keys that the bitmap has, with places of documents and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2**BITMAP bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, size, rows = TaskContext.get().partitionId(), 0, 0, 0
        keys, docs_of, meta = [], [], []

        def flush() -> pa.RecordBatch:
            key, doc = np.concatenate(keys), np.concatenate(docs_of)
            order = np.argsort(key, kind="stable")  # documents stay in order
            key, doc = key[order], doc[order]
            edge = np.ones(len(key), bool)
            edge[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(edge)
            n = np.diff(np.append(at, len(key))).astype(np.uint32)
            key, doc = key[at], doc[at]
            cut = np.searchsorted(key >> U(64 - bits_of), np.arange((1 << bits_of) + 1, dtype=U))
            part, out = task << 24 | seq, []
            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if a < b:
                    u, inv = np.unique(key[a:b], return_inverse=True)
                    out.append((task % groups, s, part, rows, pack(u), pack(inv.astype(U) * U(rows) + doc[a:b], n[a:b])))
            out.append((task % groups, 0, part, rows, pack_rows(pa.Table.from_batches(meta).combine_chunks()), None))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SENT_ROWS.types, strict=True)], schema=SENT_ROWS)

        for b in slices(batches, step=1 << 20):
            h, ptr = token_hashes(b.column("text"))
            doc = np.repeat(np.arange(b.num_rows, dtype=U) + U(rows), np.diff(ptr))
            for k in range(1, order + 1):
                at, key, _ = ngrams(h, ptr, k)
                if k == 1:  # a start is no word, but a context
                    at, key = np.arange(len(h)), prefix(np.zeros(len(h), U), h)
                here = holds(shared.value, key >> U(64 - BITMAP))
                keys.append(key[here]), docs_of.append(doc[at[here]])
                size += int(here.sum())
            meta.append(pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "print")), pa.array(np.diff(ptr) - 1, pa.int64())], names=["doc_id", "lang", "print", "n_tokens"]))
            rows += b.num_rows
            if size > 600_000:
                yield flush()
                seq, size, rows = seq + 1, 0, 0
                keys.clear(), docs_of.clear(), meta.clear()
        if rows:
            yield flush()
        keys.clear(), docs_of.clear(), meta.clear()
        trim()

    return docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("print")).mapInArrow(run, SENT)


def _answer(sent: pa.Table, model: pa.Table) -> pa.Table:
    out = []
    key, value = unpack(model.column("keys")[0].as_py(), "f8") if model.num_rows else (np.zeros(0, U), np.zeros(0))
    for part, n, keys, refs in zip(*(sent.column(c) for c in ("part", "docs", "keys", "refs")), strict=True):
        if not refs.is_valid:
            out.append((part.as_py(), True, keys.as_py()))
            continue
        asked, n = unpack(keys.as_py())[0], n.as_py()
        place, count = unpack(refs.as_py(), "u4")
        at = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
        v = np.where(key[at] == asked, value[at], 0.0) if len(key) else np.zeros(len(asked))
        sums = np.bincount((place % U(n)).astype(np.int64), v[(place // U(n)).astype(np.int64)] * count, n)
        out.append((part.as_py(), False, zstandard.ZstdCompressor(level=1).compress(sums.tobytes())))
    del key, value
    trim()
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(SUM_ROWS.types)], schema=SUM_ROWS)


def _total(table: pa.Table) -> pa.Table:
    rows, total = None, 0.0
    for meta, blob in sorted(zip(table.column("meta").to_pylist(), table.column("blob").to_pylist(), strict=True)):  # one order of summation
        if meta:
            rows = unpack_rows(blob)
        else:
            total = total + np.frombuffer(zstandard.ZstdDecompressor().decompress(blob))
    return pa.Table.from_arrays([*rows.columns, pa.array(np.broadcast_to(total, rows.num_rows), pa.float64())], schema=ROWS)


def learned(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, int, float] | None:
    """What scored() takes, of docs' texts. None without texts."""
    if (model := train(docs, order)) is None:
        return None
    bits_of = shard_bits(model[0])
    kept = shards(model[0], bits_of)
    discard(model[0])
    return kept, bits_of, model[1]


def shard_bits(values: DataFrame) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (values.count() // SHARD_KEYS).bit_length()))


def log_probabilities(docs: DataFrame, values: DataFrame, unseen: float, order: int = ORDER, group_bytes: int = 512 << 20) -> DataFrame:
    """doc_id, lang, print (of the text), n_tokens, log10_prob for each row of docs (doc_id, lang, text)."""
    bits_of = shard_bits(values)
    return scored(docs, shards(values, bits_of), bits_of, unseen, order, group_bytes)


def scored(docs: DataFrame, model: DataFrame, bits_of: int, unseen: float, order: int = ORDER, group_bytes: int = 512 << 20) -> DataFrame:
    """log_probabilities() with a model of shards."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(size // rounds_of(size) // (group_bytes << bits_of - LEAST_BITS)) + 1  # the same bytes a task, whatever the number of shards
    pieces = {r.shard: r.bits for r in model.select("shard", "bits").collect()}  # 2**BITMAP bits in all
    bits = whole(pieces, bits_of)

    def of(docs: DataFrame) -> DataFrame:
        told = model.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "shard", "keys")
        sums = requests(docs, bits, bits_of, groups, order).groupBy("grp", "shard").cogroup(told.groupBy("grp", "shard")).applyInArrow(_answer, SUMS)
        out = sums.groupBy("part").applyInArrow(_total, RESULT)
        return out.select("doc_id", "lang", "print", "n_tokens", ((F.col("log_sum") + F.col("n_tokens") * unseen) / float(np.log(10))).alias("log10_prob"))

    return in_rounds(of, docs, F.xxhash64("doc_id", "text"), size, "scores")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, margin: float = 0.1, least: int = 30, by_text: bool = False) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold, rejected for each row of docs (doc_id, text, lang).

    trusted: doc_id of documents whose text is trusted. margin: added to the quantile of log10 perplexity. by_text: also print, xxhash64 of
    the text, which tells rows apart that share a doc_id.
    """
    return settled(lambda: _classify(docs, trusted, quantile, margin, least, by_text), docs.sparkSession, "quality")


def _classify(docs: DataFrame, trusted: DataFrame, quantile: float, margin: float, least: int, by_text: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    trusted = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    u = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    size = docs.select("doc_id", F.octet_length("text").alias("size")).join(trusted, "doc_id", "left_semi").agg(F.sum("size")).first()[0] or 0
    # one half of all trusted documents is learned, the other sets the thresholds
    model = learned(sifted(docs.where((u < 0.5) & F.col("text").isNotNull()), trusted).join(trusted, "doc_id", "left_semi")) if size else None
    if model is None:
        nothing = F.lit(None).cast("double")
        count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        return docs.select("doc_id", "lang", count.cast("long").alias("n_tokens"), nothing.alias("log10_prob"), nothing.alias("perplexity"), nothing.alias("threshold"), F.lit(False).alias("rejected"), *[F.xxhash64("text").alias("print")] * by_text)
    out = scored(docs, *model)
    out = written(out.withColumn("level", -F.col("log10_prob") / F.col("n_tokens")), spark, "perplexity")
    held = out.where(u >= 0.5).join(trusted, "doc_id", "left_semi").where("n_tokens > 1")
    cut = F.percentile_approx("level", quantile, 100_000)
    every = held.agg(cut).first()[0]
    own = held.groupBy("lang").agg(F.when(F.count(F.lit(1)) >= least, cut).alias("cut"))
    limit = F.coalesce("cut", F.lit(every).cast("double")) + margin
    out = out.join(own, "lang", "left").withColumn("limit", limit)
    return out.select("doc_id", "lang", "n_tokens", "log10_prob", F.pow(F.lit(10.0), "level").alias("perplexity"), F.pow(F.lit(10.0), "limit").alias("threshold"), F.coalesce((F.col("level") > F.col("limit")) & (F.col("n_tokens") > 1), F.lit(False)).alias("rejected"), *["print"] * by_text)
