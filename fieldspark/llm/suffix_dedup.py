"""Repeated passages by a sparse suffix array.

Of a text's suffixes (in words) only those at minimiser positions are kept: the smallest GRAM-word hash of each SPAN consecutive
ones. Any two copies of a passage of `least` words keep the same suffix among their first SPAN words, so they share the `least` - SPAN + 1
words from there on, and that is how far suffixes are compared. A word's symbol is 16 bits of its hash.

1. Suffixes go to ranges of their order (bounds from a sample of them; uneven ones cost balance, never rows). A range's task sorts them
   as word sequences and measures the common prefix of neighbours; equal symbols up to the end make a candidate match.
2. A match is extended left and right: around a matched suffix, each window of `least` words that holds it among its first SPAN words
   is compared, as a whole, with those of other documents (64 and 16 bits of independent hashes of the words), so every alignment of every
   pair counts and not the nearest neighbour's alone. A word belongs to a repeated passage exactly if such a window occurs in another document.

Suffixes and windows travel as sorted blobs for each (range, block of documents), each distinct one once with a mark if two documents of
the block have it; a passage in a third of all documents therefore reaches a range once for each block. Only blocks that hold a match
are told of it.

Nulls: a null text has no words. Rows count as documents, also where they share a doc_id or it is null (the last block). Passages
that repeat inside one document alone don't count. Very long texts are read whole. Ties (equal suffixes) are one entry. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, buffers, covered, inside, mix, pack, slices, unpack, unpack_rows, window_hashes, word_hashes, words, written
from .substring_dedup import _cut, blocks_of, layout

GRAM, SPAN = 8, 20
SENT = "bucket int, block int, blob binary"
SENT_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
RESULT = "doc_id bigint, n_words bigint, n_repeated bigint, spans array<struct<start:bigint,length:bigint>>"
RESULT_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_repeated", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def extreme(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each n consecutive elements, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def minimisers(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Places of the kept suffixes. A text with fewer than SPAN grams keeps none: no passage fits."""
    g = window_hashes(h, GRAM)
    if len(g) < SPAN:
        return np.zeros(0, np.int64)
    low = extreme(g, SPAN, np.minimum)
    low = np.where(inside(ptr, GRAM + SPAN - 1)[: len(low)], low, U(0))
    top = extreme(np.concatenate((np.zeros(SPAN - 1, U), low, np.zeros(SPAN - 1, U))), SPAN, np.maximum)
    return np.flatnonzero((top == g) & (top > 0))


def both(h: np.ndarray, check: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(h, n), window_hashes(check, n).astype(np.uint16)


def symbols(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Suffixes as rows of 16-bit symbols for n words, four to a number, so that numbers from left to right give their order."""
    wide = np.zeros((len(at), -(-n // 4) * 4), ">u2")
    if len(at):
        wide[:, :n] = np.lib.stride_tricks.sliding_window_view((h >> U(48)).astype(">u2"), n)[at]
    return wide.view(">u8").astype(U)


def digest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 bits of each suffix, for the way back."""
    h = c = np.zeros(len(rows), U)
    for k in range(rows.shape[1]):
        h, c = mix(h + rows[:, k]), mix((c ^ rows[:, k]) * U(0x9E3779B97F4A7C15) + U(1))
    return h, c.astype(np.uint16)


def ordered(rows: np.ndarray, *last: np.ndarray) -> np.ndarray:
    return np.lexsort((*last, *rows.T[::-1]))


def common(rows: np.ndarray, n: int) -> np.ndarray:
    """The common prefix of each suffix with the next one, in words."""
    same = rows[1:].astype(">u8").view(">u2")[:, :n] == rows[:-1].astype(">u8").view(">u2")[:, :n]
    return np.where(same.all(1), n, same.argmin(1))


def distinct(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (hash, check) with 1 where two documents have it."""
    order = np.lexsort((doc, c, h))
    h, c, doc = h[order], c[order], doc[order]
    if not len(h):
        return h, c, np.zeros(0, np.uint8)
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(h)) - 1
    return h[at], c[at], (doc[at] != doc[last]).astype(np.uint8)


class Sender:
    """Collects (hash, check, document) by block and sends sorted blobs by bucket."""

    def __init__(self, bits: int):
        self.bits, self.held, self.size, self.docs = bits, {}, 0, 0

    def add(self, block: int, h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> None:
        self.held.setdefault(block, []).append((h, c, doc))
        self.size += len(h)

    def flush(self) -> Iterator[tuple]:
        for block, parts in sorted(self.held.items()):
            h, c, two = distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield from ((k, block, pack(h[s], c[s], two[s])) for k, s in _cut(h, self.bits))
        self.held, self.size = {}, 0


class SuffixSender:
    """Collects suffixes by block and sends them in order, by range."""

    def __init__(self, bounds: np.ndarray, n: int):
        self.bounds, self.n, self.held, self.size = bounds, n, {}, 0

    def add(self, block: int, rows: np.ndarray, doc: np.ndarray) -> None:
        self.held.setdefault(block, []).append((rows, doc))
        self.size += len(rows)

    def flush(self) -> Iterator[tuple]:
        for block, parts in sorted(self.held.items()):
            rows, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = ordered(rows, doc)
            rows, doc = rows[order], doc[order]
            if len(rows):
                at = np.flatnonzero(np.concatenate(([True], common(rows, self.n) < self.n)))
                two = (doc[at] != doc[np.append(at[1:], len(doc)) - 1]).astype(np.uint8)
                rows = rows[at]
                cut = [0, *np.searchsorted(rows[:, 0], self.bounds), len(rows)]
                yield from ((k, block, pack(rows[a:b, 0], *rows[a:b, 1:].T, two[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b)
        self.held, self.size = {}, 0


def _suffix_array(n: int):
    def run(table: pa.Table) -> pa.Table:
        """One range: every block's suffixes in one order. Those with an equal neighbour are told to the blocks that have them."""
        width, hits = -(-n // 4), []
        parts = [unpack(x.as_py(), *["u8"] * (width - 1), "u1") for x in table.column("blob")]
        rows = np.concatenate([np.stack(p[:-1], 1) for p in parts])
        two = np.concatenate([p[-1] for p in parts]) > 0
        of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = ordered(rows)
        equal = common(rows[order], n) >= n
        hit = two
        hit[order[1:]] |= equal
        hit[order[:-1]] |= equal
        # equal suffixes with a block that has two documents among them
        group = np.concatenate(([0], np.cumsum(~equal)))
        hit[order] |= (np.bincount(group, two[order]) > 0)[group]
        blocks = table.column("block").to_pylist()
        for i in np.unique(of[hit]):
            h, c = digest(rows[hit & (of == i)])
            order = np.lexsort((c, h))
            hits.append((table.column("bucket")[0].as_py(), blocks[i], pack(h[order], c[order])))
        return pa.Table.from_arrays([pa.array([r[i] for r in hits], t) for i, t in enumerate(SENT_ROWS.types)], schema=SENT_ROWS)

    return run


def _neighbours(table: pa.Table) -> pa.Table:
    """One bucket: every block's entries sorted together; those that meet an equal neighbour are told to the blocks that have them."""
    bucket = table.column("bucket")[0].as_py()
    parts = [unpack(x.as_py(), "u2", "u1") for x in table.column("blob")]
    h, c, two = (np.concatenate(x) for x in zip(*parts, strict=True))
    of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((c, h))
    sh, sc = h[order], c[order]
    same = (sh[1:] == sh[:-1]) & (sc[1:] == sc[:-1])
    group = np.concatenate(([0], np.cumsum(~same)))
    many = (np.bincount(group) > 1) | (np.bincount(group, two[order]) > 0)
    hit = np.zeros(len(h), bool)
    hit[order[many[group]]] = True
    rows = []
    blocks = table.column("block").to_pylist()
    for i, p in enumerate(parts):
        m = hit[of == i]
        if m.any():
            rows.append((bucket, blocks[i], pack(p[0][m], p[1][m])))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(SENT_ROWS.types)], schema=SENT_ROWS)


class Known:
    """Membership in what a block was told."""

    def __init__(self, blobs: pa.ChunkedArray):
        parts = [unpack(x.as_py(), "u2") for x in blobs]
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U), np.zeros(0, np.uint16))
        order = np.lexsort((c, h))
        self.h, self.c = h[order], c[order]

    def holds(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if len(self.h):
            at = np.searchsorted(self.h, h)
            for step in range(4):  # a fingerprint with several checks is as rare as a false match
                near = np.minimum(at + step, len(self.h) - 1)
                out |= (self.h[near] == h) & (self.c[near] == c)
        return out


def around(places: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a suffix among their first SPAN words, inside one text."""
    mark = np.zeros(len(ok) + 1, np.int32)
    np.add.at(mark, np.maximum(places - SPAN + 1, 0), 1)
    np.add.at(mark, np.minimum(places + 1, len(ok)), -1)
    return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & ok)


def repeated(docs: DataFrame, least: int = 50, block_bytes: int = 8 << 20, most_sampled: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_repeated, spans (in words) of the documents that share a passage of so many words with another one."""
    if least < SPAN + GRAM:
        raise ValueError(f"least must be {SPAN + GRAM} words or more")
    key = least - SPAN + 1
    blocks, buckets, _ = layout(docs, block_bytes, 1)
    bits = buckets.bit_length() - 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession

    def rows_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(SENT_ROWS.types)], schema=SENT_ROWS)

    def suffixes(b) -> tuple:
        data, offs = buffers(b.column("text"))
        s, e, ptr = words(data, offs)
        h = word_hashes(data, s, e)
        at = minimisers(h, ptr)
        at = at[at < max(len(h) - key + 1, 0)]
        at = at[inside(ptr, key)[at]]
        return h, word_hashes(data, s, e, seed=1), ptr, at, symbols(h, at, key)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            first = suffixes(b)[-1][:, 0]
            yield pa.RecordBatch.from_arrays([pa.array((first ^ U(1 << 63)).view(np.int64))], names=["first"])  # signed, in the same order

    # about most_sampled suffixes of evenly hashed documents
    rate = min(1.0, most_sampled * 64 / max(1, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1))
    some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= int(rate * (1 << 30))).mapInArrow(sampled, "first bigint")
    steps = [k / buckets for k in range(1, buckets)]
    at = some.agg(F.percentile_approx("first", steps, 20 * buckets)).first()[0] or []
    ranges = np.unique(np.array(at, np.int64).view(U) ^ U(1 << 63))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send, doc = SuffixSender(ranges, key), 0
        for b in slices(batches):
            _, _, ptr, at, rows = suffixes(b)
            row = np.searchsorted(ptr, at, "right") - 1
            of = blocks.of(b)[row]
            for block in np.unique(of):
                m = of == block
                send.add(int(block), rows[m], row[m] + doc)
            doc += b.num_rows
            if send.size > 600_000 and (out := list(send.flush())):
                yield rows_of(out)
        if out := list(send.flush()):
            yield rows_of(out)

    def extend(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not (docs.num_rows and told.num_rows):
            return SENT_ROWS.empty_table()
        known, send, doc = Known(told.column("blob")), Sender(bits), 0
        for blob in docs.column("blob"):
            for b in slices(unpack_rows(blob.as_py()).to_batches()):
                h, check, ptr, at, rows = suffixes(b)
                starts = around(at[known.holds(*digest(rows))], inside(ptr, least))
                w, wc = both(h, check, least)
                send.add(docs.column("block")[0].as_py(), w[starts], wc[starts], np.searchsorted(ptr, starts, "right") - 1 + doc)
                doc += b.num_rows
        return pa.Table.from_batches([rows_of(list(send.flush()))])

    def mark(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not (docs.num_rows and told.num_rows):
            return RESULT_ROWS.empty_table()
        known, out = Known(told.column("blob")), []
        for blob in docs.column("blob"):
            for b in slices(unpack_rows(blob.as_py()).to_batches()):
                data, offs = buffers(b.column("text"))
                s, e, ptr = words(data, offs)
                h = word_hashes(data, s, e)
                ok = np.flatnonzero(inside(ptr, least))
                w, wc = both(h, word_hashes(data, s, e, seed=1), least)
                starts = ok[known.holds(w[ok], wc[ok])]
                got = covered(starts, least, len(s))
                for k in np.unique(np.searchsorted(ptr, starts, "right") - 1):
                    mine = np.concatenate(([False], got[ptr[k] : ptr[k + 1]], [False]))
                    edge = np.flatnonzero(mine[1:] != mine[:-1])
                    out.append((b.column("doc_id")[int(k)].as_py(), int(ptr[k + 1] - ptr[k]), int(mine.sum()), [{"start": int(x), "length": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)]))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(RESULT_ROWS.types)], schema=RESULT_ROWS)

    told = written(texts.mapInArrow(first, SENT).groupBy("bucket").applyInArrow(_suffix_array(key), SENT), spark, "suffixes", "snappy")
    sent = blocks_of(texts, blocks).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(extend, SENT)
    told = written(sent.groupBy("bucket").applyInArrow(_neighbours, SENT), spark, "windows", "snappy")
    return blocks_of(texts, blocks).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(mark, RESULT)
