"""Packing of tokenised documents into sequences of a fixed length: bounded-space online best fit.

Each partition keeps a fixed number of open sequences. A document (what remains of it after whole sequences are cut from it) goes to
the open sequence with the smallest sufficient gap; when none fits and no more may be opened, the fullest is emitted and a new one
opened for the document, which stays whole. The gap of an emitted sequence is filled from one document held in reserve, the only one
that is cut: the rest of a long document, or else the one that didn't fit. So emitted sequences carry no padding (fill=False: no
reserve, and their gaps are padding). What is open or in reserve when a partition ends goes, with its tokens, to a second step that
merges the leftovers of a bounded number of partitions: placed anew, then the emptiest are cut to fill the fullest.

Tokens come from a tokenizer file, one distinct word at a time: the vocabulary's pre-tokeniser never joins what white space
separates, nor an ASCII letter with the ASCII punctuation behind it, so a text's ids are those of its pieces in turn. Texts of
special tokens are ordinary text. A null text is empty: its only id is the end id. Rows that share a doc_id are packed one by one.
A null doc_id stays null. Columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, buffers, slices, written

COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, leftover boolean, part int"
ROWS = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("leftover", pa.bool_()), ("part", pa.int32())])
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: ASCII punctuation but for the apostrophe, which begins contractions.
POINT = np.zeros(256, bool)
POINT[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MARK = "\x00"


class Words:
    """Ids of distinct words, kept in two generations of bounded size."""

    def __init__(self, path: str, most: int = 350_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.most, self.young, self.old = most, {}, {}
        self.mark = self.tok.encode(MARK, add_special_tokens=False).ids

    def _encode(self, new: list[str]) -> list[bytes]:
        """Many words as one text, a mark between; one by one where a word has the mark or the marks don't come out."""
        if len(self.mark) == 1 and not any(MARK in w for w in new):
            ids = np.array(self.tok.encode(f" {MARK} ".join(new), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark[0])
            if len(cut) == len(new) - 1:
                return [x.tobytes() for x in (ids[a:b] for a, b in zip([0, *(cut + 1)], [*cut, len(ids)], strict=True))]
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tok.encode_batch(new, add_special_tokens=False)]

    def ids(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out = [young.get(w) or old.get(w) for w in words]
        missing = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(missing), 2000):
            part = missing[at : at + 2000]
            for k, x in zip(part, self._encode([words[k] for k in part]), strict=True):
                out[k] = x
        young.update(zip(words, out, strict=True))
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out


_WORDS: dict[str, Words] = {}


def tokens(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text's end id included, and where each text's ids begin (one more at the end)."""
    w = _WORDS.get(path) or _WORDS.setdefault(path, Words(path))
    data, offs = buffers(texts)
    n = len(data)
    if n:
        data = LOWER[data]
        word = ~SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1] | (LETTER[data[:-1]] & POINT[data[1:]])
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        first |= edge[:-1] & word
        starts = np.flatnonzero(first)
    else:
        starts = np.zeros(0, np.int64)
    ptr = np.searchsorted(starts, offs)
    if len(starts):
        s = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, n)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pc.dictionary_encode(s)
        # a piece holds the white space behind it; the ids don't depend on it
        names = [x.rstrip(" \t\n\r\x0b\x0c") for x in coded.dictionary.to_pylist()]
        blobs, index = w.ids(names), coded.indices.to_numpy()
    else:
        blobs, index = [], np.zeros(0, np.int64)
    blobs = [*blobs, np.array([end_id], np.uint32).tobytes()]
    index = np.insert(index.astype(np.int64), ptr[1:], len(blobs) - 1)
    size = np.array([len(x) // 4 for x in blobs], np.int64)
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)[:-1]))
    flat = np.frombuffer(b"".join(blobs), np.uint32)
    each = size[index]
    ends = np.cumsum(each)
    ids = flat[np.repeat(at[index] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
    per = np.concatenate((np.zeros(1, np.int64), ends))
    return ids, per[ptr + np.arange(len(ptr))]


class Packer:
    """Open sequences of one partition and the document in reserve. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, open_most: int, first_id: int, fill: bool = True):
        self.length, self.most, self.next, self.fill = length, open_most, first_id, fill
        self.open, self.done, self.reserve = [], [], None

    def _emit(self, pieces: list) -> None:
        self.done.append((self.next, pieces))
        self.next += 1

    def _place(self, w: list, piece: tuple) -> None:
        w[1].append(piece)
        w[0] -= len(piece[2])
        if not w[0]:
            self.open = [x for x in self.open if x is not w]
            self._emit(w[1])

    def _from_reserve(self, w: list) -> None:
        """Tokens of the reserve into the gap of w, as far as both go."""
        doc_id, start, ids, total = self.reserve
        n = min(w[0], len(ids))
        self.reserve = (doc_id, start + n, ids[n:], total) if n < len(ids) else None
        self._place(w, (doc_id, start, ids[:n], total))

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self._emit([(doc_id, start, ids[: self.length], total)])
            ids, start = ids[self.length :], start + self.length
        if not len(ids):
            return
        piece = (doc_id, start, ids, total)
        if self.fill and self.reserve is None and len(ids) < total:
            self.reserve = piece
            return
        fits = [w for w in self.open if w[0] >= len(ids)]
        if fits:
            self._place(min(fits, key=lambda w: w[0]), piece)
            return
        if len(self.open) == self.most:
            fullest = min(self.open, key=lambda w: w[0])
            if not self.fill:
                self.open = [w for w in self.open if w is not fullest]
                self._emit(fullest[1])
            else:
                if self.reserve is not None:
                    self._from_reserve(fullest)
                if fullest[0]:
                    self.reserve = piece
                    self._from_reserve(fullest)
                    return
        self.open.append(w := [self.length, []])
        self._place(w, piece)

    def finish(self) -> None:
        """Emits all that is open: the reserve and the pieces of the emptiest sequences fill the gaps of the fullest."""
        while self.open:
            fullest = min(self.open, key=lambda w: w[0])
            while self.fill and fullest[0] and (self.reserve is not None or len(self.open) > 1):
                if self.reserve is None:
                    emptiest = max((w for w in self.open if w is not fullest), key=lambda w: w[0])
                    self.reserve = emptiest[1].pop()
                    emptiest[0] += len(self.reserve[2])
                    if not emptiest[1]:
                        self.open = [w for w in self.open if w is not emptiest]
                self._from_reserve(fullest)
            if fullest[0]:
                self.open = [w for w in self.open if w is not fullest]
                self._emit(fullest[1])
        if self.reserve is not None:
            self._emit([self.reserve])
            self.reserve = None

    def rows(self, leftover: bool, part: int, with_ids: bool) -> pa.RecordBatch:
        """The finished sequences, or what is still open or in reserve."""
        sequences = [(-1, w[1]) for w in self.open] + [(-1, [self.reserve])] * (self.reserve is not None) if leftover else self.done
        out = []
        for sid, pieces in sequences:
            at = 0
            for doc_id, start, ids, total in pieces:
                raw = ids.astype("<u4").tobytes()
                out.append((doc_id, start, len(ids), zlib.crc32(raw), total, sid, at, raw if with_ids or leftover else None, leftover, part))
                at += len(ids)
        if not leftover:
            self.done = []
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(ROWS.types), ROWS.types, strict=True)], schema=ROWS)


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, open_most: int = 8, merge: int = 16, with_ids: bool = False, fill: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids (uint32).

    open_most: open sequences in a partition. merge: partitions whose leftovers meet in one task.
    fill: False packs by the placing rule alone, which cuts no document shorter than a sequence and pads what it emits.
    Very long texts are tokenised whole and cut into whole sequences first; ties between equal gaps go to the sequence opened first.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        p = Packer(length, open_most, part << 32, fill)
        for b in slices(batches, step=8 << 20):
            for c in slices([b], step=1 << 20) if b.num_rows < 2 else [b]:
                ids, ptr = tokens(c.column("text"), tokenizer, end_id)
                for k, doc_id in enumerate(c.column("doc_id").to_pylist()):
                    p.add(doc_id, 0, ids[ptr[k] : ptr[k + 1]].copy() if ptr[k + 1] - ptr[k] < length else ids[ptr[k] : ptr[k + 1]], int(ptr[k + 1] - ptr[k]))
                yield p.rows(False, part, with_ids)
        yield p.rows(True, part, with_ids)

    def last(key: tuple, table: pa.Table) -> pa.Table:
        p = Packer(length, open_most * merge, (1 << 62) | (int(key[0].as_py()) << 32), fill)
        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["part"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"]))
        for r in rows:
            p.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], np.uint32), r["doc_tokens"])
        p.finish()
        return pa.Table.from_batches([p.rows(False, 0, with_ids)])

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, COLUMNS)
    one = written(one, docs.sparkSession, "pieces")
    rest = one.where("leftover").withColumn("g", F.expr(f"cast(part / {merge} as int)")).groupBy("g").applyInArrow(last, COLUMNS)
    out = one.where("not leftover").unionByName(rest)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
