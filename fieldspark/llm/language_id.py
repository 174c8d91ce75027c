"""Language identification with interpolated Kneser-Ney character models.

For each language one order-4 model over letters (other characters count as one space) is counted on a bounded sample of labelled
documents; counts of lower orders are continuation counts. The union of all languages' n-grams lies in sorted arrays of 64-bit
keys, with one column of log probabilities for each language, so one search serves all of them. A text goes to the language with
the lowest cross-entropy per character. The score is a softmax of the length-normalised evidence, with a temperature fitted on
sampled documents that the models didn't see; those also give the cross-entropy beyond which a prediction counts as rejected.

Bounds (parameters): at most per_language sampled documents for each language, and at most total in all.
A null text, or one without letters, gives `und` with score 0. Without any labelled row every prediction is `und`. Repeated rows and
ties (the alphabetically first language wins) are harmless; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, slices

ORDER = 4
RESULT = "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean, n_letters bigint"
ROWS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_()), ("n_letters", pa.int64())])
_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> lower-case letter, 32 for anything else; made from Unicode's own classes."""
    if not _TABLE:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(t)
    return _TABLE[0]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, each text with a space before it, runs of spaces as one; offsets; letters by text."""
    data, offs = buffers(texts)
    n = len(offs) - 1
    lead = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))
    at = lead[offs]
    cps = letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)] if len(data) else np.zeros(0, np.uint32)
    cps = np.insert(cps, at[:-1], 32)
    at = at + np.arange(n + 1)
    space = cps == 32
    keep = np.ones(len(cps), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1]] = True
    kept = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[at]
    let = np.concatenate((np.zeros(1, np.int64), np.cumsum(~space)))[at]
    return cps[keep], kept, np.diff(let)


def codes(cps: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """16 bits for each character: its place in the sorted alphabet, or one code for all others."""
    at = np.minimum(np.searchsorted(alphabet, cps), max(len(alphabet) - 1, 0))
    return np.where(alphabet[at] == cps, at + 2, 1).astype(np.uint64) if len(alphabet) else np.ones(len(cps), np.uint64)


def grams(code: np.ndarray, k: int) -> np.ndarray:
    """Exact keys of the k characters that end at each place (0 stands before the first)."""
    out = code.copy()
    for j in range(1, k):
        out[j:] |= code[:-j] << np.uint64(16 * j)
    return out


def kneser_ney(keys: np.ndarray, counts: np.ndarray, vocabulary: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From order-4 counts: for each order sorted keys with log p, and contexts with the log weight of the lower order."""
    levels = [(keys, counts.astype(float))]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        u, c = np.unique(levels[-1][0] & np.uint64((1 << (16 * k)) - 1), return_counts=True)
        levels.append((u, c.astype(float)))
    out, lower = [], None
    for k, (u, c) in enumerate(levels[::-1], 1):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx, inv = np.unique(u >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(inv, c), np.bincount(inv)
        gamma = d * kinds / total
        base = np.full(len(u), 1 / vocabulary) if lower is None else lower[1][np.searchsorted(lower[0], u & np.uint64((1 << (16 * (k - 1))) - 1))]
        p = (c - d) / total[inv] + gamma[inv] * base
        lower = (u, p)
        out.append((u, np.log(p), ctx, np.log(gamma)))
    return out


class Models:
    """All languages' models over the union of their n-grams."""

    def __init__(self, langs: list[str], alphabet: np.ndarray, each: list[list[tuple]]):
        self.langs, self.alphabet, self.tables = langs, alphabet, []
        floor = -np.log(len(alphabet) + 2)
        lower = None
        for k in range(ORDER):
            u = np.unique(np.concatenate([m[k][0] for m in each]))
            ctx = np.unique(np.concatenate([m[k][2] for m in each]))
            gamma = np.zeros((len(ctx), len(langs)), np.float32)
            logp = np.full((len(u), len(langs)), floor, np.float32)
            for j, m in enumerate(each):
                gamma[np.searchsorted(ctx, m[k][2]), j] = m[k][3]
            if lower is not None:  # a language that lacks the n-gram backs off
                logp = gamma[np.searchsorted(ctx, u >> np.uint64(16))] + self.look(lower, u & np.uint64((1 << (16 * k)) - 1), k)
            else:
                logp += gamma[0]
            for j, m in enumerate(each):
                logp[np.searchsorted(u, m[k][0]), j] = m[k][1]
            self.tables.append((u, logp, ctx, gamma))
            lower = k

    def look(self, k: int, keys: np.ndarray, order: int) -> np.ndarray:
        """log p of n-grams of the order, by language."""
        u, logp, ctx, gamma = self.tables[order - 1]
        at = np.minimum(np.searchsorted(u, keys), len(u) - 1)
        out = logp[at]
        miss = np.flatnonzero(u[at] != keys)
        if len(miss):
            key = keys[miss]
            if order == 1:
                low = np.full((len(miss), len(self.langs)), -np.log(len(self.alphabet) + 2), np.float32)
            else:
                low = self.look(order - 1, key & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
            c = key >> np.uint64(16)
            at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            out[miss] = low + np.where((ctx[at] == c)[:, None], gamma[at], np.float32(0))
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy (nats a character) by text and language; characters; letters."""
        cps, ptr, let = characters(texts)
        key = grams(codes(cps, self.alphabet), ORDER)
        inner = np.ones(len(cps), bool)  # the space before a text isn't predicted; contexts end at it
        inner[ptr[:-1]] = False
        for j in range(1, ORDER):
            first = ptr[:-1] + j
            first = first[first < ptr[1:]]
            key[first] &= np.uint64((1 << (16 * (j + 1))) - 1)
        places = np.flatnonzero(inner)
        ends = np.searchsorted(places, ptr)
        total = np.zeros((len(ptr) - 1, len(self.langs)))
        full = ends[1:] > ends[:-1]
        if full.any():
            total[full] = np.add.reduceat(self.look(0, key[places], ORDER).astype(np.float64), ends[:-1][full], axis=0)
        n = np.maximum(np.diff(ends), 1)
        return -total / n[:, None], np.diff(ends), let


def count(texts: pa.Array, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cps, ptr, _ = characters(texts)
    key = grams(codes(cps, alphabet), ORDER)
    inner = np.ones(len(cps), bool)
    inner[ptr[:-1]] = False
    for j in range(1, ORDER):
        first = ptr[:-1] + j
        first = first[first < ptr[1:]]
        key[first] &= np.uint64((1 << (16 * (j + 1))) - 1)
    return np.unique(key[inner], return_counts=True)


def sample(labelled: DataFrame, per_language: int, total: int) -> pa.Table:
    """Evenly hashed labelled rows, at most per_language of each language and total in all; a language's rows never meet in one task."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(total).collect()}
    most = max(2, min(per_language, total // max(1, len(sizes))))
    parts = [F.when(F.col("lang") == F.lit(k), F.lit(min(1.0, 1.5 * most / n))) for k, n in sizes.items()]
    if not parts:
        return pa.table({"lang": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    u = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    got = labelled.withColumn("u", u).where(F.col("u") < F.coalesce(*parts)).select("lang", "u", "text").toArrow().sort_by([("lang", "ascending"), ("u", "ascending"), ("text", "ascending")])
    lang, keep, seen = got.column("lang").to_pylist(), [], {}
    for i, k in enumerate(lang):
        seen[k] = seen.get(k, 0) + 1
        if seen[k] <= most:
            keep.append(i)
    return got.take(pa.array(keep, pa.int64()))


def train(labelled: DataFrame, per_language: int = 400, total: int = 4000) -> tuple[Models | None, float, float]:
    """Models, temperature, and the cross-entropy beyond which a prediction is rejected."""
    rows = sample(labelled, per_language, total).combine_chunks()
    if not rows.num_rows:
        return None, 1.0, 0.0
    text = rows.column("text").combine_chunks()
    lang = np.array(rows.column("lang").to_pylist(), object)
    langs = sorted(set(lang))
    alphabet = np.unique(characters(text)[0])[:60_000]

    def fit(mask: np.ndarray) -> Models:
        return Models(langs, alphabet, [kneser_ney(*count(text.filter(pa.array(mask & (lang == k))), alphabet), len(alphabet) + 2) for k in langs])

    held = np.arange(rows.num_rows) % 5 == 4
    if any(not (~held & (lang == k)).any() for k in langs):
        held[:] = False
    parts = [count(text.filter(pa.array(~held & (lang == k))), alphabet) for k in langs]
    if any(not len(p[0]) for p in parts):  # a language without a single letter in its sample
        parts = [(np.array([1], np.uint64), np.array([1])) if not len(p[0]) else p for p in parts]
    models = Models(langs, alphabet, [kneser_ney(*p, len(alphabet) + 2) for p in parts])
    ce, n, let = models.score(text.filter(pa.array(held)) if held.any() else text)
    truth = np.searchsorted(np.array(langs, object), lang[held] if held.any() else lang)
    use = let > 0
    best, temperature = np.inf, 1.0
    for t in 0.02 * 2.0 ** np.arange(0, 9):
        p = softmax(ce[use], n[use], t)
        nll = -np.log(np.maximum(p[np.arange(len(p)), truth[use]], 1e-9)).mean() if len(p) else 0
        if nll < best - 1e-6:
            best, temperature = nll, float(t)
    own = ce[use].min(axis=1) if use.any() else np.zeros(1)
    return models, temperature, float(np.quantile(own, 0.999) + 0.25)


def softmax(ce: np.ndarray, n: np.ndarray, t: float) -> np.ndarray:
    z = -(ce - ce.min(axis=1, keepdims=True)) * (t * np.minimum(n, 1000))[:, None]
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, labelled: DataFrame, per_language: int = 400, total: int = 4000) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected, n_letters for each row of docs. labelled: doc_id, text, lang; rows with a null are left out."""
    labelled = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    models, temperature, limit = train(labelled, per_language, total)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, step=1 << 20):
            if m is None:
                n, let = np.zeros(b.num_rows, np.int64), characters(b.column("text"))[2]
                cols = [["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows), [True] * b.num_rows]
            else:
                ce, n, let = m.score(b.column("text"))
                p = softmax(ce, n, temperature)
                best = ce.argmin(axis=1)
                none = let == 0
                names = np.array(m.langs, object)[best]
                names[none] = "und"
                low = np.where(none, 0, ce.min(axis=1))
                cols = [names, np.where(none, 0, p[np.arange(len(p)), best]), low, none | (low > limit)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, ROWS.types[1:5], strict=True)), pa.array(let, pa.int64())], schema=ROWS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
