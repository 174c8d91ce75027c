"""Toxicity scores: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

Features: densities of a weighted lexicon (words and word beginnings), how often its words stand near the second person, capitals,
punctuation, digits, words in capitals, and words that match the lexicon only once obfuscation (digits and signs for letters, dots
inside) is undone. The lexicon is learned from a bounded sample of labelled rows, beside a short fixed list; features of a training
row always come from a lexicon that didn't see the row (cross-fitting), and so do the scores that the isotonic step is fitted on.

Bounds (parameters): most labelled rows and most_bytes of their text are learned from, in the order of a hash of doc_id; a doc_id whose
rows no longer fit is left out. Where labels of a doc_id clash, it counts as toxic. Very long texts are scored whole. A null text counts
as empty; empty texts get the score of their features. Without labelled rows of both kinds every score is the share of label 1 (0 if there
is none). Repeated rows are learned from and scored each. Tied scores share a calibrated value. Other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, buffers, slices, written

RESULT = "doc_id bigint, score double"
ROWS = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
#: Common insults and second-person words of the corpus languages.
INSULTS = "idiot stupid trash loser moron scum worthless disgusting clown dumb pathetic garbage idiota imbécil basura idiote stupide ordure dumm blöd abschaum".split()
SECOND_PERSON = frozenset("you your yours yourself you're u ur du dein deine dir dich ihr euch tu te ton ta tes toi vous votre vos usted ustedes tú ti tus".split())
#: Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "*": "", ".": "", "-": "", "_": ""})
EDGE = ".,!?;:\"'()[]{}|#$%&*<>-_/\\+=~`"
STEMS = (4, 5, 6, 7, 8)
NEAR = 3
FEATURES = 16


def plain(word: str) -> str:
    return word.strip(EDGE).lower()


class Lexicon:
    """Weights (log odds) of words and word beginnings; remembers the features of the words it has seen."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.memo = words, stems, {}

    def weight(self, w: str) -> tuple[float, float]:
        return self.words.get(w, 0.0), max((self.stems.get(w[:k], 0.0) for k in STEMS if len(w) > k), default=0.0)

    def features(self, raw: str) -> tuple:
        """Word weight, stem weight, matches only without obfuscation, second person, capitals, digits mixed in."""
        if (f := self.memo.get(raw)) is None:
            w = plain(raw)
            a, b = self.weight(w)
            hidden = 0.0
            if a <= 0 and not w.isalpha() and w:
                x = raw.strip(".,?;:\"'()").lower().translate(SIGNS)
                c, _ = self.weight(x)
                if c > 0:
                    a, hidden = c, 1.0
            alpha = w.isalpha()
            f = (a, b, hidden, float(w in SECOND_PERSON), float(len(w) > 1 and raw.isupper()), float(not alpha and any(ch.isdigit() for ch in w) and any(ch.isalpha() for ch in w)))
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[raw] = f
        return f


def learn(texts: list[str], labels: np.ndarray, least: int = 3) -> Lexicon:
    """Words and beginnings that label 1 holds far more often than label 0, by the share of documents."""
    seen: list[dict[str, int]] = [{}, {}]
    for t, y in zip(texts, labels, strict=True):
        ws = {plain(x) for x in t.split()}
        for x in ws | {"^" + w[:k] for w in ws for k in STEMS if len(w) > k}:
            seen[y][x] = seen[y].get(x, 0) + 1
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    words, stems = {w: 3.0 for w in INSULTS}, {}
    for x, c in seen[1].items():
        if c >= least:
            odds = np.log((c + 0.5) / (n1 + 1)) - np.log((seen[0].get(x, 0) + 0.5) / (n0 + 1))
            sure = c / n1 - 3 * np.sqrt(max(c, 1)) / n1
            if odds > 1.2 and sure > seen[0].get(x, 0) / n0:
                (stems if x[:1] == "^" else words)[x.lstrip("^")] = float(odds)
    return Lexicon(words, stems)


def features(texts: pa.Array, lex: Lexicon) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    data, offs = buffers(texts)
    docs, n = len(offs) - 1, len(data)
    out = np.zeros((docs, FEATURES))
    sums = lambda mask: np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(mask)))[offs])
    size = np.maximum(np.diff(offs), 1)
    if not n:
        return out
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    point = (data > 32) & (data < 127) & ~(upper | lower | digit)
    for k, m in ((8, upper), (9, point), (10, data == 33), (11, digit)):
        out[:, k] = sums(m) / size
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first |= edge[:-1] & word
    starts = np.flatnonzero(first)
    ptr = np.searchsorted(starts, offs)
    if not len(starts):
        return out
    coded = pc.dictionary_encode(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, n)), pa.py_buffer(np.ascontiguousarray(data))))
    table = np.array([lex.features(x.rstrip(" \t\n\r\x0b\x0c")) for x in coded.dictionary.to_pylist()])
    f = table[coded.indices.to_numpy()]
    per = lambda v: np.diff(np.concatenate((np.zeros(1), np.cumsum(v)))[ptr])
    words = np.maximum(np.diff(ptr), 1)
    hit, stem, you = f[:, 0] > 0, (f[:, 1] > 0) & (f[:, 0] <= 0), f[:, 3] > 0
    out[:, 0] = np.log1p(np.diff(ptr))
    out[:, 1], out[:, 2] = per(hit) / words, np.log1p(per(hit))
    out[:, 3], out[:, 4] = per(stem) / words, np.log1p(per(stem))
    out[:, 5] = per(f[:, 2])
    out[:, 6] = per(you) / words
    of = np.repeat(np.arange(docs), np.diff(ptr))
    close = np.zeros(len(starts), bool)
    at = np.flatnonzero(hit | stem)
    for d in range(-NEAR, NEAR + 1):
        x = at + d
        ok = (x >= 0) & (x < len(starts))
        ok[ok] = you[x[ok]] & (of[x[ok]] == of[at[ok]])
        close[at[ok]] = True
    out[:, 7] = np.log1p(per(close))
    out[:, 12] = per(f[:, 4]) / words
    out[:, 13] = per(f[:, 5]) / words
    full = ptr[1:] > ptr[:-1]
    w = np.maximum(f[:, 0], f[:, 1])
    out[full, 14] = np.maximum.reduceat(w, ptr[:-1][full])
    out[:, 15] = np.log1p(per(w))
    return out


class Trees:
    """Boosted trees for the logistic loss, split on quantile bins; every leaf value is shrunk Newton."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48):
        self.rounds, self.depth, self.rate, self.bins, self.trees, self.base = rounds, depth, rate, bins, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), int), []
            for _ in range(self.depth):
                k = node.max() + 1
                feat, cut = np.zeros(k, int), np.full(k, np.inf)
                tg, th = np.bincount(node, g, k), np.bincount(node, h, k)
                best = np.zeros(k)
                for j, c in enumerate(self.cuts):
                    if not len(c):
                        continue
                    w = len(c) + 1
                    gl = np.cumsum(np.bincount(node * w + b[:, j], g, k * w).reshape(k, w), 1)[:, :-1]
                    hl = np.cumsum(np.bincount(node * w + b[:, j], h, k * w).reshape(k, w), 1)[:, :-1]
                    gr, hr = tg[:, None] - gl, th[:, None] - hl
                    gain = np.where((hl > 1) & (hr > 1), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (tg**2 / (th + 1))[:, None], 0)
                    at = gain.argmax(1)
                    top = gain[np.arange(k), at]
                    m = top > best + 1e-9
                    best[m], feat[m], cut[m] = top[m], j, c[at[m]]
                tree.append((feat, cut))
                node = node * 2 + (x[np.arange(len(y)), feat[node]] > cut[node])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + 1)
            self.trees.append((tree, leaf))
            raw += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), int)
            for feat, cut in tree:
                node = node * 2 + (x[rows, feat[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and non-decreasing values, for linear interpolation."""
    place, of = np.unique(s, return_inverse=True)
    weight = np.bincount(of)
    stack: list[list[float]] = []  # value, weight, first place, last place
    for v, t, w in zip(place, np.bincount(of, y) / weight, weight, strict=True):
        stack.append([float(t), float(w), float(v), float(v)])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[3]
    at = np.array([x for a in stack for x in (a[2], a[3])])
    value = np.array([x for a in stack for x in (a[0], a[0])])
    return at, value


class Scorer:
    def __init__(self, lex: Lexicon, trees: Trees, at: np.ndarray, value: np.ndarray):
        self.lex, self.trees, self.at, self.value = lex, trees, at, value

    def score(self, texts: pa.Array) -> np.ndarray:
        raw = self.trees.raw(features(texts, self.lex))
        # a trace of the uncalibrated score keeps the order inside a step
        return np.clip(0.98 * np.interp(raw, self.at, self.value) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def fit(texts: list[str], y: np.ndarray, folds: int = 4) -> Scorer | float:
    if y.min(initial=1) == y.max(initial=0) or len(y) < 2 * folds:
        return float(y.mean()) if len(y) else 0.0
    fold = np.empty(len(y), int)
    for label in (0, 1):  # both labels in every fold
        at = np.flatnonzero(y == label)
        fold[at] = np.arange(len(at)) % folds
    x = np.zeros((len(y), FEATURES))
    for k in range(folds):
        use = fold != k
        lex = learn([t for t, u in zip(texts, use, strict=True) if u], y[use])
        x[~use] = features(pa.array([t for t, u in zip(texts, use, strict=True) if not u], pa.string()), lex)
    out = np.zeros(len(y))
    for k in range(folds):
        use = fold != k
        out[~use] = Trees().fit(x[use], y[use]).raw(x[~use])
    return Scorer(learn(texts, y), Trees().fit(x, y), *isotonic(out, y))


def sample(docs: DataFrame, labelled: DataFrame, most: int, most_bytes: int) -> pa.Table:
    """u, doc_id, toxic, text of the labelled rows that are learned from, in one order."""
    spark = docs.sparkSession
    labelled = labelled.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = labelled.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    chosen = labelled.withColumn("u", u).where(F.col("u") < int(min(1.0, 1.2 * most / max(n, 1)) * (1 << 30))).orderBy("u", "doc_id").limit(most)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("u", "doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))  # most rows at most
    rows = written(rows, spark, "labelled")
    per_id = rows.groupBy("u", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy("u", "doc_id").collect()
    out, n, size = [], 0, 0
    for r in per_id:
        if n + r.n > most or size + r.size > most_bytes:
            out.append((r.doc_id,))
        else:
            n, size = n + r.n, size + r.size
    if out:
        rows = rows.join(F.broadcast(spark.createDataFrame(out, "doc_id bigint")), "doc_id", "left_anti").select(*rows.columns)  # of chosen ids
    return rows.toArrow().sort_by([("u", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])


def classify(docs: DataFrame, labelled: DataFrame, most: int = 8000, most_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, score. labelled: doc_id, toxic, of documents in docs; rows with a null are left out. The bounds are those of sample()."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = sample(docs, labelled, most, most_bytes)
    shared = spark.sparkContext.broadcast(fit(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), int)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            s = m.score(b.column("text")) if isinstance(m, Scorer) else np.full(b.num_rows, m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], schema=ROWS)

    return docs.mapInArrow(run, RESULT)
