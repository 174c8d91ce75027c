import math
import random
import re
from collections import Counter

import numpy as np

from fieldspark.llm import context_tree as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(t):
    return [w.translate(LOW) for w in WORD.findall(t or "")]


def brute(train, depth):
    """Context-tree weighting by recursion over dictionaries; returns log10 p(text)."""
    n = {}
    for t in train:
        b = " ".join(tokens(t)).encode() + b"\n"
        for i, x in enumerate(b):
            ctx = ((b"\n" * depth) + b[:i])[-depth:][::-1]
            for k in range(8):
                pre, bit = (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1
                for d in range(depth + 1):
                    n.setdefault((ctx[:d], pre), [0, 0])[bit] += 1
    kids = {}
    for c, pre in n:
        if c:
            kids.setdefault((c[:-1], pre), []).append((c, pre))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def pw(s):
        if s not in memo:
            e = kt(*n[s])
            memo[s] = e if len(s[0]) == depth else np.logaddexp(e, sum(map(pw, kids[s]))) - math.log(2)
        return memo[s]

    def p(ctx, pre, bit, d=0):
        s = (ctx[:d], pre)
        if s not in n:
            return None
        a = (n[s][bit] + 0.5) / (sum(n[s]) + 1)
        deeper = p(ctx, pre, bit, d + 1) if d < depth else None
        if deeper is None:
            return a
        w = math.exp(kt(*n[s]) - math.log(2) - pw(s))
        return w * a + (1 - w) * deeper

    def score(t):
        b, out = " ".join(tokens(t)).encode() + b"\n", 0.0
        for i, x in enumerate(b):
            ctx = ((b"\n" * depth) + b[:i])[-depth:][::-1]
            for k in range(8):
                q = p(ctx, (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1)
                out += math.log10(0.5 if q is None else q)
        return out

    return score


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice([" ", "\n"]).join(r.choice(["The", "cat", "sat", "sät", "on", "mat."]) for _ in range(r.randint(0, 12))), i % 3 > 0) for i in range(40)]
    rows += [(50, None, True), (51, "", False), (52, "zebra ÿ", False), (53, "the the", True), (53, "the the", True), (None, "cat", False)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, train boolean, score double").repartition(3)
    pairs = {x for t in ("The cat sat on the mat.", "s\u00e4t") for x in op.prepare(op.pa.array([t]), 4)[0] >> op.U(24)}
    for split in (None, [], sorted(map(int, pairs))[::2]):
        same_as_brute(rows, op.score(df, 4, 300, split).collect())


def same_as_brute(rows, got):
    s = brute([t for _, t, k in rows if k], 4)
    c = Counter(w for _, t, k in rows if k for w in [*tokens(t), None])
    big, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in rows:
        w = [*tokens(t), None]
        want.append((i, len(w), sum(c[x] > 0 for x in w), big, sum(math.log10((c[x] + 1) / (big + v + 1)) for x in w), s(t)))
    key = lambda x: (x[0] is None, x[0] or 0)
    for a, b in zip(sorted(got, key=lambda x: key((x.doc_id,))), sorted(want, key=key), strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known, a.train_tokens) == b[:4]
        assert abs(a.base_score - b[4]) < 1e-9 and abs(a.score - b[5]) < 1e-4 * max(1, abs(b[5]))


def test_probabilities_sum_to_one():
    key, _, _, _ = op.prepare(op.pa.array(["abc abd", "b"]), 3)
    k, c = op._sum(key, np.ones(len(key), np.int64))
    f = op.Forest(k, c, 2, 3)
    up = op.Upper([(1, *x) for x in f.top()])
    for ctx in (k[0] >> op.U(8), k[3] >> op.U(8), op.U(12345)):
        assert abs(np.exp(f.log_p((ctx << op.U(8)) | np.arange(256, dtype=op.U), up)).sum() - 1) < 1e-9


def test_no_training_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, False)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in op.score(df).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0
    assert abs(got[1].score - 32 * math.log10(0.5)) < 1e-6 and got[2].n_tokens == 1
    assert op.score(df.where("false")).collect() == []


def test_cut_pairs_give_the_same_nodes():
    key, _, _, _ = op.prepare(op.pa.array(["abc abd", "b ab cd ab"]), 4)
    k, c = op._sum(key, np.ones(len(key), np.int64))
    whole = op.Forest(k, c, 2, 4)
    want = whole.log_p(k, op.Upper([(1, *x) for x in whole.top()]))
    cut = np.unique((k >> op.U(24)).astype(np.int64))[::2]
    parts = [(op.Forest(k[m], c[m], low, 4), m) for low, m in op._lows(k, 4, cut)]
    upper = op.Upper([(f.low - 1, *x) for f, _ in parts for x in f.top()])
    assert all(len(m) for _, m in parts)
    for f, m in parts:
        assert np.allclose(f.log_p(k[m], upper), want[m], rtol=1e-12)


def test_very_long_text(spark):
    text = "A b\n c " * 450_000  # more than one step
    df = spark.createDataFrame([(1, text, False), (2, "a b c a b c", True)], "doc_id long, text string, train boolean").repartition(2)
    got = {r.doc_id: r for r in op.score(df).collect()}
    n = 3 * 450_000 + 1
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens) == (n, n, 7)
    assert abs(got[1].base_score - ((n - 1) * math.log10(3 / 12) + math.log10(2 / 12))) < 1e-3
    assert 0 < got[1].code_length < 8
