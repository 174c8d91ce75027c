import random
import re

import numpy as np

from fieldspark.llm import suffix_dedup as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    seen = {}
    for k, (_, t) in enumerate(rows):
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        got = {j for k in range(len(w) - n + 1) if len(seen[tuple(w[k : k + n])]) > 1 for j in range(k, k + n)}
        if got:
            spans = []
            for j in sorted(got):
                if spans and sum(spans[-1]) == j:
                    spans[-1][1] += 1
                else:
                    spans.append([j, 1])
            out.append((i, len(w), len(got), [tuple(s) for s in spans]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    for seed, least in ((1, 50), (2, 30)):
        r = random.Random(seed)
        vocab = ["w%d" % i for i in range(8 if seed == 2 else 60)]
        passages = [[r.choice(vocab) for _ in range(r.randint(least - 8, least + 60))] for _ in range(6)]
        rows = [(0, None), (1, ""), (2, "a " * 200), (3, "a " * 20), (None, " ".join(passages[0]))]
        for i in range(4, 90):
            t = [r.choice(vocab) for _ in range(r.randint(0, 90))]
            for _ in range(r.randint(0, 2)):
                k = r.randint(0, len(t))
                t[k:k] = r.choice(passages)
            rows.append((i, r.choice([" ", "\n"]).join(t)))
        rows += [(60, rows[30][1]), (61, " ".join(passages[1] * 2))]
        df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, block int").repartition(3)
        got = sorted(((x.doc_id, x.n_words, x.n_repeated, [tuple(s) for s in x.spans]) for x in op.repeated(df, least, block_bytes=3000).collect()), key=str)
        assert got == brute(rows, least)


def test_minimisers_are_kept_in_every_span():
    h = op.mix(np.arange(400, dtype=op.U) % op.U(7)) if hasattr(op, "mix") else np.random.default_rng(1).integers(0, 1 << 62, 400, dtype=np.uint64)
    at = op.minimisers(h, np.array([0, 150, 400]))
    for a, b in ((0, 150), (150, 400)):
        for s in range(a, b - op.SPAN - op.GRAM + 2):
            assert ((at >= s) & (at < s + op.SPAN)).any()


def test_empty(spark):
    assert op.repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
