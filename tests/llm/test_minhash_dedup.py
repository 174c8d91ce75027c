import random
import re

import numpy as np
import pytest

from fieldspark.llm import minhash_dedup as op
from fieldspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i) if i is not None else None
    return sorted(((i, len(s[k]), low[find(k)], i is None or i == low[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def cases(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    line = " ".join(vocab[:9])
    rows = [(0, None), (1, ""), (2, "a"), (3, "A"), (4, "a b"), (5, "b a"), (None, "a"), (6, "x " * 500)]
    i = 10
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                k = r.randrange(len(t))
                r.choice([lambda: t.__setitem__(k, "Z%d" % r.randint(0, 9)), lambda: t.insert(k, "q"), lambda: t.pop(k)])()  # noqa: B023
            text = " ".join(t) + (" " + line if r.random() < 0.3 else "")
            rows.append((i, text))
            if r.random() < 0.15:
                rows.append((i, text.upper()))
            i += 1
    return rows


@pytest.mark.parametrize("most_list", [4096, 6, 2])
def test_against_brute_force(spark, most_list):
    """Whole lists, lists that are posted anew, and blocks of those give the same."""
    rows = cases(most_list)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string").repartition(4)
    assert sorted(map(tuple, op.near_duplicates(df, most_list=most_list).collect()), key=str) == brute(rows)


def test_words_with_thue_morse_order(spark):
    """Words that collide under any polynomial modulo 2**64."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    rows = [(1, f"p q {a} r"), (2, f"p q {b} r"), (3, a), (4, b)]
    assert sorted(map(tuple, op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_chains_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(df).collect() == []
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (200, 150), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert all(got[i] == 0 for i in range(61)) and {got[100], got[150], got[200]} == {100}


def test_prefix_filter_keeps_candidates():
    r = np.random.default_rng(1)
    sig = r.integers(0, 1 << 32, (700, op.COORDINATES)).astype(np.uint32)
    sig[:, 40:80] = sig[0, 40:80]  # a passage that all share
    sig[650, :90] = sig[3, :90]
    zero = np.zeros(700, int)
    assert op.active(sig, 75).sum() == 2
    assert [sorted((*a.tolist(), *b.tolist())) for a, b in op.across(sig, np.arange(700), zero, 0, 75)] == [[3, 650]]
    assert not list(op.across(sig, np.arange(700), zero, 5, 75))  # coordinate 5 isn't their first common one


def test_rows_that_share_a_doc_id(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (12, b + " more"), (13, "less " + a), (13, "c"), (7, "b0 " + b), (7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, op.near_duplicates(docs).collect()), key=str) == brute(rows)
