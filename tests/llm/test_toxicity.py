import bisect
import math
import random
import re

import numpy as np

from fieldspark.llm import toxicity as op


def test_isotonic_against_brute_force():
    r = np.random.default_rng(1)
    s, y = np.round(r.random(40), 1), r.integers(0, 2, 40)
    at, v = op.isotonic(s, y)
    got = np.interp(s, at, v)
    # min-max formula over the means of tied places
    u = np.unique(s)
    m, w = np.array([y[s == x].mean() for x in u]), np.array([(s == x).sum() for x in u])
    mean = lambda a, b: (m[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))]
    assert np.allclose(got, [want[list(u).index(x)] for x in s])


def test_trees_learn_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    assert ((op.Trees().fit(x[:600], y[:600]).raw(x[600:]) > 0) == y[600:]).mean() > 0.95


def test_obfuscation_and_proximity():
    lex = op.learn([], np.zeros(0, int))
    f = op.features(op.pa.array(["you are an id1ot", "an IDIOT! said i.d.i.o.t", "calm words", None, ""]), lex)
    assert f[0, 5] == 1 and f[0, 7] > 0 and f[1, 5] == 1 and f[1, 7] == 0 and not f[3].any() and not f[4].any()


def test_held_out_and_edges(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        t = [r.choice("alpha beta gamma delta omega".split()) for _ in range(r.randint(3, 60))]
        toxic = int(r.random() < 0.2)
        for _ in range(toxic * 3):
            t[r.randrange(len(t))] = r.choice(["zorgal", "zorgax", "idiot,"])
        rows.append((i, " ".join(t), toxic))
    rows += [(900, None, None), (901, "", None), (901, "", None), (None, "you idiot", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)
    lab = df.where("doc_id < 300").select("doc_id", "toxic")
    got = {r.doc_id: r.score for r in op.classify(df, lab).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(t) for i, _, t in rows[300:400]]) > 0.97
    assert got[901] < 0.3
    assert {r.score for r in op.classify(df, lab.where("false")).collect()} == {0.0}
    assert op.classify(df.where("false"), lab).collect() == []


def plain_features(text, lex):
    """By definition, over plain Python lists."""
    data = (text or "").encode()
    raw = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = [0.0] * op.FEATURES
    if not data:
        return out
    between = lambda a, b: sum(a <= c <= b for c in data)
    letters, digits = between(65, 90) + between(97, 122), between(48, 57)
    out[8], out[9], out[10], out[11] = (x / len(data) for x in (between(65, 90), between(33, 126) - letters - digits, data.count(33), digits))
    if not raw:
        return out
    hits, stems, you, weight, hidden, loud, mixed = [], [], [], [], 0, 0, 0
    for k, x in enumerate(raw):
        w = op.plain(x)
        a, b = lex.words.get(w, 0.0), max((lex.stems.get(w[:n], 0.0) for n in op.STEMS if len(w) > n), default=0.0)
        if a <= 0 and w and not w.isalpha():
            c = lex.words.get(x.strip(".,?;:\"'()").lower().translate(op.SIGNS), 0.0)
            if c > 0:
                a, hidden = c, hidden + 1
        hits += [k] * (a > 0)
        stems += [k] * (b > 0 >= a)
        you += [k] * (w in op.SECOND_PERSON)
        loud += len(w) > 1 and x.isupper()
        mixed += any(c.isdigit() for c in w) and any(c.isalpha() for c in w)
        weight.append(max(a, b))
    n = len(raw)
    near = set(you)
    close = sum(any(k + d in near for d in range(-op.NEAR, op.NEAR + 1)) for k in hits + stems)
    out[:8] = [math.log1p(n), len(hits) / n, math.log1p(len(hits)), len(stems) / n, math.log1p(len(stems)), hidden, len(you) / n, math.log1p(close)]
    out[12:] = [loud / n, mixed / n, max(weight), math.log1p(sum(weight))]
    return out


def plain_score(text, m):
    x, raw = plain_features(text, m.lex), m.trees.base
    for tree, leaf in m.trees.trees:
        node = 0
        for feat, cut in tree:
            node = 2 * node + (x[feat[node]] > cut[node])
        raw += leaf[node]
    at, v = list(m.at), list(m.value)
    k = bisect.bisect_right(at, raw)
    calm = v[0] if k == 0 else v[-1] if k == len(at) else v[k - 1] + (v[k] - v[k - 1]) * (raw - at[k - 1]) / (at[k] - at[k - 1])
    return min(max(0.98 * calm + 0.02 / (1 + math.exp(-raw)), 0), 1)


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    long = "You are such an IDIOT, 1d10t! calm words of no weight " * 60_000  # over one step of 2 MB
    docs = docs.unionByName(spark.createDataFrame([(90001, long), (90002, None), (90003, ""), (None, "you id1ot"), (90004, " \n ")], docs.schema)).repartition(4)
    lab = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = sorted(((r.doc_id, r.score) for r in op.classify(docs, lab).collect()), key=str)
    rows = op.sample(docs, lab, 8000, 64 << 20)
    m = op.fit(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), int))
    assert isinstance(m, op.Scorer)
    want = sorted(((r.doc_id, plain_score(r.text, m)) for r in docs.collect()), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=0, atol=1e-6)


def test_bounds_of_the_sample(spark):
    rows = [(1, "you idiot", 1), (2, "calm", 0), (3, "x" * 5000, 0), (4, None, 1)] + [(5, "again", 0)] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("u", op.F.lit("clash")).withColumn("score", op.F.lit(2))
    lab = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(2, 1), (1, None), (None, 1)], "doc_id bigint, toxic int"))
    got = sorted(zip(*(op.sample(df.select("doc_id", "text"), lab, 20, 1000).column(c).to_pylist() for c in ("doc_id", "toxic", "text"))))
    assert got == [(1, 1, "you idiot"), (2, 1, "calm"), (4, 1, "")]  # clashing labels: toxic; neither 5,000 bytes nor 50 rows fit
    assert len(op.sample(df.select("doc_id", "text"), lab, 8000, 1 << 20)) == 54
    assert op.classify(df, lab).columns == ["doc_id", "score"]
