import numpy as np
import pyarrow as pa

from fieldspark.llm import language_id as op


def brute_kn(counts: dict, vocabulary: int):
    """Interpolated Kneser-Ney by dictionaries of tuples; returns p(gram)."""
    levels = {4: dict(counts)}
    for k in (3, 2, 1):
        c = {}
        for g in levels[k + 1]:
            c[g[1:]] = c.get(g[1:], 0) + 1
        levels[k] = c

    def p(g):
        k = len(g)
        if not k:
            return 1 / vocabulary
        c = levels[k]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        t = sum(own.values())
        return max(own.get(g, 0) - d, 0) / t + d * len(own) / t * p(g[1:])

    return p


def test_model_against_brute_force():
    texts = pa.array(["abab cab bad cab", "bab", "dada bad", None, "", "ab1ab"])
    alphabet = np.unique(op.characters(texts)[0])
    keys, n = op.count(texts, alphabet)
    tup = lambda x: tuple((int(x) >> (16 * j)) & 0xFFFF for j in (3, 2, 1, 0))
    p = brute_kn({tup(k): c for k, c in zip(keys, n)}, len(alphabet) + 2)
    m = op.Models(["x"], alphabet, [op.kneser_ney(keys, n, len(alphabet) + 2)])
    new = pa.array(["bad dab", "cacb", "zz a"])
    cps, ptr, _ = op.characters(new)
    code = op.codes(cps, alphabet)
    for d in range(3):
        want, own = 0.0, [0, 0, 0, *code[ptr[d] : ptr[d + 1]].tolist()]
        for i in range(4, len(own)):
            want -= np.log(p(tuple(own[i - 3 : i + 1])))
        ce, k, _ = m.score(new)
        assert abs(ce[d, 0] * k[d] - want) < 1e-4


def test_accuracy_and_edges(spark):
    rows = [(i, " ".join(["the house and", "who was there", "with thing"][: i % 3 + 1]), "en") for i in range(40)]
    rows += [(100 + i, " ".join(["das haus und", "wer war dort", "mit sache"][: i % 3 + 1]), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !!", None), (203, "und wer war das", None), (203, "und wer war das", None), (None, "who and the", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in op.identify(df, df).collect()}
    assert all((i, "en") in got and (100 + i, "de") in got for i in range(40))
    assert {(200, "und"), (201, "und"), (202, "und"), (203, "de"), (None, "en")} <= got
    assert op.identify(df, df.where("false")).where("lang_pred = 'und'").count() == len(rows)
    assert op.identify(df.where("false"), df).collect() == []
