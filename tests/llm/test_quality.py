import math
from collections import Counter

from fieldspark.llm import quality


def brute(texts, order):
    """log10 probability under an interpolated modified Kneser-Ney model of texts, over plain Python counters."""
    sents = [["<s>", *t.split(), "</s>"] for t in texts]
    raw = {k: Counter(tuple(s[i - k + 1 : i + 1]) for s in sents for i in range(max(1, k - 1), len(s))) for k in range(1, order + 1)}
    levels = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        cont = Counter(g[1:] for g in levels[k + 1])
        levels[k] = {g: cont.get(g) or c for g, c in raw[k].items()}

    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        c = levels[len(g)]
        n = [max(sum(v == x for v in c.values()), 1) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(x, 0.1), h) for x, h in zip((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]), (0.9, 1.9, 2.9))]
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        t = sum(own.values())
        off = lambda v: min(d[min(v, 3) - 1], v)
        return max(own.get(g, 0) - (off(own[g]) if g in own else 0), 0) / t + sum(map(off, own.values())) / t * p(g[1:])

    def score(t):
        s = ["<s>", *(t or "").split(), "</s>"]
        return sum(math.log10(p(tuple(s[max(0, i - order + 1) : i + 1]))) for i in range(1, len(s)))

    return score


LONG = "a b c longerwordthaneightbytes " * 5000


def test_scores_against_brute_force(spark):
    texts = ["a b c a b", "b c a", "c c a b d", "a", "", "a b d", "longerwordthaneightbytes a b"]
    trusted = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = ["a b c", "d d", "x a b", "", "b", None, "b", LONG, *texts]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(asked)], "doc_id long, lang string, text string")
    for order, groups in ((2, 2 << 30), (2, 50_000), (3, 50_000)):  # one group of shards, several
        want, model = brute(texts, order), quality.train(trusted, order)
        got = {r.doc_id: r for r in quality.log_probabilities(docs.repartition(5), *model, order, groups).collect()}
        assert len(got) == len(asked)
        for k, t in enumerate(asked[:7] + texts):
            k = k if k < 7 else k + 1
            assert abs(got[k].log10_prob - want(t)) < 1e-9 * max(1, abs(want(t))), (k, t)
            assert got[k].n_tokens == len((t or "").split()) + 1
        assert got[7].n_tokens == 20001


def test_thresholds(spark):
    good = [(k, "the cat sat on the mat and the dog ran " * 3, "en") for k in range(60)]
    odd = [(100, "zq xv kk jj ww pp qq rr", "en"), (101, None, None), (102, "", "en"), (102, "", "en"), (None, "zz yy xx", "en"), (103, "zq xv kk", None)]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string, lang string").withColumn("threshold", quality.F.lit(1)).withColumn("key", quality.F.lit("x"))
    out = quality.classify(docs, docs.where("doc_id < 60"))
    got = {(r.doc_id, r.n_tokens): r.rejected for r in out.collect()}
    assert out.count() == 66 and got[100, 9] and got[103, 4] and not got[101, 1] and not got[102, 1]
    assert not any(got[k, 31] for k in range(60))  # ties at the threshold stay


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c", "en", 1), (2, None, None, 1), (3, "", "en", 1), (3, "", "en", 1), (None, "x", "en", 1)], "doc_id long, text string, lang string, threshold int")
    got = quality.classify(df, df.where("false"))
    assert got.where("rejected").count() == 0 and sorted(r.n_tokens for r in got.collect()) == [1, 1, 1, 2, 4]
    got = quality.classify(df, df)
    assert got.count() == 5 and got.where("doc_id in (2, 3) and rejected").count() == 0
    assert quality.classify(df.where("false"), df).collect() == []


def test_words_with_thue_morse_order():
    """Words that collide under any polynomial modulo 2**64 have hashes of their own, and so do words past eight bytes."""
    from fieldspark.llm.common import buffers, word_hashes, words

    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    text = quality.pa.array([" ".join([a, b, "abcdefgh", "abcdefghabcdefgh", "abcdefgh" * 3, "hgfedcba", "a", "a\0", "A"])])
    data, offs = buffers(text)
    s, e, _ = words(data, offs)
    for seed in (0, 1):
        assert len(set(word_hashes(data, s, e, seed=seed).tolist())) == 9
    assert len(set(word_hashes(data, s, e, lower=True).tolist())) == 8
    assert not set(word_hashes(data, s, e).tolist()) & set(word_hashes(data, s, e, seed=1).tolist())


def test_all_trusted_text_is_used(spark, monkeypatch):
    """80 MB of trusted text: one half of the documents is learned, whatever their size."""
    learned = []
    monkeypatch.setattr(quality, "train", lambda docs, *a: learned.extend(r.doc_id for r in docs.select("doc_id").collect()))
    docs = spark.range(80).select(quality.F.col("id").alias("doc_id"), quality.F.lit("en").alias("lang"), quality.F.expr("repeat('ab ', 350000)").alias("text"))
    quality._classify(docs, docs, 0.99, 0.1, 30, False)
    u = quality.F.pmod(quality.F.xxhash64(quality.F.col("id"), quality.F.lit(3)), quality.F.lit(1 << 30)) / float(1 << 30)
    assert sorted(learned) == [r.id for r in spark.range(80).where(u < 0.5).orderBy("id").collect()] and 25 < len(learned) < 55


def test_shards_grow_with_the_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_KEYS", 1)
    texts = ["a b c a b", "b c a", "c c a b d e f g h i j k l m n o p q r s t u v w x y z"]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert model[0].count() > 32
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    want = brute(texts, 2)
    for r in quality.log_probabilities(docs, *model).collect():
        assert abs(r.log10_prob - want(texts[r.doc_id])) < 1e-9 * abs(want(texts[r.doc_id]))


def test_highest_order_travels_in_blocks(spark):
    """A pair of words takes less than 16 bytes, not a row of 36, and each is in one shard."""
    texts = [" ".join(str(k * k % p) for k in range(3000)) for p in (1009, 2003, 3001)]
    want = Counter(g for t in texts for w in [["<s>", *t.split(), "</s>"]] for g in zip(w, w[1:]))
    rows = quality.blocks(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), 2).collect()
    shards = [quality.grams(quality.pa.scalar(bytes(r.grams))) for r in rows]
    assert len({r.shard for r in rows}) == len(rows) > 16
    keys = quality.np.concatenate([quality.prefix(ctx, word) for ctx, word, _, _ in shards])
    assert len(set(keys.tolist())) == len(keys) == len(want)
    assert Counter(quality.np.concatenate([n for *_, n in shards]).tolist()) == Counter(want.values())
    assert sum(len(r.grams) for r in rows) < 16 * len(want)


def test_rounds_take_each_document_once(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROUND_BYTES", 1)
    seen, requests = [], quality.requests
    monkeypatch.setattr(quality, "requests", lambda docs, *a: (seen.append(docs.count()), requests(docs, *a))[1])
    texts = ["a b c a b", "b c a", "c c a b d"]
    want = brute(texts, 2)
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = [*texts * 4, None, "", "x"]
    docs = spark.createDataFrame([(k // 2 or None, "en", t) for k, t in enumerate(asked)], "doc_id long, lang string, text string")
    got = quality.log_probabilities(docs, *model).collect()
    assert len(seen) == quality.MOST_ROUNDS and sum(seen) == len(asked) and max(seen) < len(asked)
    assert all(abs(x - y) < 1e-9 for x, y in zip(sorted(r.log10_prob for r in got), sorted(map(want, asked)), strict=True))


def test_untrusted_texts_stay_out_of_the_join(spark):
    docs = spark.range(20_000).select(quality.F.col("id").alias("doc_id"), quality.F.lit("a").alias("text"))
    trusted = docs.where("doc_id % 100 = 0").select("doc_id")
    got = {r.doc_id for r in quality.sifted(docs, trusted).collect()}
    assert got >= set(range(0, 20_000, 100)) and len(got) < 210
    assert quality.sifted(docs, trusted.where("false")).collect() == []
