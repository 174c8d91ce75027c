import numpy as np

from fieldspark.llm import inverted_multi_index as op
from pyspark.sql import functions as F


def brute(rows, k, chosen):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % 10 == 0:
            out[i] = sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for j, x in ok if j != i)[:k]
    return out


def test_recall_order_and_edges(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=(12, 8)) * 3
    rows = [(i, [float(x) for x in np.float32(centre[i % 12] + r.normal(size=8))]) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # one common vector
    rows += [(2000, None), (2010, [0.0] * 8), (2020, [float("nan")] + [1.0] * 7), (2030, [None] + [1.0] * 7), (2040, [1.0] * 3), (None, [1.0] * 8), (2050, [float("inf")] + [1.0] * 7), (2060, [])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, cell int").repartition(3)
    for most_entries, most_queries in ((20_000, 5_000), (40, 3)):
        got = {}
        for x in op.search(df, F.col("vec_id") % 10 == 0, most=400, most_entries=most_entries, most_queries=most_queries).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.score, x.vec_id))
            assert x.rank == len(got[x.query_id])
        want = brute(rows, 10, None)
        assert got.keys() == want.keys()
        hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        for i in want:
            assert got[i] == sorted(got[i]) and len(got[i]) == 10
            exact = dict((j, s) for s, j in brute(rows, 2000, None)[i]) if i in (0, 1000) else {}
            assert all(s == exact[j] for s, j in got[i] if exact)


def test_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [3.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x)[:3] for x in op.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert op.search(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_walk_visits_all_cells_in_order():
    r = np.random.default_rng(2)
    a, b = r.random(5), r.random(7)
    got = list(op.walk(a, b))
    s = [a[c // 7] + b[c % 7] for _, c in got]
    assert sorted(c for _, c in got) == list(range(35)) and s == sorted(s) == [x for x, _ in got]


def test_one_dimension(spark):
    df = spark.createDataFrame([(i, [float(i * i + 1)]) for i in range(40)], "vec_id long, embedding array<double>")
    got = [tuple(x) for x in op.search(df, F.col("vec_id") == 10, k=3).orderBy("rank").collect()]
    assert got == [(10, 1, 9, 19.0), (10, 2, 11, 21.0), (10, 3, 8, 36.0)]


def test_clustered_vectors_visit_few(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(300, 16)) * 5, 20, axis=0) + r.normal(size=(6000, 16))
    index = op.Index(x, len(x), 512)
    sizes = np.bincount(index.cells(x), minlength=len(index.c1) * len(index.c2))
    stored = spark.createDataFrame(list(zip(range(6000), x.tolist(), index.cells(x).tolist())), "vec_id long, v array<double>, cell int")
    probes = [(i, x[i].tolist()) for i in range(0, 6000, 200)]
    assert op.calibrated(stored, index, probes, sizes, 10, 0.95, 16) < 0.1 * len(x)
