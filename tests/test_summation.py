import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import predicates as T
from fieldspark.functions.kernels import KERNELS, Rbf, on_arrays
from fieldspark.model import Model
from fieldspark.operators import interpolation as IP
from fieldspark.operators import summation as U

A2 = ((1.5, 0.2), (0.0, 0.8))


def brute(b, x, w, y):
    return b.evaluate(y[:, None] - x) @ w


@pytest.mark.parametrize("name", list(KERNELS))
def test_sums_over_clusters(name):
    r = np.random.default_rng(4)
    x, w, y = r.uniform(-1, 1, (3000, 2)), r.normal(size=3000), r.uniform(-3, 3, (400, 2))
    b = Rbf(name, (1.0, 0.1) if KERNELS[name].order else (1.0, 0.8), A2)
    errors = [np.abs(U.ClusterSum(b, x, w, k).values(y) - brute(b, x, w, y)).max() for k in (4, 12)]
    assert errors[1] < 1e-5 and errors[1] <= max(errors[0], 1e-9)


def test_orders_are_chosen_by_accuracy():
    r = np.random.default_rng(5)
    x, w = r.uniform(-1, 1, (2500, 3)), r.normal(size=2500)
    model = Model((Rbf("bh3"), Rbf("sp5", (2.0, 0.5))), 0)
    loose, tight = U.cluster_sums(model, x, w, 1.0), U.cluster_sums(model, x, w, 1e-5)
    assert loose[0].order <= tight[0].order and U.cluster_sums(model, x, w, 1e-300) is None
    got = sum(c.values(x[:200]) for c in tight)
    assert np.abs(got - sum(brute(b, x, w, x[:200]) for b in model.rbfs)).max() < 1e-4
    same = U.ClusterSum(Rbf("bh3"), np.ones((500, 3)), np.ones(500), 4)
    assert np.allclose(same.values(np.zeros((2, 3))), -500 * np.sqrt(3)) and len(same.values(np.zeros((0, 3)))) == 0
    assert (U.ClusterSum(Rbf("bh3"), x[:0], w[:0], 4).values(x[:3]) == 0).all()


def test_evaluate_with_an_accuracy(spark):
    r = np.random.default_rng(6)
    x, w = r.uniform(-1, 1, (1500, 2)), np.append(r.normal(size=1500), [0.5, 1.0, 2.0])
    f = IP.Interpolant(Model(Rbf("th3"), 1), x, x[:0], w)
    rows = [(i, *map(float, p)) for i, p in enumerate(r.uniform(-1, 1, (50, 2)))] + [(50, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {t.id: t.value for t in f.evaluate(df, accuracy=1e-6).collect()}
    assert got.pop(50) is None
    assert np.abs(np.array([got[i] for i in range(50)]) - f.values(np.array([t[1:] for t in rows[:50]]))).max() < 1e-5
    with pytest.raises(ValueError):
        f.evaluate(df, accuracy=-1.0)


def test_compact_sums(spark):
    r = np.random.default_rng(7)
    x, w, y = r.uniform(-1, 1, (300, 2)), r.normal(size=300), r.uniform(-2, 2, (100, 2))
    model = Model((Rbf("sph", (1.0, 0.5), A2), Rbf("cub", (2.0, 0.3))), 1)
    centers = spark.createDataFrame([(i, *map(float, p), float(t)) for i, (p, t) in enumerate(zip(x, w))], "id long, x double, y double, w double")
    points = spark.createDataFrame([(i, *map(float, p), "k") for i, p in enumerate(y)] + [(100, None, 0.0, "k")], "id long, x double, y double, tag string")
    got = {t.id: t.value for t in U.compact_sum(model, centers, points, tail=[1.0, 2.0, 3.0]).collect()}
    assert got.pop(100) is None
    want = sum(brute(b, x, w, y) for b in model.rbfs) + 1 + y @ [2.0, 3.0]
    assert np.abs(np.array([got[i] for i in range(100)]) - want).max() < 1e-9
    assert U.compact_sum(model, centers.limit(0), points.where("id = 0")).first().value == 0.0
    assert U.compact_sum(model, centers, points.limit(0)).collect() == []
    with pytest.raises(ValueError):
        U.compact_sum(Model(Rbf("exp", (1.0, 1.0)), 0), centers, points)


def test_predicates(spark):
    r = np.random.default_rng(8)
    p = r.normal(size=(4, 50, 3))
    a, b, c, d = (tuple(q.T) for q in p)
    assert np.allclose(T.orient3d(a, b, c, d), np.linalg.det(np.stack((p[1] - p[0], p[2] - p[0], p[3] - p[0]), 1)))
    assert T.orient2d((0, 0), (1, 0), (0, 1)) == 1 and T.orient2d((0, 0), (1, 1), (2, 2)) == 0
    assert T.incircle((1, 0), (0, 1), (-1, 0), (0, 0)) > 0 > T.incircle((1, 0), (0, 1), (-1, 0), (2, 0)) and T.incircle((1, 0), (0, 1), (-1, 0), (0, -1)) == 0
    one = np.array([[0.0, 0], [0, 0]])
    assert np.allclose(T.min_angle(one, np.array([[1.0, 0], [0, 0]]), np.array([[0.0, 1], [1, 1]])), [np.pi / 4, 0])
    assert on_arrays(Rbf("bh3"))(np.array([2.0]))[0] == -2
    assert spark.range(1).select(F.signum(T.orient2d((0.0, 0.0), (1.0, 0.0), (F.lit(0.0), F.lit(2.0)))).alias("s")).first().s == 1


def test_more_centres_than_a_fit_takes(spark, tmp_path):
    """Weights that are given need no fit; sums whose rounding is beyond the accuracy are exact."""
    from fieldspark.queries import QUERIES

    n = 210_000
    spark.range(n).selectExpr("id as c_custkey", "id % 25 as c_nationkey", "cast(id % 7 as double) as c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(3).selectExpr("cast(id as int) as n_nationkey", "cast(id as int) as n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    got = {r.id: r.value for r in QUERIES["cluster_sum"](spark, str(tmp_path)).collect()}
    i = np.arange(n)
    for k in range(3):
        want = -(i % 7 / 1e6 * np.hypot(k * 40 + 0.5 - i, k * 5 + 0.5 - i % 25)).sum()
        assert abs(got[k] - want) < 2e-3
