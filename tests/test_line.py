"""Fits and sums on a line at sizes where all pairs, or a general solver, don't do."""

import time

import numpy as np
import pytest

from fieldspark.functions.kernels import Rbf
from fieldspark.model import Model
from fieldspark.operators import interpolation as IP
from fieldspark.operators import line
from fieldspark.operators.interpolation import Interpolant

N = 20_000


def data(n=N, seed=4):
    r = np.random.default_rng(seed)
    x = r.permutation(np.cumsum(r.uniform(0.5, 1.5, n)))[:, None]
    return x, r.uniform(-999, 9999, n)


@pytest.mark.parametrize("model", [Model(Rbf("exp", (1.3, 5.0)), -1), Model(Rbf("exp", (1.3, 5.0), ((2.0,),)), 2, 0.1), Model(Rbf("bh3"), 0), Model(Rbf("bh3", (2.0,)), 1, 0.3), Model(Rbf("bh3", (2.0,), ((-1.5,),)), 2)])
def test_line_is_the_dense_solution(model):
    x, v = data(200)
    w = line.solve(model, x, v)
    assert np.allclose(w, IP.dense_solve(model, x, x[:0], v), rtol=1e-8, atol=1e-6)
    t = np.concatenate((x, np.linspace(-20, 250, 150)[:, None]))
    want = IP.kernel_rows(model, t, t, x, x[:0]) @ w[:200] + IP.basis_rows(model, t, t) @ w[200:]
    assert np.allclose(Interpolant(model, x, x[:0], w).values(t, t), want, rtol=1e-8, atol=1e-6)


def test_line_leaves_what_it_does_not_serve():
    x, v = data(50)
    twice = np.concatenate((x, x))
    assert line.solve(Model(Rbf("bh3"), 0), twice, np.append(v, v)) is None
    for m in (Model(Rbf("bh3", (1.0, 0.5)), 0), Model(Rbf("gau", (1.0, 5.0)), 0), Model((Rbf("exp", (1.0, 5.0)), Rbf("exp", (1.0, 9.0))), 0)):
        assert not line.serves(m, x, x[:0])
    assert not line.serves(Model(Rbf("bh3"), 0), x, x[:1]) and not line.serves(Model(Rbf("bh3"), 0), np.ones((3, 2)), np.ones((0, 2)))


def test_linear_fit_of_many_rows():
    x, v = data()
    f = Interpolant(Model(Rbf("bh3"), 0)).fit(x, v)
    o = np.argsort(x[:, 0])
    t = (x[o[1:]] + x[o[:-1]]) / 2
    assert np.abs(f.values(x) - v).max() < 1e-6 and np.abs(f.values(t) - (v[o[1:]] + v[o[:-1]]) / 2).max() < 1e-6


def test_slopes_between_many_centres():
    x, v = data()
    f = Interpolant(Model(Rbf("bh3"), 0)).fit(x, v)
    o = np.argsort(x[:, 0])
    t = (x[o[1:]] + x[o[:-1]]) / 2
    assert np.abs(f.values(t[:0], t) - np.diff(v[o]) / np.diff(x[o, 0])).max() < 1e-6


def test_large_line_fit_saved_and_loaded(spark, tmp_path):
    x, v = data(7000)
    f = Interpolant(Model(Rbf("bh3"), 0)).fit(x, v)
    f.save(spark, str(tmp_path / "f"))
    g = Interpolant.load(spark, str(tmp_path / "f"))
    assert (g.weights == f.weights).all() and np.abs(g.values(x) - v).max() < 1e-6


def test_folds_of_many_rows(spark):
    """An exponential prediction hangs on the nearest rows of the other folds alone."""
    n = 70_000
    v = np.random.default_rng(5).uniform(-999, 9999, n)
    p = spark.createDataFrame([(i, float(i), float(v[i]), i % 10) for i in range(n)], "id long, x double, v double, fold int")
    got = np.array(IP.cross_validate(Model(Rbf("exp", (1.0, 5.0)), -1), p).orderBy("id").select("prediction").collect())[1:-1, 0]
    want = (v[:-2] + v[2:]) * np.sinh(0.6) / np.sinh(1.2)
    assert np.abs(got - want).max() < 1e-6


def test_nugget_of_many_rows():
    x, v = data()
    m = Model(Rbf("exp", (1.0, 5.0)), 0, 0.1)
    f = Interpolant(m).fit(x, v)
    assert np.abs(f.values(x) + 0.1 * f.weights[:N] - v).max() < 1e-8 and abs(f.weights[:N].sum()) < 1e-5


def test_bounds_of_many_rows():
    x, v = data()
    f = Interpolant(Model(Rbf("exp", (1.0, 5.0)), -1)).fit_inequality(x, np.where(v > 5000, v, np.nan), v - 100, v + 100, 1e-6)
    got = f.values(x)
    assert (np.abs(got - v) <= 100.001).all() and np.abs(got - v)[v > 5000].max() < 1e-6


def test_incremental_fit_of_many_rows():
    x, v = data()
    start = time.time()
    f = Interpolant(Model(Rbf("bh3"), 0)).fit_incrementally(x, v, 500.0)
    assert np.abs(f.values(x) - v).max() <= 500.0 and time.time() - start < 60
