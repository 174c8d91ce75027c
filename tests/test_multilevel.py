import numpy as np

from fieldspark.functions.kernels import Rbf, on_arrays
from fieldspark.model import Model
from fieldspark.operators import interpolation as IP
from fieldspark.operators.multilevel import GridSum

A2 = ((1.5, 0.2), (0.0, 0.8))


def test_sums_through_cells():
    r = np.random.default_rng(1)
    for d, n in ((1, 2000), (2, 4000), (3, 3000)):
        x, w = r.normal(size=(n, d)), r.normal(size=n)
        f = on_arrays(Rbf("bh3"))
        want = f(np.linalg.norm(x[:50, None] - x, axis=2)) @ w
        got = np.full(n, np.nan)
        g = GridSum(f, x)
        for k in range(3):
            rows, part = g.values(w, k, 3)
            assert np.isnan(got[rows]).all()
            got[rows] = part
        assert np.abs(got[:50] - want).max() < 1e-3 * np.abs(want).max()
    same = GridSum(f, np.ones((300, 3)))
    assert np.allclose(same.values(np.ones(300))[1], 0)


def test_fit_without_all_pairs_in_each_step(spark, monkeypatch):
    """Only residuals, some rounds of them, are sums over all pairs; the fit is exact at its data."""
    monkeypatch.setattr(IP, "DENSE", 10)
    r = np.random.default_rng(2)
    x, v = r.normal(size=(4000, 2)), r.integers(0, 10, 4000).astype(float)
    whole, old = [], IP.products

    def counted(f, y, z, w):
        whole.append(len(z) == len(x))
        return old(f, y, z, w)

    monkeypatch.setattr(IP, "products", counted)
    model = Model((Rbf("bh3"), Rbf("bh3", (0.5,), A2)), 1)
    f = IP.Interpolant(model).fit(x, v, 1e-6)
    assert sum(whole) <= 2 * 2 * 8 * 2  # two kernels, two tiles of rows
    assert np.abs(f.values(x) - v).max() <= 1.1e-6
    far = IP.Interpolant(model).fit(x, v, 1e-6, spark=spark)
    assert np.abs(far.values(x) - v).max() <= 1.1e-6 and np.abs(far.weights - f.weights).max() < 1e-3 * np.abs(f.weights).max()
