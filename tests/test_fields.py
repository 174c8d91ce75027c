import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark import geometry as G
from fieldspark.functions import polynomial as P
from fieldspark.functions.kernels import KERNELS, Rbf, split_spheroidal
from fieldspark.model import Model
from fieldspark.operators import geostatistics as S
from fieldspark.operators import interpolation as IP
from fieldspark.operators import isosurface as I
from fieldspark.operators import neighbors as N
from fieldspark.operators import pointcloud as C
from fieldspark.operators.krylov import fgmres, gmres, minres
from fieldspark.sources import read_table, write_table

A = ((1.2, 0.1, 0.0), (0.0, 0.9, 0.2), (0.1, 0.0, 1.1))


def rbf(name, aniso=None):
    return Rbf(name, (1.1, 0.1) if KERNELS[name].order else (1.1, 0.9), aniso)


@pytest.mark.parametrize("name", list(KERNELS))
def test_kernel_derivatives(name):
    r = np.random.default_rng(1)
    x, e, b = r.normal(size=(30, 3)) * 0.3, 1e-6, rbf(name, A)
    num = np.stack([(b.evaluate(x + e * u) - b.evaluate(x - e * u)) / (2 * e) for u in np.eye(3)], -1)
    assert np.abs(b.gradient(x) - num).max() < 1e-4
    if KERNELS[name].bend:
        num = np.stack([(b.gradient(x + e * u) - b.gradient(x - e * u)) / (2 * e) for u in np.eye(3)], -2)
        assert np.abs(b.hessian(x) - num).max() < 1e-4
    else:
        with pytest.raises(ValueError):
            b.hessian(x)


def test_spheroidal_parts_add_up():
    r = np.linspace(0, 3, 50)
    for n in ("sp3", "sp5", "sp7", "sp9"):
        d, s = split_spheroidal(rbf(n))
        assert np.allclose(d(r) + s(r), rbf(n).evaluate(r[:, None])) and (d(r[r >= 0.9]) == 0).all()


def test_model_api():
    m = Model((Rbf("exp", (2.0, 3.0)), Rbf("sph", (1.0, 4.0), ((2.0, 0.0), (0.0, 1.0)))), 0, 0.5)
    assert m.parameter_names == ["nugget", "psill", "range", "psill", "range"] and m.with_parameters(m.parameters) == m
    assert Model.from_json(m.to_json()) == m and "psill" in m.description(2)
    assert Model.from_tokens([["exp", "2", "3"], ["sph", "1", "4", "aniso", "2", "0", "0", "1"]], 0, 0.5, 2) == m
    for bad in (lambda: Model((), 0), lambda: Model(Rbf("th3"), 0), lambda: Rbf("exp"), lambda: Rbf("nope"), lambda: Model(Rbf("bh3"), nugget=-1)):
        with pytest.raises(ValueError):
            bad()


def test_polynomials():
    assert [[P.size(d, k) for k in (-1, 0, 1, 2)] for d in (1, 2, 3)] == [[0, 1, 2, 3], [0, 1, 3, 6], [0, 1, 4, 10]]
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 3))
    i = P.unisolvent(x, 2)
    b = P.Lagrange(x[i], 2)
    assert np.abs(b.evaluate(x[i]) - np.eye(10)).max() < 1e-10
    with pytest.raises(ValueError):
        P.Lagrange(np.zeros((4, 3)), 1)
    e = 1e-6
    g = P.gradient_design(x, 2).reshape(60, 3, 10)
    num = np.stack([(P.design(x + e * u, 2) - P.design(x - e * u, 2)) / (2 * e) for u in np.eye(3)], 1)
    assert np.abs(g - num).max() < 1e-6


def test_krylov():
    r = np.random.default_rng(3)
    a = r.normal(size=(100, 100))
    a, b = a + a.T, r.normal(size=100)
    for f in (gmres, fgmres, minres):
        norms = [n for _, n in f(lambda v: a @ v, b, 140)]
        assert all(x >= y - 1e-9 for x, y in zip(norms, norms[1:])) and norms[-1] < 1e-6


def sines(n, d=3, seed=1):
    x = np.random.default_rng(seed).uniform(-1, 1, (n, d))
    return x, np.sin(np.pi * x).sum(1)


def test_fits_with_gradients_and_nugget():
    x, v = sines(300)
    g, _ = sines(50, seed=2)
    both = np.concatenate((v, (np.pi * np.cos(np.pi * g)).ravel()))
    for n in ("th3", "gau", "gc5", "th2"):
        f = IP.Interpolant(Model(rbf(n))).fit(x, both, grad_points=g)
        assert np.abs(f.values(x, g) - both).max() < 1e-3
    f = IP.Interpolant(Model(Rbf("exp", (1.0, 1.0)), 0, 0.01)).fit(x, v)
    assert np.abs(f.values(x) + 0.01 * f.weights[: len(x)] - v).max() < 1e-6
    for bad in (lambda f: f.fit(x[:0], v[:0]), lambda f: f.fit(x, v[:-1]), lambda f: f.fit(x, v, 0.0)):
        with pytest.raises(ValueError):
            bad(IP.Interpolant(Model(Rbf("bh3"))))
    with pytest.raises(RuntimeError):
        IP.Interpolant(Model(Rbf("bh3"))).values(x)


def test_iterative_fit_and_warm_start(spark, monkeypatch):
    monkeypatch.setattr(IP, "DENSE", 10)
    x, v = sines(900)
    m = Model(Rbf("bh3"))
    f = IP.Interpolant(m).fit(x[:800], v[:800], 1e-4)
    g = IP.Interpolant(m).fit(x, v, 1e-4, initial=f, spark=spark)
    assert np.abs(g.values(x) - v).max() <= 2e-4
    parts = IP.divide(x, 100)
    assert sorted(np.concatenate([i[inner] for i, inner in parts])) == list(range(900))


def test_incremental_and_inequality():
    x, v = sines(500)
    f = IP.Interpolant(Model(Rbf("bh3"))).fit_incrementally(x, v, 0.05)
    assert np.abs(f.values(x) - v).max() < 0.05 and len(f.centers) < 500
    n = lambda t: np.array([np.nan if c == "-" else float(c) for c in t.split()])
    value = n("1 - 4 - 3 - - - - - 3 - - 7 - 8 - - - 8 3 - - 6 -")
    lower = n("- 6 - 2 - 2 9 4 3 3 - - 7 - 4 - - - 5 - - 9 5 - -")
    upper = n("- - - 4 - 4 - - - - - 1 - - - - 4 7 - - - - - - 3")
    s = IP.Interpolant(Model(Rbf("exp", (1.0, 3.0)), -1)).fit_inequality(np.arange(25.0)[:, None], value, lower, upper, 1e-5).values(np.arange(25.0)[:, None])
    assert np.nanmax(np.abs(s - value)) < 1e-5 and np.nanmax(lower - s) < 1e-5 and np.nanmax(s - upper) < 1e-5


def test_evaluate_save_load(spark, tmp_path):
    x, v = sines(80)
    f = IP.Interpolant(Model(Rbf("th3"))).fit(x, v)
    f.save(spark, str(tmp_path / "m"))
    g = IP.Interpolant.load(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([(i, *map(float, p), "k") for i, p in enumerate(x)] + [(99, None, 0.0, 0.0, "k")], "id long, x double, y double, z double, tag string")
    got = sorted(g.evaluate(df, gradients=True).collect())
    assert max(abs(r.value - v[r.id]) for r in got[:-1]) < 1e-8 and got[-1].value is None
    assert np.allclose([r.dx for r in got[:-1]], f.values(x[:0], x).reshape(-1, 3)[:, 0])


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double, z double")


def test_distance_filter_fixtures(spark):
    dups = frame(spark, [(0, 0, 0)] * 3 + [(1, 0, 0)] * 3 + [(2, 0, 0)] * 3)
    ids = lambda d: sorted(r.id for r in d.select("id").collect())
    assert ids(N.distance_filter(dups, 0.5)) == [0, 3, 6] and ids(N.unique(dups)) == [0, 3, 6]
    assert ids(N.distance_filter(dups.where("id > 0").withColumn("o", -F.col("id")), 0.5, "o")) == [2, 5, 8]
    star = frame(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2)])
    assert ids(N.distance_filter(star, 1.5)) == [0, 4, 5, 6]
    x = np.random.default_rng(4).uniform(0, 1, (200, 3))
    assert ids(N.distance_filter(frame(spark, x), 0.2)) == N.greedy_filter(x, 0.2).tolist()
    with pytest.raises(ValueError):
        N.distance_filter(star, 0.0)


def test_knn_against_brute_force(spark):
    x = np.random.default_rng(5).normal(size=(150, 3))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    got = {(r.id, r["rank"]): r.other for r in N.knn_join(frame(spark, x), frame(spark, x), 4).collect()}
    assert got == {(i, k + 1): int(j) for i in range(150) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}


def test_variogram_of_a_tetrahedron(spark):
    s = np.sqrt(0.5)
    v = np.random.default_rng(6).normal(size=4)
    df = spark.createDataFrame([(i, *(2 * s * np.array(p)).tolist(), float(v[i])) for i, p in enumerate([(0.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0)])], "id long, x double, y double, z double, v double")
    rows = S.variogram(df, 1.0, 5).collect()
    assert len(rows) == 1 and rows[0].num_pairs == 6 and abs(rows[0].bin_distance - 2) < 1e-9 and abs(rows[0].bin_gamma - v.var(ddof=1)) < 1e-9
    assert S.variogram(df.where("false"), 0.2, 5).collect() == []
    assert len(S.directions(3, "anisotropic")) == 46 and len(S.directions(2, "anisotropic")) == 8


def test_variogram_fit_recovers_parameters(spark):
    m = Model(Rbf("sph", (3.0, 20.0)), 0, 1.0)
    d = np.arange(1, 15) * 2.0
    g = m.nugget + 3.0 - m.evaluate(d[:, None])
    rows = [(0, 1.0, k, float(a), float(b), 10) for k, (a, b) in enumerate(zip(d, g))]
    df = spark.createDataFrame(rows, "direction int, dx double, bin int, bin_distance double, bin_gamma double, num_pairs long")
    got, cost = S.fit_variogram(df, Model(Rbf("sph", (1.0, 10.0)), 0, 0.1))
    assert cost < 1e-6 and np.allclose(got.parameters, [1.0, 3.0, 20.0], rtol=1e-2)


def test_detrend_moments(spark):
    df = spark.range(4000).select("id", (F.rand(1) * 2 - 1).alias("x"), (F.rand(2) * 2 - 1).alias("y")).withColumn("v", F.expr("1 + x + y + x*x + x*y + y*y"))
    df = spark.createDataFrame(df.toPandas())
    r = S.detrend(df, 1).agg(F.avg("residual"), F.avg(F.col("residual") * F.col("x")), F.avg(F.col("residual") * F.col("y"))).first()
    assert max(map(abs, r)) < 1e-10
    assert S.detrend(df, 2).agg(F.max(F.abs("residual"))).first()[0] < 1e-9


def test_normal_scores_round_trip(spark):
    df = spark.range(500).select("id", (F.exp(F.randn(3))).alias("v"))
    df = spark.createDataFrame(df.toPandas())
    out, t = S.normal_score(df)
    r = out.select("v", t.back_transform(F.col("score")).alias("b")).toPandas()
    assert np.corrcoef(r.v, r.b)[0, 1] > 0.98
    with pytest.raises(ValueError):
        S.normal_score(df.limit(1))


def test_planes_and_normals(spark):
    o = frame(spark, [(13, 11, 12), (7, 11, 12), (10, 13, 12), (10, 9, 12), (10, 11, 13), (10, 11, 11)])
    r = C.plane_errors(o).first()
    assert np.allclose([r.point_error, r.line_error, r.plane_error], np.sqrt([28 / 6, 10 / 6, 2 / 6])) and abs(abs(r.nz) - 1) < 1e-9
    p = C.random_points(spark, 300, sphere=((0.0, 0.0, 0.0), 1.0), seed=5)
    p = spark.createDataFrame(p.toPandas())
    n = C.orient_closed_surface(C.normals_knn(p, 10), 10)
    t = n.agg(F.min(F.expr("x*nx + y*ny + z*nz")), F.min(F.expr("nx*nx + ny*ny + nz*nz"))).first()
    assert t[0] > 0.5 and abs(t[1] - 1) < 1e-9
    r = C.normals_radius(p, [0.5, 0.001])
    assert r.where("nx = 0 and ny = 0 and nz = 0").count() == 0 and C.normals_radius(p, 1e-6).where("nx <> 0").count() == 0
    s = np.array(C.sdf(n.select("id", *C.XYZ, *C.NORMAL), 0.05).select("x", "y", "z", "value").collect())
    x = np.array(p.select("x", "y", "z").collect())
    d = np.sqrt(((s[:, None, :3] - x) ** 2).sum(2)).min(1)
    assert np.abs(d - np.abs(s[:, 3])).max() < 1e-12 and np.abs(s[:, 3]).max() <= 0.05 and len(s) == 900
    a = np.array(C.thin_normals(n, 0.25).where("nx <> 0 or ny <> 0 or nz <> 0").select("id").collect())
    assert len(a) == 75


def test_isosurfaces(spark):
    box = G.Bbox((-1.2,) * 3, (1.2,) * 3)
    ball = lambda d: d.withColumn("value", F.sqrt(F.expr("x*x + y*y + z*z")))
    m = I.generate(spark, box, 0.1, ball, 1.0, local=lambda p: np.linalg.norm(p, axis=1))
    assert (len(m.vertices), len(m.faces)) == (1610, 3216) and not len(I.singular_vertices(m.faces, 1610))
    assert np.abs(np.linalg.norm(m.vertices, axis=1) - 1).max() < 1e-6
    e = m.edges()
    assert len(e) == 3 * 3216 and all((b, a) in e for a, b in e)
    seeded = I.generate(spark, box, 0.1, ball, 1.0, seeds=np.array([[1.0, 0.0, 0.0]]))
    assert len(seeded.faces) == 3216
    plane = lambda d: d.withColumn("value", F.expr("x + y + z") / float(np.sqrt(3)))
    m = I.generate(spark, box, 0.1, plane)
    assert (len(m.vertices), len(m.faces)) == (1122, 2021)
    unit = G.Bbox((-1.0,) * 3, (1.0,) * 3)
    m = [I.generate(spark, unit, 0.1, plane, float(s * 1.01 * np.sqrt(3))) for s in (-1, 1)]
    assert [(len(x.faces), x.entire) for x in m] == [(0, False), (0, True)]


def grid(n):
    v = np.array([(x, y, 0.0) for x in range(n) for y in range(n)])
    f = [t for x in range(n - 1) for y in range(n - 1) for a in [x * n + y] for t in ((a, a + n, a + n + 1), (a, a + n + 1, a + 1))]
    return I.Mesh(v, np.array(f))


def test_mesh_edits(tmp_path, spark):
    g = grid(4)
    m, ok = I.snap(g, np.array([[1.5, 1.5, 0.3], [1.5, 1.5, 1.5]]), 1.0)
    assert ok.tolist() == [True, False] and (m.vertices == [1.5, 1.5, 0.3]).all(1).any() and not len(I.singular_vertices(m.faces, len(m.vertices)))
    assert not len(I.intersecting_faces(m))
    fine = I.thin(grid(5), grid(5).vertices, 1.0)
    assert not len(I.singular_vertices(fine.faces, len(fine.vertices)))
    s = I.smooth(m, 1.0)
    assert len(s.faces) == len(m.faces) and not len(I.singular_vertices(s.faces, len(s.vertices)))
    fold = I.Mesh(np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0)], float), np.array([(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 1)]))
    r = I.refine(fold, lambda p: p[:, 0] - 5, 2.0)
    n = np.cross(r.vertices[r.faces[:, 1]] - r.vertices[r.faces[:, 0]], r.vertices[r.faces[:, 2]] - r.vertices[r.faces[:, 0]])
    assert (n[:, 2] > 0).all()
    c = I.clip(g, G.Bbox((0.5, 0.5, -1), (2.5, 2.5, 1)))
    area = np.linalg.norm(np.cross(c.vertices[c.faces[:, 1]] - c.vertices[c.faces[:, 0]], c.vertices[c.faces[:, 2]] - c.vertices[c.faces[:, 0]]), axis=1).sum() / 2
    assert abs(area - 4) < 1e-9
    two = I.Mesh(np.array([(0, 0, 0), (2, 0, 0), (0, 2, 0), (0.5, 0.5, -1), (0.5, 0.5, 1), (3, 3, 1.0)]), np.array([(0, 1, 2), (3, 4, 5)]))
    assert I.intersecting_faces(two).tolist() == [[0, 1]]
    c.export_obj(spark, str(tmp_path / "o"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert sum(t.startswith("f ") for t in lines) == len(c.faces)


def test_tables(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("# head\n1 2.5,x\r\n3\tnan 1e400\n1,2\n4,,5\n")
    got = [tuple(r)[1:] for r in read_table(spark, str(p)).orderBy("id").collect()]
    assert got[0][:2] == (1.0, 2.5) and np.isnan(got[0][2]) and got[1][0] == 3.0 and got[2][0] == 4.0 and np.isnan(got[2][1]) and len(got) == 3
    write_table(spark.createDataFrame([(1, 0.1, 2.0)], "id long, a double, b double"), str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["0.1 2.0"]


def test_geometry(spark):
    rot, scale = G.decompose_inverse_anisotropy(np.diag([2.0, 0.5]))
    assert np.allclose(sorted(scale), [0.5, 2.0]) and np.linalg.det(rot) > 0
    q = G.orthonormalize(np.random.default_rng(1).normal(size=(5, 3)))
    assert np.allclose(q.T @ q, np.eye(3))
    b = G.Bbox((0.0, 0.0), (1.0, 2.0))
    assert b.convex_hull(G.Bbox((2.0, 2.0), (3.0, 3.0))).high == (3.0, 3.0) and G.Bbox.empty(2).is_empty() and len(b.corners()) == 4
    assert json.loads(Model(Rbf("bh3")).to_json())["degree"] == 0


def test_directions_in_space():
    d = np.array(S.directions(3, "anisotropic"))
    assert d.shape == (46, 3) and np.allclose(np.linalg.norm(d, axis=1), 1)
    # fixed values: some of the vertices of the subdivided icosahedron
    for v in ((0.0, 0.0, 1.0), (0.10607892, 0.32647735, 0.9392336), (-0.18759248, 0.57735026, 0.79465449), (0.89442718, 0.0, 0.44721359), (-0.065560378, 0.85472882, 0.51491791), (-0.98224694, 0.0, 0.18759248), (0.10607892, 0.97943211, 0.17163931)):
        assert np.abs(d @ np.array(v)).max() > 1 - 1e-7
    cosines = np.abs(d @ d.T) - 2 * np.eye(46)
    assert cosines.max() < np.cos(np.radians(19))  # apart


def test_distance_filter_chains(spark):
    from pyspark.sql import functions as F

    line = spark.range(1000).select("id", F.col("id").cast("double").alias("x"))
    for per_block in (20_000, 90):  # in one block, through many
        got = sorted(r.id for r in N.distance_filter(line, 1.0, per_block=per_block).collect())
        assert got == list(range(0, 1000, 2))
    with pytest.raises(RuntimeError):
        N.distance_filter(line, 1.0, per_block=30, most_rounds=2)


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_range_join_broadcasts_no_side(spark):
    """A side that Spark takes to be small can still be too large for the driver's memory."""
    p = spark.createDataFrame([(i, float(i), float(i % 3), float(i)) for i in range(50)], "id long, x double, y double, v double")
    v = S.variogram(p, 3.0, 6, lag_tolerance=1.3, angle_tolerance=0.6, along=[(1.0, 0.0), (0.0, 2.0), (3.0, 4.0)])
    assert v.count() > 0 and "BroadcastHashJoin" not in _plan(v) and "SortMergeJoin" in _plan(v)


def test_directional_variogram_broadcasts_no_side(spark):
    p = spark.createDataFrame([(i, float(i), float(i % 3), float(i)) for i in range(50)], "id long, x double, y double, v double")
    v = S.variogram(p, 3.0, 6, lag_tolerance=1.3, along=S.directions(2, "anisotropic"))
    assert v.count() > 0 and "BroadcastHashJoin" not in _plan(v)


def test_blocks_find_what_all_pairs_do():
    r = np.random.default_rng(3)
    for n in (1, 5, 3000):
        x = r.normal(size=(n, 3)).round(1)
        t, p = N.Blocks(x), x[:50] + r.normal(size=(min(50, n), 3))
        r2 = r.uniform(0, 4, len(p))
        d = ((p[:, None] - x) ** 2).sum(2)
        i, best = t.nearest(p, r2)
        ok = d.min(1) <= r2
        assert (i == np.where(ok, d.argmin(1), -1)).all() and (best[ok] == d.min(1)[ok]).all()
        assert np.allclose(t.reach(p, min(6, n)), np.sqrt(np.sort(d, 1)[:, min(6, n) - 1]))


def test_sdf_of_many_points(spark):
    """No offset point meets all points: 200,000 of them would take tens of thousands of millions of distances."""
    p = spark.range(200_000).select("id", (F.col("id") * 10.0).alias("x"), *(F.lit(c).alias(n) for n, c in (("y", 0.0), ("z", 0.0), ("nx", 0.0), ("ny", 0.0), ("nz", 1.0))))
    start = time.time()
    s = C.sdf(p, 0.5)
    assert s.groupBy("z", "value").count().orderBy("z").collect() == [(-0.5, -0.5, 200_000), (0.0, 0.0, 200_000), (0.5, 0.5, 200_000)] and time.time() - start < 60


def test_thin_normals_rounds_halves_up(spark):
    p = spark.range(10).select("id", *(F.lit(1.0).alias(c) for c in C.NORMAL))
    assert C.thin_normals(p, 0.25).where("nz > 0").count() == 3


def test_polynomial_data_need_no_kernel():
    """More rows than are solved densely: the least-squares polynomial is the fit, without a step of the solver."""
    x = np.random.default_rng(6).normal(size=(20_000, 3))
    v = 1 + 2 * x[:, 0] - x[:, 1] + 3 * x[:, 2]
    start = time.time()
    f = IP.Interpolant(Model(Rbf("th3"), 1)).fit(x, v)
    assert not f.weights[: len(x)].any() and np.abs(f.values(x) - v).max() < 1e-9 and time.time() - start < 20


def test_tiled_products_are_the_kernel_matrix():
    r = np.random.default_rng(7)
    x, y, w = r.normal(size=(2100, 3)), r.normal(size=(130, 3)), r.normal(size=2100)
    w[::3] = 0
    for name in KERNELS:
        m = Model(rbf(name, A))
        f = IP.Interpolant(m, x, x[:0], np.append(w, np.zeros(m.basis_size(3))))
        assert np.allclose(f.values(y), IP.kernel_rows(m, y, y[:0], x, x[:0]) @ w, rtol=1e-9, atol=1e-9)
