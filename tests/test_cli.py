import numpy as np

from fieldspark.cli import run
from fieldspark.geometry import Bbox
from fieldspark.operators import isosurface as I


def text(spark, path):
    return [list(map(float, r.value.split(" "))) for r in spark.read.text(str(path)).collect()]


def test_verbs(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    r = np.random.default_rng(1)
    x = r.uniform(0, 10, (60, 2))
    v = np.sin(x).sum(1)
    np.savetxt(t("data"), np.column_stack((x, v, np.arange(60) % 3)))
    run(spark, ["create-model", "--dim", "2", "--rbf", "exp", "1", "5", "--deg", "0", "--out", t("model")])
    assert "psill" in run(spark, ["show-model", "--dim", "2", "--in", t("model")])
    run(spark, ["fit", "--dim", "2", "--in", t("data"), "--model", t("model"), "--tol", "1e-6", "--out", t("fit")])
    np.savetxt(t("at"), x)
    run(spark, ["evaluate", "--dim", "2", "--in", t("fit"), "--points", t("at"), "--out", t("values")])
    assert np.allclose(np.array(text(spark, t("values")))[:, 2], v, atol=1e-6)
    run(spark, ["extract-model", "--in", t("fit"), "--out", t("model2")])
    assert open(t("model")).read() == open(t("model2")).read()
    run(spark, ["cross-validate", "--dim", "2", "--in", t("data"), "--model", t("model"), "--tol", "1e-6", "--out", t("cv")])
    assert np.array(text(spark, t("cv"))).shape == (60, 5)
    run(spark, ["unique", "--dim", "2", "--in", t("data"), "--dist", "2", "--out", t("few")])
    assert 0 < len(text(spark, t("few"))) < 60
    run(spark, ["variogram", "--dim", "2", "--in", t("data"), "--lag", "1", "--num-lags", "6", "--detrend", "1", "--normal-score", "--out", t("vg")])
    assert len(run(spark, ["show-variogram", "--in", t("vg")]).splitlines()) >= 5
    run(spark, ["fit-model-to-variogram", "--dim", "2", "--in", t("vg"), "--rbf", "sph", "1", "3", "--out", t("model3"), "--num-trials", "2"])
    assert "sph" in open(t("model3")).read()
    run(spark, ["surface-25d", "--in", t("fit"), "--bbox", "2", "2", "-3", "5", "5", "3", "--res", "0.5", "--out", t("obj")])
    assert any(r.value.startswith("f ") for r in spark.read.text(t("obj")).collect())


def test_surface_from_points(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    x = np.random.default_rng(2).normal(size=(150, 3))
    np.savetxt(t("p"), x / np.linalg.norm(x, axis=1, keepdims=True))
    run(spark, ["estimate-normals", "--in", t("p"), "--k", "8", "--threshold", "0", "--closed", "8", "--out", t("n")])
    run(spark, ["normals-to-sdf", "--in", t("n"), "--offset", "0.1", "--out", t("s")])
    run(spark, ["fit", "--in", t("s"), "--rbf", "bh3", "--tol", "1e-6", "--out", t("f")])
    run(spark, ["isosurface", "--in", t("f"), "--bbox", "-1.5", "-1.5", "-1.5", "1.5", "1.5", "1.5", "--res", "0.3", "--out", t("o")])
    v = np.array([list(map(float, r.value.split()[1:])) for r in spark.read.text(t("o")).collect() if r.value.startswith("v ")])
    assert len(v) > 50 and np.abs(np.linalg.norm(v, axis=1) - 1).max() < 0.2


def test_offset_surface_and_stream(spark, tmp_path):
    from fieldspark.functions.kernels import Rbf
    from fieldspark.model import Model
    from fieldspark.operators.interpolation import Interpolant
    from fieldspark.plans.workflows import offset_surface
    from fieldspark.streaming import evaluate_stream, read_variogram, variogram_sink

    box = Bbox((-1.5,) * 3, (1.5,) * 3)
    ball = I.generate(spark, Bbox((-1.2,) * 3, (1.2,) * 3), 0.4, lambda d: d.selectExpr("*", "sqrt(x*x + y*y + z*z) as value"), 0.7)
    sides = np.array([(1.0, 0, 0, 0), (-1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0), (0, -1.2, 0, 1)], float)
    m = offset_surface(spark, ball, sides, 0.3, box, 0.4, Model(Rbf("bh3")))
    assert len(m.faces) > 20
    spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(20)], "id long, x double, v double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long, x double, v double").parquet(str(tmp_path / "in"))
    q = s.writeStream.foreachBatch(variogram_sink(str(tmp_path / "out"), 1.0, 4)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert read_variogram(spark, str(tmp_path / "out")).where("bin = 1").first().num_pairs == 19
    f = Interpolant(Model(Rbf("bh3"))).fit(np.arange(3.0)[:, None], np.arange(3.0))
    q = evaluate_stream(s, f).writeStream.format("memory").queryName("ev").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ev").count() == 20
