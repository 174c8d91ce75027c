"""Command line: python -m fieldspark.cli VERB ... ; tables are delimited text, models JSON, interpolants and variograms folders."""

from __future__ import annotations

import argparse
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import Bbox
from .model import Model
from .operators import geostatistics as S
from .operators import isosurface as I
from .operators import neighbors as N
from .operators import pointcloud as C
from .operators.interpolation import Interpolant, cross_validate
from .plans import workflows as W
from .sources import read_table, write_table

AXES = ["x", "y", "z"]


def _table(spark: SparkSession, path: str, dim: int, *more: str) -> DataFrame:
    df = read_table(spark, path)
    cells = df.columns[1:]
    names = [*AXES[:dim], *more, *(f"c{i}" for i in range(len(cells)))][: len(cells)]
    return df.toDF("id", *names)


def _model(args) -> Model:
    if args.model:
        return Model.from_json(Path(args.model).read_text())
    return Model.from_tokens(args.rbf, args.deg, args.nug, args.dim)


def _array(df: DataFrame, *names: str) -> np.ndarray:
    return np.array(df.orderBy("id").select(*names).collect(), float).reshape(-1, len(names))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldspark")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *flags: str, model: bool = False):
        s = sub.add_parser(name)
        s.add_argument("--dim", type=int, choices=(1, 2, 3), default=3)
        for f in flags:
            s.add_argument("--" + f, required=f in ("in", "out"))
        if model:
            s.add_argument("--model")
            s.add_argument("--rbf", nargs="+", action="append", default=[])
            s.add_argument("--nug", type=float, default=0.0)
            s.add_argument("--deg", type=int)
        return s

    verb("create-model", "out", model=True)
    verb("extract-model", "in", "out")
    verb("show-model", "in")
    s = verb("fit", "in", "out", "grad-in", "initial", model=True)
    s.add_argument("--tol", type=float, required=True)
    s.add_argument("--grad-tol", type=float)
    s.add_argument("--max-iter", type=int, default=100)
    s.add_argument("--ineq", action="store_true")
    s.add_argument("--reduce", action="store_true")
    verb("evaluate", "in", "out", "points").add_argument("--grad", action="store_true")
    verb("cross-validate", "in", "out", model=True).add_argument("--tol", type=float, required=True)
    verb("unique", "in", "out").add_argument("--dist", type=float, default=N.LEAST_DISTANCE)
    s = verb("variogram", "in", "out")
    for f, t in (("lag", float), ("num-lags", int), ("lag-tol", float), ("angle-tol", float), ("detrend", int)):
        s.add_argument("--" + f, type=t)
    s.add_argument("--normal-score", action="store_true")
    s.add_argument("--aniso", action="store_true")
    verb("show-variogram", "in")
    s = verb("fit-model-to-variogram", "in", "out", model=True)
    s.add_argument("--num-trials", type=int, default=30)
    s.add_argument("--weights", choices=list(S.WEIGHTS), default="num_pairs")
    s = verb("estimate-normals", "in", "out")
    s.add_argument("--k", type=int, nargs="+")
    s.add_argument("--radius", type=float, nargs="+")
    s.add_argument("--threshold", type=float, default=1.8)
    s.add_argument("--closed", type=int, nargs="?", const=100)
    s.add_argument("--point", type=float, nargs=3)
    s.add_argument("--direction", type=float, nargs=3)
    s = verb("normals-to-sdf", "in", "out")
    s.add_argument("--offset", type=float, default=0.0)
    s.add_argument("--ratio", type=float)
    s.add_argument("--aniso", type=float, nargs=9)
    for name in ("isosurface", "surface-25d"):
        s = verb(name, "in", "out", "seeds", "snap")
        s.add_argument("--bbox", type=float, nargs=6, required=True)
        s.add_argument("--res", type=float, required=True)
        s.add_argument("--isoval", type=float, default=0.0)
        s.add_argument("--aniso", type=float, nargs=9)
    return p


def run(spark: SparkSession, argv: list[str]) -> str | None:
    args = parser().parse_args(argv)
    source, on, v = getattr(args, "in", None), AXES[: args.dim], args.verb
    if v == "create-model":
        Path(args.out).write_text(_model(args).to_json())
    elif v == "extract-model":
        Path(args.out).write_text(Interpolant.load(spark, source).model.to_json())
    elif v == "show-model":
        return Model.from_json(Path(source).read_text()).description(args.dim)
    elif v == "fit":
        df, f = _table(spark, source, args.dim, "v", "lower", "upper"), Interpolant(_model(args))
        if args.ineq and args.grad_in or args.initial and args.reduce:
            raise SystemExit("these options exclude each other")
        x, val = _array(df, *on), _array(df, "v")[:, 0]
        g = gv = None
        if args.grad_in:
            t = _table(spark, args.grad_in, args.dim, *("d" + a for a in on))
            g, gv = _array(t, *on), _array(t, *("d" + a for a in on)).ravel()
            val = np.concatenate((val, gv))
        if args.ineq:
            f.fit_inequality(x, val, _array(df, "lower")[:, 0], _array(df, "upper")[:, 0], args.tol, args.max_iter)
        elif args.reduce:
            f.fit_incrementally(x, val, args.tol, g, args.grad_tol)
        else:
            f.fit(x, val, args.tol, g, args.grad_tol, args.max_iter, initial=Interpolant.load(spark, args.initial) if args.initial else None, spark=spark)
        f.save(spark, args.out)
    elif v == "evaluate":
        write_table(Interpolant.load(spark, source).evaluate(_table(spark, args.points, args.dim), args.grad, on=on), args.out)
    elif v == "cross-validate":
        df = _table(spark, source, args.dim, "v", "fold")
        write_table(cross_validate(_model(args), df.withColumn("fold", F.col("fold").cast("int")), tolerance=args.tol), args.out)
    elif v == "unique":
        write_table(N.unique(_table(spark, source, args.dim), args.dist), args.out)
    elif v == "variogram":
        along = S.directions(args.dim, "anisotropic") if args.aniso else None
        angle = None if args.angle_tol is None else float(np.radians(args.angle_tol))
        W.experimental_variogram(_table(spark, source, args.dim, "v"), args.lag, args.num_lags, args.detrend, args.normal_score, lag_tolerance=args.lag_tol, angle_tolerance=angle, along=along).write.mode("overwrite").parquet(args.out)
    elif v == "show-variogram":
        rows = spark.read.parquet(source).orderBy("direction", "bin").collect()
        return "\n".join(" ".join(f"{c:g}" for c in r) for r in rows)
    elif v == "fit-model-to-variogram":
        m, _ = S.fit_variogram(spark.read.parquet(source), _model(args), S.WEIGHTS[args.weights], args.num_trials)
        Path(args.out).write_text(m.to_json())
    elif v == "estimate-normals":
        write_table(W.normals(_table(spark, source, 3), args.k, args.radius, args.threshold, args.closed, args.point, args.direction).drop("plane_factor"), args.out)
    elif v == "normals-to-sdf":
        df = _table(spark, source, 3, *C.NORMAL)
        df = df if args.ratio is None else C.thin_normals(df, args.ratio)
        write_table(C.sdf(df, args.offset, None if args.aniso is None else np.array(args.aniso).reshape(3, 3)), args.out, order=None)
    else:
        f = Interpolant.load(spark, source)
        box = Bbox(tuple(args.bbox[:3]), tuple(args.bbox[3:]))
        field = I.field_of(f) if v == "isosurface" else I.field_25d(f)
        local = f.values if v == "isosurface" else (lambda x: x[:, 2] - f.values(x[:, :2]))
        seeds = _array(_table(spark, args.seeds, 3), *AXES) if args.seeds else None
        snap = _array(_table(spark, args.snap, 3), *AXES) if args.snap else None
        I.generate(spark, box, args.res, field, args.isoval, None if args.aniso is None else np.array(args.aniso).reshape(3, 3), local, seeds, snap).export_obj(spark, args.out)
    return None


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("fieldspark").getOrCreate()
    text = run(session, sys.argv[1:])
    if text:
        print(text)
