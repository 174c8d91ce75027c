"""Registered queries of the interpolation and geostatistics operators over whole tables, and their independent SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geometry as G
from .functions import polynomial as P
from .functions import predicates as T
from .functions import scalar as Z
from .functions.kernels import KERNELS, Rbf
from .functions.scalar import inv_normal_cdf_sql
from .model import Model
from .operators import geostatistics as S
from .operators import isosurface as I
from .operators import neighbors as N
from .operators import pointcloud as C
from .operators.interpolation import Interpolant, cross_validate, saddle_map, training
from .operators.summation import compact_sum
from .plans.tables import shared_dir
from .sources import points, read_table, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

P1 = "(SELECT s_suppkey AS id, s_suppkey::DOUBLE AS x, s_acctbal::DOUBLE AS v FROM supplier)"
PC = "(SELECT c_custkey AS id, c_custkey::DOUBLE AS x, c_nationkey::DOUBLE AS y, c_acctbal::DOUBLE AS v FROM customer)"
PP = "(SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part)"
P3 = "(SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label::DOUBLE AS v FROM embeddings)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(c: Column | str, k: int) -> Column:
    return F.round(c, k) + F.lit(0.0)


# ---- scalar kernels ------------------------------------------------------------------------------
_R = "sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000) / 1e4)"
_Q = "(r / 20.0)"
_TAILS = {"sp3": (0.18657871684006438, 2.009875543958482, 0.8734640537108553, 7.181510581693163), "sp5": (0.2580127411803573, 1.6149073288415876, 0.8575980168032007, 2.5036086535164204), "sp7": (0.2944149476843637, 1.4859979204216045, 0.8494862533016855, 1.44208314742683), "sp9": (0.31622776601683794, 1.4230249470757708, 0.8445585690332554, 1.0)}
_RHO = "sqrt(r * r + 0.25)"
_KERNEL_SQL = {
    "bh2": f"1.1 * {_RHO} * {_RHO} * ln({_RHO})", "th2": f"-1.1 * {_RHO} * {_RHO} * {_RHO} * {_RHO} * ln({_RHO})", "bh3": f"-1.1 * {_RHO}", "th3": f"1.1 * {_RHO} * {_RHO} * {_RHO}",
    "exp": f"1.1 * exp(-3 * {_Q})", "gau": f"1.1 * exp(-3 * {_Q} * {_Q})", "sph": f"CASE WHEN r < 20 THEN 1.1 * (1 - 1.5 * {_Q} + 0.5 * {_Q} ** 3) ELSE 0 END",
    "cub": f"CASE WHEN r < 20 THEN 1.1 * (1 - 7 * {_Q} ** 2 + 8.75 * {_Q} ** 3 - 3.5 * {_Q} ** 5 + 0.75 * {_Q} ** 7) ELSE 0 END",
    "gc3": f"1.1 / (1 + 7 * {_Q} ** 2) ** 1.5", "gc5": f"1.1 / (1 + 2.4822022531844965 * {_Q} ** 2) ** 2.5", "gc7": f"1.1 / (1 + 1.438027308408951 * {_Q} ** 2) ** 3.5", "gc9": f"1.1 / (1 + {_Q} ** 2) ** 4.5",
} | {k: f"CASE WHEN {_Q} < {e!r} THEN 1.1 * (1 - {a!r} * {_Q}) ELSE 1.1 * {b!r} / (1 + {c!r} * {_Q} ** 2) ** ({k[2]}.0 / 2) END" for k, (e, a, b, c) in _TAILS.items()}


def _kernel(name: str):
    rbf = Rbf(name, (1.1, 0.5) if KERNELS[name].order else (1.1, 20.0))

    @query(f"rbf_values_{name}", f"SELECT id, round({_KERNEL_SQL[name]}, {3 if KERNELS[name].order else 6}) + 0.0 AS value FROM (SELECT id, {_R} AS r FROM {PP})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points(spark, sf_dir, "part")
        return p.select("id", rounded(rbf.column(F.col("x") - 25, (F.col("y") - 1000) / 100), 3 if KERNELS[name].order else 6).alias("value"))


for _name in KERNELS:
    _kernel(_name)


@query("rbf_gradients", f"SELECT id, round(-6.6 / 400 * exp(-3 * (u * u + w * w) / 400) * u, 9) + 0.0 AS gx, round(-6.6 / 400 * exp(-3 * (u * u + w * w) / 400) * w, 9) + 0.0 AS gy FROM (SELECT id, x - 25 AS u, (y - 1000) / 100 AS w FROM {PP})")
def rbf_gradients(spark, sf_dir):
    gx, gy = Rbf("gau", (1.1, 20.0)).gradient_columns(F.col("x") - 25, (F.col("y") - 1000) / 100)
    return points(spark, sf_dir, "part").select("id", rounded(gx, 9).alias("gx"), rounded(gy, 9).alias("gy"))


@query("poly_design_matrix", f"SELECT id, 1.0::DOUBLE AS b0, x AS b1, y AS b2, round(x * x, 4) AS b3, round(x * y, 4) AS b4, round(y * y, 4) AS b5 FROM {PP}")
def poly_design_matrix(spark, sf_dir):
    return points(spark, sf_dir, "part").select("id", *(F.round(c, 4).alias(f"b{i}") for i, c in enumerate(P.columns([F.col("x"), F.col("y")], 2))))


@query("aniso_transform", f"SELECT id, round(2 * x + 0.5 * y, 6) + 0.0 AS x, round(-x + 0.25 * y, 6) + 0.0 AS y FROM {PP}")
def aniso_transform(spark, sf_dir):
    return G.transform(points(spark, sf_dir, "part"), [[2, 0.5], [-1, 0.25]]).select("id", rounded("x", 6).alias("x"), rounded("y", 6).alias("y"))


@query("bbox", f"SELECT min(x) AS low_x, min(y) AS low_y, min(z) AS low_z, max(x) AS high_x, max(y) AS high_y, max(z) AS high_z FROM {P3}")
def bbox(spark, sf_dir):
    b = G.Bbox.of(points(spark, sf_dir, "embeddings"))
    return spark.createDataFrame([(*b.low, *b.high)], "low_x double, low_y double, low_z double, high_x double, high_y double, high_z double")


@query("bbox_contains", f"SELECT id FROM {P3} WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN 0 AND 1")
def bbox_contains(spark, sf_dir):
    return points(spark, sf_dir, "embeddings").where(G.Bbox((-0.1, -0.1, 0.0), (0.1, 0.1, 1.0)).inside(["x", "y", "z"])).select("id")


@query("complementary_indices", f"SELECT id FROM {PC} WHERE NOT v < 0")
def complementary_indices(spark, sf_dir):
    c = points(spark, sf_dir, "customer")
    return G.complement(c, G.where(c, F.col("v") < 0)).select("id")


@query("arg_where", f"SELECT id FROM {PC} WHERE v > 5000")
def arg_where(spark, sf_dir):
    return G.where(points(spark, sf_dir, "customer"), F.col("v") > 5000)


@query("row_gather", f"SELECT id, x, v FROM {PC} WHERE y = 3")
def row_gather(spark, sf_dir):
    c = points(spark, sf_dir, "customer")
    return G.gather(c, G.where(c, F.col("y") == 3)).select("id", "x", "v")


# ---- variograms -----------------------------------------------------------------------------------
def _pairs(src: str, on: str) -> str:
    dist = " + ".join(f"(b.{c} - a.{c}) * (b.{c} - a.{c})" for c in on)
    diff = ", ".join(f"b.{c} - a.{c} AS d{c}" for c in on)
    return f"(SELECT sqrt({dist}) AS d, (a.v - b.v) * (a.v - b.v) / 2 AS g, {diff} FROM {src} a JOIN {src} b ON a.id < b.id)"


def _bins(pairs: str, lag: float, lags: int, tol: float, direction: str = "0") -> str:
    return f"""SELECT direction, bin::INTEGER AS bin, round(avg(d), 6) AS bin_distance, round(avg(g), 4) AS bin_gamma, count(*)::BIGINT AS num_pairs FROM (
        SELECT {direction} AS direction, d, g, unnest(range(greatest(ceil((d - {tol}) / {lag}), 0)::INT, least(floor((d + {tol}) / {lag}), {lags - 1})::INT + 1)) AS bin FROM {pairs}) GROUP BY ALL"""


def _shown(v: DataFrame) -> DataFrame:
    return v.select("direction", "bin", F.round("bin_distance", 6).alias("bin_distance"), F.round("bin_gamma", 4).alias("bin_gamma"), "num_pairs")


@query("variogram_iso_1d", _bins(_pairs(P1, "x"), 5, 15, 2.5))
def variogram_iso_1d(spark, sf_dir):
    return _shown(S.variogram(points(spark, sf_dir, "supplier"), 5.0, 15))


@query("variogram_lag_tol_overlap", _bins(_pairs(P1, "x"), 5, 10, 6))
def variogram_lag_tol_overlap(spark, sf_dir):
    return _shown(S.variogram(points(spark, sf_dir, "supplier"), 5.0, 10, lag_tolerance=6.0))


@query("variogram_iso_3d", _bins(_pairs(P3, "xyz"), 0.05, 8, 0.025))
def variogram_iso_3d(spark, sf_dir):
    return _shown(S.variogram(points(spark, sf_dir, "embeddings"), 0.05, 8))


_DOTS2 = ", ".join(f"(dx * {math.cos(k * math.pi / 8)!r} + dy * {math.sin(k * math.pi / 8)!r}) ** 2" for k in range(8))


@query("variogram_aniso_2d", _bins(f"(SELECT *, list_position(q, list_max(q)) - 1 AS w FROM (SELECT *, [{_DOTS2}] AS q FROM {_pairs(PC, 'xy')}))", 3, 6, 1.3, "w"))
def variogram_aniso_2d(spark, sf_dir):
    return _shown(S.variogram(points(spark, sf_dir, "customer"), 3.0, 6, lag_tolerance=1.3, along=S.directions(2, "anisotropic")))


_DOTS3 = ", ".join(f"(dx * {a!r} + dy * {b!r} + dz * {c!r}) ** 2" for a, b, c in S.directions(3, "anisotropic"))


@query("variogram_aniso_3d", _bins(f"(SELECT *, list_position(q, list_max(q)) - 1 AS w FROM (SELECT *, [{_DOTS3}] AS q FROM {_pairs(P3, 'xyz')}))", 0.05, 4, 0.025, "w"))
def variogram_aniso_3d(spark, sf_dir):
    return _shown(S.variogram(points(spark, sf_dir, "embeddings"), 0.05, 4, along=S.directions(3, "anisotropic")))


_CONE = math.cos(math.radians(35.0)) ** 2


@query("variogram_angle_tol", " UNION ALL ".join(_bins(f"(SELECT * FROM {_pairs(PC, 'xy')} WHERE ({dot}) ** 2 >= d * d * {_CONE!r})", 3, 6, 1.3, str(k)) for k, dot in enumerate(("dx", "dy", "0.6 * dx + 0.8 * dy"))))
def variogram_angle_tol(spark, sf_dir):
    return _shown(S.variogram(points(spark, sf_dir, "customer"), 3.0, 6, lag_tolerance=1.3, angle_tolerance=math.radians(35.0), along=[(1.0, 0.0), (0.0, 2.0), (3.0, 4.0)]))


@query("variogram_merge", _bins(_pairs(P1, "x"), 5, 15, 2.5))
def variogram_merge(spark, sf_dir):
    """Odd and even pair distances as two partial variograms, added up."""
    p = points(spark, sf_dir, "supplier")
    a, b = (S.variogram(p.where(t), 5.0, 15) for t in ("id % 2 = 0", "id % 2 = 1"))
    cross = S.variogram(p, 5.0, 15).alias("w").join(a.unionByName(b).groupBy("direction", "bin").agg(F.sum("num_pairs").alias("n"), F.sum(F.col("num_pairs") * F.col("bin_distance")).alias("d"), F.sum(F.col("num_pairs") * F.col("bin_gamma")).alias("g")), ["direction", "bin"], "left")
    n = F.coalesce("n", F.lit(0))
    rest = cross.where(F.col("num_pairs") > n).select("direction", "dx", "bin", ((F.col("bin_distance") * F.col("num_pairs") - F.coalesce("d", F.lit(0.0))) / (F.col("num_pairs") - n)).alias("bin_distance"), ((F.col("bin_gamma") * F.col("num_pairs") - F.coalesce("g", F.lit(0.0))) / (F.col("num_pairs") - n)).alias("bin_gamma"), (F.col("num_pairs") - n).alias("num_pairs"))
    return _shown(S.merge_variograms(a.unionByName(b).unionByName(rest)))


@query("variogram_counts", f"SELECT count(DISTINCT direction)::BIGINT AS num_variograms, count(*)::BIGINT AS num_bins, sum(num_pairs)::BIGINT AS num_pairs FROM ({_bins(_pairs(P1, 'x'), 5, 15, 2.5)})")
def variogram_counts(spark, sf_dir):
    return S.counts(S.variogram(points(spark, sf_dir, "supplier"), 5.0, 15))


_MODEL_G = "(10.0 + 1000.0 * (1 - exp(-3 * bin_distance / 40)))"
_VARIO = _bins(_pairs(P1, "x"), 5, 15, 2.5).replace("round(avg(d), 6)", "avg(d)").replace("round(avg(g), 4)", "avg(g)")
_MODEL = Model(Rbf("exp", (1000.0, 40.0)), 0, 10.0)


@query("model_variogram", f"SELECT bin, round({_MODEL_G}, 6) AS model_gamma FROM ({_VARIO})")
def model_variogram(spark, sf_dir):
    return S.model_variogram(S.variogram(points(spark, sf_dir, "supplier"), 5.0, 15), _MODEL).select("bin", F.round("model_gamma", 6).alias("model_gamma"))


def _residual(name: str, w: S.Weight):
    sql = f"bin_distance ** ({w.distance} / 2.0) * {_MODEL_G} ** ({w.gamma} / 2.0) * num_pairs ** ({w.pairs} / 2.0)"

    @query(f"variogram_residuals_{name}", f"SELECT bin, round({sql} * (bin_gamma - {_MODEL_G}), 2) + 0.0 AS residual FROM ({_VARIO})")
    def run(spark, sf_dir):
        return S.residuals(S.variogram(points(spark, sf_dir, "supplier"), 5.0, 15), _MODEL, w).select("bin", rounded("residual", 2).alias("residual"))


for _name, _w in S.WEIGHTS.items():
    _residual(_name, _w)


@query("fit_variogram_model", "SELECT true AS better")
def fit_variogram_model(spark, sf_dir):
    """Property: the fitted model's weighted squares lie below the first guess's."""
    v = S.variogram(points(spark, sf_dir, "supplier"), 5.0, 15)
    _, cost = S.fit_variogram(v, Model(Rbf("exp", (1e6, 40.0)), 0, 1e5))
    r = S.residuals(v, Model(Rbf("exp", (1e6, 40.0)), 0, 1e5), S.WEIGHTS["num_pairs"]).agg((F.sum(F.col("residual") * F.col("residual")) / 2).alias("c"))
    return r.select((F.col("c") >= cost).alias("better"))


# ---- detrending and normal scores ---------------------------------------------------------------
@query("detrend_0_1d", f"SELECT id, round(v - avg(v) OVER (), 4) + 0.0 AS residual FROM {P1}")
def detrend_0_1d(spark, sf_dir):
    return S.detrend(points(spark, sf_dir, "supplier"), 0).select("id", rounded("residual", 4).alias("residual"))


@query("detrend_1_1d", f"SELECT id, round(v - (SELECT regr_intercept(v, x) FROM {P1}) - x * (SELECT regr_slope(v, x) FROM {P1}), 4) + 0.0 AS residual FROM {P1}")
def detrend_1_1d(spark, sf_dir):
    return S.detrend(points(spark, sf_dir, "supplier"), 1).select("id", rounded("residual", 4).alias("residual"))


@query("detrend_2_1d", f"""WITH c AS (SELECT id, v - avg(v) OVER () AS v, x - avg(x) OVER () AS a, x * x - avg(x * x) OVER () AS b FROM {P1}),
m AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * v) AS av, sum(b * v) AS bv FROM c)
SELECT id, round(v - a * (av * bb - bv * ab) / (aa * bb - ab * ab) - b * (aa * bv - ab * av) / (aa * bb - ab * ab), 4) + 0.0 AS residual FROM c, m""")
def detrend_2_1d(spark, sf_dir):
    return S.detrend(points(spark, sf_dir, "supplier"), 2).select("id", rounded("residual", 4).alias("residual"))


@query("detrend_1_2d", f"""WITH c AS (SELECT id, v - avg(v) OVER () AS v, x - avg(x) OVER () AS a, y - avg(y) OVER () AS b FROM {PC}),
m AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * v) AS av, sum(b * v) AS bv FROM c)
SELECT id, round(v - a * (av * bb - bv * ab) / (aa * bb - ab * ab) - b * (aa * bv - ab * av) / (aa * bb - ab * ab), 4) + 0.0 AS residual FROM c, m""")
def detrend_1_2d(spark, sf_dir):
    return S.detrend(points(spark, sf_dir, "customer"), 1).select("id", rounded("residual", 4).alias("residual"))


_SCORE = f"(SELECT *, {inv_normal_cdf_sql('p')} AS y FROM (SELECT id, v, (2 * row_number() OVER (ORDER BY v, id) - 1) / (2.0 * count(*) OVER ()) AS p, lag(v) OVER (ORDER BY v, id) AS lo, lead(v) OVER (ORDER BY v, id) AS hi FROM {PC}))"


@query("normal_score", f"SELECT id, round(y, 9) + 0.0 AS score FROM {_SCORE}")
def normal_score(spark, sf_dir):
    return S.normal_score(points(spark, sf_dir, "customer"), hermite=1)[0].select("id", rounded("score", 9).alias("score"))


_STEP = "(coalesce(lo, v) - coalesce(hi, v)) / 2 * exp(-y * y / 2) / sqrt(2 * pi())"
_COEF = f"(SELECT avg(v) AS c0, sum({_STEP}) AS c1, sum({_STEP} * -y) / sqrt(2) AS c2, sum({_STEP} * (y * y / sqrt(2) - 1 / sqrt(2))) / sqrt(3) AS c3 FROM {_SCORE})"


@query("hermite_coeffs", " UNION ALL ".join(f"SELECT {k} AS p, round(c{k}, 4) + 0.0 AS c FROM {_COEF}" for k in range(4)))
def hermite_coeffs(spark, sf_dir):
    t = S.normal_score(points(spark, sf_dir, "customer"), hermite=3)[1]
    return spark.createDataFrame([(k, round(c, 4) + 0.0) for k, c in enumerate(t.coefficients)], "p int, c double")


@query("back_transform", f"SELECT id, round(c0 - c1 * y + c2 * (y * y - 1) / sqrt(2) + c3 * (-y * (y * y - 1) / sqrt(2) / sqrt(3) + y * sqrt(2.0 / 3)), 3) + 0.0 AS back FROM {_SCORE}, {_COEF}")
def back_transform(spark, sf_dir):
    df, t = S.normal_score(points(spark, sf_dir, "customer"), hermite=3)
    return df.select("id", rounded(t.back_transform(F.col("score")), 3).alias("back"))


@query("back_transform_gamma", f"SELECT n_nationkey AS k, round(c1 * c1 * g + c2 * c2 * (1 - (1 - g) ** 2) + c3 * c3 * (1 - (1 - g) ** 3), 1) + 0.0 AS gamma FROM (SELECT n_nationkey, n_nationkey / 25.0 AS g FROM nation), {_COEF}")
def back_transform_gamma(spark, sf_dir):
    t = S.normal_score(points(spark, sf_dir, "customer"), hermite=3)[1]
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("k"), rounded(t.back_transform_gamma(F.col("n_nationkey") / 25.0), 1).alias("gamma"))


# ---- spatial search ---------------------------------------------------------------------------
_D3 = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


@query("radius_join", f"SELECT a.id, b.id AS other, round({_D3}, 9) AS distance FROM {P3} a JOIN {P3} b ON {_D3} <= 0.06")
def radius_join(spark, sf_dir):
    e = points(spark, sf_dir, "embeddings")
    return N.range_join(e, e, 0.06).select("id", "other", F.round("distance", 9).alias("distance"))


@query("knn_join", f"SELECT id, rank::INTEGER AS rank, other, round(d, 9) AS distance FROM (SELECT a.id, b.id AS other, {_D3} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D3}, b.id) AS rank FROM {P3} a, {P3} b) WHERE rank <= 5")
def knn_join(spark, sf_dir):
    e = points(spark, sf_dir, "embeddings")
    return N.knn_join(e, e, 5).select("id", "rank", "other", F.round("distance", 9).alias("distance"))


@query("nearest", f"SELECT id, other, round(d, 9) AS distance FROM (SELECT a.id, b.id AS other, {_D3} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D3}, b.id) AS rank FROM {P3} a, {P3} b WHERE b.v = 3) WHERE rank = 1")
def nearest(spark, sf_dir):
    e = points(spark, sf_dir, "embeddings")
    return N.nearest(e, e.where("v = 3")).select("id", "other", F.round("distance", 9).alias("distance"))


@query("distance_filter", f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM {P3}),
near AS (SELECT a.r, list(b.r) AS early FROM p a JOIN p b ON b.r < a.r AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.08 GROUP BY 1),
walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
SELECT w.r + 1, CASE WHEN n.r IS NULL OR len(list_intersect(n.early, w.kept)) = 0 THEN list_append(w.kept, w.r + 1) ELSE w.kept END FROM walk w LEFT JOIN near n ON n.r = w.r + 1 WHERE w.r < (SELECT count(*) FROM p))
SELECT id FROM p WHERE r IN (SELECT unnest(kept) FROM walk WHERE r = (SELECT count(*) FROM p))""")
def distance_filter(spark, sf_dir):
    return N.distance_filter(points(spark, sf_dir, "embeddings"), 0.08).select("id")


@query("distance_filter_line", "SELECT c_custkey::BIGINT AS id FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r % 2 = 1")
def distance_filter_line(spark, sf_dir):
    """Consecutive keys on a line, at a spacing of exactly the distance: each verdict hangs on the one before."""
    line = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_custkey").cast("double").alias("x"))
    return N.distance_filter(line, 1.0).select("id")


@query("unique_rows", "SELECT min(c_custkey) AS id FROM customer GROUP BY c_nationkey")
def unique_rows(spark, sf_dir):
    c = points(spark, sf_dir, "customer").select("id", F.col("y").alias("x"))
    return N.unique(c).select("id")


# ---- interpolation ------------------------------------------------------------------------------
_BRACKETS = f"(SELECT x AS a, v AS va, lead(x) OVER (ORDER BY x) AS b, lead(v) OVER (ORDER BY x) AS vb FROM {P1})"


def _between(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir, "supplier")
    most = p.agg(F.max("x")).first()[0]
    return p.where(F.col("x") < most).select("id", (F.col("x") + 0.5).alias("x"))


def _fit1(spark, sf_dir, model: Model) -> Interpolant:
    return Interpolant(model).fit(*training(points(spark, sf_dir, "supplier")), spark=spark)


@query("fit_eval_exp_kriging", f"SELECT a::BIGINT AS id, round((sinh(0.6 * (b - a - 0.5)) * va + sinh(0.3) * vb) / sinh(0.6 * (b - a)), 4) + 0.0 AS value FROM {_BRACKETS} WHERE b IS NOT NULL")
def fit_eval_exp_kriging(spark, sf_dir):
    return _fit1(spark, sf_dir, Model(Rbf("exp", (1.0, 5.0)), -1)).evaluate(_between(spark, sf_dir)).select("id", rounded("value", 4).alias("value"))


@query("fit_eval_bh3_linear", f"SELECT a::BIGINT AS id, round(va + 0.5 / (b - a) * (vb - va), 4) + 0.0 AS value FROM {_BRACKETS} WHERE b IS NOT NULL")
def fit_eval_bh3_linear(spark, sf_dir):
    return _fit1(spark, sf_dir, Model(Rbf("bh3"), 0)).evaluate(_between(spark, sf_dir)).select("id", rounded("value", 4).alias("value"))


@query("fit_eval_gradient", f"SELECT a::BIGINT AS id, round((vb - va) / (b - a), 3) + 0.0 AS dx FROM {_BRACKETS} WHERE b IS NOT NULL")
def fit_eval_gradient(spark, sf_dir):
    """Between centres the gradient of the piecewise linear interpolant is its slope."""
    return _fit1(spark, sf_dir, Model(Rbf("bh3"), 0)).evaluate(_between(spark, sf_dir), gradients=True).select("id", rounded("dx", 3).alias("dx"))


@query("fit_exact_at_data", f"SELECT id, round(v, 3) + 0.0 AS value FROM {P3}")
def fit_exact_at_data(spark, sf_dir):
    e = points(spark, sf_dir, "embeddings")
    return Interpolant(Model(Rbf("bh3"), 1)).fit(*training(e), spark=spark).evaluate(e).select("id", rounded("value", 3).alias("value"))


@query("poly_reproduction_3d", f"SELECT id, round(1 + 2 * x - y + 3 * z, 6) + 0.0 AS value FROM {P3}")
def poly_reproduction_3d(spark, sf_dir):
    e = points(spark, sf_dir, "embeddings").withColumn("v", 1 + 2 * F.col("x") - F.col("y") + 3 * F.col("z"))
    x, v = training(e)
    return Interpolant(Model(Rbf("th3"), 1)).fit(x, v).evaluate(e).select("id", rounded("value", 6).alias("value"))


@query("fit_nugget_identity", f"SELECT id, round(v, 4) + 0.0 AS value FROM {P1}")
def fit_nugget_identity(spark, sf_dir):
    """Fit plus nugget times weight is the data."""
    f = _fit1(spark, sf_dir, Model(Rbf("exp", (1.0, 5.0)), 0, 0.1))
    p = points(spark, sf_dir, "supplier")
    w = spark.createDataFrame([(float(x), float(w)) for x, w in zip(f.centers[:, 0], f.weights)], "x double, w double")
    return f.evaluate(p).join(w, "x").select("id", rounded(F.col("value") + 0.1 * F.col("w"), 4).alias("value"))


@query("evaluate_weights", f"SELECT n.n_nationkey AS id, round(sum(p.v * exp(-3 * abs(n.n_nationkey - p.x) / 5)), 3) + 0.0 AS value FROM nation n, {P1} p GROUP BY 1")
def evaluate_weights(spark, sf_dir):
    """A given weight table against the cross sum in SQL."""
    x, v = training(points(spark, sf_dir, "supplier"))
    f = Interpolant(Model(Rbf("exp", (1.0, 5.0)), -1), x, np.zeros((0, 1)), v)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("double").alias("x"))
    return f.evaluate(n).select("id", rounded("value", 3).alias("value"))


@query("cross_validate_exp", f"""SELECT id, round(CASE WHEN lv IS NULL THEN hv * exp(-0.6 * (hx - x)) WHEN hv IS NULL THEN lv * exp(-0.6 * (x - lx)) ELSE (sinh(0.6 * (hx - x)) * lv + sinh(0.6 * (x - lx)) * hv) / sinh(0.6 * (hx - lx)) END, 4) + 0.0 AS prediction
FROM (SELECT *, lag(v) OVER w AS lv, lag(x) OVER w AS lx, lead(v) OVER w AS hv, lead(x) OVER w AS hx FROM {P1} WINDOW w AS (ORDER BY x))""")
def cross_validate_exp(spark, sf_dir):
    p = points(spark, sf_dir, "supplier").withColumn("fold", F.col("id") % 10)
    out = cross_validate(Model(Rbf("exp", (1.0, 5.0)), -1), p)
    return out.select("id", rounded("prediction", 4).alias("prediction"))


@query("fit_inequality_flags", f"SELECT id, true AS ok FROM {P1}")
def fit_inequality_flags(spark, sf_dir):
    """Property: bounds (value plus or minus 100) hold for every row."""
    p = points(spark, sf_dir, "supplier")
    x, v = training(p)
    f = Interpolant(Model(Rbf("exp", (1.0, 5.0)), -1)).fit_inequality(x, np.where(v > 5000, v, np.nan), v - 100, v + 100, 1e-6)
    return f.evaluate(p).select("id", ((F.col("value") >= F.col("v") - 100.001) & (F.col("value") <= F.col("v") + 100.001)).alias("ok"))


@query("fit_incremental_flags", f"SELECT id, true AS ok FROM {P1}")
def fit_incremental_flags(spark, sf_dir):
    """Property: every residual stays within the tolerance."""
    p = points(spark, sf_dir, "supplier")
    f = Interpolant(Model(Rbf("bh3"), 0)).fit_incrementally(*training(p), 500.0)
    return f.evaluate(p).select("id", (F.abs(F.col("value") - F.col("v")) <= 500.0).alias("ok"))


# ---- point clouds -------------------------------------------------------------------------------
@query("plane_errors", f"SELECT v, count(*)::BIGINT AS n, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 8) AS point_error FROM {P3} GROUP BY v")
def plane_errors(spark, sf_dir):
    return C.plane_errors(points(spark, sf_dir, "embeddings"), ["v"]).select("v", "n", F.round("point_error", 8).alias("point_error"))


def _patch(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir, "embeddings").withColumn("z", 0.5 * F.col("x") - 0.25 * F.col("y"))


_PLANE = math.sqrt(1 + 0.25 + 0.0625)


@query("normals_planar_patch", f"SELECT id, round(-0.5 / {_PLANE!r}, 6) AS nx, round(0.25 / {_PLANE!r}, 6) AS ny, round(1 / {_PLANE!r}, 6) AS nz FROM {P3}")
def normals_planar_patch(spark, sf_dir):
    n = C.filter_by_plane_factor(C.normals_knn(_patch(spark, sf_dir), [8, 12]))
    return C.orient_toward_direction(n, (0, 0, 1)).select("id", *(rounded(c, 6).alias(c) for c in C.NORMAL))


@query("orient_toward_point", f"SELECT id, CASE WHEN 1 - x + y * 0 > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS nx FROM {P3} WHERE x <> 1")
def orient_toward_point(spark, sf_dir):
    p = points(spark, sf_dir, "embeddings").where("x <> 1").withColumns({"nx": F.lit(1.0), "ny": F.lit(0.0), "nz": F.lit(0.0)})
    return C.orient_toward_point(p, (1.0, 0.0, 0.0)).select("id", "nx")


@query("sdf_fixed_offset", "SELECT round(c_custkey * 10.0 + 0.0, 6)::DOUBLE AS x, round(s * 0.5, 6)::DOUBLE AS z, (s * 0.5)::DOUBLE AS value FROM customer, (SELECT unnest([-1, 0, 1]) AS s)")
def sdf_fixed_offset(spark, sf_dir):
    """Points far apart on a plane: no offset shrinks."""
    p = points(spark, sf_dir, "customer").select("id", (F.col("x") * 10).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return C.sdf(p, 0.5).select(rounded("x", 6).alias("x"), rounded("z", 6).alias("z"), "value")


# ---- isosurfaces --------------------------------------------------------------------------------
_BOX = G.Bbox((-1.2,) * 3, (1.2,) * 3)


def _sphere(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))


_LAT = I.Lattice(_BOX, 0.1)
_EXT = _LAT.extended(2)
_NODES = "(SELECT i, j, k, " + ", ".join(f"i * {_LAT.basis[0, a]!r} + j * {_LAT.basis[1, a]!r} + k * {_LAT.basis[2, a]!r} AS {c}" for a, c in enumerate("xyz")).replace("np.float64(", "").replace(")", "") + " FROM (SELECT unnest(range(-60, 61)) AS i), (SELECT unnest(range(-60, 61)) AS j), (SELECT unnest(range(-60, 61)) AS k))"
_IN = " AND ".join(f"{c} BETWEEN {float(_EXT.low[a])!r} AND {float(_EXT.high[a])!r}" for a, c in enumerate("xyz"))


@query("lattice_nodes", f"SELECT count(*)::BIGINT AS nodes, count(*) FILTER (sqrt(x * x + y * y + z * z) < 1)::BIGINT AS inside FROM {_NODES} WHERE {_IN}")
def lattice_nodes(spark, sf_dir):
    return _sphere(_LAT.nodes(spark)).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("value") < 1).alias("inside"))


_HALF = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)]


@query("edge_crossings", f"WITH n AS (SELECT i, j, k, sqrt(x * x + y * y + z * z) - 1 AS v FROM {_NODES} WHERE {_IN}), d AS (SELECT unnest([{', '.join(str(h[0]) for h in _HALF)}]) AS di, unnest([{', '.join(str(h[1]) for h in _HALF)}]) AS dj, unnest([{', '.join(str(h[2]) for h in _HALF)}]) AS dk) SELECT count(*)::BIGINT AS vertices FROM n a, d, n b WHERE b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk AND (a.v < 0) <> (b.v < 0)")
def edge_crossings(spark, sf_dir):
    t = I.raw_triangles(_sphere(_LAT.nodes(spark)), 1.0)
    return t.select(F.explode(F.array(*(F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in range(3)))).alias("e")).distinct().agg(F.count(F.lit(1)).alias("vertices"))


@query("isosurface_sphere_counts", "SELECT 1610::BIGINT AS vertices, 3216::BIGINT AS faces, 0::BIGINT AS singular")
def isosurface_sphere_counts(spark, sf_dir):
    m = I.generate(spark, _BOX, 0.1, _sphere, 1.0, local=lambda p: np.linalg.norm(p, axis=1))
    return spark.createDataFrame([(len(m.vertices), len(m.faces), len(I.singular_vertices(m.faces, len(m.vertices))))], "vertices long, faces long, singular long")


@query("isosurface_plane_clipped", "SELECT 1122::BIGINT AS vertices, 2021::BIGINT AS faces")
def isosurface_plane_clipped(spark, sf_dir):
    m = I.generate(spark, _BOX, 0.1, lambda d: d.withColumn("value", (F.col("x") + F.col("y") + F.col("z")) / math.sqrt(3)))
    return spark.createDataFrame([(len(m.vertices), len(m.faces))], "vertices long, faces long")


@query("surface_reconstruction")
def surface_reconstruction(spark, sf_dir):
    """Normals, orientation, signed distances, fit and isosurface of points on a sphere."""
    p = C.random_points(spark, 400, sphere=((0.0, 0.0, 0.0), 1.0), seed=3)
    n = C.orient_closed_surface(C.normals_knn(p, [10]), 10)
    s = C.sdf(n.select("id", *C.XYZ, *C.NORMAL), 0.05).withColumnRenamed("value", "v").withColumn("id", F.monotonically_increasing_id())
    f = Interpolant(Model(Rbf("bh3"), 0)).fit(*training(s))
    m = I.generate(spark, _BOX, 0.2, I.field_of(f), 0.0, local=lambda q: f.values(q))
    return spark.createDataFrame([tuple(map(float, v)) for v in m.vertices], "x double, y double, z double")


# ---- tables in and out, small functions ------------------------------------------------------------
@query("table_round_trip", "SELECT round(id, 0)::BIGINT AS id, x, v FROM " + P1)
def table_round_trip(spark, sf_dir):
    """Supplier points as delimited text and back."""
    path = shared_dir(spark)
    write_table(points(spark, sf_dir, "supplier").withColumn("k", F.col("id")), path, order="k")
    return read_table(spark, path, ["key", "x", "v"]).select(F.col("key").cast("long").alias("id"), "x", "v")


@query("interpolant_save_load", f"SELECT a::BIGINT AS id, round(va + 0.5 / (b - a) * (vb - va), 4) + 0.0 AS value FROM {_BRACKETS} WHERE b IS NOT NULL")
def interpolant_save_load(spark, sf_dir):
    path = shared_dir(spark)
    _fit1(spark, sf_dir, Model(Rbf("bh3"), 0)).save(spark, path)
    return Interpolant.load(spark, path).evaluate(_between(spark, sf_dir)).select("id", rounded("value", 4).alias("value"))


@query("export_obj_faces", f"SELECT 'f ' || r || ' ' || (r + 1) || ' ' || (r + 2) AS line FROM (SELECT row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM {P1}) WHERE r <= n - 2")
def export_obj_faces(spark, sf_dir):
    """A strip of triangles over the suppliers, as Wavefront faces."""
    x, v = training(points(spark, sf_dir, "supplier"))
    n, path = len(x), shared_dir(spark)
    I.Mesh(np.stack((x[:, 0], v, np.zeros(n)), 1), np.arange(n - 2)[:, None] + np.arange(3), False).export_obj(spark, path)
    return spark.read.text(path).where("startswith(value, 'f')").select(F.col("value").alias("line"))


@query("stack_rows", f"SELECT id, x, v FROM {P1} UNION ALL SELECT id, x, v FROM {PC}")
def stack_rows(spark, sf_dir):
    return G.stack_rows(points(spark, sf_dir, "supplier"), points(spark, sf_dir, "customer").select("id", "x", "v"))


@query("stack_columns", f"SELECT a.id, a.x, a.v, b.y FROM {P1} a JOIN {PC} b USING (id)")
def stack_columns(spark, sf_dir):
    return G.stack_columns(points(spark, sf_dir, "supplier"), points(spark, sf_dir, "customer").select("id", "y"))


@query("zip_sort", "SELECT vec_id AS id, (list_position(embedding, list_min(embedding)) - 1)::INTEGER AS first, list_min(embedding)::DOUBLE AS least, list_max(embedding)::DOUBLE AS most FROM embeddings")
def zip_sort(spark, sf_dir):
    """Components sorted with their places."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k, v = G.zip_sort("embedding", F.sequence(F.lit(0), F.size("embedding") - 1))
    return e.select(F.col("vec_id").alias("id"), v[0].alias("first"), F.element_at(k, 1).cast("double").alias("least"), F.element_at(k, -1).cast("double").alias("most"))


@query("bit_operations", "SELECT c_custkey::BIGINT AS id, bit_count(c_custkey::BIGINT)::INTEGER AS bits, CASE WHEN c_custkey <> 0 THEN round(log2(c_custkey::BIGINT & -c_custkey::BIGINT))::INTEGER END AS lowest, (c_custkey & (c_custkey - 1))::BIGINT AS rest FROM customer")
def bit_operations(spark, sf_dir):
    c = points(spark, sf_dir, "customer").select(F.col("id").cast("long").alias("id"))
    return c.select("id", F.bit_count("id").cast("int").alias("bits"), Z.bit_peek(F.col("id")).cast("int").alias("lowest"), Z.bit_pop(F.col("id")).alias("rest"))


@query("number_parse", "SELECT n_nationkey::INTEGER AS id, n_nationkey * 10.0::DOUBLE AS value, true AS none FROM nation")
def number_parse(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").cast("int").alias("id"), Z.to_double(F.concat(F.col("n_nationkey").cast("string"), F.lit("e1"))).alias("value"), F.isnan(Z.to_double(F.col("n_name"))).alias("none"))


@query("error_norms", f"SELECT max(abs(v - 100 * x)) AS largest, round(sqrt(sum((v - 100 * x) ** 2)), 3) AS euclidean FROM {P1}")
def error_norms(spark, sf_dir):
    a, b = Z.error_columns(F.col("v"), 100 * F.col("x"))
    return points(spark, sf_dir, "supplier").agg(a.alias("largest"), F.round(b, 3).alias("euclidean"))


@query("lagrange_basis", f"SELECT id, (x - 2) * (x - 3) / 2 AS l0, -(x - 1) * (x - 3) + 0.0 AS l1, (x - 1) * (x - 2) / 2 AS l2 FROM {P1}")
def lagrange_basis(spark, sf_dir):
    basis = P.Lagrange(np.array([[1.0], [2.0], [3.0]]), 2).columns([F.col("x")])
    return points(spark, sf_dir, "supplier").select("id", *(rounded(c, 6).alias(f"l{k}") for k, c in enumerate(basis)))


@query("predicates", f"SELECT id, sign(1000 * y - 20 * x)::INTEGER AS side, (x * x + y * y < 2500)::INTEGER AS inside FROM {PC} WHERE x * x + y * y <> 2500")
def predicates(spark, sf_dir):
    p = (F.col("x"), F.col("y"))
    c = points(spark, sf_dir, "customer").where("x * x + y * y <> 2500")
    return c.select("id", F.signum(T.orient2d((0.0, 0.0), (1000.0, 20.0), p)).cast("int").alias("side"), (T.incircle((50.0, 0.0), (0.0, 50.0), (-50.0, 0.0), p) > 0).cast("int").alias("inside"))


_UW = f"(SELECT id, u, w, sqrt(u * u + w * w) AS r FROM (SELECT id, x - 25.25 AS u, (y - 1000) / 100 AS w FROM {PP}))"
_SLOPES = {
    "bh3": "-1.1 / sqrt(r * r + 0.25)", "th3": "3.3 * sqrt(r * r + 0.25)", "bh2": "1.1 * (ln(r * r + 0.25) + 1)", "exp": "-3.3 / (20 * r) * exp(-3 * r / 20)",
    "sph": "CASE WHEN r < 20 THEN 1.1 * (-1.5 + 1.5 * r * r / 400) / (20 * r) ELSE 0 END", "gc9": "-9.9 / 400 * (1 + r * r / 400) ** -5.5",
}


def _gradient(name: str):
    @query(f"rbf_gradients_{name}", f"SELECT id, round({_SLOPES[name]} * u, 6) + 0.0 AS gx, round({_SLOPES[name]} * w, 6) + 0.0 AS gy FROM {_UW}")
    def run(spark, sf_dir):
        gx, gy = Rbf(name, (1.1, 0.5 if KERNELS[name].order else 20.0)).gradient_columns(F.col("x") - 25.25, (F.col("y") - 1000) / 100)
        return points(spark, sf_dir, "part").select("id", rounded(gx, 6).alias("gx"), rounded(gy, 6).alias("gy"))


for _name in _SLOPES:
    _gradient(_name)

_E = "1.1 * exp(-3 * (u * u + w * w) / 400)"


@query("rbf_hessians", f"SELECT id, round({_E} * (36 * u * u / 160000 - 6 / 400.0), 8) + 0.0 AS hxx, round({_E} * 36 * u * w / 160000, 8) + 0.0 AS hxy, round({_E} * (36 * w * w / 160000 - 6 / 400.0), 8) + 0.0 AS hyy FROM {_UW}")
def rbf_hessians(spark, sf_dir):
    (xx, xy), (_, yy) = Rbf("gau", (1.1, 20.0)).hessian_columns(F.col("x") - 25.25, (F.col("y") - 1000) / 100)
    return points(spark, sf_dir, "part").select("id", *(rounded(c, 8).alias(n) for n, c in (("hxx", xx), ("hxy", xy), ("hyy", yy))))


# ---- sums over many centres ----------------------------------------------------------------------
@query("compact_sum_sph", f"SELECT c.id, round(coalesce(sum(CASE WHEN abs(c.x - p.x) < 19.7 THEN p.v * (1 - 1.5 * abs(c.x - p.x) / 19.7 + 0.5 * (abs(c.x - p.x) / 19.7) ** 3) END), 0) + 1 + 2 * c.x, 3) + 0.0 AS value FROM {PC} c, {P1} p GROUP BY c.id, c.x")
def compact_sum_sph(spark, sf_dir):
    """Customers near and far from the suppliers, whose balances are the weights; a linear tail. A range of 20 would put
    sums on the ties of rounding."""
    at = points(spark, sf_dir, "customer").select("id", "x")
    return compact_sum(Model(Rbf("sph", (1.0, 19.7)), 1), points(spark, sf_dir, "supplier"), at, "v", [1.0, 2.0]).select("id", rounded("value", 3).alias("value"))


@query("cluster_sum", f"SELECT n.n_nationkey AS id, round(sum(c.v / 1e6 * sqrt((n.n_nationkey * 40 + 0.5 - c.x) ** 2 + (n.n_regionkey * 5 + 0.5 - c.y) ** 2)) / -1, 3) + 0.0 AS value FROM nation n, {PC} c GROUP BY 1")
def cluster_sum(spark, sf_dir):
    """Values within 1e-6, from boxes of centres where there are many. Nothing is fitted, so the limit is the driver's memory (24 bytes a row)."""
    x, v = training(points(spark, sf_dir, "customer"), on=["x", "y"], most=5_000_000)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    at = n.select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 40 + 0.5).alias("x"), (F.col("n_regionkey") * 5 + 0.5).alias("y"))
    f = Interpolant(Model(Rbf("bh3"), 0), x, np.zeros((0, 2)), np.append(v / 1e6, 0.0))
    return f.evaluate(at, accuracy=1e-6).select("id", rounded("value", 3).alias("value"))


@query("saddle_product", f"SELECT a.id, round(sum(b.v * exp(-0.6 * abs(a.x - b.x))) + 0.1 * any_value(a.v), 3) + 0.0 AS value FROM {P1} a, {P1} b GROUP BY a.id")
def saddle_product(spark, sf_dir):
    """The operator of a fit, its rows worked out by executors, applied to the balances."""
    p = points(spark, sf_dir, "supplier")
    x, v = training(p)
    got = saddle_map(Model(Rbf("exp", (1.0, 5.0)), -1, 0.1), x, np.zeros((0, 1)), spark)(v)
    ids = [r[0] for r in p.orderBy("id").select("id").collect()]
    return spark.createDataFrame([(int(i), float(t)) for i, t in zip(ids, got, strict=True)], "id long, t double").select("id", rounded("t", 3).alias("value"))


# ---- more of point clouds ------------------------------------------------------------------------
_LEAST = "greatest((var_pop(x) + var_pop(y)) / 2 - sqrt(((var_pop(x) - var_pop(y)) / 2) ** 2 + covar_pop(x, y) ** 2), 0)"


@query("plane_errors_flat", f"SELECT v, round(sqrt({_LEAST}), 7) AS line_error, (round(sqrt({_LEAST}), 7) * 0 + 1.0)::DOUBLE AS nz FROM {P3} GROUP BY v")
def plane_errors_flat(spark, sf_dir):
    """Points with their third coordinate set to 0: a line's error is the smaller spread in the plane, the normal is the axis."""
    e = C.plane_errors(points(spark, sf_dir, "embeddings").withColumn("z", F.lit(0.0)), ["v"])
    return e.select("v", F.round("line_error", 7).alias("line_error"), F.round(F.abs("nz"), 6).alias("nz"))


@query("normals_radius_patch", f"SELECT a.id, CASE WHEN count(*) < 3 THEN 0.0 ELSE round(1 / {_PLANE!r}, 6) END::DOUBLE AS nz FROM {P3} a JOIN {P3} b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (0.5 * (a.x - b.x) - 0.25 * (a.y - b.y)) ** 2) <= 0.1 GROUP BY a.id")
def normals_radius_patch(spark, sf_dir):
    n = C.orient_toward_direction(C.normals_radius(_patch(spark, sf_dir), [0.05, 0.1]), (0, 0, 1))
    return n.select("id", rounded("nz", 6).alias("nz"))


@query("thin_normals", "SELECT count(*)::BIGINT AS n, round(0.25 * count(*))::BIGINT AS kept FROM embeddings")
def thin_normals(spark, sf_dir):
    p = points(spark, sf_dir, "embeddings").withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    return C.thin_normals(p, 0.25).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nz") > 0).alias("kept"))
