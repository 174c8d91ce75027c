"""Structured Streaming forms: an interpolant over a stream, and a variogram that grows batch by batch.

Both are stateless per batch; the variogram's state is the algebraic table of bins (sums by pairs), so merging is exact for pairs
within a batch. Pairs across batches are not formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geostatistics as S
from ..operators.interpolation import Interpolant


def evaluate_stream(points: DataFrame, interpolant: Interpolant) -> DataFrame:
    return interpolant.evaluate(points)


def variogram_sink(path: str, lag: float, lags: int, **options):
    """A foreachBatch function that writes each batch's bins as a new file set; read_variogram() adds them up."""

    def sink(batch: DataFrame, epoch: int) -> None:
        S.variogram(batch, lag, lags, **options).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def read_variogram(spark, path: str) -> DataFrame:
    return S.merge_variograms(spark.read.parquet(f"{path}/epoch=*").drop("epoch"))
