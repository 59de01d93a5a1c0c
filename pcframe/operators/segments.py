"""Per-entry reductions that keep empty entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.model import PointCloud


def segment_sum(cloud: PointCloud, *columns: str) -> DataFrame:
    """batch_id and the sum of each column; 0 for an empty entry."""
    a = cloud.points.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in columns])
    return cloud.clouds.select("batch_id").join(a, "batch_id", "left").select("batch_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def segment_mean(cloud: PointCloud, *columns: str) -> DataFrame:
    """batch_id and the mean of each column; NaN for an empty entry."""
    a = cloud.points.groupBy("batch_id").agg(*[F.avg(c).alias(c) for c in columns])
    return cloud.clouds.select("batch_id").join(a, "batch_id", "left").select("batch_id", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in columns])


def batch_reduce(df: DataFrame, column: str, reduction: str) -> DataFrame:
    """none: as it is; mean, sum: over the entries, as one row."""
    if reduction not in ("none", "mean", "sum"):
        raise ValueError("reduction must be 'none', 'mean', or 'sum'")
    if reduction == "none":
        return df
    return df.agg((F.avg(column) if reduction == "mean" else F.sum(column)).alias(column))
