"""Voxel occupancy of a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.model import XYZ
from pcframe.operators.voxel import VOXEL


def voxel_occupancy(points: DataFrame, voxel_size: float, *, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window, batch_id, vx, vy, vz, count, centroid (x, y, z) of a (streaming or static) table of
    points with an event time; later than the delay, points are left out."""
    if not voxel_size > 0:
        raise ValueError("voxel_size must be positive")
    if points.isStreaming:
        points = points.withWatermark(time, delay)
    keyed = points.withColumns({v: F.floor(F.col(c) / F.lit(float(voxel_size))).cast("long") for v, c in zip(VOXEL, XYZ)})
    return keyed.groupBy(F.window(time, window), "batch_id", *VOXEL).agg(F.count("*").alias("count"), *[(F.sum(c) / F.count("*")).alias(c) for c in XYZ])
