"""Voxel grids and per-voxel reductions."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcframe.model import XYZ, PointCloud, as_point_cloud
from pcframe.plans.order import numbered

VOXEL = ("vx", "vy", "vz")
REDUCTIONS = ("mean", "sum", "min", "max", "first")


@dataclass(frozen=True)
class Voxelization:
    """keyed: the points with their voxel's coordinates; source: the cloud; voxels: batch_id, vx,
    vy, vz, count, x, y, z (the centroid)."""

    source: PointCloud
    keyed: DataFrame
    voxels: DataFrame

    def ids(self) -> DataFrame:
        """voxels with voxel_id, dense from 0 in order of (batch_id, vx, vy, vz); made once."""
        return self._ids

    @functools.cached_property
    def _ids(self) -> DataFrame:
        return numbered(self.voxels, ["batch_id", *VOXEL], "voxel_id")

    def point_to_voxel(self) -> DataFrame:
        """batch_id, row_id, voxel_id."""
        return self.keyed.select("batch_id", "row_id", *VOXEL).join(self.ids().select("batch_id", *VOXEL, "voxel_id"), ["batch_id", *VOXEL]).select("batch_id", "row_id", "voxel_id")

    @property
    def cloud(self) -> PointCloud:
        """The centroids; normals and features are dropped, empty entries kept."""
        v = self.ids().select("batch_id", F.col("voxel_id").alias("row_id"), *[F.col(c).cast(self.source.dtype).alias(c) for c in XYZ])
        return PointCloud(v, self.occupancy().select("batch_id", F.col("voxels").alias("length")))

    def occupancy(self) -> DataFrame:
        """batch_id, voxels, offset: how many voxels each entry has, empty ones 0."""
        n = self.voxels.groupBy("batch_id").agg(F.count("*").alias("v"))
        every = self.source.clouds.join(n, "batch_id", "left").select("batch_id", F.coalesce("v", F.lit(0)).cast("long").alias("voxels"))
        w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
        return every.withColumn("offset", F.coalesce(F.sum("voxels").over(w), F.lit(0)).cast("long"))

    def reduce(self, *columns: str, reduction: str = "mean") -> DataFrame:
        """batch_id, vx, vy, vz and each column reduced: mean, sum, min, max, or first (the value
        of the voxel's lowest row)."""
        if reduction not in REDUCTIONS:
            raise ValueError(f"reduction must be one of {REDUCTIONS}")
        of = {
            "mean": lambda c: F.avg(c), "sum": lambda c: F.sum(c), "first": lambda c: F.min_by(c, "row_id"), "max": lambda c: F.max(c),
            # a NaN makes the minimum NaN, as it makes the others
            "min": lambda c: F.when(F.bool_or(F.isnan(F.col(c).cast("double"))), F.lit(float("nan"))).otherwise(F.min(c)),
        }[reduction]
        return self.keyed.groupBy("batch_id", *VOXEL).agg(*[of(c).alias(c) for c in columns])


def cell(c: Column, size: Column, dtype: str) -> Column:
    """floor(c / size), signed; float32 coordinates divide in float32."""
    return F.floor((c / size.cast("float")).cast("float") if dtype == "float" else c / size).cast("long")


def voxelize(cloud, voxel_size: float) -> Voxelization:
    """Group points by floor(p / voxel_size), signed, in each batch entry. float32 clouds divide
    in float32. Points must be finite (PointCloud.validate() checks)."""
    if not (voxel_size > 0 and math.isfinite(voxel_size)):
        raise ValueError("voxel_size must be positive and finite")
    cloud = as_point_cloud(cloud)
    size = F.lit(float(voxel_size))
    keyed = cloud.points.withColumns({v: cell(F.col(c), size, cloud.dtype) for v, c in zip(VOXEL, XYZ)})
    voxels = keyed.groupBy("batch_id", *VOXEL).agg(F.count("*").alias("count"), *[(F.sum(F.col(c).cast("double")) / F.count("*")).alias(c) for c in XYZ])
    return Voxelization(cloud, keyed, voxels)
