"""Closed-form gradients, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.model import XYZ, PointCloud, as_point_cloud, check_pair
from pcframe.operators.neighbors import NeighborIndex
from pcframe.operators.voxel import VOXEL, Voxelization


def knn_gradient(reference, queries, k: int, radius: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Gradients of the sum of all neighbors' d2: (by query, by reference), each batch_id,
    row_id, gx, gy, gz; rows without a neighbor have 0."""
    reference, queries = as_point_cloud(reference), as_point_cloud(queries)
    found = NeighborIndex(reference)._search(queries, k, radius)
    g = {c: 2 * (F.col(f"q{c}") - F.col(f"r{c}")) for c in XYZ}

    def gathered(key: str, sign: float, cloud: PointCloud) -> DataFrame:
        s = found.groupBy("batch_id", F.col(key).alias("row_id")).agg(*[F.sum(sign * v).alias(f"g{c}") for c, v in g.items()])
        return cloud.points.select("batch_id", "row_id").join(s, ["batch_id", "row_id"], "left").select("batch_id", "row_id", *[F.coalesce(f"g{c}", F.lit(0.0)).alias(f"g{c}") for c in XYZ])

    return gathered("query_row", 1.0, queries), gathered("ref_row", -1.0, reference)


def chamfer_gradient(source, target) -> DataFrame:
    """Gradient of each entry's squared bidirectional Chamfer distance by its source points."""
    source, target = as_point_cloud(source), as_point_cloud(target)
    check_pair(source, target)
    own, _ = knn_gradient(target, source, 1)
    _, back = knn_gradient(source, target, 1)
    n = source.clouds.select("batch_id", F.col("length").alias("ns")).join(target.clouds.select("batch_id", F.col("length").alias("nt")), "batch_id")
    both = own.join(back.select("batch_id", "row_id", *[F.col(f"g{c}").alias(f"b{c}") for c in XYZ]), ["batch_id", "row_id"]).join(n, "batch_id")
    return both.select("batch_id", "row_id", *[(F.col(f"g{c}") / (2 * F.col("ns")) + F.col(f"b{c}") / (2 * F.col("nt"))).alias(f"g{c}") for c in XYZ])


def voxel_gradient(grid: Voxelization, reduction: str = "mean") -> DataFrame:
    """Gradient of the sum of each voxel's reduced value by its points' values: 1/count or 1."""
    if reduction not in ("mean", "sum"):
        raise ValueError("reduction must be 'mean' or 'sum'")
    rows = grid.keyed.join(grid.voxels.select("batch_id", *VOXEL, "count"), ["batch_id", *VOXEL])
    return rows.select("batch_id", "row_id", (1.0 / F.col("count") if reduction == "mean" else F.lit(1.0)).alias("g"))


def transform_gradient(gradient: DataFrame, matrix) -> DataFrame:
    """Gradient by the points from that by the moved points (gx, gy, gz): R^T g."""
    new = {f"g{c}": sum((F.lit(float(matrix[i][j])) * F.col(f"g{XYZ[i]}") for i in range(3)), F.lit(0.0)) for j, c in enumerate(XYZ)}
    return gradient.withColumns(new)
