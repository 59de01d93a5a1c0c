"""Normals and curvature from neighborhood covariances."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.functions.linalg import smallest_eigenvector
from pcframe.model import NORMALS, XYZ, PointCloud, as_point_cloud
from pcframe.operators.neighbors import NeighborIndex

TINY = 2.2250738585072014e-308


def neighborhood_covariance(cloud: PointCloud, radius: float | None, k: int, index: NeighborIndex | None = None) -> DataFrame:
    """batch_id, row_id, n and the six sums (g-m)(g-m)^T of each point's neighborhood (itself
    included), from moments about the point, which far origins can't cancel."""
    index = index or NeighborIndex(cloud, algorithm="grid" if radius is not None else "auto")
    found = index._search(cloud, k, radius)
    d = {c: F.col(f"r{c}") - F.col(f"q{c}") for c in XYZ}
    found = found.select("batch_id", F.col("query_row").alias("row_id"), *[v.alias(c) for c, v in d.items()])
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    s = found.groupBy("batch_id", "row_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in XYZ], *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs])
    return s.select("batch_id", "row_id", "n", *[(F.col(a + b) - F.col(a) * F.col(b) / F.col("n")).alias("c" + a + b) for a, b in pairs])


def estimate_normals(cloud, radius: float | None = None, *, k: int = 30, index: NeighborIndex | None = None) -> DataFrame:
    """batch_id, row_id, nx, ny, nz, valid, curvature for every point.

    valid: at least three neighbors (the point is one); else normal 0 and curvature 0. The sign
    follows attached normals, where there are any. Curvature: the least eigenvalue's share.
    """
    cloud = as_point_cloud(cloud)
    if not 3 <= k <= 64:
        raise ValueError("k must be in [3, 64]")
    if radius is not None and not radius > 0:
        raise ValueError("radius must be positive")
    if index is not None and index.reference.points is not cloud.points:
        raise ValueError("index must be over the same cloud")
    cov = neighborhood_covariance(cloud, radius, k, index).where("n >= 3")
    e = cov.withColumn("e", smallest_eigenvector(*[F.col(f"c{c}") for c in ("xx", "xy", "xz", "yy", "yz", "zz")])).select("batch_id", "row_id", "e")
    own = [F.col(c).alias(f"own_{c}") for c in NORMALS] if cloud.has_normals else []
    rows = cloud.points.select("batch_id", "row_id", *own).join(e, ["batch_id", "row_id"], "left")
    sign = F.lit(1.0)
    if own:
        sign = F.when(sum((F.col(f"e.{c}") * F.col(f"own_{c}") for c in NORMALS), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    total = F.greatest(F.col("e.l0") + F.col("e.l1") + F.col("e.l2"), F.lit(TINY))
    return rows.select(
        "batch_id", "row_id", *[F.coalesce(F.col(f"e.{c}") * sign, F.lit(0.0)).alias(c) for c in NORMALS],
        F.col("e").isNotNull().alias("valid"), F.coalesce(F.greatest(F.col("e.l0"), F.lit(0.0)) / total, F.lit(0.0)).alias("curvature"),
    )


def with_normals(cloud: PointCloud, normals: DataFrame) -> PointCloud:
    """The cloud with these normals attached (instead of its own)."""
    bare = cloud.points.drop(*NORMALS)
    return replace(cloud, points=bare.join(normals.select("batch_id", "row_id", *NORMALS), ["batch_id", "row_id"]))
