"""Rigid transforms and poses."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pcframe.model import NORMALS, XYZ, PointCloud, as_point_cloud

#: 4x4 matrices are array<array<double>>, rows first.
MATRIX = "array<array<double>>"
IDENTITY = [[float(i == j) for j in range(4)] for i in range(4)]


def _apply(entry, columns: Sequence[str], shift: bool) -> list[Column]:
    out = []
    for i in range(3):
        c = entry(i, 0) * F.col(columns[0]) + entry(i, 1) * F.col(columns[1]) + entry(i, 2) * F.col(columns[2])
        out.append(c + entry(i, 3) if shift else c)
    return out


def transform(cloud, transformations) -> PointCloud:
    """R p + t for every point; normals are turned only, other columns kept, the bottom row of
    the matrix ignored. transformations: one 4x4 matrix (nested lists), or a DataFrame batch_id,
    m (4x4) with a row for every entry (points of an entry without one raise when the plan runs).
    The result is of the wider type of the two; a matrix's
    is double."""
    cloud = as_point_cloud(cloud)
    normals = [NORMALS] if cloud.has_normals else []
    if isinstance(transformations, DataFrame):
        if "batch_id" not in transformations.columns or dict(transformations.dtypes).get("m") != MATRIX:
            raise TypeError(f"transformations need batch_id and m, {MATRIX}")
        missing = F.raise_error(F.concat(F.lit("transformations: none for entry "), F.col("batch_id").cast("string"))).cast(MATRIX)
        rows = cloud.points.join(transformations.select("batch_id", F.col("m").alias("__m")), "batch_id", "left").withColumn("__m", F.coalesce("__m", missing))
        entry = lambda i, j: F.col("__m")[i][j]
    else:
        m = [[float(v) for v in r] for r in transformations]
        if len(m) != 4 or any(len(r) != 4 for r in m):
            raise ValueError("a transformation must have shape (4, 4)")
        rows, entry = cloud.points, lambda i, j: F.lit(m[i][j])
    new = dict(zip(XYZ, _apply(entry, XYZ, True)))
    for n in normals:
        new |= dict(zip(n, _apply(entry, n, False)))
    return replace(cloud, points=rows.withColumns(new).drop("__m").select(*cloud.points.columns))


def transform_points(points: DataFrame, matrix) -> DataFrame:
    """One 4x4 matrix over rows with x, y, z; the result has the points' own type."""
    kind = dict(points.dtypes)["x"]
    m = [[float(v) for v in r] for r in matrix]
    new = _apply(lambda i, j: F.lit(m[i][j]), XYZ, True)
    return points.withColumns({c: v.cast(kind) for c, v in zip(XYZ, new)})


def pose_matrix(rx: Column, ry: Column, rz: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """4x4 of a pose, R = Rz Ry Rx in double precision."""
    rx, ry, rz, tx, ty, tz = (c.cast("double") for c in (rx, ry, rz, tx, ty, tz))
    a, b, c = F.cos(rx), F.cos(ry), F.cos(rz)
    u, v, w = F.sin(rx), F.sin(ry), F.sin(rz)
    rows = [[c * b, c * v * u - w * a, c * v * a + w * u, tx], [w * b, w * v * u + c * a, w * v * a - c * u, ty], [-v, b * u, b * a, tz], [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    return F.array(*[F.array(*r) for r in rows])


def pose_to_matrix(pose: Sequence[float]) -> list[list[float]]:
    """The same on the driver, for one pose [rx, ry, rz, tx, ty, tz]."""
    if len(pose) != 6:
        raise ValueError("a pose has six numbers")
    rx, ry, rz, *t = map(float, pose)
    a, b, c, u, v, w = math.cos(rx), math.cos(ry), math.cos(rz), math.sin(rx), math.sin(ry), math.sin(rz)
    return [[c * b, c * v * u - w * a, c * v * a + w * u, t[0]], [w * b, w * v * u + c * a, w * v * a - c * u, t[1]], [-v, b * u, b * a, t[2]], [0.0, 0.0, 0.0, 1.0]]


def pose_matrices(poses: np.ndarray) -> np.ndarray:
    """The same for an array of poses, a row each: (n, 4, 4)."""
    (a, b, c), (u, v, w) = np.cos(poses[:, :3]).T, np.sin(poses[:, :3]).T
    m = np.tile(np.eye(4), (len(poses), 1, 1))
    rows = [[c * b, c * v * u - w * a, c * v * a + w * u], [w * b, w * v * u + c * a, w * v * a - c * u], [-v, b * u, b * a]]
    m[:, :3, :3] = np.moveaxis(np.array(rows), 2, 0)
    m[:, :3, 3] = poses[:, 3:]
    return m


def rigid_inverse(m: Sequence[Sequence[float]]) -> list[list[float]]:
    r = [[m[j][i] for j in range(3)] for i in range(3)]
    return [[*r[i], -sum(r[i][j] * m[j][3] for j in range(3))] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]]


def pose_error(estimated: Column, truth: Column) -> tuple[Column, Column]:
    """Rotation in degrees and translation of inv(truth) @ estimated, both rigid."""
    e, t = (lambda i, j: estimated[i][j]), (lambda i, j: truth[i][j])
    trace = sum((t(k, i) * e(k, i) for i in range(3) for k in range(3)), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    shift = [sum((t(k, i) * (e(k, 3) - t(k, 3)) for k in range(3)), F.lit(0.0)) for i in range(3)]
    return angle, F.sqrt(shift[0] * shift[0] + shift[1] * shift[1] + shift[2] * shift[2])
