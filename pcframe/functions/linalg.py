"""Small dense linear algebra, batched: Arrow functions for many rows, numpy inside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("nx", "ny", "nz", "l0", "l1", "l2")]))
def smallest_eigenvector(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Of symmetric 3x3 matrices: the eigenvector of the smallest eigenvalue, and all three."""
    n = len(xx)
    m = np.empty((n, 3, 3))
    m[:, 0, 0], m[:, 1, 1], m[:, 2, 2] = xx, yy, zz
    m[:, 0, 1] = m[:, 1, 0] = xy
    m[:, 0, 2] = m[:, 2, 0] = xz
    m[:, 1, 2] = m[:, 2, 1] = yz
    values, vectors = np.linalg.eigh(np.nan_to_num(m))
    return pd.DataFrame({"nx": vectors[:, 0, 0], "ny": vectors[:, 1, 0], "nz": vectors[:, 2, 0], "l0": values[:, 0], "l1": values[:, 1], "l2": values[:, 2]})


def kabsch(h: np.ndarray, source_mean: np.ndarray, target_mean: np.ndarray, source_var: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotations, translations, scales and ranks from weighted cross-covariances sum w s t^T.

    The closest rotation of each, improper ones turned at the least singular value. With
    source_var (sum w |s|^2) the scale is fitted, else 1. Rank: singular values above the
    largest by three epsilons.
    """
    u, s, vt = np.linalg.svd(np.nan_to_num(h))
    v = np.swapaxes(vt, 1, 2)
    sign = np.ones_like(s)
    sign[:, 2] = np.where(np.linalg.det(v @ np.swapaxes(u, 1, 2)) < 0, -1.0, 1.0)
    r = (v * sign[:, None, :]) @ np.swapaxes(u, 1, 2)
    scale = np.ones(len(h))
    if source_var is not None:
        scale = (s * sign).sum(1) / np.where(source_var > 0, source_var, np.nan)
    t = target_mean - scale[:, None] * np.einsum("bij,bj->bi", r, source_mean)
    rank = (s > s[:, :1] * 3 * np.finfo(float).eps).sum(1)
    return r, t, scale, rank


def solve_poses(jtj: np.ndarray, jtr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 6-vectors that solve jtj x = -jtr, a row each, and which could be solved."""
    x = np.zeros_like(jtr)
    try:
        x = np.linalg.solve(jtj, -jtr[..., None])[..., 0]
    except np.linalg.LinAlgError:  # at least one is singular: each by itself
        for i in range(len(jtj)):
            try:
                x[i] = np.linalg.solve(jtj[i], -jtr[i])
            except np.linalg.LinAlgError:
                x[i] = np.nan
    good = np.isfinite(x).all(1)
    return np.where(good[:, None], x, 0.0), good


def homogeneous(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, t
    return m
