"""Alignment of clouds with known correspondences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.functions.linalg import homogeneous, kabsch
from pcframe.model import XYZ, PointCloud, as_point_cloud, check_pair
from pcframe.plans.search import WHOLE_POINTS, keep


def correspondences(source: PointCloud, target: PointCloud, weights: DataFrame | None, whole: bool = True) -> DataFrame:
    """Rows of both clouds at the same place of the same entry: batch_id, w, sx.., tx..; weights:
    row_id (of the source; batch_id too, if they have it), weight, a row a point."""
    s = source.local_rows(whole).select("batch_id", "local_row", "row_id", *[F.col(c).cast("double").alias(f"s{c}") for c in XYZ])
    t = target.local_rows(whole).select("batch_id", "local_row", *[F.col(c).cast("double").alias(f"t{c}") for c in XYZ])
    both = s.join(t, ["batch_id", "local_row"])
    if weights is None:
        return both.withColumn("w", F.lit(1.0))
    on = source.check_aligned(weights, "weights")
    return both.join(weights.select(*on, F.col("weight").cast("double").alias("w")), on)


def cross_covariance(rows: DataFrame) -> DataFrame:
    """Per entry: w, weighted means ms, mt, the 9 sums h (source by target, about the means) and
    var = sum w |s - ms|^2. Two passes: means, then centered sums."""
    coordinates = [f"{a}{c}" for a in "st" for c in XYZ]
    means = rows.groupBy("batch_id").agg(F.sum("w").alias("sw"), F.count(F.when(F.col("w") > 0, 1)).alias("positive"), F.count(F.when((F.col("w") < 0) | F.isnan("w") | (F.col("w") - F.col("w") != 0), 1)).alias("bad"), *[(F.sum(F.col("w") * F.col(c)) / F.nullif(F.sum("w"), F.lit(0.0))).alias(f"m{c}") for c in coordinates])
    c = rows.join(means, "batch_id").withColumns({f"d{v}": F.col(v) - F.col(f"m{v}") for v in coordinates})
    h = [F.sum(F.col("w") * F.col(f"ds{a}") * F.col(f"dt{b}")) for a in XYZ for b in XYZ]
    var = F.sum(F.col("w") * (F.col("dsx") * F.col("dsx") + F.col("dsy") * F.col("dsy") + F.col("dsz") * F.col("dsz")))
    sums = c.groupBy("batch_id").agg(F.array(*h).alias("h"), var.alias("var"))
    return means.join(sums, "batch_id").select("batch_id", "sw", "positive", "bad", F.array(*[f"ms{c}" for c in XYZ]).alias("ms"), F.array(*[f"mt{c}" for c in XYZ]).alias("mt"), "h", "var")


def procrustes(source, target, *, weights: DataFrame | None = None, estimate_scale: bool = False) -> DataFrame:
    """batch_id, rotation (3x3), translation, scale, transform (4x4: scale * R | t): the motion
    that takes source onto target, row by row, in the weighted least-squares sense.

    Errors: entries of unequal lengths; weights without a row for each point; negative or infinite weights; fewer than three rows of
    positive weight; collinear rows. They are found by one aggregate job over the entries.
    """
    source, target = as_point_cloud(source), as_point_cloud(target)
    whole = check_pair(source, target, equal_lengths=True, non_empty=False) <= WHOLE_POINTS
    moments = keep(cross_covariance(correspondences(source, target, weights, whole)))  # a row an entry, read three times
    every = source.clouds.select("batch_id").join(moments, "batch_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stack = lambda c: np.array(b[c].tolist(), float)
            r, t, s, rank = kabsch(stack("h").reshape(-1, 3, 3), stack("ms"), stack("mt"), b["var"].to_numpy(float) if estimate_scale else None)
            yield pd.DataFrame({
                "batch_id": b["batch_id"], "rotation": r.tolist(), "translation": t.tolist(), "scale": s,
                "transform": [homogeneous(s[i] * r[i], t[i]).tolist() for i in range(len(b))], "rank": rank,
            })

    out = moments.mapInPandas(run, "batch_id long, rotation array<array<double>>, translation array<double>, scale double, transform array<array<double>>, rank int")
    seen = every.agg(F.coalesce(F.max("bad"), F.lit(0)).alias("bad"), F.coalesce(F.min(F.coalesce("positive", F.lit(0))), F.lit(0)).alias("least")).first()
    if seen["bad"]:
        raise ValueError("weights must be finite and nonnegative")
    if seen["least"] < 3:
        raise ValueError("every entry needs at least 3 positive weights")
    if not out.where("rank < 2").isEmpty():
        raise ValueError("points must be non-collinear")
    return out.drop("rank")
