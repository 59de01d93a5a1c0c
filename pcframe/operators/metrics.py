"""Reconstruction metrics of cloud pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pcframe.model import PointCloud, as_point_cloud, check_pair
from pcframe.operators.neighbors import NeighborIndex
from pcframe.operators.segments import batch_reduce
from pcframe.plans import search


def directed_nearest(source: PointCloud, target: PointCloud) -> DataFrame:
    """batch_id, row_id, d2 to the nearest target point of the same entry (NaN points: inf)."""
    near = NeighborIndex(target).knn(source, 1).select("batch_id", F.col("query_row").alias("row_id"), "d2")
    return source.points.select("batch_id", "row_id").join(near, ["batch_id", "row_id"], "left").select("batch_id", "row_id", F.coalesce("d2", F.lit(float("inf"))).alias("d2"))


def _both(source, target, means: dict[str, Column]) -> DataFrame:
    """One row an entry: means of values of d2 over source-to-target distances (f_) and back (b_).
    Entries of checked size find both directions in one task."""
    source, target = as_point_cloud(source), as_point_cloud(target)
    if check_pair(source, target) <= search.LOCAL_POINTS:
        found = search.both_nearest(source.points, target.points)
    else:
        one = lambda s, t, forward: directed_nearest(s, t).withColumn("forward", F.lit(forward))
        found = one(source, target, True).unionByName(one(target, source, False))
    sides = {"f": F.col("forward"), "b": ~F.col("forward")}
    return found.groupBy("batch_id").agg(*[F.avg(F.when(on, v)).alias(f"{p}_{n}") for p, on in sides.items() for n, v in means.items()])


def chamfer_distance(source, target, *, squared: bool = True, bidirectional: bool = True, reduction: str = "mean") -> DataFrame:
    """batch_id, chamfer: the mean nearest distance from source to target, averaged with that of
    the other direction; reduction over the entries: none, mean, sum (mean and sum give one row)."""
    d = F.col("d2") if squared else F.sqrt("d2")
    if bidirectional:
        out = _both(source, target, {"m": d}).select("batch_id", ((F.col("f_m") + F.col("b_m")) / 2).alias("chamfer"))
    else:
        source, target = as_point_cloud(source), as_point_cloud(target)
        check_pair(source, target)
        out = directed_nearest(source, target).groupBy("batch_id").agg(F.avg(d).alias("chamfer"))
    return batch_reduce(out, "chamfer", reduction)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)


def _threshold(threshold) -> float:
    if isinstance(threshold, (list, tuple)) or not isinstance(threshold, (int, float)):
        raise ValueError("threshold must be a scalar")
    if not threshold > 0:
        raise ValueError("threshold must be positive")
    return float(threshold)


def fscore(prediction, reference, threshold: float) -> DataFrame:
    """batch_id, precision, recall, f1 at unsquared distances <= threshold."""
    t = _threshold(threshold)
    got = _both(prediction, reference, {"s": (F.sqrt("d2") <= F.lit(t)).cast("double")})
    return got.select("batch_id", F.col("f_s").alias("precision"), F.col("b_s").alias("recall"), _f1(F.col("f_s"), F.col("b_s")).alias("f1"))


def point_cloud_metrics(prediction, reference, threshold: float) -> DataFrame:
    """batch_id, accuracy, completion, chamfer (unsquared), precision, recall, f1."""
    t = _threshold(threshold)
    got = _both(prediction, reference, {"m": F.sqrt("d2"), "s": (F.sqrt("d2") <= F.lit(t)).cast("double")})
    p, r = F.col("f_s"), F.col("b_s")
    return got.select("batch_id", F.col("f_m").alias("accuracy"), F.col("b_m").alias("completion"), ((F.col("f_m") + F.col("b_m")) / 2).alias("chamfer"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))
