import numpy as np
import pytest
from pyspark.sql import functions as F

from pcframe.model import PointCloud, as_point_cloud, check_pair
from pcframe.operators.segments import batch_reduce, segment_mean, segment_sum
from pcframe.operators.transforms import pose_to_matrix, rigid_inverse, transform


def cloud(spark, rows, lengths, extra=""):
    """rows: (batch, row, x, y, z, ...)."""
    p = spark.createDataFrame(rows, "batch_id long, row_id long, x double, y double, z double" + extra)
    return PointCloud(p, spark.createDataFrame(list(enumerate(lengths)), "batch_id long, length long"))


def xyz(c):
    return [tuple(r) for r in c.points.orderBy("batch_id", "row_id").select("x", "y", "z").collect()]


def test_padded_round_trip_keeps_the_empty_entry(spark):
    pad = [[99.0] * 3]
    rows = [(0, [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0], *pad], 2), (1, pad * 3, 0), (2, [[6.0, 7.0, 8.0], *pad, *pad], 1)]
    c = PointCloud.from_padded(spark.createDataFrame(rows, "batch_id long, points array<array<double>>, length int"))
    assert [tuple(r) for r in c.offsets().orderBy("batch_id").collect()] == [(0, 0, 2), (1, 2, 0), (2, 2, 1)]
    assert xyz(c) == [(0, 1, 2), (3, 4, 5), (6, 7, 8)]
    again = {r.batch_id: r.points for r in c.to_padded(-1.0).collect()}
    assert again == {0: [[0, 1, 2], [3, 4, 5]], 1: [[-1] * 3] * 2, 2: [[6, 7, 8], [-1] * 3]}
    c.validate()


@pytest.mark.parametrize("offsets", [[1, 3], [0, 4], [0, 2, 1, 3]])
def test_bad_offsets(spark, offsets):
    p = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(3)], "row_id long, x double, y double, z double")
    with pytest.raises(ValueError, match="offsets"):
        PointCloud.from_offsets(p, offsets)


def test_offsets_and_validate(spark):
    p = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(3)], "row_id long, x double, y double, z double")
    c = PointCloud.from_offsets(p, [0, 2, 2, 3])
    assert [r.length for r in c.lengths.orderBy("batch_id").collect()] == [2, 0, 1]
    assert {r.row_id: r.batch_id for r in c.batch_ids().collect()} == {0: 0, 1: 0, 2: 2}
    with pytest.raises(ValueError, match="offsets"):
        PointCloud(c.points, c.clouds.withColumn("length", F.lit(7))).validate()


def test_types_are_checked(spark):
    bad = spark.createDataFrame([(0, 0, 1, 1, 1)], "batch_id long, row_id long, x int, y int, z int")
    with pytest.raises(TypeError, match="float32 or float64"):
        PointCloud.packed(bad)
    with pytest.raises(TypeError, match="from_padded"):
        as_point_cloud(np.zeros((2, 3)))
    with pytest.raises(ValueError, match="from_padded"):
        PointCloud.from_dense(spark, np.zeros((2, 4)))
    dense = PointCloud.from_dense(spark, np.zeros((2, 5, 3), np.float32))
    assert dense.dtype == "float" and dense.batch_size == 2 and dense.to("double").dtype == "double"


def test_pairs_are_checked(spark):
    a = cloud(spark, [(0, 0, 0.0, 0.0, 0.0)], [1])
    with pytest.raises(ValueError, match="same batch size"):
        check_pair(a, cloud(spark, [(0, 0, 0.0, 0.0, 0.0)], [1, 0]))
    with pytest.raises(ValueError, match="non-empty"):
        check_pair(a, cloud(spark, [], [0]))


def test_transform_by_entry_turns_normals_and_keeps_features(spark):
    rows = [(0, 0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, "a"), (0, 1, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0, "b"), (1, 2, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, "c")]
    c = cloud(spark, rows, [2, 1], ", nx double, ny double, nz double, tag string")
    m0 = [[1.0, 0, 0, 10], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    m1 = [[0.0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    m = spark.createDataFrame([(0, [[float(v) for v in r] for r in m0]), (1, [[float(v) for v in r] for r in m1])], "batch_id long, m array<array<double>>")
    out = transform(c, m)
    assert xyz(out) == [(11, 0, 0), (12, 0, 0), (-1, 0, 0)]
    assert [tuple(r) for r in out.points.orderBy("row_id").select("nx", "ny", "nz", "tag").collect()] == [(1, 0, 0, "a"), (1, 0, 0, "b"), (-1, 0, 0, "c")]


def test_transform_broadcasts_over_empty_entries(spark):
    c = cloud(spark, [(1, 0, 1.0, 2.0, 3.0)], [0, 1, 0])
    out = transform(c, pose_to_matrix((0, 0, 0, 2, 3, 4)))
    assert xyz(out) == [(3, 5, 7)] and out.batch_size == 3


def test_pose_and_inverse():
    p = (0.3, -0.2, 0.5, 1.0, -2.0, 3.0)
    c, s = np.cos(p[:3]), np.sin(p[:3])
    rx = np.array([[1, 0, 0], [0, c[0], -s[0]], [0, s[0], c[0]]])
    ry = np.array([[c[1], 0, s[1]], [0, 1, 0], [-s[1], 0, c[1]]])
    rz = np.array([[c[2], -s[2], 0], [s[2], c[2], 0], [0, 0, 1]])
    m = np.array(pose_to_matrix(p))
    assert np.allclose(m[:3, :3], rz @ ry @ rx, atol=1e-12) and np.allclose(m[:3, 3], p[3:])
    assert np.allclose(np.array(rigid_inverse(m)) @ m, np.eye(4))


def test_segments_of_empty_entries(spark):
    c = cloud(spark, [(0, 0, 1.0, 0.0, 0.0), (0, 1, 3.0, 0.0, 0.0)], [2, 0])
    assert [r.x for r in segment_sum(c, "x").orderBy("batch_id").collect()] == [4.0, 0.0]
    means = [r.x for r in segment_mean(c, "x").orderBy("batch_id").collect()]
    assert means[0] == 2.0 and np.isnan(means[1])
    with pytest.raises(ValueError, match="reduction must be"):
        batch_reduce(segment_sum(c, "x"), "x", "median")
