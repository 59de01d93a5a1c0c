import numpy as np
import pytest
from pyspark.sql import functions as F

from pcframe.model import PointCloud
from pcframe.operators import metrics
from pcframe.operators.align import procrustes
from pcframe.operators.multiscale import ICPScale, build_pyramid, multiscale_icp
from pcframe.operators.normals import estimate_normals
from pcframe.operators.register import evaluate_registration, icp
from pcframe.operators.transforms import pose_to_matrix, transform
from tests.test_model import cloud
from tests.test_search import dense, line


def matrices(df):
    return [np.array(r.transform) for r in df.orderBy("batch_id").collect()]


def test_metric_pair(spark):
    p, r = line(spark, [[0, 1], [10]]), line(spark, [[0.1, 1.1], [10.2]])
    assert np.allclose([x.chamfer for x in metrics.chamfer_distance(p, r, squared=False, reduction="none").orderBy("batch_id").collect()], [0.1, 0.2])
    assert [x.f1 for x in metrics.fscore(p, r, 0.15).orderBy("batch_id").collect()] == [1.0, 0.0]
    assert np.isclose(metrics.chamfer_distance(p, r, squared=False).first()[0], 0.15)
    for bad in (0.0, [0.1]):
        with pytest.raises(ValueError, match="threshold"):
            metrics.fscore(p, r, bad)


def test_grid_shift(spark):
    g = np.stack(np.meshgrid(*[np.arange(5.0)] * 3), -1).reshape(1, -1, 3)
    m = metrics.point_cloud_metrics(dense(spark, g), dense(spark, g + [0.1, 0, 0]), 0.2).first()
    assert np.allclose([m.accuracy, m.completion, m.chamfer], 0.1) and m.f1 == 1.0


def test_normals(spark):
    got = estimate_normals(line(spark, [[0, 100]]), radius=0.1, k=5).collect()
    assert all(not r.valid and (r.nx, r.ny, r.nz, r.curvature) == (0, 0, 0, 0) for r in got)
    g = np.random.default_rng(1).normal(size=(400, 3))
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    rows = [(0, i, *map(float, p), *map(float, p)) for i, p in enumerate(g)]
    c = cloud(spark, rows, [400], ", nx double, ny double, nz double")
    n = np.array([[r.nx, r.ny, r.nz] for r in estimate_normals(c, k=12).orderBy("row_id").collect()])
    assert ((n * g).sum(1) > 0).all() and np.median((n * g).sum(1)) > 0.98
    with pytest.raises(ValueError, match="k must be"):
        estimate_normals(c, k=2)
    with pytest.raises(ValueError, match="radius"):
        estimate_normals(c, -1.0)


def test_procrustes(spark):
    g = np.random.default_rng(2)
    a = dense(spark, g.random((2, 30, 3)))
    m = np.array(pose_to_matrix((0.3, -0.2, 0.5, 1, -2, 3)))
    for got in matrices(procrustes(a, transform(a, m.tolist()))):
        assert np.allclose(got, m, atol=1e-10)
    similar = m.copy()
    similar[:3, :3] *= 2.5
    out = procrustes(a, transform(a, similar.tolist()), estimate_scale=True)
    assert np.allclose([r.scale for r in out.collect()], 2.5, atol=1e-10)


def test_procrustes_errors(spark):
    flat = cloud(spark, [(0, t, 1.0 * t, 2.0 * t, 3.0 * t) for t in range(4)], [4])
    with pytest.raises(ValueError, match="non-collinear"):
        procrustes(flat, flat)
    w = lambda *v: spark.createDataFrame(list(enumerate(map(float, v))), "row_id long, weight double")
    with pytest.raises(ValueError, match="at least 3"):
        procrustes(flat, flat, weights=w(1, 1, 0, 0))
    with pytest.raises(ValueError, match="nonnegative"):
        procrustes(flat, flat, weights=w(1, 1, 1, -1))
    with pytest.raises(ValueError, match="equal lengths"):
        procrustes(flat, cloud(spark, [(0, 0, 0.0, 0.0, 0.0)], [1]))


@pytest.mark.parametrize("strategy", ["local", "distributed"])
def test_icp_recovers_and_isolates_failures(spark, strategy):
    g = np.random.default_rng(4).random((2, 150, 3))
    m = np.array(pose_to_matrix((0.03, -0.02, 0.02, 0.01, -0.01, 0.02)))
    s = dense(spark, g)
    t = transform(s, m.tolist())
    s = PointCloud(s.points.withColumn("x", F.when(F.col("batch_id") == 1, F.col("x") + 100).otherwise(F.col("x"))), s.clouds)
    good, bad = icp(s, t, 0.1, strategy=strategy).orderBy("batch_id").collect()
    assert good.converged and good.fitness == 1.0 and np.allclose(good.transform, m, atol=1e-5)
    assert not bad.converged and bad.iterations == 0 and np.array_equal(bad.transform, np.eye(4)) and bad.fitness == 0 == bad.inlier_rmse
    one = icp(s, t, 0.1, max_iterations=1, strategy=strategy).orderBy("batch_id").first()
    assert not one.converged and one.iterations == 1
    at = evaluate_registration(s, t, 0.1, m.tolist()).orderBy("batch_id").first()
    assert at.fitness == 1.0 and at.inlier_rmse < 1e-12


def test_icp_plane_huber_and_arguments(spark):
    g = np.random.default_rng(6).random((1, 200, 3))
    n = np.random.default_rng(7).normal(size=(200, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    m = np.array(pose_to_matrix((0.02, -0.02, 0.02, 0.01, -0.01, 0.01)))
    s = dense(spark, g)
    t = transform(s, m.tolist())
    normals = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(n)], "row_id long, nx double, ny double, nz double")
    got = icp(s, t, 0.2, method="point_to_plane", target_normals=normals, robust_kernel="huber", robust_delta=0.5)
    assert np.allclose(matrices(got)[0], m, atol=1e-4)
    for match, kw in {"target_normals": {"method": "point_to_plane"}, "method": {"method": "x"}, "max_iterations": {"max_iterations": -1}, "thresholds": {"relative_rmse": -1.0}, "robust_kernel": {"robust_kernel": "x"}, "robust_delta": {"robust_delta": 0.0}}.items():
        with pytest.raises(ValueError, match=match):
            icp(s, t, 0.2, **kw)
    with pytest.raises(ValueError, match="max_distance"):
        icp(s, t, 0.0)


def test_multiscale_widens_the_basin(spark):
    g = np.random.default_rng(8)
    a = np.concatenate([g.normal([0, 0, 0], [0.5, 0.2, 0.1], (140, 3)), g.normal([1.2, 0.5, 0], [0.1, 0.3, 0.2], (80, 3)), g.normal([-0.5, 0.8, 0.6], [0.2, 0.1, 0.3], (60, 3))])[None]
    m = np.array(pose_to_matrix((0.08, -0.05, 0.12, 0.28, -0.18, 0.12)))
    s = dense(spark, a)
    t = transform(s, m.tolist())
    out = multiscale_icp(s, t, [ICPScale(0.2, 0.6, 25), ICPScale(1e-3, 0.2, 20)])
    assert np.allclose(matrices(out)[0], m, atol=2e-3)
    with pytest.raises(ValueError, match="at least one"):
        multiscale_icp(s, t, [])
    with pytest.raises(ValueError, match="voxel_sizes"):
        multiscale_icp(s, build_pyramid(t, [0.5]), [ICPScale(0.25, 0.6)])
    p = build_pyramid(t, [0.5])
    with pytest.raises(ValueError, match="cannot be combined"):
        multiscale_icp(s, p, [ICPScale(0.5, 0.6)], target_normals=s.points)
