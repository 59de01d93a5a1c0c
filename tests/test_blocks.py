"""The block search, dense numbers, and what is an error rather than a dropped row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pcframe.model import PointCloud
from pcframe.operators.align import procrustes
from pcframe.operators.metrics import chamfer_distance
from pcframe.operators.multiscale import ICPScale, Pyramid, build_pyramid, multiscale_icp
from pcframe.operators.neighbors import NeighborIndex, knn, radius_neighbors
from pcframe.operators.register import evaluate_registration, icp
from pcframe.operators.transforms import IDENTITY, pose_to_matrix, rigid_inverse, transform
from pcframe.operators.voxel import voxelize
from pcframe.plans import search
from pcframe.plans.order import numbered
from tests.test_search import dense, line


def brute(q, r, k, within):
    out = []
    for a in range(len(q)):
        d = np.square(q[a] - r).sum(1)
        d[~np.isfinite(r).all(1)] = np.inf
        if np.isfinite(q[a]).all():
            out += [(a, b) for b in np.lexsort((np.arange(len(r)), d))[:k] if d[b] <= (within if np.isscalar(within) else within[a]) and np.isfinite(d[b])]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_nearest_equals_brute_force(seed):
    g = np.random.default_rng(seed)
    q, r = g.integers(0, 6, (300, 3)).astype(float), g.integers(0, 6, (400, 3)).astype(float)  # many ties
    q[3], r[5] = np.nan, np.inf
    k, within = int(g.integers(1, 9)), [np.inf, 2.0, g.random(300) * 4][seed % 3]
    i, j, d = search.nearest(q, r, k, within)
    assert list(zip(i.tolist(), j.tolist())) == brute(q, r, k, within)
    assert np.array_equal(d, np.square(q[i] - r[j]).sum(1))
    assert len(search.nearest(q[:0], r, k)[0]) == len(search.nearest(q, r[:0], k)[0]) == 0


@pytest.mark.parametrize("shape", ["cube", "plane", "line", "clumps", "equal"])
def test_flat_and_clumped_clouds_stay_far_from_quadratic(monkeypatch, shape):
    g, n = np.random.default_rng(1), 6_000
    p = {"cube": g.random((n, 3)), "plane": g.random((n, 3)) * [1, 1, 0], "line": g.random((n, 3)) * [0, 1, 0], "clumps": np.concatenate([g.random((n // 2, 3)), 1e-6 * g.random((n // 2, 3))]), "equal": np.zeros((500, 3))}[shape]
    compared, real = [0], search._squared

    def counted(a, b):
        compared[0] += len(a) * len(b)
        return real(a, b)

    monkeypatch.setattr(search, "_squared", counted)
    i, _, _ = search.nearest(p, p, 8)
    assert len(i) == 8 * len(p)
    assert shape == "equal" or compared[0] < 0.3 * len(p) ** 2


@pytest.mark.parametrize("radius", [None, 0.15])
def test_blocks_equal_brute_force(spark, monkeypatch, radius):
    monkeypatch.setattr(search, "LOCAL_POINTS", 60)
    g = np.random.default_rng(4)
    ref, q = np.round(g.random((2, 500, 3)), 2), np.round(g.random((2, 90, 3)), 2)
    ref[1, :, 2] = q[1, :, 2] = 0  # one flat entry
    index = NeighborIndex(dense(spark, ref))
    assert len(index.blocks()[1].trees) == 2 and index.blocks() is index.blocks()
    sizes = [r["count"] for r in index.blocks()[0].groupBy("batch_id", "block").count().collect()]
    assert max(sizes) <= 120 and len(sizes) > 10
    queries = dense(spark, q)
    got = (index.knn(queries, 5) if radius is None else index.hybrid(queries, radius, 5)).orderBy("query_row", "rank").collect()
    want = [(90 * b + i, 500 * b + j) for b in range(2) for i, j in brute(q[b], ref[b], 5, np.inf if radius is None else radius * radius)]
    assert [(r.query_row, r.ref_row) for r in got] == want
    assert [r["rank"] for r in got] == [1 + k - [x for x, _ in want].index(x) for k, (x, _) in enumerate(want)]


def test_infinite_radius_and_types(spark):
    a, b = line(spark, [[0, 5]]), line(spark, [[1]])
    assert radius_neighbors(a, b, float("inf")).count() == 2
    assert evaluate_registration(b, a, float("inf")).first().fitness == 1.0
    assert icp(b, a, float("inf"), strategy="distributed", max_iterations=2).count() == 1
    for bad in (0.0, -1.0, float("nan")):
        with pytest.raises(ValueError, match="positive"):
            radius_neighbors(a, b, bad)
        with pytest.raises(ValueError, match="positive"):
            icp(b, a, bad)
    with pytest.raises(TypeError, match="dtype"):
        knn(a, b.to("float"), 1)
    with pytest.raises(ValueError, match="grid"):
        knn(a, b, 1, algorithm="grid")


def test_registration_searches_the_given_index(spark, monkeypatch):
    monkeypatch.setattr(search, "LOCAL_POINTS", 60)
    g = np.random.default_rng(6)
    t = dense(spark, g.random((1, 300, 3)))
    pose = pose_to_matrix((0.02, -0.01, 0.02, 0.01, 0.0, -0.01))
    s, index = transform(t, rigid_inverse(pose)), NeighborIndex(t)
    for strategy in ("distributed", "local"):
        got = icp(s, t, 0.1, strategy=strategy, index=index).first()
        assert got.converged and np.allclose(np.array(got.transform), pose, atol=1e-6)
    assert evaluate_registration(s, t, 0.1, pose, index=index).first().fitness == 1.0
    with pytest.raises(ValueError, match="index"):
        icp(s, t, 0.1, index=NeighborIndex(s))


def test_missing_rows_are_errors(spark):
    a = line(spark, [[0, 1, 2], [3, 4, 9]])
    one = spark.createDataFrame([(0, IDENTITY)], "batch_id long, m array<array<double>>")
    with pytest.raises(Exception, match="none for entry 1"):
        transform(a, one).points.collect()
    for init in (one, one.unionByName(one), one.unionByName(spark.createDataFrame([(1, IDENTITY[:3])], "batch_id long, m array<array<double>>"))):
        with pytest.raises(ValueError, match="init must have shape"):
            icp(a, a, 1.0, init=init)
    weights = a.points.select("row_id", F.lit(1.0).alias("weight"))
    for bad in (weights.where("row_id > 0"), weights.unionByName(weights), weights.unionByName(spark.createDataFrame([(99, 1.0)], "row_id long, weight double"))):
        with pytest.raises(ValueError, match="weights must have one row"):
            procrustes(a, a, weights=bad)
        with pytest.raises(ValueError, match="values must have one row"):
            a.with_values(bad)
    normals = a.points.select("row_id", *[F.lit(v).alias(c) for c, v in (("nx", 1.0), ("ny", 0.0), ("nz", 0.0))])
    with pytest.raises(ValueError, match="target_normals must have one row"):
        icp(a, a, 1.0, method="point_to_plane", target_normals=normals.limit(2))
    with pytest.raises(ValueError, match="dtype"):
        icp(a, a, 1.0, method="point_to_plane", target_normals=normals.withColumns({c: F.col(c).cast("float") for c in ("nx", "ny", "nz")}))


def test_both_directions_equal_two_searches(spark, monkeypatch):
    g = np.random.default_rng(7)
    a, b = dense(spark, g.random((3, 40, 3))), dense(spark, g.random((3, 30, 3)))
    local = [r.chamfer for r in chamfer_distance(a, b, reduction="none").orderBy("batch_id").collect()]
    monkeypatch.setattr(search, "LOCAL_POINTS", 10)
    assert np.allclose([r.chamfer for r in chamfer_distance(a, b, reduction="none").orderBy("batch_id").collect()], local, rtol=1e-12)
    assert np.isclose(chamfer_distance(a, b).first()[0], np.mean(local))


def test_numbers_in_order(spark):
    d = spark.range(500).select((F.col("id") * 37 % 500).alias("a"), (F.col("id") % 2).alias("b")).repartition(5)
    got = [r.n for r in numbered(d, ["b", "a"], "n").orderBy("b", "a").collect()]
    assert got == list(range(500))
    assert numbered(d.limit(0), ["a"], "n").count() == 0
    wall = dense(spark, [[[0.5, i % 20, i // 20] for i in range(400)]])
    assert [r.voxel_id for r in voxelize(wall, 1.0).ids().orderBy("vx", "vy", "vz").collect()] == list(range(400))
    c = line(spark, [[5, 6], [], [7, 8, 9]])
    for whole in (True, False):
        assert [r.local_row for r in c.local_rows(whole).orderBy("row_id").collect()] == [0, 1, 0, 1, 2]


def test_offsets_of_empty_entries(spark):
    p = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(6)], "row_id long, x double, y double, z double")
    c = PointCloud.from_offsets(p, [0, 0, 2, 2, 2, 5, 6, 6])
    assert [(r.row_id, r.batch_id) for r in c.batch_ids().orderBy("row_id").collect()] == [(0, 1), (1, 1), (2, 4), (3, 4), (4, 4), (5, 5)]
    assert [r.length for r in c.clouds.orderBy("batch_id").collect()] == [0, 2, 0, 0, 3, 1, 0]


def test_pyramid_checks(spark):
    a, b = line(spark, [[0, 1.5, 3]]), line(spark, [[0, 1.5, 3], [4]])
    with pytest.raises(ValueError, match="nonnegative integer"):
        ICPScale(1.0, 1.0, 2.5)
    with pytest.raises(ValueError, match="same nonzero length"):
        Pyramid((), ())
    with pytest.raises(ValueError, match="positive"):
        Pyramid((a,), (0.0,))
    with pytest.raises(TypeError, match="PointCloud"):
        Pyramid((a.points,), (1.0,))
    with pytest.raises(ValueError, match="dtype"):
        Pyramid((a, a.to("float")), (1.0, 2.0))
    with pytest.raises(ValueError, match="batch size"):
        multiscale_icp(Pyramid((a, b), (1.0, 2.0)), a, [ICPScale(1.0, 1.0), ICPScale(2.0, 1.0)])
    p = build_pyramid(b, [1.0, 2.0])
    assert [[r.length for r in level.clouds.orderBy("batch_id").collect()] for level in p.levels] == [[3, 1], [2, 1]]
    rows = [r.row_id for level in p.levels for r in level.points.collect()]
    assert len(set(rows)) == len(rows) == 7


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,3000]"])
def test_shared_folder_is_asked_for_on_clusters(master):
    from types import SimpleNamespace

    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        search.keep(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_search_makes_no_pairs_of_entries(spark):
    """Many ties, and no join of queries with the reference."""
    g = np.random.default_rng(11)
    q, r = g.integers(0, 5, (2, 150, 3)).astype(float), g.integers(0, 5, (2, 200, 3)).astype(float)
    got = knn(dense(spark, r), dense(spark, q), 3, algorithm="batch")
    assert "Join" not in _plan(got) and "CartesianProduct" not in _plan(got)
    rows = [(x.query_row, x.ref_row) for x in got.orderBy("query_row", "rank").collect()]
    assert rows == [(b * 150 + i, b * 200 + j) for b in range(2) for i, j in brute(q[b], r[b], 3, np.inf)]
    lost = PointCloud.packed(dense(spark, r).points.withColumn("batch_id", F.when(F.col("batch_id") == 0, F.col("batch_id"))))
    assert {x.batch_id for x in knn(lost, lost, 1, algorithm="batch").collect()} == {0}  # a null is no entry


def test_copies_of_a_point_are_compared_k_times_at_most(monkeypatch):
    p, compared, real = np.repeat([[0.0, 0, 0], [-0.0, 3, 1]], 3_000, axis=0), [0], search._squared

    def counted(a, b):
        compared[0] += len(a) * len(b)
        return real(a, b)

    monkeypatch.setattr(search, "_squared", counted)
    i, j, d = search.nearest(p, p, 2)
    assert compared[0] < 10 * len(p) and not d.any()
    assert i.tolist() == np.repeat(np.arange(6_000), 2).tolist() and j.tolist() == [0, 1] * 3_000 + [3_000, 3_001] * 3_000


@pytest.mark.parametrize("method", ["point_to_point", "point_to_plane"])
def test_distributed_registration_meets_no_pairs_within_the_distance(spark, monkeypatch, method):
    """All points of an entry within max_distance of one another: nearest points come from blocks."""

    def fail(*_):
        raise AssertionError("all pairs within the distance")

    monkeypatch.setattr(search, "band_join", fail)
    g = np.random.default_rng(13)
    t = dense(spark, g.random((2, 300, 3)) * 0.1)
    n = g.normal(size=(600, 3))
    n = spark.createDataFrame([(i, *map(float, v / np.linalg.norm(v))) for i, v in enumerate(n)], "row_id long, nx double, ny double, nz double")
    s = transform(t, rigid_inverse(pose_to_matrix((0.01, -0.02, 0.01, 0.001, 0.002, -0.001))))
    more = {"target_normals": n, "method": method} if method == "point_to_plane" else {}
    near, far = ({x.batch_id: x for x in icp(s, t, 0.5, max_iterations=3, strategy=w, **more).collect()} for w in ("distributed", "local"))
    assert near.keys() == far.keys() == {0, 1}
    for b in near:
        assert np.allclose(near[b].transform, far[b].transform, atol=1e-9) and near[b].fitness == far[b].fitness == 1.0
    at = evaluate_registration(s, t, 0.5).orderBy("batch_id").collect()
    assert [x.fitness for x in at] == [1.0, 1.0]


def test_grid_search_makes_no_pairs_of_cells(spark):
    """All points of an entry in a few cells, with ties at the last rank and on the radius."""
    g = np.random.default_rng(17)
    q, r = g.integers(0, 4, (1, 120, 3)).astype(float), g.integers(0, 4, (1, 300, 3)).astype(float)
    got = radius_neighbors(dense(spark, r), dense(spark, q), 2.0, max_neighbors=5, algorithm="grid")
    assert "Join" not in _plan(got) and "CartesianProduct" not in _plan(got)
    assert [(x.query_row, x.ref_row) for x in got.orderBy("query_row", "rank").collect()] == brute(q[0], r[0], 5, 4.0)


def test_all_pairs_come_in_tiles(spark, monkeypatch):
    """One entry's pairs are dealt to as many tasks as tiles, each pair once; the other entry is one tile."""
    monkeypatch.setattr(search, "TILE", 16, raising=False)
    g = np.random.default_rng(19)
    a, b = g.random((1, 100, 3)), g.random((1, 70, 3))
    r, q = search.sides(dense(spark, b).points.unionByName(line(spark, [[], [1, 2, 3]]).points.withColumn("row_id", F.col("row_id") + 70)), dense(spark, a).points.unionByName(line(spark, [[], [5]]).points.withColumn("row_id", F.col("row_id") + 100)))
    got = search.batch_join(r, q)
    assert sorted(got.columns) == sorted({*r.columns, *q.columns, "d2"})
    rows = got.select("query_row", "ref_row", "d2", F.spark_partition_id().alias("task")).collect()
    want = {(i, j): float(np.square(a[0, i] - b[0, j]).sum()) for i in range(100) for j in range(70)} | {(100, 70 + j): float((4 - j) ** 2) for j in range(3)}
    assert len(rows) == len(want) and all(np.isclose(want[x.query_row, x.ref_row], x.d2) for x in rows)
    pairs = np.bincount([x.task for x in rows])
    assert np.count_nonzero(pairs) > 10 and pairs.max() < 0.4 * len(rows)
