import numpy as np
import pytest

from pcframe.model import PointCloud
from pcframe.operators.gradients import chamfer_gradient, knn_gradient
from pcframe.operators.neighbors import NeighborIndex, hybrid_neighbors, knn, radius_neighbors, slots
from tests.test_model import cloud


def line(spark, entries):
    """One-dimensional clouds: x values of each entry."""
    rows, i = [], 0
    for b, xs in enumerate(entries):
        for x in xs:
            rows.append((b, i, float(x), 0.0, 0.0))
            i += 1
    return cloud(spark, rows, [len(e) for e in entries])


def dense(spark, a):
    return PointCloud.from_dense(spark, np.asarray(a, float))


def wide(found, q, k):
    return [(r.ref_row, r.valid) for r in slots(found, q, k).orderBy("query_row", "slot").collect()]


def test_entries_are_isolated(spark):
    ref, q = line(spark, [[0, 2], [10, 12]]), line(spark, [[1.9], [10.1]])
    got = knn(ref, q, 2).orderBy("query_row", "rank").collect()
    assert [r.ref_row for r in got] == [1, 0, 2, 3]
    assert np.allclose([r.d2 for r in got], [0.01, 3.61, 0.01, 3.61])


@pytest.mark.parametrize("algorithm", ["batch", "grid"])
def test_radius_and_hybrid(spark, algorithm):
    ref, q = line(spark, [[0, 1], [10]]), line(spark, [[0.1], [10.2]])
    for found in (radius_neighbors(ref, q, 0.5, algorithm=algorithm), hybrid_neighbors(ref, q, 0.5, 2, algorithm=algorithm)):
        assert [r.ref_row for r in found.orderBy("query_row").collect()] == [0, 2]


def test_invalid_slots_and_empty_references(spark):
    q = line(spark, [[0.1, 2]])
    assert wide(hybrid_neighbors(line(spark, [[0]]), q, 0.5, 2), q, 2) == [(0, True), (-1, False), (-1, False), (-1, False)]
    q = line(spark, [[0], [10.1]])
    assert wide(knn(line(spark, [[], [10]]), q, 1), q, 1) == [(-1, False), (0, True)]


def test_far_query_and_radius_edge(spark):
    origin = line(spark, [[0]])
    assert knn(origin, line(spark, [[1e10]]), 1).first().d2 == 1e20
    assert wide(radius_neighbors(origin, q := line(spark, [[0.0999, 0.1001]]), 0.1), q, 1) == [(0, True), (-1, False)]


@pytest.mark.parametrize("algorithm", ["batch", "local", "blocks"])
def test_equals_brute_force(spark, algorithm):
    g = np.random.default_rng(3)
    ref, q = g.random((2, 37, 3)), g.random((2, 11, 3))
    got = knn(dense(spark, ref), dense(spark, q), 5, algorithm=algorithm).orderBy("query_row", "rank").collect()
    want = [b * 37 + i for b in range(2) for d in ((q[b][:, None] - ref[b][None]) ** 2).sum(-1) for i in np.argsort(d, kind="stable")[:5]]
    assert [r.ref_row for r in got] == want


def test_nan_points_match_nothing(spark):
    ref, q = line(spark, [[0, float("nan")]]), line(spark, [[0.25, float("nan")]])
    assert [(r.query_row, r.ref_row) for r in knn(ref, q, 2).collect()] == [(0, 0)]
    assert [(r.query_row, r.ref_row) for r in radius_neighbors(ref, q, 1.0).collect()] == [(0, 0)]


def test_arguments(spark):
    c = line(spark, [[0]])
    for k in (0, 65):
        with pytest.raises(ValueError, match=r"\[1, 64\]"):
            knn(c, c, k)
    with pytest.raises(ValueError, match="positive"):
        radius_neighbors(c, c, 0.0)
    with pytest.raises(ValueError, match="bvh"):
        NeighborIndex(c, algorithm="bvh")


def test_gradients(spark):
    by_query, by_ref = knn_gradient(line(spark, [[0, 2]]), line(spark, [[0.25]]), 1)
    assert by_query.first().gx == 0.5
    assert [r.gx for r in by_ref.orderBy("row_id").collect()] == [-0.5, 0.0]
    g = np.random.default_rng(5)
    s, t = g.random((1, 6, 3)), g.random((1, 7, 3))

    def value(a):
        d = ((a[0][:, None] - t[0][None]) ** 2).sum(-1)
        return (d.min(1).mean() + d.min(0).mean()) / 2

    got = np.array([[r.gx, r.gy, r.gz] for r in chamfer_gradient(dense(spark, s), dense(spark, t)).orderBy("row_id").collect()])
    e, want = 1e-6, np.zeros((6, 3))
    for i in range(6):
        for j in range(3):
            up, down = s.copy(), s.copy()
            up[0, i, j] += e
            down[0, i, j] -= e
            want[i, j] = (value(up) - value(down)) / (2 * e)
    assert np.allclose(got, want, atol=1e-6)
