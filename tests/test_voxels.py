import pytest

from pcframe.operators.gradients import voxel_gradient
from pcframe.operators.voxel import voxelize
from tests.test_model import cloud
from tests.test_search import line


def test_signed_coordinates_and_ids(spark):
    grid = voxelize(line(spark, [[-3000000.2, -3000000.1], [-3000000.2, 1.2]]), 1.0)
    v = grid.ids().orderBy("voxel_id").collect()
    assert [(r.batch_id, r.vx, r.vy, r.vz, r["count"]) for r in v] == [(0, -3000001, 0, 0, 2), (1, -3000001, 0, 0, 1), (1, 1, 0, 0, 1)]
    assert [r.voxel_id for r in grid.point_to_voxel().orderBy("row_id").collect()] == [0, 0, 1, 2]
    assert [r.offset for r in grid.occupancy().orderBy("batch_id").collect()] == [0, 1]


@pytest.mark.parametrize("how, a, b", [("sum", [6, 8], [8, 1]), ("mean", [3, 4], [8, 1]), ("min", [2, 3], [8, 1]), ("max", [4, 5], [8, 1]), ("first", [2, 5], [8, 1])])
def test_reductions(spark, how, a, b):
    rows = [(0, 0, 0.1, 0.0, 0.0, 2.0, 5.0), (0, 1, 0.2, 0.0, 0.0, 4.0, 3.0), (0, 2, 1.1, 0.0, 0.0, 8.0, 1.0)]
    got = voxelize(cloud(spark, rows, [3], ", v0 double, v1 double"), 1.0).reduce("v0", "v1", reduction=how).orderBy("vx").collect()
    assert [[r.v0, r.v1] for r in got] == [a, b]


def test_gradient_empties_and_errors(spark):
    c = line(spark, [[], [0.1, 0.2, 1.1], []])
    grid = voxelize(c, 1.0)
    assert [r.g for r in voxel_gradient(grid).orderBy("row_id").collect()] == [0.5, 0.5, 1.0]
    assert [r.g for r in voxel_gradient(grid, "sum").collect()] == [1.0] * 3
    assert [r.length for r in grid.cloud.clouds.orderBy("batch_id").collect()] == [0, 2, 0]
    with pytest.raises(ValueError, match="voxel_size"):
        voxelize(c, 0.0)
    with pytest.raises(ValueError, match="reduction must be"):
        grid.reduce("x", reduction="median")


def test_float32_divides_in_float32(spark):
    import numpy as np

    g = np.random.default_rng(0).random((1, 500, 3)).astype(np.float32) * 7
    from pcframe.model import PointCloud

    got = sorted((r.row_id, r.vx, r.vy, r.vz) for r in voxelize(PointCloud.from_dense(spark, g), 0.1).keyed.collect())
    want = np.floor(g[0] / np.float32(0.1)).astype(int)
    assert [tuple(x[1:]) for x in got] == [tuple(r) for r in want.tolist()]
