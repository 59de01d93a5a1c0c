import numpy as np
import pytest

from pcframe.sources.files import parse_ply, read_matrix, read_ply
from pcframe.streaming.occupancy import voxel_occupancy

HEAD = "ply\nformat {} 1.0\ncomment c\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 0\nend_header\n"
POINTS = np.array([[0, 1, 2], [3.5, 4, 5], [-6, 7, 8]], np.float32)


def binary():
    rows = np.zeros(3, [("p", "<f4", 3), ("r", "u1")])
    rows["p"] = POINTS
    return HEAD.format("binary_little_endian").encode() + rows.tobytes()


def test_ply(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(binary())
    text = HEAD.format("ascii") + "".join(f"{x} {y} {z} 9\n" for x, y, z in POINTS.tolist())
    (tmp_path / "b.ply").write_text(text)
    got = read_ply(spark, str(tmp_path)).orderBy("path", "row").collect()
    assert np.array_equal([[r.x, r.y, r.z] for r in got], np.tile(POINTS, (2, 1)))


@pytest.mark.parametrize("data, match", [(b"ply\n", "end_header"), (b"plx\nend_header\n", "not a PLY"), (b"ply\nformat ascii 1.0\nend_header\n", "no vertices"), (binary().replace(b"little", b"big"), "unsupported format"), (binary().replace(b"float x", b"float w"), "first vertex")])
def test_ply_errors(data, match):
    with pytest.raises(ValueError, match=match):
        parse_ply(data)


def test_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# pose\n1 0 0 0.5\n0 1 0 0\n\n0 0 1 0\n0 0 0 1\n")
    m = read_matrix(spark, str(tmp_path / "m.txt")).first().m
    assert m[0] == [1, 0, 0, 0.5] and len(m) == 4


def test_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id % 2 as batch_id, cast(id as double) as x, 0d as y, 0d as z from range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    q = voxel_occupancy(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 10.0, time="ts").writeStream.format("memory").queryName("occ").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    got = {(r.batch_id, r.vx): r["count"] for r in spark.table("occ").collect()}
    want = {(r.batch_id, r.vx): r["count"] for r in voxel_occupancy(rows, 10.0, time="ts").collect()}
    assert got == want and sum(got.values()) == 100
