"""The catalogue of point-cloud queries over the generated tables, with their DuckDB equivalents.

Values that are irrational are quantised to 1e-6 before they are summed (q6), so that neither
engine's order of summation shows; coordinates are dyadic, so squared distances are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pcframe.model import NORMALS, XYZ, PointCloud, as_point_cloud, check_pair
from pcframe.operators import gradients, metrics, multiscale, register
from pcframe.operators.align import procrustes
from pcframe.operators.neighbors import NeighborIndex, hybrid_neighbors, knn, radius_neighbors, slots
from pcframe.operators.normals import estimate_normals
from pcframe.operators.segments import batch_reduce, segment_mean, segment_sum
from pcframe.operators.transforms import pose_error, pose_matrix, pose_to_matrix, rigid_inverse, transform, transform_points
from pcframe.operators.voxel import VOXEL, voxelize
from pcframe.plans.order import numbered
from pcframe.sources import clouds
from pcframe.sources.files import read_matrix, read_ply
from pcframe.streaming.occupancy import voxel_occupancy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

POSE = (0.03, -0.02, 0.04, 0.01, -0.008, 0.006)
POSES = [(0.3, -0.2, 0.5, 1.0, -2.0, 3.0), (0.01, 0.02, -0.03, 0.25, 0.5, -0.75), (0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
SHIFT = [[1.0, 0.0, 0.0, 10.0], [0.0, 1.0, 0.0, -2.5], [0.0, 0.0, 1.0, 0.125], [0.0, 0.0, 0.0, 1.0]]
RADIUS, EVT_RADIUS, THRESHOLD = 0.125, 1.5, 0.125


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def q6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("long")


def _q6(x: str) -> str:
    return f"CAST(floor(({x}) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def _with(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({clouds.SQL[n]})" for n in names) + (", " + more if more else "") + " "


_D2 = "((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z))"
_A, _B = (lambda s, d: clouds.embeddings(s, d, 0)), (lambda s, d: clouds.embeddings(s, d, 3))


def _pairs(q: str, r: str) -> str:
    return f"SELECT q.batch_id, q.row_id AS query_row, r.row_id AS ref_row, {_D2} AS d2 FROM {q} q JOIN {r} r ON q.batch_id = r.batch_id"


def _ranked(q: str, r: str, k: int, where: str = "true") -> str:
    return f"SELECT batch_id, query_row, CAST(rank AS INTEGER) AS rank, ref_row, d2 FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, query_row ORDER BY d2, ref_row) AS rank FROM ({_pairs(q, r)}) WHERE {where}) WHERE rank <= {k}"


_NEAREST = f"f AS MATERIALIZED (SELECT batch_id, query_row, min(d2) AS d2 FROM ({_pairs('emb_a', 'emb_b')}) GROUP BY ALL), b AS MATERIALIZED (SELECT batch_id, query_row, min(d2) AS d2 FROM ({_pairs('emb_b', 'emb_a')}) GROUP BY ALL)"
_EACH = _with("emb_a", "emb_b", more=_NEAREST + ", fa AS (SELECT batch_id, avg(d2) AS m FROM f GROUP BY 1), ba AS (SELECT batch_id, avg(d2) AS m FROM b GROUP BY 1)")


# -- metrics ------------------------------------------------------------------------------
@query(_EACH + "SELECT batch_id, (fa.m + ba.m) / 2 AS chamfer FROM fa JOIN ba USING (batch_id)")
def chamfer_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chamfer_distance(_A(spark, sf_dir), _B(spark, sf_dir), reduction="none")


@query(_EACH + "SELECT batch_id, m AS chamfer FROM fa")
def chamfer_one_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chamfer_distance(_A(spark, sf_dir), _B(spark, sf_dir), bidirectional=False, reduction="none")


@query(_with("emb_a", "emb_b", more=_NEAREST) + f"SELECT batch_id, CAST(sum({_q6('sqrt(d2)')}) AS BIGINT) AS sum_q6, count(*) AS n FROM f GROUP BY 1")
def chamfer_unsquared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.directed_nearest(_A(spark, sf_dir), _B(spark, sf_dir)).groupBy("batch_id").agg(F.sum(q6(F.sqrt("d2"))).alias("sum_q6"), F.count("*").alias("n"))


@query(_EACH + f"SELECT {_q6('avg((fa.m + ba.m) / 2)')} AS chamfer_q6 FROM fa JOIN ba USING (batch_id)")
def chamfer_reduce_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chamfer_distance(_A(spark, sf_dir), _B(spark, sf_dir), reduction="mean").select(q6("chamfer").alias("chamfer_q6"))


@query(_EACH + f"SELECT {_q6('sum((fa.m + ba.m) / 2)')} AS chamfer_q6 FROM fa JOIN ba USING (batch_id)")
def chamfer_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chamfer_distance(_A(spark, sf_dir), _B(spark, sf_dir), reduction="sum").select(q6("chamfer").alias("chamfer_q6"))


_HITS = f"h AS (SELECT batch_id, avg(CASE WHEN d2 <= CAST({THRESHOLD * THRESHOLD} AS DOUBLE) THEN 1.0::DOUBLE ELSE 0 END) AS precision FROM f GROUP BY 1), g AS (SELECT batch_id, avg(CASE WHEN d2 <= CAST({THRESHOLD * THRESHOLD} AS DOUBLE) THEN 1.0::DOUBLE ELSE 0 END) AS recall FROM b GROUP BY 1)"
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"


@query(_with("emb_a", "emb_b", more=_NEAREST + ", " + _HITS) + f"SELECT batch_id, precision, recall, {_F1} AS f1 FROM h JOIN g USING (batch_id)")
def fscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fscore(_A(spark, sf_dir), _B(spark, sf_dir), THRESHOLD)


@query(
    _with("emb_a", "emb_b", more=_NEAREST + ", " + _HITS + ", m AS (SELECT batch_id, avg(sqrt(d2)) AS a FROM f GROUP BY 1), n AS (SELECT batch_id, avg(sqrt(d2)) AS c FROM b GROUP BY 1)")
    + f"SELECT batch_id, {_q6('a')} AS accuracy_q6, {_q6('c')} AS completion_q6, {_q6('(a + c) / 2')} AS chamfer_q6, {_q6('precision')} AS precision_q6, {_q6('recall')} AS recall_q6, {_q6(_F1)} AS f1_q6 FROM m JOIN n USING (batch_id) JOIN h USING (batch_id) JOIN g USING (batch_id)"
)
def point_cloud_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.point_cloud_metrics(_A(spark, sf_dir), _B(spark, sf_dir), THRESHOLD)
    return got.select("batch_id", *[q6(c).alias(f"{c}_q6") for c in got.columns[1:]])


# -- neighbor search ----------------------------------------------------------------------
@query(_with("emb_a", "emb_b") + _ranked("emb_a", "emb_b", 5))
def knn_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(_B(spark, sf_dir), _A(spark, sf_dir), 5)


@query(_with("prt") + _ranked("prt", "prt", 10))
def knn_self_k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clouds.parts(spark, sf_dir)
    return knn(c, c, 10)


@query(_with("prt") + _ranked("prt", "prt", 3))
def knn_batch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clouds.parts(spark, sf_dir)
    return knn(c, c, 3, algorithm="batch")


def _one_entry(cloud: PointCloud, **moved: Column) -> PointCloud:
    """All points as one entry."""
    p = cloud.points.withColumn("batch_id", F.lit(0).cast("long")).withColumns(moved)
    return PointCloud(p, p.groupBy("batch_id").agg(F.count("*").alias("length")))


_ONE = "one AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS batch_id, row_id, {x} AS x, {y} AS y, {z} AS z FROM {name})"


def _in_blocks(points: int):
    """Entries of more than so many points are cut into blocks, which the small tables have none of."""
    from pcframe.plans import search

    def run(f: Callable[[], DataFrame]) -> DataFrame:
        before, search.LOCAL_POINTS = search.LOCAL_POINTS, points
        try:
            return f()
        finally:
            search.LOCAL_POINTS = before

    return run


@query(_with("evt", more=_ONE.format(x="x", y="y", z="z", name="evt")) + _ranked("one", "one", 4))
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry, cut into blocks; many points at equal distances."""
    c = _one_entry(clouds.events(spark, sf_dir))
    return _in_blocks(1_000)(lambda: knn(c, c, 4))


@query(_with("prt", more=_ONE.format(x="y", y="z", z="CAST(0 AS DOUBLE)", name="prt")) + _ranked("one", "one", 5))
def knn_plane_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat entry in blocks."""
    c = _one_entry(clouds.parts(spark, sf_dir), x=F.col("y"), y=F.col("z"), z=F.lit(0.0))
    return _in_blocks(200)(lambda: knn(c, c, 5))


@query(_with("evt", more="skew AS MATERIALIZED (SELECT CASE WHEN batch_id < 24 THEN 0 ELSE batch_id END AS batch_id, row_id, CASE WHEN batch_id = 31 THEN 1000 * x ELSE x END AS x, y, z FROM evt)") + _ranked("skew", "skew", 3))
def knn_skewed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry with most of the points, some small ones, and a sparse one."""
    p = clouds.events(spark, sf_dir).points
    p = p.withColumn("x", F.when(F.col("batch_id") == 31, 1000 * F.col("x")).otherwise(F.col("x"))).withColumn("batch_id", F.when(F.col("batch_id") < 24, F.lit(0).cast("long")).otherwise(F.col("batch_id")))
    c = PointCloud.packed(p)
    return _in_blocks(1_500)(lambda: knn(c, c, 3))


@query(_with("prt", more="thick AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS batch_id, row_id, x / 1024 AS x, y / 1024 AS y, z / 1024 AS z FROM prt)") + _ranked("thick", "thick", 8, "d2 <= CAST(1 AS DOUBLE)"))
def hybrid_dense_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of an entry within the radius of one another."""
    c = _one_entry(clouds.parts(spark, sf_dir), **{c: F.col(c) / 1024 for c in XYZ})
    return _in_blocks(300)(lambda: hybrid_neighbors(c, c, 1.0, 8))


@query(_with("emb_a", "emb_b") + _ranked("emb_a", "emb_b", 64, f"d2 <= CAST({RADIUS * RADIUS} AS DOUBLE)"))
def radius_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius_neighbors(_B(spark, sf_dir), _A(spark, sf_dir), RADIUS, algorithm="grid")


@query(_with("emb_a", "emb_b") + _ranked("emb_a", "emb_b", 2))
def radius_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius_neighbors(_B(spark, sf_dir), _A(spark, sf_dir), float("inf"), max_neighbors=2)


@query(_with("emb_a", "emb_b", more=f"n1 AS ({_ranked('emb_a', 'emb_b', 1)}), n2 AS ({_ranked('emb_a', 'emb_b', 3, 'd2 <= CAST(' + str(RADIUS * RADIUS) + ' AS DOUBLE)')})") + "SELECT 1 AS search, * FROM n1 UNION ALL SELECT 2, * FROM n2")
def neighbor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index, searched twice."""
    a, index = _A(spark, sf_dir), NeighborIndex(_B(spark, sf_dir))
    one, two = index.knn(a, 1), index.hybrid(a, RADIUS, 3)
    return one.select(F.lit(1).alias("search"), "*").unionByName(two.select(F.lit(2).alias("search"), "*"))


@query(_with("emb_a", "emb_b", more="qa AS MATERIALIZED (SELECT * FROM emb_a WHERE row_id % 5 <> 0), rb AS MATERIALIZED (SELECT * FROM emb_b WHERE row_id % 5 <> 0)") + _ranked("qa", "rb", 3))
def knn_nan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that aren't numbers match nothing."""
    holes = lambda c: PointCloud(c.points.withColumn("x", F.when(F.col("row_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("x"))), c.clouds)
    return knn(holes(_B(spark, sf_dir)), holes(_A(spark, sf_dir)), 3)


@query(_with("prt") + _ranked("prt", "prt", 1))
def knn_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clouds.parts(spark, sf_dir)
    return knn(c, c, 1)


@query(_with("emb_a", "emb_b") + _ranked("emb_a", "emb_b", 64, f"d2 <= CAST({RADIUS * RADIUS} AS DOUBLE)"))
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius_neighbors(_B(spark, sf_dir), _A(spark, sf_dir), RADIUS)


@query(_with("evt") + _ranked("evt", "evt", 8, f"d2 <= CAST({EVT_RADIUS * EVT_RADIUS} AS DOUBLE)"))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clouds.events(spark, sf_dir)
    return hybrid_neighbors(c, c, EVT_RADIUS, 8)


@query(_with("emb_a", "emb_b") + f"SELECT batch_id, query_row, ref_row, d2 FROM ({_pairs('emb_a', 'emb_b')}) WHERE d2 <= CAST({RADIUS * RADIUS} AS DOUBLE)")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pcframe.plans import search

    r, q = search.sides(_B(spark, sf_dir).points, _A(spark, sf_dir).points)
    return search.band_join(r, q, RADIUS).select("batch_id", "query_row", "ref_row", "d2")


@query(_with("emb_a", "emb_b") + f"SELECT batch_id, query_row, ref_row, d2 FROM ({_pairs('emb_a', 'emb_b')})")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pcframe.plans import search

    r, q = search.sides(_B(spark, sf_dir).points, _A(spark, sf_dir).points)
    return search.batch_join(r, q).select("batch_id", "query_row", "ref_row", "d2")


_SLOTS = "n AS ({ranked}), s AS (SELECT batch_id, row_id AS query_row, unnest(range({k})) AS slot FROM emb_a) SELECT s.batch_id, s.query_row, CAST(s.slot AS INTEGER) AS slot, coalesce(ref_row, -1) AS ref_row, ref_row IS NOT NULL AS valid FROM s LEFT JOIN n ON s.batch_id = n.batch_id AND s.query_row = n.query_row AND s.slot = n.rank - 1"


@query(_with("emb_a", "emb_b") + ", " + _SLOTS.format(ranked=_ranked("emb_a", "emb_b", 6, f"d2 <= CAST({RADIUS * RADIUS} AS DOUBLE)"), k=6))
def knn_invalid_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _A(spark, sf_dir)
    return slots(hybrid_neighbors(_B(spark, sf_dir), a, RADIUS, 6), a, 6).select("batch_id", "query_row", "slot", "ref_row", "valid")


@query(_with("emb_a", "emb_b", more="thin AS (SELECT * FROM emb_b WHERE batch_id <> 3)") + ", " + _SLOTS.format(ranked=_ranked("emb_a", "thin", 1), k=1))
def knn_empty_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _A(spark, sf_dir), _B(spark, sf_dir)
    thin = PointCloud(b.points.where("batch_id <> 3"), b.clouds.withColumn("length", F.when(F.col("batch_id") == 3, 0).otherwise(F.col("length"))))
    return slots(knn(thin, a, 1), a, 1).select("batch_id", "query_row", "slot", "ref_row", "valid")


@query(_with("emb_a", "emb_b", more=f"n AS ({_ranked('emb_a', 'emb_b', 1)})") + "SELECT ref_row, count(*) AS n FROM n GROUP BY 1")
def nearest_count_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(_B(spark, sf_dir), _A(spark, sf_dir), 1).groupBy("ref_row").agg(F.count("*").alias("n"))


# -- transforms ---------------------------------------------------------------------------
def _moved_sql(m: list[list[float]], f: Callable[[str], str]) -> str:
    return ", ".join(f"{f(f'CAST({m[i][0]!r} AS DOUBLE) * x + CAST({m[i][1]!r} AS DOUBLE) * y + CAST({m[i][2]!r} AS DOUBLE) * z + CAST({m[i][3]!r} AS DOUBLE)')} AS {c}" for i, c in enumerate("xyz"))


@query(_with("emb_a") + f"SELECT batch_id, row_id, {_moved_sql(pose_to_matrix(POSES[0]), _q6)} FROM emb_a")
def transform_rigid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_A(spark, sf_dir), pose_to_matrix(POSES[0])).points.select("batch_id", "row_id", *[q6(c).alias(c) for c in XYZ])


@query(_with("emb_a") + f"SELECT batch_id, row_id, {_moved_sql(SHIFT, str)} FROM emb_a")
def transform_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(_A(spark, sf_dir), SHIFT).points


@query(_with("emb_a") + "SELECT batch_id, row_id, x + batch_id AS x, y - 2 * batch_id AS y, z AS z FROM emb_a")
def transform_per_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _A(spark, sf_dir)
    b, zero, one = F.col("batch_id").cast("double"), F.lit(0.0), F.lit(1.0)
    rows = [[one, zero, zero, b], [zero, one, zero, -2 * b], [zero, zero, one, zero], [zero, zero, zero, one]]
    return transform(a, a.clouds.select("batch_id", F.array(*[F.array(*r) for r in rows]).alias("m"))).points


@query(_with("emb_a") + f"SELECT row_id, {_moved_sql(SHIFT, str)} FROM emb_a")
def transform_points_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_points(_A(spark, sf_dir).points.drop("batch_id"), SHIFT)


_R0 = pose_to_matrix(POSES[0])


@query(_with("emb_a") + "SELECT batch_id, row_id, " + ", ".join(f"{_q6(repr(_R0[i][2]))} AS n{c}" for i, c in enumerate("xyz")) + " FROM emb_a")
def transform_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _A(spark, sf_dir)
    flat = PointCloud(a.points.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)}), a.clouds)
    return transform(flat, _R0).points.select("batch_id", "row_id", *[q6(c).alias(c) for c in NORMALS])


_POSE_ROWS = ", ".join(f"({i}, " + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in p) + ")" for i, p in enumerate(POSES))
_POSE_SQL = [
    ["cos(rz) * cos(ry)", "cos(rz) * sin(ry) * sin(rx) - sin(rz) * cos(rx)", "cos(rz) * sin(ry) * cos(rx) + sin(rz) * sin(rx)", "tx"],
    ["sin(rz) * cos(ry)", "sin(rz) * sin(ry) * sin(rx) + cos(rz) * cos(rx)", "sin(rz) * sin(ry) * cos(rx) - cos(rz) * sin(rx)", "ty"],
    ["-sin(ry)", "cos(ry) * sin(rx)", "cos(ry) * cos(rx)", "tz"],
    ["0", "0", "0", "1"],
]


@query(f"WITH p(pose_id, rx, ry, rz, tx, ty, tz) AS (VALUES {_POSE_ROWS}) " + " UNION ALL ".join(f"SELECT pose_id, {i} AS i, {j} AS j, {_q6(_POSE_SQL[i][j])} AS m FROM p" for i in range(4) for j in range(4)))
def pose_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([(i, *v) for i, v in enumerate(POSES)], "pose_id int, rx double, ry double, rz double, tx double, ty double, tz double")
    m = p.select("pose_id", F.posexplode(pose_matrix(*[F.col(c) for c in ("rx", "ry", "rz", "tx", "ty", "tz")])).alias("i", "row"))
    return m.select("pose_id", "i", F.posexplode("row").alias("j", "v")).select("pose_id", "i", "j", q6("v").alias("m"))


@query("SELECT * FROM (VALUES (0, CAST(0 AS BIGINT), CAST(250000 AS BIGINT)), (1, CAST(57295780 AS BIGINT), CAST(0 AS BIGINT))) t(pair, degrees_q6, distance_q6)")
def pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    still, turn = pose_to_matrix((0, 0, 0, 0, 0, 0)), pose_to_matrix((0, 0, 1.0, 0, 0, 0))
    rows = spark.createDataFrame([(0, pose_to_matrix((0, 0, 0, 0.25, 0, 0)), still), (1, turn, still)], "pair int, e array<array<double>>, t array<array<double>>")
    angle, shift = pose_error(F.col("e"), F.col("t"))
    return rows.select("pair", q6(angle).alias("degrees_q6"), q6(shift).alias("distance_q6"))


# -- voxels -------------------------------------------------------------------------------
def _vox(size: str) -> str:
    return ", ".join(f"CAST(floor({c} / CAST({size} AS DOUBLE)) AS BIGINT) AS v{c}" for c in "xyz")


@query(_with("li", more=f"v AS (SELECT batch_id, {_vox('10')} FROM li)") + "SELECT batch_id, vx, vy, vz, count(*) AS n FROM v GROUP BY ALL")
def voxelize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxelize(clouds.lineitems(spark, sf_dir), 10.0).voxels.select("batch_id", *VOXEL, F.col("count").alias("n"))


_EVT_V = f"v AS MATERIALIZED (SELECT *, {_vox('4')} FROM evt)"


@query(_with("evt", more=_EVT_V) + "SELECT batch_id, vx, vy, vz, count(*) AS n, sum(x) / count(*) AS cx, sum(y) / count(*) AS cy, sum(z) / count(*) AS cz FROM v GROUP BY batch_id, vx, vy, vz")
def voxelize_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxelize(clouds.events(spark, sf_dir), 4.0).voxels.select("batch_id", *VOXEL, F.col("count").alias("n"), *[F.col(c).alias(f"c{c}") for c in XYZ])


@query(_with("prt", more=f"v AS (SELECT *, {_vox('4')} FROM prt)") + "SELECT batch_id, vx, vy, vz, count(*) AS n, sum(x) / count(*) AS cx, sum(y) / count(*) AS cy, sum(z) / count(*) AS cz FROM v GROUP BY batch_id, vx, vy, vz")
def voxelize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxelize(clouds.parts(spark, sf_dir), 4.0).voxels.select("batch_id", *VOXEL, F.col("count").alias("n"), *[F.col(c).alias(f"c{c}") for c in XYZ])


@query(_with("evt", more=_EVT_V) + "SELECT batch_id, row_id, dense_rank() OVER (ORDER BY batch_id, vx, vy, vz) - 1 AS voxel_id FROM v")
def voxel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxelize(clouds.events(spark, sf_dir), 4.0).point_to_voxel()


def _voxel_reduce(how: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return voxelize(clouds.events(spark, sf_dir), 4.0).reduce("x", reduction=how).select("batch_id", *VOXEL, F.col("x").alias("value"))

    run.__name__ = f"voxel_reduce_{how}"
    query(_with("evt", more=_EVT_V) + f"SELECT batch_id, vx, vy, vz, {sql} AS value FROM v GROUP BY batch_id, vx, vy, vz")(run)


for _how, _sql in {"sum": "sum(x)", "mean": "avg(x)", "min": "min(x)", "max": "max(x)", "first": "arg_min(x, row_id)"}.items():
    _voxel_reduce(_how, _sql)


@query(
    _with("evt", more=_EVT_V + ", c AS (SELECT unnest(range(40)) AS batch_id), n AS (SELECT batch_id, count(*) AS n FROM (SELECT DISTINCT batch_id, vx, vy, vz FROM v) GROUP BY 1), j AS (SELECT c.batch_id, CAST(coalesce(n, 0) AS BIGINT) AS voxels FROM c LEFT JOIN n USING (batch_id))")
    + 'SELECT batch_id, voxels, CAST(sum(voxels) OVER (ORDER BY batch_id) - voxels AS BIGINT) AS "offset" FROM j'
)
def voxel_occupancy_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = clouds.events(spark, sf_dir)
    every = spark.range(40).select(F.col("id").alias("batch_id")).join(e.clouds, "batch_id", "left").na.fill(0, ["length"])
    return voxelize(PointCloud(e.points, every), 4.0).occupancy()


@query("SELECT date_trunc('hour', ts) AS hour, CAST(user_id % 32 AS BIGINT) AS batch_id, CAST(floor(floor(value * 16) / 16 / 4) AS BIGINT) AS vx, count(*) AS n FROM events GROUP BY ALL")
def occupancy_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = t.select("ts", (F.col("user_id") % 32).cast("long").alias("batch_id"), (F.floor(F.col("value") * 16) / 16).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return voxel_occupancy(p, 4.0, time="ts").select(F.col("window.start").alias("hour"), "batch_id", "vx", F.col("count").alias("n"))


# -- the model ----------------------------------------------------------------------------
@query(_with("emb_a") + "SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) - 1 AS pos, x, y, z FROM emb_a")
def padded_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = PointCloud.from_padded(_A(spark, sf_dir).to_padded(-1.0))
    return again.local_rows().select("batch_id", F.col("local_row").alias("pos"), *XYZ)


@query(_with("emb_a") + "SELECT batch_id, CAST(sum(n) OVER (ORDER BY batch_id) - n AS BIGINT) AS \"offset\", n AS length FROM (SELECT batch_id, count(*) AS n FROM emb_a GROUP BY 1)")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _A(spark, sf_dir).offsets()


@query(_with("evt", more="c AS (SELECT unnest(range(40)) AS batch_id), a AS (SELECT batch_id, sum(x) AS s, avg(x) AS m FROM evt GROUP BY 1)") + "SELECT c.batch_id, coalesce(s, 0) AS sum_x, coalesce(m, 'nan'::DOUBLE) AS mean_x FROM c LEFT JOIN a USING (batch_id)")
def segment_sum_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = clouds.events(spark, sf_dir)
    c = PointCloud(e.points, spark.range(40).select(F.col("id").alias("batch_id"), F.lit(0).cast("long").alias("length")))
    return segment_sum(c, "x").withColumnRenamed("x", "sum_x").join(segment_mean(c, "x").withColumnRenamed("x", "mean_x"), "batch_id")


@query(_with("evt") + "SELECT sum(s) AS x FROM (SELECT batch_id, sum(x) AS s FROM evt GROUP BY 1)")
def reduce_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_reduce(segment_sum(clouds.events(spark, sf_dir), "x"), "x", "sum")


# -- normals ------------------------------------------------------------------------------
_COV = ", ".join(f"sum(({a} - m{a}) * ({b} - m{b})) AS c{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")))
_CURVATURE = f"""n AS MATERIALIZED ({_ranked("emb_a", "emb_a", 16)}),
g AS MATERIALIZED (SELECT n.batch_id, n.query_row, r.x, r.y, r.z, avg(r.x) OVER w AS mx, avg(r.y) OVER w AS my, avg(r.z) OVER w AS mz FROM n JOIN emb_a r ON n.ref_row = r.row_id AND n.batch_id = r.batch_id WINDOW w AS (PARTITION BY n.batch_id, n.query_row)),
c AS MATERIALIZED (SELECT batch_id, query_row, {_COV} FROM g GROUP BY 1, 2),
p AS (SELECT *, (cxx + cyy + czz) / 3 AS q, cxy * cxy + cxz * cxz + cyz * cyz AS off FROM c),
s AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * off) / 6) AS t FROM p),
d AS (SELECT *, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * t * t * t) AS h FROM s)
SELECT batch_id, query_row AS row_id, {_q6("(q + 2 * t * cos(acos(greatest(-1::DOUBLE, least(1::DOUBLE, h))) / 3 + 2 * pi() / 3)) / (3 * q)")} AS curvature_q6 FROM d"""


@query(_with("emb_a", more=_CURVATURE))
def normals_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_normals(_A(spark, sf_dir), k=16).select("batch_id", "row_id", q6("curvature").alias("curvature_q6"))


def _grid(spark: SparkSession) -> PointCloud:
    i = F.col("id")
    return PointCloud.from_points(spark.range(400).select(i.alias("row_id"), (i % 20).cast("double").alias("x"), F.floor(i / 20).cast("double").alias("y"), F.lit(0.0).alias("z")))


@query("SELECT i AS row_id, CAST(1000000 AS BIGINT) AS nz_q6, true AS valid FROM range(400) t(i)")
def normals_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_normals(_grid(spark), radius=2.5, k=12).select("row_id", q6(F.abs("nz")).alias("nz_q6"), "valid")


# -- alignment and registration -----------------------------------------------------------
def _matrix_sql(m: list[list[float]], name: str = "emb_a") -> str:
    rows = ", ".join(f"({i}, {j}, CAST({m[i][j]!r} AS DOUBLE))" for i in range(3) for j in range(4))
    return _with(name, more=f"m(i, j, v) AS (VALUES {rows})") + f"SELECT DISTINCT batch_id, i, j, {_q6('v')} AS m_q6 FROM {name}, m"


def _entries(df: DataFrame, column: str = "transform") -> DataFrame:
    rows = df.select("batch_id", F.posexplode(column).alias("i", "row")).where("i < 3")
    return rows.select("batch_id", "i", F.posexplode("row").alias("j", "v")).select("batch_id", "i", "j", q6("v").alias("m_q6"))


@query(_matrix_sql(pose_to_matrix(POSES[0])))
def procrustes_rigid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _A(spark, sf_dir)
    return _entries(procrustes(a, transform(a, pose_to_matrix(POSES[0]))))


@query(_with("emb_a") + "SELECT DISTINCT batch_id, CAST(2500000 AS BIGINT) AS scale_q6 FROM emb_a")
def procrustes_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _A(spark, sf_dir)
    m = [[2.5 * v for v in r[:3]] + [r[3]] for r in pose_to_matrix(POSES[0])[:3]] + [[0.0, 0.0, 0.0, 1.0]]
    return procrustes(a, transform(a, m), estimate_scale=True).select("batch_id", q6("scale").alias("scale_q6"))


@query(_matrix_sql(pose_to_matrix(POSES[1])))
def procrustes_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _A(spark, sf_dir)
    b = transform(a, pose_to_matrix(POSES[1]))
    out = F.col("row_id") % 7 == 0
    spoiled = PointCloud(b.points.withColumn("x", F.when(out, F.col("x") + 100).otherwise(F.col("x"))), b.clouds)
    return _entries(procrustes(a, spoiled, weights=a.points.select("row_id", F.when(out, 0.0).otherwise(1.0).alias("weight"))))


@query(_with("emb_a", "emb_b", more=_NEAREST) + f"SELECT batch_id, CAST(count(*) FILTER (d2 <= CAST({RADIUS * RADIUS} AS DOUBLE)) AS DOUBLE) / count(*) AS fitness, {_q6(f'coalesce(sqrt(sum(d2) FILTER (d2 <= CAST({RADIUS * RADIUS} AS DOUBLE)) / count(*) FILTER (d2 <= CAST({RADIUS * RADIUS} AS DOUBLE))), 0)')} AS rmse_q6 FROM f GROUP BY 1")
def evaluate_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = register.evaluate_registration(_A(spark, sf_dir), _B(spark, sf_dir), RADIUS)
    return got.select("batch_id", "fitness", q6("inlier_rmse").alias("rmse_q6"))


def _posed(spark: SparkSession, sf_dir: str) -> tuple[PointCloud, PointCloud]:
    a = _A(spark, sf_dir)
    return transform(a, rigid_inverse(pose_to_matrix(POSE))), a


def _unit_normals(cloud: PointCloud) -> DataFrame:
    """A fixed unit normal for each row, in all directions."""
    u, v = F.col("row_id") * 0.7548776662, F.col("row_id") * 0.5698402910
    z, t = 2 * (u - F.floor(u)) - 1, 6.283185307179586 * (v - F.floor(v))
    s = F.sqrt(1 - z * z)
    return cloud.points.select("row_id", (s * F.cos(t)).alias("nx"), (s * F.sin(t)).alias("ny"), z.alias("nz"))


@query(_matrix_sql(pose_to_matrix(POSE)))
def icp_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(register.icp(*_posed(spark, sf_dir), 0.2))


@query(_matrix_sql(pose_to_matrix(POSE)))
def icp_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _posed(spark, sf_dir)
    return _entries(register.icp(s, t, 0.2, method="point_to_plane", target_normals=_unit_normals(t)))


_ALIGNED = "SELECT DISTINCT batch_id, true AS converged, CAST(1000000 AS BIGINT) AS fitness_q6 FROM emb_a"


@query(_with("emb_a") + _ALIGNED)
def icp_huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.icp(*_posed(spark, sf_dir), 0.2, robust_kernel="huber", robust_delta=0.05).select("batch_id", "converged", q6("fitness").alias("fitness_q6"))


@query(_with("emb_a") + "SELECT DISTINCT batch_id, batch_id <> 4 AS converged, CAST(CASE WHEN batch_id = 4 THEN 0 ELSE 1 END AS DOUBLE) AS fitness FROM emb_a")
def icp_one_batch_fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _posed(spark, sf_dir)
    off = PointCloud(s.points.withColumn("x", F.when(F.col("batch_id") == 4, F.col("x") + 100).otherwise(F.col("x"))), s.clouds)
    return register.icp(off, t, 0.2).select("batch_id", "converged", "fitness")


@query(_matrix_sql(pose_to_matrix(POSE)))
def icp_point_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan a turn, the state distributed."""
    return _entries(register.icp(*_posed(spark, sf_dir), 0.2, strategy="distributed"))


@query(_matrix_sql(pose_to_matrix(POSE)))
def icp_plane_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _posed(spark, sf_dir)
    return _entries(register.icp(s, t, 0.2, method="point_to_plane", target_normals=_unit_normals(t), strategy="distributed"))


@query(_with("emb_a") + _ALIGNED)
def icp_huber_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _posed(spark, sf_dir)
    return register.icp(s, t, 0.2, robust_kernel="huber", robust_delta=0.05, strategy="distributed", index=NeighborIndex(t)).select("batch_id", "converged", q6("fitness").alias("fitness_q6"))


@query(_with("emb_a") + "SELECT DISTINCT batch_id, false AS converged, 3 AS iterations FROM emb_a")
def icp_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of zero are never met: all turns are taken."""
    return register.icp(*_posed(spark, sf_dir), 0.2, relative_fitness=0.0, relative_rmse=0.0, max_iterations=3).select("batch_id", "converged", "iterations")


@query(_matrix_sql(pose_to_matrix(POSE)))
def icp_given_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(register.icp(*_posed(spark, sf_dir), 0.2, init=pose_to_matrix(POSE), max_iterations=0))


@query(_with("evt", more="l AS (SELECT unnest([2, 4, 8]) AS size), v AS (SELECT DISTINCT size, batch_id, floor(x / size) AS vx, floor(y / size) AS vy, floor(z / size) AS vz FROM evt, l)") + "SELECT CAST(size AS INTEGER) AS size, batch_id, count(*) AS n FROM v GROUP BY ALL")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = multiscale.build_pyramid(clouds.events(spark, sf_dir), [2.0, 4.0, 8.0])
    parts = [level.clouds.select(F.lit(int(s)).alias("size"), "batch_id", F.col("length").alias("n")) for level, s in zip(p.levels, p.voxel_sizes)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_with("evt", more="l AS (SELECT unnest([4, 8]) AS size)") + "SELECT CAST(size AS INTEGER) AS size, batch_id, CAST(600000 AS BIGINT) AS nx_q6, CAST(800000 AS BIGINT) AS nz_q6 FROM evt, l GROUP BY ALL")
def pyramid_reduced_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = clouds.events(spark, sf_dir)
    flat = PointCloud(e.points.withColumns({"nx": F.lit(1.5), "ny": F.lit(0.0), "nz": F.lit(2.0)}), e.clouds)
    p = multiscale.build_pyramid(flat, [4.0, 8.0], normal_mode="reduce")
    parts = [level.points.select(F.lit(int(s)).alias("size"), "batch_id", q6("nx").alias("nx_q6"), q6("nz").alias("nz_q6")).distinct() for level, s in zip(p.levels, p.voxel_sizes)]
    return parts[0].unionByName(parts[1])


@query(_matrix_sql(pose_to_matrix(POSE)))
def multiscale_icp(spark: SparkSession, sf_dir: str) -> DataFrame:
    scales = [multiscale.ICPScale(2.0**-20, 0.4, 10), multiscale.ICPScale(2.0**-21, 0.2, 20)]
    return _entries(multiscale.multiscale_icp(*_posed(spark, sf_dir), scales))


@query(_matrix_sql(pose_to_matrix(POSE)))
def multiscale_icp_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point to plane from pyramids, the target's with reduced normals."""
    s, t = _posed(spark, sf_dir)
    scales = [multiscale.ICPScale(2.0**-20, 0.4, 10), multiscale.ICPScale(2.0**-21, 0.2, 20)]
    sizes = [x.voxel_size for x in scales]
    with_n = PointCloud(t.points.join(_unit_normals(t), "row_id"), t.clouds)
    return _entries(multiscale.multiscale_icp(multiscale.build_pyramid(s, sizes), multiscale.build_pyramid(with_n, sizes, normal_mode="reduce"), scales, method="point_to_plane"))


# -- gradients ----------------------------------------------------------------------------
@query(_with("emb_a", "emb_b", more=f"n AS ({_ranked('emb_a', 'emb_b', 3)})") + "SELECT q.batch_id, q.row_id, sum(2 * (q.x - r.x)) AS gx, sum(2 * (q.y - r.y)) AS gy, sum(2 * (q.z - r.z)) AS gz FROM n JOIN emb_a q ON n.query_row = q.row_id JOIN emb_b r ON n.ref_row = r.row_id GROUP BY 1, 2")
def grad_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradients.knn_gradient(_B(spark, sf_dir), _A(spark, sf_dir), 3)[0]


@query(_with("emb_a", "emb_b", more=f"n AS ({_ranked('emb_a', 'emb_b', 3)}), g AS (SELECT r.row_id, sum(-2 * (q.x - r.x)) AS gx, sum(-2 * (q.y - r.y)) AS gy, sum(-2 * (q.z - r.z)) AS gz FROM n JOIN emb_a q ON n.query_row = q.row_id JOIN emb_b r ON n.ref_row = r.row_id GROUP BY 1)") + "SELECT b.batch_id, b.row_id, coalesce(gx, 0) AS gx, coalesce(gy, 0) AS gy, coalesce(gz, 0) AS gz FROM emb_b b LEFT JOIN g USING (row_id)")
def grad_knn_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradients.knn_gradient(_B(spark, sf_dir), _A(spark, sf_dir), 3)[1]


@query(_with("evt", more=_EVT_V) + "SELECT batch_id, row_id, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY batch_id, vx, vy, vz) AS g FROM v")
def grad_voxel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradients.voxel_gradient(voxelize(clouds.events(spark, sf_dir), 4.0))


_NEAR1 = f"n AS MATERIALIZED ({_ranked('emb_a', 'emb_b', 1)}), m AS MATERIALIZED ({_ranked('emb_b', 'emb_a', 1)}), c AS (SELECT batch_id, count(*) AS n FROM emb_a GROUP BY 1)"


@query(
    _with("emb_a", "emb_b", more=_NEAR1 + ", f AS (SELECT q.batch_id, q.row_id, 2 * (q.x - r.x) AS gx, 2 * (q.y - r.y) AS gy, 2 * (q.z - r.z) AS gz FROM n JOIN emb_a q ON n.query_row = q.row_id JOIN emb_b r ON n.ref_row = r.row_id), b AS (SELECT r.row_id, sum(-2 * (q.x - r.x)) AS gx, sum(-2 * (q.y - r.y)) AS gy, sum(-2 * (q.z - r.z)) AS gz FROM m JOIN emb_b q ON m.query_row = q.row_id JOIN emb_a r ON m.ref_row = r.row_id GROUP BY 1)")
    + "SELECT f.batch_id, f.row_id, " + ", ".join(f"{_q6(f'f.g{x} / (2 * n) + coalesce(b.g{x}, 0) / (2 * n)')} AS g{x}_q6" for x in "xyz") + " FROM f JOIN c USING (batch_id) LEFT JOIN b ON b.row_id = f.row_id"
)
def grad_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gradients.chamfer_gradient(_A(spark, sf_dir), _B(spark, sf_dir))
    return g.select("batch_id", "row_id", *[q6(c).alias(f"{c}_q6") for c in ("gx", "gy", "gz")])


@query(_with("emb_a") + "SELECT batch_id, row_id, " + ", ".join(f"{_q6(' + '.join(f'CAST({_R0[i][j]!r} AS DOUBLE) * {c}' for i, c in enumerate('xyz')))} AS g{'xyz'[j]}_q6" for j in range(3)) + " FROM emb_a")
def grad_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of half the squared length of moved points, whose gradient there is the point itself."""
    g = _A(spark, sf_dir).points.select("batch_id", "row_id", *[F.col(c).alias(f"g{c}") for c in XYZ])
    return gradients.transform_gradient(g, _R0).select("batch_id", "row_id", *[q6(c).alias(f"{c}_q6") for c in ("gx", "gy", "gz")])


# -- sources, types and aligned values -------------------------------------------------------
def _written(spark: SparkSession, rows: DataFrame, what: str) -> str:
    """A folder of one text file of the rows' lines, in order."""
    import tempfile
    import uuid

    top = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="pcframe-")
    path = f"{top}/{what}-{uuid.uuid4().hex}"
    rows.coalesce(1).write.text(path)
    return path


@query(_with("emb_a") + "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM emb_a")
def ply_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ASCII PLY file of a table's points, read again."""
    p = _A(spark, sf_dir).points
    head = "\n".join(["ply", "format ascii 1.0", f"element vertex {p.count()}", *[f"property float {c}" for c in XYZ], "end_header"])
    lines = p.orderBy("row_id").select(F.concat_ws(" ", *XYZ).alias("value"))
    first = spark.createDataFrame([(head,)], "value string")
    return read_ply(spark, _written(spark, first.coalesce(1).unionByName(lines.coalesce(1)), "ply")).select("row", *XYZ)


@query("SELECT i, j, v FROM (VALUES " + ", ".join(f"({i}, {j}, CAST({SHIFT[i][j]!r} AS DOUBLE))" for i in range(4) for j in range(4)) + ") t(i, j, v)")
def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "# a pose\n\n" + "\n".join("  ".join(map(repr, r)) + "  # row" for r in SHIFT)
    m = read_matrix(spark, _written(spark, spark.createDataFrame([(text,)], "value string"), "matrix"))
    return m.select(F.posexplode("m").alias("i", "row")).select("i", F.posexplode("row").alias("j", "v"))


@query("SELECT CAST(b AS BIGINT) AS batch_id, CAST(b * 3 + n AS BIGINT) AS row_id, CAST(b + n AS DOUBLE) AS x, CAST(b * n AS DOUBLE) / 2 AS y, CAST(n AS DOUBLE) / 4 AS z FROM range(2) t(b), range(3) u(n)")
def dense_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_point_cloud(PointCloud.from_dense(spark, [[[float(b + n), b * n / 2, n / 4] for n in range(3)] for b in range(2)])).points


@query(_with("emb_a", more="s AS (SELECT min(row_id) AS lo FROM emb_a)") + "SELECT CASE WHEN p < 100 THEN 0 WHEN p < 150 THEN 2 ELSE 3 END::BIGINT AS batch_id, p AS row_id FROM (SELECT row_number() OVER (ORDER BY row_id) - 1 AS p FROM emb_a)")
def offsets_to_batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packed table cut by offsets; the second entry is empty."""
    p = _A(spark, sf_dir).points.drop("batch_id")
    rows = numbered(p.withColumnRenamed("row_id", "old"), ["old"], "row_id").drop("old")
    return PointCloud.from_offsets(rows, [0, 100, 100, 150, rows.count()]).batch_ids().select("batch_id", "row_id")


@query(_with("emb_a") + "SELECT batch_id, row_id, x, CAST(row_id % 7 AS BIGINT) AS v FROM emb_a")
def aligned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _A(spark, sf_dir)
    return a.with_values(a.points.select("row_id", (F.col("row_id") % 7).alias("v"))).points.select("batch_id", "row_id", "x", "v")


@query(_with("evt", more="f AS (SELECT batch_id, row_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM evt)") + "SELECT batch_id, CAST(floor(x / CAST(0.7 AS FLOAT)) AS BIGINT) AS vx, CAST(floor(y / CAST(0.7 AS FLOAT)) AS BIGINT) AS vy, CAST(floor(z / CAST(0.7 AS FLOAT)) AS BIGINT) AS vz, count(*) AS n FROM f GROUP BY ALL")
def voxelize_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """float32 clouds divide in float32."""
    return voxelize(clouds.events(spark, sf_dir).to("float"), 0.7).voxels.select("batch_id", *VOXEL, F.col("count").alias("n"))


@query(_with("emb_a", "emb_b") + _ranked("emb_a", "emb_b", 2))
def knn_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dyadic coordinates are float32 numbers, so neighbors are the same."""
    return knn(_B(spark, sf_dir).to("float"), _A(spark, sf_dir).to("float"), 2)


@query(_with("emb_a") + "SELECT (SELECT count(*) FROM emb_a WHERE isnan(x) OR isinf(x)) > 0 AS any_odd, true AS valid")
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a cloud and of a pair: they raise, or the cloud is as it says."""
    a = _A(spark, sf_dir).validate()
    check_pair(a, _B(spark, sf_dir), equal_lengths=True)
    return a.points.agg(F.bool_or(F.isnan("x") | (F.abs("x") == float("inf"))).alias("any_odd")).withColumn("valid", F.lit(True))
