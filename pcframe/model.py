"""The data model: a ragged batch of 3-D point clouds as two DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
NORMALS = ("nx", "ny", "nz")
KEYS = ("batch_id", "row_id")


def _check_types(points: DataFrame) -> None:
    kinds = dict(points.dtypes)
    for c in KEYS:
        if c not in kinds:
            raise TypeError(f"points need {', '.join(KEYS + XYZ)}; for padded arrays use from_padded")
    for c in XYZ + tuple(n for n in NORMALS if n in kinds):
        if kinds.get(c) not in ("float", "double"):
            what = "normals" if c in NORMALS else "points"
            raise TypeError(f"{what}: {c} must be float32 or float64, not {kinds.get(c)}")
    if len(set(NORMALS) & set(kinds)) not in (0, 3):
        raise ValueError("normals need all of nx, ny, nz")
    if len({kinds[c] for c in XYZ}) != 1:
        raise TypeError("x, y, z must have one type, float32 or float64")


@dataclass(frozen=True)
class PointCloud:
    """points: batch_id, row_id, x, y, z[, nx, ny, nz][, other columns], a row a point;
    clouds: batch_id, length, a row an entry of the batch, empty ones too.

    DataFrames are immutable, so clouds share them freely. row_id orders points and is unique
    in the whole batch; it need not be dense.
    """

    points: DataFrame
    clouds: DataFrame

    def __post_init__(self) -> None:
        _check_types(self.points)

    # -- constructors ---------------------------------------------------------------------
    @classmethod
    def packed(cls, points: DataFrame, clouds: DataFrame | None = None) -> PointCloud:
        """From rows with batch_id; without clouds, entries without points are unknown."""
        if clouds is None:
            clouds = points.groupBy("batch_id").agg(F.count("*").alias("length"))
        return cls(points, clouds)

    @classmethod
    def from_points(cls, points: DataFrame) -> PointCloud:
        """A batch of one cloud, which may be empty."""
        one = points.withColumn("batch_id", F.lit(0).cast("long"))
        return cls(one, one.agg(F.count("*").alias("length")).select(F.lit(0).cast("long").alias("batch_id"), "length"))

    @classmethod
    def from_offsets(cls, points: DataFrame, offsets: Sequence[int]) -> PointCloud:
        """From one packed table whose row_id is 0..P-1 and the offsets (B+1) of its entries."""
        o = [int(v) for v in offsets]
        if len(o) < 2 or o[0] != 0 or any(b < a for a, b in zip(o, o[1:])) or o[-1] != points.count():
            raise ValueError("offsets must start at 0, not decrease, and end at the number of points")
        spark = points.sparkSession
        spans = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(o, o[1:]))], "batch_id long, lo long, hi long")
        at = points.drop("batch_id")
        ddl = "batch_id long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema)
        place, edges, names = at.columns.index("row_id"), np.asarray(o), ["batch_id", *at.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:  # a binary search a row; empty entries begin where the next one does
                entry = np.searchsorted(edges, b.column(place).to_numpy(), "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int64()), *b.columns], names)

        rows = at.where((F.col("row_id") >= 0) & (F.col("row_id") < o[-1])).mapInArrow(run, ddl)
        return cls(rows, spans.select("batch_id", (F.col("hi") - F.col("lo")).alias("length")))

    @classmethod
    def from_padded(cls, padded: DataFrame) -> PointCloud:
        """From a row an entry: batch_id, points (array of [x, y, z]), length[, normals, features
        (arrays alongside)]. Rows at or beyond length are padding, whatever they hold."""
        kinds = dict(padded.dtypes)
        if kinds.get("points") not in ("array<array<double>>", "array<array<float>>"):
            raise TypeError("from_padded: points must be arrays of float32 or float64 triples")
        if kinds.get("length") not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError("from_padded: length must be integral")
        widest = F.max(F.size("points")).over(Window.partitionBy("batch_id"))
        bad = padded.select(((F.col("length") < 0) | (F.col("length") > widest)).alias("bad")).where("bad")
        if not bad.isEmpty():
            raise ValueError("from_padded: lengths must lie between 0 and the padded size")
        sides = [c for c in ("normals", "features") if c in kinds]
        rows = padded.select("batch_id", F.col("length").cast("long").alias("length"), *sides, F.posexplode("points").alias("local", "p")).where("local < length")
        clouds = padded.select("batch_id", F.col("length").cast("long").alias("length"))
        offsets = clouds.withColumn("lo", _before("length"))  # a row an entry
        rows = rows.join(offsets.select("batch_id", "lo"), "batch_id")
        columns = [F.col("batch_id").cast("long"), (F.col("lo") + F.col("local")).alias("row_id"), *[F.col("p")[i].alias(c) for i, c in enumerate(XYZ)]]
        if "normals" in kinds:
            columns += [F.col("normals")[F.col("local")][i].alias(c) for i, c in enumerate(NORMALS)]
        if "features" in kinds:
            columns.append(F.col("features")[F.col("local")].alias("features"))
        return cls(rows.select(*columns), clouds)

    @classmethod
    def from_dense(cls, spark: SparkSession, values) -> PointCloud:
        """From nested sequences or an array: (N, 3) is one cloud, (B, N, 3) B equal ones."""
        a = np.asarray(values)
        if a.dtype not in (np.float32, np.float64):
            raise TypeError("points must be float32 or float64")
        if a.ndim == 2 and a.shape[1] == 3:
            a = a[None]
        if a.ndim != 3 or a.shape[2] != 3:
            raise ValueError("expected shape (N, 3) or (B, N, 3); for ragged arrays use from_padded")
        b, n, _ = a.shape
        kind = "float" if a.dtype == np.float32 else "double"
        rows = [(i, i * n + j, *map(float, a[i, j])) for i in range(b) for j in range(n)]
        points = spark.createDataFrame(rows, f"batch_id long, row_id long, x {kind}, y {kind}, z {kind}")
        return cls(points, spark.createDataFrame([(i, n) for i in range(b)], "batch_id long, length long"))

    # -- metadata -------------------------------------------------------------------------
    @property
    def batch_size(self) -> int:
        return self.clouds.count()

    @property
    def lengths(self) -> DataFrame:
        return self.clouds

    @property
    def dtype(self) -> str:
        return dict(self.points.dtypes)["x"]

    @property
    def has_normals(self) -> bool:
        return set(NORMALS) <= set(self.points.columns)

    @property
    def features(self) -> list[str]:
        return [c for c in self.points.columns if c not in KEYS + XYZ + NORMALS]

    def offsets(self) -> DataFrame:
        """batch_id, offset (points in the entries before), length."""
        return self.clouds.select("batch_id", _before("length").alias("offset"), "length")

    def batch_ids(self) -> DataFrame:
        return self.points.select("row_id", "batch_id")

    def local_rows(self, whole: bool = True) -> DataFrame:
        """points with local_row, a point's place in its own cloud from 0. whole: entries are small
        enough for a task to sort each; otherwise rows are numbered in all and entries' first
        numbers taken off."""
        if not whole:
            from pcframe.plans.order import numbered

            rows = numbered(self.points, ["batch_id", "row_id"], "__n")
            first = rows.groupBy("batch_id").agg(F.min("__n").alias("__first"))
            return rows.join(first, "batch_id").withColumn("local_row", F.col("__n") - F.col("__first")).drop("__n", "__first")
        return self.points.withColumn("local_row", (F.row_number().over(Window.partitionBy("batch_id").orderBy("row_id")) - 1).cast("long"))

    # -- conversions ----------------------------------------------------------------------
    def to(self, dtype: str) -> PointCloud:
        """Cast the geometry to 'float' or 'double'; other columns keep their types."""
        if dtype not in ("float", "double"):
            raise TypeError("dtype must be float32 or float64: 'float' or 'double'")
        cast = {c: F.col(c).cast(dtype) for c in XYZ + (NORMALS if self.has_normals else ())}
        return replace(self, points=self.points.withColumns(cast))

    def clone(self) -> PointCloud:
        """DataFrames can't be changed in place, so a clone shares them."""
        return replace(self)

    def check_aligned(self, values: DataFrame, name: str) -> list[str]:
        """Raise ValueError unless values have one row for each point; the columns to join by."""
        on = ["batch_id", "row_id"] if "batch_id" in values.columns else ["row_id"]
        own, other = self.points.select(*on, F.lit(1).alias("__p")), values.select(*on, F.lit(1).alias("__v"))
        both = own.join(other, on, "full").groupBy(*on).agg(F.count("__p").alias("p"), F.count("__v").alias("v"))
        if not both.where("p <> 1 or v <> 1").isEmpty():
            raise ValueError(f"{name} must have one row for each point")
        return on

    def with_values(self, values: DataFrame) -> PointCloud:
        """Point-aligned side values, joined by row_id (and batch_id, if they have it); each point
        needs its row (one job checks)."""
        return replace(self, points=self.points.join(values, self.check_aligned(values, "values")))

    def to_padded(self, pad_value: float = 0.0) -> DataFrame:
        """batch_id, points (array of [x, y, z], all of the longest entry's length), length."""
        p = self.points.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", *XYZ))), lambda r: F.array(*[r[c].cast("double") for c in XYZ])).alias("points"))
        top = self.clouds.agg(F.coalesce(F.max("length"), F.lit(0)).alias("top"))
        rows = self.clouds.join(p, "batch_id", "left").join(F.broadcast(top))
        own = F.coalesce("points", F.array().cast("array<array<double>>"))
        pad = F.array_repeat(F.array(*[F.lit(float(pad_value))] * 3), (F.col("top") - F.size(own)).cast("int"))
        return rows.select("batch_id", F.concat(own, pad).alias("points"), "length")

    # -- checks ---------------------------------------------------------------------------
    def validate(self) -> PointCloud:
        """Check the data, in one aggregate job: finite points, and clouds that match points."""
        n = self.points.groupBy("batch_id").agg(F.count("*").alias("n"), F.max(sum((F.col(c) - F.col(c) != 0).cast("int") for c in XYZ)).alias("odd"))
        both = self.clouds.join(n, "batch_id", "full").agg(
            F.coalesce(F.bool_or(~F.col("length").eqNullSafe(F.coalesce("n", F.lit(0)))), F.lit(False)).alias("bad"), F.coalesce(F.max("odd"), F.lit(0)).alias("odd")
        ).first()
        if both["bad"]:
            raise ValueError("offsets: the lengths of clouds don't match their points")
        if both["odd"]:
            raise ValueError("points must be finite")
        return self


def _before(column: str):
    """Running sum of the entries before, over the (small) table of clouds."""
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0)).cast("long")


def as_point_cloud(value) -> PointCloud:
    """PointCloud as it is; a DataFrame with batch_id as a packed batch, without as one cloud."""
    if isinstance(value, PointCloud):
        return value
    if isinstance(value, DataFrame):
        return PointCloud.packed(value) if "batch_id" in value.columns else PointCloud.from_points(value)
    raise TypeError("expected a PointCloud or a DataFrame; for padded arrays use from_padded")


def check_pair(source: PointCloud, target: PointCloud, equal_lengths: bool = False, non_empty: bool = True) -> int:
    """Both over the same entries and of one type; optionally equal lengths, no empty entry.
    Returns the points of the largest entry of either."""
    if source.dtype != target.dtype:
        raise TypeError("source and target must have the same dtype, float32 or float64")
    a, b = source.clouds.select("batch_id", F.col("length").alias("la")), target.clouds.select("batch_id", F.col("length").alias("lb"))
    r = a.join(b, "batch_id", "full").agg(
        F.bool_or(F.col("la").isNull() | F.col("lb").isNull()).alias("size"), F.bool_or(F.col("la") != F.col("lb")).alias("unequal"), F.bool_or((F.col("la") == 0) | (F.col("lb") == 0)).alias("empty"), F.count("*").alias("n"), F.max(F.greatest("la", "lb")).alias("largest")
    ).first()
    if r["size"]:
        raise ValueError("source and target must have the same batch size")
    if equal_lengths and r["unequal"]:
        raise ValueError("source and target must have equal lengths")
    if non_empty and (r["empty"] or not r["n"]):
        raise ValueError("source and target must be non-empty")
    return r["largest"] or 0


