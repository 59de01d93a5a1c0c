"""Clouds from the generated tables: dyadic coordinates, whose sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pcframe.model import PointCloud


def _dyadic(c: Column, scale: int) -> Column:
    return F.floor(c.cast("double") * scale) / F.lit(float(scale))


def _cloud(spark: SparkSession, sf_dir: str, table: str, batch: Column, row: Column, x: Column, y: Column, z: Column, *extra: Column) -> PointCloud:
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return PointCloud.packed(t.select(batch.cast("long").alias("batch_id"), row.cast("long").alias("row_id"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), *extra))


def embeddings(spark: SparkSession, sf_dir: str, first: int) -> PointCloud:
    """Three components of each embedding from the first on; an entry a label."""
    e = F.col("embedding")
    return _cloud(spark, sf_dir, "embeddings", F.col("label"), F.col("vec_id"), *[_dyadic(e[first + i], 1024) for i in range(3)])


def events(spark: SparkSession, sf_dir: str) -> PointCloud:
    """Value, hour and day of each event; 32 entries by user."""
    return _cloud(spark, sf_dir, "events", F.col("user_id") % 32, F.col("event_id"), _dyadic(F.col("value"), 16), F.hour("ts"), F.dayofmonth("ts"))


def parts(spark: SparkSession, sf_dir: str) -> PointCloud:
    k = F.col("p_partkey")
    return _cloud(spark, sf_dir, "part", k % 32, k, F.col("p_size"), (k * 37) % 1009 / F.lit(16.0), (k * 53) % 997 / F.lit(16.0))


def lineitems(spark: SparkSession, sf_dir: str) -> PointCloud:
    """Quantity, price and discount; an entry a return flag. Rows have no key of their own: for
    order-free results only."""
    flag = F.ascii("l_returnflag")
    return _cloud(spark, sf_dir, "lineitem", flag, F.lit(0), F.col("l_quantity"), F.col("l_extendedprice").cast("double") / F.lit(100.0), F.round(F.col("l_discount").cast("double") * F.lit(100.0)))


#: The same clouds in DuckDB's SQL, as common table expressions.
SQL = {
    "emb_a": "SELECT CAST(label AS BIGINT) AS batch_id, vec_id AS row_id, floor(CAST(embedding[1] AS DOUBLE) * 1024) / 1024 AS x, floor(CAST(embedding[2] AS DOUBLE) * 1024) / 1024 AS y, floor(CAST(embedding[3] AS DOUBLE) * 1024) / 1024 AS z FROM embeddings",
    "emb_b": "SELECT CAST(label AS BIGINT) AS batch_id, vec_id AS row_id, floor(CAST(embedding[4] AS DOUBLE) * 1024) / 1024 AS x, floor(CAST(embedding[5] AS DOUBLE) * 1024) / 1024 AS y, floor(CAST(embedding[6] AS DOUBLE) * 1024) / 1024 AS z FROM embeddings",
    "evt": "SELECT CAST(user_id % 32 AS BIGINT) AS batch_id, CAST(event_id AS BIGINT) AS row_id, floor(CAST(value AS DOUBLE) * 16) / 16 AS x, CAST(hour(ts) AS DOUBLE) AS y, CAST(day(ts) AS DOUBLE) AS z FROM events",
    "prt": "SELECT CAST(p_partkey % 32 AS BIGINT) AS batch_id, CAST(p_partkey AS BIGINT) AS row_id, CAST(p_size AS DOUBLE) AS x, CAST((p_partkey * 37) % 1009 AS DOUBLE) / 16 AS y, CAST((p_partkey * 53) % 997 AS DOUBLE) / 16 AS z FROM part",
    "li": "SELECT CAST(ascii(l_returnflag) AS BIGINT) AS batch_id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / CAST(100 AS DOUBLE) AS y, round(CAST(l_discount AS DOUBLE) * CAST(100 AS DOUBLE)) AS z FROM lineitem",
}
