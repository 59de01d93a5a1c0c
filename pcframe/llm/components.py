"""Connected components of a link table, distributed: alternating star contraction with a
union-find pass over each partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.llm.common import cut, discard


class UnionFind(dict):
    """Least member as the root, with path halving."""

    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links become stars about their least members: no more rows than before."""
    for batch in batches:
        uf = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            uf.union(a, b)
        pairs = [(x, r) for x in list(uf) if (r := uf.find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (its least reachable node, itself included) for every node of a link.

    links: two long columns; repeated links, either direction and loops are allowed, nulls are
    left out. Nodes without a link are not in the result. Each round is a large-star and a
    small-star step over tables in the shared folder, until nothing changes.
    """
    spark = links.sparkSession
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.mapInArrow(_contract, "u long, v long").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # large star: the greater neighbours of u go to u's least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's lesser neighbours and u itself go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, cut(small.mapInArrow(_contract, "u long, v long").distinct(), "stars")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        roots_free = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        if tuple(now) == before or (now[0] == now[2] and roots_free):
            break
        before = tuple(now)
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
