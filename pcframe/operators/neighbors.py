"""Neighbor search: k nearest, radius and hybrid, isolated by batch entry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.model import XYZ, PointCloud, as_point_cloud
from pcframe.plans import search

ALGORITHMS = ("auto", "local", "batch", "grid", "blocks")


class NeighborIndex:
    """A reference cloud to search in, as often as wanted.

    algorithm: 'blocks' (and 'auto') keys the reference by blocks of bounded size, an entry a
    block unless it is larger; 'local' takes each entry whole, whatever its size; 'batch' (whole
    entries) and 'grid' (cells of the radius, which it needs) ask for the same answers and are
    searched in blocks too: all pairs of an entry, or of the cells that a radius reaches, grow with
    the square of their points. The keyed reference of 'blocks' is made at the first search and, if
    an entry had to be cut, kept in the shared folder for the next ones."""

    def __init__(self, reference, *, algorithm: str = "auto"):
        if algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {ALGORITHMS}; a bvh has no counterpart in a distributed plan")
        self.reference: PointCloud = as_point_cloud(reference)
        self.algorithm = algorithm
        self._kept: tuple[DataFrame, search.Blocks] | None = None

    def blocks(self) -> tuple[DataFrame, search.Blocks]:
        """The reference with all its columns, keyed by batch_id and block, and how it is cut."""
        if self._kept is None:
            points = self.reference.points
            carry = tuple(c for c in points.columns if c not in ("batch_id", "row_id", *XYZ))
            r, _ = search.sides(points, points, carry)
            dealt, blocks = search.indexed(r, self.reference.clouds)
            self._kept = search.keep(dealt) if blocks.trees else dealt, blocks
        return self._kept

    def _search(self, queries, k: int, radius: float | None, carry: tuple[str, ...] = ()) -> DataFrame:
        if not isinstance(k, int) or not 1 <= k <= search.MAX_K:
            raise ValueError("k must be in [1, 64]")
        if radius is not None and not radius > 0:
            raise ValueError("radius must be positive")
        if radius is not None and math.isinf(radius):
            radius = None
        queries = as_point_cloud(queries)
        if queries.dtype != self.reference.dtype:
            raise TypeError("queries and reference must have the same dtype, float32 or float64")
        r, q = search.sides(self.reference.points, queries.points, carry)
        if self.algorithm == "grid" and radius is None:
            raise ValueError("algorithm 'grid' needs a finite radius")
        if self.algorithm == "local":
            return search.local_knn(r, q, k, radius)
        dealt, blocks = self.blocks()
        wanted = ["batch_id", "block", "ref_row", *[f"r{c}" for c in XYZ], *[f"r_{c}" for c in carry]]
        # columns of its own, where queries and reference are one cloud
        return search.block_knn(dealt.select(*[F.col(c).alias(c) for c in wanted]), blocks, q, k, radius)

    def _long(self, found: DataFrame) -> DataFrame:
        return found.select("batch_id", "query_row", "rank", "ref_row", "d2")

    def knn(self, queries, k: int) -> DataFrame:
        """batch_id, query_row, rank (from 1, by d2 then ref_row), ref_row, d2. Slots that a query
        can't fill have no rows; see slots() for the padded form."""
        return self._long(self._search(queries, k, None))

    def radius(self, queries, radius: float, *, max_neighbors: int = search.MAX_K) -> DataFrame:
        """Neighbors with d2 <= radius**2, the nearest max_neighbors of them."""
        return self._long(self._search(queries, max_neighbors, radius))

    def hybrid(self, queries, radius: float, k: int) -> DataFrame:
        """The k nearest within the radius."""
        return self._long(self._search(queries, k, radius))


def knn(reference, queries, k: int, *, algorithm: str = "auto") -> DataFrame:
    return NeighborIndex(reference, algorithm=algorithm).knn(queries, k)


def radius_neighbors(reference, queries, radius: float, *, max_neighbors: int = search.MAX_K, algorithm: str = "auto") -> DataFrame:
    return NeighborIndex(reference, algorithm=algorithm).radius(queries, radius, max_neighbors=max_neighbors)


def hybrid_neighbors(reference, queries, radius: float, k: int, *, algorithm: str = "auto") -> DataFrame:
    return NeighborIndex(reference, algorithm=algorithm).hybrid(queries, radius, k)


def slots(neighbors: DataFrame, queries, k: int) -> DataFrame:
    """The padded form: batch_id, query_row, slot (from 0), ref_row (-1), d2 (inf), valid, with
    k rows for every query."""
    q = as_point_cloud(queries).points.select("batch_id", F.col("row_id").alias("query_row"))
    every = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    own = neighbors.select("batch_id", "query_row", (F.col("rank") - 1).cast("int").alias("slot"), "ref_row", "d2")
    out = every.join(own, ["batch_id", "query_row", "slot"], "left")
    return out.select("batch_id", "query_row", "slot", F.coalesce("ref_row", F.lit(-1)).cast("long").alias("ref_row"), F.coalesce("d2", F.lit(float("inf"))).alias("d2"), F.col("ref_row").isNotNull().alias("valid"))
