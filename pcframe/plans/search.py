"""Plans of the neighbor search: batch join, grid band join, and blocks of points in numpy, of
which a small entry is one.

All give rows batch_id, query_row, ref_row, d2 (and the carried columns of both sides);
d2 is (qx-x)*(qx-x) + (qy-y)*(qy-y) + (qz-z)*(qz-z), associated in that order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcframe.model import XYZ

#: Cells are a little larger than the radius, so that rounding at a cell's edge can't lose a pair.
_SLACK = 1 + 1e-9
MAX_K = 64
#: Points of an entry up to which it is one block, searched in one task; larger ones are cut.
LOCAL_POINTS = 16_384
#: Points of an entry up to which a task may hold it whole for many turns or for a window.
WHOLE_POINTS = 131_072
#: Points of a leaf of the search inside a block.
LEAF = 128
#: Points a side of a tile of all pairs, and tasks that tiles are dealt to at most.
TILE, MOST_TASKS = 4_096, 10_000
#: Points of large entries that are sampled to the driver to cut them (32 bytes each), and of
#: these how many a block needs at least: so many blocks there are at most.
SAMPLE, LEAST_SAMPLE = 200_000, 32


def sides(reference: DataFrame, queries: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    r = reference.select("batch_id", F.col("row_id").alias("ref_row"), *[F.col(c).cast("double").alias(f"r{c}") for c in XYZ], *[F.col(c).alias(f"r_{c}") for c in carry])
    q = queries.select("batch_id", F.col("row_id").alias("query_row"), *[F.col(c).cast("double").alias(f"q{c}") for c in XYZ])
    return r, q


def distance2() -> Column:
    x, y, z = ((F.col(f"q{c}") - F.col(f"r{c}")) for c in XYZ)
    return x * x + y * y + z * z


def batch_join(r: DataFrame, q: DataFrame) -> DataFrame:
    """All pairs of a batch entry, in tiles of about TILE queries and as many points of the
    reference: tasks are as many as tiles, and hold a few tiles' points. The pairs themselves grow
    with the square of an entry's points, which no plan changes."""
    count = lambda side, name: side.groupBy("batch_id").agg(F.ceil(F.count("*") / TILE).alias(name))
    cuts = count(q, "__qs").join(count(r, "__rs"), "batch_id")
    tasks = min(int(cuts.agg(F.sum(F.col("__qs") * F.col("__rs"))).first()[0] or 1), MOST_TASKS)

    def tiled(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one of its entry's strips, once for each strip of the other side."""
        at = F.pmod(F.xxhash64(*[c for c in side.columns if c != "batch_id"]), F.col(f"__{own}s"))
        rows = side.join(cuts, "batch_id").select(*side.columns, at.alias(f"__{own}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__{other}s") - 1)).alias(f"__{other}"))
        return rows.repartition(tasks, "batch_id", "__q", "__r").hint("merge")  # a number of its own: tasks aren't joined by the size of what they read

    pairs = tiled(q, "q", "r").join(tiled(r, "r", "q"), ["batch_id", "__q", "__r"]).drop("__q", "__r")
    return pairs.withColumn("d2", distance2()).where(~F.isnan("d2"))


def _cell(side: str, size: float, c: str) -> Column:
    return F.floor(F.col(f"{side}{c}") / F.lit(size)).cast("long")


def band_join(r: DataFrame, q: DataFrame, radius: float) -> DataFrame:
    """Pairs within the radius: queries visit the 27 cells around theirs, an equi-join meets the
    reference there, and the exact distance decides."""
    size = radius * _SLACK
    around = [F.array(*[(_cell("q", size, c) + d) for d in (-1, 0, 1)]) for c in XYZ]
    finite = lambda s: F.expr(" and ".join(f"{s}{c} - {s}{c} = 0" for c in XYZ))
    q = q.where(finite("q"))
    for c, a in zip(XYZ, around):
        q = q.withColumn(f"c{c}", F.explode(a))
    r = r.where(finite("r")).withColumns({f"c{c}": _cell("r", size, c) for c in XYZ})
    both = q.join(r, ["batch_id", "cx", "cy", "cz"]).drop("cx", "cy", "cz")
    return both.withColumn("d2", distance2()).where(F.col("d2") <= F.lit(radius * radius))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """rank 1..k by (d2, ref_row) for each query; for one neighbor a plain aggregate."""
    if k == 1:
        rest = [c for c in pairs.columns if c not in ("batch_id", "query_row", "d2", "ref_row")]
        best = pairs.groupBy("batch_id", "query_row").agg(F.min(F.struct("d2", "ref_row", *rest)).alias("b"))
        return best.select("batch_id", "query_row", F.lit(1).alias("rank"), *[F.col(f"b.{c}") for c in ("ref_row", "d2", *rest)])
    w = Window.partitionBy("batch_id", "query_row").orderBy("d2", "ref_row")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result: checkpoint it to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="pcframe-"))
    return df.checkpoint()


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """Rows of p in leaves of LEAF at most, halved at the median of the widest side."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        side = int(np.ptp(p[at], axis=0).argmax())
        at = at[np.argpartition(p[at, side], len(at) // 2)]
        todo += [at[: len(at) // 2], at[len(at) // 2 :]]
    return out


def _squared(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    d = np.square(q[:, None, 0] - r[None, :, 0])
    d += np.square(q[:, None, 1] - r[None, :, 1])
    d += np.square(q[:, None, 2] - r[None, :, 2])
    return d


def _first_copies(r: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows of r at one place, the first k: others can't be among anyone's k nearest."""
    p = r[rows]
    order = np.lexsort((rows, p[:, 2], p[:, 1], p[:, 0]))
    p = p[order]
    starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(1)]))
    place = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))
    return rows[np.sort(order[place < k])]


def nearest(q: np.ndarray, r: np.ndarray, k: int, within: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, d2) of the k nearest with d2 <= within (one for all, or one a query), in
    order of (query, d2, reference); points that aren't finite never.

    Leaves of queries meet the leaves of the reference in order of the distance of their boxes,
    until that is more than every query's k-th so far: exact whatever the density, with no
    radius to choose and no pair of whole entries. Of what is known so far, a query holds k values.
    """
    none = np.empty(0, int), np.empty(0, int), np.empty(0)
    fine, used = np.flatnonzero(np.isfinite(r).all(1)), np.flatnonzero(np.isfinite(q).all(1))
    if not len(fine) or not len(used):
        return none
    fine = _first_copies(r, fine, k)
    leaves = [fine[x] for x in _leaves(r[fine])]
    low, high = (np.array([f(r[x], axis=0) for x in leaves]) for f in (np.min, np.max))
    limit, out = np.broadcast_to(np.asarray(within, float), (len(q),)), []
    for mine in (used[x] for x in _leaves(q[used])):
        p = q[mine]
        gap = np.maximum(np.maximum(low - p.max(0), p.min(0) - high), 0)
        apart = np.square(gap).sum(1) * (1 - 1e-12)  # rounding must not lose a leaf
        best, bound, found = np.full((len(p), k), np.inf), limit[mine], []
        for leaf in np.argsort(apart, kind="stable"):
            if apart[leaf] > bound.max():
                break
            d = _squared(p, r[leaves[leaf]])
            near = d <= bound[:, None]
            best = np.partition(np.concatenate([best, np.where(near, d, np.inf)], axis=1), k - 1, axis=1)[:, :k]
            bound = np.minimum(bound, best[:, k - 1])
            i, j = np.nonzero(d <= bound[:, None])
            found.append((i, leaves[leaf][j], d[i, j]))
        if not found:
            continue
        i, j, v = (np.concatenate(x) for x in zip(*found))
        last = v <= bound[i]
        i, j, v = i[last], j[last], v[last]
        order = np.lexsort((j, v, i))
        i, j, v = i[order], j[order], v[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((mine[i[first]], j[first], v[first]))
    if not out:
        return none
    i, j, v = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(i, kind="stable")
    return i[order], j[order], v[order]


@dataclass(frozen=True)
class Blocks:
    """How entries are cut: of each large entry, a binary tree of (side, value, low child, high
    child), -1 - b standing for block b. Blocks cover all space, so any point has one; entries
    without a tree are one block."""

    trees: dict[int, list[tuple[int, float, int, int]]]

    @staticmethod
    def of(reference: DataFrame, sizes: list[tuple[int, int]]) -> Blocks:
        """From a bounded sample of the entries that have more than LOCAL_POINTS points (sizes:
        entry, points), halved at its medians until a block stands for LOCAL_POINTS of them."""
        total = sum(n for _, n in sizes)
        if not sizes:
            return Blocks({})
        rows = reference.where(F.col("batch_id").isin([b for b, _ in sizes])).select("batch_id", *[F.col(f"r{c}") for c in XYZ])
        rows = rows.sample(min(1.0, 0.9 * SAMPLE / total), 11).limit(SAMPLE) if total > SAMPLE else rows
        got = rows.toPandas()
        trees = {}
        for b, n in sizes:
            p = got.loc[got["batch_id"] == b, ["rx", "ry", "rz"]].to_numpy(float)
            p = p[np.isfinite(p).all(1)]
            least = max(LEAST_SAMPLE, len(p) * LOCAL_POINTS // n)
            nodes, todo, blocks = [], [(np.arange(len(p)), -1, 0)], 0
            while todo:
                at, above, which = todo.pop()
                side = int(np.ptp(p[at], axis=0).argmax()) if len(at) else 0
                value = float(np.median(p[at, side])) if len(at) else 0.0
                lower = p[at, side] < value
                if len(at) <= least or not lower.any():
                    here = -1 - blocks
                    blocks += 1
                else:
                    here = len(nodes)
                    nodes.append([side, value, 0, 0])
                    todo += [(at[lower], here, 2), (at[~lower], here, 3)]
                if above >= 0:
                    nodes[above][which] = here
            if nodes:
                trees[b] = [tuple(x) for x in nodes]
        return Blocks(trees)

    def own(self, batch: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Each point's block."""
        out = np.zeros(len(p), np.int64)
        for b, nodes in self.trees.items():
            todo = [(0, np.flatnonzero(batch == b))]
            while todo:
                at, rows = todo.pop()
                if at < 0:
                    out[rows] = -1 - at
                elif len(rows):
                    side, value, low, high = nodes[at]
                    less = p[rows, side] < value
                    todo += [(low, rows[less]), (high, rows[~less])]
        return out

    def touched(self, batch: int, p: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) for each block that the ball about a point of an entry reaches into."""
        nodes, out = self.trees.get(batch), []
        if nodes is None:
            return np.arange(len(p)), np.zeros(len(p), np.int64)
        todo = [(0, np.arange(len(p)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out.append((rows, np.full(len(rows), -1 - at)))
            elif len(rows):
                side, value, low, high = nodes[at]
                gap = p[rows, side] - value
                near = np.square(gap) * (1 - 1e-12) <= d2[rows]
                todo += [(low, rows[(gap < 0) | near]), (high, rows[(gap >= 0) | near])]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int))


def _dealt(side: DataFrame, blocks: Blocks, prefix: str) -> DataFrame:
    """Points with their block."""
    if not blocks.trees:
        return side.withColumn("block", F.lit(0).cast("long"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(block=blocks.own(f["batch_id"].to_numpy(), f[[f"{prefix}{c}" for c in XYZ]].to_numpy(float)))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in side.schema)
    return side.mapInPandas(run, ddl + ", block long")


def indexed(r: DataFrame, sizes: DataFrame) -> tuple[DataFrame, Blocks]:
    """The reference keyed by block: cut where entries (sizes: batch_id, length) are large. Of more
    large entries than the sample can cut, the largest are; the others are blocks enough."""
    large = [(int(x[0]), int(x[1])) for x in sizes.where(F.col("length") > LOCAL_POINTS).orderBy(F.col("length").desc()).limit(SAMPLE // LEAST_SAMPLE).select("batch_id", "length").collect()]
    blocks = Blocks.of(r, large)
    return _dealt(r, blocks, "r"), blocks


def block_knn(dealt: DataFrame, blocks: Blocks, q: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """Exact k nearest (within the radius, if one is given), as top_k gives them.

    A query is searched in its own block, which bounds how far its k nearest can be. Only where
    that ball reaches into other blocks it goes there as well, with its bound; so points are
    shuffled once, queries near the edges of blocks a few times, and no task sees more than a block.
    """
    most = np.inf if radius is None else float(radius) * float(radius)
    r_fields = [f for f in dealt.schema if f.name not in ("batch_id", "block")]
    q_fields = [f for f in q.schema if f.name != "batch_id"]
    ddl = "batch_id long, rank int, d2 double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*q_fields, *r_fields])
    names, coordinates = [f.name for f in r_fields], [f"q{c}" for c in XYZ]

    def search(a: pd.DataFrame, b: pd.DataFrame, limit: np.ndarray | float) -> tuple[pd.DataFrame, np.ndarray]:
        b = b.sort_values("ref_row", ignore_index=True)
        i, j, d = nearest(a[coordinates].to_numpy(float), b[["rx", "ry", "rz"]].to_numpy(float), k, limit)
        out = pd.concat([a[["batch_id", *(f.name for f in q_fields)]].iloc[i].reset_index(drop=True), b[names].iloc[j].reset_index(drop=True)], axis=1)
        return out.assign(d2=d, rank=np.arange(len(i)) - np.searchsorted(i, i) + 1), i

    def whole(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search(a, b, most)[0]

    def first(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """What is found, and (as rows without a rank) the blocks that a query goes to next."""
        found, i = search(a, b, most)
        bound = np.full(len(a), most)
        full = np.flatnonzero(np.bincount(i, minlength=len(a)) >= k)
        ends = np.searchsorted(i, full, "right") - 1
        bound[full] = np.minimum(most, found["d2"].to_numpy()[ends])
        found["more"], found["block"] = False, 0
        if len(a):
            p, own = a[coordinates].to_numpy(float), int(a["block"].iloc[0])
            rows, to = blocks.touched(int(a["batch_id"].iloc[0]), p, bound)
            other = (to != own) & np.isfinite(p[rows]).all(1)
            asked = a[["batch_id", *(f.name for f in q_fields)]].iloc[rows[other]].reset_index(drop=True).assign(d2=bound[rows[other]], block=to[other], more=True, rank=0)
            for name in names:  # of the same types, so that ids stay whole
                asked[name] = np.zeros(len(asked), found[name].dtype) if pd.api.types.is_numeric_dtype(found[name].dtype) else None
            far = np.isin(found["query_row"].to_numpy(), asked["query_row"].to_numpy())
            found["block"] = far.astype(np.int64)  # 1: to be merged with what other blocks have
            found = pd.concat([found, asked], ignore_index=True)
        return found

    def next_(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search(a, b, a["d2"].to_numpy(float))[0]

    by = ["batch_id", "block"]
    asked = _dealt(q.where(F.col("batch_id").isNotNull()), blocks, "q")  # a null is no entry, as in a join
    if not blocks.trees:
        return asked.groupBy(by).cogroup(dealt.groupBy(by)).applyInPandas(whole, ddl)
    once = keep(asked.groupBy(by).cogroup(dealt.groupBy(by)).applyInPandas(first, ddl + ", more boolean, block long"))
    more = once.where("more").select("batch_id", "block", "d2", *[f.name for f in q_fields])
    again = more.groupBy(by).cogroup(dealt.groupBy(by)).applyInPandas(next_, ddl)
    columns = again.columns
    merged = top_k(once.where("not more and block = 1").select(columns).unionByName(again).drop("rank"), k)
    return once.where("not more and block = 0").select(columns).unionByName(merged.select(columns))


def local_knn(r: DataFrame, q: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """Each entry as one block; for entries of checked size."""
    return block_knn(_dealt(r, Blocks({}), "r"), Blocks({}), q, k, radius)


def both_nearest(s: DataFrame, t: DataFrame) -> DataFrame:
    """batch_id, forward, row_id, d2: of the points (batch_id, row_id, x, y, z) of both sides, the
    nearest of the other one, an entry a task: for entries of checked size. inf without one."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p, r, parts = a[list(XYZ)].to_numpy(float), b[list(XYZ)].to_numpy(float), []
        for one, x, y, forward in ((a, p, r, True), (b, r, p, False)):
            d = np.full(len(one), np.inf)
            i, _, v = nearest(x, y, 1)
            d[i] = v
            parts.append(pd.DataFrame({"batch_id": one["batch_id"], "forward": forward, "row_id": one["row_id"], "d2": d}))
        return pd.concat(parts, ignore_index=True)

    s, t = (x.select("batch_id", "row_id", *[F.col(c).cast("double").alias(c) for c in XYZ]) for x in (s, t))
    return s.groupBy("batch_id").cogroup(t.groupBy("batch_id")).applyInPandas(run, "batch_id long, forward boolean, row_id long, d2 double")
