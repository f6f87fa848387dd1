"""M4: density clusters (DBSCAN) by grid cells, eps joins of neighbouring cells and pointer jumping.

Two grids. Points of one fine cell (side eps / sqrt(dimensions), all dimensions) are within eps of each
other: a fine cell with ``min_samples`` points is all core, and the core points of a fine cell are
one node of the cluster graph, so a dense spot costs one node and no pairs. Fine cells are linked by
their outermost core points first (two a dimension); all core points meet only for pairs of cells whose boxes
are within eps and that are still in different components, so dense data is not met pair by pair. The coarse grid (up to
``GRID_DIMS`` widest dimensions, side at least eps) is the index: a point meets the cells that its
eps-box touches, nothing else. Co-grouped tasks hold one chunk of a coarse cell and one chunk of the
points that meet it, so a hot cell is many tasks; they give out counts, a spanning forest of fine
cells, or the least cluster, never pairs of points.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.graph import connected_components
from kiln.functions.nearest import vectors
from kiln.functions.ordering import row_index
from kiln.session import saved, ship_package

GRID_DIMS = 3
CELL_POINTS = 2048
CHUNK = 8192
_BATCH = 512


def _close(q: np.ndarray, m: np.ndarray, eps: float):
    """Batches of (first query, matrix of who is within eps)."""
    mm = (m * m).sum(axis=1)
    for s in range(0, len(q), _BATCH):
        part = q[s:s + _BATCH]
        d2 = (part * part).sum(axis=1)[:, None] + mm[None, :] - 2.0 * (part @ m.T)
        near = d2 <= eps * eps
        # products are off by rounding: what lies at the edge is measured again, term by term
        slack = 1e-12 * (mm.max() + (part * part).sum(axis=1).max()) + 1e-300
        for i, j in np.argwhere(np.abs(d2 - eps * eps) <= slack):
            diff = part[i] - m[j]
            near[i, j] = (diff * diff).sum() <= eps * eps
        yield s, near


def _counts(eps: float, enough: int):
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if queries.num_rows and rows.num_rows:
            q, m = vectors(queries.column("v")), vectors(rows.column("v"))
            ids = queries.column("pid").to_numpy()
            n = np.concatenate([np.minimum(near.sum(axis=1), enough) for _, near in _close(q, m, eps)]).astype(np.int64)
        return pa.table([pa.array(ids), pa.array(n)], names=["pid", "n"])
    return work


def _forest(eps: float):
    """Fine cells with core points within eps of each other, as few links as connect them."""
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        links = []
        if queries.num_rows and rows.num_rows:
            q, m = vectors(queries.column("v")), vectors(rows.column("v"))
            names, at = np.unique(np.concatenate([queries.column("fine").to_numpy(), rows.column("fine").to_numpy()]), return_inverse=True)
            root = np.arange(len(names))
            fq, fm = at[:len(q)], at[len(q):]
            for s, near in _close(q, m, eps):
                near &= root[fq[s:s + len(near)]][:, None] != root[fm][None, :]
                i, j = np.nonzero(near)
                for a, b in np.unique(np.stack([fq[s + i], fm[j]], axis=1), axis=0):
                    if root[a] != root[b]:
                        links.append((int(names[a]), int(names[b])))
                        root[root == root[b]] = root[a]
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])
    return work


def _near_boxes(eps: float):
    """Pairs of fine cells of different components whose core points' boxes are within eps."""
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [np.zeros((0, 2), dtype=np.int64)]
        if queries.num_rows and rows.num_rows:
            (qlo, qhi, qroot, qid), (lo, hi, root, ids) = [
                (vectors(t.column("lo")), vectors(t.column("hi")), t.column("root").to_numpy(), t.column("pid").to_numpy()) for t in (queries, rows)]
            for s in range(0, len(qid), _BATCH):
                part = slice(s, s + _BATCH)
                d2 = np.zeros((len(qid[part]), len(ids)))
                for j in range(lo.shape[1]):
                    gap = np.maximum(qlo[part, j, None] - hi[None, :, j], lo[None, :, j] - qhi[part, j, None])
                    d2 += np.maximum(gap, 0.0) ** 2
                i, j = np.nonzero((d2 <= eps * eps * (1 + 1e-9)) & (qroot[part, None] != root[None, :]))
                found.append(np.stack([qid[s + i], ids[j]], axis=1))
        a, b = np.concatenate(found).T
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return work


def _roots(cores: DataFrame, grid: "_Grid", dim: int, eps: float) -> DataFrame:
    """(node: fine cell, root): the components of the fine cells with core points within eps of each other."""
    outer = [f(F.struct("pid", "v", "cell"), F.col("v")[i]) for i in range(dim) for f in (F.min_by, F.max_by)]
    side = lambda f: F.array(*[f(F.col("v")[i]) for i in range(dim)])
    cells = saved(cores.groupBy("fine").agg(F.count("*").alias("n"), side(F.min).alias("lo"), side(F.max).alias("hi"),
                                            F.array_distinct(F.array(*outer)).alias("outer")), "fine")
    outermost = cells.select("fine", F.explode("outer").alias("o")).select("o.pid", "o.v", "fine", "o.cell")
    # a fine cell is linked from the side of each of its points; both directions are met, one is enough
    links = saved(_meet(grid.touched(outermost.select("pid", "v", "fine")), outermost, _forest(eps), "a bigint, b bigint"), "links")
    nodes = cells.select(F.col("fine").alias("node"))
    roots = connected_components(nodes, links)
    # two cells with outermost points only are settled by them
    boxes = saved(cells.join(roots, cells["fine"] == roots["node"]).select(
        F.col("fine").alias("pid"), F.zip_with("lo", "hi", lambda a, b: (a + b) / 2).alias("v"), "lo", "hi", "root", (F.col("n") > F.size("outer")).alias("more")), "boxes")
    if not boxes.where("more").limit(1).count() or roots.select("root").distinct().limit(2).count() < 2:
        return roots
    coarse = _Grid(boxes, boxes.count(), dim, 2 * eps)  # a centre is less than eps / 2 off its cell's points in a dimension
    box = boxes.drop("more")
    pairs = _meet(coarse.touched(box.join(boxes.where("more").select("pid"), "pid")), box.withColumn("cell", coarse.own()), _near_boxes(eps), "a bigint, b bigint")
    pairs = saved(pairs.distinct().withColumn("cell", F.monotonically_increasing_id()), "pairs")
    if not pairs.limit(1).count():
        return roots

    def facing(own: str, other: str) -> DataFrame:
        """Core points of one cell of each pair that can be within eps of the other."""
        ahead = pairs.select(F.col(own).alias("fine"), F.col(other).alias("_o"), "cell")
        held = ahead.join(boxes.select(F.col("pid").alias("_o"), "lo", "hi"), "_o")
        met = cores.drop("cell").join(held, "fine")
        gap = sum((F.greatest(F.col("lo")[i] - F.col("v")[i], F.col("v")[i] - F.col("hi")[i], F.lit(0.0)) ** 2 for i in range(dim)), F.lit(0.0))
        return met.where(gap <= eps * eps * (1 + 1e-9)).select("pid", "v", "fine", "cell")

    more = _meet(facing("a", "b"), facing("b", "a"), _forest(eps), "a bigint, b bigint")
    return connected_components(nodes, saved(links.unionByName(more), "links"))


def _least(eps: float):
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, least = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if queries.num_rows and rows.num_rows:
            q, m, c = vectors(queries.column("v")), vectors(rows.column("v")), rows.column("cluster").to_numpy()
            ids = queries.column("pid").to_numpy()
            none = np.iinfo(np.int64).max
            least = np.concatenate([np.where(near, c[None, :], none).min(axis=1) for _, near in _close(q, m, eps)])
            ids, least = ids[least < none], least[least < none]
        return pa.table([pa.array(ids), pa.array(least)], names=["pid", "cluster"])
    return work


class _Grid:
    """Coarse cells over the dimensions with most room for them."""

    def __init__(self, points: DataFrame, n: int, dim: int, eps: float):
        ranges = points.agg(*[f(F.col("v")[i]) for i in range(dim) for f in (F.min, F.max)]).first()
        spans = [(ranges[2 * i + 1] - ranges[2 * i], i, ranges[2 * i]) for i in range(dim)]
        spans = sorted((s for s in spans if s[0] > eps), reverse=True)[:GRID_DIMS]
        per = max(1.0, math.ceil(n / CELL_POINTS) ** (1 / max(1, len(spans))))
        self.eps = eps
        self.dims = [(i, start, max(eps * (1 + 1e-9), span / per)) for span, i, start in spans]

    def _at(self, x: Column, start: float, side: float) -> Column:
        return F.floor((x - F.lit(start)) / F.lit(side)).cast("bigint")

    def own(self) -> Column:
        return F.xxhash64(F.lit(len(self.dims)), *[self._at(F.col("v")[i], start, side) for i, start, side in self.dims])

    def touched(self, df: DataFrame) -> DataFrame:
        """A row per point and cell that its eps-box touches."""
        reach = self.eps * (1 + 1e-9)
        for i, start, side in self.dims:
            x = F.col("v")[i]
            df = df.withColumn(f"_g{i}", F.explode(F.sequence(self._at(x - reach, start, side), self._at(x + reach, start, side))))
        names = [f"_g{i}" for i, _, _ in self.dims]
        return df.withColumn("cell", F.xxhash64(F.lit(len(self.dims)), *names)).drop(*names)


def _meet(queries: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
    """Every chunk of a cell's rows with every chunk of the queries that touch the cell."""
    size = lambda d, name: d.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    rows = rows.select([F.col(c).alias(c) for c in rows.columns])  # both sides come from one table
    sizes = saved(size(queries, "qc").join(size(rows, "rc"), "cell"))
    units, held = sizes.agg(F.coalesce(F.sum(F.col("qc") * F.col("rc")), F.lit(0)), F.coalesce(F.sum(F.col("qc") + F.col("rc")), F.lit(0))).first()
    # sparse cells share tasks, the chunks of a hot cell do not
    tasks = max(1, min(units, 10_000, max(2 * queries.sparkSession.sparkContext.defaultParallelism, (units + held) // 16)))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("pid"), F.col(c)).cast("int")
    keys = ["cell", "i", "j"]
    q = queries.join(sizes, "cell").withColumn("i", part("qc")).withColumn("j", each("rc")).drop("qc", "rc").repartition(tasks, *keys)
    r = rows.join(sizes.select([F.col(c).alias(c) for c in sizes.columns]), "cell").withColumn("j", part("rc")).withColumn("i", each("qc")).drop("qc", "rc").repartition(tasks, *keys)
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(work, schema)


def dbscan(df: DataFrame, id_col: str, features: str | list[str], eps: float = 0.8, min_samples: int = 5) -> DataFrame:
    """(id, cluster) of every row: core points have ``min_samples`` points (themselves included) within
    eps; core points within eps share a cluster; a border point takes the least cluster of the core
    points within eps of it; the rest is noise, -1. Clusters are numbered from 0 in the order of
    their smallest core id. Ids are of any orderable type; rows with a null vector or element are
    noise. An empty table gives an empty result. ``features``: an array column, or columns.
    """
    ship_package(df.sparkSession)
    vec = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    # the row number stands for the id, whose type may be anything, and is fixed by the saved table
    every = saved(df.select(F.col(id_col).alias("id"), vec.alias("v")).withColumn("pid", F.monotonically_increasing_id()))
    points = every.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).drop("id")
    n, dim, least = points.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    noise = every.select(F.col("id").alias(id_col), F.lit(-1).alias("cluster"))
    if not n or not dim:
        return noise
    if dim != least:
        raise ValueError("vectors of several widths")
    side = eps / math.sqrt(dim) * (1 - 1e-9)
    fine = F.transform("v", lambda x: F.floor(x / F.lit(side)).cast("bigint"))
    grid = _Grid(points, n, dim, eps)
    names = saved(points.groupBy(fine.alias("key")).agg(F.count("*").alias("m")).withColumn("fine", F.monotonically_increasing_id()))
    points = saved(points.withColumn("key", fine).join(names, "key").select("pid", "v", "fine", "m", grid.own().alias("cell")))
    rows = points.select("pid", "v", "cell")
    dense = points.where(F.col("m") >= min_samples).select("pid")
    loose = grid.touched(points.where(F.col("m") < min_samples).select("pid", "v"))
    found = _meet(loose, rows, _counts(eps, min_samples), "pid bigint, n bigint").groupBy("pid").agg(F.sum("n").alias("n"))
    core = saved(dense.unionByName(found.where(F.col("n") >= min_samples).select("pid")))
    cores = saved(points.join(core, "pid").select("pid", "v", "fine", "cell"))
    roots = _roots(cores, grid, dim, eps)
    cores = cores.join(roots.withColumnRenamed("node", "fine"), "fine")
    first = cores.join(every.select("pid", "id"), "pid").groupBy("root").agg(F.min("id").alias("first"))
    numbers = row_index(first, ["first", "root"], "cluster").select("root", F.col("cluster").cast("bigint").alias("cluster"))
    cores = saved(cores.join(numbers, "root").select("pid", "v", "cell", "cluster"))
    others = points.join(core, "pid", "left_anti").select("pid", "v")
    border = _meet(grid.touched(others), cores, _least(eps), "pid bigint, cluster bigint").groupBy("pid").agg(F.min("cluster").alias("cluster"))
    held = cores.select("pid", "cluster").unionByName(border)
    return every.join(held, "pid", "left").select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
