"""M5: mean silhouette, exact, without scanning far clusters point by point.

Rows of a cluster are dealt to cells around a few pivots; a cell is described by its size, mean and
mean squared distance V to that mean. For a point x the mean distance to a cell's rows lies between
``|x - mean|`` and ``sqrt(|x - mean|^2 + V)``, so the cells of a cluster bound the point's mean distance
to it. Only its own cluster and those that can be the nearest other one are summed row by row.
With squared distances the upper bound's square is the mean itself, so no row is scanned at all.

Several labellings of the same points are scored in one scan (``silhouettes``): each pair of rows meets once, and
its distance counts for both rows and in all labellings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.nearest import SAMPLE_ROWS, choose_pivots, distances, vec_col, vectors
from kiln.session import saved, ship_package

METRICS = ("euclidean", "squared")
PIVOTS = 64
#: Cells whose means are broadcast at once; more are met in several passes.
CELL_BYTES = 8 << 20
#: Rows of a cluster that one group scans, and points that meet them there, at most; groups a core to aim at.
BLOCK_BYTES = 16 << 20
POINT_ROWS = 65_536
GROUPS_PER_CORE = 8
#: Points and rows whose distances are held at once: they stay in a core's cache.
TILE = (128, 1024)
#: For several labellings: groups of two blocks a core to aim at, rows of a block at least, rows and columns whose distances are
#: held at once, and bytes of a block's vectors and sums at most.
PAIRS_PER_CORE = 5
PAIR_ROWS = 1024
PAIR_TILE = 256
PAIR_BYTES = 64 << 20
#: Share by which bounds are widened against rounding.
SLACK = 1e-9


class _Cells:
    """Cells of some clusters, ordered by cluster."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["_c"])
        self.n = np.array([r["n"] for r in rows], dtype=np.float64)
        self.mean = np.array([r["s"] for r in rows], dtype=np.float64) / self.n[:, None]
        self.var = np.array([r["v"] for r in rows], dtype=np.float64) / self.n
        of = np.array([r["_c"] for r in rows], dtype=np.float64)
        self.starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        self.cluster = of[self.starts]
        self.size = np.add.reduceat(self.n, self.starts)

    def to_means(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of points to the cells' means, by differences (exact for near ones too)."""
        out = np.empty((len(x), len(self.n)))
        for j, m in enumerate(self.mean):
            d = x - m
            out[:, j] = np.einsum("ij,ij->i", d, d)
        return out

    def per_cluster(self, per_cell: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_cell * self.n, self.starts, axis=1) / self.size


def _slices(batch: pa.RecordBatch, cells: _Cells) -> Iterator[pa.RecordBatch]:
    step = max(1, (4 << 20) // max(1, len(cells.n)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _rows_with(part: pa.RecordBatch, **columns) -> pa.RecordBatch:
    names = [n for n in part.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns.values()], names=[*names, *columns])


def _deal(pivots: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = vectors(batch.column("_v"))
            cell = distances(m, pivots, "euclidean").argmin(axis=1) if len(m) else np.zeros(0)
            yield _rows_with(batch, _cell=pa.array(cell.astype(np.int32)))
    return work


def _upper(held, squared: bool):
    """Lowers ``_b`` to the least upper bound (squared: the least mean) over other clusters; squared also
    sets ``_a``, the mean over the rest of the own cluster."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in batches:
            for part in _slices(batch, cells):
                x, own = vectors(part.column("_v")), part.column("_c").to_numpy()
                d2 = cells.to_means(x) + cells.var
                mean = cells.per_cluster(d2 if squared else np.sqrt(d2))
                mine = own[:, None] == cells.cluster[None, :]
                b = np.minimum(part.column("_b").to_numpy(), np.where(mine, np.inf, mean).min(axis=1))
                if squared:
                    total = np.where(mine, mean * cells.size, 0.0).sum(axis=1)
                    count = np.where(mine, cells.size, 0.0).sum(axis=1)
                    a = np.where(count > 1, total / np.maximum(count - 1, 1), part.column("_a").to_numpy())
                    yield _rows_with(part, _a=pa.array(a), _b=pa.array(b))
                else:
                    yield _rows_with(part, _b=pa.array(b))
    return work


def _targets(held):
    """``_to``: the clusters whose lower bound does not exceed the least upper bound, and the own one."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in batches:
            for part in _slices(batch, cells):
                x, own = vectors(part.column("_v")), part.column("_c").to_numpy()
                low = cells.per_cluster(np.sqrt(cells.to_means(x)))
                at = low <= (part.column("_b").to_numpy() * (1 + SLACK) + SLACK)[:, None]
                at |= own[:, None] == cells.cluster[None, :]
                to = [cells.cluster[row].tolist() for row in at]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_v"), pa.array(to, pa.list_(pa.float64()))],
                                                 names=["_id", "_v", "_to"])
    return work


def _distance_sums(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For every row of ``x`` the sum of its distances to the rows of ``m``. One product gives
    |x|^2 - 2 x m + |m|^2 of a tile, and all further steps meet it in the cache."""
    ones = np.ones((max(len(x), len(m)), 1))
    left = np.hstack([-2.0 * x, (x * x).sum(axis=1)[:, None], ones[:len(x)]])
    right = np.hstack([m, ones[:len(m)], (m * m).sum(axis=1)[:, None]])
    out = np.zeros(len(x))
    for j in range(0, len(m), TILE[1]):
        part = np.ascontiguousarray(right[j:j + TILE[1]].T)
        tile = np.empty((min(TILE[0], len(x)), part.shape[1]))
        for s in range(0, len(x), TILE[0]):
            q = left[s:s + TILE[0]]
            d = np.matmul(q, part, out=tile[:len(q)])
            np.maximum(d, 0.0, out=d)
            np.sqrt(d, out=d)
            out[s:s + TILE[0]] += d.sum(axis=1)
    return out


def _sums(points: pa.Table, rows: pa.Table) -> pa.Table:
    """For every point of a chunk the sum of its distances to the rows of one block."""
    if not points.num_rows or not rows.num_rows:
        return pa.table([points.column("_id").slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.float64())], names=["_id", "_to", "_sum"])
    x, m = vectors(points.column("_v")), vectors(rows.column("_v"))
    centre = m.mean(axis=0)  # products near the rows' own mean lose fewer digits
    return pa.table([points.column("_id"), points.column("_to"), pa.array(_distance_sums(x - centre, m - centre))], names=["_id", "_to", "_sum"])


def _cell_rows(points: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """(cluster, cell, n, s: sum of vectors, v: sum of squared distances to the cell's mean)."""
    dealt = saved(points.select("_c", "_v").mapInArrow(_deal(pivots), "_c double, _v array<double>, _cell int"), "cells") \
        if len(pivots) > 1 else points.select("_c", "_v", F.lit(0).alias("_cell"))
    sums = [F.sum(F.col("_v")[i]) for i in range(dim)]
    # sums of squared deviations come from Spark's stable variance, not from differences of squares
    spread = [F.var_pop(F.col("_v")[i]) for i in range(dim)]
    n = F.count(F.lit(1))
    total = spread[0]
    for e in spread[1:]:
        total = total + e
    return dealt.groupBy("_c", "_cell").agg(n.alias("n"), F.array(*sums).alias("s"), (total * n).alias("v"))


def silhouette(df: DataFrame, id_col: str, vec: str | list[str], cluster: str, metric: str = "euclidean") -> DataFrame:
    """M5: ``(silhouette, n_clusters)`` over all points; metric ``euclidean`` or ``squared`` (squared Euclidean).

    Noise (-1) counts as a cluster; a point alone in its cluster, or with no other cluster, scores 0, and so
    does one that equals all of both. Rows with a null id, vector or cluster take no part; ids name their rows.
    Without rows the score is null.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    spark = df.sparkSession
    ship_package(spark)
    points = df.select(F.col(id_col).alias("_id"), vec_col(df, vec).alias("_v"), F.col(cluster).cast("double").alias("_c"))
    points = saved(points.where("_id is not null and _v is not null and _c is not null"), "points")
    n, dim, least, n_clusters = points.agg(F.count("*"), F.max(F.size("_v")), F.min(F.size("_v")), F.countDistinct("_c")).first()
    if not n or n_clusters < 2:
        return spark.createDataFrame([(0.0 if n else None, n_clusters)], "silhouette double, n_clusters bigint")
    if dim != least:
        raise ValueError("vectors of several widths")
    id_type = df.schema[id_col].dataType.simpleString()
    squared = metric == "squared"
    pivots = np.zeros((1, dim))
    if not squared:
        sample = points.select("_v").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS).toArrow()
        pivots = choose_pivots(vectors(sample.column(0)), PIVOTS, "euclidean")
    cells = saved(_cell_rows(points, pivots, dim), "moments")
    # the cells go out in passes of about CELL_BYTES, all cells of a cluster in one pass
    passes = math.ceil(cells.count() * (dim + 4) * 8 / CELL_BYTES)
    cells = cells.withColumn("_pass", F.pmod(F.xxhash64("_c"), F.lit(passes)))

    def held():
        for p in range(passes):
            rows = cells.where(F.col("_pass") == p).collect()
            if rows:
                yield spark.sparkContext.broadcast(_Cells(rows))

    inf = F.lit(float("inf"))
    bounded = points.withColumns({"_a": F.lit(0.0), "_b": inf}) if squared else points.withColumn("_b", inf)
    schema = f"_id {id_type}, _v array<double>, _c double, " + ("_a double, _b double" if squared else "_b double")
    for h in held():
        bounded = saved(bounded.mapInArrow(_upper(h, squared), schema), "bounds")
    sizes = cells.groupBy("_c").agg(F.sum("n").alias("_n"))
    if squared:
        per = bounded.join(sizes, "_c").select(F.when(F.col("_n") > 1, F.col("_a")).alias("a"), F.col("_b").alias("b"))
        return _mean(per, n_clusters)
    wanted = None
    for h in held():
        part = bounded.mapInArrow(_targets(h), f"_id {id_type}, _v array<double>, _to array<double>")
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = saved(wanted.select("_id", "_v", F.explode("_to").alias("_to")), "wanted")

    asked = saved(sizes.withColumnRenamed("_c", "_to").join(wanted.groupBy("_to").agg(F.count("*").alias("_asked")), "_to"), "asked")
    # square groups, several a core, whatever the rows' bytes: Spark would join small partitions to one task
    cores = spark.sparkContext.defaultParallelism
    pairs = asked.agg(F.sum(F.col("_asked").cast("double") * F.col("_n"))).first()[0]
    side = max(256, math.ceil(math.sqrt(pairs / (GROUPS_PER_CORE * cores))))
    per_block = max(1, min(side, BLOCK_BYTES // (dim * 8 + 16)))
    per_chunk = max(1, min(side, POINT_ROWS))
    plan = saved(asked.select("_to", F.ceil(F.col("_asked") / per_chunk).cast("int").alias("_chunks"),
                              F.ceil(F.col("_n") / per_block).cast("int").alias("_blocks")), "plan")  # a row per cluster
    groups = plan.agg(F.sum(F.col("_chunks").cast("bigint") * F.col("_blocks"))).first()[0]
    tasks = max(1, min(groups, 10_000, max(4 * cores, groups // 8)))
    keys = ["_to", "_block", "_chunk"]
    place = lambda by: F.pmod(F.xxhash64("_id"), F.col(by)).cast("int")
    each = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    left = wanted.join(plan, "_to").withColumn("_chunk", place("_chunks")).withColumn("_block", each("_blocks"))
    right = points.withColumnRenamed("_c", "_to").join(plan, "_to").withColumn("_block", place("_blocks")).withColumn("_chunk", each("_chunks"))
    deal = lambda d: d.select(*keys, "_id", "_v").repartition(tasks, *keys).groupBy(*keys)
    found = deal(left).cogroup(deal(right)).applyInArrow(_sums, f"_id {id_type}, _to double, _sum double")
    sums = found.groupBy("_id", "_to").agg(F.sum("_sum").alias("_sum"))
    own = F.col("_to") == F.col("_c")
    per = (sums.join(sizes.withColumnRenamed("_c", "_to"), "_to").join(points.select("_id", "_c"), "_id")
           .groupBy("_id").agg(F.max(F.when(own & (F.col("_n") > 1), F.col("_sum") / (F.col("_n") - 1))).alias("a"),
                               F.min(F.when(~own, F.col("_sum") / F.col("_n"))).alias("b")))
    return _mean(per, n_clusters)


class _Runs:
    """Rows that lie side by side by an ascending number: the numbers ``of`` and where their runs are."""

    def __init__(self, numbers: np.ndarray):
        starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        self.of, self.ends = numbers[starts], [*starts[1:].tolist(), len(numbers)]
        self.ones = np.ones(len(numbers))
        self.all = (numbers[:, None] == self.of).astype(np.float64) if len(starts) > 4 else None

    def sums(self, d: np.ndarray) -> np.ndarray:
        """Sums of the columns of each run."""
        if self.all is not None:
            return d @ self.all
        out, at = np.empty((len(d), len(self.ends))), 0
        for i, end in enumerate(self.ends):
            out[:, i] = d[:, at:end] @ self.ones[at:end]
            at = end
        return out


@np.errstate(invalid="ignore")
def _meet(x: np.ndarray, m: np.ndarray, xj: np.ndarray, mj: np.ndarray, to: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances: of the rows of ``x`` to each cluster among the rows of ``m``, and (``both``) the other way round.
    ``xj``, ``mj``: the rows' joint labels, ascending; ``to``: the clusters of a joint label, ones in its row."""
    centre = m.mean(axis=0)  # products near the rows' own mean lose fewer digits
    x, m = x - centre, m - centre
    ones = np.ones((max(len(x), len(m)), 1))
    left = np.hstack([-2.0 * x, (x * x).sum(axis=1)[:, None], ones[:len(x)]])
    right = np.hstack([m, ones[:len(m)], (m * m).sum(axis=1)[:, None]])
    of_x, of_m = np.zeros((len(x), to.shape[1])), np.zeros((len(m), to.shape[1]))
    joint, at_x = np.unique(xj, return_inverse=True)
    tiles = [(s, min(s + PAIR_TILE, len(x)), at_x[s], _Runs(at_x[s:s + PAIR_TILE])) for s in range(0, len(x), PAIR_TILE)]
    for j in range(0, len(m), PAIR_TILE):
        part = np.ascontiguousarray(right[j:j + PAIR_TILE].T)
        runs, back = _Runs(mj[j:j + PAIR_TILE]), np.zeros((len(joint), part.shape[1]))
        clusters = to[runs.of]
        tile = np.empty((PAIR_TILE, part.shape[1]))
        for lo, hi, first, mine in tiles:
            d = np.matmul(left[lo:hi], part, out=tile[:hi - lo])
            np.sqrt(d, out=d)
            sums = runs.sums(d)
            if np.isnan(sums).any():  # squares below zero by rounding, among rows that are almost equal
                d = np.sqrt(np.maximum(left[lo:hi] @ part, 0.0))
                sums = runs.sums(d)
            of_x[lo:hi] += sums @ clusters
            if both:
                back[first:first + len(mine.of)] += mine.sums(d.T).T
        if both:
            of_m[j:j + PAIR_TILE] = back.T @ to[joint]
    return of_x, of_m


def _shared_sums(held, id_type: pa.DataType):
    """For the rows of two blocks the sums of distances to the clusters of the other one."""
    def work(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["_id", "_j", "_s"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], id_type), pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64()))], names=names)
        to, both = held.value[0], key[0].as_py() != key[1].as_py()
        a, b = a.sort_by("_j"), b.sort_by("_j")
        sums = _meet(vectors(a.column("_v")), vectors(b.column("_v")), a.column("_j").to_numpy(), b.column("_j").to_numpy(), to, both)
        lists = lambda s: pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
        sides = [pa.table([t.column("_id"), t.column("_j"), lists(s)], names=names) for t, s in zip((a, b)[:1 + both], sums)]
        return pa.concat_tables(sides).cast(pa.schema([("_id", id_type), ("_j", pa.int32()), ("_s", pa.list_(pa.float64()))]))
    return work


def _shared_scores(held):
    """Per labelling the sum of the scores of a batch's rows, and their number."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, sizes, spans = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sums, mine = vectors(batch.column("_s")), to[batch.column("_j").to_numpy()] > 0
            got = []
            for first, last in spans:
                s, own, n = sums[:, first:last], mine[:, first:last], sizes[first:last]
                alone = (own * n).sum(axis=1) <= 1
                a = np.where(own, s, 0.0).sum(axis=1) / np.where(alone, 1.0, (own * (n - 1)).sum(axis=1))
                b = np.where(own, np.inf, s / n).min(axis=1)
                top = np.maximum(a, b)
                flat = alone | ~(top > 0)
                got.append(float(np.where(flat, 0.0, (b - a) / np.where(flat, 1.0, top)).sum()) if last - first > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([got], pa.list_(pa.float64()))], names=["n", "total"])
    return work


def silhouettes(df: DataFrame, id_col: str, vec: str | list[str], clusters: list[str]) -> list[tuple[float | None, int]]:
    """M5 with Euclidean distances for several labellings of the same points: ``[(silhouette, number of clusters)]``,
    as ``silhouette`` gives them one by one. Rows with a null id, vector or cluster take no part.

    All pairs are met, once for all labellings; a group holds two blocks of rows, and their sums are a double
    per row and cluster: for few clusters."""
    spark = df.sparkSession
    ship_package(spark)
    labels = F.array(*[F.col(c).cast("double") for c in clusters])
    points = df.select(F.col(id_col).alias("_id"), vec_col(df, vec).alias("_v"), labels.alias("_c"))
    points = saved(points.where("_id is not null and _v is not null and not exists(_c, x -> x is null)"), "points")
    n, dim, least = points.agg(F.count("*"), F.max(F.size("_v")), F.min(F.size("_v"))).first()
    if not n:
        return [(None, 0) for _ in clusters]
    if dim != least:
        raise ValueError("vectors of several widths")
    joint = sorted((tuple(r["_c"]), r["count"]) for r in points.groupBy("_c").count().collect())  # a row per clusters that occur together
    names = [sorted({c[i] for c, _ in joint}) for i in range(len(clusters))]
    starts = np.cumsum([0, *map(len, names)])
    to = np.zeros((len(joint), starts[-1]))
    for j, (c, _) in enumerate(joint):
        for i, x in enumerate(c):
            to[j, starts[i] + names[i].index(x)] = 1.0
    sizes = np.array([m for _, m in joint], dtype=np.float64) @ to
    held = spark.sparkContext.broadcast((to, sizes, list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))))
    numbers = spark.createDataFrame([(list(c), j) for j, (c, _) in enumerate(joint)], "_c array<double>, _j int")
    pairs = PAIRS_PER_CORE * spark.sparkContext.defaultParallelism
    blocks = min(math.ceil(math.sqrt(2 * pairs)), math.ceil(n / PAIR_ROWS))
    blocks = max(blocks, math.ceil(n * (dim + len(sizes)) * 8 / PAIR_BYTES))
    # rows of the same clusters lie side by side, in blocks of about the same size
    dealt = points.join(F.broadcast(numbers), "_c").select("_id", "_v", "_j").repartitionByRange(blocks, "_j", F.xxhash64("_id"))
    dealt = saved(dealt.withColumn("_block", F.spark_partition_id()), "blocks")  # ranges come from a sample: fixed here for all readers
    last = F.lit(blocks - 1)
    left = dealt.withColumn("_a", F.col("_block")).withColumn("_b", F.explode(F.sequence("_block", last)))
    right = dealt.withColumn("_b", F.col("_block")).withColumn("_a", F.explode(F.sequence(F.lit(0), "_block")))
    deal = lambda d: d.select("_a", "_b", "_id", "_v", "_j").repartition(blocks * (blocks + 1) // 2, "_a", "_b").groupBy("_a", "_b")
    id_type = df.schema[id_col].dataType.simpleString()
    arrow = pa.schema(spark.createDataFrame([], f"x {id_type}").toArrow().schema).field(0).type
    found = deal(left).cogroup(deal(right)).applyInArrow(_shared_sums(held, arrow), f"_id {id_type}, _j int, _s array<double>")
    each = found.groupBy("_id").agg(F.min("_j").alias("_j"), F.array(*[F.sum(F.col("_s")[i]) for i in range(len(sizes))]).alias("_s"))
    total = each.mapInArrow(_shared_scores(held), "n bigint, total array<double>")
    row = total.agg(F.sum("n"), *[F.sum(F.col("total")[i]) for i in range(len(clusters))]).first()
    held.destroy()
    return [(row[1 + i] / row[0], len(x)) for i, x in enumerate(names)]


def _mean(per: DataFrame, n_clusters: int) -> DataFrame:
    """The mean of ``(b - a) / max(a, b)``; a is null for a point alone in its cluster."""
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | (top <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return per.agg(F.avg(s).alias("silhouette"), F.lit(n_clusters).cast("bigint").alias("n_clusters"))


def silhouette_exact(df: DataFrame, id_col: str, vec: str | list[str], cluster: str) -> DataFrame:
    """M5 with Euclidean distances."""
    return silhouette(df, id_col, vec, cluster)
