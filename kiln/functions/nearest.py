"""Exact nearest neighbours by pivot cells and the triangle inequality.

Reference rows are dealt to the nearest of a few pivots and range-partitioned by (pivot, distance to
it, id): each range is a block with a known ring around its pivot, and a hot cell, also one of equal
vectors, is many blocks. For a query q, a block in the ring [lo, hi] around pivot p holds nothing
nearer than max(d(q, p) - hi, lo - d(q, p), 0). A query first visits the block that can be nearest;
its k-th distance there is an upper bound, and it then visits only the blocks whose lower bound does
not exceed it (ties: whose smallest id is below the k-th id). Visits are co-grouped tasks of one
block and one bounded chunk of queries, and give out k rows per query.

Of equal reference vectors only the rows of the smallest ids can be among the nearest, and equal queries
are searched once. With few dimensions a block has about 2 sqrt(n) rows, so that a query's work grows with the
root of the rows; with many, where bounds rule little out, blocks are as large as memory allows.

On the driver: the pivots (at most ``PIVOTS``, from a bounded sample) and one row per block and
pivot (at most ``MAX_BLOCKS`` + ``PIVOTS`` rows). Any sample gives the same results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.session import saved, ship_package

BLOCK_BYTES = 16 << 20
PIVOTS = 256
SAMPLE_ROWS = 4096
MAX_BLOCKS = 65_536
#: Rows of a block at least, for vectors of at most ``FEW`` dimensions.
BLOCK_ROWS = 2048
FEW = 8
#: Queries of a task at most, and at least for narrow and wide vectors (each task reads a whole block); tasks to aim at.
QUERY_ROWS = 32_768
LEAST_ROWS = (256, 4096)
TASKS = 64
#: Distances of a task held at once.
HELD = 1 << 21
#: Elements up to which sums of wide vectors are counted in steps: more leave too few steps to an element.
STEPPED = 256
#: Share of the vectors' norms by which the blocks' bounds are widened.
SLACK = 1e-6


def vec_col(df: DataFrame, vec: str | list[str]):
    """An array column, or several numeric columns, as one array of doubles."""
    if isinstance(vec, str):
        return F.col(vec).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in vec])


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of one width as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0), dtype=np.float64)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of two matrices, right to about 1e-7 of the norms."""
    if metric == "manhattan":
        out = np.zeros((len(a), len(b)))
        step = max(1, (1 << 16) // max(1, len(b)))
        for i in range(0, len(a), step):
            for x, y in zip(a[i:i + step].T, b.T, strict=True):
                out[i:i + step] += np.abs(x[:, None] - y[None, :])
        return out
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _norms(m: np.ndarray, metric: str) -> np.ndarray:
    return np.abs(m).sum(axis=1) if metric == "manhattan" else np.sqrt((m * m).sum(axis=1))


def choose_pivots(sample: np.ndarray, count: int, metric: str) -> np.ndarray:
    """``count`` rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = distances(sample, sample[:1], metric)[:, 0]
    while len(chosen) < min(count, len(sample)):
        at = int(nearest.argmax())
        if nearest[at] <= 0:
            break
        chosen.append(at)
        nearest = np.minimum(nearest, distances(sample, sample[at:at + 1], metric)[:, 0])
    return sample[chosen]


class _Index:
    """What a task needs to find a query's blocks: one entry per (block, pivot)."""

    def __init__(self, pivots: np.ndarray, entries: list, metric: str):
        self.pivots, self.metric = pivots, metric
        self.block, self.cell, self.n = (np.array([e[k] for e in entries], dtype=np.int64) for k in ("block", "cell", "n"))
        self.lo, self.hi, self.norm = (np.array([e[k] for e in entries], dtype=np.float64) for k in ("lo", "hi", "norm"))
        self.first = [e["first"] for e in entries]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the distance to each entry's rows, and distances to its pivot."""
        to = distances(q, self.pivots, self.metric)[:, self.cell]
        slack = SLACK * (_norms(q, self.metric)[:, None] + self.norm[None, :])
        return np.maximum(np.maximum(to - self.hi, self.lo - to) - slack, 0.0), to

    def home(self, q: np.ndarray, need: int) -> list[list[int]]:
        """For each query the block that can be nearest, and further ones until they hold ``need`` rows."""
        low, to = self.bounds(q)
        best = np.where(low <= low.min(axis=1, keepdims=True), to, np.inf).argmin(axis=1)
        out = []
        for i in range(len(q)):
            if self.n[best[i]] >= need:
                out.append([int(self.block[best[i]])])
                continue
            order = np.lexsort((to[i], low[i]))
            blocks, held = [], 0
            for e in order:
                if self.block[e] not in blocks:
                    blocks.append(int(self.block[e]))
                held += int(self.n[e])
                if held >= need:
                    break
            if held < need:
                for e in np.lexsort((to[i], low[i])):
                    if self.block[e] not in blocks:
                        blocks.append(int(self.block[e]))
                        held += int(self.n[self.block == self.block[e]].sum())
                        if held >= need:
                            break
            out.append(blocks)
        return out

    def rest(self, q: np.ndarray, tau: list, last: list, seen: list) -> list[list[int]]:
        """For each query the blocks, besides those seen, that can hold a row before its k-th."""
        low, _ = self.bounds(q)
        out = []
        for i in range(len(q)):
            if tau[i] is None:
                at = set(self.block.tolist())
            else:
                at = set(self.block[low[i] < tau[i]].tolist())
                at |= {int(self.block[e]) for e in np.flatnonzero(low[i] == tau[i]) if self.first[e] < last[i]}
            out.append(sorted(at - set(seen[i])))
        return out


def _assign(pivots: np.ndarray, metric: str):
    """(id, vector, label) with the nearest pivot, the distance to it and the norm."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = vectors(batch.column("_tv"))
            d = distances(m, pivots, metric) if len(m) else np.zeros((0, 1))
            cell = d.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(d[np.arange(len(m)), cell]), pa.array(_norms(m, metric) if len(m) else np.zeros(0))],
                names=[*batch.schema.names, "_cell", "_pd", "_norm"])
    return work


def _visits(held, need: int, rest: bool):
    """Adds the list of blocks that a query visits."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        step = max(1, (2 << 20) // max(1, len(index.block)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                q = vectors(part.column("_qv"))
                blocks = index.rest(q, *(part.column(k).to_pylist() for k in ("_tau", "_last", "_seen"))) if rest else index.home(q, need)
                names = ["_qid", "_qv", "_own", "_tau"]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(blocks, pa.list_(pa.int64()))], names=[*names, "_blocks"])
    return work


class _Rough:
    """Keys of the distances from queries to a block's rows (squares without the query's own share, or sums)
    with a bound of their error: single precision for wide vectors, scaled so that nothing overflows. Sums of wide finite
    vectors are counted in steps of the block's widest element, so small that a sum fits 16 bits."""

    def __init__(self, m: np.ndarray, metric: str):
        dim = m.shape[1]
        self.metric, self.type = metric, np.float32 if dim > 16 else np.float64
        size = np.abs(m)
        self.scale = float(size.max(where=np.isfinite(size), initial=0.0)) or 1.0
        if self.type == np.float64:
            self.scale = 1.0
        self.unit = 4 * (dim + 8) * float(np.finfo(self.type).eps)
        m = m / self.scale
        norms = _norms(m, metric)
        self.largest = norms.max()  # a row without a norm leaves its block without bounds: nothing is found there
        if metric == "manhattan":  # |a - b| = a + b - 2 min(a, b)
            self.m, self.own = np.ascontiguousarray(m.T, dtype=self.type), m.sum(axis=1).astype(self.type)
            self.step = 0.0
            if self.type == np.float32 and dim <= STEPPED and np.isfinite(m).all():
                self.low = m.min(axis=0)
                self.span = float((m.max(axis=0) - self.low).max())
                self.step = self.span / (np.iinfo(np.uint16).max // dim - 1)
            if self.step > 0:
                codes = np.rint((m - self.low) / self.step)
                self.codes, self.code_sums = np.ascontiguousarray(codes.T, dtype=np.uint16), codes.sum(axis=1).astype(np.float32)
        else:
            self.m = np.ascontiguousarray(np.column_stack([-2.0 * m, (m * m).sum(axis=1)]).T, dtype=self.type)

    def keys(self, q: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, the largest key that a row within ``tau`` can have, and the error of a key."""
        q, tau = q / self.scale, tau / self.scale
        norms = _norms(q, self.metric)
        if self.metric == "manhattan":
            if self.step > 0 and np.isfinite(q).all():
                return self._steps(q, tau)
            error = self.unit * (norms + self.largest)
            return self._sums(q.astype(self.type)), tau + error + self.unit * tau, error
        error = self.unit * (norms + self.largest) ** 2
        keys = np.column_stack([q, np.ones(len(q))]).astype(self.type) @ self.m
        return keys, tau * tau * (1 + self.unit) - norms * norms + error, error

    def _steps(self, q: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``keys`` in steps. The block's rows lie within its span, so what a query has outside of it is part of each
        of its distances; within, two rounded elements are off by a step together at most."""
        inside = np.clip(q - self.low, 0.0, self.span)
        outside = np.abs(q - self.low - inside).sum(axis=1)
        codes = np.rint(inside / self.step).astype(np.uint16)
        own, dim = codes.sum(axis=1, dtype=np.float32), q.shape[1]
        out = np.empty((len(q), self.codes.shape[1]), dtype=np.float32)
        for i in range(0, len(q), 64):  # tiles that stay in a core's cache
            some = np.ascontiguousarray(codes[i:i + 64].T)
            for j in range(0, out.shape[1], 1024):
                part = self.codes[:, j:j + 1024]
                both = np.zeros((some.shape[1], part.shape[1]), dtype=np.uint16)
                least = np.empty_like(both)
                for a, b in zip(some, part, strict=True):  # |a - b| = a + b - 2 min(a, b)
                    np.minimum(a[:, None], b[None, :], out=least)
                    both += least
                out[i:i + 64, j:j + 1024] = own[i:i + 64, None] + self.code_sums[None, j:j + 1024] - 2 * both.astype(np.float32)
        rounding = 16 * (dim + 8) * float(np.finfo(np.float64).eps) * (np.abs(q).sum(axis=1) + self.largest + outside)
        error = dim * 1.000001 + 1 + rounding / self.step
        return out, (tau - outside) / self.step + error, error

    def _sums(self, q: np.ndarray) -> np.ndarray:
        out = np.empty((len(q), self.m.shape[1]), dtype=self.type)
        own = q.sum(axis=1)
        for i in range(0, len(q), 32):  # tiles that stay in a core's cache
            some = np.ascontiguousarray(q[i:i + 32].T)
            for j in range(0, out.shape[1], 1024):
                part = self.m[:, j:j + 1024]
                both = np.zeros((some.shape[1], part.shape[1]), dtype=self.type)
                least = np.empty_like(both)
                for a, b in zip(some, part, strict=True):
                    np.minimum(a[:, None], b[None, :], out=least)
                    both += least
                out[i:i + 32, j:j + 1024] = own[i:i + 32, None] + self.own[None, j:j + 1024] - 2 * both
        return out


def _pair_distances(q: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of the pairs (i, j), some at a time."""
    out, step = np.empty(len(i)), max(1, HELD // max(1, m.shape[1]))
    for s in range(0, len(i), step):
        diff = m[j[s:s + step]] - q[i[s:s + step]]
        out[s:s + step] = np.abs(diff).sum(axis=1) if metric == "manhattan" else np.sqrt((diff * diff).sum(axis=1))
    return out


def _nearest(k: int, metric: str, types: tuple[pa.DataType, pa.DataType]):
    names = ["_qid", "_tid", "_dist", "_tlabel"]

    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_tid").combine_chunks()  # places are in id order
        found: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            m, q = vectors(rows.column("_tv")), vectors(queries.column("_qv"))
            tau = queries.column("_tau").to_numpy()
            tau = np.where(np.isnan(tau), np.inf, tau)
            own, place = queries.column("_own").to_pylist(), {}
            if any(x is not None for x in own):
                for j, x in enumerate(rows.column("_tid").to_pylist()):
                    place.setdefault(x, []).append(j)
            rough = _Rough(m, metric)
            step = max(1, HELD // len(m))
            for s in range(0, len(q), step):
                near, edge, error = rough.keys(q[s:s + step], tau[s:s + step])
                if place:
                    for i, x in enumerate(own[s:s + step]):
                        near[i, place.get(x, [])] = np.inf
                if len(m) <= k:
                    edge = np.full(len(near), np.inf)
                elif not np.isfinite(edge).all():
                    edge = np.minimum(edge, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * error)
                edge = np.nextafter(edge.astype(near.dtype), near.dtype.type(np.inf))
                close = near <= edge[:, None]
                if not np.isfinite(edge).all():
                    close &= near < np.inf
                i, j = np.nonzero(close)
                exact = _pair_distances(q[s:s + step], m, i, j, metric)
                order = np.lexsort((j, exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append((i[first] + s, j[first], exact[first]))
        i, j, exact = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([queries.column("_qid").take(pa.array(i)).cast(types[0]), rows.column("_tid").take(pa.array(j)).cast(types[1]), pa.array(exact),
                         rows.column("_tlabel").take(pa.array(j)).cast(pa.float64())], names=names)
    return work


def _meet(visits: DataFrame, blocks: DataFrame, work, schema: str, least: int) -> DataFrame:
    """Every visited block with its queries, in chunks of at most ``QUERY_ROWS`` queries or so."""
    q = visits.select("_qid", "_qv", "_own", "_tau", F.explode("_blocks").alias("_block"))
    counts = saved(q.groupBy("_block").agg(F.count("*").alias("_n")))  # a row per block
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    some = min(QUERY_ROWS, max(least, math.ceil(total / TASKS)))
    chunks = counts.select("_block", F.ceil(F.col("_n") / some).cast("int").alias("_chunks"))
    tasks = chunks.agg(F.coalesce(F.sum("_chunks"), F.lit(0))).first()[0]
    tasks = max(1, min(int(tasks), 4 * TASKS if some < QUERY_ROWS else 10_000))
    q = q.join(F.broadcast(chunks), "_block").withColumn("_chunk", F.pmod(F.xxhash64("_qid"), F.col("_chunks")).cast("int"))
    r = blocks.join(F.broadcast(chunks), "_block").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    keys = ["_block", "_chunk"]
    q = q.select(*keys, "_qid", "_qv", "_own", "_tau").repartition(tasks, *keys)
    r = r.select([F.col(c).alias(c) for c in (*keys, "_tid", "_tv", "_tlabel")]).repartition(tasks, *keys)
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(work, schema)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_qid").orderBy("_dist", "_tid")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def _few_of_equal(ref: DataFrame, k: int, need: int) -> DataFrame:
    """Of each distinct vector the rows of its ``need`` smallest ids, ``k`` rows of an id."""
    once = Window.partitionBy("_tv", "_tid").orderBy("_tlabel")
    first = Window.partitionBy("_tv").orderBy("_tid")
    some = ref.withColumn("_r", F.row_number().over(once)).where(F.col("_r") <= k)
    return some.withColumn("_r", F.dense_rank().over(first)).where(F.col("_r") <= need).drop("_r")


def nearest_rows(query: DataFrame, ref: DataFrame, k: int, exclude_self: bool = False, metric: str = "euclidean") -> DataFrame:
    """The k nearest rows of ``ref(_tid, _tv, _tlabel)`` for every row of ``query(_qid, _qv)``:
    (_qid, _tid, _dist, _tlabel, _rank), nearest first, ties by smaller _tid.

    Ids are of any orderable type and name their rows; vectors are arrays of doubles of one width.
    Rows with a null id or vector take no part. Fewer than k references give fewer rows.
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric}")
    spark = query.sparkSession
    ship_package(spark)
    q_type, t_type = query.schema["_qid"].dataType.simpleString(), ref.schema["_tid"].dataType.simpleString()
    query = query.where("_qid is not null and _qv is not null").select("_qid", "_qv")
    label = F.coalesce(F.col("_tlabel").cast("double"), F.lit(float("nan")))  # a missing label is one of its own, the last
    ref = ref.where("_tid is not null and _tv is not null").select("_tid", "_tv", label.alias("_tlabel"))
    need = k + int(exclude_self)
    twice = None
    if exclude_self:  # ids that name several rows: their queries leave them all out
        twice = saved(ref.groupBy(F.col("_tid").alias("_own")).count().where("count > 1").select("_own"), "twice")
    ref = saved(_few_of_equal(ref, k, need), "references")
    query = query.withColumn("_own", F.lit(None).cast(t_type))
    if twice is not None and not twice.isEmpty():
        query = query.drop("_own").join(twice, F.col("_qid") == F.col("_own"), "left")
    kinds = saved(query.select("_qv", "_own").distinct().withColumn("_kind", F.monotonically_increasing_id()), "kinds")
    found = _search(kinds.select(F.col("_kind").alias("_qid"), "_qv", "_own"), ref, need, metric)
    if found is None:
        return spark.createDataFrame([], f"_qid {q_type}, _tid {t_type}, _dist double, _tlabel double, _rank int")
    lists = found.groupBy(F.col("_qid").alias("_kind")).agg(F.collect_list(F.struct("_tid", "_dist", "_tlabel")).alias("_near"))  # ``need`` rows
    each = kinds.join(lists, "_kind").select(F.col("_qv").alias("_v"), F.col("_own").alias("_o"), "_near")
    rows = query.join(each, (F.col("_qv") == F.col("_v")) & F.col("_own").eqNullSafe(F.col("_o"))).select("_qid", F.inline("_near"))
    if exclude_self:
        rows = rows.where(F.col("_tid") != F.col("_qid"))
    return _first_k(rows, k)


def _search(query: DataFrame, ref: DataFrame, k: int, metric: str) -> DataFrame | None:
    """``nearest_rows`` for saved tables without its care for equal vectors; rows whose id is the query's ``_own`` are
    left out. Nothing without references."""
    spark = query.sparkSession
    q_type, t_type = query.schema["_qid"].dataType.simpleString(), ref.schema["_tid"].dataType.simpleString()
    schema = f"_qid {q_type}, _tid {t_type}, _dist double, _tlabel double"
    n, dim, least = ref.agg(F.count("*"), F.max(F.size("_tv")), F.min(F.size("_tv"))).first()
    if not n:
        return None
    if dim != least:
        raise ValueError("vectors of several widths")
    rows, least = max(1, BLOCK_BYTES // (dim * 8 + 16)), LEAST_ROWS[dim > FEW]
    if dim <= FEW:
        rows = min(rows, max(BLOCK_ROWS, 2 * math.isqrt(n)))
    count = min(MAX_BLOCKS, math.ceil(n / rows))
    sample = ref.select("_tv").orderBy(F.xxhash64("_tid")).limit(SAMPLE_ROWS if count > 1 else 1).toArrow()
    pivots = choose_pivots(vectors(sample.column(0)), min(PIVOTS, 4 * count) if count > 1 else 1, metric)
    dealt = ref.mapInArrow(_assign(pivots, metric), f"_tid {t_type}, _tv array<double>, _tlabel double, _cell int, _pd double, _norm double")
    if count > 1:
        dealt = dealt.repartitionByRange(count, "_cell", "_pd", "_tid").withColumn("_block", F.spark_partition_id().cast("bigint"))
    else:
        dealt = dealt.withColumn("_block", F.lit(0).cast("bigint"))
    blocks = saved(dealt)  # ranges come from a sample: fixed here for all readers
    entries = blocks.groupBy(F.col("_block").alias("block"), F.col("_cell").alias("cell")).agg(
        F.count("*").alias("n"), F.min("_pd").alias("lo"), F.max("_pd").alias("hi"), F.max("_norm").alias("norm"), F.min("_tid").alias("first")).collect()
    held = spark.sparkContext.broadcast(_Index(pivots, entries, metric))
    types = tuple(pa.schema(spark.createDataFrame([], f"x {t}").toArrow().schema).field(0).type for t in (q_type, t_type))
    work = _nearest(k, metric, types)
    kept = f"_qid {q_type}, _qv array<double>, _own {t_type}, _tau double, _blocks array<bigint>"
    query = query.withColumn("_tau", F.lit(None).cast("double"))
    # an own id can leave out ``k`` rows of a block at most
    seen = query.mapInArrow(_visits(held, k, False), kept)
    if len({e["block"] for e in entries}) == 1:
        return _first_k(_meet(seen, blocks, work, schema, least), k)
    seen = saved(seen)
    first = saved(_first_k(_meet(seen, blocks, work, schema, least), k))
    edge = first.where(F.col("_rank") == k).select("_qid", F.col("_dist").alias("_tau"), F.col("_tid").alias("_last"))
    more = (seen.drop("_tau").join(edge, "_qid", "left").select("_qid", "_qv", "_own", "_tau", "_last", F.col("_blocks").alias("_seen"))
            .mapInArrow(_visits(held, k, True), kept).where(F.size("_blocks") > 0))
    second = _meet(saved(more), blocks, work, schema, least)
    return _first_k(first.drop("_rank").unionByName(second), k)
