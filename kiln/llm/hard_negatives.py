"""Hard negatives for contrastive training, by angular triangle filtering.

Method. Components become integers; each row keeps its norm and its angles to ``REFERENCES`` fixed
directions. For an anchor a and a row x the triangle inequality on the sphere gives, for each
direction r, |t_r(a) - t_r(x)| <= angle(a, x) <= min(t_r(a) + t_r(x), 2 pi - t_r(a) - t_r(x)).
The tightest of these angles, widened by ``SLACK`` for rounding, times both norms, bound the score
on both sides. A positive is scored only if its upper bound reaches the worst of the k best so far;
a negative only if its interval overlaps a window of allowed scores. What is scored is scored in
integers, so results are exact whatever the bounds let through.

Anchors meet all rows in blocks: one co-grouped task per (anchor block, row block), which keeps the
few best rows of each anchor; a window per anchor merges them. Blocks are dealt by a stored row
number, so no label, id or group of copies makes a block larger. More rows mean more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm.common import ready, save

REFERENCES = 8
#: Rows (smallest id hashes) among which the reference directions are looked for. They steer the
#: work, not the results.
SAMPLE_ROWS = 4096
#: Radians. Angles are stored in single precision (1.2e-7 near pi) and come from an arc cosine (1.5e-8).
SLACK = 2e-6
ROW_BLOCK = 65_536
ANCHOR_BLOCK = 8_192

_TABLE = "uid bigint, vec_id bigint, label bigint, q binary, norm double, angles binary"


def _integers(scale: int):
    """(vec_id, label, embedding) to (vec_id, label, q, n, top): components floor(scale * x) as 64-bit integers.
    Rows with a null or non-finite component are left out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            x = np.floor(np.nan_to_num(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), nan=np.nan,
                                       posinf=np.nan, neginf=np.nan) * scale)
            bad |= ~np.isfinite(x)
            if (np.abs(x[~bad]) >= 2.0 ** 31).any():
                raise OverflowError("a component times the scale does not fit 32 bits: scores would not fit 64")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            good = wrong[bounds[1:]] == wrong[bounds[:-1]]
            x = np.where(bad, 0, x).astype("<i4")
            q = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            top = [int(np.abs(x[a:b].astype(np.int64)).max(initial=0)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q, pa.binary()), pa.array(top, pa.int64())],
                                             names=["vec_id", "label", "q", "top"]).filter(pa.array(good))
    return work


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of 32-bit components as one matrix of doubles; shorter rows end in zeros."""
    rows = column.to_pylist()
    if all(len(r) == 4 * dim for r in rows):
        return np.frombuffer(b"".join(rows), dtype="<i4").reshape(len(rows), dim).astype(np.float64)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, :len(r) // 4] = np.frombuffer(r, dtype="<i4")
    return out


def reference_directions(m: np.ndarray) -> np.ndarray:
    """Up to ``REFERENCES`` unit rows of ``m``, each the farthest in angle from those before it."""
    norms = np.linalg.norm(m, axis=1)
    m = m[norms > 0] / norms[norms > 0, None]
    if not len(m):
        return m
    chosen = [0]
    nearest = m @ m[0]
    while len(chosen) < min(REFERENCES, len(m)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, m @ m[at])
    return m[chosen]


def _angles(references: np.ndarray, dim: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("q"), dim)
            norm = np.sqrt((m * m).sum(axis=1))
            cos = (m @ references.T) / np.where(norm > 0, norm, 1)[:, None]
            t = np.arccos(np.clip(cos, -1, 1)).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), batch.column("label"), batch.column("q"),
                                              pa.array(norm), pa.array([x.tobytes() for x in t], pa.binary())],
                                             names=["uid", "vec_id", "label", "q", "norm", "angles"])
    return work


def score_bounds(ta: np.ndarray, na: float, tx: np.ndarray, nx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner product of one row (angles ta, norm na) with each of many
    (angles tx: references x rows, norms nx). Zero rows get 0 and 0; no reference leaves |na nx|."""
    size = na * nx * (1 + 1e-9)
    if not len(tx):
        return -size, size
    both = ta[:, None] + tx
    near = np.abs(ta[:, None] - tx).max(axis=0).astype(np.float64) - SLACK
    far = np.minimum(both, np.float32(2 * math.pi) - both).min(axis=0).astype(np.float64) + SLACK
    low, high = np.cos(np.clip(far, 0, math.pi)), np.cos(np.clip(near, 0, math.pi))
    pad = 1e-9 * size
    return size * low - pad, size * high + pad


class _Block:
    """Rows of one block, by label, ready for scoring."""

    def __init__(self, t: pa.Table, dim: int, exact: bool):
        t = t.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("uid", "ascending")]).combine_chunks()
        self.uid, self.vec_id, self.label, self.norm = (t.column(k).to_numpy() for k in ("uid", "vec_id", "label", "norm"))
        m = _matrix(t.column("q"), dim)
        self.m = m if exact else m.astype(np.int64)  # doubles hold every score exactly, or integers do
        self.angles = np.frombuffer(b"".join(t.column("angles").to_pylist()), dtype="<f4").reshape(len(self.uid), -1).T.copy()

    def scores(self, anchor: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Integer scores of the rows ``at`` (within lo to hi)."""
        if 2 * len(at) > hi - lo:
            return (self.m[lo:hi] @ anchor).astype(np.int64)[at - lo]
        return (self.m[at] @ anchor).astype(np.int64)

    def best(self, at: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
        """Places in ``at`` of the k highest scores, ties by smaller id."""
        if len(s) > 4 * k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            keep = np.flatnonzero(s >= edge)
            return keep[np.lexsort((self.vec_id[at[keep]], -s[keep]))[:k]]
        return np.lexsort((self.vec_id[at], -s))[:k]


def _positives(dim: int, exact: bool, k: int):
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            b, a = _Block(rows, dim, exact), _Block(anchors, dim, exact)
            for i in range(len(a.uid)):
                lo, hi = np.searchsorted(b.label, a.label[i], "left"), np.searchsorted(b.label, a.label[i], "right")
                at = np.arange(lo, hi)
                at = at[b.uid[lo:hi] != a.uid[i]]
                if len(at) > k:
                    _, high = score_bounds(a.angles[:, i], a.norm[i], b.angles[:, at], b.norm[at])
                    first = at[np.argpartition(-high, k - 1)[:k]]
                    worst = b.scores(a.m[i], first, lo, hi).min()
                    at = at[high >= worst]
                if len(at):
                    s = b.scores(a.m[i], at, lo, hi)
                    for j in b.best(at, s, k):
                        out.append((int(a.uid[i]), int(b.vec_id[at[j]]), int(s[j])))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["uid", "positive_id", "positive_score"])
    return work


def _negatives(dim: int, exact: bool, k: int, low: int, high: int):
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            pos = dict(zip(anchors.column("uid").to_pylist(), anchors.column("scores").to_pylist(), strict=True))
            b, a = _Block(rows, dim, exact), _Block(anchors, dim, exact)
            n = len(b.uid)
            for i in range(len(a.uid)):
                windows = [(-((-low * p) // 100), high * p // 100) for p in pos[int(a.uid[i])]]
                if not (wanted := [w for w in windows if w[0] <= w[1]]):
                    continue
                lower, upper = score_bounds(a.angles[:, i], a.norm[i], b.angles, b.norm)
                keep = (upper >= min(w[0] for w in wanted)) & (lower <= max(w[1] for w in wanted))
                keep[np.searchsorted(b.label, a.label[i], "left"):np.searchsorted(b.label, a.label[i], "right")] = False
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                s = b.scores(a.m[i], at, 0, n)
                for slot, (w0, w1) in enumerate(windows):
                    fits = np.flatnonzero((s >= w0) & (s <= w1))
                    for j in fits[b.best(at[fits], s[fits], k)]:
                        out.append((int(a.uid[i]), slot, int(b.vec_id[at[j]]), int(s[j])))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["uid", "slot", "negative_id", "negative_score"])
    return work


def _meet(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, work, schema: str) -> DataFrame:
    """Every anchor block with every row block, each pair in one task of its own."""
    of = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(anchor_blocks * row_blocks, 20_000)
    anchors = anchors.select([F.col(c).alias(c) for c in anchors.columns])  # both sides come from one table
    left = anchors.withColumn("ab", of(anchor_blocks)).withColumn("rb", every(row_blocks)).repartition(tasks, "ab", "rb")
    right = rows.withColumn("rb", of(row_blocks)).withColumn("ab", every(anchor_blocks)).repartition(tasks, "ab", "rb")
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(work, schema)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                                     "negative_score bigint, positive_rank int")


def hard_negatives(vectors: DataFrame, anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels with low * p <= 100 * score <= high * p (p: the positive's score).

    ``vectors`` has vec_id, label, embedding (other columns are ignored); ``anchor`` is a condition on
    it. A score is the inner product of components floor(scale * x); higher first, ties by smaller
    vec_id. Result: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score, positive_rank (from 1).

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; an
    empty vector scores 0 with everything; shorter vectors end in zeros. Each row of a repeated
    vec_id is a row (and an anchor) of its own: it is only not its own positive. An anchor with
    fewer rows of its label has fewer positives; a negative positive's window is empty. An empty
    table gives an empty result. Components beyond 32 bits after scaling raise OverflowError.
    """
    spark = ready(vectors)
    given = vectors.withColumn("_anchor", F.coalesce(F.expr(anchor) if isinstance(anchor, str) else anchor, F.lit(False)))
    rows = given.where("vec_id is not null and label is not null and embedding is not null")
    # the flag travels with the label, so that the Arrow step keeps its three columns
    packed = rows.select(F.col("vec_id").cast("bigint"), (F.col("label").cast("bigint") * 2 + F.col("_anchor").cast("bigint")).alias("label"),
                         F.col("embedding").cast("array<double>").alias("embedding"))
    ints = packed.mapInArrow(_integers(scale), "vec_id bigint, label bigint, q binary, top bigint")
    ints = save(ints.withColumn("uid", F.monotonically_increasing_id()), "integers")
    n, n_anchors, dim, top = ints.agg(F.count("*"), F.sum(F.abs(F.col("label") % 2)), F.max(F.length("q")), F.max("top")).first()
    if not n or not n_anchors:
        return _empty(spark)
    dim = max(1, dim // 4)
    if dim * top * top >= 2 ** 63:
        raise OverflowError("scores would not fit 64 bits")
    exact = dim * top * top < 2 ** 53
    sample = ints.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(SAMPLE_ROWS).select("q").toArrow()
    directions = reference_directions(_matrix(sample.column("q"), dim))
    table = save(ints.mapInArrow(_angles(directions, dim), _TABLE), "angles")
    is_anchor = F.abs(F.col("label") % 2) == 1
    table = table.withColumn("is_anchor", is_anchor).withColumn("label", F.floor(F.col("label") / 2).cast("bigint"))
    cores = spark.sparkContext.defaultParallelism
    row_blocks = max(math.ceil(n / ROW_BLOCK), min(cores, math.ceil(n / 2048)))
    anchor_blocks = math.ceil(n_anchors / ANCHOR_BLOCK)
    rows, anchors = table.drop("is_anchor"), table.where("is_anchor").drop("is_anchor")

    found = _meet(anchors, rows, anchor_blocks, row_blocks, _positives(dim, exact, positives),
                  "uid bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id")
    best = save(found.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives), "positives")
    lists = best.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))),
                                                lambda x: x["positive_score"]).alias("scores"))
    found = _meet(anchors.join(lists, "uid"), rows, anchor_blocks, row_blocks, _negatives(dim, exact, negatives, low, high),
                  "uid bigint, slot bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("uid", "slot").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = anchors.select("uid", F.col("vec_id").alias("anchor_id"))
    return (ranked.join(best, ["uid", "slot"]).join(names, "uid")
            .select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score",
                    (F.col("slot") + 1).cast("int").alias("positive_rank")))


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """The registered query's reading of ``embeddings``: every seventh row's label moves on by one of
    ten, every fiftieth row is an anchor."""
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(embeddings.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
