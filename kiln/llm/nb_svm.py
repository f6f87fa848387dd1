"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes.

Features of a text are the distinct words, and the one- to three-grams of word shapes (runs of upper
case, lower case, digits and each other character, and whether the word repeats the one before),
hashed to ``DIMENSIONS`` places. Over all labelled training rows, each feature's log-count ratio

    r = log((a + p) / |a + p|) - log((a + q) / |a + q|)

of the documents of either class that have it is summed up in Spark. A text's vector is the r of its
features, scaled to length 1, with a constant for the bias. The weights are fitted on a bounded
sample of training rows (``FIT_ROWS`` of the smallest id hashes) by dual coordinate descent on the
hinge loss, and the margins become probabilities by a logistic fit on a fifth of the sample that
the weights do not see.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import textnp as T
from kiln.llm.common import ready, remainder, save, small

DIMENSIONS = 1 << 20
#: Rows that the weights are fitted on; the class statistics take all labelled rows.
FIT_ROWS = 8_000
SMOOTHING = 1.0
COST = 1.0
TOLERANCE = 0.01
#: Parts of the count vector that are summed separately, and partial sums of each part.
PARTS, SALTS = 64, 16

_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[48:58] = 48
_KIND[128:] = 97


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of each row, one row after the other, and how many each has."""
    starts, ends, n_words = T.word_spans(data, offsets)
    words = T.span_hashes(data, starts, ends)
    kinds = _KIND[data]
    keep = np.ones(len(kinds), dtype=bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    shapes = T.span_hashes(kinds[keep], upto[starts], upto[ends])
    rows = T.row_of(n_words)
    if len(words):
        again = np.zeros(len(words), dtype=bool)
        again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
        shapes = T.mix(shapes + again.astype(np.uint64) * np.uint64(0x51ED270B))
    h, of = [words], [rows]
    for size in (1, 2, 3):
        if len(shapes) >= size:
            g = np.full(len(shapes) - size + 1, size, dtype=np.uint64)
            for k in range(size):
                g = T.mix(g * np.uint64(3) + shapes[k:len(shapes) - size + 1 + k])
            whole = rows[:len(g)] == rows[size - 1:]
            h.append(g[whole])
            of.append(rows[:len(g)][whole])
    place = (np.concatenate(of).astype(np.uint64) << np.uint64(32)) | (np.concatenate(h) >> np.uint64(44))
    place = np.unique(place)
    return (place & np.uint64(0xFFFFFFFF)).astype(np.int64), np.bincount((place >> np.uint64(32)).astype(np.int64), minlength=len(offsets) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the feature counts of either class, as packed parts."""
    from pyspark import TaskContext

    counts, n = np.zeros((2, DIMENSIONS), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for batch in batches:
        for first, end, data, offsets in T.slices(batch.column("text")):
            label = batch.column("quality").slice(first, end - first).to_numpy()
            f, m = features(data, offsets)
            np.add.at(counts, (np.repeat(label, m), f), 1)
            n += np.bincount(label, minlength=2)
    if n.sum():
        yield _packed_counts(counts.reshape(2, PARTS, -1), np.arange(PARTS), TaskContext.get().partitionId() % SALTS)


def _packed_counts(counts: np.ndarray, parts: np.ndarray, salt: int) -> pa.RecordBatch:
    blobs = [zlib.compress(np.ascontiguousarray(counts[:, k]).tobytes(), 1) for k in range(len(parts))]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array(blobs, pa.binary())],
                                      names=["part", "salt", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of packed counts with equal (part, salt); rows come in that order."""
    key, total = None, None
    for batch in batches:
        for part, salt, blob in zip(*(batch.column(k).to_pylist() for k in ("part", "salt", "counts")), strict=True):
            if (part, salt) != key:
                if key is not None:
                    yield _packed_counts(total[:, None], np.array([key[0]]), key[1])
                key, total = (part, salt), np.zeros((2, DIMENSIONS // PARTS), dtype=np.int64)
            total += np.frombuffer(zlib.decompress(blob), dtype=np.int64).reshape(2, -1)
    if key is not None:
        yield _packed_counts(total[:, None], np.array([key[0]]), key[1])


def log_count_ratios(training: DataFrame) -> np.ndarray:
    """r of every feature, from all rows of ``training`` (text, quality)."""
    kind = "part int, salt int, counts binary"
    sums = training.select("text", "quality").mapInArrow(_count, kind)
    for salted in (True, False):
        sums = sums if salted else sums.withColumn("salt", F.lit(0))
        sums = sums.repartition(PARTS, "part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_add, kind)
    counts = np.zeros((2, PARTS, DIMENSIONS // PARTS), dtype=np.int64)
    for r in sums.collect():  # PARTS rows
        counts[:, r["part"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.int64).reshape(2, -1)
    smooth = counts.reshape(2, -1) + SMOOTHING
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    return np.where(counts.reshape(2, -1).sum(axis=0) > 0, ratio, 0.0)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in T.slices(batch.column("text")):
            f, m = features(data, offsets)
            parts = np.split(f.astype(np.int32), np.cumsum(m)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, end - first) for k in ("rank", "quality")]
                                             + [pa.array([p.tobytes() for p in parts], pa.binary())], names=["rank", "quality", "features"])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss machine; ``cost`` bounds each row's dual variable.

    Goes over the rows in random order, solving each row's dual variable exactly, until the projected
    gradients of a whole pass lie within ``TOLERANCE``.
    """
    w = np.zeros(DIMENSIONS + 1)
    alpha = np.zeros(len(rows))
    square = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(1)
    while len(rows):
        low, high = np.inf, -np.inf
        for i in rng.permutation(len(rows)):
            f, v, y = rows[i], values[i], labels[i]
            gradient = y * (w[f] @ v + w[-1]) - 1.0
            step = gradient
            if alpha[i] == 0:
                step = min(gradient, 0.0)
            elif alpha[i] == cost[i]:
                step = max(gradient, 0.0)
            low, high = min(low, step), max(high, step)
            if step:
                before = alpha[i]
                alpha[i] = min(max(before - gradient / square[i], 0.0), cost[i])
                change = (alpha[i] - before) * y
                w[f] += change * v
                w[-1] += change
        if high - low < TOLERANCE:
            break
    return w


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton steps on smoothed targets."""
    up, down = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margins * margins).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


def fit(training: DataFrame) -> dict:
    """The model from labelled rows (doc_id, text, quality): weights by feature, bias and probability scale.

    Without rows of both classes every text scores the smoothed share of label 1.
    """
    training = training.where("quality in (0, 1)")
    sizes = dict(training.groupBy("quality").agg(F.count("*")).collect())
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if len(sizes) < 2:
        return {"ratio": np.zeros(DIMENSIONS, np.float32), "weight": np.zeros(DIMENSIONS, np.float32), "bias": 0.0, "slope": 1.0,
                "offset": float(np.log(share / (1 - share)))}
    ratio = log_count_ratios(training)
    picked = training.select(F.xxhash64("doc_id").alias("rank"), "doc_id").orderBy("rank").limit(FIT_ROWS)
    cut = picked.agg(F.max("rank")).first()[0]
    rows = (training.select(F.xxhash64("doc_id").alias("rank"), "quality", "text").where(F.col("rank") <= cut)
            .mapInArrow(_feature_rows, "rank bigint, quality int, features binary").limit(2 * FIT_ROWS).collect())
    rows.sort(key=lambda r: (r["rank"], bytes(r["features"])))
    found = [np.frombuffer(bytes(r["features"]), dtype=np.int32) for r in rows]
    values = [ratio[f] / max(np.linalg.norm(ratio[f]), 1e-9) for f in found]
    labels = np.array([1.0 if r["quality"] else -1.0 for r in rows])
    learn = np.arange(len(rows)) % 5 != 0
    if len(set(labels[learn])) < 2:
        learn[:] = True
    some = np.flatnonzero(learn)
    cost = np.where(labels[some] > 0, COST, COST * max(1.0, (labels[some] > 0).sum() / max(1, (labels[some] < 0).sum())))
    w = dual_coordinate_descent([found[i] for i in some], [values[i] for i in some], labels[some], cost)
    margins = np.array([w[f] @ v + w[-1] for f, v in zip(found, values, strict=True)])
    test = ~learn if (~learn).any() and len(set(labels[~learn])) == 2 else learn
    slope, offset = _logistic(margins[test], labels[test])
    return {"ratio": ratio.astype(np.float32), "weight": (w[:-1] * ratio).astype(np.float32), "bias": float(w[-1]), "slope": slope, "offset": offset}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (probability of label 1) of each row of ``docs`` (doc_id, text); only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of DIMENSIONS floats, whatever the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, end, data, offsets in T.slices(batch.column(1)):
                f, n = features(data, offsets)
                row = np.repeat(np.arange(len(n)), n)
                r = m["ratio"][f].astype(np.float64)
                length = np.sqrt(np.bincount(row, weights=r * r, minlength=len(n)))
                margin = np.bincount(row, weights=m["weight"][f], minlength=len(n)) / np.maximum(length, 1e-9) + m["bias"]
                z = np.clip(m["slope"] * margin + m["offset"], -700, 700)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text), learnt from ``labels``
    (doc_id, quality) of documents outside the held-out fold (crc32 of the id as text, modulo ``folds``, is 0).

    Null and empty texts get the score of a text without features. Labels that are null, other than 0
    and 1, or of unknown documents are not used; a document with several labels counts once for each.
    Repeated rows score alike. Empty tables work: without documents there are no rows, without labels
    every score is 0.5. Other columns are ignored.
    """
    ready(docs)
    known = labels.select(F.col("doc_id").alias("of"), "quality").where(remainder("doc_id", folds) != 0).where("quality in (0, 1)")
    training = docs.select("doc_id", "text").join(small(save(known, "labels")), F.col("doc_id") == F.col("of")).select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    scored = score(docs, fit(training))
    return scored.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
