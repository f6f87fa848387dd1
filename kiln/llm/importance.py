"""Importance resampling towards a target distribution, with hashed n-grams and position-table CRC.

Method. The features of a text are its runs of 1 to ``n`` words, and a feature's bucket is the CRC-32
of its bytes modulo ``buckets``. CRC-32 is linear over XOR: the checksum of a span is the XOR of one
contribution per byte, which depends on the byte and on its distance from the span's end, and of a
constant of the length. ``_TABLE`` holds the contributions for distances below ``SPAN``, so the
spans of a slice are hashed by one gather and one ``bitwise_xor.reduceat``. A longer span is cut
into blocks of ``SPAN`` bytes from its end; each block's XOR is folded into the span's state,
moved on by ``SPAN`` zero bytes, block by block.

Bucket counts of the corpus and of the target are one array per task and one row per bucket after
that; log-ratio gains are at most ``buckets`` numbers whatever the corpus. A second pass sums the
gains of each document, Gumbel noise keyed by the document's id makes the highest scores a
weighted draw without replacement, and ranks come from a range-partitioned row index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.ordering import row_index
from kiln.llm import textnp as T
from kiln.llm.common import ready, save

#: Distances that the position table holds. Words are shorter as a rule.
SPAN = 32
_POLYNOMIAL = 0xEDB88320  # CRC-32 of zlib, reflected


def _byte_steps() -> np.ndarray:
    """CRC register after one byte, from zero: the usual table of 256."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_STEP = _byte_steps()


def _zeros(state: np.ndarray, n: int) -> np.ndarray:
    """The register after ``n`` more zero bytes."""
    for _ in range(n):
        state = (state >> np.uint32(8)) ^ _STEP[state & np.uint32(255)]
    return state


def _positions() -> np.ndarray:
    table = np.empty((SPAN, 256), dtype=np.uint32)
    table[0] = _STEP
    for d in range(1, SPAN):
        table[d] = _zeros(table[d - 1], 1)
    return table.reshape(-1)


#: Contribution of byte b at distance d from the end, at d * 256 + b.
_TABLE = _positions()
#: A register's four bytes after SPAN zero bytes: the move of a whole block.
_MOVE = [_zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), SPAN) for k in range(4)]


def _moved(state: np.ndarray) -> np.ndarray:
    return (_MOVE[0][state & np.uint32(255)] ^ _MOVE[1][(state >> np.uint32(8)) & np.uint32(255)]
            ^ _MOVE[2][(state >> np.uint32(16)) & np.uint32(255)] ^ _MOVE[3][state >> np.uint32(24)])


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    """What the preset register and the final inversion add, by length."""
    distinct, at = np.unique(lengths, return_inverse=True)
    out = np.empty(len(distinct), dtype=np.uint32)
    state, done = np.array([0xFFFFFFFF], dtype=np.uint32), 0
    for i, n in enumerate(distinct):
        blocks, rest = divmod(int(n) - done, SPAN)
        for _ in range(blocks):
            state = _moved(state)
        state, done = _zeros(state, rest), int(n)
        out[i] = state[0] ^ np.uint32(0xFFFFFFFF)
    return out[at]


def span_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the byte spans [start, end) of ``data``; spans may overlap or be empty."""
    lengths = ends - starts
    out = _length_constants(lengths) if len(lengths) else np.zeros(0, dtype=np.uint32)
    state = np.zeros(len(lengths), dtype=np.uint32)
    n_blocks = -(-lengths // SPAN)
    for k in range(int(n_blocks.max(initial=0)) - 1, -1, -1):  # the block that is k blocks before the end
        at = np.flatnonzero(n_blocks > k)
        hi = ends[at] - k * SPAN
        lo = np.maximum(starts[at], hi - SPAN)
        size = hi - lo
        first = np.cumsum(size) - size
        inner = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        distance = np.repeat(size, size) - 1 - inner
        part = np.bitwise_xor.reduceat(_TABLE[distance * 256 + data[np.repeat(lo, size) + inner]], first)
        state[at] = _moved(state[at]) ^ part
    return out ^ state


_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_WORD[0x41:0x5B] = True  # A-Z count as a-z


def feature_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of every feature, its row, words per row) of a slice of texts. Words are runs of bytes
    other than 00-2F, 3A-60 and 7B-7F after lower-casing A-Z."""
    n_rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(n_rows, dtype=np.int64)
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a word cannot go on over these places
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    low = T.lower(data)
    rows = T.row_of(counts)
    hashes, of = [span_crc32(low, starts, ends)], [rows]
    if n > 1 and len(starts):  # words one space apart, so that a run of words is one span
        size = ends - starts
        new_starts = np.cumsum(size + 1) - size - 1
        inner = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        joined = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
        joined[np.repeat(new_starts, size) + inner] = low[np.repeat(starts, size) + inner]
        new_ends = new_starts + size
        for k in range(2, n + 1):
            whole = np.flatnonzero(rows[:len(rows) - k + 1] == rows[k - 1:]) if len(rows) >= k else np.zeros(0, dtype=np.int64)
            hashes.append(span_crc32(joined, new_starts[whole], new_ends[whole + k - 1]))
            of.append(rows[whole])
    return np.concatenate(hashes), np.concatenate(of), counts


def _counter(n: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0)):
                h, _, _ = feature_hashes(data, offsets, n)
                total += np.bincount(h % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return work


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    ready(texts)
    return (texts.select("text").mapInArrow(_counter(n, buckets), "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln of the smoothed target share over the source share)."""
    all_s, all_t = (d.agg(F.sum("n")).first()[0] or 0 for d in (source, target))
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    c = (every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
         .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"]))
    up = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    return c.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("bigint").alias("gain"))


def _weigher(gains: np.ndarray, n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in T.slices(batch.column(1)):
                h, rows, words = feature_hashes(data, offsets, n)
                weight = np.zeros(end - first, dtype=np.int64)
                np.add.at(weight, rows, gains[h % np.uint32(len(gains))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(words), pa.array(np.bincount(rows, minlength=end - first)), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"])
    return work


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = 10_000, least_words: int = 20,
             seed: int = 2024) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words towards the texts of ``target``.

    One row per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_features, weight (sum of
    the gains of its features), score (weight plus Gumbel noise of the id, in thousandths), rank (from
    1 among the drawn, highest score first, ties by smaller doc_id; null if not drawn), n_words.

    A null or word-less text has no features and weight 0, and a text of too few words is never drawn.
    A null doc_id is hashed as empty text and comes last among ties; rows that repeat a doc_id are
    drawn one by one, in any order where they tie. An empty corpus gives an empty table, an empty
    target a draw towards the uniform distribution over buckets.
    """
    ready(docs)
    source = save(bucket_counts(docs, n, buckets), "source-counts")
    gains = np.zeros(buckets, dtype=np.int64)  # bounded by the number of buckets
    for r in bucket_gains(source, save(bucket_counts(target, n, buckets), "target-counts"), buckets).collect():
        gains[r["bucket"]] = r["gain"]
    weighed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_weigher(gains, n), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("bigint")
    scored = save(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scored")
    may = scored.where(F.col("n_words") >= least_words)
    k = may.count() * percent // 100
    # the row number splits ties, also those of one repeated id
    ranked = row_index(may.select("*", (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_null")), ["_down", "_null", "doc_id", "row"], "_place")
    drawn = ranked.withColumn("rank", F.when(F.col("_place") < k, F.col("_place") + 1).cast("bigint"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    names = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return drawn.select(names).unionByName(rest.select(names))
