"""Best-fit packing of token pieces into sequences, improved by local search.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut. Pieces
are dealt evenly into blocks of about ``BLOCK`` pieces, by a number that was drawn when the piece
was made, so no block depends on keys or grows with the table. A block is packed by best-fit
decreasing; then underfull bins trade pieces (move one, one for one, two for one, one for two)
whenever that raises the sum of squared fills, until no trade does; bins that empty disappear.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import ready, save
from kiln.llm.tokens import encoder, text_slices

CAPACITY = 2048
BLOCK = 8192


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of places in ``lengths``); every length is 1 to ``capacity``."""
    bins: list[list[int]] = []
    free: list[int] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    open_ = 0  # bit f: some bin has f free
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fit = open_ >> n
        if fit:
            f = n + (fit & -fit).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                open_ ^= 1 << f
            bins[b].append(i)
        else:
            b, f = len(bins), capacity
            bins.append([i])
            free.append(0)
        free[b] = f - n
        by_free[f - n].append(b)
        open_ |= 1 << (f - n)
    return _improve(bins, free, lengths, capacity)


def _improve(bins: list[list[int]], free: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Trades between underfull bins until none raises the sum of squared fills.

    A trade carries d > 0 tokens from a bin to one that is at least as full after it as the first was
    before; the receiver looks for the largest d that it has room for.
    """
    place: dict[int, dict[int, int]] = defaultdict(dict)  # length -> piece -> bin, of underfull bins
    mask = 0

    def add(b):
        nonlocal mask
        if free[b]:
            for i in bins[b]:
                place[lengths[i]][i] = b
                mask |= 1 << lengths[i]

    def drop(b):
        nonlocal mask
        for i in bins[b]:
            if place[lengths[i]].pop(i, None) is not None and not place[lengths[i]]:
                mask &= ~(1 << lengths[i])

    def find(low: int, high: int, b: int) -> int | None:
        """The longest piece of low..high tokens in a bin that is emptier than b, or as full."""
        some = mask & ((1 << (high + 1)) - 1)
        while some >> low:
            n = some.bit_length() - 1
            for i, other in place[n].items():
                if other != b and free[other] >= free[b]:
                    return i
            some ^= 1 << n
        return None

    for b in range(len(bins)):
        add(b)
    # fullest first: they need least
    work = sorted((b for b in range(len(bins)) if free[b]), key=lambda b: free[b], reverse=True)
    waiting = set(work)
    while work:
        b = work.pop()
        waiting.discard(b)
        if not free[b] or not bins[b]:
            continue
        trade = None
        got = find(1, min(free[b], capacity), b)
        if got is not None:
            trade = (lengths[got], [], [got])
        own = sorted(set(lengths[i] for i in bins[b]))
        first = {lengths[i]: i for i in bins[b]}
        for n in own:  # one of ours for a longer one
            got = find(n + 1, min(n + free[b], capacity), b)
            if got is not None and (trade is None or lengths[got] - n > trade[0]):
                trade = (lengths[got] - n, [first[n]], [got])
        if trade is None or trade[0] < free[b]:
            mine = sorted(bins[b], key=lambda i: lengths[i])[:16]
            for x in range(len(mine)):  # two of ours for one
                for y in range(x + 1, len(mine)):
                    n = lengths[mine[x]] + lengths[mine[y]]
                    if n >= capacity:
                        break
                    got = find(n + 1, min(n + free[b], capacity), b)
                    if got is not None and (trade is None or lengths[got] - n > trade[0]):
                        trade = (lengths[got] - n, [mine[x], mine[y]], [got])
        if trade is None:
            continue
        _, ours, theirs = trade
        other = place[lengths[theirs[0]]][theirs[0]]
        drop(b)
        drop(other)
        bins[b] = [i for i in bins[b] if i not in ours] + theirs
        bins[other] = [i for i in bins[other] if i not in theirs] + ours
        for c in (b, other):
            free[c] = capacity - sum(lengths[i] for i in bins[c])
            add(c)
            if free[c] and bins[c] and c not in waiting:
                waiting.add(c)
                work.append(c)
    return [b for b in bins if b]


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal): the pieces of each document's ids and end id.

    ``deal`` is an evenly spread number that does not depend on the row's values.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                ids, counts = enc.encode(texts, end)
                ids = ids.astype("<u4")
                at, row, start, length, crc = 0, [], [], [], []
                for r, n in enumerate(counts.tolist()):
                    for s in range(0, n, capacity):
                        k = min(capacity, n - s)
                        row.append(r)
                        start.append(s)
                        length.append(k)
                        crc.append(zlib.crc32(ids[at + s:at + s + k]))
                    at += n
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)).take(pa.array(row, pa.int64())),
                    pa.array([s // capacity for s in start], pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rng.integers(0, 1 << 62, len(row)))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    ready(docs)
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint")


def packed(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows that repeat a doc_id, or have none, are packed each
    for itself. Other columns are ignored; an empty table gives an empty table.
    """
    made = save(pieces(docs, tokenizer, end, capacity), "pieces")
    blocks = max(1, -(-made.count() // BLOCK))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["deal", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bin_of, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for b, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                bin_of[i], offset[i] = b, at
                at += lengths[i]
        rows["sequence_id"] = rows["block"] * (1 << 32) + bin_of
        rows["offset"] = offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = made.withColumn("block", F.col("deal") % F.lit(blocks))
    return dealt.groupBy("block").applyInPandas(work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
