"""Document scores by prediction by partial matching over bytes.

The model is a context trie of depth ``ORDER``: for each context of up to 5 preceding bytes, the
counts of the bytes that follow it in the training texts. A context shorter than that counts a byte
once for each next longer context that knows it (update exclusion). A byte is coded in its longest known
context; where it was not seen there, the escape of method D (a context with q different
successors among n escapes with q / 2n) leads to the next shorter context, from which the bytes that
the longer one knows are excluded. Below order 0 the remaining bytes are equally likely. A text is its
bytes and an end symbol; the score is the sum of log10 probabilities, which is its code length.

The code length of a byte is a function of its *gram*, the byte and the five before it. So texts are
gathered into chunks (about ``CHUNK_BYTES``), and what travels is each chunk's distinct grams:

1. every chunk gives its distinct grams with their training counts, in parts by the two latest bytes
   of the context (a part holds the subtree of an order-2 context); its words go along likewise;
2. parts of equal key are summed, in streams: the trie, split by order-2 context;
3. each part of the trie meets the chunks' parts of its key, one after the other, and answers with the
   grams' code lengths; only the counts of orders 0 and 1 (at most 65,536) are sent to all tasks;
4. the answers return to their chunk, which adds them up over its texts.

No task holds the whole trie, a whole key's chunks, or more than one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import textnp as T
from kiln.llm.common import ready, remainder, save
from kiln.llm.tokens import text_slices

ORDER = 5
CHUNK_BYTES = 16 << 20
#: Rows of about so many bytes are worked on at once.
SLICE_BYTES = 1 << 20
#: Bytes that UTF-8 never has: the end of a text, and what stands before its start.
END, BEFORE = 0xFF, 0xFE
#: Words are kept in so many parts by hash; their keys follow those of the grams.
WORD_PARTS = 512
WORDS = 1 << 16
_TEXT = -1
_PARTS = "key int, chunk bigint, items binary, counts binary"


def _press(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _unpress(x: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def _steps(x: np.ndarray) -> np.ndarray:
    """Ascending values as differences, which compress better."""
    return np.diff(x, prepend=x.dtype.type(0))


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 48-bit gram of every byte and of the end of each row: latest context byte highest, coded byte lowest."""
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    padded = np.full(len(data) + n_rows * (ORDER + 1), BEFORE, dtype=np.uint8)
    padded[np.arange(len(data)) + row * (ORDER + 1) + ORDER] = data
    ends = offsets[1:] + np.arange(1, n_rows + 1) * (ORDER + 1) - 1
    padded[ends] = END
    coded = np.ones(len(padded), dtype=bool)
    starts = offsets[:-1] + np.arange(n_rows) * (ORDER + 1)
    coded[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    at = np.flatnonzero(coded)
    out = padded[at].astype(np.uint64)
    for k in range(1, ORDER + 1):
        out |= padded[at - k].astype(np.uint64) << np.uint64(8 * (ORDER + 1 - k))
    return out


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each is there."""
    if not len(x):
        return x, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) runs of rows of about ``SLICE_BYTES``."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        yield first, min(end, n)
        first = min(end, n)


def _counted(items: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items, ascending, and their counts where ``held`` is false."""
    every, _ = _grouped(np.sort(items))
    train, n = _grouped(np.sort(items[~held]))
    counts = np.zeros(len(every), dtype=np.uint32)
    counts[np.searchsorted(every, train)] = n
    return every, counts


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, n = T.word_spans(data, offsets)
    return T.span_hashes(data, starts, ends), n


def _parts(chunk: int, data: np.ndarray, offsets: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
    found = []
    for first, end in _slices(offsets):
        some, own = data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        words, n_words = _words(some, own)
        found.append((_counted(grams(some, own), np.repeat(held[first:end], np.diff(own) + 1)),
                      _counted(words, np.repeat(held[first:end], n_words))))
    (every, counts), (every_word, word_counts) = (_merge([f[k] for f in found]) for k in (0, 1))
    keys = (every >> np.uint64(32)).astype(np.int64)
    rest = (every & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    shift = np.uint64(64 - (WORD_PARTS - 1).bit_length())
    for key, items, n in ((keys, rest, counts), (WORDS + (every_word >> shift).astype(np.int64), every_word, word_counts)):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(key[a]), chunk, _press(_steps(items[a:b])), _press(n[a:b].astype(np.uint32))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the partition: one row with the texts, and one for each part."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, held, texts, size = [], [], [], 0

    def out():
        nonlocal number, size
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        data = T.lower(np.frombuffer(b"".join(texts), dtype=np.uint8))
        flags = np.array(held, dtype=bool)
        known = np.array([i is not None for i in ids], dtype=bool)
        head = np.column_stack([[i if i is not None else 0 for i in ids], known, flags, lengths]).astype("<i8")
        rows = [(_TEXT, number, head.tobytes(), _press(data)), *_parts(number, data, offsets, flags)]
        number += 1
        size = 0
        ids.clear(), held.clear(), texts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                          names=["key", "chunk", "items", "counts"])

    for batch in batches:
        for first, some in text_slices(batch.column("text"), CHUNK_BYTES // 4):
            ids += batch.column("doc_id").slice(first, len(some)).to_pylist()
            held += batch.column("held_out").slice(first, len(some)).to_pylist()
            texts += some
            size += sum(map(len, some))
            if size >= CHUNK_BYTES:
                yield out()
    if ids:
        yield out()


def _kind(key: int):
    return np.uint64 if key >= WORDS else np.uint32


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    items, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(items, kind="stable")
    items, counts = items[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.zeros(0, np.int64)
    return items[first], (np.add.reduceat(counts, first) if len(items) else counts)


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of each key; rows come ordered by key. Sums are formed as rows come in."""
    key, parts, size = None, [], 0

    def out():
        items, counts = _merge(parts)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([_press(_steps(items))], pa.binary()), pa.array([_press(counts)], pa.binary()),
                                           pa.array([len(items)]), pa.array([int(counts.sum())])], names=["key", "items", "counts", "types", "tokens"])

    for batch in batches:
        for k, items, counts in zip(*(batch.column(c).to_pylist() for c in ("key", "items", "counts")), strict=True):
            if k != key:
                if key is not None:
                    yield out()
                key, parts, size = k, [], 0
            n = _unpress(counts, np.uint32).astype(np.int64)
            x = np.cumsum(_unpress(items, _kind(k)), dtype=_kind(k))[n > 0]
            parts.append((x, n[n > 0]))
            size += len(x)
            if len(parts) > 1 and size > 2 * len(parts[0][0]) + 100_000:
                parts = [_merge(parts)]
                size = len(parts[0][0])
    if key is not None:
        yield out()


def _low_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (latest byte, coded byte) of each part of the trie."""
    for batch in batches:
        for key, items in zip(*(batch.column(c).to_pylist() for c in ("key", "items")), strict=True):
            byte = np.cumsum(_unpress(items, np.uint32), dtype=np.uint32) & np.uint32(255)
            s = np.unique(byte)
            yield pa.RecordBatch.from_arrays([pa.array([key >> 8] * len(s), pa.int32()), pa.array(s, pa.int32())], names=["c", "s"])


class Order:
    """The contexts of one order within a part: sorted (context, byte) keys with counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, self.distinct = _grouped(keys >> np.uint32(8))
        first = np.cumsum(self.distinct) - self.distinct
        self.totals = np.add.reduceat(counts, first) if len(keys) else counts
        self.of = np.repeat(np.arange(len(self.contexts)), self.distinct)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def context(self, contexts: np.ndarray) -> np.ndarray:
        """Places of contexts, -1 where not known."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)


def _shorten(items: np.ndarray, order: int) -> np.ndarray:
    """(context, byte) keys of an order 2..ORDER from a part's items, whose context bytes 3.. stand before the coded byte."""
    drop = np.uint32(8 * (ORDER - order) + 8)
    return ((items >> drop) << np.uint32(8)) | (items & np.uint32(255)) if order > 2 else items & np.uint32(255)


def _shorter(keys: np.ndarray) -> np.ndarray:
    """(context, byte) keys without the context's earliest byte."""
    return ((keys >> np.uint32(16)) << np.uint32(8)) | (keys & np.uint32(255))


class Part:
    """The trie below one order-2 context, with the shared counts of orders 0 and 1."""

    def __init__(self, key: int, items: np.ndarray, counts: np.ndarray, one: np.ndarray):
        self.latest = key >> 8
        self.one, self.zero = one, (one > 0).sum(axis=0)
        self.orders: dict[int, Order] = {ORDER: Order(items, counts)}
        for k in range(ORDER - 1, 1, -1):
            self.orders[k] = Order(*_grouped(np.sort(_shorter(self.orders[k + 1].keys))))
        # what a context's known bytes count in the next shorter context
        self.above: dict[int, np.ndarray] = {}
        for k in range(ORDER, 1, -1):
            own = self.orders[k]
            if k > 2:
                at, _ = self.orders[k - 1].find(_shorter(own.keys))
                there = self.orders[k - 1].counts[at] if len(at) else own.counts
            else:
                there = self.one[self.latest][own.keys & np.uint32(255)]
            self.above[k] = np.bincount(own.of, weights=there, minlength=len(own.contexts)).astype(np.int64)

    def code(self, items: np.ndarray) -> np.ndarray:
        """log10 probability of the coded byte of each of the sorted ``items``."""
        out = np.zeros(len(items))
        left = np.arange(len(items))
        gone, gone_n = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)  # excluded: kinds, counts
        for k in range(ORDER, 1, -1):
            if not len(left):
                return out
            o = self.orders[k]
            keys = _shorten(items[left], k)
            at, hit = o.find(keys)
            c = o.context(keys >> np.uint32(8))
            known = c >= 0
            n = np.where(known, o.totals[c] if len(o.totals) else 0, 0) - gone_n
            q = np.where(known, o.distinct[c] if len(o.distinct) else 0, 0) - gone
            out[left[hit]] += np.log10((2 * o.counts[at[hit]] - 1) / (2 * n[hit])) if hit.any() else 0
            escape = known & ~hit & (q > 0)
            out[left[escape]] += np.log10(q[escape] / (2 * n[escape]))
            gone = np.where(known, o.distinct[c] if len(o.distinct) else 0, 0)[~hit]
            gone_n = np.where(known, self.above[k][c] if len(o.totals) else 0, 0)[~hit]
            left = left[~hit]
        byte = (items[left] & np.uint32(255)).astype(np.int64)
        kinds = (self.one[self.latest] > 0).sum()
        over = int(self.zero[self.one[self.latest] > 0].sum())
        for counts, below, below_n in ((self.one[self.latest], kinds, over), (self.zero, (self.zero > 0).sum(), 0)):
            if not len(left):
                return out
            n, q = counts.sum() - gone_n, (counts > 0).sum() - gone
            hit = counts[byte] > 0
            out[left[hit]] += np.log10((2 * counts[byte[hit]] - 1) / (2 * n[hit])) if hit.any() else 0
            escape = ~hit & (q > 0)
            out[left[escape]] += np.log10(q[escape] / (2 * n[escape]))
            left, byte = left[~hit], byte[~hit]
            gone, gone_n = np.full(len(left), below), np.full(len(left), below_n)
        out[left] -= np.log10(255 - (self.zero > 0).sum())
        return out


def _answers(one: np.ndarray):
    """Code lengths of grams and training counts of words, for each chunk's part; a key's model row comes first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, model = None, None
        for batch in batches:
            keys, chunks, answers = [], [], []
            for k, chunk, items, counts in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "items", "counts")), strict=True):
                x = np.cumsum(_unpress(items, _kind(k)), dtype=_kind(k))
                if chunk < 0:
                    n = _unpress(counts, np.int64)
                    key, model = k, ((x, n) if k >= WORDS else Part(k, x, n, one))
                    continue
                if k != key:  # the key is not in the training texts
                    none = np.zeros(0, np.int64)
                    key, model = k, ((np.zeros(0, np.uint64), none) if k >= WORDS else Part(k, np.zeros(0, np.uint32), none, one))
                if k < WORDS:
                    answer = _press(model.code(x).astype(np.float32))
                else:
                    at = np.minimum(np.searchsorted(model[0], x), max(len(model[0]) - 1, 0))
                    answer = _press(np.where(model[0][at] == x, model[1][at], 0) if len(model[0]) else np.zeros(len(x), np.int64))
                keys.append(k)
                chunks.append(chunk)
                answers.append(answer)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(chunks), pa.array(answers, pa.binary())], names=["key", "chunk", "answer"])
    return work


def _chunk_scores(head: np.ndarray, data: np.ndarray, code: np.ndarray, count: np.ndarray, tokens: int, types: int, train_docs: int) -> pa.RecordBatch:
    lengths = head[:, 3]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    runs = [(first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]) for first, end in _slices(offsets)]
    every, _ = _grouped(np.sort(np.concatenate([_grouped(np.sort(grams(some, own)))[0] for _, _, some, own in runs])))
    every_word = np.unique(np.concatenate([np.unique(_words(some, own)[0]) for _, _, some, own in runs]))
    scale = np.log10(tokens + types + 1)
    score, base, known, n_words = (np.zeros(len(head), dtype=t) for t in (float, float, np.int64, np.int64))
    for first, end, some, own in runs:
        g = grams(some, own)
        row = np.repeat(np.arange(first, end), np.diff(own) + 1)
        for a in range(0, len(g), 1 << 16):  # place and gram in one number: sorted look-ups
            x = np.sort((g[a:a + (1 << 16)] << np.uint64(16)) | np.arange(len(g[a:a + (1 << 16)]), dtype=np.uint64))
            kinds, n = _grouped(x >> np.uint64(16))
            value = np.repeat(code[np.searchsorted(every, kinds)], n)
            low = int(row[a])
            part = np.bincount(row[a + (x & np.uint64(0xFFFF)).astype(np.int64)] - low, weights=value)
            score[low:low + len(part)] += part
        words, n = _words(some, own)
        c = count[np.searchsorted(every_word, words)] if len(words) else np.zeros(0, np.int64)
        n_words[first:end] = n
        base[first:end] = np.bincount(T.row_of(n), weights=np.log10(c + 1) - scale, minlength=end - first) + np.log10(train_docs + 1) - scale
        known[first:end] = np.bincount(T.row_of(n), weights=c > 0, minlength=end - first).astype(np.int64) + (train_docs > 0)
    return pa.RecordBatch.from_arrays([pa.array(head[:, 0], pa.int64(), mask=head[:, 1] == 0), pa.array(head[:, 2] == 1), pa.array(n_words + 1), pa.array(known),
                                       pa.array(np.full(len(head), tokens)), pa.array(base), pa.array(score)],
                                      names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _score(tokens: int, types: int, train_docs: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, code, count = None, None, [], []

        def out():
            head = np.frombuffer(text[0], dtype="<i8").reshape(-1, 4)
            return _chunk_scores(head, _unpress(text[1], np.uint8), np.concatenate([np.zeros(0, np.float32), *code]).astype(np.float64),
                                 np.concatenate([np.zeros(0, np.int64), *count]), tokens, types, train_docs)

        for batch in batches:  # ordered by chunk and key, the texts first
            for k, chunk, items, answer in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "items", "answer")), strict=True):
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, code, count = chunk, [], []
                if k == _TEXT:
                    text = (items, answer)
                elif k < WORDS:
                    code.append(_unpress(answer, np.float32))
                else:
                    count.append(_unpress(answer, np.int64))
        if now is not None:
            yield out()
    return work


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    The model learns from documents whose crc32 of the id as text, modulo ``folds``, is not ``held``. base_score
    is the add-one unigram score of words and an end per text. A null or empty text is its end alone; a
    null id counts as empty text in the crc32. Repeated rows are learnt and scored each. Other columns are
    ignored; an empty table gives an empty table.
    """
    ready(docs)
    out = remainder("doc_id", folds) == held
    rows = docs.select("doc_id", "text", out.alias("held_out"))
    train_docs = docs.select("doc_id").where(~out).count()
    gathered = save(rows.mapInArrow(_gather, _PARTS), "chunks")
    parts = gathered.where(F.col("key") != _TEXT)
    summed = (parts.select("key", "items", "counts").repartition("key").sortWithinPartitions("key")
              .mapInArrow(_sum_parts, "key int, items binary, counts binary, types bigint, tokens bigint"))
    trie = save(summed, "trie")
    low = trie.where(F.col("key") < WORDS).select("key", "items").mapInArrow(_low_orders, "c int, s int")
    one = np.zeros((256, 256), dtype=np.int64)
    for r in low.groupBy("c", "s").agg(F.count("*").alias("n")).collect():  # at most 256 * 256 rows
        one[r["c"], r["s"]] = r["n"]
    totals = trie.where(F.col("key") >= WORDS).agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = (totals[0] or 0) + (train_docs > 0), (totals[1] or 0) + train_docs
    asked = parts.unionByName(trie.select("key", F.lit(-1).cast("bigint").alias("chunk"), "items", "counts"))
    answers = save(asked.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_answers(one), "key int, chunk bigint, answer binary"), "answers")
    none = F.lit(None).cast("binary")
    back = (gathered.where(F.col("key") == _TEXT).select("key", "chunk", "items", F.col("counts").alias("answer"))
            .unionByName(answers.select("key", "chunk", none.alias("items"), "answer")))
    return back.repartition("chunk").sortWithinPartitions("chunk", "key").mapInArrow(
        _score(tokens, types, train_docs), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
