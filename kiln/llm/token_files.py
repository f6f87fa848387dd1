"""Token-id files: documents' ids, each compressed on its own with a shared zstandard dictionary.

A file set is a folder with three Parquet tables, written by Spark's committing writer (a lost
executor or a repeated task leaves nothing behind):

``dictionary``  one row: hash (64 bits of SHA-256) and the zstandard dictionary, trained on the
                serialised id arrays of a bounded sample of documents (``SAMPLE``)
``blocks``      shard, block, first_doc, last_doc, n_docs, dict_hash, index, data; documents ascend by
                doc_id through shards and blocks. ``data`` is the documents' frames end to end (about
                ``BLOCK_BYTES``); ``index`` has five little-endian int64 per document: doc_id, 1 if it has
                one, end of its frame in ``data``, its first token's place in the shard, token count
``shards``      shard, n_docs, n_tokens

Ids are serialised as unsigned 16-bit integers if the vocabulary allows it, else 32-bit. A single
document is read by one filtered read of ``blocks`` and one decompression.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import ROW_GROUP_BYTES, ready, save, small
from kiln.llm.tokens import encoder, forget_encoders, text_slices

#: The dictionary is trained on so many documents (those of the smallest id hashes), on this many bytes of each.
SAMPLE = 512
SAMPLE_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 16
LEVEL = 1
BLOCK_BYTES = 1 << 18
#: Rows for each shard; a shard is one file.
SHARD_DOCS = 25_000

_BLOCK = "shard int, block int, first_doc bigint, last_doc bigint, n_docs int, n_tokens bigint, dict_hash bigint, index binary, data binary"


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def dictionary_hash(dictionary: bytes) -> int:
    return int.from_bytes(hashlib.sha256(dictionary).digest()[:8], "little", signed=True)


def train_dictionary(docs: DataFrame, tokenizer: str, end: int) -> bytes:
    """The shared dictionary; empty if there is too little text to train on."""
    import zstandard

    order = F.xxhash64("doc_id")
    picked = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(order, "doc_id").limit(SAMPLE).collect()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                ids, counts = enc.encode(texts, end)
                parts = np.split(ids.astype(_kind(enc.vocabulary)), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)),
                                                  pa.array([p.tobytes()[:SAMPLE_BYTES] for p in parts], pa.binary())], names=["doc_id", "sample"])

    rows = docs.select("doc_id", "text").where(F.col("doc_id").isin(picked)).mapInArrow(work, "doc_id bigint, sample binary")
    samples = [bytes(r[1]) for r in rows.orderBy("doc_id", "sample").limit(2 * SAMPLE).collect()]
    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 8:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples
        return b""


def _frames(docs: DataFrame, tokenizer: str, end: int, dictionary: bytes) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared is not None:
            shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(**({} if shared is not None else {"level": LEVEL}), dict_data=shared, write_dict_id=False)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                ids, counts = enc.encode(texts, end)
                flat, at, out = ids.astype(_kind(enc.vocabulary)), 0, []
                for n in counts.tolist():
                    out.append(press.compress(flat[at:at + n]))
                    at += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(counts), pa.array(out, pa.binary())],
                                                 names=["doc_id", "n_tokens", "frame"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n_tokens bigint, frame binary")


def _to_blocks(dict_hash: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_encoders()
        shard, block, place = TaskContext.get().partitionId(), 0, 0
        ids, frames, counts = [], [], []

        def out():
            nonlocal block, place
            n = np.array(counts, dtype="<i8")
            upto = np.cumsum(n)
            known = [i is not None for i in ids]
            index = np.column_stack([[i if i is not None else 0 for i in ids], known, np.cumsum([len(f) for f in frames]), place + upto - n, n]).astype("<i8")
            named = [i for i in ids if i is not None]
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([min(named, default=None)], pa.int64()),
                pa.array([max(named, default=None)], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([int(upto[-1])]),
                pa.array([dict_hash]), pa.array([index.tobytes()], pa.binary()), pa.array([b"".join(frames)], pa.binary())],
                names=["shard", "block", "first_doc", "last_doc", "n_docs", "n_tokens", "dict_hash", "index", "data"])
            block += 1
            place += int(upto[-1])
            ids.clear(), frames.clear(), counts.clear()
            return row

        size = 0
        for batch in batches:
            for i, n, f in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_tokens", "frame")), strict=True):
                ids.append(i)
                counts.append(n)
                frames.append(f)
                size += len(f)
                if size >= BLOCK_BYTES:
                    yield out()
                    size = 0
        if ids:
            yield out()
    return work


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order into the new folder ``path``.

    A null or empty text is its end id alone. Rows with a null doc_id come first; rows that repeat a
    doc_id lie side by side, the shortest first. An empty table gives a file set without blocks.
    Other columns are ignored.
    """
    spark = ready(docs)
    dictionary = train_dictionary(docs, tokenizer, end)
    code = dictionary_hash(dictionary)
    kind = _kind(encoder(tokenizer).vocabulary)
    spark.createDataFrame([(code, kind, tokenizer.rsplit("/", 1)[-1], end, bytearray(dictionary))],
                          "dict_hash bigint, kind string, tokenizer string, end int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = save(_frames(docs, tokenizer, end, dictionary), "frames")
    shards = max(1, -(-frames.count() // SHARD_DOCS))
    dealt = frames.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "n_tokens", F.xxhash64("frame"))
    dealt.mapInArrow(_to_blocks(code), _BLOCK).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/blocks")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    (blocks.groupBy("shard").agg(F.sum("n_docs").cast("bigint").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
     .coalesce(1).write.parquet(f"{path}/shards"))


def _decoded(dictionary: bytes, kind: str, code: int, digest: bool, wanted: Sequence[int] | None = None):
    """A function for mapInArrow: the documents of block rows, as ids or as their crc32."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        forget_encoders()
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for first, used, index, data in zip(*(batch.column(k).to_pylist() for k in ("before", "dict_hash", "index", "data")), strict=True):
                if used != code:
                    raise ValueError("the block was written with another dictionary")
                rows = np.frombuffer(index, dtype="<i8").reshape(-1, 5)
                begin = np.concatenate([[0], rows[:-1, 2]]).astype(np.int64)
                if wanted is not None:
                    keep = np.isin(rows[:, 0], wanted) & (rows[:, 1] == 1)
                    rows, begin = rows[keep], begin[keep]
                values = []
                for a, b in zip(begin.tolist(), rows[:, 2].tolist(), strict=True):
                    ids = np.frombuffer(press.decompress(data[a:b]), dtype=kind).astype("<u4")
                    values.append((len(ids), zlib.crc32(ids) if digest else ids.astype(np.int32).tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows[:, 0], pa.int64(), mask=rows[:, 1] == 0), pa.array(rows[:, 3] + first),
                    pa.array([n for n, _ in values], pa.int64()), pa.array([v for _, v in values], pa.int64() if digest else pa.list_(pa.int32()))],
                    names=["doc_id", "start", "n_tokens", "value"])
    return work


def read_token_files(spark: SparkSession, path: str, digest: bool = False, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (as decoded), and ``ids`` or, with ``digest``,
    ``ids_crc32``. With ``doc_ids`` only these documents' blocks are read."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    shards = spark.read.parquet(f"{path}/shards")
    totals = {r["shard"]: r["n_tokens"] for r in shards.collect()}  # one row for each file of the set
    before, at = [], 0
    for k in sorted(totals):
        before.append((k, at))
        at += totals[k]
    offsets = spark.createDataFrame(before, "shard int, before bigint")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    if doc_ids is not None:
        hit = F.lit(False)
        for i in doc_ids:
            hit = hit | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
        blocks = blocks.where(hit)
    work = _decoded(bytes(head["dictionary"]), head["kind"], head["dict_hash"], digest, None if doc_ids is None else list(doc_ids))
    rows = blocks.join(small(offsets), "shard").select("before", "dict_hash", "index", "data")
    value = "bigint" if digest else "array<int>"
    return rows.mapInArrow(work, f"doc_id bigint, start bigint, n_tokens bigint, value {value}").withColumnRenamed("value", "ids_crc32" if digest else "ids")
