"""WARC archives without repeated payloads: revisit records and their resolution.

Writing. Only headers (id, payload digest, length) are shuffled: by digest, to find the record that
keeps the payload; every other record of that digest becomes a revisit record of it. Records are
strings that Spark's text writer puts down with the record terminator (CR LF CR LF) as the line
separator, so archives are ordinary gzip WARC files in any store Spark writes to, committed by
Spark's committer. The payload moves from the input to the archive without a shuffle.

Reading. A gzip file is not split: one task reads it from its start, cut at the terminator, and
``_records`` puts the pieces together by Content-Length, so a payload may hold terminators or even
whole records. Revisit records are then joined to the responses that they refer to.

File format. WARC/1.1; a response's block is a small HTTP header and the payload, a revisit's the
HTTP header alone (profile identical-payload-digest). Fields hold no line breaks: CR and LF of a
URL are written as %0D and %0A. Text must be valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import ready, save, small

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Originals are broadcast up to so many rows (of about 70 bytes) and so many bytes of URLs; beyond, the join shuffles.
ORIGINALS = 200_000
URL_BYTES = 32 << 20

RECORD = ("record_id string, page_id bigint, url string, record_type string, refers_to_record string, payload_bytes bigint, "
          "payload_digest string, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1 of a binary column: each ten hex digits are eight digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0"), _HEX32, _BASE32) for i in (1, 11, 21, 31)]
    return F.concat(*parts)


def _record_id(page_id: Column, digest: Column, row: Column) -> Column:
    """A name-based URN; ``row`` keeps the records of repeated rows apart."""
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest, row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                          for x in ((F.lit("-"),) if i > 1 else ()) + (F.substring(h, i, n),)], F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record per row of ``pages`` (page_id, url, html; other columns are ignored) under ``path``.

    Of the rows with equal payloads (html in UTF-8, null as empty) of at least ``least`` bytes, the
    one with the largest page_id is the response and the others revisit it; shorter payloads are all
    responses. Rows that repeat the largest page_id are tied: one of them is the response. A null
    page_id is smaller than any other and is written without the field. An empty table gives an archive without records.
    """
    spark = ready(pages)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
                        payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    # saved: the row numbers stay the same, whoever reads them
    rows = save(rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload").cast("bigint")), "pages")
    heads = rows.where(F.col("bytes") >= least).select("page_id", "url", "digest", "bytes", "row")
    # partial aggregates meet, not rows: a payload held by a third of the pages is one row per task
    first = heads.groupBy("digest", "bytes").agg(
        F.count("*").alias("m"),
        F.max(F.struct(F.coalesce(F.col("page_id"), F.lit(-(2 ** 63))).alias("order"), F.col("page_id").isNotNull().alias("has"), -F.col("row"), "page_id", "url", "row")).alias("kept"))
    first = save(first.where("m > 1").select("digest", "bytes", F.col("kept.page_id").alias("kept_page"), F.col("kept.url").alias("kept_url"),
                                             F.col("kept.row").alias("kept_row")), "originals")
    url_bytes = first.agg(F.sum(F.octet_length("kept_url"))).first()[0] or 0
    joined = rows.join(small(first, ORIGINALS) if url_bytes <= URL_BYTES else first, ["digest", "bytes"], "left")
    revisit = F.col("kept_row").isNotNull() & (F.col("kept_row") != F.col("row"))
    http = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), F.col("row"))),
        _field("WARC-Date", F.lit(DATE)), _field("WARC-Target-URI", F.col("url")), _field("X-Page-Id", F.col("page_id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _field("WARC-Profile", F.lit(PROFILE)),
            _field("WARC-Refers-To", _record_id(F.col("kept_page"), F.col("digest"), F.col("kept_row"))),
            _field("WARC-Refers-To-Target-URI", F.col("kept_url")), _field("WARC-Refers-To-Date", F.lit(DATE)))).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"), block)
    joined.select(lines.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Cuts the byte stream of archives into records by their Content-Length."""

    def __init__(self, keep_payload: bool):
        self.keep, self.head, self.rest = keep_payload, None, b""

    def feed(self, data: bytes) -> Iterator[tuple]:
        """Take the stream's next bytes; the records that end in them."""
        while True:
            if self.head is None:
                data = (self.rest + data).lstrip(b"\r\n")  # what is left of the terminator before
                at = data.find(END.encode())
                if at < 0:
                    self.rest = data
                    return
                self._start(data[:at])
                data, self.rest = data[at + 4:], b""
            taken = data[:self.wait]
            self.wait -= len(taken)
            self._take(taken)
            if self.wait:
                return
            data = data[len(taken):]
            yield self._record()
            self.head = None

    def _start(self, head: bytes) -> None:
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/1."):
            raise ValueError("archive: no record starts here")
        self.head = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            self.head[name.strip().lower().decode()] = value.strip().decode()
        self.wait = int(self.head["content-length"])
        self.front = b"" if self.head.get("content-type", "").startswith("application/http") else None
        self.sha, self.size, self.parts = hashlib.sha1(), 0, []

    def _take(self, data: bytes) -> None:
        if self.front is not None:  # still in the block's HTTP header
            self.front += data
            at = self.front.find(END.encode())
            if at < 0:
                return
            data, self.front = self.front[at + 4:], None
        self.sha.update(data)
        self.size += len(data)
        if self.keep:
            self.parts.append(data)

    def _record(self) -> tuple:
        h = self.head
        digest, response = h.get("warc-payload-digest", "").removeprefix("sha1:"), h["warc-type"] == "response"
        if response:
            found = base64.b32encode(self.sha.digest()).decode()
            if digest and digest != found:
                raise ValueError(f"archive: {h['warc-record-id']} does not have its payload digest")
            digest = found
        page = h.get("x-page-id")
        return (h["warc-record-id"], None if page is None else int(page), h.get("warc-target-uri"), h["warc-type"], h.get("warc-refers-to"),
                self.size if response else None, digest, b"".join(self.parts) if self.keep and response else None)


def _records(keep_payload: bool):
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(keep_payload)
        for batch in batches:
            out, held = [], 0
            for piece in batch.column(0):
                for record in reader.feed(piece.as_buffer().to_pybytes() + END.encode()):
                    out.append(record)
                    held += len(record[-1] or b"")
                if held > 8 << 20:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)
        if reader.head is not None or reader.rest:
            raise ValueError("archive: a record is cut off")
    return work


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records as they are in the archives (columns of ``RECORD``); a revisit has no payload of
    its own. Digests of responses are computed from the payloads read and must be those written."""
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"))
    return pieces.mapInArrow(_records(payload), RECORD)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to (the
    original's page_id for revisits), payload (of a revisit: its original's). A revisit whose
    original is not in the archives keeps its digest, with length, refers_to and payload null."""
    ready(spark.range(0))
    records = save(read_records(spark, path, payload), "records")
    kept = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("o_bytes"),
        *([F.col("payload").alias("o_payload")] if payload else []))
    wanted = records.where("record_type = 'revisit'").select("refers_to_record").distinct()
    kept = kept.join(wanted, "refers_to_record", "left_semi")
    joined = records.join(kept if payload else small(save(kept, "referred"), ORIGINALS), "refers_to_record", "left")
    return joined.select("page_id", "url", "record_type", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"), "payload_digest", "refers_to",
                         *([F.coalesce("payload", "o_payload").alias("payload")] if payload else []))


def rewrite_archives(spark: SparkSession, source: str, target: str, least: int = 0) -> None:
    """Resolve the revisits of the archives under ``source``, and write deduplicated archives with
    fresh headers under ``target``. Revisits without their original raise an error when the result is written."""
    rows = read_archives(spark, source)
    whole = F.when(F.col("payload").isNull(), F.raise_error(F.concat(F.lit("no original of payload "), F.col("payload_digest"))).cast("string")).otherwise(
        F.decode("payload", "UTF-8"))
    write_archives(rows.select("page_id", "url", whole.alias("html")), target, least)
