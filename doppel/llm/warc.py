"""WARC archives by way of a chunked record table.

A payload becomes rows ``(record, chunk number, characters)`` of bounded size, each with
the SHA-1 of the payload up to its end, carried on from chunk to chunk. Chunks are
yielded one after the other; beside the page's own row no more than one of them is held.
Chunk 0 opens the
record; further chunks are segments (``WARC-Type: continuation`` with
``WARC-Segment-Number``), the form the WARC standard has for payloads that are
cut. Spark's text writer turns the rows into gzip archives through the cluster's
own file system: a row is a header block or a block of content, and the writer's
separator ``CRLF CRLF`` is what the format puts after either. That writer makes one gzip
member a file, where the standard recommends one a record.

Reading goes the other way: a gzip file is read by one task from its start, and a
small state machine follows the ``Content-Length`` of each record, feeding the
SHA-1 of a payload chunk by chunk.

Of payloads that are equal (SHA-1 and length) and have at least
``min_revisit_bytes`` bytes, the record with the smallest id is the response and
the others are revisits that carry no content.

Defined cases: a null payload counts as empty; a null url is written as ``-``.
Repeated rows (one id several times) give one record each, also with different
payloads; rows that carry the response's id are responses themselves. With
``null_ids`` rows with a null id are records under a generated identifier and have a
null id when read back: a revisit if an id has the same payload, else a response with
its content, as a revisit could not name another null id. Without it they are left
out. Further columns are not read. An empty table gives archives without records and
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import Scratch, workers_find_package

CHUNK_CHARS = 1 << 18
SEP = "\r\n\r\n"
# Names of the WARC format.
VERSION = "WARC/1.1"
# a record whose page has no id
NO_ID = "x-page-without-id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _payloads(pages: DataFrame, id_col: str, payload_col: str, null_ids: bool, *more: Column) -> DataFrame:
    src = (pages if null_ids else pages.where(F.col(id_col).isNotNull())).select(
        F.col(id_col).cast("long").alias("id"), *more, F.coalesce(payload_col, F.lit("")).alias("payload"))
    return src.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "sha", F.unhex(F.sha1(F.col("payload").cast("binary"))))


def payload_digests(pages: DataFrame, id_col: str, payload_col: str, null_ids: bool = False) -> DataFrame:
    """``id, payload_bytes, sha`` of the full payload."""
    return _payloads(pages, id_col, payload_col, null_ids).select("id", "payload_bytes", "sha")


def record_chunks(pages: DataFrame, revisits: DataFrame, id_col: str, url_col: str, payload_col: str,
                  chunk_chars: int = CHUNK_CHARS, null_ids: bool = False) -> DataFrame:
    """The chunked record table: ``id, url, refers_to, payload_bytes, sha, n_chunks, chunk, content, digest``.

    ``sha`` is the digest of the whole payload, ``digest`` that of its part up to the chunk's end.

    ``revisits`` (``id, sha, payload_bytes, refers_to``, one row each) is joined to the
    pages by id and payload, which is the only time that payloads are moved. Content
    is cut at code points.
    """
    workers_find_package(pages.sparkSession)
    src = _payloads(pages, id_col, payload_col, null_ids, F.coalesce(url_col, F.lit("-")).alias("url"))
    r = revisits.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), F.col("payload_bytes").alias("_bytes"), "refers_to")
    joined = src.join(r, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
                      & (F.col("payload_bytes") == F.col("_bytes")), "left")
    rows = joined.select("id", "url", "refers_to", "payload_bytes", "sha", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("").alias("payload"))
    return rows.mapInArrow(lambda batches: _cut(batches, chunk_chars), CHUNKS)


CHUNKS = ("id long, url string, refers_to long, payload_bytes long, sha binary, urn string, payload_digest string, n_chunks int, chunk int, "
          "content string, digest binary")
_CHUNKS = pa.schema([("id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("sha", pa.binary()),
                     ("urn", pa.string()), ("payload_digest", pa.string()), ("n_chunks", pa.int32()), ("chunk", pa.int32()), ("content", pa.string()),
                     ("digest", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], chunk_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows of chunks, some ``CHUNK_CHARS`` characters at a time."""
    made: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal made, held
        rows, made, held = made, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)

    for batch in batches:
        for i in range(batch.num_rows):
            id_, url, ref, n_bytes, whole, payload = (batch.column(c)[i].as_py() for c in range(batch.num_columns))
            urn = f"{NO_ID}:{uuid.uuid4().hex}" if id_ is None else f"x-page:{id_}"
            record = id_, " ".join(url.split()), ref, n_bytes, whole, urn, base64.b32encode(whole).decode()
            n, sha = max(1, -(-len(payload) // chunk_chars)), hashlib.sha1()
            for k in range(n):
                content = payload[k * chunk_chars:(k + 1) * chunk_chars]
                sha.update(content.encode())
                made.append((*record, n, k, content, sha.digest()))
                held += len(content) + 256
                if held >= CHUNK_CHARS:
                    yield flush()
            if ref is None and sha.digest() != whole:
                raise ValueError(f"the chunks of page {id_} are not its payload")
    if made:
        yield flush()


RECORD = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64())])


def _header(date: str) -> Column:
    """The header block of a chunk."""
    first, last, cut = F.col("chunk") == 0, F.col("chunk") + 1 == F.col("n_chunks"), F.col("n_chunks") > 1
    revisit = F.col("refers_to").isNotNull()
    lines = [F.lit(VERSION),
             F.concat(F.lit("WARC-Type: "), F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
             F.concat(F.lit("WARC-Record-ID: <urn:"), "urn", F.lit(":"), F.col("chunk").cast("string"), F.lit(">")),
             F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), "url"),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
             F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
             F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:x-page:"), F.col("refers_to").cast("string"), F.lit(":0>"))),
             F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
             F.when(cut, F.concat(F.lit("WARC-Segment-Number: "), (F.col("chunk") + 1).cast("string"))),
             F.when(cut & ~first, F.concat(F.lit("WARC-Segment-Origin-ID: <urn:"), "urn", F.lit(":0>"))),
             F.when(cut & last, F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("payload_bytes").cast("string"))),
             F.concat(F.lit("Content-Length: "), F.octet_length("content").cast("string"))]
    return F.concat_ws("\r\n", *lines)


def write_archives(chunks: DataFrame, path: str, date: str | None = None) -> None:
    """Chunks of a record stay in one task and in order, so an archive reads as a stream.

    A record's chunks come from one row of the table, hence from one task; the
    rows are not moved between cutting and writing. A task writes one file, so that no
    record is spread over two; how large files get is a matter of the table's partitions.
    ``date`` (UTC, ``YYYY-MM-DDThh:mm:ssZ``) is the records' WARC-Date, by default now.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    blocks = chunks.select(F.explode(F.array(_header(date), F.col("content"))).alias("value"))
    blocks.write.option("lineSep", SEP).option("compression", "gzip").option("maxRecordsPerFile", 0).text(path)


class _Reader:
    """Parses one archive from its rows and yields finished records.

    State between rows: the open header, the bytes of content still to come and
    the running digest. At most one row is held.
    """

    def __init__(self):
        self.buffer, self.left, self.record = b"", -1, None
        self.out: list[tuple] = []

    def feed(self, row: str) -> None:
        sep = SEP.encode()
        self.buffer += row.encode() + sep
        while self.buffer:
            if self.left < 0:
                if self.buffer == sep:
                    return
                head, found, rest = self.buffer.partition(sep)
                if not found:
                    return
                version, *lines = head.decode().split("\r\n")
                if version != VERSION:
                    raise ValueError(f"a record must begin with {VERSION}, not with {version[:40]!r}")
                fields = dict(x.split(": ", 1) for x in lines)
                self.buffer, self.left = rest, int(fields["Content-Length"])
                if fields["WARC-Type"] != "continuation":
                    self.finish()
                    self.record = fields
                    self.sha, self.n = hashlib.sha1(), 0
                elif self.record is None or fields["WARC-Segment-Origin-ID"] != self.record["WARC-Record-ID"]:
                    raise ValueError("a segment without its origin: " + fields["WARC-Record-ID"])
                continue
            take = self.buffer[:self.left]
            if take:
                self.sha.update(take)
                self.n += len(take)
                self.left -= len(take)
                self.buffer = self.buffer[len(take):]
            if self.left == 0:
                if len(self.buffer) < len(sep):
                    return
                if not self.buffer.startswith(sep):
                    raise ValueError("a record is longer than its Content-Length")
                self.buffer, self.left = self.buffer[len(sep):], -1

    def finish(self) -> None:
        """Close the open record, checked against its header."""
        if self.record is None:
            return
        f, self.record = self.record, None
        number = lambda urn: None if urn.split(":")[1] == NO_ID else int(urn.split(":")[2])
        digest, length = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["WARC-Payload-Length"])
        revisit = f["WARC-Type"] == "revisit"
        if not revisit and (digest, length) != (_digest(self.sha), self.n):
            raise ValueError("payload differs from its digest: " + f["WARC-Record-ID"])
        self.out.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], length, digest, f["WARC-Type"],
                         number(f["WARC-Refers-To"]) if revisit else None))

    def end(self) -> None:
        """The last row of a file may have ended without a separator, then one too many was added."""
        if self.buffer not in (b"", SEP.encode()) or self.left >= 0:
            raise ValueError("an archive ends inside a record")
        self.finish()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, reader = None, None
    for batch in batches:
        for path, row in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
            if path != file:
                done = reader
                file, reader = path, _Reader()
                if done:
                    done.end()
                    reader.out = done.out
            reader.feed(row)
        if reader:
            yield _records(reader.out)
            reader.out = []
    if reader:
        reader.end()
        yield _records(reader.out)


def _records(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r)) for r in out], RECORD)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record; the rows of a gzip file come to one task in file order."""
    workers_find_package(spark)
    rows = spark.read.option("lineSep", SEP).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.mapInArrow(_parse, "id long, url string, payload_bytes long, payload_digest string, "
                                    "record_type string, refers_to long")


def find_revisits(digests: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``id, sha, payload_bytes, refers_to``, one row each, of records whose payload a smaller id has too."""
    key = ["sha", "payload_bytes"]
    first = digests.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy(*key).agg(
        F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return digests.join(first, key).where("id IS NULL OR id > refers_to").select("id", *key, "refers_to").distinct()


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                       min_revisit_bytes: int = 0, chunk_chars: int = CHUNK_CHARS, null_ids: bool = False) -> DataFrame:
    """Write the archives and read them back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    digests = scratch.write(payload_digests(pages, id_col, payload_col, null_ids), "digests")
    revisits = find_revisits(digests, min_revisit_bytes)
    chunks = record_chunks(pages, revisits, id_col, url_col, payload_col, chunk_chars, null_ids)
    write_archives(chunks, f"{scratch.root}/archives")
    return read_archives(spark, f"{scratch.root}/archives").withColumnRenamed("id", id_col)
