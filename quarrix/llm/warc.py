"""WARC archives compressed record by record with a dictionary of their own.

A Zstandard dictionary is built from a bounded sample of the records.  Each
archive begins with it in a skippable frame; every record follows as a frame of
its own, so a record can be read at its offset.  Archives are rolled by bytes
and written by Spark's text sink (one row, one file), which commits whole files
only and reaches any store Spark can; its line separator is an empty skippable
frame, which readers of the format pass over.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: magic numbers of Zstandard frames.
DICTIONARY_MAGIC, PADDING_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
PADDING = struct.pack("<II", PADDING_MAGIC, 0)
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_HEADER = re.compile(rb"([A-Za-z-]+): (.*?)\r\n")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its HTTP message, or a revisit that leaves out the payload."""
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + f"\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record; raises where it is broken."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.decode() for k, v in _HEADER.findall(head[10:] + b"\r\n")}
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few or too alike to train on, their bytes as a raw one."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def frames(archive: bytes) -> Iterator[tuple[bytes | None, memoryview | None]]:
    """The archive's parts in order: ``(dictionary, None)`` first, then ``(None, rest from a record on)``.

    The consumer sends back how many bytes the record's frame took.
    """
    at, view = 0, memoryview(archive)
    while at < len(archive):
        (magic,) = struct.unpack_from("<I", archive, at)
        if magic == FRAME_MAGIC:
            at += yield None, view[at:]
        elif magic in (DICTIONARY_MAGIC, PADDING_MAGIC):
            (size,) = struct.unpack_from("<I", archive, at + 4)
            if magic == DICTIONARY_MAGIC:
                yield archive[at + 8 : at + 8 + size], None
            at += 8 + size
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")


def read_archive(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record."""
    decompressor = zstandard.ZstdDecompressor()
    parts = frames(archive)
    item = next(parts, None)
    while item is not None:
        dictionary, rest = item
        took = None
        if dictionary is not None:
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else decompressor
        else:
            one = decompressor.decompressobj()
            raw, took = [], 0
            while not one.eof:
                piece = rest[took : took + (1 << 16)]
                if not piece:
                    raise ValueError("an archive ends inside a record")
                raw.append(one.decompress(piece))
                took += len(piece)
            took -= len(one.unused_data)
            yield parse_record(b"".join(raw))
        try:
            item = parts.send(took)
        except StopIteration:
            item = None


def with_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, html, refers_to``.

    Of pages with equal payloads (UTF-8 of the html; null counts as empty) of
    at least ``min_bytes``, the ones with the smallest id are responses, the
    others refer to it.  Rows with a null id are always responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = rows.where(F.octet_length("html") >= min_bytes).where("page_id IS NOT NULL").select("page_id", F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    again = keyed.join(first.hint("merge"), "digest").where("page_id > first_id")
    # Rows of one id may have several payloads: a row is told by its payload too.
    refs = again.select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()
    digest = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    return rows.withColumn("digest", digest).join(refs.hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def sample_dictionary(pages: DataFrame, size: int = 64 << 10, sample: int = 1000, sample_chars: int = 8192) -> bytes:
    """A dictionary from the records of the ``sample`` pages of the least hash; equal rows count once.

    Tasks send hashes first; the driver then fetches the pages up to the
    last of these, cut to ``sample_chars`` characters for this purpose alone, so
    what it receives is bounded whatever the number of tasks.  Without pages the
    dictionary is empty.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("hash", F.xxhash64("page_id", "url", "html"))
    least = [r.hash for r in rows.select("hash").orderBy("hash").limit(sample).collect()]
    if not least:
        return b""
    cut = F.struct("page_id", "url", F.substring("html", 1, sample_chars).alias("html"))
    found = rows.where(F.col("hash") <= least[-1]).groupBy("hash").agg(F.min(cut).alias("row")).orderBy("hash").select("row.*").collect()
    return train_dictionary([record_bytes(r.page_id, r.url, r.html.encode(), hashlib.sha256(r.html.encode()).hexdigest(), None) for r in found], size)


def write_archives(pages: DataFrame, path: str, dictionary: bytes = b"", level: int = 3, archive_bytes: int = 32 << 20) -> None:
    """Writes ``page_id, url, html, refers_to`` as archives of about ``archive_bytes`` at most.

    An archive is one row of the text sink and one file; it ends with the
    record that reaches the limit, so only a single record can make it longer.
    """

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=data)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        archive: list[bytes] = []
        held = 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                archive.append(compressor.compress(record_bytes(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to)))
                held += len(archive[-1])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(archive)], pa.binary())], names=["archive"])
                    archive, held = [], 0
        if archive:
            yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(archive)], pa.binary())], names=["archive"])

    made = pages.select("page_id", "url", "html", "refers_to").mapInArrow(compress, "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", PADDING.decode("ascii")).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``RECORD`` from the archives under ``path``.

    A response's payload is measured and hashed again and must agree with its
    header; a revisit's length and digest are those of the payload it left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for fields, block in read_archive(archive.as_py()):
                    page, refers = (fields.get(k, "")[len("<urn:x-page:") : -1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"page {page}: payload and header disagree")
                    rows.append((int(page) if page else None, size, digest, fields["WARC-Type"], int(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _RECORD.types, strict=True)], schema=_RECORD)

    archives = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    # Archives are small files: a task gets as many as spark.sql.files.maxPartitionBytes allows.
    return archives.select("content").mapInArrow(read, RECORD)
