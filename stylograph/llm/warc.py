"""WARC archives as Zstandard files, one frame per record, with the dictionary in front.

An archive begins with a skippable frame that holds the dictionary, trained on the first records of
the archive (a bounded sample that only affects size). The reader loads it, decodes the frames one
after the other, so its memory is bounded by one record, and validates each record: version line,
mandatory headers, content length, the closing blank lines, the length the HTTP headers state and the
digest of a response's payload.

A payload that several pages share is stored once, with the page of the largest id; the others are
revisit records that hold the HTTP headers only and refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stylograph.llm.common import landed, partitions, scratch, text_of
from stylograph.session import lookup

#: Fixed by the formats.
DICTIONARY_FRAME, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION, BREAK, PROFILE = b"WARC/1.1", b"\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "1970-01-01T00:00:00Z"
SAMPLES, DICTIONARY_BYTES, READ_BYTES = 64, 16_384, 1 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record; ``refers_to`` makes it a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return head + b"\r\n" + block + BREAK


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines)}


def parse(data: bytes) -> dict:
    """A record's page, type, refers_to, url, payload (None in a revisit), its length and digest; raises ValueError if it is not valid."""
    head, found, rest = data.partition(BREAK)
    version, *lines = head.split(b"\r\n")
    headers = _fields(lines)
    if version != VERSION or not found or any(name.lower() not in headers for name in MANDATORY):
        raise ValueError("not a WARC record with its mandatory headers")
    length = int(headers["content-length"])
    if len(rest) != length + len(BREAK) or not rest.endswith(BREAK):
        raise ValueError(f"the block has {len(rest) - len(BREAK)} bytes, its header says {length}")
    http, _, payload = rest[:length].partition(BREAK)
    stated = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != stated or sha1_base32(payload) != digest):
        raise ValueError("the payload does not match its length or digest")
    if kind not in ("response", "revisit"):
        raise ValueError(f"a record of type {kind}")
    name = lambda urn: urn and urn.removeprefix("<urn:page:").removesuffix(">")
    return {
        "page": name(headers["warc-record-id"]), "record_type": kind, "refers_to": name(headers.get("warc-refers-to")),
        "url": headers.get("warc-target-uri"), "payload": payload if kind == "response" else None,
        "payload_bytes": stated, "payload_digest": digest,
    }


def write_archive(sink, records: Iterator[bytes], level: int = 3) -> int:
    """Dictionary frame, then a frame per record; the number of records."""
    first = [data for _, data in zip(range(SAMPLES), records)]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, first)
    except zstandard.ZstdError:  # too few or too small records to train on
        dictionary = zstandard.ZstdCompressionDict(b"".join(first)[:DICTIONARY_BYTES] + b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    stored = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
    sink.write(struct.pack("<II", DICTIONARY_FRAME, len(stored)) + stored)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    count = 0
    for part in (first, records):
        for data in part:
            sink.write(compressor.compress(data))
            count += 1
    return count


def read_archive(source) -> Iterator[bytes]:
    """The records of an open archive, one frame each."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with its dictionary")
    stored = source.read(size)
    if stored.startswith(ZSTD_MAGIC):
        stored = zstandard.ZstdDecompressor().decompress(stored)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
    waiting = source.read(READ_BYTES)
    while waiting:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not waiting:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(waiting))
            waiting = frame.unused_data if frame.eof else source.read(READ_BYTES)
        waiting = waiting or source.read(READ_BYTES)
        yield b"".join(parts)


def with_originals(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """id, url, payload and refers_to: the largest id among the rows of an equal payload, null for that row itself
    and for payloads below ``least_bytes``."""
    payload = F.encode(text_of(payload_col), "utf-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digest = F.struct(F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"))
    shared = rows.where(F.octet_length("payload") >= least_bytes).groupBy(digest.alias("digest")).agg(F.max("id").alias("original"), F.count("*").alias("n"))
    shared = lookup(landed(shared.where("n > 1").select("digest", "original"), "shared-payloads"))
    joined = rows.withColumn("digest", digest).join(shared, "digest", "left")
    return joined.select("id", "url", "payload", F.when(~F.col("original").eqNullSafe(F.col("id")), F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write an archive per partition of ``pages``; returns the landed manifest: path, records.

    Null payloads count as empty. Rows that share the largest id of a payload are all responses. Null ids are
    written as ``null``. Without rows there is no archive."""
    rows = with_originals(pages, id_col, url_col, payload_col, least_bytes)
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    schema = StructType().add("path", "string").add("records", "long")
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        path, temporary = f"{root}/pages-{context.partitionId():06d}.warc.zst", f"{root}/.pages-{context.partitionId():06d}-{context.taskAttemptId()}"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for at in range(batch.num_rows):
                    yield record(*(batch[name][at].as_py() for name in ("id", "url", "payload", "refers_to")))

        made = records()
        first = next(made, None)
        if first is None:
            return
        store.create_dir(root, recursive=True)
        with store.open_output_stream(temporary, compression=None) as sink:
            count = write_archive(sink, _chain(first, made))
        store.move(temporary, path)
        uri = folder.split("://")[0] + "://" + path if "://" in folder else path
        yield pa.RecordBatch.from_pylist([{"path": uri, "records": count}], arrow)

    return landed(rows.mapInArrow(write, schema), "manifest")


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def read_archives(manifest: DataFrame, id_type, id_col: str = "page_id") -> DataFrame:
    """The records of all archives: id, url, payload (null in a revisit), payload_bytes, payload_digest, record_type, refers_to.
    A record that is not valid ends the job."""
    names = ("page", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = StructType().add("page", "string").add("url", "string").add("payload", "binary").add("payload_bytes", "long").add("payload_digest", "string").add("record_type", "string").add("refers_to", "string")
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch["path"].to_pylist()):
            store, name = fs.FileSystem.from_uri(path)
            waiting, size = [], 0
            with store.open_input_stream(name, compression=None) as source:
                for data in read_archive(source):
                    waiting.append(parse(data))
                    size += len(data)
                    if size > 4_000_000 or len(waiting) >= 2_000:
                        yield pa.RecordBatch.from_pylist(waiting, arrow)
                        waiting, size = [], 0
            if waiting:
                yield pa.RecordBatch.from_pylist(waiting, arrow)

    rows = manifest.select("path").repartition(partitions(manifest.sparkSession), "path").mapInArrow(read, schema)
    as_id = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(id_type)
    return rows.select(as_id("page").alias(id_col), *names[1:-1], as_id("refers_to").alias("refers_to"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` as archives below the shared folder and read them back."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"), id_col, **options)
    return read_archives(manifest, pages.schema[id_col].dataType, id_col)
