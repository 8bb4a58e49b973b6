"""Token ids as seekable Zstandard files.

A file holds one frame per document, in ascending order of ids. Behind the frames stand two
skippable frames: the documents' ids (an Arrow stream), and the seek table of the seekable format,
with each frame's compressed and decompressed size and the low half of the XXH64 of its content. Any
Zstandard tool decompresses such a file as a whole; the reader here fetches the two tables from the
end and then only the frames of the documents asked.

Files are written by the executors through a file system both sides share, each under a temporary
name that is renamed at the end: a task that runs again replaces its file by the same content.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stylograph.llm.common import landed, partitions, scratch, text_of
from stylograph.llm.tokenize import encode, slices

#: Values of the seekable format and of skippable frames, fixed by their specification.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE, WITH_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
HEAD, ENTRY, FOOT = struct.Struct("<II"), np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")]), struct.Struct("<IBI")


class FrameWriter:
    """Writes one file; ``add`` takes a document's id and its ids' bytes."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.compress, self.ids, self.entries = sink, zstandard.ZstdCompressor(level=level).compress, [], []

    def add(self, doc_ids: pa.Array, documents: list[memoryview]) -> None:
        self.ids.append(doc_ids)
        for data in documents:
            frame = self.compress(data)
            self.entries.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.sink.write(frame)

    def close(self) -> None:
        stream = pa.BufferOutputStream()
        table = pa.table({"id": pa.chunked_array(self.ids)})
        with pa.ipc.new_stream(stream, table.schema) as writer:
            writer.write_table(table)
        index = stream.getvalue().to_pybytes()
        self.sink.write(HEAD.pack(SKIPPABLE_INDEX, len(index) + 4) + index + struct.pack("<I", len(index)))
        entries = np.array(self.entries, ENTRY).tobytes()
        self.sink.write(HEAD.pack(SKIPPABLE_TABLE, len(entries) + FOOT.size) + entries + FOOT.pack(len(self.entries), WITH_CHECKSUM, SEEKABLE))


class FrameReader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        count, flags, magic = FOOT.unpack(self._at(end - FOOT.size, FOOT.size))
        if magic != SEEKABLE or flags != WITH_CHECKSUM:
            raise ValueError("not a seekable file with checksums")
        table = end - FOOT.size - count * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(table, count * ENTRY.itemsize), ENTRY)
        length = struct.unpack("<I", self._at(table - HEAD.size - 4, 4))[0]
        with pa.ipc.open_stream(self._at(table - HEAD.size - 4 - length, length)) as stream:
            self.ids = stream.read_all()["id"].combine_chunks()
        self.starts = np.cumsum(self.entries["packed"], dtype=np.int64) - self.entries["packed"]

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def document(self, number: int) -> bytes:
        entry = self.entries[number]
        size = int(entry["size"])
        frame = self._at(int(self.starts[number]), int(entry["packed"]))
        data = zstandard.ZstdDecompressor().decompress(frame, max_output_size=size) if size else b""
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {number} does not match its checksum")
        return data


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None
) -> DataFrame:
    """Encode ``docs`` and write them in ascending order of id; returns the landed manifest: file_no, path,
    documents, tokens, start (tokens in all files before it).

    Null texts count as empty; null ids come first; rows that repeat an id follow each other in the order of
    their texts. No document, no file."""
    ordered = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ordered = ordered.repartitionByRange(files or partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    schema = StructType().add("file_no", "integer").add("path", "string").add("documents", "long").add("tokens", "long")
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        number, tokens, writer = context.partitionId(), 0, None
        path = f"{root}/tokens-{number:06d}.zst"
        temporary = f"{root}/.tokens-{number:06d}-{context.taskAttemptId()}"
        for batch in (part for whole in batches for part in slices(whole, "text")):
            if writer is None:
                store.create_dir(root, recursive=True)
                writer = FrameWriter(store.open_output_stream(temporary, compression=None))
            ids, bounds = encode(batch["text"], tokenizer_path, end_id)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            writer.add(batch["id"], [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
            tokens += len(ids)
        if writer:
            writer.close()
            writer.sink.close()
            store.move(temporary, path)
            uri = folder.split("://")[0] + "://" + path if "://" in folder else path
            yield pa.RecordBatch.from_pylist([{"file_no": number, "path": uri, "documents": len(writer.entries), "tokens": tokens}], arrow)

    manifest = landed(ordered.mapInArrow(write, schema), "manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, id_type, id_col: str = "doc_id", wanted: list | None = None) -> DataFrame:
    """The documents of the files: id, start, n_tokens, ids (binary). With ``wanted`` only the frames of
    those ids are fetched; their starts are the same."""
    schema = StructType().add(id_col, id_type).add("start", "long").add("n_tokens", "long").add("ids", "binary")
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    reader = FrameReader(source)
                    sizes = reader.entries["size"].astype(np.int64) // 4
                    starts = first + np.cumsum(sizes) - sizes
                    chosen = np.arange(len(sizes))
                    if wanted is not None:
                        chosen = np.flatnonzero(pa.compute.is_in(reader.ids, pa.array(wanted, reader.ids.type)).to_numpy(zero_copy_only=False))
                    for at in range(0, len(chosen), 500):
                        part = chosen[at : at + 500]
                        data = pa.array([reader.document(n) for n in part.tolist()], pa.binary())
                        yield pa.RecordBatch.from_arrays([reader.ids.take(pa.array(part)), pa.array(starts[part]), pa.array(sizes[part]), data], schema=arrow)

    rows = manifest.select("path", "start")
    return rows.repartition(partitions(rows.sparkSession), "path").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` below the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, folder, tokenizer_path, id_col=id_col, **options)
    return read_token_files(manifest, docs.schema[id_col].dataType, id_col)
