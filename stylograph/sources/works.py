"""Works from text files: one file, or a folder of chapters in numeric order.

``read_pieces`` reads files by byte ranges into ordered rows, however large a file or a work is; ``read_files`` and ``assemble``
give whole texts for those who need them in a row.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stylograph.operators.long_texts import PIECE_CHARS
from stylograph.operators.pieces import GLUE
from stylograph.session import lookup


# Bytes of a file that are read at once, and rows of a batch in a list of files. They change no result.
RANGE_BYTES = 4_000_000
ROWS_PER_BATCH = 10_000


def chapter_number(name: Column) -> Column:
    """The number after "Chapter-" in a file name, else 0."""
    return F.coalesce(F.regexp_extract(name, r"Chapter-(\d+)", 1).try_cast("decimal(38,0)"), F.lit(0))


def read_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """Text files below ``root``, one row each: path (relative), folder, name, text."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return files.select(F.col("value").alias("text"), _below(root, "_metadata.file_path").alias("path")).select(*_named(), "text")


def _below(root: str, path: str) -> Column:
    """A file's path relative to ``root``."""
    full = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/+", "/")
    base = re.sub(r"^[a-z0-9]+:/+", "/", root.rstrip("/"))
    return F.substring(full, F.lit(len(base) + 2), F.length(full))


def _named() -> tuple[Column | str, ...]:
    return "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.regexp_extract("path", r"[^/]*$", 0).alias("name")


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's path there."""
    local = re.sub(r"^(file:)?/+", "/", root)
    store, base = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(root)
    return store, base.rstrip("/")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _arrow_schema(fields: str) -> tuple[StructType, pa.Schema]:
    schema = StructType()
    for field in fields.split(", "):
        schema = schema.add(*field.split(" "))
    return schema, to_arrow_schema(schema)


def listed_files(spark: SparkSession, root: str, manifest: DataFrame, pattern: str = "*.md") -> DataFrame:
    """The files of the works of ``manifest(work_id, path)`` below ``root``, without reading them: work_id, path, name, bytes. Empty files
    are left out, as Spark's readers do. Each task lists the places of its rows, so the driver never holds a list of files."""
    schema, arrow = _arrow_schema("work_id string, path string, name string, bytes long")
    named = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern())

    def found(store: fs.FileSystem, base: str, place: str) -> list[fs.FileInfo]:
        steps = place.split("/") if place else []
        if any(step in ("", ".", "..") or _hidden(step) for step in steps):
            return []
        info = store.get_file_info("/".join([base, *steps]))
        if info.type == fs.FileType.Directory:
            infos = store.get_file_info(fs.FileSelector(info.path))
        else:
            infos = [info]
        return [i for i in infos if i.type == fs.FileType.File and i.size and named.fullmatch(i.base_name) and not _hidden(i.base_name)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            rows = []
            for work, place in zip(batch["work_id"].to_pylist(), batch["place"].to_pylist()):
                rows += [{"work_id": work, "path": i.path[len(base) + 1 :], "name": i.base_name, "bytes": i.size} for i in found(store, base, place)]
                if len(rows) >= ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, arrow)

    places = manifest.where("path IS NOT NULL").select("work_id", F.rtrim("path", F.lit("/")).alias("place"))
    return places.repartition(_partitions(spark)).mapInArrow(listed, schema)


def file_pieces(files: DataFrame, root: str, chars: int = PIECE_CHARS) -> DataFrame:
    """The texts of ``files(work_id, path, bytes, joins, ranges)`` in rows of up to ``chars`` characters: work_id, piece_no, text. A file that
    ``joins`` begins with a blank line; ``ranges`` is the number of byte ranges of the work's files before it.

    A file is read in byte ranges, each by any task; a character belongs to the range in which it begins."""
    schema, arrow = _arrow_schema("work_id string, piece_no long, text string")
    parts = -(-RANGE_BYTES // chars)  # of a range, at most

    def text_of(file: pa.NativeFile, start: int, size: int) -> str:
        file.seek(start)
        data = file.read(min(start + RANGE_BYTES, size) - start + 3)  # a character takes 4 bytes at most
        begins = [at for at in range(min(4, len(data))) if data[at] & 0xC0 != 0x80] if start else [0]
        end = RANGE_BYTES
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        data = data[begins[0] : end] if begins and begins[0] < RANGE_BYTES else b""
        return (data if start else data.removeprefix(codecs.BOM_UTF8)).decode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['path']}") as file:
                    text = text_of(file, row["start"], row["bytes"])
                glue = GLUE if row["joins"] and row["start"] == 0 else ""
                for part, at in enumerate(range(0, max(len(text), row["start"] == 0), chars)):
                    rows.append({"work_id": row["work_id"], "piece_no": row["range"] * parts + part, "text": (glue if part == 0 else "") + text[at : at + chars]})
                    held += chars
                if held >= RANGE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, arrow)

    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE_BYTES).cast("long"))
    cut = files.select("work_id", "path", "bytes", "joins", "ranges", F.posexplode(starts).alias("nth", "start"))
    cut = cut.select("work_id", "path", "bytes", "joins", "start", (F.col("ranges") + F.col("nth")).cast("long").alias("range"))
    return cut.repartition(_partitions(files.sparkSession)).mapInArrow(read, schema)


def _partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_pieces(spark: SparkSession, root: str, manifest: DataFrame, pattern: str = "*.md", chars: int = PIECE_CHARS) -> DataFrame:
    """The works of ``manifest(work_id, path)`` as ordered pieces (work_id, piece_no, text): the file at a work's path, or those directly
    in the folder at its path, in numeric order, then by name, joined by a blank line. Joined in order, the pieces are the
    work's text; no row holds more than ``chars`` characters and a blank line. Numbers ascend with gaps, counted from the files' sizes, so
    texts are neither kept nor moved."""
    by_number = Window.partitionBy("work_id").orderBy(chapter_number(F.col("name")), "name")
    files = listed_files(spark, root, manifest, pattern)
    ranges = F.ceil(F.col("bytes") / RANGE_BYTES)
    before = by_number.rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("work_id", "path", "bytes", (F.row_number().over(by_number) > 1).alias("joins"), F.coalesce(F.sum(ranges).over(before), F.lit(0)).alias("ranges"))
    return file_pieces(placed, root, chars)


def write_files(rows: DataFrame, root: str) -> int:
    """Write ``rows(path, text)`` as one file each below ``root``, a folder all executors share; a file that is there is replaced."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
                place = f"{base}/{path}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place, compression=None) as sink:
                    sink.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("path", "text").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def chapters(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files of every work of ``manifest(work_id, path)``: the file at its path, or those
    directly in the folder at its path. Columns work_id, name, text."""
    return placed_files(files, manifest).select("work_id", "name", "text")


def placed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files(path, folder, name, ...)`` with the works they belong to."""
    places = lookup(manifest.select("work_id", F.rtrim("path", F.lit("/")).alias("place")))
    placed = files.select("*", F.explode(F.array_distinct(F.array("path", "folder"))).alias("place"))
    return placed.join(places, "place").drop("place")


def assemble(chapters: DataFrame) -> DataFrame:
    """Whole texts (work_id, text): the chapters of a work in numeric order, then by name, joined by a blank line.

    Chapters are joined before anything is cleaned, at every size, since markup may run over their ends. A work is
    one row, and so bounded by the longest string Spark holds (2 GB).
    """
    placed = chapters.select("work_id", F.struct(chapter_number(F.col("name")).alias("n"), "name").alias("part"), "text")
    in_order = F.array_sort(F.collect_list(F.struct("part", "text")))
    return placed.groupBy("work_id").agg(F.array_join(F.transform(in_order, lambda c: c["text"]), GLUE).alias("text"))
