"""Repeated runs of lines, found by winnowing over line hashes.

A document is a sequence of lines that aren't blank, each known by a hash. A window is the shortest run of lines from some
line on that holds ``min_words`` words; from each window the line of the least hash is selected as its fingerprint.
A run of at least that many words that occurs twice holds a whole window, whose fingerprint is selected at both
places, so no such run is missed. Only windows whose fingerprint is selected at two positions or more go on. Of equal windows the first
one (by id, text and position) is the anchor; every later one is joined to it, never to all others, and the match is extended both ways,
line by line, along the pair's diagonal. Matched runs of at least ``min_words`` words are deleted at the later place.

So every window that occurred before is deleted, together with the lines around it that equal those around its
anchor, and the first occurrence of a line always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from stylograph.llm.common import landed, text_of
from stylograph.llm.tokenize import slices
from stylograph.session import lookup

MIN_WORDS = 50
#: Odd multipliers of the two halves of a window's hash.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


def sequence(text: str) -> tuple[list[int], list[int], list[int]]:
    """Hash, words and line number of each line that isn't blank; outer white space doesn't count."""
    hashes, words, numbers = [], [], []
    for number, line in enumerate(text.split("\n")):
        if line := line.strip():
            hashes.append(xxhash.xxh3_64_intdigest(line) - (1 << 63))
            words.append(len(line.split()))
            numbers.append(number)
    return hashes, words, numbers


def windows(hashes: list[int], words: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """(start, stop, selected position) of each window; of equal least hashes the last is selected."""
    total, stop = 0, 0
    for start in range(len(hashes)):
        while total < min_words and stop < len(hashes):
            total += words[stop]
            stop += 1
        if total < min_words:
            return
        yield start, stop, min(range(start, stop), key=lambda at: (hashes[at], -at))
        total -= words[start]


def window_hash(hashes: list[int]) -> bytes:
    halves = []
    for multiplier in MULTIPLIERS:
        value = len(hashes)
        for line in hashes:
            value = (value * multiplier + line) & MASK
            value ^= value >> 29
        halves.append(value.to_bytes(8, "little"))
    return b"".join(halves)


def _sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per document: id, version (hash of its text), its lines and its windows as arrays."""
    schema = StructType([docs.schema["id"], docs.schema["version"]])
    lists = {"hashes": LongType(), "words": IntegerType(), "numbers": IntegerType(), "starts": IntegerType(), "selected": IntegerType(), "keys": BinaryType()}
    for name, kind in lists.items():
        schema = schema.add(name, ArrayType(kind))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            columns = {name: [] for name in lists}
            for text in batch["text"].to_pylist():
                hashes, words, numbers = sequence(text)
                found = list(windows(hashes, words, min_words))
                row = (hashes, words, numbers, [w[0] for w in found], [w[2] for w in found], [window_hash(hashes[w[0] : w[1]]) for w in found])
                for name, values in zip(lists, row):
                    columns[name].append(values)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["version"], *(pa.array(columns[f.name], f.type) for f in list(arrow)[2:])], schema=arrow
            )

    return docs.select("id", "version", "text").mapInArrow(run, schema)


def _extended(pairs: DataFrame, min_words: int) -> DataFrame:
    """Line numbers (first, last) of the later document's runs that match along a diagonal."""
    schema = StructType([pairs.schema["id"], pairs.schema["version"]]).add("first", "integer").add("last", "integer")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts, lasts = [], [], []
            for at in range(batch.num_rows):
                own, other, words, numbers = (batch[c][at].values.to_numpy() for c in ("hashes", "other", "words", "numbers"))
                shift = batch["shift"][at].as_py()
                low, high = max(0, shift), min(len(own), len(other) + shift)
                same = np.concatenate([[False], own[low:high] == other[low - shift : high - shift], [False]])
                edges = np.flatnonzero(np.diff(same.astype(np.int8))) + low
                for start, stop in zip(edges[::2], edges[1::2]):
                    if words[start:stop].sum() >= min_words:
                        rows.append(at)
                        firsts.append(numbers[start])
                        lasts.append(numbers[stop - 1])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(take), batch["version"].take(take), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], schema=arrow)

    return pairs.mapInArrow(run, schema)


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, version and the runs to delete, an array of (first, last) line numbers; only documents that have any."""
    documents = landed(_sequences(rows.dropDuplicates(["id", "version"]), min_words), "line-sequences", compression="zstd")
    window = F.explode(F.arrays_zip("starts", "selected", "keys")).alias("w")
    found = documents.select("id", "version", "hashes", window).select(
        "id", "version", F.col("w.starts").alias("start"), F.col("w.selected").alias("at"), F.col("w.keys").alias("key"),
        F.element_at("hashes", F.col("w.selected") + 1).alias("fingerprint"),
    )
    # A position may be selected by several windows, which follow each other.
    selections = documents.select(F.explode(F.transform(F.array_distinct("selected"), lambda at: F.element_at("hashes", at + 1))).alias("fingerprint"))
    shared = lookup(landed(selections.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "fingerprints"))
    found = found.join(shared, "fingerprint", "left_semi").select("id", "version", "start", "key")

    place = F.struct("id", "version", "start")
    anchors = found.groupBy("key").agg(F.min(place).alias("anchor"), F.count("*").alias("n")).where("n > 1").select("key", "anchor")
    later = found.join(anchors, "key").where(place != F.col("anchor")).select(
        "id", "version", (F.col("start") - F.col("anchor.start")).alias("shift"),
        F.col("anchor.id").alias("anchor_id"), F.col("anchor.version").alias("anchor_version"),
    )
    diagonals = landed(later.distinct(), "diagonals")
    own = documents.select("id", "version", "hashes", "words", "numbers")
    other = documents.select(F.col("id").alias("anchor_id"), F.col("version").alias("anchor_version"), F.col("hashes").alias("other"))
    pairs = _meet(_meet(diagonals, other, "anchor_id", "anchor_version"), own, "id", "version")
    runs = _extended(pairs.select("id", "version", "shift", "hashes", "words", "numbers", "other"), min_words)
    return runs.groupBy("id", "version").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _meet(left: DataFrame, right: DataFrame, id_col: str, version: str, how: str = "inner") -> DataFrame:
    """Join on version and on id, null ids being equal."""
    named = right.select(*(F.col(c).alias(f"r_{c}" if c in (id_col, version) else c) for c in right.columns))
    met = (F.col(version) == F.col(f"r_{version}")) & F.col(id_col).eqNullSafe(F.col(f"r_{id_col}"))
    return left.join(named, met, how).drop(f"r_{id_col}", f"r_{version}")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, the text without its later repeated runs, and ``lines_removed``.

    Null texts count as empty and stay null; texts of fewer than ``min_words`` words never change. Blank lines within a run
    go with it. Rows that repeat id and text are one document and change alike; of rows that share an id, those with
    different texts are ordered by a hash of the text. Null ids come first. An existing column lines_removed is replaced."""
    version = F.xxhash64(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("id"), version.alias("version"), text_of(text_col).alias("text"))
    runs = lookup(landed(repeated_runs(rows, min_words), "repeated-runs"))
    marked = _meet(docs.withColumn("version_of_text", version), runs.select(F.col("id").alias(id_col), F.col("version").alias("version_of_text"), F.col("runs").alias("runs_of_text")), id_col, "version_of_text", "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda line, at: ~F.exists("runs_of_text", lambda r: at.between(r["first"], r["last"])))
    changed = F.col("runs_of_text").isNotNull()
    marked = marked.withColumn("kept_lines", F.when(changed, kept))
    removed = F.when(changed, F.size(lines) - F.size("kept_lines")).otherwise(F.lit(0))
    text = F.when(changed, F.array_join("kept_lines", "\n")).otherwise(F.col(text_col))
    others = [F.col(c) if c != text_col else text.alias(text_col) for c in docs.columns if c != "lines_removed"]
    return marked.select(*others, removed.alias("lines_removed"))
