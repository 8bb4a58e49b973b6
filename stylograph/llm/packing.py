"""Best-fit packing of documents into sequences under several capacities.

Documents are encoded whole; one with more ids than a sequence holds is cut into full pieces, the
first piece being the shorter rest. Full pieces are sequences of their own. All other pieces are
vectors of demand (tokens, one document, attention cost = length squared) and are packed by vector
best-fit: largest first, each into the open bin that has room in every dimension and scores best.

Pieces are dealt by a hash into shards of about ``shard_items`` items, and each shard is packed by
one task; a shard wastes a few sequences at most, so the count stays within a fraction of a percent of one
packing of everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stylograph.llm.common import landed
from stylograph.llm.tokenize import binary_slices, encode, slices

#: Sequence numbers of full pieces begin here; those of packed ones are shard and bin.
FULL = 1 << 62


def pieces_of(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = False
) -> DataFrame:
    """The documents' pieces: id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and a number of
    their own, piece_key; with ``ids`` the ids (binary) too.

    Null texts count as empty. A document without any id, when there is no end id, has no piece. Other columns are dropped."""
    schema = StructType([docs.schema[id_col]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("piece_key", "long")
    schema = schema.add("ids", "binary") if ids else schema
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            found, bounds = encode(batch[text_col], tokenizer_path, end_id)
            sizes = np.diff(bounds)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            stop = sizes[row] - (counts[row] - 1 - piece) * capacity
            start = np.maximum(stop - capacity, 0)
            cuts = np.concatenate([bounds[row] + start, bounds[-1:]])
            data = memoryview(np.ascontiguousarray(found, "<u4")).cast("B")
            crcs = [crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            columns = [
                batch[id_col].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(stop - start),
                pa.array(crcs, pa.int64()), pa.array(np.arange(key, key + len(row))),
            ]
            out = pa.RecordBatch.from_arrays(columns + [binary_slices(found, cuts)] * ids, schema=arrow)
            key += len(row)
            for at in range(0, out.num_rows, 1_000):
                yield out.slice(at, 1_000)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def vector_best_fit(
    demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, score: str = "norm"
) -> np.ndarray:
    """The bin of each item (rows of ``demands``; none may exceed a capacity by itself).

    Items are taken by weighted relative size, largest first, ties in the order given. ``norm`` picks
    the bin whose residual after placing has the least weighted norm, ``dot`` the one whose residual has the
    greatest weighted dot-product with the demand; ties go to the bin opened first."""
    share = demands / capacities
    order = np.argsort(-(share * weights).sum(1), kind="stable")
    dimensions = range(demands.shape[1])
    least = demands.min(0) if len(demands) else capacities
    bins = np.empty(len(demands), np.int64)
    # A row per dimension, so that a bin's dimensions are compared and summed along whole rows.
    residual, number, opened, used = np.empty((demands.shape[1], 1024)), np.empty(1024, np.int64), 0, 0
    for item in order:
        demand = demands[item]
        room = residual[:, :used]
        fit = room[0] >= demand[0]
        for d in dimensions[1:]:
            fit &= room[d] >= demand[d]
        fits = np.flatnonzero(fit)
        if len(fits):
            free = room[:, fits]
            if score == "norm":
                at = fits[np.argmin(sum(((free[d] - demand[d]) / capacities[d]) ** 2 * weights[d] for d in dimensions))]
            else:
                at = fits[np.argmax(sum(free[d] / capacities[d] * share[item, d] * weights[d] for d in dimensions))]
        else:
            if used == residual.shape[1]:
                residual, number = np.concatenate([residual, np.empty_like(residual)], 1), np.concatenate([number, np.empty_like(number)])
            at = used
            residual[:, at], number[at] = capacities, opened
            used, opened = used + 1, opened + 1
        residual[:, at] -= demand
        bins[item] = number[at]
        if (residual[:, at] < least).any():  # nothing fits any more: close the bin
            residual[:, at : used - 1] = residual[:, at + 1 : used].copy()
            number[at : used - 1] = number[at + 1 : used].copy()
            used -= 1
    return bins


def pack(
    pieces: DataFrame, capacity: int = 1024, max_documents: int = 1024, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02), score: str = "norm", shard_items: int = 20_000,
) -> DataFrame:
    """``pieces`` with sequence_id and offset, gapless from 0 within each sequence.

    ``max_attention`` bounds the sum of squared piece lengths; by default it doesn't bind. A full piece,
    or one that exceeds a bound by itself, has a sequence of its own. Sequence numbers are unique but not dense. An empty table gives an empty result."""
    attention = capacity * capacity if max_attention is None else max_attention
    capacities, weighing = np.array([capacity, max_documents, attention], float), np.array(weights)
    alone = (F.col("length") >= capacity) | (F.col("length") * F.col("length") > attention)
    items = pieces.where(~alone)
    shards = max(1, -(-items.count() // shard_items))
    schema = StructType(pieces.schema.fields).add("sequence_id", "long").add("offset", "long")
    arrow = to_arrow_schema(schema)

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_key")
        length = table["length"].to_numpy().astype(float)
        bins = vector_best_fit(np.stack([length, np.ones(len(length)), length**2], 1), capacities, weighing, score)
        order = np.argsort(bins, kind="stable")
        sizes = length[order].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        first = np.concatenate([[True], np.diff(bins[order]) != 0])
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offset)).cast(arrow)

    packed = items.withColumn("shard", F.pmod(F.xxhash64("piece_key"), F.lit(shards))).groupBy("shard").applyInArrow(place, schema)
    full = pieces.where(alone).select("*", (F.lit(FULL) + F.col("piece_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, **options) -> DataFrame:
    """Encode, cut and pack: one row per piece of each document with its sequence and its place there.

    Pieces: id, piece (from 0), start (the document's ids before it), length, ids_crc32, sequence_id, offset; with ``ids`` the ids too.
    Rows that repeat an id are packed each. The pieces are landed once, so nothing is encoded twice; only their lengths and
    checksums are dealt to the packing tasks, and ids, if wanted, meet their places afterwards."""
    pieces = landed(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col, ids), "pieces", compression="zstd")
    packed = pack(pieces.drop("ids"), capacity, **options)
    if ids:
        packed = packed.join(pieces.select("piece_key", "ids"), "piece_key")
    return packed.drop("piece_key")
