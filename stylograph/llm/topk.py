"""Exact top-k search over an impact-ordered index, score at a time.

Vectors are turned into integers, dealt into blocks and indexed: a block's postings (vector, dimension,
value) are sorted into segments of descending quantised impact, the size of the value in ``LEVELS`` steps. A search works through a block's
segments from the greatest impact down, adding query weight x value to the accumulators. What a
vector can still gain is at most the next segment's impact times the query weights it has not been
paid for, so after each segment every score has a lower and an upper bound. Work on the block ends only when
the bounds prove that few vectors can be among the best k, or when the segments are used up; those
vectors are then rescored in exact integers, and the blocks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType

from stylograph.llm.common import landed

LEVELS = 6
#: Vectors in a block and queries in a chunk (about), for bounded memory; neither changes a result.
BLOCK, CHUNK = 4_096, 512
#: A block's work may end when at most this many times k vectors are still possible.
FEW = 8


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """id and floor(scale * x) of every component, as long. Rows with a null id, a null vector, or a null or
    non-finite component take no part; other columns don't either. A scaled component beyond 2^52 ends the job."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vector_col, lambda x: F.lit(float(scale)) * x.cast("double"))
    kept = rows.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).alias("id"), scaled.alias("scaled"))
    refused = F.raise_error(F.lit("a component is too large for exact scores")).cast("array<double>")
    held = F.when(F.forall("scaled", lambda x: F.abs(x) <= float(1 << 52)), F.col("scaled")).otherwise(refused)
    return kept.select("id", F.transform(held, lambda x: F.floor(x).cast("long")).alias("vector"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width; shorter vectors end with zeros."""
    lists = vectors.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(sizes, default=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block: ids, width, top (the greatest size of a value), and per segment the postings' slots (vector * width + dimension) and values."""
    id_type: DataType = vectors.schema["id"].dataType
    blocks = max(1, -(-vectors.count() // block))
    schema = StructType().add("block", "integer").add("ids", ArrayType(id_type)).add("width", "integer").add("top", "long")
    schema = schema.add("bounds", ArrayType(vectors.schema["vector"].dataType.elementType)).add("slots", "binary").add("values", "binary")
    arrow = to_arrow_schema(schema)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        values = _matrix(table["vector"])
        flat, size = values.ravel(), np.abs(values).ravel()
        top = int(size.max(initial=0))
        impact = -(-size * LEVELS // max(top, 1))
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        bounds = np.searchsorted(-impact[order], -np.arange(LEVELS, -1, -1))  # segment s: impact LEVELS - s
        row = {
            "block": key[0].as_py(), "ids": table["id"].to_pylist(), "width": values.shape[1], "top": top, "bounds": bounds.tolist(),
            "slots": order.astype("<i8").tobytes(), "values": flat[order].astype("<i8").tobytes(),
        }
        return pa.Table.from_pylist([row], arrow)

    return vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(build, schema)


def search_block(queries: np.ndarray, own: np.ndarray, k: int, size: int, width: int, top: int, bounds, slots, values) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best vectors of the block, with ties beyond, and their exact scores. ``own`` marks
    (query, vector) pairs that don't count."""
    if max(width, 1) * top * float(np.abs(queries).max(initial=0)) > 2**53:
        raise ValueError("scores are too large to be exact")  # sums of products, and the bounds on them, stay exact below
    exact = np.zeros((size, max(width, queries.shape[1])), np.int64)
    dense = np.zeros(size * width, np.int64)
    dense[slots] = values
    exact[:, :width] = dense.reshape(size, width)
    weights = np.zeros((len(queries), exact.shape[1]))
    weights[:, : queries.shape[1]] = queries
    weights = weights[:, :width]
    sizes = np.abs(weights)
    scores = np.where(own, -np.inf, 0.0)
    unpaid = np.repeat(sizes.sum(1)[:, None], size, 1)
    possible = ~own
    for segment in range(LEVELS):
        start, stop = bounds[segment], bounds[segment + 1]
        part = np.zeros(size * width)
        part[slots[start:stop]] = values[start:stop]
        part = part.reshape(size, width)
        scores += weights @ part.T
        unpaid -= sizes @ (part != 0).T
        gain = (LEVELS - 1 - segment) * top // LEVELS * unpaid
        if size > k:
            best = np.partition(scores - gain, size - k, axis=1)[:, size - k]
            possible = (scores + gain >= best[:, None]) & ~own
        if possible.sum(1).max(initial=0) <= FEW * k:
            break
    full = np.zeros((len(queries), exact.shape[1]), np.int64)
    full[:, : queries.shape[1]] = queries
    for query in range(len(queries)):
        found = np.flatnonzero(possible[query])
        yield found, exact[found] @ full[query]


def search(index: DataFrame, queries: DataFrame, k: int = 10, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query (id, vector), all if there are fewer; ties to the
    smaller id. Scores that might pass 2^53 in size end the job. Vectors with the query's id don't count; of queries that share an id the least vector counts. Vectors of
    unequal length meet on their common components."""
    id_type = queries.schema["id"].dataType
    queries = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    chunks = max(1, -(-queries.count() // chunk))
    packed = queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    last = index.agg(F.max("block")).first()[0] or 0
    pairs = packed.select("queries", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))
    # Never broadcast: Spark takes the queries for as small as before they were repeated for each block, and an index for as small as its files.
    pairs = pairs.join(index.hint("merge"), "block")
    schema = StructType().add("query_id", id_type).add("vec_id", index.schema["ids"].dataType.elementType).add("score", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch[name][at] for name in ("ids", "width", "top", "bounds", "slots", "values", "queries")}
                asked = row["queries"].values
                names, ids = pa.compute.struct_field(asked, "id"), row["ids"].values
                vectors = _matrix(pa.chunked_array([pa.compute.struct_field(asked, "vector")]))
                number = {v: n for n, v in enumerate(ids.unique().to_pylist())}
                codes = np.array([number[v] for v in ids.to_pylist()])
                own = np.array([number.get(v, -1) for v in names.to_pylist()])[:, None] == codes[None, :]
                slots, values = (np.frombuffer(row[c].as_py(), "<i8") for c in ("slots", "values"))
                place = np.empty(len(ids), np.int64)
                place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                best, who, scores = [], [], []
                found = search_block(vectors, own, k, len(ids), row["width"].as_py(), row["top"].as_py(), row["bounds"].as_py(), slots, values)
                for query, (members, score) in enumerate(found):
                    first = np.lexsort([place[members], -score])[:k]
                    best.append(members[first])
                    scores.append(score[first])
                    who.append(np.full(len(first), query))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(np.concatenate(who))), ids.take(pa.array(np.concatenate(best))), pa.array(np.concatenate(scores))], schema=arrow
                )

    found = pairs.select("ids", "width", "top", "bounds", "slots", "values", "queries").mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """Index every row and search for those that ``is_query`` names. Empty tables give an empty result."""
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    asked = integer_vectors(rows.where(is_query), id_col, vector_col, scale)
    return search(landed(build_index(vectors), "impact-index"), asked, k)
