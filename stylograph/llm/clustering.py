"""Exact k-means over integer vectors that skips what geometry proves.

Vectors are dealt into blocks and written once. Each round a block knows, per vector, its cluster, an upper bound of the distance to
its centroid and a lower bound of the distance to every other one. When centroids move, the upper bound grows by the
drift of its own centroid. The lower bound would shrink by the greatest drift of another centroid; but all vectors of
cluster i lie in a sphere round its old centroid, and the distance to centroid j shrinks by its full drift only for vectors that
lie straight ahead of it. In the plane through the sphere's centre and both places of centroid j, the points that it comes nearer to by more
than a given amount lie inside one branch of a hyperbola, and so inside the cone of its asymptotes; the angle of the
cone that touches the sphere bounds what any vector of the cluster can lose (``drift_bounds``). A vector whose upper bound
is below its lower bound keeps its cluster unseen; for the others the own distance is computed, and only if that does not
settle it all centroids are, in exact integers. Bounds are rounded outwards, so they never decide a tie.

New centroids are exact floors of sums over counts; sums are added up by Spark from one row per block. The vectors stay
where they are (cached by block on the executors' disks, computed again from the written table if one is lost); a round moves only
its bounds, 20 bytes a vector, in a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from stylograph.llm.common import landed, partitions

#: Vectors in a block, about; it changes no result.
BLOCK = 4_096
#: Greatest size of a component: squared distances then stay within 64 bits.
LIMIT = 1 << 27
#: Relative slack of bounds in floating point, far above their rounding.
SLACK = 1e-9

STATE = "block long, cluster binary, upper binary, lower binary, sums array<long>, counts array<long>, radius array<double>, measured long, scanned long"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, width: int, scale: int = 1024) -> DataFrame:
    """id and floor(scale * x) of every component. Only vectors of exactly ``width`` components, none null or non-finite, take part;
    a scaled component above LIMIT ends the job, for squared distances could not be held."""
    sound = (F.size(vector_col) == width) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vector_col, lambda x: F.lit(float(scale)) * x.cast("double"))
    refused = F.raise_error(F.lit("a component is too large for exact distances")).cast("array<double>")
    kept = rows.where(F.col(vector_col).isNotNull() & sound).select(F.col(id_col).alias("id"), scaled.alias("scaled"))
    held = F.when(F.forall("scaled", lambda x: F.abs(x) <= LIMIT), F.col("scaled")).otherwise(refused)
    return kept.select("id", F.transform(held, lambda x: F.floor(x).cast("long")).alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the least sha256 after ``seed``, in that order; a null id comes last, equal ids by vector."""
    drawn = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = vectors.select(drawn.alias("drawn"), "vector").orderBy(F.asc_nulls_last("drawn"), "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def blocks_of(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block: its number, the ids, and the components as 32-bit integers. Rows are packed where they were read."""
    schema = StructType().add("block", "long").add("ids", ArrayType(vectors.schema["id"].dataType)).add("values", "binary")
    arrow = to_arrow_schema(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table["id"].combine_chunks())
            values = table["vector"].combine_chunks().flatten().to_numpy().astype("<i4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number]), ids.cast(arrow.field("ids").type), pa.array([values], pa.binary())], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if rows + part.num_rows > block:
                    yield packed()
                    number, held, rows = number + 1, [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield packed()

    return vectors.select("id", "vector").mapInArrow(deal, schema)


def squared(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((values - centroids) ** 2).sum(-1)


def scan(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number), its squared distance, and a bound below all others."""
    distances = np.stack([squared(values, c) for c in centroids], 1)
    cluster = distances.argmin(1)
    rows = np.arange(len(values))
    own = distances[rows, cluster]
    others = distances.astype(float)
    others[rows, cluster] = np.inf
    return cluster, own, np.sqrt(others.min(1)) * (1 - SLACK)


def drift_bounds(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and by how much at most the least distance from a vector of each cluster to the other
    centroids shrank. ``radius`` bounds the distance of a cluster's vectors from its old centroid.

    Centroid j moves from a to b; the sphere's centre is p, seen from the middle of a and b at an angle ``phi`` to the move and
    ``beta`` wide. Points that come nearer by more than |b - a| cos(theta) lie inside the cone of half angle theta round the move, so with
    theta = phi - beta no point of the sphere does. Behind the middle plane nothing comes nearer at all."""
    moves = (new - old).astype(float)
    drift = np.sqrt((moves**2).sum(1))
    loose = np.zeros(len(old))
    for j in np.flatnonzero(drift):
        from_middle = old - (old[j] + new[j]) / 2.0
        far = np.sqrt((from_middle**2).sum(1))
        outside = far > radius * (1 + SLACK)
        with np.errstate(divide="ignore", invalid="ignore"):
            phi = np.arccos(np.clip(from_middle @ moves[j] / (far * drift[j]), -1, 1))
            theta = phi - np.arcsin(np.minimum(radius / far, 1))
        lost = np.where(outside & (theta > 0), np.maximum(np.cos(theta), 0) + 1e-7, 1.0)
        lost[j] = 0  # its own centroid is the upper bound's matter
        loose = np.maximum(loose, np.minimum(lost, 1) * drift[j])
    return drift * (1 + SLACK), loose * (1 + SLACK)


def assign_block(values: np.ndarray, centroids: np.ndarray, state: tuple | None, drift: np.ndarray, loose: np.ndarray) -> tuple:
    """cluster, upper and lower bounds after the centroids moved, and how many vectors were measured and scanned."""
    if state is None:
        cluster, own, lower = scan(values, centroids)
        return cluster, np.sqrt(own.astype(float)) * (1 + SLACK), lower, len(values), len(values)
    cluster, upper, lower = (part.copy() for part in state)
    upper += drift[cluster]
    lower -= loose[cluster]
    unsure = np.flatnonzero(upper >= lower)
    upper[unsure] = np.sqrt(squared(values[unsure], centroids[cluster[unsure]]).astype(float)) * (1 + SLACK)
    ambiguous = unsure[upper[unsure] >= lower[unsure]]
    if len(ambiguous):
        cluster[ambiguous], own, lower[ambiguous] = scan(values[ambiguous], centroids)
        upper[ambiguous] = np.sqrt(own.astype(float)) * (1 + SLACK)
    return cluster, upper, lower, len(unsure), len(ambiguous)


def _round(blocks: DataFrame, states: DataFrame | None, centroids: np.ndarray, drift: np.ndarray, loose: np.ndarray) -> DataFrame:
    """The state of every block under ``centroids``, with its sums, counts and radius per cluster; written."""
    schema = StructType.fromDDL(STATE)
    arrow = to_arrow_schema(schema)
    (k, width), first = centroids.shape, states is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["values"], "<i4").reshape(-1, width).astype(np.int64)
                state = None
                if not first:
                    state = np.frombuffer(row["cluster"], "<i4").astype(np.int64), np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8")
                cluster, upper, lower, measured, scanned = assign_block(values, centroids, state, drift, loose)
                radius = np.zeros(k)
                np.maximum.at(radius, cluster, upper)
                out = {
                    "block": row["block"], "cluster": cluster.astype("<i4").tobytes(), "upper": upper.astype("<f8").tobytes(), "lower": lower.astype("<f8").tobytes(),
                    "sums": np.stack([values[cluster == c].sum(0) for c in range(k)]).ravel().tolist(), "counts": np.bincount(cluster, minlength=k).tolist(),
                    "radius": radius.tolist(), "measured": measured, "scanned": scanned,
                }
                yield pa.RecordBatch.from_pylist([out], arrow)

    given = blocks.select("block", "values")
    if not first:
        given = given.join(states.select("block", "cluster", "upper", "lower"), "block")
    return landed(given.mapInArrow(run, schema), "clustering-state")


def _totals(states: DataFrame, k: int, width: int) -> tuple[list[int], list[int], np.ndarray]:
    """Sums and counts of all blocks and the greatest radius, per cluster: k * (width + 2) numbers."""

    def merged(column: str, how) -> list:
        rows = states.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(how("x").alias("x")).collect()
        return [r.x for r in sorted(rows, key=lambda r: r.at)]

    return merged("sums", F.sum), merged("counts", F.sum), np.array(merged("radius", F.max))


def k_means(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3:", block: int = BLOCK) -> tuple[DataFrame, np.ndarray, list[tuple[int, int]]]:
    """Cluster ``vectors(id, vector)`` of one width. Returns rows (id, cluster, squared distance), the final centroids, and per
    assignment how many vectors were measured against their own centroid and how many were scanned.

    ``rounds`` times every vector goes to its nearest centroid (ties: the smaller number) and every centroid that has vectors to
    the floor of their mean; then vectors are assigned once more. Rounds that cannot change anything are left out. With fewer
    vectors than k, each is a centroid; repeated rows count each; without vectors the result is empty."""
    schema = StructType([vectors.schema["id"]]).add("cluster", "integer").add("distance", "long")
    vectors = landed(vectors, "clustering-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids, []
    k, width = centroids.shape
    packed = landed(blocks_of(vectors, block), "clustering-blocks")
    blocks = packed.repartition(partitions(packed.sparkSession), "block").persist(StorageLevel.DISK_ONLY)
    states, work = None, []
    drift = loose = np.zeros(k)
    for step in range(rounds + 1):
        states = _round(blocks, states, centroids, drift, loose)
        spent = states.agg(F.sum("measured"), F.sum("scanned")).first()
        work.append((spent[0], spent[1]))
        if step == rounds:
            break
        sums, counts, radius = _totals(states, k, width)
        moved = np.array([[sums[c * width + d] // counts[c] if counts[c] else int(centroids[c, d]) for d in range(width)] for c in range(k)], np.int64)
        if (moved == centroids).all():
            break
        drift, loose = drift_bounds(centroids, moved, radius)
        centroids = moved
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                values = np.frombuffer(batch["values"][at].as_py(), "<i4").reshape(-1, width).astype(np.int64)
                cluster = np.frombuffer(batch["cluster"][at].as_py(), "<i4")
                yield pa.RecordBatch.from_arrays([batch["ids"][at].values, pa.array(cluster), pa.array(squared(values, centroids[cluster]))], schema=arrow)

    found = landed(blocks.join(states.select("block", "cluster"), "block").select("ids", "values", "cluster").mapInArrow(rows, schema), "clusters")
    blocks.unpersist()
    return found, centroids, work


def clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, k: int = 8, rounds: int = 10, seed: str = "3:") -> DataFrame:
    """Every kept vector's id, cluster and squared distance, the distances' sums over its cluster and over all, and its
    cluster's centroid (array of long). Other columns take no part."""
    found, centroids, _ = k_means(integer_vectors(rows, id_col, vector_col, width), k, rounds, seed)
    spent = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(spent.values())
    known = found.sparkSession.createDataFrame(
        [(c, spent.get(c, 0), total, [int(x) for x in centroid]) for c, centroid in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    return found.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
