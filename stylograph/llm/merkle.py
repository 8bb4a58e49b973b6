"""A Merkle manifest of a table: a tree of digests per group, one over the groups' roots, and a proof for every row.

A row's leaf is the digest of its fields. Within a group the leaves stand in order, and every ``fanout`` consecutive nodes
become one until a single node, the subroot, is left; the subroots, ordered by group, become the root in the same way.

Trees are cut into blocks: aligned subtrees of ``height`` steps, each built by one task from at most ``fanout ** height``
digests. The blocks' roots are the leaves of the next level's blocks, so a tree of N leaves takes a few rounds and no group
of rows grows with N, whatever a single source holds. A block is stored in the van Emde Boas layout: its levels are split at half height,
the upper subtree stands first and the lower ones after it, each stored likewise, so that a path touches few cache lines or
pages of any size. Where a node lies is arithmetic on its depth and place (``address``); construction writes by it and the
search for siblings reads by it.

H is sha256 as lowercase hex over its inputs, digests as hex text. A field is ``-`` if null, else the bytes of its UTF-8 text,
a colon and the text. Groups are ordered with null first, then bytewise. Rows that share an id keep their places by their
leaves; equal rows are interchangeable. An empty table has no root and no rows. Columns that are not named take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from stylograph.llm.common import landed, partitions
from stylograph.session import lookup

FANOUT = 3
#: Steps from a block's leaves to its root: 81 leaves, 121 nodes. It changes no digest.
HEIGHT = 4

BLOCK = "grp string, n long, block long, tall int, count int, root string, layout binary"
STEPS = ArrayType(StructType().add("before", "string").add("after", "string"))
HEX = np.array([list(b"%02x" % byte) for byte in range(256)], np.uint8)


def nodes_in(levels: int, fanout: int = FANOUT) -> int:
    """Nodes of a complete tree with so many levels."""
    return (fanout**levels - 1) // (fanout - 1)


def address(levels: int, depth: int, at: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """Where the nodes ``at`` (places from the left) of a depth lie in the van Emde Boas layout of a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(at)
    upper = levels // 2
    lower = levels - upper
    if depth < upper:
        return address(upper, depth, at, fanout)
    width = fanout ** (depth - upper)  # nodes of this depth in one lower subtree
    return nodes_in(upper, fanout) + at // width * nodes_in(lower, fanout) + address(lower, depth - upper, at % width, fanout)


def build_block(leaves: Sequence[str], tall: int, fanout: int = FANOUT) -> tuple[str, bytes]:
    """The root of a subtree of ``tall`` steps over the digests ``leaves``, and its nodes in the layout; absent nodes are zeros."""
    layout = np.zeros((nodes_in(tall + 1, fanout), 32), np.uint8)
    level = list(leaves)
    for depth in range(tall, -1, -1):
        where = address(tall + 1, depth, np.arange(len(level)), fanout)
        layout[where] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        if depth:
            level = [sha256("".join(level[a : a + fanout]).encode()).hexdigest() for a in range(0, len(level), fanout)]
    return level[0], layout.tobytes()


def sibling_steps(layout: bytes, tall: int, count: int, at: np.ndarray, upper: list[dict], fanout: int = FANOUT) -> pa.ListArray:
    """For the leaves ``at`` of a block that holds ``count``: per step to its root the digests before and after the path's
    node in its run, then the steps ``upper`` from the block's root on."""
    nodes = HEX[np.frombuffer(layout, np.uint8).reshape(-1, 32)].reshape(-1, 64)
    slots, path = np.arange(fanout), at.astype(np.int64)
    where, before, after = [], [], []
    for depth in range(tall, 0, -1):
        run = (path - path % fanout)[:, None] + slots
        own = (path % fanout)[:, None]
        there = run < count
        where.append(address(tall + 1, depth, np.minimum(run, count - 1), fanout))
        before.append(there & (slots < own))
        after.append(there & (slots > own))
        path, count = path // fanout, -(-count // fanout)
    index = np.arange(len(at) * tall).reshape(len(at), tall)
    index = np.hstack([index, np.broadcast_to(len(at) * tall + np.arange(len(upper)), (len(at), len(upper)))]).ravel()

    def strings(masks: list[np.ndarray], side: str) -> pa.Array:
        ends, data = np.zeros(1, np.int32), b""
        if tall:
            mask = np.stack(masks, 1)
            ends = np.concatenate([ends, np.cumsum(mask.sum(2) * 64)]).astype(np.int32)
            data = nodes[np.stack(where, 1)[mask]].tobytes()
        own = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))
        return pa.concat_arrays([own, pa.array([u[side] for u in upper], pa.string())]).take(pa.array(index))

    steps = pa.StructArray.from_arrays([strings(before, "before"), strings(after, "after")], ["before", "after"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (tall + len(upper)), pa.int32()), steps)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """H of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, the number of each within its ``grp`` by ``order``, and ``n``, the group's rows.

    Rows are sorted in ranges over group and order, so a group of any size lies in many partitions; each numbers its own
    rows, and what lies before is a running sum over one row per group and partition."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    schema = StructType([*rows.schema.fields]).add("part", "integer").add("local", "long")
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch["grp"].dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            runs = np.diff(np.append(starts, len(codes)))
            local = np.arange(len(codes)) - np.repeat(starts, runs)
            if batch["grp"][0].as_py() == last:
                local[: runs[0]] += so_far
            last, so_far = batch["grp"][-1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(local)], schema=arrow)

    placed = landed(ranged.mapInArrow(number, schema), "merkle-rows")
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "grp", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("grp")).alias("n")
    )
    return placed.join(lookup(landed(offsets, "merkle-offsets")), ["grp", "part"]).select(
        *rows.columns, (F.col("local") + F.col("before")).alias("place"), "n"
    )


@dataclass(frozen=True)
class Forest:
    """A tree per ``grp``: its blocks level by level from the leaves up, and how wide a block is."""

    levels: list[DataFrame]
    width: int

    def roots(self) -> DataFrame:
        """grp and root of every group."""
        whole = [level.where(F.col("n") <= self.width).select("grp", "root") for level in self.levels]
        out = whole[0]
        for more in whole[1:]:
            out = out.unionByName(more)
        return out


def grow(rows: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> Forest:
    """The trees over ``rows(grp, n, place, digest)``. Every level is written, so none is built twice."""
    width = fanout**height
    schema = StructType.fromDDL(BLOCK)
    arrow = to_arrow_schema(schema)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        grp, n, block = (k.as_py() for k in key)
        tall = height
        if n <= width:  # the whole tree: it ends where one node is left
            tall = next(h for h in range(height + 1) if fanout**h >= n)
        root, layout = build_block(table.sort_by("place")["digest"].to_pylist(), tall, fanout)
        return pa.Table.from_pylist([{"grp": grp, "n": n, "block": block, "tall": tall, "count": table.num_rows, "root": root, "layout": layout}], arrow)

    levels = []
    while True:
        keyed = rows.select("grp", "n", F.expr(f"place div {width}").alias("block"), "place", "digest")
        levels.append(landed(keyed.groupBy("grp", "n", "block").applyInArrow(build, schema), "merkle-level"))
        rows = levels[-1].where(F.col("n") > width).select(
            "grp", F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("block").alias("place"), F.col("root").alias("digest")
        )
        if rows.isEmpty():
            return Forest(levels, width)


def paths(rows: DataFrame, blocks: DataFrame, width: int, fanout: int = FANOUT) -> DataFrame:
    """``rows(grp, place, ...)``, leaves of ``blocks`` that know their own way up (``upper``, ``subroot``), with ``steps`` up to the
    root and ``subroot``. A block meets its own leaves only, ``width`` at most."""
    schema = StructType([*rows.schema.fields]).add("steps", STEPS).add("subroot", "string")
    arrow = to_arrow_schema(schema)

    def climb(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        block = right.to_pylist()[0]
        at = left["place"].to_numpy() % width
        steps = sibling_steps(block["layout"], block["tall"], block["count"], at, block["upper"], fanout)
        subroot = pa.array([block["subroot"]] * len(at), pa.string())
        return pa.Table.from_arrays([*left.drop_columns(["block"]).columns, steps, subroot], names=schema.names).cast(arrow)

    keyed = rows.withColumn("block", F.expr(f"place div {width}"))
    known = blocks.select("grp", "block", "tall", "count", "layout", "upper", "subroot")
    return keyed.groupBy("grp", "block").cogroup(known.groupBy("grp", "block")).applyInArrow(climb, schema)


def descend(forest: Forest, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves' blocks with the steps from their roots up. ``above(grp, upper, subroot)``: what lies over each group's root."""
    higher = None
    for level in reversed(forest.levels):
        ready = level.where(F.col("n") <= forest.width).join(above, "grp")
        if higher is not None:
            inner = level.where(F.col("n") > forest.width)
            way = paths(inner.select("grp", F.col("block").alias("place")), higher, forest.width, fanout)
            way = way.select("grp", F.col("place").alias("block"), F.col("steps").alias("upper"), "subroot")
            ready = ready.unionByName(inner.join(way, ["grp", "block"]))
        higher = landed(ready, "merkle-paths")
    return higher


@dataclass(frozen=True)
class Manifest:
    """The digests of a table: its leaves with their places, the groups' trees, the tree over them, and the root."""

    leaves: DataFrame
    groups: Forest
    members: DataFrame
    top: Forest
    root: str | None
    fanout: int


def build(
    rows: DataFrame, id_col: str, group_col: str, leaf: Column, keep: dict[str, Column] | None = None, fanout: int = FANOUT, height: int = HEIGHT
) -> Manifest:
    """The manifest of ``rows``. ``keep``: named values that stay beside each leaf."""
    keep = keep or {}
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))
    leaves = rows.select(
        group.alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), F.monotonically_increasing_id().alias("tie"),
        *(value.alias(f"keep_{name}") for name, value in keep.items()),
    )
    placed = numbered(landed(leaves, "merkle-leaves"), "id", "leaf", "tie").drop("tie")
    groups = grow(placed.withColumnRenamed("leaf", "digest"), fanout, height)
    members = groups.roots().select(F.lit("").alias("grp"), F.col("grp").alias("member"), "root")
    members = landed(numbered(members, "member").withColumnRenamed("root", "digest"), "merkle-members")
    top = grow(members, fanout, height)
    found = top.roots().first()
    return Manifest(placed, groups, members, top, found and found.root, fanout)


def proofs(manifest: Manifest) -> DataFrame:
    """Every row's id, leaf, kept values (``keep_...``), subroot, and ``steps``: before and after, the digests beside the path, level by
    level from the leaf to the root."""
    fanout = manifest.fanout
    start = manifest.members.sparkSession.createDataFrame([("", [], manifest.root)], StructType().add("grp", "string").add("upper", STEPS).add("subroot", "string"))
    over = paths(manifest.members.select("grp", "place", "member", "digest"), descend(manifest.top, start, fanout), manifest.top.width, fanout)
    above = landed(over.select(F.col("member").alias("grp"), F.col("steps").alias("upper"), F.col("digest").alias("subroot")), "merkle-above")
    rows = manifest.leaves.drop("n")
    return paths(rows, descend(manifest.groups, above, fanout), manifest.groups.width, fanout).drop("grp", "place")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """H of all digests of a proof, in order."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)
