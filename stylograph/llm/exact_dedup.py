"""Exact duplicates: local combining, salted digest groups, then salt winners, on full contents.

The corpus is first reduced to narrow rows (id, digest, length). Only texts whose digest occurs more
than once travel as contents. Those contents are grouped three times, each time by the content
itself and not by its digest alone:

1. within the input partition, by the map side of the first aggregation;
2. by (digest, salt), the salt being the input partition's number, so that a text that a third of
   all rows hold is merged by many tasks;
3. by digest over the salts' winners, of which there are at most ``salts`` per text.

A digest under which more than one content is found (a collision) is resolved by joining the rows
to the winners on the content; without a collision that join has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograph.llm.common import landed, text_of
from stylograph.session import BROADCAST_ROWS, lookup

#: Characters that don't count: blank, tab, line feed, vertical tab, form feed, carriage return.
IGNORED = " \t\n\x0b\f\r"


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _salted(scan: DataFrame, repeated: DataFrame, salts: int) -> DataFrame:
    """The contents of repeated digests, combined by (digest, salt): digest, salt, content, n_chars, id, copies.

    The digests with the most rows, BROADCAST_ROWS at most, are always looked up on the scan's partitions, so their copies are combined
    there. Only the texts of other digests, none of which has more rows than those, are moved to be looked up."""
    scan = scan.withColumn("salt", F.spark_partition_id() % salts)
    hot = landed(repeated.orderBy(F.desc("group_size"), "digest").limit(BROADCAST_ROWS).select("digest"), "exact-hot-digests")
    found = scan.join(F.broadcast(hot), "digest", "left_semi")
    if repeated.count() > BROADCAST_ROWS:
        rest = repeated.select("digest").join(F.broadcast(hot), "digest", "left_anti")
        found = found.unionByName(scan.join(F.broadcast(hot), "digest", "left_anti").join(rest, "digest", "left_semi"))
    return found.groupBy("digest", "salt", "content", "n_chars").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest, n_chars.

    Null texts count as empty; texts without visible characters are all equal. Of equal texts the row
    with the most code points in its original text stays, then the one with the smallest id (null ids
    last). Rows that repeat id and text are counted each, and one of them stays. An empty table gives
    an empty result. Other columns are not read.
    """
    content = F.translate(text_of(text_col), IGNORED, "")
    scan = docs.select(
        F.col(id_col).alias("id"), content.alias("content"), F.length(text_of(text_col)).cast("long").alias("n_chars")
    )
    narrow = landed(
        scan.select("id", "n_chars", digest(F.col("content")).alias("digest"))
        .groupBy("id", "n_chars", "digest").agg(F.count("*").alias("copies")),
        "exact-rows",
    )
    sizes = narrow.groupBy("digest").agg(
        F.sum("copies").alias("group_size"), F.max("n_chars").alias("n_chars"), F.min("id").alias("id"), F.count("*").alias("distinct_rows")
    )
    repeated = landed(sizes.where("distinct_rows > 1").select("digest", "group_size"), "exact-digests")
    salted = _salted(scan.withColumn("digest", digest(F.col("content"))), repeated, salts)
    best = F.min(F.struct((-F.col("n_chars")).alias("order"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    contents = (
        salted.groupBy("digest", "salt", "content").agg(best.alias("best"), F.sum("copies").alias("copies"))
        .groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("copies").alias("group_size"))
    )
    winners = landed(
        contents.select("digest", "content", F.col("best.id").alias("keep_id"), (-F.col("best.order")).alias("keep_chars"), "group_size")
        .withColumn("contents", F.count("*").over(Window.partitionBy("digest")))
        .withColumn("content", F.when(F.col("contents") > 1, F.col("content"))),
        "exact-winners",
    )
    plain = lookup(winners.where("contents = 1").select("digest", "keep_id", "keep_chars", "group_size"))
    clashing = winners.where("contents > 1").select("digest", "content", "keep_id", "keep_chars", "group_size")
    clashing_digests = lookup(clashing.select("digest").distinct())

    single = F.col("keep_chars").isNull()
    resolved = narrow.join(clashing_digests, "digest", "left_anti").join(plain, "digest", "left").select(
        "id", "digest", "n_chars", "copies",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(single, F.col("n_chars")).otherwise(F.col("keep_chars")).alias("keep_chars"),
        F.when(single, F.col("copies")).otherwise(F.col("group_size")).alias("group_size"),
    )
    collided = (
        scan.withColumn("digest", digest(F.col("content"))).join(clashing_digests, "digest", "left_semi")
        .join(clashing, ["digest", "content"])
        .groupBy("id", "digest", "n_chars", "keep_id", "keep_chars", "group_size").agg(F.count("*").alias("copies"))
    )
    rows = resolved.unionByName(collided.select(resolved.columns))
    first = F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy", "number")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("copy") == 0)
    return rows.select("*", first).select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "digest", "n_chars"
    )
