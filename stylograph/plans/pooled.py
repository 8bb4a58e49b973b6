"""Measures of groups of works, at several levels in one pass.

A measure that does not add up (Yule's K, Honoré's R, a deviation) is never averaged: the counts it is made of are merged, type
frequencies among them, and the measure is taken of the merged counts, as if the works were one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.operators import measures
from stylograph.operators.surface import RICHNESS_COUNTS

KEY = "work_id"  # the name ``measures.measure`` gives a row's key


def pooled_counts(counts: DataFrame, types: DataFrame, groups: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Counts of every group: level, work_id (the group's key), n_works and all counts.

    ``counts`` has a row per work, ``types(work_id, term, n)`` its type frequencies, ``groups`` the columns that ``levels`` names (level
    -> column) per work_id. A level more is a grouping set more of the same aggregation, combined before the shuffle; types are
    grouped by group and term, so no group's vocabulary is in one task. A null column value is a group of its own."""
    columns = {level: f"_{level}" for level in levels}
    sets = [[c] for c in columns.values()] + [[]]
    name, key = F.lit("total"), F.lit("")
    for level, column in columns.items():
        here = F.grouping(column) == 0
        name, key = F.when(here, level).otherwise(name), F.when(here, F.col(column)).otherwise(key)
    keyed = groups.select("work_id", *(F.col(c).cast("string").alias(columns[level]) for level, c in levels.items()))
    additive = [c for c in counts.columns if c not in ("work_id", *RICHNESS_COUNTS)]

    def grouped(rows: DataFrame, *more: str, **sums: Column) -> DataFrame:
        wanted = rows.join(keyed, "work_id").drop("work_id").groupingSets([[*s, *more] for s in sets], *columns.values(), *more)
        return wanted.agg(name.alias("level"), key.alias(KEY), *(c.alias(n) for n, c in sums.items())).drop(*columns.values())

    sums = grouped(counts.select("work_id", *additive), n_works=F.count("*"), **{c: F.sum(c) for c in additive})
    merged = grouped(types.select("work_id", "term", "n"), "term", n=F.sum("n"))
    rich = merged.groupBy("level", KEY).agg(
        F.count("*").alias("n_types"), F.count_if(F.col("n") == 1).alias("n_hapax"), F.sum(F.col("n") * F.col("n")).alias("sum_sq_types")
    ).select(F.col("level").alias("_l"), F.col(KEY).alias("_k"), *RICHNESS_COUNTS)
    joined = sums.join(rich, (F.col("level") == F.col("_l")) & F.col(KEY).eqNullSafe(F.col("_k")), "left")
    return joined.select("level", KEY, "n_works", *additive, *(F.coalesce(c, F.lit(0)).alias(c) for c in RICHNESS_COUNTS))


def pooled_measures(counts: DataFrame, types: DataFrame, groups: DataFrame, levels: dict[str, str], wanted: dict[str, str]) -> DataFrame:
    """One row per group: level, key, n_works and a column per measure."""
    pooled = pooled_counts(counts, types, groups, levels)
    return measures.measure(pooled, wanted, "level", "n_works").withColumnRenamed(KEY, "key")


# --- histograms ---------------------------------------------------------------------------------


def length_histogram(lengths: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Sparse histogram of every group from those of works: ``lengths(work_id, length, n)`` to (group, length, n)."""
    return lengths.join(groups.select("work_id", group), "work_id").groupBy(group, "length").agg(F.sum("n").alias("n"))


def dense_histogram(sparse: DataFrame, group: str, width: int) -> DataFrame:
    """Every bucket of ``width`` lengths from 0 to the group's longest, empty ones too: (group, bucket, n). Only here are zeros filled in."""
    bucket = F.floor(F.col("length") / width).cast("long")
    counted = sparse.groupBy(group, bucket.alias("at")).agg(F.sum("n").alias("n"))
    spans = counted.groupBy(group).agg(F.max("at").alias("last")).select(group, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("at"))
    return spans.join(counted, [group, "at"], "left").select(group, (F.col("at") * width).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def exact_quantiles(sparse: DataFrame, group: str, quantiles: dict[str, str]) -> DataFrame:
    """The least length that at least a share q of the group's sentences do not exceed, per quantile
    (name -> q as a decimal), read off the counts: nothing is
    sorted but the distinct lengths of a group."""
    by_length = F.array_sort(F.collect_list(F.struct("length", "n")))
    totals = sparse.groupBy(group).agg(F.sum("n").alias("total"), by_length.alias("counts"))

    def value(q: str) -> Column:
        # (counted so far, the answer once it is reached)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("found"))

        def step(state: Column, x: Column) -> Column:
            seen = state["seen"] + x["n"]
            reached = state["found"].isNull() & (seen >= F.ceil(F.col("total") * F.lit(q).cast("decimal(10,9)")))
            return F.struct(seen.alias("seen"), F.when(reached, x["length"]).otherwise(state["found"]).alias("found"))

        return F.aggregate("counts", start, step, lambda state: state["found"])

    return totals.select(group, F.col("total").alias("n_sentences"), *(value(q).alias(name) for name, q in quantiles.items()))
