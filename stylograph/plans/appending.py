"""Loads that add to what is there.

Every load's rows stay in a folder named after its load time; beside them a small state is kept that merges: per series the number,
sum and sum of squares of its values, per author the number of works that use a term and how often. A load adds what its rows sum to
and takes away what the rows of works it replaces had added, so old rows are read only for those works. Values are summed as decimals: sums
are exact, and the same whatever the order of loads.

A state is a published version (see ``sources.releases``) and names the load it includes; a load that is not newer than that is left
out, so repeating one changes nothing, and a load that is lost half-way is not listed.
"""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.sources.landing import Tables
from stylograph.sources.releases import Releases

# Nine digits after the point, eighteen of squares; the rest of 38 digits is room for the sums.
VALUE, SQUARE = "decimal(38,9)", "decimal(38,18)"
SERIES = f"metric string, n bigint, total {VALUE}, total_sq {SQUARE}"
TERMS = "author string, term string, n_works bigint, n bigint"
LOADS = "work_id string, loaded_at timestamp_ntz"


class Appended:
    """Measurements and vocabularies that grow by loads, below a root folder."""

    def __init__(self, releases: Releases):
        self.releases, self.spark = releases, releases.spark

    def _folder(self, name: str, loaded_at: datetime) -> str:
        return f"{self.releases.root}/loads/{name}/{loaded_at:%Y%m%dT%H%M%S%f}"

    def _state(self, name: str, schema: str) -> DataFrame:
        current = self.releases.current()
        return current.read(name) if current else self.spark.createDataFrame([], schema)

    def last_load(self) -> datetime | None:
        note = self.releases.note()
        return datetime.fromisoformat(note) if note else None

    def _rows(self, name: str, works: DataFrame) -> DataFrame | None:
        """The rows of ``works(work_id, loaded_at)`` from the loads that hold them."""
        loads = [r.loaded_at for r in works.select("loaded_at").distinct().collect()]  # as many as there were loads
        if not loads:
            return None
        rows = self.spark.read.parquet(*(self._folder(name, at) for at in loads))
        return rows.join(works, ["work_id", "loaded_at"], "left_semi")

    def load(self, measurements: DataFrame, vocab: DataFrame, authors: DataFrame, loaded_at: datetime) -> bool:
        """Add ``measurements(work_id, metric, value)`` and ``vocab(work_id, term, term_count)`` of some works, replacing what those
        works had. ``authors(work_id, author)``. False if that load, or a later one, is already in."""
        last = self.last_load()
        if last is not None and loaded_at <= last:
            return False
        stamp = F.lit(loaded_at.isoformat(sep=" ")).cast("timestamp_ntz")
        for name, rows in (("measurements", measurements), ("vocab", vocab.join(authors.select("work_id", "author"), "work_id"))):
            rows.withColumn("loaded_at", stamp).write.mode("overwrite").parquet(self._folder(name, loaded_at))
        added = {name: self.spark.read.parquet(self._folder(name, loaded_at)) for name in ("measurements", "vocab")}
        works = added["measurements"].select("work_id").unionByName(added["vocab"].select("work_id")).distinct()
        loads = self._state("loads", LOADS)
        replaced = loads.join(works, "work_id")

        draft = self.releases.draft()
        series = [self._state("series", SERIES), series_state(added["measurements"])]
        terms = [self._state("terms", TERMS), term_state(added["vocab"])]
        if (old := self._rows("measurements", replaced)) is not None:
            series.append(negated(series_state(old)))
        if (old := self._rows("vocab", replaced)) is not None:
            terms.append(negated(term_state(old)))
        draft.write("series", merged(series, ["metric"]).where("n > 0"))
        draft.write("terms", merged(terms, ["author", "term"]).where("n_works > 0"))
        draft.write("loads", loads.join(works, "work_id", "left_anti").unionByName(works.withColumn("loaded_at", stamp)))
        self.releases.publish(draft, loaded_at.isoformat(sep=" "))
        return True

    def scores(self) -> DataFrame:
        """Every work's latest values with their standard scores: work_id, metric, value, zscore. Mean and spread come from the state."""
        rows = self._rows("measurements", self._state("loads", LOADS))
        if rows is None:
            return self.spark.createDataFrame([], "work_id string, metric string, value double, zscore double")
        spread = self.spark.createDataFrame(
            [(r.metric, *mean_and_spread(r.n, r.total, r.total_sq)) for r in self._state("series", SERIES).collect()],  # a row per series
            "metric string, mean double, spread double",
        )
        joined = rows.join(F.broadcast(spread), "metric")
        return joined.select("work_id", "metric", "value", ((F.round("value", 9) - F.col("mean")) / F.col("spread")).alias("zscore"))

    def terms(self) -> DataFrame:
        """Per author and term: n_works, n."""
        return self._state("terms", TERMS)


def mean_and_spread(n: int, total: Decimal, total_sq: Decimal) -> tuple[float, float | None]:
    """Mean and population deviation from exact sums; no spread is null, not a rounding error."""
    one, squares = int(total.scaleb(9)), int(total_sq.scaleb(18))
    varies = n * squares - one * one
    return float(Fraction(one, n * 10**9)), math.sqrt(Fraction(varies, n * n * 10**18)) if varies else None


def series_state(measurements: DataFrame) -> DataFrame:
    exact = F.round("value", 9).cast("decimal(19,9)")
    return measurements.where(F.col("value").isNotNull()).groupBy("metric").agg(
        F.count("*").alias("n"), F.sum(exact).cast(VALUE).alias("total"), F.sum((exact * exact).cast(SQUARE)).cast(SQUARE).alias("total_sq")
    )


def term_state(vocab: DataFrame) -> DataFrame:
    """``vocab`` has a row per work and term."""
    return vocab.groupBy("author", "term").agg(F.count("*").alias("n_works"), F.sum("term_count").alias("n"))


def negated(state: DataFrame) -> DataFrame:
    """What takes a state away when merged."""
    return state.select(*((-F.col(c)).cast(kind).alias(c) if kind != "string" else F.col(c) for c, kind in state.dtypes))


def merged(states: list[DataFrame], keys: list[str]) -> DataFrame:
    """The sum of states."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*keys).agg(*(F.sum(c).cast(kind).alias(c) for c, kind in rows.dtypes if c not in keys))
