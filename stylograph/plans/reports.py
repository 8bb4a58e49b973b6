"""Report queries over the marts. Filters are bound values, never spliced text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.session import lookup

# Fixed value: rows on a page of the report.
PAGE_ROWS = 15


def authors(mart: DataFrame) -> DataFrame:
    return mart.select("author").distinct().orderBy("author")


def metrics(dim_metric: DataFrame) -> DataFrame:
    return dim_metric.select("metric_name").distinct().orderBy("metric_name")


def works(mart: DataFrame, author: str = "%") -> DataFrame:
    """Works of authors LIKE ``author`` with four of their standard scores."""
    return (
        mart.where(F.col("author").like(author))
        .select("title", "author", "mean_word_length", "mean_sentence_length", "adjective_density", "yules_k")
        .orderBy("author", "title")
    )


def author_metrics(
    fact: DataFrame, dim_metric: DataFrame, dim_author: DataFrame, metric_names: list[str], author: str = "%"
) -> DataFrame:
    """Mean value and standard score per author and metric; a family's mean is over all its series.

    The fact is summed by its keys first: an author with most of the rows meets the dimensions as a
    few summed rows.
    """
    sums = fact.groupBy("author_key", "metric_key").agg(
        *(f(c).alias(f"{f.__name__}_{c}") for c in ("value", "zscore") for f in (F.sum, F.count))
    )
    chosen = dim_metric.where(F.col("metric_name").isin(*metric_names)).select("metric_key", "metric_name")
    named = dim_author.where(F.col("name").like(author)).select("author_key", F.col("name").alias("author"))

    def mean(c: str):
        return F.try_divide(F.sum(f"sum_{c}"), F.sum(f"count_{c}")).alias(c)

    return (
        sums.join(lookup(chosen), "metric_key")
        .join(lookup(named), "author_key")
        .groupBy("author", "metric_name")
        .agg(mean("value"), mean("zscore"))
        .orderBy(F.col("zscore").asc_nulls_last(), F.col("value").asc_nulls_last())
    )


def first_page(report: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """The rows a page shows; with the report's order this is a top-k, not a full sort."""
    return report.limit(rows)
