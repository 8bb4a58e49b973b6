"""Staging: landed tables renamed and cast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _typed(raw: DataFrame, *columns: tuple[str, str, str]) -> DataFrame:
    return raw.select(*(F.col(source).cast(kind).alias(name) for source, name, kind in columns))


def stg_works(raw: DataFrame) -> DataFrame:
    return _typed(
        raw, ("work_id", "work_id", "string"), ("word_count", "word_count", "bigint"), ("loaded_at", "loaded_at", "timestamp_ntz")
    )


def stg_measurements(raw: DataFrame) -> DataFrame:
    return _typed(
        raw,
        ("work_id", "work_id", "string"),
        ("metric", "metric_name", "string"),
        ("value", "value", "double"),
        ("loaded_at", "loaded_at", "timestamp_ntz"),
    )


def stg_vocab(raw: DataFrame) -> DataFrame:
    return _typed(
        raw,
        ("work_id", "work_id", "string"),
        ("term", "term", "string"),
        ("term_count", "term_count", "bigint"),
        ("loaded_at", "loaded_at", "timestamp_ntz"),
    )
