"""Splitting long texts at blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.functions.arrays import let
from stylograph.functions.prose import PARAGRAPH_BREAK, paragraphs

# Fixed value: longest chunk handed to a parser, in characters.
MAX_CHUNK_CHARS = 100_000

GLUE = "\n\n"

# Works up to this many characters are handled inside their row (a long novel has about a million).
IN_ROW_CHARS = 2_000_000


def chunk_text(text: Column, max_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Paragraphs packed greedily, in order, into chunks of at most ``max_chars``.

    A chunk is closed when it holds something and the next paragraph would overfill it; the blank
    line between two paragraphs counts. A paragraph longer than the limit is a chunk by itself.

    The fold walks over lengths and notes where chunks start; texts are joined once, afterwards.
    """

    def step(state: Column, paragraph: Column) -> Column:
        filled = paragraph["length"] + len(GLUE)
        closes = (paragraph["i"] > 0) & (state["size"] + paragraph["length"] > max_chars)
        return F.when(
            closes,
            F.struct(F.array_append(state["starts"], paragraph["i"]).alias("starts"), filled.alias("size")),
        ).otherwise(F.struct(state["starts"].alias("starts"), (state["size"] + filled).alias("size")))

    def packed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("length"), i.alias("i")))
        start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("size"))
        return let(
            F.aggregate(sizes, start, step, lambda state: state["starts"]),
            lambda starts: F.transform(
                starts,
                lambda at, n: F.array_join(
                    F.slice(parts, at + 1, F.coalesce(F.get(starts, n + 1), F.size(parts)) - at), GLUE
                ),
            ),
        )

    return let(paragraphs(text), packed)


def chunks(works: DataFrame, max_chars: int = MAX_CHUNK_CHARS, column: str = "text") -> DataFrame:
    """One row per chunk: the other columns, ``chunk_no`` from 0, and the chunk in ``column``."""
    rest = [c for c in works.columns if c != column]
    fits = F.length(column) <= max_chars
    whole = F.array(F.regexp_replace(column, PARAGRAPH_BREAK, GLUE))
    packed = F.when(fits, whole).otherwise(chunk_text(F.col(column), max_chars))
    return works.select(*rest, F.posexplode(packed).alias("chunk_no", column))


def paragraph_rows(works: DataFrame, column: str = "text") -> DataFrame:
    """One row per paragraph: the other columns, ``paragraph_no`` from 0, and its text."""
    rest = [c for c in works.columns if c != column]
    return works.select(*rest, F.posexplode(paragraphs(F.col(column))).alias("paragraph_no", column))
