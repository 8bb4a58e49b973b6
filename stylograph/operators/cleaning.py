"""Markdown to plain prose. The author's punctuation stays: later steps count it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.functions.arrays import let
from stylograph.functions.prose import BLANK_CHARS

# What counts as markup, in the order it is taken out. Whole-line rules come before
# inline ones. Each row: (name, a text the rule needs, pattern, replacement).
# Lines end at LF only, hence the d flag.
MARKUP = (
    ("line_ends", "\r", r"\r\n|\r", "\n"),
    ("front_matter", "---\n", r"\A---\n(?s:.*?)\n---\n", ""),
    ("heading", "#", r"(?dm)^[ \t]*#{1,6}[ \t].*$", ""),
    ("star_rule", "*", r"(?dm)^[ \t]*\*[ \t]*\*[ \t]*\*[* \t]*$", ""),
    ("dash_rule", "---", r"(?dm)^[ \t]*-{3,}[ \t]*$", ""),
    ("underscore_rule", "___", r"(?dm)^[ \t]*_{3,}[ \t]*$", ""),
    ("quote_marker", ">", r"(?dm)^[ \t]*>[ \t]?", ""),
    ("image", "![", r"!\[[^\]]*\]\([^)]*\)", ""),
    ("link", "](", r"\[([^\]]+)\]\([^)]+\)", "$1"),
    ("bold_star", "**", r"\*\*([^*]+)\*\*", "$1"),
    ("bold_underscore", "__", r"__([^_]+)__", "$1"),
    ("italic_star", "*", r"\*([^*\n]+)\*", "$1"),
    ("italic_underscore", "_", r"_([^_\n]+)_", "$1"),
    ("code", "`", r"`([^`]+)`", "$1"),
    ("blank_lines", "\n\n\n", r"\n{3,}", "\n\n"),
)


def clean_markdown(text: Column) -> Column:
    """Reduce a text to plain prose.

    A rule's pattern runs only on texts that contain what it needs, so plain prose costs a few
    substring searches.
    """
    for _, needs, pattern, replacement in MARKUP:
        text = let(text, _without(needs, pattern, replacement))
    return F.trim(text, F.lit(BLANK_CHARS))


def _without(needs: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
    return lambda t: F.when(t.contains(needs), F.regexp_replace(t, pattern, replacement)).otherwise(t)


def cleaned(works: DataFrame, column: str = "text") -> DataFrame:
    return works.withColumn(column, clean_markdown(F.col(column)))
