"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit separator: cannot occur in a name, so ('a-b', 'c') and ('a', 'b-c') hash apart.
KEY_SEPARATOR = "\x1f"
KEY_NULL = "<null>"


def surrogate_key(*columns: Column | str) -> Column:
    """md5 over the columns' text; null and the empty string give different keys."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(KEY_NULL)) for c in columns]
    return F.md5(F.concat_ws(KEY_SEPARATOR, *parts))
