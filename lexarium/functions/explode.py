"""Rows of a computed list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, value: Column, name: str, *keep, position: str | None = None, size: str | None = None) -> DataFrame:
    """``keep`` and one row an element of ``value`` in the column ``name``, with its place and the list's size where these are named.

    The list is computed once: the filters that an explode brings along (not null, not empty) see a column instead of the expression.
    """
    held = df.select(*keep, F.explode(F.array(value)).alias("_list"))
    names = [c if isinstance(c, str) else held.columns[i] for i, c in enumerate(keep)]
    sized = [F.size("_list").cast("bigint").alias(size)] if size else []
    return held.select(*names, *sized, F.posexplode("_list").alias(position, name) if position else F.explode("_list").alias(name))
