"""Typed columns from text, with a table of what could not be read.

A cell that says nothing (null or a word for it) becomes null. Any other text that its type does not accept becomes null as well, and leaves a row
(key, column, text) among the rejects, so that no cell is lost without a trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.functions.columns import is_blank

TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parsed(column: str, kind: str) -> Column:
    """The value of a text, or null; times in any of a few forms, without a zone in UTC."""
    text = F.trim(F.col(f"`{column}`"))
    value = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]) if kind == "timestamp" else text.try_cast(kind)
    return F.when(~is_blank(f"`{column}`"), value).cast(kind)


def coerce(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """`df` with the columns of `kinds` typed, and `_rejects`, an array of (column, text) for the cells that were not accepted."""
    faults = [F.when(~is_blank(f"`{c}`") & parsed(c, kind).isNull(), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text")))
              for c, kind in kinds.items()]
    return df.withColumn("_rejects", F.array_compact(F.array(*faults))).withColumns({c: parsed(c, kind) for c, kind in kinds.items()})


def rejects(coerced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per rejected cell: the keys, column and text."""
    return coerced.where(F.size("_rejects") > 0).select(*keys, F.explode("_rejects").alias("r")).select(*keys, "r.column", "r.text")
