"""Shared primitives on ordered rows and time intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.functions.columns import hour_bucket


def number_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], breaks, out: str = "run_id") -> DataFrame:
    """Number the runs of each key; `breaks(previous)` gets a lag function and says where a new run opens.

    Meant for keys with a bounded number of rows, such as the hours of one station.
    """
    ordered = W.partitionBy(*keys).orderBy(*order)
    opens = F.coalesce(breaks(lambda c: F.lag(c).over(ordered)), F.lit(False))
    first = F.row_number().over(ordered) == 1
    marked = df.withColumn("_open", (opens | first).cast("long"))
    running = ordered.rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn(out, F.sum("_open").over(running)).drop("_open")


def chunked_previous(df: DataFrame, keys: Sequence[str], time: str, chunk_hours: int, out: str) -> DataFrame:
    """Time of the previous row of the same key, for keys with any number of rows.

    A plain window would sort a whole key in one task. Here rows are ordered inside (key, time chunk); only
    the first row of each chunk needs the last time of the chunk before, and chunks are few.
    """
    keys = list(keys)
    data = df.withColumn("_chunk", hour_bucket(time, chunk_hours))
    inner = W.partitionBy(*keys, "_chunk").orderBy(time)
    chunks = data.groupBy(*keys, "_chunk").agg(F.max(time).alias("_last"))
    before = chunks.withColumn(
        "_chunk_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    previous = F.lag(time).over(inner)
    return data.withColumn("_prev", previous).join(before, [*keys, "_chunk"], "left").withColumn(
        out, F.coalesce("_prev", "_chunk_before")).drop("_prev", "_chunk_before", "_chunk")


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str,
    slot_hours: int = 1, how: str = "inner",
) -> DataFrame:
    """Rows of `points` with `low <= point <= high`, as an equi-join.

    Intervals are exploded into the time slots they touch and meet the points on (keys, slot); the exact
    bounds are checked on the joined rows. No pair outside a shared slot is ever formed.
    """
    slots = F.explode(F.sequence(hour_bucket(low, slot_hours), hour_bucket(high, slot_hours)))
    left = points.withColumn("_slot", hour_bucket(point, slot_hours))
    right = intervals.where(F.col(low) <= F.col(high)).withColumn("_slot_of", slots)
    right = right.withColumnsRenamed({k: f"_{k}_of" for k in keys})
    match = (F.col("_slot") == F.col("_slot_of")) & (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}_of"))
    return left.join(right, match, how).drop("_slot", "_slot_of", *[f"_{k}_of" for k in keys])


def covered_hours(intervals: DataFrame, keys: Sequence[str], low: str, high: str, out: str = "hour_utc") -> DataFrame:
    """Distinct whole hours from floor(low) to floor(high), both included."""
    hours = F.sequence(F.date_trunc("hour", low), F.date_trunc("hour", high), F.expr("INTERVAL 1 HOUR"))
    return intervals.where(F.col(low) <= F.col(high)).select(*keys, F.explode(hours).alias(out)).distinct()


def with_all_labels(counts: DataFrame, label: str, labels: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """A row for every label of a fixed list, in its order, with `fill` where nothing was counted."""
    spark = counts.sparkSession
    fixed = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], f"position int, {label} string")
    return fixed.join(counts, label, "left").fillna(fill).orderBy("position").drop("position")
