"""Renaming, ordering, enriching and pruning columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewatch.functions import vocab as V
from telewatch.functions.columns import is_blank


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename what is listed, pass everything else through. Source names may contain dots."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def canonical_observations(df: DataFrame) -> DataFrame:
    return rename(df, V.OBSERVATION_RENAMES)


def canonical_reference_hourly(df: DataFrame) -> DataFrame:
    return rename(df, V.REFERENCE_HOURLY_RENAMES)


def canonical_reference_daily(df: DataFrame) -> DataFrame:
    return rename(df, V.REFERENCE_DAILY_RENAMES)


def drop_redundant(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*V.REDUNDANT_COLUMNS, *extra)


def prefer_order(df: DataFrame, first: list[str]) -> DataFrame:
    """Columns named in `first` that exist, then the others as they are."""
    lead = [c for c in first if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in [*lead, *[c for c in df.columns if c not in lead]]])


def attach_station_metadata(
    df: DataFrame, registry: DataFrame, columns: tuple[str, ...] = ("latitude", "longitude", "elevation_m")
) -> DataFrame:
    """Registry metadata right behind `station_id`; copies that `df` carries are replaced.

    Whether the registry is broadcast is left to the optimiser, which knows its size.
    """
    meta = registry.select("station_id", *columns)
    rest = [c for c in df.columns if c != "station_id" and c not in columns]
    return df.select("station_id", *rest).join(meta, "station_id", "left").select("station_id", *columns, *rest)


def numeric_channels(df: DataFrame, metadata: list[str] | None = None) -> list[str]:
    """Columns to be scored: numeric ones that are not metadata. Read off the schema, no job runs."""
    skip = set(V.METADATA_COLUMNS if metadata is None else metadata)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def holds_value(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return ~is_blank(c) if isinstance(field.dataType, T.StringType) else c.isNotNull()


def column_fill(df: DataFrame) -> DataFrame:
    """(column, non_empty): how many cells of each column hold something, in one scan."""
    counts = df.agg(*[F.count_if(holds_value(f)).alias(f.name) for f in df.schema.fields])
    return counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "non_empty")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value. Runs one aggregate job, because the schema depends on the data."""
    seen = df.agg(*[F.max(holds_value(f)).alias(f.name) for f in df.schema.fields]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if seen[i]])


def reference_coverage(reference: DataFrame, stations: DataFrame, start, end, time: str = "valid_time_utc") -> DataFrame:
    """Per station, whether the reference weather reaches from `start` to `end`; no rows means not covered."""
    span = reference.groupBy("station_id").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    covered = (F.col("first_time") <= lo) & (F.col("last_time") >= hi)
    return stations.select("station_id").join(span, "station_id", "left").withColumn(
        "covered", F.coalesce(covered, F.lit(False))
    )


def station_manifest(grid: DataFrame, time: str = "expected_time_utc") -> DataFrame:
    """Rows, present, missing and grid bounds per station, and the totals as the row with a null station."""
    present = F.sum(F.col("data_present").cast("long"))
    return grid.rollup("station_id").agg(
        F.count(F.lit(1)).alias("rows"), present.alias("present_rows"),
        (F.count(F.lit(1)) - present).alias("missing_rows"),
        F.min(time).alias("grid_start"), F.max(time).alias("grid_end"),
    )
