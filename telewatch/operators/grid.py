"""Completing irregular observations to a regular time grid.

The order matters for size: raw observations are first reduced to one row per station and bin with a
map-side combined aggregate. From there on a station has at most one row per bin of the calendar,
however many observations it sent, so no station can dominate a later shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import beside, floor_time, iso_utc


def latest_per_bin(
    obs: DataFrame, step_seconds: int, time: str = "obs_time_utc", tiebreak: Sequence[str] = (), out: str = "expected_time_utc"
) -> DataFrame:
    """The latest observation of every (station, bin) and the number of observations the bin received.

    `tiebreak` columns order observations with equal times, the larger wins. Rows without station or time
    are ignored. One shuffle, of at most one row per station, bin and input partition.
    """
    keys = ["station_id", out]
    data = obs.where(F.col("station_id").isNotNull() & F.col(time).isNotNull()).withColumn(
        out, floor_time(time, step_seconds))
    payload = [c for c in obs.columns if c != "station_id"]
    return data.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(time, *tiebreak)).alias("_last"),
        F.count(F.lit(1)).alias("n_observations_in_bin"),
    ).select(*keys, "n_observations_in_bin", *[F.col("_last")[c].alias(c) for c in payload])


def end_date(obs: DataFrame, explicit: str | None = None, time: str = "obs_time_utc") -> DataFrame:
    """One row `end_date`: the explicit date, else the latest requested date, else the latest observed day."""
    if explicit:
        return obs.sparkSession.range(1).select(F.to_date(F.lit(explicit)).alias("end_date"))
    days = [F.max(F.to_date(F.col(time)))]
    if "requested_date" in obs.columns:
        days.insert(0, F.max(F.to_date("requested_date")))
    inferred = F.coalesce(*days)
    return obs.agg(F.coalesce(
        inferred, F.raise_error(F.lit("Could not infer the end date from the observations.")).cast("date")
    ).alias("end_date"))


def expand(bounds: DataFrame, step_seconds: int, start: Column, end: Column, out: str = "expected_time_utc") -> DataFrame:
    """Every station with each bin from start to end. A station whose start lies behind its end has none."""
    steps = F.sequence(start, end, F.expr(f"INTERVAL '{step_seconds}' SECOND"))
    return bounds.where(start <= end).select("station_id", F.explode(steps).alias(out))


def utc_grid(registry: DataFrame, end: DataFrame, step_seconds: int, out: str = "expected_time_utc") -> DataFrame:
    """UTC midnight of `start_date` up to the last bin of the end date, for every registered station."""
    bounds = beside(registry.select("station_id", F.col("start_date").cast("timestamp").alias("_start")), end)
    last = F.col("end_date").cast("timestamp") + F.expr(f"INTERVAL 1 DAY - INTERVAL '{step_seconds}' SECOND")
    return expand(bounds, step_seconds, F.col("_start"), last, out)


def local_day_bounds(start_date: Column, end_day: Column, zone: Column, step_seconds: int) -> tuple[Column, Column]:
    """Local midnight of the first day, and local midnight of the last day plus one day less one bin, in UTC."""
    start = F.to_utc_timestamp(start_date.cast("timestamp"), zone)
    end = F.to_utc_timestamp(end_day.cast("timestamp"), zone)
    return start, end + F.expr(f"INTERVAL 1 DAY - INTERVAL '{step_seconds}' SECOND")


def local_grid(registry: DataFrame, binned: DataFrame, end: DataFrame, step_seconds: int, out: str = "expected_time_utc") -> DataFrame:
    """Grid over local days, widened to the bins that were observed outside of them."""
    # the zone is the first one the station sent
    seen = binned.groupBy("station_id").agg(
        F.min(out).alias("_first"), F.max(out).alias("_last"),
        F.min_by("timezone", F.when(F.col("timezone").isNotNull(), F.col(out))).alias("_zone"),
    )
    bounds = beside(registry.select("station_id", "start_date").join(seen, "station_id", "left"), end)
    zone = F.coalesce("_zone", F.lit(V.DEFAULT_TIMEZONE))
    start, last = local_day_bounds(F.col("start_date"), F.col("end_date"), zone, step_seconds)
    return expand(bounds, step_seconds, F.least(start, "_first"), F.greatest(last, "_last"), out)


def fill_grid(grid: DataFrame, binned: DataFrame, out: str = "expected_time_utc", present: str = "data_present") -> DataFrame:
    """Grid rows with their observation, if any. Counts become 0 and measurements stay null where nothing came.

    Both sides hold a (station, bin) at most once, so the join neither multiplies rows nor skews.
    """
    return grid.join(binned.withColumn(present, F.lit(1)), ["station_id", out], "left").withColumns({
        present: F.coalesce(present, F.lit(0)),
        "n_observations_in_bin": F.coalesce("n_observations_in_bin", F.lit(0)).cast("long"),
    })


def fill_from_registry(filled: DataFrame, registry: DataFrame) -> DataFrame:
    """Zone and coordinates of rows without observation from the registry; elevation always from there."""
    meta = registry.select(
        "station_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
        F.col("elevation_m").alias("_elevation"))
    return filled.join(meta, "station_id", "left").withColumns({
        "latitude": F.coalesce("latitude", "_lat"), "longitude": F.coalesce("longitude", "_lon"),
        "timezone": F.coalesce("timezone", F.lit(V.DEFAULT_TIMEZONE)), "elevation_m": F.col("_elevation"),
    }).drop("_lat", "_lon", "_elevation")


def _binned_and_end(obs: DataFrame, binned: DataFrame | None, step_seconds: int, explicit_end: str | None, tiebreak: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The bins, and the end date: the last time of all bins is that of all observations, so a stored table of bins saves a read of these."""
    bins = latest_per_bin(obs, step_seconds, tiebreak=tiebreak) if binned is None else binned
    return bins, end_date(obs if binned is None or "requested_date" in obs.columns else bins, explicit_end)


def complete_utc(obs: DataFrame, registry: DataFrame, step_seconds: int, explicit_end: str | None = None,
                 tiebreak: Sequence[str] = (), binned: DataFrame | None = None) -> DataFrame:
    """UTC-day completion: observations outside the grid are dropped, coordinates come from the registry. `binned` may be `latest_per_bin`, stored."""
    binned, end = _binned_and_end(obs, binned, step_seconds, explicit_end, tiebreak)
    grid = utc_grid(registry, end, step_seconds)
    filled = fill_grid(grid, binned.drop("latitude", "longitude", "elevation_m"))
    return filled.join(registry.select("station_id", "latitude", "longitude", "elevation_m"), "station_id", "left")


def complete_local(obs: DataFrame, registry: DataFrame, step_seconds: int, explicit_end: str | None = None,
                   tiebreak: Sequence[str] = (), binned: DataFrame | None = None) -> DataFrame:
    """Local-day completion that keeps every observation, with the public gap-filled columns. `binned` may be `latest_per_bin`, stored."""
    binned, end = _binned_and_end(obs, binned, step_seconds, explicit_end, tiebreak)
    grid = local_grid(registry, binned, end, step_seconds)
    filled = fill_from_registry(fill_grid(grid, binned), registry)
    return filled.withColumn("date_utc", F.date_format("expected_time_utc", "yyyy-MM-dd"))


def gap_summary(filled: DataFrame, present: str = "data_present") -> DataFrame:
    here = F.count_if(F.col(present) == 1)
    return filled.agg(
        F.count(F.lit(1)).alias("total_rows"), here.alias("present_rows"),
        (F.count(F.lit(1)) - here).alias("explicit_missing_rows"))


def render_times(filled: DataFrame) -> DataFrame:
    """Text form of the grid time for CSV output."""
    return filled.withColumn("expected_time_utc", iso_utc("expected_time_utc"))
