"""A sensor network read from an event log.

`events` holds one row per user action. Sixteen neighbouring users form a station, an action is one observation
of it, and the measurements of an hour are extremes of `value` and of the number `k` in `props`. Regions serve as
registered stations that never reported. The network grows with the log, and so does all work on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import beside, floor_time
from telewatch.operators.grid import utc_grid
from telewatch.sources.tables import materialise, read_parquet

USERS_PER_STATION = 16
HOUR, FIVE_MINUTES = 3600, 300

# Plain SQL arithmetic on the extremes of a bin; shared with the SQL that checks the results.
EXTREMES = {
    "vmax": "max(value)", "vmin": "min(value)",
    "kmax": "cast(max(k) as double)", "kmin": "cast(min(k) as double)",
    "pmax": "max(case when event_type = 'purchase' then value end)",
    "cmin": "min(case when event_type = 'click' then value end)",
}
MEASUREMENT_SQL = {
    "solar_radiation_high_wm2": "vmax * 4", "uv_high": "cast(floor(kmax / 25) as double)",
    "winddir_avg_deg": "kmax * 3.6",
    "humidity_avg_pct": "(kmin + kmax) / 2", "humidity_high_pct": "kmax", "humidity_low_pct": "kmin",
    "temp_avg_c": "(vmin + vmax) / 20 - 5", "temp_high_c": "vmax / 10 - 5", "temp_low_c": "vmin / 10 - 5",
    "windspeed_avg_kmh": "(vmin + vmax) / 2", "windspeed_high_kmh": "vmax",
    "windspeed_low_kmh": "cast(floor(vmin / 40) as double)",
    "windgust_avg_kmh": "pmax", "windgust_high_kmh": "pmax * 1.5",
    "windgust_low_kmh": "cast(floor(cmin / 30) as double)",
    "dewpoint_avg_c": "(vmin + vmax) / 20 - 7", "dewpoint_high_c": "vmax / 10 - 7", "dewpoint_low_c": "vmin / 10 - 7",
    "windchill_avg_c": "(vmin + vmax) / 20 - 6", "windchill_high_c": "vmax / 10 - 6", "windchill_low_c": "vmin / 10 - 6",
    "heatindex_avg_c": "(vmin + vmax) / 20 - 4", "heatindex_high_c": "vmax / 10 - 4", "heatindex_low_c": "vmin / 10 - 4",
    "pressure_max_hpa": "1000 + kmax", "pressure_min_hpa": "1000 + kmin", "pressure_trend_hpa": "(kmax - kmin) / 4",
    "precip_rate_mmh": "cast(floor(vmin / 10) as double)", "precip_total_mm": "cast(floor(vmax / 20) as double)",
}
assert list(MEASUREMENT_SQL) == V.MEASUREMENTS


def load(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{table}.parquet", list(columns) or None)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per action: station, time, tie-break id, value, k."""
    events = load(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    number = F.floor(F.col("user_id") / USERS_PER_STATION).cast("long")
    return events.select(
        F.concat(F.lit("S"), F.lpad(number.cast("string"), 6, "0")).alias("station_id"), number.alias("station_no"),
        F.col("ts").alias("obs_time_utc"), "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements per station and hour, stored: one read of the log, from which registry, end date and grid follow."""
    return materialise(binned(spark, folder, HOUR, "hour_utc"), "station_hours")


def registry(spark: SparkSession, folder: str, bins: DataFrame | None = None) -> DataFrame:
    """Stations with formula-made metadata; the first observed day is the start date. `bins` saves a read of the log."""
    if bins is None:
        live = observations(spark, folder).groupBy("station_id", "station_no").agg(F.to_date(F.min("obs_time_utc")).alias("start_date"))
    else:
        first = bins.groupBy("station_id").agg(F.to_date(F.min("hour_utc")).alias("start_date"))
        live = first.select("station_id", F.expr("cast(substring(station_id, 2) as long)").alias("station_no"), "start_date")
    opening = live.agg(F.min("start_date").alias("start_date"))
    silent = load(spark, folder, "region", "r_regionkey").select(
        F.concat(F.lit("R"), F.lpad(F.col("r_regionkey").cast("string"), 6, "0")).alias("station_id"),
        (F.lit(900000) + F.col("r_regionkey")).cast("long").alias("station_no"))
    everyone = live.unionByName(beside(silent, opening))
    n = F.col("station_no")
    return everyone.select(
        "station_id", F.concat(F.lit("Station "), n.cast("string")).alias("station_name"),
        F.concat(F.lit("City "), (n % 7).cast("string")).alias("city"), F.lit("Nowhere").alias("country"),
        (F.lit(20.0) + (n * 37 % 100) / F.lit(10.0)).alias("latitude"),
        (F.lit(10.0) + (n * 53 % 120) / F.lit(10.0)).alias("longitude"),
        (n * 17 % 900).cast("double").alias("elevation"), F.col("start_date").alias("install_date"), "start_date")


def binned(spark: SparkSession, folder: str, step_seconds: int, out: str) -> DataFrame:
    """Measurements per (station, bin): a map-side combined aggregate over the log."""
    obs = observations(spark, folder).withColumn(out, floor_time("obs_time_utc", step_seconds))
    extremes = [F.expr(sql).alias(name) for name, sql in EXTREMES.items()]
    bins = obs.groupBy("station_id", out).agg(F.count(F.lit(1)).alias("n_raw_records"), *extremes)
    return bins.select("station_id", out, "n_raw_records",
                       *[F.expr(sql).cast("double").alias(name) for name, sql in MEASUREMENT_SQL.items()])


def network_end(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).agg(F.to_date(F.max("obs_time_utc")).alias("end_date"))


def station_hours(spark: SparkSession, folder: str, bins: DataFrame | None = None) -> DataFrame:
    """Complete hourly table of every station, with `data_present` 0 or 1."""
    bins = hourly(spark, folder) if bins is None else bins
    end = bins.agg(F.to_date(F.max("hour_utc")).alias("end_date"))
    grid = utc_grid(registry(spark, folder, bins), end, HOUR, "hour_utc")
    hours = bins.withColumn("data_present", F.lit(1))
    return grid.join(hours, ["station_id", "hour_utc"], "left").withColumns({
        "data_present": F.coalesce("data_present", F.lit(0)), "n_raw_records": F.coalesce("n_raw_records", F.lit(0))})


def five_minute_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings per five minutes in which something was sent."""
    return binned(spark, folder, FIVE_MINUTES, "expected_time_utc")
