"""Dataset validation as tables of checks: (name, status, message).

Each table is scanned once into one row of counts, and the checks are read off that row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import beside, is_blank

SCHEMA = "name string, status string, message string"


def rows_of() -> Column:
    return F.count(F.lit(1))


def passed(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), "PASS").otherwise("FAIL")


def read_off(counts: DataFrame, items: Sequence[tuple[str, Column, str, Column]]) -> DataFrame:
    """Checks from a one-row table: name, condition, and a message made of a text and a number."""
    rows = F.array(*[F.struct(F.lit(name).alias("name"), passed(ok).alias("status"),
                              F.concat(F.lit(f"{text}: "), F.coalesce(value.cast("string"), F.lit("none"))).alias("message"))
                     for name, ok, text, value in items])
    return counts.select(F.explode(rows).alias("c")).select("c.*")


def registry_checks(registry: DataFrame, expected_stations: int | None = None) -> DataFrame:
    missing = [c for c in V.PUBLIC_REGISTRY_COLUMNS if c not in registry.columns]
    if missing:
        return registry.sparkSession.createDataFrame(
            [("registry_required_columns", "FAIL", f"Missing columns: {len(missing)}")], SCHEMA)

    def bad(c: Column) -> Column:
        return F.count_if(~F.coalesce(c, F.lit(False)))

    n = registry.agg(
        rows_of().alias("rows"), F.countDistinct("station_id").alias("ids"),
        bad(F.col("start_date").try_cast("date").isNotNull()).alias("dates"),
        bad(F.col("latitude").try_cast("double").between(-90, 90)).alias("lat"),
        bad(F.col("longitude").try_cast("double").between(-180, 180)).alias("lon"),
        bad(F.col("elevation_m").try_cast("double").isNotNull()).alias("elevation"))
    size_ok = F.lit(True) if expected_stations is None else F.col("rows") == expected_stations
    return read_off(n, [
        ("registry_required_columns", F.lit(True), "Missing columns", F.lit(0)),
        ("registry_station_count", size_ok, "Registry station count", F.col("rows")),
        ("registry_unique_station_ids", F.col("rows") == F.col("ids"), "Distinct station IDs", F.col("ids")),
        ("registry_valid_start_dates", F.col("dates") == 0, "Invalid start dates", F.col("dates")),
        ("registry_valid_latitudes", F.col("lat") == 0, "Latitudes outside [-90, 90]", F.col("lat")),
        ("registry_valid_longitudes", F.col("lon") == 0, "Longitudes outside [-180, 180]", F.col("lon")),
        ("registry_valid_elevations", F.col("elevation") == 0, "Invalid elevations", F.col("elevation"))])


def header_checks(spark: SparkSession, columns: Sequence[str], expected: Sequence[str], prefix: str) -> DataFrame:
    """Checks on column names alone; nothing is scanned."""
    old = [t for t in V.FORBIDDEN_HEADER_TEXT if any(t in c for c in columns)]
    odd = [c for c in columns if not re.match(V.SNAKE_CASE_PATTERN, c)]
    extra = [c for c in columns if c in V.REDUNDANT_COLUMNS]
    rows = [("header_columns_match", list(columns) == list(expected), f"{len(columns)} columns"),
            ("header_no_old_names", not old, f"Old-name fragments: {old}"),
            ("header_snake_case", not odd, f"Non-snake-case columns: {odd}"),
            ("header_no_redundant_metadata", not extra, f"Redundant columns: {extra}")]
    return spark.createDataFrame([(f"{prefix}_{n}", "PASS" if ok else "FAIL", m) for n, ok, m in rows], SCHEMA)


def metadata_mismatches(df: DataFrame, registry: DataFrame, columns: Sequence[str] = ("latitude", "longitude", "elevation_m")) -> DataFrame:
    """One row `mismatch_cells`: cells that differ from the registry, where a null also counts as a difference."""
    reg = registry.select("station_id", *[F.col(c).alias(f"_{c}") for c in columns])
    different = sum(F.coalesce((F.col(c) != F.col(f"_{c}")).cast("long"), F.lit(1)) for c in columns)
    # only distinct combinations meet the registry, so the join does not grow with the observations
    seen = df.groupBy("station_id", *columns).agg(rows_of().alias("_n"))
    return seen.join(reg, "station_id", "left").agg(F.coalesce(F.sum(different * F.col("_n")), F.lit(0)).alias("mismatch_cells"))


def station_differences(left: DataFrame, right: DataFrame, value: str | None = None) -> DataFrame:
    """One row `differing_stations`: stations on one side only, or with unequal `value`."""
    a = left.select("station_id", (F.col(value) if value else F.lit(1)).alias("_l")).distinct()
    b = right.select("station_id", (F.col(value) if value else F.lit(1)).alias("_r")).distinct()
    joined = a.join(b, "station_id", "full_outer")
    return joined.agg(F.count_if(~F.col("_l").eqNullSafe(F.col("_r"))).alias("differing_stations"))


def station_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id").agg(rows_of().alias("rows"))


def qc_histogram(raw: DataFrame) -> DataFrame:
    return raw.groupBy(F.coalesce(F.col("qc_status").cast("string"), F.lit("<NA>")).alias("qc_status")).agg(rows_of().alias("rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row `duplicates`: rows beyond the first of their key. Keys are counted map-side before the shuffle."""
    return df.groupBy(*keys).agg((rows_of() - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("duplicates"))


def raw_checks(raw: DataFrame, registry: DataFrame) -> DataFrame:
    valid = F.coalesce(F.col("qc_status").cast("string").isin("-1", "0", "1"), F.lit(False))
    n = beside(
        raw.agg(rows_of().alias("rows"), F.count_if(~valid).alias("qc"), F.count_if(is_blank("obs_time_utc")).alias("no_time")),
        station_differences(raw, registry), metadata_mismatches(raw, registry), duplicate_keys(raw, ["station_id", "obs_time_utc"]))
    return read_off(n, [
        ("exact_total_rows_positive", F.col("rows") > 0, "Exact pooled rows", F.col("rows")),
        ("exact_station_coverage", F.col("differing_stations") == 0, "Stations not in both", F.col("differing_stations")),
        ("exact_qc_status_values", F.col("qc") == 0, "Invalid qc_status rows", F.col("qc")),
        ("exact_obs_time_present", F.col("no_time") == 0, "Missing obs_time_utc rows", F.col("no_time")),
        ("exact_station_metadata_matches_registry", F.col("mismatch_cells") == 0, "Station metadata mismatch cells", F.col("mismatch_cells")),
        ("exact_no_duplicate_station_timestamps", F.col("duplicates") == 0, "Duplicate station and time rows", F.col("duplicates"))])


def filled_cells_of_missing_rows(gap: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, cells): values that rows without observation carry although they should be blank; one scan."""
    names = [c for c in (columns or V.OBSERVED_COLUMNS) if c in gap.columns]
    missing = F.col("data_present") == 0
    one = gap.agg(*[F.count_if(missing & ~is_blank(c)).alias(c) for c in names])
    return one.unpivot([], names, "column", "cells")


def gap_checks(gap: DataFrame, raw: DataFrame, registry: DataFrame) -> DataFrame:
    present, binned = F.col("data_present"), F.col("n_observations_in_bin")
    here, gone = F.coalesce(present == 1, F.lit(False)), F.coalesce(present == 0, F.lit(False))
    names = [c for c in V.OBSERVED_COLUMNS if c in gap.columns]
    filled = sum(F.count_if(gone & ~is_blank(c)) for c in names) if names else F.lit(0)
    mine = gap.where(here)
    totals = gap.agg(rows_of().alias("rows"), F.count_if(here).alias("present"), F.count_if(gone).alias("missing"),
                     F.count_if(~here & ~gone).alias("presence"), F.count_if((gone & (binned != 0)) | (here & (binned < 1))).alias("bins"),
                     filled.alias("filled"))
    per_station = station_differences(station_counts(mine), station_counts(raw), "rows").withColumnRenamed("differing_stations", "unequal")
    n = beside(totals, raw.agg(rows_of().alias("raw_rows")), station_differences(gap, registry), per_station, metadata_mismatches(gap, registry))
    return read_off(n, [
        ("gap_total_rows_positive", F.col("rows") > 0, "Gap-filled pooled rows", F.col("rows")),
        ("gap_present_rows_equal_exact_rows", F.col("present") == F.col("raw_rows"), "Gap present rows", F.col("present")),
        ("gap_station_coverage", F.col("differing_stations") == 0, "Stations not in both", F.col("differing_stations")),
        ("gap_present_counts_equal_exact_counts", F.col("unequal") == 0, "Stations with other counts", F.col("unequal")),
        ("gap_has_missing_rows", F.col("missing") > 0, "Gap missing rows", F.col("missing")),
        ("gap_data_present_values", F.col("presence") == 0, "Invalid data_present rows", F.col("presence")),
        ("gap_n_observations_in_bin_consistent", F.col("bins") == 0, "Invalid bin count rows", F.col("bins")),
        ("gap_missing_rows_keep_measurements_blank", F.col("filled") == 0, "Filled cells in missing rows", F.col("filled")),
        ("gap_station_metadata_matches_registry", F.col("mismatch_cells") == 0, "Station metadata mismatch cells", F.col("mismatch_cells"))])


def irregular_steps(gap: DataFrame, step_seconds: int, key: str = "station_id", time: str = "expected_time_utc") -> DataFrame:
    """(key, bad_steps): grid rows whose time is missing or not exactly one step behind the row before."""
    ordered = W.partitionBy(key).orderBy(time)
    step = F.unix_micros(time) - F.unix_micros(F.lag(time).over(ordered))
    wrong = F.coalesce(step != step_seconds * 1_000_000, F.lit(False)) | F.col(time).isNull()
    return gap.select(key, time, wrong.alias("_wrong")).groupBy(key).agg(F.count_if("_wrong").alias("bad_steps"))


def station_file_checks(raw_files: DataFrame, gap_files: DataFrame, raw: DataFrame, gap: DataFrame, expected_stations: int, step_seconds: int = 300) -> DataFrame:
    """Per-station files against the pooled tables. Both file tables carry `file_station_id` from the file name."""
    other = F.count_if(~F.col("station_id").eqNullSafe(F.col("file_station_id")))

    def per_file(files: DataFrame, condition: Column | None = None) -> DataFrame:
        rows = files.where(condition) if condition is not None else files
        return rows.groupBy(F.col("file_station_id").alias("station_id")).agg(rows_of().alias("rows"))

    def unequal(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return station_differences(a, b, "rows").withColumnRenamed("differing_stations", name)

    n = beside(
        raw_files.agg(F.countDistinct("file_station_id").alias("raw_n"), other.alias("raw_other")),
        gap_files.agg(F.countDistinct("file_station_id").alias("gap_n"), other.alias("gap_other")),
        unequal(per_file(raw_files), station_counts(raw), "raw_unequal"), unequal(per_file(gap_files), station_counts(gap), "gap_unequal"),
        unequal(per_file(gap_files, F.col("data_present") == 1), station_counts(raw), "present_unequal"),
        irregular_steps(gap_files, step_seconds, "file_station_id").agg(F.count_if(F.col("bad_steps") > 0).alias("irregular")))
    ids = F.col("raw_other") + F.col("gap_other")
    return read_off(n, [
        ("station_file_counts", (F.col("raw_n") == expected_stations) & (F.col("gap_n") == expected_stations), "Exact files", F.col("raw_n")),
        ("station_file_station_ids_consistent", ids == 0, "Rows under another station's file", ids),
        ("station_file_exact_counts_match_pooled", F.col("raw_unequal") == 0, "Stations with other counts", F.col("raw_unequal")),
        ("station_file_gap_counts_match_pooled", F.col("gap_unequal") == 0, "Stations with other counts", F.col("gap_unequal")),
        ("station_file_gap_present_counts_match_exact", F.col("present_unequal") == 0, "Stations with other counts", F.col("present_unequal")),
        ("station_file_gap_frequency_regular_5min", F.col("irregular") == 0, "Files with irregular grids", F.col("irregular"))])


def canonical_checks(df: DataFrame, expected_rows: int | None = None, expected_stations: int | None = None) -> DataFrame:
    """Invariants of the station-hour table with its text timestamps."""
    hour = F.col("hour_utc").try_cast("timestamp")
    plain = F.date_format(hour, "yyyy-MM-dd HH:mm:ss")
    same = F.col("hour_utc").eqNullSafe(F.col("timestamp_utc_dt")) & plain.eqNullSafe(F.col("timestamp_utc"))
    p = F.col("data_present")
    n = beside(
        df.agg(rows_of().alias("rows"), F.countDistinct("station_id").alias("stations"), F.count_if(hour.isNull()).alias("bad_hour"),
               F.count_if(~F.coalesce(F.col("hour_utc").cast("string").endswith("+00:00"), F.lit(False))).alias("no_suffix"),
               F.count_if(~same).alias("unequal"), F.count_if(p.isNotNull() & ~p.isin(0, 1)).alias("presence"),
               F.count_if((p == 1) & F.col("timestamp_local").isNull()).alias("no_local")),
        duplicate_keys(df, ["station_id", "hour_utc"]))
    shape = F.lit(df.columns == V.CANONICAL_COLUMNS) & (F.lit(True) if expected_rows is None else F.col("rows") == expected_rows)
    stations = F.lit(True) if expected_stations is None else F.col("stations") == expected_stations
    return read_off(n, [
        ("canonical_shape", shape, "Rows", F.col("rows")),
        ("canonical_unique_station_hour", F.col("duplicates") == 0, "Duplicate station hours", F.col("duplicates")),
        ("canonical_station_count", stations, "Stations", F.col("stations")),
        ("canonical_hour_is_utc", (F.col("bad_hour") == 0) & (F.col("no_suffix") == 0), "Hours not in UTC", F.col("no_suffix")),
        ("canonical_utc_columns_agree", F.col("unequal") == 0, "Rows with differing UTC columns", F.col("unequal")),
        ("canonical_presence_is_binary", F.col("presence") == 0, "Invalid data_present rows", F.col("presence")),
        ("canonical_local_time_on_live_rows", F.col("no_local") == 0, "Live rows without local time", F.col("no_local"))])


def failed(checks: DataFrame) -> DataFrame:
    return checks.where(F.col("status") == "FAIL")


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(rows_of().alias("checks"), F.count_if(F.col("status") == "FAIL").alias("failed"), passed(
        F.bool_and(F.col("status") == "PASS")).alias("status"))
