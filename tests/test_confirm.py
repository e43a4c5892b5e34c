import datetime as dt

import pytest
from conftest import at
from pyspark.sql import functions as F

from telewatch.functions.columns import has_token
from telewatch.operators import confirm as C
from telewatch.operators import validate as VA
from telewatch.sources import tables

EPISODE = "station_id string, channel string, start_hour timestamp, end_hour timestamp, duration_hours long"


def readings(spark, start=0, **stations):
    return spark.createDataFrame([(s, at(start + i / 12), None if v is None else float(v)) for s, xs in stations.items() for i, v in enumerate(xs)],
                                 "station_id string, expected_time_utc timestamp, temp_avg_c double")


def check(spark, data, hours, channel="temp_avg_c", **options):
    eps = spark.createDataFrame([(s, channel, at(0), at(h - 1), h) for s, h in hours.items()], EPISODE)
    return {r.station_id: r for r in C.confirm(eps, data, **options).collect()}


def test_statuses(spark):
    data = readings(spark, FLAT=[0.0] * 24, RAMP=range(24), NEAR=[1.0] * 119 + [2.0], OFF=[1.0] * 118 + [2.0, 3.0], FEW=[1.0] * 23, GAP=[5, 5, None, 5, 5, 5] * 4)
    got = check(spark, data, {"FLAT": 2, "RAMP": 2, "NEAR": 10, "OFF": 10, "FEW": 2, "GAP": 2, "NODATA": 2})
    assert {s: r.status for s, r in got.items()} == {
        "FLAT": "confirmed_stuck", "RAMP": "not_constant", "NEAR": "confirmed_stuck", "OFF": "not_constant", "FEW": "insufficient_5min_data",
        "GAP": "insufficient_5min_data", "NODATA": "insufficient_5min_data"}
    assert (got["FLAT"].modal_fraction, got["FLAT"].longest_constant_run_hours, got["FLAT"].n_5min_expected) == (1.0, 2.0, 24)
    assert got["GAP"].longest_constant_run_hours == pytest.approx(5 * 5 / 60) and got["GAP"].n_5min_present == 20
    assert got["NODATA"].n_5min_present == 0 and got["NODATA"].modal_value is None
    assert check(spark, data, {"FLAT": 2}, channel="soil_temp")["FLAT"].status == "unmapped_channel"
    assert check(spark, data, {"FLAT": 2}, channel="uv_high")["FLAT"].status == "unmapped_channel"


def test_window_holds_both_ends_and_rounds_half_even(spark):
    data = readings(spark, start=-1 / 12, A=[9, 0.125, 0.125, 9])
    eps = spark.createDataFrame([("A", "temp_avg_c", at(0), at(0), 1)], EPISODE)
    found = C.checks(eps, ["temp_avg_c"]).withColumn("_until", F.lit(at(1 / 12)))
    rows = C.window_readings(found, data, ["temp_avg_c"], 2).collect()
    assert [r.value for r in rows] == [0.12, 0.12]


def test_categories(spark):
    rows = [(.99, 1, 0.0, 0.0), (.90, 5, 0.0, 9.0), (.20, 26, 0.0, 25.0), (.50, 2, 1.0, 1.01), (.5, 11, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "modal_fraction double, n_distinct_values int, min_reading double, max_reading double")
    assert [r.c for r in df.select(C.category().alias("c")).collect()] == [
        "confirmed_flatline", "borderline_lowvar", "ranging_not_stuck", "ambiguous_lowmodal", "ranging_not_stuck"]


EP = "station_id string, start_hour timestamp, end_hour timestamp, dominant_detector string, reasons string, affected_channels string"
EV = "station_id string, channel string, start_hour timestamp, end_hour timestamp, duration_hours long, min_rolling_variance double, reasons string"


def test_dominant_channel(spark):
    eps = spark.createDataFrame([("A", at(0), at(5), "stuck", "stuck_variance_zero", "temp_avg_c|winddir_sin"),
                                 ("B", at(0), at(100), "zscore", "mad_high", "winddir_sin|humidity_low_pct|other"), ("C", at(0), at(0), "zscore", "mad_high", "")], EP)
    ev = spark.createDataFrame([
        ("A", "winddir_sin", at(0), at(3), 4, 0.0, "stuck_variance_zero"), ("A", "windspeed_avg_kmh", at(0), at(1), 2, 0.0, "stuck_variance_zero"),
        ("A", "temp_avg_c", at(0), at(5), 6, 0.0, "iforest_outlier"), ("A", "uv_high", at(50), at(60), 11, 0.0, "stuck_variance_zero"),
        ("B", "temp_avg_c", at(101), at(102), 2, 0.0, "stuck_variance_zero")], EV)
    got = {r.station_id: (r.channel, r.channel_resolution) for r in C.dominant_channels(eps, ev).collect()}
    assert got == {"A": ("winddir_sin", "stuck_event"), "B": ("humidity_low_pct", "fallback_affected_channels"), "C": ("", "fallback_affected_channels")}
    own = eps.withColumn("channel", F.lit("uv_high"))
    assert {r.station_id: r.channel_resolution for r in C.dominant_channels(own, ev).collect()}["A"] == "row_channel"
    assert C.each_channel(eps).count() == 5


def test_relabel_and_summaries(spark):
    data = readings(spark, RANGE=[float(i) for i in range(24)], FLAT=[1.0] * 24)
    eps = spark.createDataFrame([(s, "temp_avg_c", at(0), at(1), 2) for s in ("RANGE", "FLAT")], EPISODE)
    result = C.confirm(eps, data)
    labels = spark.createDataFrame([(s, at(0), at(1), "stuck_flatline") for s in ("RANGE", "FLAT", "NONE")],
                                   "station_id string, start_hour timestamp, end_hour timestamp, label string")
    after = C.relabel(labels, result)
    got = {r.station_id: r for r in after.collect()}
    assert got["RANGE"].label == "outlier_benign" and "spread 23.0)" in got["RANGE"].evidence
    assert got["FLAT"].label == "stuck_flatline" and got["FLAT"].stuck_confirmed_5min and got["NONE"].stuck_5min_status == ""
    assert {r.label: (r.before, r.after) for r in C.label_counts(labels, after).collect()} == {"stuck_flatline": (3, 2), "outlier_benign": (0, 1)}
    assert C.to_recheck(after).count() == 3
    assert {r.status: r.checks for r in C.status_counts(result).collect()} == {
        "confirmed_stuck": 1, "not_constant": 1, "insufficient_5min_data": 0, "unmapped_channel": 0}
    sweep = C.threshold_sweep(result).collect()
    assert [(r.confirmed, r.not_constant) for r in sweep] == [(1, 1)] * 5
    assert C.known_fault_check(result, "FLAT", ["temp_"]).first().all_confirmed is True
    assert C.spread_summary(result).first().spread_gt_5 == 1 and C.widest_profiles(result).first().spread == 23.0
    assert C.headline({"a": result, "b": result}).count() == 2
    assert spark.createDataFrame([("xa|a",)], "r string").select(has_token("r", "a").alias("h")).first().h


# --- validation: every check has to fail once -------------------------------------------------
RAW = "station_id string, latitude double, longitude double, elevation_m double, obs_time_utc timestamp, qc_status int, temp_avg_c double"
GOOD_RAW = [("A", 1.0, 2.0, 3.0, at(0), 1, 5.0), ("B", 1.0, 2.0, 3.0, at(0), -1, 5.0)]
REG = "station_id string, station_name string, city string, country string, latitude double, longitude double, elevation_m double, start_date string"
GOOD_REG = [(s, "n", "c", "k", 1.0, 2.0, 3.0, "2025-01-01") for s in "AB"]


def failures(df):
    return {r.name for r in VA.failed(df).collect()}


def test_registry_and_header_checks(spark):
    assert failures(VA.registry_checks(spark.createDataFrame(GOOD_REG, REG), 2)) == set()
    bad = [("A", "n", "c", "k", 91.0, 181.0, None, "nope")] * 2
    assert failures(VA.registry_checks(spark.createDataFrame(bad, REG), 3)) == {
        "registry_station_count", "registry_unique_station_ids", "registry_valid_start_dates", "registry_valid_latitudes", "registry_valid_longitudes",
        "registry_valid_elevations"}
    assert failures(VA.registry_checks(spark.createDataFrame([("A",)], "station_id string"))) == {"registry_required_columns"}
    assert failures(VA.header_checks(spark, ["a_b"], ["a_b"], "x")) == set()
    assert len(failures(VA.header_checks(spark, ["metric.x", "registry_city"], ["a"], "x"))) == 4


def test_raw_checks(spark):
    reg = spark.createDataFrame(GOOD_REG, REG)
    good = spark.createDataFrame(GOOD_RAW, RAW)
    assert failures(VA.raw_checks(good, reg)) == set()
    bad = spark.createDataFrame([GOOD_RAW[0], GOOD_RAW[0], ("Z", None, 2.0, 3.0, None, 7, 5.0)], RAW)
    assert failures(VA.raw_checks(bad, reg)) == {
        "exact_station_coverage", "exact_qc_status_values", "exact_obs_time_present", "exact_station_metadata_matches_registry", "exact_no_duplicate_station_timestamps"}
    assert failures(VA.raw_checks(good.where("false"), reg)) >= {"exact_total_rows_positive"}
    assert VA.verdict(VA.raw_checks(bad, reg)).first().asDict() == {"checks": 6, "failed": 5, "status": "FAIL"}
    assert {r.qc_status: r.rows for r in VA.qc_histogram(bad).collect()} == {"1": 2, "7": 1}


GAP = "station_id string, latitude double, longitude double, elevation_m double, expected_time_utc timestamp, data_present int, n_observations_in_bin long, temp_avg_c double"


def test_gap_checks_and_station_files(spark):
    reg, raw = spark.createDataFrame(GOOD_REG, REG), spark.createDataFrame(GOOD_RAW, RAW)
    rows = [(s, 1.0, 2.0, 3.0, at(i / 12), int(i == 0), int(i == 0), 5.0 if i == 0 else None) for s in "AB" for i in range(3)]
    gap = spark.createDataFrame(rows, GAP)
    assert failures(VA.gap_checks(gap, raw, reg)) == set()
    bad = spark.createDataFrame([("Z", 9.0, 2.0, 3.0, at(0), 1, 0, 5.0), ("Z", 1.0, 2.0, 3.0, at(0), 5, 0, None)], GAP)
    assert failures(VA.gap_checks(bad, raw, reg)) == {
        "gap_present_rows_equal_exact_rows", "gap_station_coverage", "gap_present_counts_equal_exact_counts", "gap_has_missing_rows", "gap_data_present_values",
        "gap_n_observations_in_bin_consistent", "gap_station_metadata_matches_registry"}
    filled = gap.withColumn("temp_avg_c", F.lit(1.0))
    assert failures(VA.gap_checks(filled, raw, reg)) == {"gap_missing_rows_keep_measurements_blank"}
    assert {r["column"]: r.cells for r in VA.filled_cells_of_missing_rows(filled).collect()} == {"temp_avg_c": 4}
    named = [d.withColumn("file_station_id", F.col("station_id")) for d in (raw, gap)]
    assert failures(VA.station_file_checks(*named, raw, gap, 2)) == set()
    moved = [d.withColumn("file_station_id", F.lit("A")) for d in (raw, gap.where("expected_time_utc <> timestamp'2025-06-01 00:05:00'"))]
    assert len(failures(VA.station_file_checks(*moved, raw, gap, 2))) == 6


def test_station_files_read_from_disk(spark, tmp_path):
    (tmp_path / "A_observations.csv").write_text("station_id,temp_avg_c\nA,1\nA,2\n")
    (tmp_path / "B_observations.csv").write_text("station_id,temp_avg_c\nA,1\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("temp_avg_c", T.DoubleType())])
    files = tables.read_station_files(spark, str(tmp_path / "*.csv"), schema, suffix="_observations")
    assert files.where("station_id <> file_station_id").count() == 1


def test_canonical_checks(spark):
    from telewatch.functions import vocab as V
    base = {c: None for c in V.CANONICAL_COLUMNS}
    schema = ", ".join(f"{c} {'int' if c == 'data_present' else 'string'}" for c in V.CANONICAL_COLUMNS)

    def row(**values):
        return tuple({**base, **values}[c] for c in V.CANONICAL_COLUMNS)

    good = row(station_id="A", hour_utc="2025-06-01 00:00:00+00:00", timestamp_utc_dt="2025-06-01 00:00:00+00:00",
               timestamp_utc="2025-06-01 00:00:00", data_present=1, timestamp_local="2025-06-01 02:00:00")
    assert failures(VA.canonical_checks(spark.createDataFrame([good], schema), 1, 1)) == set()
    bad = row(station_id="A", hour_utc="2025-06-01 00:00:00", timestamp_utc="x", data_present=1)
    worse = row(station_id="A", hour_utc="2025-06-01 00:00:00", timestamp_utc="x", data_present=3)
    assert len(failures(VA.canonical_checks(spark.createDataFrame([bad, worse], schema), 1, 2))) == 7
    assert dt.datetime(2025, 6, 1) == at(0)
