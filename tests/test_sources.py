import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from telewatch.functions import vocab as V
from telewatch.sources import commits, rejects, shape, station_files, tables


def test_csv_nan_and_zoneless_time_are_normalised(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station_id,temp\nA,1.5\nB,NaN\nC,\n")
    schema = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("temp", T.DoubleType())])
    got = {r.station_id: r.temp for r in tables.read_csv(spark, str(tmp_path / "a.csv"), schema).collect()}
    assert got == {"A": 1.5, "B": None, "C": None}
    ntz = spark.sql("select timestamp_ntz'2025-01-01 00:00:00' t, double('NaN') v")
    fixed = tables.normalise(ntz)
    assert fixed.schema["t"].dataType == T.TimestampType() and fixed.first().v is None
    assert tables.read_csv_header(spark, str(tmp_path / "a.csv")) == ["station_id", "temp"]


def test_station_files_carry_the_key_of_their_name(spark, tmp_path):
    for s in ("A", "B"):
        (tmp_path / f"{s}_complete.csv").write_text(f"station_id,temp\n{s},1\n")
    schema = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("temp", T.DoubleType())])
    got = tables.read_station_files(spark, str(tmp_path / "*.csv"), schema).collect()
    assert sorted((r.station_id, r.file_station_id) for r in got) == [("A", "A"), ("B", "B")]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "station_id string, v double")
    tables.write_parquet(df, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p"), ["station_id"]).columns == ["station_id"]
    tables.write_by_station(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("station_id=*")} == {"station_id=A", "station_id=B"}
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    raw = tables.write_stage(df, str(tmp_path), "events", "raw")
    tables.write_stage(spark.read.parquet(raw), str(tmp_path), "events", "classified")
    assert spark.read.parquet(str(tmp_path / "events")).groupBy("stage").count().count() == 2
    assert tables.materialise(df, "x").count() == 2


def test_renames_pass_unknown_columns_through(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["stationID", "metric.tempHigh", "other"])
    assert shape.canonical_observations(df).columns == ["station_id", "temp_high_c", "other"]
    hourly = spark.createDataFrame([(1, 2)], ["temperature_2m", "time"])
    assert shape.canonical_reference_hourly(hourly).columns == ["base_temperature_c", "time"]
    daily = spark.createDataFrame([(1,)], ["sunrise"])
    assert shape.canonical_reference_daily(daily).columns == ["base_sunrise_utc"]
    assert shape.prefer_order(df, ["other", "absent"]).columns == ["other", "stationID", "metric.tempHigh"]
    assert shape.drop_redundant(spark.createDataFrame([(1, 2)], ["a", "registry_city"])).columns == ["a"]


def test_metadata_replaces_old_copies_behind_the_key(spark):
    df = spark.createDataFrame([("A", 9.0, 1.0), ("Z", 9.0, 2.0)], "station_id string, latitude double, v double")
    reg = spark.createDataFrame([("A", 1.0, 2.0, 3.0)], "station_id string, latitude double, longitude double, elevation_m double")
    out = shape.attach_station_metadata(df, reg)
    assert out.columns == ["station_id", "latitude", "longitude", "elevation_m", "v"]
    assert {r.station_id: r.latitude for r in out.collect()} == {"A": 1.0, "Z": None}


def test_empty_columns_and_numeric_channels(spark):
    df = spark.createDataFrame([("A", " N/A ", None, 1.0), ("B", "none", None, None)],
                               "station_id string, blank string, gone double, temp_avg_c double")
    assert shape.drop_empty_columns(df).columns == ["station_id", "temp_avg_c"]
    assert {r["column"]: r.non_empty for r in shape.column_fill(df).collect()} == {
        "station_id": 2, "blank": 0, "gone": 0, "temp_avg_c": 1}
    assert shape.numeric_channels(df) == ["gone", "temp_avg_c"]
    assert set(tables.STATION_HOUR_SCHEMA.fieldNames()) == set(V.CANONICAL_COLUMNS)
    assert tables.RAW_SCHEMA.fieldNames() == V.RAW_COLUMNS and tables.GAP_FILLED_SCHEMA.fieldNames() == V.GAP_FILLED_COLUMNS


def test_reference_coverage_and_manifest(spark):
    ref = spark.sql("select 'A' station_id, explode(sequence(timestamp'2025-01-01 00:00:00', timestamp'2025-01-03 00:00:00', interval 1 day)) valid_time_utc")
    stations = spark.createDataFrame([("A",), ("B",)], "station_id string")
    got = {r.station_id: r.covered for r in shape.reference_coverage(ref, stations, "2025-01-01", "2025-01-03").collect()}
    assert got == {"A": True, "B": False}
    grid = spark.createDataFrame([("A", 1, dt.datetime(2025, 1, 1)), ("A", 0, dt.datetime(2025, 1, 2))],
                                 "station_id string, data_present int, expected_time_utc timestamp")
    rows = {r.station_id: (r.rows, r.present_rows, r.missing_rows) for r in shape.station_manifest(grid).collect()}
    assert rows == {"A": (2, 1, 1), None: (2, 1, 1)}


def test_materialised_tables_lie_in_the_shared_folder(spark):
    stored = tables.materialise(spark.range(3), "numbers")
    assert all(tables.shared_folder(spark) in f for f in stored.inputFiles()) and stored.count() == 3


def test_a_stage_is_what_its_manifest_names(spark, tmp_path):
    root, df = str(tmp_path), spark.range(10).withColumnRenamed("id", "v").repartition(3)
    commits.write_committed(df, root, "t", "raw")
    commits.write_attempt(df.where("v > 7"), root, "t", "raw")  # a writer that never commits
    assert commits.read_committed(spark, root, "t", "raw").count() == 10 and commits.damage(spark, root, "t", "raw").count() == 0
    again = commits.write_committed(commits.read_committed(spark, root, "t", "raw").where("v < 4"), root, "t", "raw")
    assert sorted(r.v for r in commits.read_committed(spark, root, "t", "raw").collect()) == [0, 1, 2, 3]
    empty = commits.write_committed(df.where("v < 0"), root, "t", "none")
    assert empty and commits.read_committed(spark, root, "t", "none").count() == 0
    folder = tmp_path / "t" / "data" / "raw" / again
    lost = next(p for p in sorted(folder.glob("part-*.parquet")) if spark.read.parquet(str(p)).count())
    os.remove(lost)
    with pytest.raises(ValueError, match="differ from the manifest"):
        commits.read_committed(spark, root, "t", "raw")


def test_rejected_cells_leave_their_text(spark):
    rows = [(1, "2024-05-01T10:00:00Z", "1.5", "7"), (2, "2024-05-01 10:00:00+0000", "NaN", " 8 "), (3, "2024-02-30", "1,5", "x"), (4, None, "", "n/a"), (5, "2024-05-01", "1e400", "9.5")]
    out = rejects.coerce(spark.createDataFrame(rows, "id int, t string, v string, n string"), {"t": "timestamp", "v": "double", "n": "long"})
    got = {r.id: (r.t, r.v, r.n) for r in out.collect()}
    day = dt.datetime(2024, 5, 1)
    assert got[1] == (day.replace(hour=10), 1.5, 7) and got[2][0] == day.replace(hour=10) and got[2][2] == 8 and got[3] == (None, None, None) and got[4] == (None, None, None)
    bad = sorted((r.id, r.column, r.text) for r in rejects.rejects(out, ["id"]).collect())
    assert [x for x in bad if x[0] in (1, 2, 4)] == [] and [x for x in bad if x[0] == 3] == [(3, "n", "x"), (3, "t", "2024-02-30"), (3, "v", "1,5")]


def test_headers_are_checked_by_task(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0), ("A", dt.datetime(2024, 1, 2), 1.0), ("B", dt.datetime(2024, 1, 1), 2.0)], "station_id string, t timestamp, v double")
    root = str(tmp_path / "f")
    station_files.write_station_csv(df.where("station_id = 'A'"), root, "t")
    station_files.write_station_csv(df.where("station_id = 'B'").withColumnRenamed("v", "qcStatus"), root, "t", "append")
    found = station_files.headers(spark, root)
    assert {(r.file_station_id, r.header) for r in found.collect()} == {("A", "station_id,t,v"), ("B", "station_id,t,qcStatus")}
    got = {r.name: r.failing_stations for r in station_files.header_faults(found, ["station_id", "t", "v"]).collect()}
    assert got == {"header_columns_match": 1, "header_no_old_names": 1, "header_snake_case": 1, "header_no_redundant_metadata": 0}
    back = station_files.read_station_csv(spark, root, df.schema).where("station_id = 'A'")
    assert sorted((r.station_id, r.t, r.v, r.file_station_id) for r in back.collect()) == [("A", dt.datetime(2024, 1, d), 1.0, "A") for d in (1, 2)]


def test_a_station_has_a_file_a_month(spark, tmp_path):
    days = [dt.datetime(2024, m, d, 5) for m in (1, 2) for d in range(1, 29)]
    df = spark.createDataFrame([("A", t, 1.0) for t in days], "station_id string, expected_time_utc timestamp, v double")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # large tables are not merged into few tasks
    try:
        station_files.write_station_csv(df, str(tmp_path / "csv"), "expected_time_utc")
        tables.write_by_station(df, str(tmp_path / "parquet"))
    finally:
        spark.conf.unset(merging)
    assert len(list((tmp_path / "csv").rglob("part-*"))) <= 2 and len(list((tmp_path / "parquet").rglob("part-*"))) <= 2
    assert station_files.read_station_csv(spark, str(tmp_path / "csv"), df.schema).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 56
