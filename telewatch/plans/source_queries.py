"""Queries on what is written and read back: stages, files per station, headers, text that is no value, and shaped columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewatch.functions import vocab as V
from telewatch.functions.columns import beside, iso_utc, offset_text
from telewatch.operators import availability as A
from telewatch.operators import validate as VA
from telewatch.plans.catalog import cte, query
from telewatch.plans.network import Network
from telewatch.sources import commits, event_log, rejects, shape, station_files, tables


def fresh(spark, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{tables.shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# --- stages -------------------------------------------------------------------------------------
@query("committed_stages", "stage outage_class events:i hours:i damaged_files:i", """
SELECT 'raw' AS stage, 'none' AS outage_class, count(*) AS events, sum(duration_hours) AS hours, 0 AS damaged_files FROM raw_events
UNION ALL SELECT 'classified', outage_class, count(*), sum(duration_hours), 0 FROM classified GROUP BY 2""")
def committed_stages(spark, folder):
    """Events are written, read, classified, and written as the next stage; a third writer is lost half-way and leaves no trace."""
    net, root = Network(spark, folder), fresh(spark, "stages")
    commits.write_committed(net.stored_events.drop("outage_class"), root, "events", "raw")
    raw = commits.read_committed(spark, root, "events", "raw")
    commits.write_committed(A.classify_events(raw, net.stored_windows), root, "events", "classified")
    commits.write_attempt(raw.where("duration_hours > 1").withColumn("outage_class", F.lit("lost")), root, "events", "classified")

    def counted(stage: str):
        rows = commits.read_committed(spark, root, "events", stage)
        kind = F.col("outage_class") if "outage_class" in rows.columns else F.lit("none")
        bad = commits.damage(spark, root, "events", stage).agg(F.count(F.lit(1)).alias("damaged_files"))
        return beside(rows.groupBy(F.lit(stage).alias("stage"), kind.alias("outage_class")).agg(
            F.count(F.lit(1)).alias("events"), F.sum("duration_hours").alias("hours")), bad)

    return counted("raw").unionByName(counted("classified"))


# --- files per station --------------------------------------------------------------------------
NO = "cast(substring(station_id, 2) AS bigint)"
EXACT = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("expected_time_utc", T.TimestampType()), T.StructField("temp_avg_c", T.DoubleType())])
GAP = T.StructType([*EXACT.fields, T.StructField("data_present", T.IntegerType())])


@query("station_file_checks", "name status message", f"""
WITH live AS (SELECT DISTINCT station_id FROM hour_bins), broken AS (SELECT station_id FROM live WHERE {NO} % 5 = 1),
alien AS (SELECT count(*) AS n FROM hour_bins WHERE {NO} % 5 = 2 AND hour(hour_utc) = 3),
stations AS (SELECT count(*) AS n FROM live), b AS (SELECT count(*) AS n FROM broken), a AS (SELECT count(DISTINCT station_id) AS n FROM hour_bins WHERE {NO} % 5 = 3 AND hour(hour_utc) = 5)
SELECT 'station_file_counts' AS name, 'PASS' AS status, 'Exact files: ' || n AS message FROM stations
UNION ALL SELECT 'station_file_station_ids_consistent', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, 'Rows under another station''s file: ' || n FROM alien
UNION ALL SELECT 'station_file_exact_counts_match_pooled', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, 'Stations with other counts: ' || n FROM a
UNION ALL SELECT 'station_file_gap_counts_match_pooled', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, 'Stations with other counts: ' || n FROM b
UNION ALL SELECT 'station_file_gap_present_counts_match_exact', 'PASS', 'Stations with other counts: 0'
UNION ALL SELECT 'station_file_gap_frequency_regular_5min', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, 'Files with irregular grids: ' || n FROM b""")
def station_file_checks(spark, folder):
    """Hourly tables written as files per station and read back, with planted defects: rows under another name, lost rows, holes in the grid."""
    net = Network(spark, folder)
    number = F.expr("cast(substring(station_id, 2) AS bigint)")
    live = net.bins.select("station_id").distinct()
    gap = net.hours.join(live, "station_id", "left_semi").select("station_id", F.col("hour_utc").alias("expected_time_utc"), "temp_avg_c", "data_present")
    raw = net.bins.select("station_id", F.col("hour_utc").alias("expected_time_utc"), "temp_avg_c")
    hour = F.hour("expected_time_utc")
    root = fresh(spark, "station-files")
    defects = raw.where(~((number % 5 == 3) & (hour == 5)))  # lost rows
    station_files.write_station_csv(defects, f"{root}/exact", "expected_time_utc")
    # a hole in the grid of every fifth station: an hour without a reading, so that the counts of present rows stay equal
    edge = gap.groupBy("station_id").agg(F.min("expected_time_utc").alias("lo"), F.max("expected_time_utc").alias("hi"))
    inner = gap.where((number % 5 == 1) & (F.col("data_present") == 0)).join(edge, "station_id").where(
        (F.col("expected_time_utc") > F.col("lo")) & (F.col("expected_time_utc") < F.col("hi")))
    hole = inner.groupBy("station_id").agg(F.min("expected_time_utc").alias("hole"))
    holed = gap.join(hole, "station_id", "left").where(F.col("hole").isNull() | (F.col("expected_time_utc") != F.col("hole"))).drop("hole")
    station_files.write_station_csv(holed, f"{root}/gap", "expected_time_utc")
    # files are opened once; the checks read what was found in them several times
    raw_files = tables.materialise(station_files.read_station_csv(spark, f"{root}/exact", EXACT), "exact_files")
    moved = raw_files.withColumn("station_id", F.when((number % 5 == 2) & (hour == 3), "S999999").otherwise(F.col("station_id")))
    gap_files = tables.materialise(station_files.read_station_csv(spark, f"{root}/gap", GAP), "gap_files")
    n = live.count()  # the expected number of stations is a parameter of the check
    return VA.station_file_checks(moved, gap_files, raw, gap, n, step_seconds=3600)


@query("station_file_headers", "name failing_stations:i", f"""
WITH n AS (SELECT station_id, {NO} % 4 AS k FROM hour_bins GROUP BY 1)
SELECT 'header_columns_match' AS name, count(*) FILTER (k > 0) AS failing_stations FROM n UNION ALL SELECT 'header_no_old_names', count(*) FILTER (k = 1) FROM n
UNION ALL SELECT 'header_snake_case', count(*) FILTER (k IN (1, 3)) FROM n UNION ALL SELECT 'header_no_redundant_metadata', count(*) FILTER (k = 2) FROM n""")
def station_file_headers(spark, folder):
    """Files per station, three quarters of them with a planted fault in the header: an old name, a redundant column, a capital letter."""
    rows = event_log.hourly(spark, folder).select("station_id", F.col("hour_utc").alias("expected_time_utc"), "temp_avg_c")
    k, root = F.expr(f"{NO} % 4"), fresh(spark, "headers")
    kinds = [rows, rows.withColumnRenamed("temp_avg_c", "metric.tempAvg"), rows.withColumn("registry_city", F.lit("x")), rows.withColumnRenamed("temp_avg_c", "temp_avg_C")]
    for i, kind in enumerate(kinds):
        station_files.write_station_csv(kind.where(k == i), root, "expected_time_utc", "append")
    return station_files.header_faults(station_files.headers(spark, root), rows.columns)


# --- text that is no value ----------------------------------------------------------------------
cte("raw_text", """
SELECT event_id, CASE WHEN event_id % 89 = 3 THEN 'not a time' WHEN event_id % 89 = 4 THEN '2024-13-45 00:00:00' WHEN event_id % 89 = 5 THEN 'nan' ELSE 'ok' END AS time_case,
  CASE WHEN event_id % 97 = 1 THEN '12,5' WHEN event_id % 97 = 2 THEN 'n/a' WHEN event_id % 97 = 3 THEN '' ELSE 'ok' END AS value_case,
  CASE WHEN event_id % 101 = 7 THEN '1.5.2' WHEN event_id % 101 = 8 THEN 'null' ELSE 'ok' END AS user_case FROM events""")


def raw_text(spark, folder):
    """The log as text, with planted cells that are no values, and others that only say that nothing is there."""
    e = event_log.load(spark, folder, "events", "event_id", "ts", "value", "user_id")
    i = F.col("event_id")
    return e.select(
        "event_id",
        F.when(i % 89 == 3, "not a time").when(i % 89 == 4, "2024-13-45 00:00:00").when(i % 89 == 5, "nan").when(i % 2 == 0, iso_utc("ts")).otherwise(offset_text("ts")).alias("ts"),
        F.when(i % 97 == 1, "12,5").when(i % 97 == 2, "n/a").when(i % 97 == 3, "").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(i % 101 == 7, "1.5.2").when(i % 101 == 8, "null").otherwise(F.col("user_id").cast("string")).alias("user_id"))


KINDS = {"ts": "timestamp", "value": "double", "user_id": "long"}


@query("rejected_text", "column_name text cells:i", """
SELECT 'ts' AS column_name, time_case AS text, count(*) AS cells FROM raw_text WHERE time_case NOT IN ('ok', 'nan') GROUP BY 2
UNION ALL SELECT 'value', value_case, count(*) FROM raw_text WHERE value_case = '12,5' GROUP BY 2
UNION ALL SELECT 'user_id', user_case, count(*) FROM raw_text WHERE user_case = '1.5.2' GROUP BY 2""")
def rejected_text(spark, folder):
    found = rejects.rejects(rejects.coerce(raw_text(spark, folder), KINDS), ["event_id"])
    return found.groupBy(F.col("column").alias("column_name"), "text").agg(F.count(F.lit(1)).alias("cells"))


@query("coerced_rows", "event_id:i ts:t value:f user_id:i", """
SELECT e.event_id, CASE WHEN time_case = 'ok' THEN date_trunc('second', e.ts) END AS ts, CASE WHEN value_case = 'ok' THEN e.value END AS value,
  CASE WHEN user_case = 'ok' THEN e.user_id END AS user_id FROM events e JOIN raw_text r ON r.event_id = e.event_id""")
def coerced_rows(spark, folder):
    return rejects.coerce(raw_text(spark, folder), KINDS).select("event_id", "ts", "value", "user_id")


# --- shaped columns -----------------------------------------------------------------------------
PUBLIC = ["station_id", "obs_time_utc", "obs_time_local", "timezone", *[c for c in V.OBSERVATION_RENAMES.values() if c in V.MEASUREMENTS], "qc_status", "note"]


@query("published_columns", "position:i column_name numeric:b non_empty:i", "\nUNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, {str(c in V.MEASUREMENTS or c == 'qc_status').lower()} AS numeric, "
    + (f"(SELECT count({c}) FROM hour_bins)" if c in V.MEASUREMENTS else "0" if c == "note" else "(SELECT count(*) FROM hour_bins)") + " AS non_empty" for i, c in enumerate(PUBLIC)))
def published_columns(spark, folder):
    """Hours under the names of their source, with metadata that is redundant and a note that says nothing, shaped for publication."""
    old = {new: name for name, new in V.OBSERVATION_RENAMES.items()}
    bins = event_log.hourly(spark, folder)
    source = bins.select(
        F.lit("null").alias("note"), F.lit("x").alias("registry_city"), *[F.col(c).alias(old[c]) for c in V.MEASUREMENTS if c in old], F.lit(1).alias(old["qc_status"]),
        F.col("station_id").alias(old["station_id"]), iso_utc("hour_utc").alias(old["obs_time_utc"]), offset_text("hour_utc").alias(old["obs_time_local"]),
        F.lit(V.DEFAULT_TIMEZONE).alias(old["timezone"]), F.lit("2024-01-01").alias("requested_date"))
    public = shape.prefer_order(shape.drop_redundant(shape.canonical_observations(source)), PUBLIC)
    numeric = set(shape.numeric_channels(public, ["station_id"]))
    place = {c: i for i, c in enumerate(public.columns)}
    facts = F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.struct(F.lit(i).alias("position"), F.lit(c in numeric).alias("numeric")))])
    return shape.column_fill(public).select(facts[F.col("column")]["position"].alias("position"), F.col("column").alias("column_name"),
                                            facts[F.col("column")]["numeric"].alias("numeric"), "non_empty")


@query("reference_columns", "column_name lowest:f highest:f", "\nUNION ALL ".join(
    f"SELECT '{new}' AS column_name, min({m}) AS lowest, max({m}) AS highest FROM hour_bins"
    for new, m in zip([*V.REFERENCE_HOURLY_RENAMES.values(), "base_temperature_max_c", "base_temperature_min_c"], V.MEASUREMENTS)))
def reference_columns(spark, folder):
    """Measurements under the names of a weather reference, renamed; hourly and daily names side by side."""
    names = [*V.REFERENCE_HOURLY_RENAMES, "temperature_2m_max", "temperature_2m_min"]
    rows = event_log.hourly(spark, folder).select(*[F.col(m).alias(n) for n, m in zip(names, V.MEASUREMENTS)])
    renamed = shape.canonical_reference_daily(shape.canonical_reference_hourly(rows))
    extremes = renamed.agg(*[F.struct(F.min(c).alias("lowest"), F.max(c).alias("highest")).alias(c) for c in renamed.columns])
    return extremes.unpivot([], renamed.columns, "column_name", "x").select("column_name", "x.lowest", "x.highest")


# --- sinks and readers --------------------------------------------------------------------------
@query("written_and_read", "sink station_id rows:i total:f", "\nUNION ALL ".join(
    f"SELECT '{s}' AS sink, station_id, count(*) AS rows, sum(temp_avg_c) AS total FROM hour_bins GROUP BY 2" for s in ("csv", "parquet", "by_station_parquet", "by_station_csv")))
def written_and_read(spark, folder):
    """The hourly table through each sink and reader."""
    rows = event_log.hourly(spark, folder).select("station_id", F.col("hour_utc").alias("expected_time_utc"), "temp_avg_c")
    root = fresh(spark, "sinks")
    tables.write_csv(rows, f"{root}/csv")
    tables.write_parquet(rows, f"{root}/parquet")
    tables.write_by_station(rows, f"{root}/by_station_parquet")
    station_files.write_station_csv(rows, f"{root}/by_station_csv", "expected_time_utc")
    back = {"csv": tables.read_csv(spark, f"{root}/csv", EXACT), "parquet": tables.read_parquet(spark, f"{root}/parquet", ["station_id", "temp_avg_c"]),
            "by_station_parquet": tables.read_parquet(spark, f"{root}/by_station_parquet"),
            "by_station_csv": station_files.read_station_csv(spark, f"{root}/by_station_csv", EXACT)}
    out = None
    for sink, df in back.items():
        one = df.groupBy(F.lit(sink).alias("sink"), "station_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("temp_avg_c").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out
