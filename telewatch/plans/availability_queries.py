"""Registered queries over grids, states, outage events, windows and reliability."""

from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.operators import availability as A
from telewatch.operators import grid as G
from telewatch.operators import states as R
from telewatch.plans.catalog import cte, query
from telewatch.plans.network import MIN_ACTIVE, WINDOW_HOURS, Network
from telewatch.sources import event_log, shape
from telewatch.sources.tables import materialise

M = V.MEASUREMENTS


def raw_observations(spark, folder):
    """Observations under their public names, for the completion operators."""
    obs = event_log.observations(spark, folder)
    return obs.select(
        "station_id", "obs_time_utc", "event_id", "value", F.col("k").cast("double").alias("humidity_avg_pct"),
        F.when(F.col("event_type") == "signup", "Africa/Tripoli").when(F.col("event_type") == "error", "UTC").alias("timezone"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))


def public_registry(spark, folder):
    return event_log.registry(spark, folder).withColumnRenamed("elevation", "elevation_m")


def completed(spark, folder, complete, step_seconds):
    """The log is read once, for its bins; the registry and the end of the network follow from these."""
    obs = raw_observations(spark, folder)
    bins = materialise(G.latest_per_bin(obs, step_seconds, tiebreak=["event_id"]), "bins")
    registry = event_log.registry(spark, folder, bins.withColumnRenamed("expected_time_utc", "hour_utc")).withColumnRenamed("elevation", "elevation_m")
    return complete(obs, registry, step_seconds, binned=bins)


# --- completion -------------------------------------------------------------------------------
cte("latest_5min", """
SELECT station_id, bin, count(*) AS n_observations_in_bin, max(ts) AS obs_time_utc, arg_max(value, (ts, event_id)) AS value,
  arg_max(k, (ts, event_id)) AS k, arg_max(coalesce(CASE event_type WHEN 'signup' THEN 'Africa/Tripoli' WHEN 'error' THEN 'UTC' END, ''),
    (ts, event_id)) AS timezone
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS bin FROM obs) GROUP BY 1, 2""")
cte("filled_hourly", """
SELECT g.station_id, g.hour_utc AS t, coalesce(b.n, 0) AS n_observations_in_bin, CASE WHEN b.n IS NULL THEN 0 ELSE 1 END AS data_present,
  b.value, r.latitude, r.longitude, r.elevation AS elevation_m FROM hour_grid g JOIN reg r USING (station_id)
LEFT JOIN (SELECT station_id, date_trunc('hour', ts) AS h, count(*) AS n, arg_max(value, (ts, event_id)) AS value FROM obs GROUP BY 1, 2) b
  ON b.station_id = g.station_id AND b.h = g.hour_utc""")
cte("local_bounds", """
SELECT r.station_id, coalesce(s.zone, 'Africa/Tripoli') AS zone, r.start_date, s.first_bin, s.last_bin,
  CASE WHEN coalesce(s.zone, 'Africa/Tripoli') = 'UTC' THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END AS shift
FROM reg r LEFT JOIN (SELECT station_id, min(bin) AS first_bin, max(bin) AS last_bin,
  arg_min(timezone, bin) FILTER (timezone <> '') AS zone FROM latest_5min GROUP BY 1) s USING (station_id)""")
cte("local_grid", """
SELECT station_id, zone, unnest(generate_series(least(cast(start_date AS timestamp) - shift, first_bin),
  greatest((SELECT cast(cast(max(ts) AS date) AS timestamp) FROM obs) - shift + INTERVAL 1 DAY - INTERVAL 5 MINUTE, last_bin),
  INTERVAL 5 MINUTE)) AS t FROM local_bounds""")
cte("filled_5min", """
SELECT g.station_id, g.t AS expected_time_utc, CASE WHEN b.bin IS NULL THEN 0 ELSE 1 END AS data_present,
  coalesce(b.n_observations_in_bin, 0) AS n_observations_in_bin, coalesce(nullif(b.timezone, ''), 'Africa/Tripoli') AS timezone,
  r.latitude, r.longitude, r.elevation AS elevation_m, b.value, b.k
FROM local_grid g JOIN reg r USING (station_id) LEFT JOIN latest_5min b ON b.station_id = g.station_id AND b.bin = g.t""")


@query("cadence_bins", "station_id bin:t n:i", """
SELECT station_id, time_bucket(INTERVAL 5 MINUTE, ts) AS bin, count(*) AS n FROM obs GROUP BY 1, 2""")
def cadence_bins(spark, folder):
    from telewatch.functions.columns import floor_time
    obs = event_log.observations(spark, folder)
    return obs.groupBy("station_id", floor_time("obs_time_utc", 300).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_per_bin", "station_id expected_time_utc:t n_observations_in_bin:i obs_time_utc:t value:f humidity_avg_pct:f",
       "SELECT station_id, bin AS expected_time_utc, n_observations_in_bin, obs_time_utc, value, k AS humidity_avg_pct FROM latest_5min")
def latest_per_bin(spark, folder):
    return G.latest_per_bin(raw_observations(spark, folder), 300, tiebreak=["event_id"])


@query("inferred_end_date", "end_date:t", "SELECT cast(max(ts) AS date) AS end_date FROM obs")
def inferred_end_date(spark, folder):
    return G.end_date(raw_observations(spark, folder))


@query("utc_grid", "station_id hour_utc:t", "SELECT station_id, hour_utc FROM hour_grid")
def utc_grid(spark, folder):
    return G.utc_grid(event_log.registry(spark, folder), G.end_date(raw_observations(spark, folder)), 3600, "hour_utc")


@query("complete_utc_grid",
       "station_id expected_time_utc:t data_present:i n_observations_in_bin:i value:f latitude:f longitude:f elevation_m:f",
       "SELECT *, t AS expected_time_utc FROM filled_hourly")
def complete_utc_grid(spark, folder):
    return completed(spark, folder, G.complete_utc, 3600)


def local_completion(spark, folder):
    return completed(spark, folder, G.complete_local, 300)


@query("complete_local_grid",
       "station_id expected_time_utc:t date_utc data_present:i n_observations_in_bin:i timezone latitude:f longitude:f elevation_m:f value:f",
       "SELECT *, strftime(expected_time_utc, '%Y-%m-%d') AS date_utc FROM filled_5min")
def complete_local_grid(spark, folder):
    return local_completion(spark, folder)


@query("gap_summary", "total_rows:i present_rows:i explicit_missing_rows:i", """
SELECT count(*) AS total_rows, sum(data_present) AS present_rows, count(*) - sum(data_present) AS explicit_missing_rows FROM filled_hourly""")
def gap_summary(spark, folder):
    return G.gap_summary(complete_utc_grid(spark, folder))


@query("station_manifest", "station_id rows:i present_rows:i missing_rows:i grid_start:t grid_end:t", """
SELECT station_id, count(*) AS rows, sum(data_present) AS present_rows, count(*) - sum(data_present) AS missing_rows,
  min(expected_time_utc) AS grid_start, max(expected_time_utc) AS grid_end FROM filled_5min GROUP BY ROLLUP (station_id)""")
def station_manifest(spark, folder):
    return shape.station_manifest(local_completion(spark, folder))


@query("reference_coverage", "station_id first_time:t last_time:t covered:b", """
SELECT r.station_id, min(ts) AS first_time, max(ts) AS last_time,
  coalesce(min(ts) <= TIMESTAMP '2024-01-01 12:00:00' AND max(ts) >= TIMESTAMP '2024-01-30 18:00:00', false) AS covered
FROM reg r LEFT JOIN obs o ON o.station_id = r.station_id GROUP BY 1""")
def reference_coverage(spark, folder):
    obs = event_log.observations(spark, folder)
    return shape.reference_coverage(
        obs, event_log.registry(spark, folder), "2024-01-01 12:00:00", "2024-01-30 18:00:00", time="obs_time_utc")


@query("column_fill", "column_name non_empty:i", " UNION ALL ".join(
    f"SELECT '{m}' AS column_name, count({m}) AS non_empty FROM hours" for m in ["station_id", "hour_utc", *M]))
def column_fill(spark, folder):
    return shape.column_fill(event_log.station_hours(spark, folder).select("station_id", "hour_utc", *M)).withColumnRenamed(
        "column", "column_name")


@query("station_metadata", "station_id latitude:f longitude:f elevation_m:f obs_time_utc:t value:f", """
SELECT o.station_id, r.latitude, r.longitude, r.elevation AS elevation_m, o.ts AS obs_time_utc, o.value FROM obs o JOIN reg r USING (station_id)""")
def station_metadata(spark, folder):
    return shape.attach_station_metadata(raw_observations(spark, folder), public_registry(spark, folder))


# --- states, audit, registry ------------------------------------------------------------------
@query("row_states", "station_id hour_utc:t data_present:i first_present_timestamp:t last_present_timestamp:t row_state "
       + " ".join(f"{f}:b" for f in R.FLAGS), f"""
SELECT *, first_present AS first_present_timestamp, last_present AS last_present_timestamp,
  station_id IS NULL AS flag_missing_station_id, hour_utc IS NULL AS flag_missing_timestamp, first_present IS NULL AS flag_station_never_active,
  data_present = 0 AS flag_data_absent, coalesce(hour_utc < first_present, false) AS flag_before_first_present,
  coalesce(hour_utc > last_present, false) AS flag_after_last_present,
  coalesce(data_present = 1 AND hour_utc < first_present + INTERVAL 7 DAY, false) AS flag_warmup,
  data_present = 1 AND ({' OR '.join(f'{m} IS NULL' for m in M)}) AS flag_online_partial_missing,
  data_present = 1 AND ({' AND '.join(f'{m} IS NOT NULL' for m in M)}) AS flag_online_complete,
  coalesce(data_present = 0 AND hour_utc BETWEEN first_present AND last_present, false) AS flag_true_outage_candidate FROM states""")
def row_states(spark, folder):
    return Network(spark, folder).states


@query("row_state_counts", "station_id " + " ".join(f"{s}:i" for s in V.ROW_STATES),
       "SELECT station_id, " + ", ".join(f"count(*) FILTER (row_state = '{s}') AS {s}" for s in V.ROW_STATES) + " FROM states GROUP BY 1")
def row_state_counts(spark, folder):
    return R.state_counts(Network(spark, folder).states)


@query("enriched_registry", "station_id city present_rate:f terminal_padded_rows:i status_class", "SELECT * FROM enriched")
def enriched_registry(spark, folder):
    return R.by_present_rate(Network(spark, folder).enriched)


@query("status_class_counts", "status_class stations:i", "SELECT status_class, count(*) AS stations FROM enriched GROUP BY 1")
def status_class_counts(spark, folder):
    return R.status_counts(Network(spark, folder).enriched)


@query("registry_by_install_date", "station_id install_date:t", "SELECT station_id, start_date AS install_date FROM reg")
def registry_by_install_date(spark, folder):
    return R.by_install_date(Network(spark, folder).registry)


@query("audit_summary", "station_id station_name city latitude:f longitude:f elevation:f status_class total_rows:i present_rows:i "
       "absent_rows:i present_rate:f first_timestamp_utc:t last_timestamp_utc:t first_present_timestamp:t last_present_timestamp:t "
       + " ".join(f"{c}:i" for c in R.AUDIT_COUNTS), "SELECT * FROM audit")
def audit_summary(spark, folder):
    return Network(spark, folder).audit


@query("missingness_by_variable", "variable total_rows:i missing_count:i missing_pct:f missing_pct_when_data_present:f",
       " UNION ALL ".join(f"""SELECT '{m}' AS variable, count(*) AS total_rows, count(*) - count({m}) AS missing_count,
  (count(*) - count({m})) / count(*) AS missing_pct,
  count(*) FILTER (data_present = 1 AND {m} IS NULL) / greatest(count(*) FILTER (data_present = 1), 1) AS missing_pct_when_data_present
FROM hours""" for m in M))
def missingness_by_variable(spark, folder):
    return R.missingness(event_log.station_hours(spark, folder))


@query("station_missingness", "station_id status_class " + " ".join(f"{m}:f" for m in M),
       "SELECT e.station_id, e.status_class, " + ", ".join(f"coalesce(h.{m}, 0) AS {m}" for m in M)
       + " FROM enriched e LEFT JOIN (SELECT station_id, " + ", ".join(f"1 - count({m}) / count(*) AS {m}" for m in M)
       + " FROM hours WHERE data_present = 1 GROUP BY 1) h USING (station_id)")
def station_missingness(spark, folder):
    net = Network(spark, folder)
    return R.station_missingness(net.stored_states, net.enriched)


@query("timeline_segments", "station_id band start_utc:t end_utc:t", f"""
SELECT station_id, band, min(hour_utc) AS start_utc, max(hour_utc) + INTERVAL 1 HOUR AS end_utc FROM (
  SELECT *, hour_utc - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY station_id, band ORDER BY hour_utc) AS island FROM (
    SELECT station_id, hour_utc, CASE WHEN row_state IN ('{V.COMPLETE}', '{V.PARTIAL}') THEN 'online' WHEN row_state = '{V.TRUE_OUTAGE}'
      THEN 'outage' WHEN row_state = '{V.WARMUP}' THEN 'warmup' ELSE 'padded' END AS band FROM states))
GROUP BY station_id, band, island""")
def timeline_segments(spark, folder):
    return R.timeline_segments(Network(spark, folder).states)


# --- outage events and windows ----------------------------------------------------------------
EVENT = "event_id station_id start_utc:t end_utc:t duration_hours:i"


@query("availability_events", EVENT + " outage_class", "SELECT *, 'unknown' AS outage_class FROM raw_events")
def availability_events(spark, folder):
    return Network(spark, folder).raw_events


@query("duration_buckets", "bucket events:i", """
SELECT b.bucket, count(e.event_id) AS events FROM (VALUES ('short', 0, 3), ('medium', 3, 24), ('long', 24, 168), ('very_long', 168, 1000000)) b(bucket, lo, hi)
LEFT JOIN raw_events e ON e.duration_hours > lo AND e.duration_hours <= hi GROUP BY 1""")
def duration_buckets(spark, folder):
    return A.duration_buckets(Network(spark, folder).raw_events)


@query("longest_events", EVENT, "SELECT * FROM raw_events ORDER BY duration_hours DESC, start_utc, station_id LIMIT 10")
def longest_events(spark, folder):
    return A.longest_events(Network(spark, folder).raw_events)


@query("events_per_station", "station_id events:i", "SELECT station_id, count(*) AS events FROM raw_events GROUP BY 1")
def events_per_station(spark, folder):
    return A.events_per_station(Network(spark, folder).raw_events)


@query("neighbour_station_counts", "start_utc:t station_count:i", "SELECT * FROM near_counts")
def neighbour_station_counts(spark, folder):
    return A.stations_starting_near(Network(spark, folder).stored_events, WINDOW_HOURS)


WINDOW = ("window_id outage_class window_start_utc:t window_end_utc:t backfill_start_utc:t backfill_end_utc:t station_count:i n_events:i "
          "median_duration_hours:f max_duration_hours:f total_duration_hours:f")


@query("network_windows", WINDOW, "SELECT * FROM windows")
def network_windows(spark, folder):
    return Network(spark, folder).windows


@query("network_window_members", "window_id station_id", "SELECT * FROM members")
def network_window_members(spark, folder):
    return Network(spark, folder).members


@query("largest_windows", WINDOW, "SELECT * FROM windows ORDER BY station_count DESC, window_start_utc LIMIT 10")
def largest_windows(spark, folder):
    return A.largest_windows(Network(spark, folder).windows)


@query("classified_events", EVENT + " outage_class", "SELECT * FROM classified")
def classified_events(spark, folder):
    return Network(spark, folder).events


@query("outage_class_counts", "outage_class events:i", """
SELECT c.outage_class, count(e.event_id) AS events FROM (VALUES ('local'), ('network_midnight'), ('network_other')) c(outage_class)
LEFT JOIN classified e USING (outage_class) GROUP BY 1""")
def outage_class_counts(spark, folder):
    return A.class_counts(Network(spark, folder).events)


@query("network_events_per_station", "station_id events:i",
       "SELECT station_id, count(*) AS events FROM classified WHERE outage_class <> 'local' GROUP BY 1")
def network_events_per_station(spark, folder):
    return A.network_events_per_station(Network(spark, folder).events)


RELIABILITY = ("station_id city region latitude:f longitude:f elevation_m:f status_class uptime_pct:f total_active_hours:i "
               "total_present_hours:i total_outage_hours:i total_event_count:i local_event_count:i network_midnight_event_count:i "
               "network_other_event_count:i median_event_duration_h:f max_event_duration_h:f last_outage_start_utc:t "
               "days_since_last_outage_at_freeze:f")


@query("station_reliability", RELIABILITY, "SELECT * FROM reliability")
def station_reliability(spark, folder):
    return Network(spark, folder).reliability


@query("downtime_by_class", "station_id downtime_local_h:f downtime_midnight_h:f downtime_other_h:f",
       "SELECT station_id, " + ", ".join(
           f"total_active_hours * (1.0 * {c} / CASE total_event_count WHEN 0 THEN 1 ELSE total_event_count END) * coalesce(median_event_duration_h, 0) AS {n}"
           for n, c in [("downtime_local_h", "local_event_count"), ("downtime_midnight_h", "network_midnight_event_count"),
                        ("downtime_other_h", "network_other_event_count")]) + " FROM reliability")
def downtime_by_class(spark, folder):
    return A.downtime_by_class(Network(spark, folder).reliability)


cte("per_hour_all", f"""
SELECT hour_utc, count(*) FILTER (row_state NOT IN ('terminal_padded_absence')) AS active_count,
  count(*) FILTER (row_state = '{V.TRUE_OUTAGE}') AS offline_count FROM states GROUP BY 1""")
cte("per_hour", f"""
SELECT *, offline_count / active_count AS offline_fraction FROM per_hour_all WHERE active_count >= {MIN_ACTIVE}""")


@query("offline_by_hour", "hour_utc:t active_count:i offline_count:i offline_fraction:f", "SELECT * FROM per_hour")
def offline_by_hour(spark, folder):
    return A.offline_by_hour(Network(spark, folder).states, MIN_ACTIVE)
