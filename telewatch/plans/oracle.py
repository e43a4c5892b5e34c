"""SQL of the tables that several queries start from, for checking in another engine."""

from telewatch.functions import vocab as V
from telewatch.plans.catalog import cte
from telewatch.plans.network import MIN_STATIONS, WINDOW_HOURS
from telewatch.sources.event_log import EXTREMES, MEASUREMENT_SQL, USERS_PER_STATION

M = V.MEASUREMENTS

cte("obs", f"""
SELECT 'S' || lpad(cast(user_id // {USERS_PER_STATION} AS varchar), 6, '0') AS station_id,
  user_id // {USERS_PER_STATION} AS station_no, ts, event_id, event_type, value,
  cast(json_extract_string(props, '$.k') AS integer) AS k FROM events""")
cte("reg", """
SELECT station_id, 'Station ' || station_no AS station_name, 'City ' || (station_no % 7) AS city,
  20.0 + (station_no * 37 % 100) / 10.0 AS latitude, 10.0 + (station_no * 53 % 120) / 10.0 AS longitude,
  cast(station_no * 17 % 900 AS double) AS elevation, start_date
FROM (SELECT station_id, station_no, cast(min(ts) AS date) AS start_date FROM obs GROUP BY 1, 2
  UNION ALL SELECT 'R' || lpad(cast(r_regionkey AS varchar), 6, '0'), 900000 + r_regionkey,
    (SELECT cast(min(ts) AS date) FROM obs) FROM region)""")
cte("hour_grid", """
SELECT station_id, unnest(generate_series(cast(start_date AS timestamp),
  (SELECT cast(cast(max(ts) AS date) AS timestamp) FROM obs) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS hour_utc FROM reg""")
cte("hour_bins", f"""
SELECT station_id, hour_utc, n_raw_records, {', '.join(f'cast({s} AS double) AS {m}' for m, s in MEASUREMENT_SQL.items())}
FROM (SELECT station_id, date_trunc('hour', ts) AS hour_utc, count(*) AS n_raw_records,
  {', '.join(f'{s} AS {n}' for n, s in EXTREMES.items())} FROM obs GROUP BY 1, 2)""")
cte("hours", f"""
SELECT g.station_id, g.hour_utc, coalesce(b.n_raw_records, 0) AS n_raw_records, {', '.join(M)},
  CASE WHEN b.station_id IS NULL THEN 0 ELSE 1 END AS data_present
FROM hour_grid g LEFT JOIN hour_bins b ON g.station_id = b.station_id AND g.hour_utc = b.hour_utc""")
cte("states", f"""
SELECT *, CASE
  WHEN station_id IS NULL OR hour_utc IS NULL THEN '{V.INVALID}'
  WHEN first_present IS NULL THEN '{V.NEVER_ACTIVE}'
  WHEN hour_utc < first_present THEN '{V.BEFORE_FIRST}'
  WHEN hour_utc > last_present AND data_present = 0 THEN '{V.TERMINAL_PADDED}'
  WHEN data_present = 1 AND hour_utc < first_present + INTERVAL 7 DAY THEN '{V.WARMUP}'
  WHEN data_present = 0 THEN '{V.TRUE_OUTAGE}'
  WHEN {' OR '.join(f'{m} IS NULL' for m in M)} THEN '{V.PARTIAL}' ELSE '{V.COMPLETE}' END AS row_state
FROM (SELECT *, min(hour_utc) FILTER (data_present = 1) OVER (PARTITION BY station_id) AS first_present,
  max(hour_utc) FILTER (data_present = 1) OVER (PARTITION BY station_id) AS last_present FROM hours)""")
cte("enriched", f"""
SELECT r.*, coalesce(s.present_rate, 0) AS present_rate, coalesce(s.padded, 0) AS terminal_padded_rows,
  CASE WHEN coalesce(s.present_rate, 0) < 0.55 OR coalesce(s.padded, 0) >= 168 THEN 'outage_dominated'
    WHEN s.present_rate < 0.70 THEN 'weak' WHEN s.present_rate < 0.85 THEN 'usable'
    WHEN s.padded > 0 THEN 'reliable_but_terminal_gap' ELSE 'reliable_reference_candidate' END AS status_class
FROM reg r LEFT JOIN (SELECT station_id,
    count(*) FILTER (row_state IN ('{V.WARMUP}', '{V.PARTIAL}', '{V.COMPLETE}')) / count(*) AS present_rate,
    count(*) FILTER (row_state = '{V.TERMINAL_PADDED}') AS padded FROM states GROUP BY 1) s USING (station_id)""")
cte("audit", f"""
SELECT e.station_id, e.station_name, e.city, e.latitude, e.longitude, e.elevation, e.status_class, s.* EXCLUDE (station_id)
FROM enriched e LEFT JOIN (SELECT station_id, count(*) AS total_rows, sum(data_present) AS present_rows,
  count(*) - sum(data_present) AS absent_rows, sum(data_present) / count(*) AS present_rate,
  min(hour_utc) AS first_timestamp_utc, max(hour_utc) AS last_timestamp_utc,
  min(first_present) AS first_present_timestamp, max(last_present) AS last_present_timestamp,
  count(*) FILTER (row_state = '{V.WARMUP}') AS warmup_rows,
  count(*) FILTER (row_state = '{V.TERMINAL_PADDED}') AS terminal_padded_absence_rows,
  count(*) FILTER (row_state = '{V.TRUE_OUTAGE}') AS true_outage_candidate_rows,
  count(*) FILTER (row_state = '{V.PARTIAL}') AS online_partial_missing_rows,
  count(*) FILTER (row_state = '{V.COMPLETE}') AS online_complete_rows FROM states GROUP BY 1) s USING (station_id)""")
cte("raw_events", f"""
SELECT station_id || '__' || strftime(min(hour_utc), '%Y%m%dT%H') || '__' || lpad(cast(count(*) AS varchar), 4, '0') || 'h' AS event_id,
  station_id, min(hour_utc) AS start_utc, max(hour_utc) AS end_utc, count(*) AS duration_hours
FROM (SELECT station_id, hour_utc, hour_utc - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY station_id ORDER BY hour_utc) AS island
  FROM states WHERE row_state = '{V.TRUE_OUTAGE}') GROUP BY station_id, island""")
cte("near_counts", f"""
SELECT s.start_utc, count(DISTINCT e.station_id) AS station_count FROM (SELECT DISTINCT start_utc FROM raw_events) s
JOIN raw_events e ON e.start_utc BETWEEN s.start_utc - INTERVAL {WINDOW_HOURS} HOUR AND s.start_utc + INTERVAL {WINDOW_HOURS} HOUR
GROUP BY 1""")
cte("spans", f"""
SELECT 'NW_' || strftime(min(start_utc), '%Y%m%dT%H') AS window_id,
  CASE WHEN hour(min(start_utc)) IN (22, 23) THEN 'network_midnight' ELSE 'network_other' END AS outage_class,
  min(start_utc) AS window_start_utc, max(start_utc) AS window_end_utc,
  min(start_utc) - INTERVAL {WINDOW_HOURS} HOUR AS backfill_start_utc, max(start_utc) + INTERVAL {WINDOW_HOURS} HOUR AS backfill_end_utc
FROM (SELECT start_utc, sum(opens) OVER (ORDER BY start_utc) AS w FROM (
  SELECT start_utc, CASE WHEN start_utc - lag(start_utc) OVER (ORDER BY start_utc) <= INTERVAL {WINDOW_HOURS} HOUR THEN 0 ELSE 1 END AS opens
  FROM near_counts WHERE station_count >= {MIN_STATIONS})) GROUP BY w""")
cte("windows", f"""
SELECT s.*, count(DISTINCT e.station_id) AS station_count, count(*) AS n_events,
  string_agg(DISTINCT e.station_id, ';' ORDER BY e.station_id) AS station_ids,
  median(duration_hours) AS median_duration_hours, max(duration_hours) AS max_duration_hours, sum(duration_hours) AS total_duration_hours
FROM spans s JOIN raw_events e ON e.start_utc BETWEEN s.backfill_start_utc AND s.backfill_end_utc
GROUP BY ALL HAVING count(DISTINCT e.station_id) >= {MIN_STATIONS}""")
cte("members", """
SELECT DISTINCT w.window_id, e.station_id FROM windows w
JOIN raw_events e ON e.start_utc BETWEEN w.backfill_start_utc AND w.backfill_end_utc""")
cte("classified", """
SELECT e.*, coalesce((SELECT arg_max(w.outage_class, w.window_start_utc) FROM windows w
  WHERE e.start_utc BETWEEN w.backfill_start_utc AND w.backfill_end_utc), 'local') AS outage_class FROM raw_events e""")
cte("reliability", """
SELECT r.station_id, r.city, CASE WHEN r.longitude < 16 THEN 'northwest' ELSE 'southeast' END AS region, r.latitude, r.longitude,
  r.elevation AS elevation_m, a.status_class, 100.0 * a.present_rows / a.total_rows AS uptime_pct, a.total_rows AS total_active_hours,
  a.present_rows AS total_present_hours, a.true_outage_candidate_rows AS total_outage_hours,
  coalesce(n, 0) AS total_event_count, coalesce(n_local, 0) AS local_event_count,
  coalesce(n_midnight, 0) AS network_midnight_event_count, coalesce(n_other, 0) AS network_other_event_count,
  med AS median_event_duration_h, longest AS max_event_duration_h, last_start AS last_outage_start_utc,
  CASE WHEN last_end IS NOT NULL THEN greatest(epoch((SELECT cast(cast(max(ts) AS date) AS timestamp) + INTERVAL 1 DAY FROM obs) - last_end) / 86400.0, 0.0) END AS days_since_last_outage_at_freeze
FROM reg r LEFT JOIN audit a USING (station_id) LEFT JOIN (SELECT station_id, count(*) AS n,
  count(*) FILTER (outage_class = 'local') AS n_local, count(*) FILTER (outage_class = 'network_midnight') AS n_midnight,
  count(*) FILTER (outage_class = 'network_other') AS n_other, median(duration_hours) AS med, max(duration_hours) AS longest,
  max(start_utc) AS last_start, arg_max(end_utc, start_utc) AS last_end FROM classified GROUP BY 1) e USING (station_id)""")
