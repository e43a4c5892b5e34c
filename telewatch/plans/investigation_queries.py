"""Registered outage investigations."""

from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.operators import availability as A
from telewatch.operators import investigate as Q
from telewatch.plans.catalog import cte, query
from telewatch.plans.network import MIN_ACTIVE, Network
from telewatch.sources import event_log
from telewatch.sources.tables import materialise

SILENCE = ("2024-01-08 00:00:00", "2024-01-24 23:00:00")


def per_hour(spark, folder, min_active=1):
    return A.offline_by_hour(Network(spark, folder).states, min_active)


cte("per_hour_any", "SELECT *, offline_count / active_count AS offline_fraction FROM per_hour_all WHERE active_count > 0")


def threshold_sql(source):
    return " UNION ALL ".join(f"""SELECT {t} AS threshold, count(*) FILTER (offline_fraction >= {t}) AS hours,
  100.0 * count(*) FILTER (offline_fraction >= {t}) / count(*) AS pct FROM {source}""" for t in V.OFFLINE_THRESHOLDS)


@query("concurrent_offline_thresholds", "threshold:f hours:i pct:f", threshold_sql("per_hour_any"))
def concurrent_offline_thresholds(spark, folder):
    return Q.hours_at_thresholds(per_hour(spark, folder))


@query("mature_offline_thresholds", "threshold:f hours:i pct:f", threshold_sql("per_hour"))
def mature_offline_thresholds(spark, folder):
    return Q.hours_at_thresholds(per_hour(spark, folder, MIN_ACTIVE))


@query("worst_hours", "hour_utc:t active_count:i offline_count:i offline_fraction:f",
       "SELECT * FROM per_hour_any ORDER BY offline_fraction DESC, hour_utc LIMIT 20")
def worst_hours(spark, folder):
    return Q.worst_hours(per_hour(spark, folder))


@query("offline_hour_of_day", "slot hours:i",
       "SELECT hour(hour_utc) AS slot, count(*) AS hours FROM per_hour_any WHERE offline_fraction >= 0.3 GROUP BY 1")
def offline_hour_of_day(spark, folder):
    return Q.offline_histogram(per_hour(spark, folder), 0.3)


@query("mature_offline_months", "slot hours:i",
       "SELECT strftime(hour_utc, '%Y-%m') AS slot, count(*) AS hours FROM per_hour WHERE offline_fraction >= 0.2 GROUP BY 1")
def mature_offline_months(spark, folder):
    return Q.offline_histogram(per_hour(spark, folder, MIN_ACTIVE), 0.2, "month")


@query("offline_at_hour", "hour_utc:t active_count:i offline_count:i offline_fraction:f",
       "SELECT * FROM per_hour_any WHERE hour_utc = TIMESTAMP '2024-01-15 22:00:00'")
def offline_at_hour(spark, folder):
    return Q.at_hour(per_hour(spark, folder), "2024-01-15 22:00:00")


@query("start_hour_counts", "start_hour:i events:i", "SELECT hour(start_utc) AS start_hour, count(*) AS events FROM raw_events GROUP BY 1")
def start_hour_counts(spark, folder):
    return Q.start_hour_counts(Network(spark, folder).raw_events)


@query("midnight_prevalence", "midnight_events:i mean_other_hours:f ratio:f", """
SELECT midnight_events, mean_other_hours, midnight_events / (2 * mean_other_hours) AS ratio FROM (
  SELECT coalesce(sum(n) FILTER (h IN (22, 23)), 0) AS midnight_events, avg(n) FILTER (h NOT IN (22, 23)) AS mean_other_hours
  FROM (SELECT hour(start_utc) AS h, count(*) AS n FROM raw_events GROUP BY 1))""")
def midnight_prevalence(spark, folder):
    return Q.midnight_prevalence(Network(spark, folder).raw_events)


cte("largest_window", "SELECT * FROM windows ORDER BY station_count DESC, window_start_utc LIMIT 1")
cte("outsiders", """
SELECT s.station_id, s.row_state FROM states s, largest_window w WHERE s.hour_utc = w.window_start_utc - INTERVAL 1 HOUR
  AND s.station_id NOT IN (SELECT station_id FROM members m JOIN largest_window l USING (window_id))""")


def outsiders(spark, folder):
    """Stations outside the largest window, one hour before it began."""
    net = Network(spark, folder)
    states, windows = net.stored_states, net.stored_windows
    top = A.largest_windows(windows, 1)
    eve = top.select((F.col("window_start_utc") - F.expr("INTERVAL 1 HOUR")).alias("eve"))
    inside = A.window_members(net.stored_events, top)
    return Q.states_of_outsiders(states, inside, eve.scalar())


@query("states_of_outsiders", "station_id row_state", "SELECT * FROM outsiders")
def states_of_outsiders(spark, folder):
    return outsiders(spark, folder)


@query("outsider_state_counts", "row_state stations:i", "SELECT row_state, count(*) AS stations FROM outsiders GROUP BY 1")
def outsider_state_counts(spark, folder):
    return Q.state_histogram(outsiders(spark, folder))


# --- co-occurrence ----------------------------------------------------------------------------
HAVERSINE = ("2 * 6371.0 * asin(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude))"
             " * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))")
FILTERS = {
    "cooccurrence": "true",
    "cooccurrence_outside_windows": """NOT EXISTS (SELECT 1 FROM windows w
      WHERE s.hour_utc BETWEEN date_trunc('hour', w.backfill_start_utc) AND w.window_end_utc)""",
    "cooccurrence_outside_events": """NOT EXISTS (SELECT 1 FROM classified c WHERE c.outage_class <> 'local'
      AND c.station_id = s.station_id AND s.hour_utc BETWEEN c.start_utc AND c.end_utc)""",
}
for _name, _condition in FILTERS.items():
    cte(f"{_name}_active", f"""SELECT s.station_id, s.hour_utc, s.row_state = '{V.TRUE_OUTAGE}' AS off, r.latitude, r.longitude
FROM states s JOIN reg r USING (station_id) WHERE s.row_state <> '{V.TERMINAL_PADDED}' AND {_condition}""")
    cte(f"{_name}_pairs", f"""SELECT *, CASE WHEN expected_both_offline_if_independent > 0
    THEN n_both_offline / expected_both_offline_if_independent END AS cooccurrence_ratio FROM (
  SELECT *, n_offline_a / n_both_active_hours AS p_offline_a, n_offline_b / n_both_active_hours AS p_offline_b,
    (n_offline_a / n_both_active_hours) * (n_offline_b / n_both_active_hours) * n_both_active_hours AS expected_both_offline_if_independent
  FROM (SELECT a.station_id AS station_a, b.station_id AS station_b, any_value({HAVERSINE}) AS distance_km, count(*) AS n_both_active_hours,
      count(*) FILTER (a.off) AS n_offline_a, count(*) FILTER (b.off) AS n_offline_b, count(*) FILTER (a.off AND b.off) AS n_both_offline
    FROM {_name}_active a JOIN {_name}_active b ON a.hour_utc = b.hour_utc AND a.station_id < b.station_id GROUP BY 1, 2))""")
PAIR = ("station_a station_b distance_km:f n_both_active_hours:i n_offline_a:i n_offline_b:i n_both_offline:i p_offline_a:f "
        "p_offline_b:f expected_both_offline_if_independent:f cooccurrence_ratio:f")


def pairs(spark, folder, kind):
    net = Network(spark, folder)
    states = net.states if kind == "cooccurrence" else net.stored_states
    if kind == "cooccurrence_outside_windows":
        states = Q.without_window_hours(states, net.windows)
    if kind == "cooccurrence_outside_events":
        states = Q.without_network_events(states, net.events)
    return Q.cooccurrence(states, net.registry)


for _name in FILTERS:
    query(_name, PAIR, f"SELECT * FROM {_name}_pairs")(lambda spark, folder, kind=_name: pairs(spark, folder, kind))

BUCKETS = ", ".join(f"({i}, '{label}', {lo}, {hi})" for i, (label, lo, hi) in enumerate(
    zip(V.DISTANCE_LABELS, [-1, *V.DISTANCE_EDGES_KM[1:]], V.DISTANCE_EDGES_KM[1:])))


@query("cooccurrence_by_distance", "distance_bucket n_pairs:i median_ratio:f mean_ratio:f min_ratio:f max_ratio:f", f"""
SELECT b.label AS distance_bucket, count(p.station_a) AS n_pairs, median(cooccurrence_ratio) AS median_ratio, avg(cooccurrence_ratio) AS mean_ratio,
  min(cooccurrence_ratio) AS min_ratio, max(cooccurrence_ratio) AS max_ratio FROM (VALUES {BUCKETS}) b(i, label, lo, hi)
LEFT JOIN cooccurrence_pairs p ON p.distance_km > b.lo AND p.distance_km <= b.hi AND p.cooccurrence_ratio IS NOT NULL GROUP BY 1""")
def cooccurrence_by_distance(spark, folder):
    return Q.ratio_by_distance(materialise(pairs(spark, folder, "cooccurrence"), "station_pairs"))


@query("strongest_pairs", "station_a station_b cooccurrence_ratio:f", """
SELECT * FROM cooccurrence_pairs WHERE cooccurrence_ratio IS NOT NULL ORDER BY cooccurrence_ratio DESC, station_a, station_b LIMIT 15""")
def strongest_pairs(spark, folder):
    return Q.strongest_pairs(pairs(spark, folder, "cooccurrence"))


@query("close_pairs", "station_a station_b distance_km:f cooccurrence_ratio:f", "SELECT * FROM cooccurrence_pairs WHERE distance_km < 200")
def close_pairs(spark, folder):
    return Q.close_pairs(pairs(spark, folder, "cooccurrence"), 200.0)


# --- geography, cadence -----------------------------------------------------------------------
cte("placed", """
SELECT m.window_id, m.station_id, r.latitude, r.longitude FROM members m JOIN reg r USING (station_id)""")
cte("geography", f"""
SELECT w.window_id, w.window_start_utc, w.station_count, w.outage_class, coalesce(n, 0) AS n_stations_resolved,
  CASE WHEN n >= 2 THEN la END AS lat_min, CASE WHEN n >= 2 THEN lb END AS lat_max, CASE WHEN n >= 2 THEN oa END AS lon_min,
  CASE WHEN n >= 2 THEN ob END AS lon_max, CASE WHEN n >= 2 THEN lb - la END AS lat_range, CASE WHEN n >= 2 THEN ob - oa END AS lon_range,
  max_pairwise_km, min_pairwise_km, median_pairwise_km, hour(w.window_start_utc) IN (22, 23) AS is_midnight,
  CASE WHEN n >= 2 THEN 'ok' ELSE 'fewer_than_2_stations' END AS status FROM windows w
LEFT JOIN (SELECT window_id, count(*) AS n, min(latitude) AS la, max(latitude) AS lb, min(longitude) AS oa, max(longitude) AS ob FROM placed GROUP BY 1) p USING (window_id)
LEFT JOIN (SELECT window_id, max(km) AS max_pairwise_km, min(km) AS min_pairwise_km, median(km) AS median_pairwise_km FROM (
  SELECT a.window_id, {HAVERSINE} AS km FROM placed a JOIN placed b ON a.window_id = b.window_id AND a.station_id < b.station_id) GROUP BY 1) d USING (window_id)""")


def geography(spark, folder):
    net = Network(spark, folder)
    return Q.window_geography(net.stored_windows, net.members, net.registry)


@query("window_geography", "window_id window_start_utc:t station_count:i outage_class n_stations_resolved:i lat_min:f lat_max:f lon_min:f lon_max:f "
       "lat_range:f lon_range:f max_pairwise_km:f min_pairwise_km:f median_pairwise_km:f is_midnight:b status", "SELECT * FROM geography")
def window_geography(spark, folder):
    return geography(spark, folder)


@query("geography_summary", "is_midnight:b windows:i median_max_km:f mean_max_km:f min_max_km:f max_max_km:f", """
SELECT is_midnight, count(*) AS windows, median(max_pairwise_km) AS median_max_km, avg(max_pairwise_km) AS mean_max_km,
  min(max_pairwise_km) AS min_max_km, max(max_pairwise_km) AS max_max_km FROM geography WHERE status = 'ok' GROUP BY 1""")
def geography_summary(spark, folder):
    return Q.geography_summary(geography(spark, folder))


@query("window_distance_histogram", "distance_bucket windows:i", f"""
SELECT b.label AS distance_bucket, count(g.window_id) AS windows FROM (VALUES {BUCKETS}) b(i, label, lo, hi)
LEFT JOIN geography g ON g.max_pairwise_km > b.lo AND g.max_pairwise_km <= b.hi AND g.status = 'ok' AND NOT g.is_midnight GROUP BY 1""")
def window_distance_histogram(spark, folder):
    return Q.distance_histogram(geography(spark, folder))


cte("top_details", """
SELECT w.window_id, w.window_start_utc, w.station_count, r.station_id, r.city, r.latitude, r.longitude
FROM (SELECT * FROM windows ORDER BY station_count DESC, window_start_utc LIMIT 5) w JOIN members m USING (window_id) JOIN reg r USING (station_id)""")


def top_details(spark, folder):
    net = Network(spark, folder)
    return Q.top_window_stations(net.stored_windows, net.members, net.registry)


@query("top_window_stations", "window_id window_start_utc:t station_count:i station_id city latitude:f longitude:f", "SELECT * FROM top_details")
def top_window_stations(spark, folder):
    return top_details(spark, folder)


@query("top_window_extent", "window_id station_count:i cities:i lat_min:f lat_max:f lon_min:f lon_max:f", """
SELECT window_id, station_count, count(DISTINCT city) AS cities, min(latitude) AS lat_min, max(latitude) AS lat_max,
  min(longitude) AS lon_min, max(longitude) AS lon_max FROM top_details GROUP BY 1, 2""")
def top_window_extent(spark, folder):
    return Q.top_window_extent(top_details(spark, folder))


@query("top_window_cities", "window_id city stations:i", "SELECT window_id, city, count(*) AS stations FROM top_details GROUP BY 1, 2")
def top_window_cities(spark, folder):
    return Q.top_window_cities(top_details(spark, folder))


@query("window_start_hours", "start_hour:i windows:i", "SELECT hour(window_start_utc) AS start_hour, count(*) AS windows FROM windows GROUP BY 1")
def window_start_hours(spark, folder):
    return Q.window_start_hours(Network(spark, folder).windows)


@query("windows_outside_midnight", "window_id window_start_utc:t station_count:i",
       "SELECT * FROM windows WHERE hour(window_start_utc) NOT IN (22, 23)")
def windows_outside_midnight(spark, folder):
    return Q.windows_outside_midnight(Network(spark, folder).windows)


cte("cadence", """
SELECT *, gap_hours / 24 AS gap_days FROM (SELECT window_id, window_start_utc, station_count, dayname(window_start_utc) AS day_of_week,
  day(window_start_utc) AS day_of_month, strftime(window_start_utc, '%Y-%m') AS year_month, strftime(window_start_utc, '%G-W%V') AS iso_week,
  epoch(window_start_utc - lag(window_start_utc) OVER (ORDER BY window_start_utc)) / 3600.0 AS gap_hours
FROM windows WHERE hour(window_start_utc) IN (22, 23))""")


def cadence(spark, folder):
    return Q.midnight_cadence(Network(spark, folder).windows)


@query("midnight_cadence", "window_id window_start_utc:t station_count:i day_of_week day_of_month:i year_month iso_week gap_hours:f gap_days:f",
       "SELECT * FROM cadence")
def midnight_cadence(spark, folder):
    return cadence(spark, folder)


@query("cadence_weekdays", "day_of_week windows:i", f"""
SELECT d.day_of_week, count(c.window_id) AS windows FROM (VALUES {', '.join(f"('{d}')" for d in V.WEEKDAYS)}) d(day_of_week)
LEFT JOIN cadence c USING (day_of_week) GROUP BY 1""")
def cadence_weekdays(spark, folder):
    return Q.weekday_histogram(cadence(spark, folder))


@query("cadence_days_of_month", "slot windows:i", "SELECT day_of_month AS slot, count(*) AS windows FROM cadence GROUP BY 1")
def cadence_days_of_month(spark, folder):
    return Q.calendar_histogram(cadence(spark, folder), "day_of_month")


@query("cadence_months", "slot windows:i", "SELECT year_month AS slot, count(*) AS windows FROM cadence GROUP BY 1")
def cadence_months(spark, folder):
    return Q.calendar_histogram(cadence(spark, folder), "year_month")


@query("cadence_gaps", "gaps:i median_days:f mean_days:f min_days:f max_days:f", """
SELECT count(gap_days) AS gaps, median(gap_days) AS median_days, avg(gap_days) AS mean_days, min(gap_days) AS min_days, max(gap_days) AS max_days FROM cadence""")
def cadence_gaps(spark, folder):
    return Q.gap_statistics(cadence(spark, folder))


GAPS = ", ".join(f"('{label}', {lo}, {hi})" for label, lo, hi in zip(V.GAP_DAY_LABELS, [-1, *V.GAP_DAY_EDGES[1:]], V.GAP_DAY_EDGES[1:]))


@query("cadence_gap_histogram", "gap_bucket gaps:i", f"""
SELECT b.label AS gap_bucket, count(c.window_id) AS gaps FROM (VALUES {GAPS}) b(label, lo, hi)
LEFT JOIN cadence c ON c.gap_days > b.lo AND c.gap_days <= b.hi GROUP BY 1""")
def cadence_gap_histogram(spark, folder):
    return Q.gap_histogram(cadence(spark, folder))


# --- recovery ---------------------------------------------------------------------------------
cte("recoveries", f"""
SELECT *, epoch(recovery_utc - outage_start_utc) / 3600.0 AS duration_hours FROM (
  SELECT o.*, (SELECT min(s.hour_utc) FROM states s WHERE s.station_id = o.station_id AND s.hour_utc > o.outage_start_utc
    AND s.row_state IN ('{V.COMPLETE}', '{V.PARTIAL}')) AS recovery_utc FROM (
    SELECT w.window_id, m.station_id, min(s.hour_utc) AS outage_start_utc FROM windows w JOIN members m USING (window_id)
    JOIN states s ON s.station_id = m.station_id AND s.hour_utc >= w.backfill_start_utc AND s.row_state = '{V.TRUE_OUTAGE}' GROUP BY 1, 2) o)""")
cte("durations", """
SELECT w.window_id, w.window_start_utc, w.station_count, w.outage_class, n_stations_in_window, r.* EXCLUDE (window_id),
  epoch(latest_outage_start_utc - earliest_outage_start_utc) / 3600.0 AS start_spread_hours,
  epoch(latest_recovery_utc - earliest_recovery_utc) / 3600.0 AS recovery_spread_hours,
  CASE WHEN n_with_duration IS NULL THEN 'no_outages_found' ELSE 'ok' END AS status
FROM windows w LEFT JOIN (SELECT window_id, count(*) AS n_stations_in_window FROM members GROUP BY 1) m USING (window_id)
LEFT JOIN (SELECT window_id, count(duration_hours) AS n_with_duration, count(*) - count(duration_hours) AS n_never_recovered,
  min(outage_start_utc) AS earliest_outage_start_utc, max(outage_start_utc) AS latest_outage_start_utc, min(duration_hours) AS min_duration_hours,
  median(duration_hours) AS median_duration_hours, max(duration_hours) AS max_duration_hours, avg(duration_hours) AS mean_duration_hours,
  min(recovery_utc) AS earliest_recovery_utc, max(recovery_utc) AS latest_recovery_utc FROM recoveries GROUP BY 1) r USING (window_id)""")


@query("station_recoveries", "window_id station_id outage_start_utc:t recovery_utc:t duration_hours:f", "SELECT * FROM recoveries")
def station_recoveries(spark, folder):
    net = Network(spark, folder)
    return Q.station_recoveries(net.stored_windows, net.members, net.stored_states)


def durations(spark, folder):
    net = Network(spark, folder)
    states = net.stored_states
    return Q.window_durations(net.stored_windows, net.members, states)


@query("window_durations", "window_id window_start_utc:t station_count:i outage_class n_stations_in_window:i n_with_duration:i n_never_recovered:i "
       "earliest_outage_start_utc:t latest_outage_start_utc:t start_spread_hours:f min_duration_hours:f median_duration_hours:f "
       "max_duration_hours:f mean_duration_hours:f earliest_recovery_utc:t latest_recovery_utc:t recovery_spread_hours:f status",
       "SELECT * FROM durations")
def window_durations(spark, folder):
    return durations(spark, folder)


@query("duration_summary", "is_midnight:b windows:i median_of_medians:f min_median:f max_median:f never_recovered:i", """
SELECT hour(window_start_utc) IN (22, 23) AS is_midnight, count(*) AS windows, median(median_duration_hours) AS median_of_medians,
  min(median_duration_hours) AS min_median, max(median_duration_hours) AS max_median, sum(n_never_recovered) AS never_recovered
FROM durations WHERE status = 'ok' GROUP BY 1""")
def duration_summary(spark, folder):
    return Q.duration_summary(durations(spark, folder))


cte("last_first", """
SELECT w.window_id, m.station_id, max(o.ts) FILTER (o.ts < w.window_start_utc) AS drop_utc, min(o.ts) FILTER (o.ts > w.window_end_utc) AS back_utc
FROM windows w JOIN members m USING (window_id) JOIN obs o ON o.station_id = m.station_id GROUP BY 1, 2""")
cte("recovery", """
SELECT *, CASE WHEN drop_spread_seconds IS NULL THEN 'unknown' WHEN drop_spread_seconds < 120 THEN 'tight' ELSE 'loose' END AS drop_sync_class FROM (
SELECT w.window_id, w.window_start_utc, w.window_end_utc, w.station_count, w.outage_class, t.stations_targeted, n_with_last_before, n_with_first_after,
  drop_min_utc, drop_max_utc, recovery_min_utc, recovery_max_utc, epoch_us(drop_max_utc - drop_min_utc) / 1e6 AS drop_spread_seconds,
  epoch_us(recovery_max_utc - recovery_min_utc) / 1e6 AS recovery_spread_seconds, make_timestamp(cast(floor(d) AS bigint)) AS drop_median_utc,
  make_timestamp(cast(floor(b) AS bigint)) AS recovery_median_utc, (b - d) / 6e7 AS outage_duration_minutes,
  CASE WHEN n_with_last_before IS NULL THEN 'empty_observations' ELSE 'ok' END AS status
FROM windows w JOIN (SELECT window_id, count(*) AS stations_targeted FROM members GROUP BY 1) t USING (window_id)
LEFT JOIN (SELECT window_id, count(drop_utc) AS n_with_last_before, count(back_utc) AS n_with_first_after, min(drop_utc) AS drop_min_utc,
  max(drop_utc) AS drop_max_utc, median(cast(epoch_us(drop_utc) AS double)) AS d, min(back_utc) AS recovery_min_utc, max(back_utc) AS recovery_max_utc,
  median(cast(epoch_us(back_utc) AS double)) AS b FROM last_first GROUP BY 1) p USING (window_id))""")


def recovery(spark, folder):
    net = Network(spark, folder)
    return Q.window_recovery(net.stored_windows, net.members, event_log.observations(spark, folder))


@query("window_recovery", "window_id window_start_utc:t station_count:i stations_targeted:i n_with_last_before:i n_with_first_after:i drop_min_utc:t "
       "drop_max_utc:t drop_median_utc:t drop_spread_seconds:f recovery_min_utc:t recovery_max_utc:t recovery_median_utc:t "
       "recovery_spread_seconds:f outage_duration_minutes:f status drop_sync_class", "SELECT * FROM recovery")
def window_recovery(spark, folder):
    return recovery(spark, folder)


@query("recovery_summary", "is_midnight:b drop_sync_class windows:i median_spread:f mean_spread:f min_spread:f max_spread:f median_minutes:f mean_minutes:f "
       "min_minutes:f max_minutes:f over_120_minutes:i with_duration:i recovery_missing:i", """
SELECT hour(window_start_utc) IN (22, 23) AS is_midnight, drop_sync_class, count(*) AS windows, median(drop_spread_seconds) AS median_spread,
  avg(drop_spread_seconds) AS mean_spread, min(drop_spread_seconds) AS min_spread, max(drop_spread_seconds) AS max_spread,
  median(outage_duration_minutes) AS median_minutes, avg(outage_duration_minutes) AS mean_minutes, min(outage_duration_minutes) AS min_minutes,
  max(outage_duration_minutes) AS max_minutes, count(*) FILTER (outage_duration_minutes > 120) AS over_120_minutes,
  count(outage_duration_minutes) AS with_duration, count(*) FILTER (n_with_first_after < stations_targeted) AS recovery_missing
FROM recovery WHERE status = 'ok' GROUP BY 1, 2""")
def recovery_summary(spark, folder):
    return Q.recovery_summary(recovery(spark, folder))


# --- silence, cadence of observations, runs ---------------------------------------------------
cte("silent_hours", f"""
SELECT hour_utc, count(*) FILTER (row_state <> '{V.TERMINAL_PADDED}') AS active_count,
  count(*) FILTER (row_state IN ('{V.COMPLETE}', '{V.PARTIAL}')) AS online_count, count(*) FILTER (row_state = '{V.TRUE_OUTAGE}') AS offline_count
FROM states WHERE hour_utc BETWEEN TIMESTAMP '{SILENCE[0]}' AND TIMESTAMP '{SILENCE[1]}' GROUP BY 1""")


def silent_hours(spark, folder):
    return Q.network_counts(Network(spark, folder).states, *SILENCE)


@query("silence_hours", "hour_utc:t active_count:i online_count:i offline_count:i", "SELECT * FROM silent_hours")
def silence_hours(spark, folder):
    return silent_hours(spark, folder)


@query("silence_statistics", "scope hours:i mean:f std:f min:f q1:f median:f q3:f max:f hours_with_3:i hours_with_6:i hours_with_9:i",
       " UNION ALL ".join(f"""SELECT '{scope}' AS scope, count(*) AS hours, avg(online_count) AS mean, stddev_samp(online_count) AS std,
  min(online_count) AS min, quantile_cont(online_count, 0.25) AS q1, median(online_count) AS median, quantile_cont(online_count, 0.75) AS q3,
  max(online_count) AS max, count(*) FILTER (online_count >= 3) AS hours_with_3, count(*) FILTER (online_count >= 6) AS hours_with_6,
  count(*) FILTER (online_count >= 9) AS hours_with_9 FROM silent_hours WHERE {where}"""
                        for scope, where in [("all", "true"), ("midnight", "hour(hour_utc) IN (22, 23)")]))
def silence_statistics(spark, folder):
    return Q.silence_statistics(silent_hours(spark, folder), (3, 6, 9))


@query("silence_weeks", "iso_week mean_online:f min_online:i mean_offline:f", """
SELECT strftime(hour_utc, '%G-W%V') AS iso_week, avg(online_count) AS mean_online, min(online_count) AS min_online, avg(offline_count) AS mean_offline
FROM silent_hours GROUP BY 1""")
def silence_weeks(spark, folder):
    return Q.weekly_online(silent_hours(spark, folder))


@query("observation_cadence", "station_id n_obs:i min_gap_min:f median_gap_min:f max_gap_min:f first:t last:t", """
SELECT station_id, count(*) AS n_obs, min(g) AS min_gap_min, median(g) AS median_gap_min, max(g) AS max_gap_min, min(ts) AS first, max(ts) AS last
FROM (SELECT station_id, ts, epoch_us(ts - lag(ts) OVER (PARTITION BY station_id ORDER BY ts)) / 6e7 AS g FROM obs) GROUP BY 1""")
def observation_cadence(spark, folder):
    return Q.observation_cadence(event_log.observations(spark, folder))


CALM = "data_present = 1 AND windspeed_low_kmh = 0 AND pressure_trend_hpa = 0"
cte("calm_runs", f"""
SELECT station_id, arg_max(s, (n, -epoch_us(s))) AS start_utc, arg_max(e, (n, -epoch_us(s))) AS end_utc, max(n) AS run_rows FROM (
  SELECT station_id, min(hour_utc) AS s, max(hour_utc) AS e, count(*) AS n FROM (
    SELECT station_id, hour_utc, hour_utc - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY station_id ORDER BY hour_utc) AS island
    FROM hours WHERE {CALM}) GROUP BY station_id, island) GROUP BY 1""")


def calm_runs(hours):
    return Q.longest_run(hours, F.expr(CALM))


@query("longest_calm_run", "station_id start_utc:t end_utc:t run_rows:i", "SELECT * FROM calm_runs")
def longest_calm_run(spark, folder):
    return calm_runs(event_log.station_hours(spark, folder))


@query("calm_run_context", "station_id hour_utc:t windspeed_low_kmh:f pressure_trend_hpa:f data_present:i", """
SELECT h.* FROM hours h JOIN calm_runs c ON h.station_id = c.station_id
  AND h.hour_utc BETWEEN c.start_utc - INTERVAL 24 HOUR AND c.end_utc + INTERVAL 24 HOUR""")
def calm_run_context(spark, folder):
    hours = event_log.station_hours(spark, folder)
    return Q.context_of_runs(hours, calm_runs(hours))
