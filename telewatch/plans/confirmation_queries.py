"""Registered queries over the five-minute confirmation and over dataset validation."""

from functools import cached_property

from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import has_token
from telewatch.operators import confirm as C
from telewatch.operators import faults as E
from telewatch.operators import grid as G
from telewatch.operators import validate as VA
from telewatch.plans.anomaly_queries import EPISODE, fault_events
from telewatch.plans.catalog import cte, query
from telewatch.sources import event_log
from telewatch.sources.event_log import EXTREMES, MEASUREMENT_SQL
from telewatch.sources.tables import materialise

MIN_READINGS, STATION = 2, "S000001"
READING_COLUMNS = list(dict.fromkeys(V.FIVE_MIN_COLUMN.values()))

cte("readings", f"""
SELECT station_id, t, {', '.join(f'cast({MEASUREMENT_SQL[c]} AS double) AS {c}' for c in READING_COLUMNS)} FROM (
  SELECT station_id, time_bucket(INTERVAL 5 MINUTE, ts) AS t, {', '.join(f'{s} AS {n}' for n, s in EXTREMES.items())} FROM obs GROUP BY 1, 2)""")
cte("stuck_episodes", "SELECT * FROM episodes WHERE list_contains(string_split(reasons, '|'), 'stuck_variance_zero')")
cte("split_episodes", "SELECT *, unnest(string_split(affected_channels, '|')) AS channel FROM stuck_episodes")


def priority_sql(c):
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in V.STUCK_PRIORITY.items()) + f" ELSE {V.NO_PRIORITY} END"


cte("dominant_episodes", f"""
SELECT e.*, coalesce(b.channel, f.channel) AS channel, CASE WHEN b.channel IS NULL THEN 'fallback_affected_channels' ELSE 'stuck_event' END AS channel_resolution
FROM stuck_episodes e LEFT JOIN (SELECT station_id, start_hour, channel FROM (
  SELECT e.station_id, e.start_hour, v.channel, row_number() OVER (PARTITION BY e.station_id, e.start_hour
    ORDER BY v.min_rolling_variance NULLS LAST, v.duration_hours DESC, {priority_sql('v.channel')}, v.channel) AS r
  FROM stuck_episodes e JOIN fault_events v ON v.station_id = e.station_id AND v.start_hour <= e.end_hour AND v.end_hour >= e.start_hour
    AND list_contains(string_split(v.reasons, '|'), 'stuck_variance_zero')) WHERE r = 1) b ON b.station_id = e.station_id AND b.start_hour = e.start_hour
LEFT JOIN (SELECT station_id, start_hour, arg_min(channel, ({priority_sql('channel')}, channel)) AS channel FROM split_episodes GROUP BY 1, 2) f
  ON f.station_id = e.station_id AND f.start_hour = e.start_hour""")

MAPPED = "CASE " + " ".join(f"WHEN channel = '{k}' THEN '{v}'" for k, v in V.FIVE_MIN_COLUMN.items()) + " END"
PICK = "CASE " + " ".join(f"WHEN five_min_column = '{c}' THEN {c}" for c in READING_COLUMNS) + " END"


def confirmation(name, source, extra):
    cte(f"{name}_checks", f"""SELECT station_id, channel, start_hour, end_hour, duration_hours, {extra} AS channel_resolution, {MAPPED} AS five_min_column,
  ({MAPPED}) IN ({', '.join(f"'{c}'" for c in READING_COLUMNS)}) AS usable FROM {source}""")
    cte(f"{name}_window", f"""SELECT c.station_id, c.channel, c.start_hour, r.t, round_even({PICK} * 100, 0) / 100 AS v FROM {name}_checks c
  JOIN readings r ON r.station_id = c.station_id AND r.t >= c.start_hour AND r.t <= c.start_hour + INTERVAL 1 HOUR * c.duration_hours - INTERVAL 5 MINUTE
  WHERE c.usable""")
    cte(f"{name}_stats", f"""SELECT station_id, channel, start_hour, sum(n) AS n, count(*) AS d, max(n) AS top, arg_max(v, (n, -v)) AS modal, min(v) AS lo, max(v) AS hi
  FROM (SELECT station_id, channel, start_hour, v, count(*) AS n FROM {name}_window WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
    cte(f"{name}_runs", f"""SELECT station_id, channel, start_hour, max(n) * 5 / 60.0 AS longest FROM (
  SELECT station_id, channel, start_hour, run, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY station_id, channel, start_hour ORDER BY t) AS run FROM (
    SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY station_id, channel, start_hour ORDER BY t) THEN 0 ELSE 1 END AS opens FROM {name}_window))
  WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
    cte(name, f"""SELECT *, n_5min_present / n_5min_expected AS present_fraction, usable AND n_5min_present >= {MIN_READINGS} AND modal_fraction >= 0.99 AS confirmed_stuck_5min,
  CASE WHEN NOT usable THEN 'unmapped_channel' WHEN n_5min_present < {MIN_READINGS} THEN 'insufficient_5min_data' WHEN modal_fraction >= 0.99 THEN 'confirmed_stuck'
    ELSE 'not_constant' END AS status FROM (
  SELECT c.*, c.duration_hours * 12 AS n_5min_expected, coalesce(s.n, 0) AS n_5min_present, coalesce(s.d, 0) AS n_distinct_values, s.modal AS modal_value, s.lo AS min_reading,
    s.hi AS max_reading, coalesce(s.top / s.n, 0) AS modal_fraction, coalesce(r.longest, 0) AS longest_constant_run_hours FROM {name}_checks c
  LEFT JOIN {name}_stats s ON s.station_id = c.station_id AND s.channel = c.channel AND s.start_hour = c.start_hour
  LEFT JOIN {name}_runs r ON r.station_id = c.station_id AND r.channel = c.channel AND r.start_hour = c.start_hour)""")


confirmation("channel_confirmed", "split_episodes", "'all_channels'")
confirmation("dominant_confirmed", "dominant_episodes", "channel_resolution")


class Confirmation:
    """Stored events and episodes, and the confirmations that start from them."""

    def __init__(self, spark, folder):
        self.events = materialise(fault_events(spark, folder), "fault_events")
        self.episodes = materialise(E.fault_episodes(self.events).where(has_token("reasons", V.STUCK_REASON)), "stuck_episodes")
        self.readings = event_log.five_minute_readings(spark, folder).select("station_id", "expected_time_utc", *READING_COLUMNS)

    def per_channel(self):
        return C.confirm(C.each_channel(self.episodes), self.readings, MIN_READINGS, extra=["channel_resolution"])

    def dominant(self):
        return C.confirm_dominant(self.episodes, self.events, self.readings, min_readings=MIN_READINGS)


RESULT = ("station_id channel start_hour:t end_hour:t duration_hours:i five_min_column n_5min_expected:i n_5min_present:i present_fraction:f n_distinct_values:i "
          "modal_value:f min_reading:f max_reading:f modal_fraction:f longest_constant_run_hours:f confirmed_stuck_5min:b status channel_resolution")


@query("expanded_channels", EPISODE + " channel", "SELECT * FROM split_episodes")
def expanded_channels(spark, folder):
    return C.each_channel(E.fault_episodes(fault_events(spark, folder)).where(has_token("reasons", V.STUCK_REASON)))


@query("dominant_channels", EPISODE + " channel channel_resolution", "SELECT * FROM dominant_episodes")
def dominant_channels(spark, folder):
    c = Confirmation(spark, folder)
    return C.dominant_channels(c.episodes, c.events)


@query("channel_confirmation", RESULT, "SELECT * FROM channel_confirmed")
def channel_confirmation(spark, folder):
    return Confirmation(spark, folder).per_channel()


@query("dominant_confirmation", RESULT, "SELECT * FROM dominant_confirmed")
def dominant_confirmation(spark, folder):
    return Confirmation(spark, folder).dominant()


@query("confirmation_headline", "mode checks:i confirmed_fraction:f " + " ".join(f"{s}:i" for s in C.STATUSES), " UNION ALL ".join(
    f"SELECT '{m}' AS mode, count(*) AS checks, count(*) FILTER (status = 'confirmed_stuck') / count(*) AS confirmed_fraction, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in C.STATUSES) + f" FROM {m}_confirmed" for m in ("channel", "dominant")))
def confirmation_headline(spark, folder):
    c = Confirmation(spark, folder)
    return C.headline({"channel": c.per_channel(), "dominant": c.dominant()})


@query("confirmation_statuses", "status checks:i", f"""SELECT s.status, count(c.channel) AS checks
FROM (VALUES {', '.join(f"('{s}')" for s in C.STATUSES)}) s(status) LEFT JOIN channel_confirmed c USING (status) GROUP BY 1""")
def confirmation_statuses(spark, folder):
    return C.status_counts(channel_confirmation(spark, folder))


@query("not_constant_medians", "median_modal_fraction:f median_n_distinct_values:f median_longest_constant_run_hours:f", """
SELECT median(modal_fraction) AS median_modal_fraction, median(n_distinct_values) AS median_n_distinct_values,
  median(longest_constant_run_hours) AS median_longest_constant_run_hours FROM channel_confirmed WHERE status = 'not_constant'""")
def not_constant_medians(spark, folder):
    return C.not_constant_medians(channel_confirmation(spark, folder))


@query("not_constant_by_channel", "channel checks:i", "SELECT channel, count(*) AS checks FROM channel_confirmed WHERE status = 'not_constant' GROUP BY 1")
def not_constant_by_channel(spark, folder):
    return C.not_constant_by_channel(channel_confirmation(spark, folder))


_BINS = [("modal_fraction", "0.95-0.99", "modal_fraction >= 0.95 AND modal_fraction < 0.99"), ("modal_fraction", "0.90-0.95", "modal_fraction >= 0.9 AND modal_fraction < 0.95"),
         ("modal_fraction", "0.80-0.90", "modal_fraction >= 0.8 AND modal_fraction < 0.9"), ("modal_fraction", "<0.80", "modal_fraction < 0.8"),
         ("n_distinct_values", "2-3", "n_distinct_values BETWEEN 2 AND 3"), ("n_distinct_values", "4-10", "n_distinct_values BETWEEN 4 AND 10"),
         ("n_distinct_values", ">10", "n_distinct_values > 10")]


@query("confirmation_shapes", "measure bucket checks:i", " UNION ALL ".join(
    f"SELECT '{m}' AS measure, '{b}' AS bucket, count(*) AS checks FROM channel_confirmed WHERE status = 'not_constant' AND {c}" for m, b, c in _BINS))
def confirmation_shapes(spark, folder):
    return C.shape_histogram(channel_confirmation(spark, folder))


@query("confirmation_sweep", "threshold:f confirmed:i not_constant:i insufficient_5min_data:i unmapped_channel:i fraction_confirmed:f", " UNION ALL ".join(f"""
SELECT {t} AS threshold, count(*) FILTER (n_5min_present >= {MIN_READINGS} AND modal_fraction >= {t}) AS confirmed,
  count(*) FILTER (n_5min_present >= {MIN_READINGS} AND modal_fraction < {t} AND status <> 'unmapped_channel') AS not_constant,
  count(*) FILTER (n_5min_present < {MIN_READINGS}) AS insufficient_5min_data, count(*) FILTER (status = 'unmapped_channel') AS unmapped_channel,
  count(*) FILTER (n_5min_present >= {MIN_READINGS} AND modal_fraction >= {t}) / count(*) AS fraction_confirmed FROM channel_confirmed""" for t in C.SWEEP))
def confirmation_sweep(spark, folder):
    return C.threshold_sweep(channel_confirmation(spark, folder), min_readings=MIN_READINGS)


@query("nearly_constant", "station_id channel start_hour:t modal_fraction:f n_distinct_values:i", """
SELECT * FROM channel_confirmed WHERE status = 'not_constant' ORDER BY modal_fraction DESC, n_distinct_values, station_id, channel, start_hour LIMIT 5""")
def nearly_constant(spark, folder):
    return C.nearly_constant(channel_confirmation(spark, folder))


@query("widest_profiles", "station_id channel start_hour:t duration_hours:i spread:f n_distinct_values:i", """
SELECT *, max_reading - min_reading AS spread FROM channel_confirmed WHERE modal_fraction < 0.8
ORDER BY spread DESC NULLS LAST, n_distinct_values DESC, duration_hours DESC, station_id, channel, start_hour LIMIT 15""")
def widest_profiles(spark, folder):
    return C.widest_profiles(channel_confirmation(spark, folder))


@query("spread_summary", "total:i spread_gt_5:i spread_le_5:i mean:f std:f min:f q1:f median:f q3:f max:f", """
SELECT count(*) AS total, count(*) FILTER (s > 5) AS spread_gt_5, count(*) FILTER (s <= 5) AS spread_le_5, avg(s) AS mean, stddev_samp(s) AS std, min(s) AS min,
  quantile_cont(s, 0.25) AS q1, median(s) AS median, quantile_cont(s, 0.75) AS q3, max(s) AS max
FROM (SELECT max_reading - min_reading AS s FROM channel_confirmed WHERE modal_fraction < 0.8)""")
def spread_summary(spark, folder):
    return C.spread_summary(channel_confirmation(spark, folder))


@query("known_fault_check", "checks:i all_confirmed:b", f"""
SELECT count(*) AS checks, bool_and(confirmed_stuck_5min) AS all_confirmed FROM channel_confirmed WHERE station_id = '{STATION}' AND channel LIKE 'pressure_%'""")
def known_fault_check(spark, folder):
    return C.known_fault_check(channel_confirmation(spark, folder), STATION, ["pressure_"])


cte("labels_before", """SELECT station_id, start_hour, end_hour, CASE WHEN dominant_detector = 'stuck' THEN 'stuck_flatline' ELSE 'other' END AS label FROM stuck_episodes""")
cte("labels_after", """
SELECT station_id, start_hour, end_hour, stuck_5min_status, stuck_5min_status = 'confirmed_flatline' AS stuck_confirmed_5min,
  CASE WHEN moved THEN 'outlier_benign' ELSE label END AS label,
  CASE WHEN moved THEN 'hourly stuck flag not supported at 5-minute resolution; sensor ranging (min-max spread ' || spread || '), reclassified as benign low-variance' ELSE '' END AS evidence
FROM (SELECT *, label = 'stuck_flatline' AND stuck_5min_status = 'ranging_not_stuck' AS moved FROM (
  SELECT l.*, round_even((d.max_reading - d.min_reading) * 100, 0) / 100 AS spread, CASE WHEN d.station_id IS NULL THEN '' WHEN d.modal_fraction >= 0.99 THEN 'confirmed_flatline'
    WHEN d.modal_fraction >= 0.8 THEN 'borderline_lowvar' WHEN coalesce(d.max_reading - d.min_reading, 0) > 5 OR d.n_distinct_values > 10 THEN 'ranging_not_stuck'
    ELSE 'ambiguous_lowmodal' END AS stuck_5min_status
  FROM labels_before l LEFT JOIN dominant_confirmed d ON d.station_id = l.station_id AND d.start_hour = l.start_hour AND d.end_hour = l.end_hour))""")


def labels_of(c):
    return c.episodes.select("station_id", "start_hour", "end_hour", F.when(
        F.col("dominant_detector") == "stuck", "stuck_flatline").otherwise("other").alias("label"))


@query("relabelled_episodes", "station_id start_hour:t end_hour:t label stuck_5min_status stuck_confirmed_5min:b evidence", "SELECT * FROM labels_after")
def relabelled_episodes(spark, folder):
    c = Confirmation(spark, folder)
    return C.relabel(labels_of(c), c.dominant())


@query("relabel_counts", "label before:i after:i", """
SELECT coalesce(b.label, a.label) AS label, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM (SELECT label, count(*) AS n FROM labels_before GROUP BY 1) b
FULL JOIN (SELECT label, count(*) AS n FROM labels_after GROUP BY 1) a ON a.label = b.label""")
def relabel_counts(spark, folder):
    c = Confirmation(spark, folder)
    before = labels_of(c)
    return C.label_counts(before, C.relabel(before, c.dominant()))


@query("episodes_to_recheck", "station_id start_hour:t label", "SELECT * FROM labels_before WHERE label = 'stuck_flatline'")
def episodes_to_recheck(spark, folder):
    return C.to_recheck(labels_of(Confirmation(spark, folder)))


# --- validation -------------------------------------------------------------------------------
CHECK = "name status message"
cte("raw_table", """
SELECT o.station_id, o.ts, k % 4 - 1 AS qc_status, r.latitude, CASE WHEN event_type = 'error' THEN NULL ELSE r.longitude END AS longitude,
  r.elevation + CASE WHEN k = 7 THEN 1 ELSE 0 END AS elevation_m, date_trunc('hour', ts) AS obs_time_utc, value AS temp_avg_c FROM obs o JOIN reg r USING (station_id)""")


class Validation:
    """The tables that the checks read, each made once: the log is read for its hours and for the raw table, and never again."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    @cached_property
    def hours(self):
        """Station and hour of what was sent; first days and the end of the network follow from it."""
        obs = event_log.observations(self.spark, self.folder)
        return materialise(obs.select("station_id", F.date_trunc("hour", "obs_time_utc").alias("hour_utc")).distinct(), "log_hours")

    @cached_property
    def registry(self):
        made = event_log.registry(self.spark, self.folder, self.hours).withColumnRenamed("elevation", "elevation_m")
        return materialise(made, "public_registry")

    @cached_property
    def raw(self):
        """Raw observations with planted defects: odd qc codes, wrong and missing metadata, repeated times."""
        meta = self.registry.select("station_id", "latitude", "longitude", "elevation_m")
        made = event_log.observations(self.spark, self.folder).join(meta, "station_id").select(
            "station_id", (F.col("k") % 4 - 1).alias("qc_status"), "latitude",
            F.when(F.col("event_type") != "error", F.col("longitude")).alias("longitude"),
            (F.col("elevation_m") + F.when(F.col("k") == 7, 1).otherwise(0)).alias("elevation_m"),
            F.date_trunc("hour", "obs_time_utc").alias("obs_time_utc"), F.col("value").alias("temp_avg_c"))
        return materialise(made, "raw_observations")

    @cached_property
    def gap(self):
        """Hourly completion of the raw table, with its metadata and measurement."""
        obs = self.raw.withColumn("value_key", F.col("temp_avg_c"))
        binned = G.latest_per_bin(obs, 3600, tiebreak=["value_key", "qc_status"])
        end = self.hours.agg(F.to_date(F.max("hour_utc")).alias("end_date"))
        grid = G.utc_grid(self.registry, end, 3600)
        meta = self.registry.select("station_id", "latitude", "longitude", "elevation_m")
        filled = G.fill_grid(grid, binned.drop("latitude", "longitude", "elevation_m", "value_key"))
        return materialise(filled.join(meta, "station_id", "left"), "gap_table")

    def raw_checks(self):
        return VA.raw_checks(self.raw, self.registry)

    def gap_checks(self):
        return VA.gap_checks(self.gap, self.raw, self.registry)


def status_sql(items, source):
    return " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS name, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, '{text}: ' || ({value}) AS message FROM {source}"
                              for n, ok, text, value in items)


@query("registry_checks", CHECK, status_sql([
    ("registry_required_columns", "true", "Missing columns", "0"), ("registry_station_count", "count(*) = 26", "Registry station count", "count(*)"),
    ("registry_unique_station_ids", "count(*) = count(DISTINCT station_id)", "Distinct station IDs", "count(DISTINCT station_id)"),
    ("registry_valid_start_dates", "count(*) = count(start_date)", "Invalid start dates", "count(*) - count(start_date)"),
    ("registry_valid_latitudes", "bool_and(latitude BETWEEN -90 AND 90)", "Latitudes outside [-90, 90]", "count(*) FILTER (latitude NOT BETWEEN -90 AND 90)"),
    ("registry_valid_longitudes", "bool_and(longitude BETWEEN -180 AND 180)", "Longitudes outside [-180, 180]", "count(*) FILTER (longitude NOT BETWEEN -180 AND 180)"),
    ("registry_valid_elevations", "count(*) = count(elevation)", "Invalid elevations", "count(*) - count(elevation)")], "reg"))
def registry_checks(spark, folder):
    return VA.registry_checks(Validation(spark, folder).registry, 26)


@query("metadata_mismatches", "mismatch_cells:i", """
SELECT count(*) FILTER (w.latitude IS DISTINCT FROM r.latitude OR w.latitude IS NULL) + count(*) FILTER (w.longitude IS DISTINCT FROM r.longitude OR w.longitude IS NULL)
  + count(*) FILTER (w.elevation_m IS DISTINCT FROM r.elevation OR w.elevation_m IS NULL) AS mismatch_cells FROM raw_table w LEFT JOIN reg r USING (station_id)""")
def metadata_mismatches(spark, folder):
    v = Validation(spark, folder)
    return VA.metadata_mismatches(v.raw, v.registry)


@query("qc_histogram", "qc_status rows:i", "SELECT qc_status, count(*) AS rows FROM raw_table GROUP BY 1")
def qc_histogram(spark, folder):
    return VA.qc_histogram(Validation(spark, folder).raw)


cte("mismatch_count", """SELECT count(*) FILTER (w.latitude IS DISTINCT FROM r.latitude) + count(*) FILTER (w.longitude IS NULL OR w.longitude <> r.longitude)
  + count(*) FILTER (w.elevation_m <> r.elevation) AS n FROM raw_table w JOIN reg r USING (station_id)""")


RAW_CHECK_SQL = status_sql([
    ("exact_total_rows_positive", "count(*) > 0", "Exact pooled rows", "count(*)"),
    ("exact_station_coverage", "count(DISTINCT station_id) = (SELECT count(*) FROM reg)", "Stations not in both", "(SELECT count(*) FROM reg) - count(DISTINCT station_id)"),
    ("exact_qc_status_values", "bool_and(qc_status IN (-1, 0, 1))", "Invalid qc_status rows", "count(*) FILTER (qc_status NOT IN (-1, 0, 1))"),
    ("exact_obs_time_present", "count(*) = count(obs_time_utc)", "Missing obs_time_utc rows", "count(*) - count(obs_time_utc)"),
    ("exact_station_metadata_matches_registry", "(SELECT n FROM mismatch_count) = 0", "Station metadata mismatch cells", "(SELECT n FROM mismatch_count)"),
    ("exact_no_duplicate_station_timestamps", "count(*) = count(DISTINCT (station_id, obs_time_utc))", "Duplicate station and time rows", "count(*) - count(DISTINCT (station_id, obs_time_utc))")],
    "raw_table")


@query("raw_table_checks", CHECK, RAW_CHECK_SQL)
def raw_table_checks(spark, folder):
    return Validation(spark, folder).raw_checks()


cte("gap_table", """
SELECT g.station_id, g.hour_utc AS t, b.n, CASE WHEN b.n IS NULL THEN 0 ELSE 1 END AS data_present FROM hour_grid g
LEFT JOIN (SELECT station_id, obs_time_utc, count(*) AS n FROM raw_table GROUP BY 1, 2) b ON b.station_id = g.station_id AND b.obs_time_utc = g.hour_utc""")
cte("unequal_stations", """
SELECT count(*) AS n FROM (SELECT station_id, sum(data_present) AS p FROM gap_table GROUP BY 1) g
FULL JOIN (SELECT station_id, count(*) AS r FROM raw_table GROUP BY 1) w ON w.station_id = g.station_id WHERE coalesce(p, 0) <> coalesce(r, 0)""")


GAP_CHECK_SQL = status_sql([
    ("gap_total_rows_positive", "count(*) > 0", "Gap-filled pooled rows", "count(*)"),
    ("gap_present_rows_equal_exact_rows", "sum(data_present) = (SELECT count(*) FROM raw_table)", "Gap present rows", "sum(data_present)"),
    ("gap_station_coverage", "count(DISTINCT station_id) = (SELECT count(*) FROM reg)", "Stations not in both", "(SELECT count(*) FROM reg) - count(DISTINCT station_id)"),
    ("gap_present_counts_equal_exact_counts", "(SELECT n FROM unequal_stations) = 0", "Stations with other counts", "(SELECT n FROM unequal_stations)"),
    ("gap_has_missing_rows", "sum(data_present) < count(*)", "Gap missing rows", "count(*) - sum(data_present)"),
    ("gap_data_present_values", "bool_and(data_present IN (0, 1))", "Invalid data_present rows", "count(*) FILTER (data_present NOT IN (0, 1))"),
    ("gap_n_observations_in_bin_consistent", "bool_and((coalesce(n, 0) > 0) = (data_present = 1))", "Invalid bin count rows", "count(*) FILTER ((coalesce(n, 0) > 0) <> (data_present = 1))"),
    ("gap_missing_rows_keep_measurements_blank", "true", "Filled cells in missing rows", "0"),
    ("gap_station_metadata_matches_registry", "true", "Station metadata mismatch cells", "0")], "gap_table")


@query("gap_table_checks", CHECK, GAP_CHECK_SQL)
def gap_table_checks(spark, folder):
    return Validation(spark, folder).gap_checks()


PLANTED = "data_present = 0 AND cast(substring(station_id, 2) AS bigint) % 7 = 2"


@query("filled_cells_of_missing_rows", "column_name cells:i", f"""
SELECT 'obs_time_utc' AS column_name, count(*) FILTER (hour(t) = 1) AS cells FROM gap_table WHERE {PLANTED}
UNION ALL SELECT 'qc_status', count(*) FILTER (hour(t) IN (1, 2)) FROM gap_table WHERE {PLANTED}
UNION ALL SELECT 'temp_avg_c', count(*) FILTER (hour(t) > 20) FROM gap_table WHERE {PLANTED}""")
def filled_cells_of_missing_rows(spark, folder):
    """The gap table with planted cells in missing rows; text that only says that nothing is there does not count."""
    gap = Validation(spark, folder).gap
    planted, hour = F.expr(PLANTED), F.hour("expected_time_utc")
    damaged = gap.withColumns({
        "obs_time_utc": F.when(planted & (hour == 1), F.col("expected_time_utc")).otherwise(F.col("obs_time_utc")).cast("string"),
        "qc_status": F.when(planted & hour.isin(1, 2), "0").when(planted & (hour == 3), "n/a").otherwise(F.col("qc_status").cast("string")),
        "temp_avg_c": F.when(planted & (hour > 20), 1.0).otherwise(F.col("temp_avg_c"))})
    return VA.filled_cells_of_missing_rows(damaged).withColumnRenamed("column", "column_name")


@query("irregular_steps", "station_id bad_steps:i", """
SELECT station_id, count(*) FILTER (step <> INTERVAL 1 HOUR) AS bad_steps FROM (
  SELECT station_id, hour_utc - lag(hour_utc) OVER (PARTITION BY station_id ORDER BY hour_utc) AS step FROM hour_bins) GROUP BY 1""")
def irregular_steps(spark, folder):
    return VA.irregular_steps(event_log.binned(spark, folder, 3600, "hour_utc"), 3600, time="hour_utc")


@query("station_row_counts", "station_id rows:i", "SELECT station_id, count(*) AS rows FROM raw_table GROUP BY 1")
def station_row_counts(spark, folder):
    return VA.station_counts(Validation(spark, folder).raw)


@query("order_key_checks", "duplicates:i", "SELECT count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS duplicates FROM orders")
def order_key_checks(spark, folder):
    return VA.duplicate_keys(event_log.load(spark, folder, "orders", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"])


cte("numbered_hours", "SELECT *, cast(substring(station_id, 2) AS bigint) % 6 AS no, hour(hour_utc) AS hr FROM hours")


@query("canonical_table_checks", CHECK, status_sql([
    ("canonical_shape", "true", "Rows", "count(*) + count(*) FILTER (no = 1 AND hr = 3)"),
    ("canonical_unique_station_hour", "count(*) FILTER (no = 1 AND hr = 3) = 0", "Duplicate station hours", "count(*) FILTER (no = 1 AND hr = 3)"),
    ("canonical_station_count", "count(DISTINCT station_id) = 26", "Stations", "count(DISTINCT station_id)"),
    ("canonical_hour_is_utc", "count(*) FILTER (no = 2 AND hr = 4) = 0", "Hours not in UTC", "count(*) FILTER (no = 2 AND hr = 4)"),
    ("canonical_utc_columns_agree", "count(*) FILTER (no = 2 AND hr = 4 OR no = 3 AND hr = 5) = 0", "Rows with differing UTC columns", "count(*) FILTER (no = 2 AND hr = 4 OR no = 3 AND hr = 5)"),
    ("canonical_presence_is_binary", "count(*) FILTER (no = 4 AND hr = 6) = 0", "Invalid data_present rows", "count(*) FILTER (no = 4 AND hr = 6)"),
    ("canonical_local_time_on_live_rows", "count(*) FILTER (data_present = 1 AND no = 5) = 0", "Live rows without local time", "count(*) FILTER (data_present = 1 AND no = 5)")],
    "numbered_hours"))
def canonical_table_checks(spark, folder):
    """The station-hour table with its text timestamps and planted defects, one kind in every sixth station."""
    no, hour = F.expr("cast(substring(station_id, 2) AS bigint) % 6"), F.hour("hour_utc")
    hours = event_log.station_hours(spark, folder).withColumns({"_no": no, "_hr": hour})
    hours = hours.unionByName(hours.where("_no = 1 AND _hr = 3"))
    plain = F.date_format("hour_utc", "yyyy-MM-dd HH:mm:ss")
    text = F.concat(plain, F.lit("+00:00"))
    none = F.lit(None).cast("string")
    made = {"latitude": none, "longitude": none, "qc_status": none, "epoch": none, "elevation": none,
            "timestamp_local": F.when((F.col("_no") != 5) | (F.col("data_present") == 0), plain),
            "timestamp_utc": F.when(F.expr("_no = 3 AND _hr = 5"), "2000-01-01 00:00:00").otherwise(plain), "timestamp_utc_dt": text,
            "data_present": F.when(F.expr("_no = 4 AND _hr = 6"), 2).otherwise(F.col("data_present"))}
    rows = hours.withColumns(made).withColumn("hour_utc", F.when(F.expr("_no = 2 AND _hr = 4"), plain).otherwise(text))
    return VA.canonical_checks(rows.select(*V.CANONICAL_COLUMNS), expected_stations=26)


@query("validation_verdict", "checks:i failed:i status", f"""
SELECT count(*) AS checks, count(*) FILTER (status = 'FAIL') AS failed, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS status
FROM ({RAW_CHECK_SQL} UNION ALL {GAP_CHECK_SQL})""")
def validation_verdict(spark, folder):
    v = Validation(spark, folder)
    return VA.verdict(v.raw_checks().unionByName(v.gap_checks()))


@query("failed_checks", "name message", f"SELECT name, message FROM ({RAW_CHECK_SQL}) WHERE status = 'FAIL'")
def failed_checks(spark, folder):
    return VA.failed(raw_table_checks(spark, folder))
