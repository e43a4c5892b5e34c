"""Registered queries over channel transforms, detectors, scores, fault events and episodes."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import limit_breach, limit_kind, sensor_group
from telewatch.operators import faults as E
from telewatch.operators import scoring as D
from telewatch.plans.catalog import cte, query
from telewatch.sources import event_log
from telewatch.sources.tables import materialise

# 720 hours cannot reach the default coverage floor; with this one both baseline sources occur
FLOOR, STUCK_ROWS = 560, 6
SCORED = [(c, name) for c in V.MEASUREMENTS if c not in V.UNSCORED_CHANNELS
          for name in (["winddir_sin", "winddir_cos"] if c in V.CIRCULAR_CHANNELS else [c])]


def value_sql(source, name):
    if name.endswith("_sin") or name.endswith("_cos"):
        return f"{name[-3:]}(radians({source}))"
    return f"ln(1 + {source})" if source in V.LOG_CHANNELS else source


def breach_sql(limits):
    def test(c, low, high, high_abs):
        parts = [f"raw < {low}"] if low is not None else []
        parts += [f"raw > {high}"] if high is not None else []
        parts += [f"abs(raw) > {high_abs}"] if high_abs is not None else []
        return f"(source_channel = '{c}' AND ({' OR '.join(parts)}))"
    return "coalesce(" + " OR ".join(test(c, *r[:3]) for c, r in limits.items()) + ", false)"


def quoted(names):
    return ", ".join(f"'{n}'" for n in names)


cte("long_channels", " UNION ALL ".join(
    f"SELECT station_id, hour_utc, '{c}' AS source_channel, '{n}' AS channel, {c} AS raw, {value_sql(c, n)} AS value FROM hours"
    for c, n in SCORED), stored=True)
cte("own_median", "SELECT station_id, channel, median(value) AS m FROM long_channels GROUP BY 1, 2")
cte("own_baseline", """
SELECT l.station_id, l.channel, any_value(o.m) AS m, median(abs(l.value - o.m)) AS s, count(l.value) AS n
FROM long_channels l JOIN own_median o ON o.station_id = l.station_id AND o.channel = l.channel GROUP BY 1, 2""", stored=True)
cte("pooled", f"""
SELECT channel, any_value(pooled_value) AS pooled_value, median(abs(value - pooled_value)) AS pooled_spread FROM (
  SELECT l.channel, l.value, median(l.value) OVER (PARTITION BY l.channel) AS pooled_value FROM long_channels l
  JOIN own_baseline o ON o.station_id = l.station_id AND o.channel = l.channel WHERE o.n >= {FLOOR} AND l.value IS NOT NULL) GROUP BY 1""")
cte("baseline", f"""
SELECT o.station_id, o.channel, CASE WHEN n >= {FLOOR} THEN 'station' ELSE 'network_pooled' END AS source,
  CASE WHEN n >= {FLOOR} THEN m ELSE pooled_value END AS baseline_value, CASE WHEN n >= {FLOOR} THEN s ELSE pooled_spread END AS baseline_spread,
  n AS n_present FROM own_baseline o LEFT JOIN pooled p USING (channel)""")
cte("stuck", f"""
SELECT station_id, hour_utc, channel, rolling_variance, bool_or(flat) OVER (PARTITION BY station_id, channel ORDER BY hour_utc
    ROWS BETWEEN CURRENT ROW AND {STUCK_ROWS - 1} FOLLOWING) AS flag_stuck FROM (
  SELECT *, coalesce(rolling_variance < 1e-6 AND (source_channel NOT IN ({quoted(V.STUCK_IGNORE_ZERO)}) OR size > 1e-9), false) AS flat FROM (
    SELECT *, CASE WHEN count(value) OVER w = {STUCK_ROWS} AND source_channel NOT IN ({quoted(V.STUCK_SKIP)}) THEN var_samp(value) OVER w END AS rolling_variance,
      avg(abs(value)) OVER w AS size FROM long_channels
    WINDOW w AS (PARTITION BY station_id, channel ORDER BY hour_utc ROWS BETWEEN {STUCK_ROWS - 1} PRECEDING AND CURRENT ROW)))""")
cte("drawn", """
SELECT *, (2 * upto * points + n) // (2 * n) - (2 * (upto - c) * points + n) // (2 * n) AS k FROM (
  SELECT *, n AS points FROM (
    SELECT station_id, channel, value AS x, count(*) AS c, cast(sum(count(*)) OVER (PARTITION BY station_id, channel ORDER BY value) AS bigint) AS upto,
      cast(sum(count(*)) OVER (PARTITION BY station_id, channel) AS bigint) AS n FROM long_channels WHERE value IS NOT NULL GROUP BY 1, 2, 3))""")
cte("gaps", """
SELECT station_id, channel, lag(x) OVER (PARTITION BY station_id, channel ORDER BY x) AS a, x AS b FROM drawn WHERE k > 0""")


def depth_sql(n):
    return f"(CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END)"


cte("isolation", f"""
SELECT d.station_id, d.channel, d.x, CASE WHEN {depth_sql('d.points')} > 0 THEN round(pow(2.0, -(coalesce(g.cuts, 0)
    + CASE WHEN d.x < lo OR d.x > hi THEN 1.0 ELSE 0.0 END + {depth_sql('d.k')}) / {depth_sql('d.points')}), 9) ELSE 0.5 END AS iforest_score
FROM drawn d JOIN (SELECT station_id, channel, min(b) AS lo, max(b) AS hi FROM gaps GROUP BY 1, 2) e ON e.station_id = d.station_id AND e.channel = d.channel
LEFT JOIN (SELECT d.station_id, d.channel, d.x, sum(CASE WHEN a >= x THEN (b - a) / (b - x) WHEN b <= x THEN (b - a) / (x - a) ELSE 2.0 END) AS cuts
  FROM drawn d JOIN gaps g ON g.station_id = d.station_id AND g.channel = d.channel WHERE g.a IS NOT NULL GROUP BY 1, 2, 3) g
  ON g.station_id = d.station_id AND g.channel = d.channel AND g.x = d.x""")
cte("lowest", "SELECT station_id, channel, min(iforest_score) AS lowest FROM isolation GROUP BY 1, 2")
cte("detector_values", f"""
SELECT l.station_id, l.hour_utc, l.channel, b.source AS baseline_source, (l.value - b.baseline_value) / nullif(b.baseline_spread, 0) AS zscore,
  s.rolling_variance, coalesce(i.iforest_score, w.lowest, 0) AS iforest_score, s.flag_stuck, {breach_sql(V.HARD_LIMITS)} AS flag_physical,
  {breach_sql(V.SUSPECT_LIMITS)} AND NOT {breach_sql(V.HARD_LIMITS)} AS suspect, l.value IS NOT NULL AS present
FROM long_channels l JOIN baseline b ON b.station_id = l.station_id AND b.channel = l.channel
JOIN stuck s ON s.station_id = l.station_id AND s.channel = l.channel AND s.hour_utc = l.hour_utc
LEFT JOIN isolation i ON i.station_id = l.station_id AND i.channel = l.channel AND i.x = l.value
LEFT JOIN lowest w ON w.station_id = l.station_id AND w.channel = l.channel""")
cte("thresholds", """
SELECT channel, quantile_cont(abs(zscore), 0.997) AS z_threshold, quantile_cont(iforest_score, 0.997) AS iforest_threshold FROM detector_values GROUP BY 1""")
cte("scores", """
SELECT *, concat_ws('|', CASE WHEN flag_zscore THEN 'mad_high' END, CASE WHEN flag_stuck THEN 'stuck_variance_zero' END,
  CASE WHEN flag_iforest THEN 'iforest_outlier' END, CASE WHEN flag_physical THEN 'physical_limit_breach' END,
  CASE WHEN flag_physical_suspect THEN 'physical_suspect_breach' END) AS reason FROM (
  SELECT *, suspect AND flag AS flag_physical_suspect FROM (SELECT *, flag_zscore OR flag_stuck OR flag_iforest OR flag_physical AS flag FROM (
    SELECT v.*, coalesce(abs(zscore) >= z_threshold, false) AS flag_zscore, coalesce(iforest_score >= iforest_threshold, false) AS flag_iforest
    FROM detector_values v LEFT JOIN thresholds USING (channel) WHERE present)))""")
cte("fault_events", """
SELECT *, CASE greatest(n_physical, n_stuck, n_iforest, n_zscore) WHEN n_physical THEN 'physical' WHEN n_stuck THEN 'stuck' WHEN n_iforest THEN 'iforest'
  ELSE 'zscore' END AS dominant_detector, cast(n_physical > 0 AS int) + cast(n_stuck > 0 AS int) + cast(n_iforest > 0 AS int) + cast(n_zscore > 0 AS int) AS detector_concordance
FROM (SELECT station_id, channel, min(hour_utc) AS start_hour, max(hour_utc) AS end_hour, count(*) AS duration_hours,
  count(*) FILTER (flag_physical OR flag_physical_suspect) AS n_physical, count(*) FILTER (flag_stuck) AS n_stuck, count(*) FILTER (flag_iforest) AS n_iforest,
  count(*) FILTER (flag_zscore) AS n_zscore, max(abs(zscore)) AS max_abs_zscore, max(iforest_score) AS max_iforest_score,
  min(rolling_variance) AS min_rolling_variance, array_to_string(list_sort(list_distinct(flatten(list(string_split(reason, '|'))))), '|') AS reasons
FROM (SELECT *, sum(opens) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) AS run FROM (
  SELECT *, CASE WHEN hour_utc - lag(hour_utc) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens
  FROM scores WHERE flag)) GROUP BY station_id, channel, run)""")
cte("numbered_events", "SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY start_hour, channel) AS seq FROM fault_events")
GROUP_SQL = "CASE " + " ".join(f"WHEN channel LIKE '{p}%' THEN '{g}'" for p, g in sorted(V.SENSOR_GROUPS.items(), key=lambda x: -len(x[0]))) + " ELSE 'other' END"
# sequential rule evaluated row by row: an episode closes where its tolerance or its running end is passed
cte("walk", """
SELECT station_id, seq, seq AS anchor, start_hour AS anchor_start, end_hour AS running_end FROM numbered_events WHERE seq = 1
UNION ALL
SELECT n.station_id, n.seq, CASE WHEN n.start_hour - w.anchor_start <= INTERVAL 6 HOUR AND n.start_hour <= w.running_end THEN w.anchor ELSE n.seq END,
  CASE WHEN n.start_hour - w.anchor_start <= INTERVAL 6 HOUR AND n.start_hour <= w.running_end THEN w.anchor_start ELSE n.start_hour END,
  CASE WHEN n.start_hour - w.anchor_start <= INTERVAL 6 HOUR AND n.start_hour <= w.running_end THEN greatest(w.running_end, n.end_hour) ELSE n.end_hour END
FROM walk w JOIN numbered_events n ON n.station_id = w.station_id AND n.seq = w.seq + 1""")
cte("episodes", f"""
SELECT *, datediff('hour', start_hour, end_hour) + 1 AS duration_hours, len(channels) AS n_channels, array_to_string(channels, '|') AS affected_channels,
  len(sensor_groups) AS n_sensor_groups, array_to_string(sensor_groups, '|') AS affected_sensor_groups,
  CASE greatest(v_physical, v_stuck, v_iforest, v_zscore) WHEN v_physical THEN 'physical' WHEN v_stuck THEN 'stuck' WHEN v_iforest THEN 'iforest' ELSE 'zscore' END AS dominant_detector,
  cast(reasons LIKE '%physical%' AS int) + cast(reasons LIKE '%stuck%' AS int) + cast(reasons LIKE '%iforest%' AS int) + cast(reasons LIKE '%mad_high%' AS int) AS detector_concordance
FROM (SELECT n.station_id, min(n.start_hour) AS start_hour, max(n.end_hour) AS end_hour, count(*) AS n_events, list_sort(list(DISTINCT channel)) AS channels,
  list_sort(list(DISTINCT {GROUP_SQL})) AS sensor_groups, {', '.join(f"count(*) FILTER (dominant_detector = '{d}') AS v_{d}" for d in V.DETECTOR_PRIORITY)},
  max(max_abs_zscore) AS max_abs_zscore, max(max_iforest_score) AS max_iforest_score, min(min_rolling_variance) AS min_rolling_variance,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, '|'))))), '|') AS reasons
FROM numbered_events n JOIN walk w ON w.station_id = n.station_id AND w.seq = n.seq GROUP BY n.station_id, w.anchor)""")


def hours(spark, folder):
    """The station-hour table as a stored one; scoring reads it several times, a few columns at a time."""
    return materialise(event_log.station_hours(spark, folder), "station_hours")


def channels(spark, folder):
    return D.long_channels(event_log.station_hours(spark, folder), V.MEASUREMENTS)


def scores(spark, folder):
    return D.score(hours(spark, folder), V.MEASUREMENTS, floor=FLOOR, window=STUCK_ROWS)


def fault_events(spark, folder):
    return E.fault_events(scores(spark, folder))


def fault_episodes(spark, folder):
    return E.fault_episodes(fault_events(spark, folder))


SERIES = "station_id hour_utc:t channel"


@query("scored_channels", SERIES + " source_channel raw:f value:f", "SELECT * FROM long_channels")
def scored_channels(spark, folder):
    return channels(spark, folder)


@query("sensor_groups", "channel sensor_group", f"SELECT DISTINCT channel, {GROUP_SQL} AS sensor_group FROM long_channels")
def sensor_groups(spark, folder):
    return channels(spark, folder).select("channel", sensor_group("channel").alias("sensor_group")).distinct()


@query("median_and_mad", "station_id channel baseline_value:f baseline_spread:f n_present:i",
       "SELECT station_id, channel, m AS baseline_value, s AS baseline_spread, n AS n_present FROM own_baseline")
def median_and_mad(spark, folder):
    return D.median_and_mad(channels(spark, folder), D.SERIES)


@query("pooled_baselines", "channel pooled_value:f pooled_spread:f", "SELECT * FROM pooled")
def pooled_baselines(spark, folder):
    return D.pooled_baseline(D.long_channels(hours(spark, folder), V.MEASUREMENTS), FLOOR)


@query("channel_baselines", "station_id channel source baseline_value:f baseline_spread:f n_present:i", "SELECT * FROM baseline")
def channel_baselines(spark, folder):
    return D.baselines(D.long_channels(hours(spark, folder), V.MEASUREMENTS), FLOOR)


@query("robust_zscores", SERIES + " score:f flag:b", """
SELECT l.station_id, l.hour_utc, l.channel, (value - m) / nullif(s, 0) AS score, coalesce(abs((value - m) / nullif(s, 0)) > 3.5, false) AS flag
FROM long_channels l JOIN own_baseline o ON o.station_id = l.station_id AND o.channel = l.channel""")
def robust_zscores(spark, folder):
    return D.score_series(channels(spark, folder), D.SERIES)


@query("stuck_values", SERIES + " rolling_variance:f flag_stuck:b", "SELECT * FROM stuck")
def stuck_values(spark, folder):
    source = F.col("source_channel")
    return D.stuck_values(channels(spark, folder), D.SERIES, "hour_utc", window=STUCK_ROWS,
                          ignore_zero=source.isin(V.STUCK_IGNORE_ZERO), skip=source.isin(V.STUCK_SKIP))


@query("isolation_scores", SERIES + " iforest_score:f", """
SELECT l.station_id, l.hour_utc, l.channel, coalesce(i.iforest_score, w.lowest, 0) AS iforest_score FROM long_channels l
LEFT JOIN isolation i ON i.station_id = l.station_id AND i.channel = l.channel AND i.x = l.value
LEFT JOIN lowest w ON w.station_id = l.station_id AND w.channel = l.channel""")
def isolation_scores(spark, folder):
    return D.isolation_scores(channels(spark, folder), D.SERIES)


@query("physical_limits", SERIES + " kind flag_physical:b flag_physical_suspect:b",
       "SELECT station_id, hour_utc, channel, CASE " + " ".join(f"WHEN source_channel = '{c}' THEN '{r[3]}'" for c, r in V.HARD_LIMITS.items())
       + f""" ELSE 'physical' END AS kind, {breach_sql(V.HARD_LIMITS)} AS flag_physical,
  {breach_sql(V.SUSPECT_LIMITS)} AND NOT {breach_sql(V.HARD_LIMITS)} AS flag_physical_suspect FROM long_channels""")
def physical_limits(spark, folder):
    raw, source = F.col("raw"), F.col("source_channel")
    hard = limit_breach(raw, source, V.HARD_LIMITS)
    return channels(spark, folder).select(
        "station_id", "hour_utc", "channel", limit_kind("source_channel").alias("kind"), hard.alias("flag_physical"),
        (limit_breach(raw, source, V.SUSPECT_LIMITS) & ~hard).alias("flag_physical_suspect"))


@query("flag_thresholds", "channel z_threshold:f iforest_threshold:f", "SELECT * FROM thresholds")
def flag_thresholds(spark, folder):
    return D.channel_thresholds(D.detector_values(hours(spark, folder), V.MEASUREMENTS, FLOOR, STUCK_ROWS))


@query("anomaly_scores", SERIES + " baseline_source zscore:f rolling_variance:f iforest_score:f flag_zscore:b flag_stuck:b flag_iforest:b "
       "flag_physical:b flag_physical_suspect:b flag:b reason", "SELECT * FROM scores")
def anomaly_scores(spark, folder):
    return scores(spark, folder)


EVENT = ("station_id channel start_hour:t end_hour:t duration_hours:i dominant_detector detector_concordance:i max_abs_zscore:f max_iforest_score:f "
         "min_rolling_variance:f reasons")


@query("fault_events", EVENT, "SELECT * FROM fault_events")
def fault_events_query(spark, folder):
    return fault_events(spark, folder)


EPISODE = ("station_id start_hour:t end_hour:t duration_hours:i n_events:i n_channels:i affected_channels n_sensor_groups:i affected_sensor_groups "
           "dominant_detector detector_concordance:i max_abs_zscore:f max_iforest_score:f min_rolling_variance:f reasons")


@query("fault_episodes", EPISODE, "SELECT * FROM episodes")
def fault_episodes_query(spark, folder):
    return fault_episodes(spark, folder)
