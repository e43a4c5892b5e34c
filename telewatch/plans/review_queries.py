"""Registered queries over clustering, the review queue and diagnostics."""

from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.operators import clustering as C
from telewatch.operators import diagnostics as X
from telewatch.operators import faults as E
from telewatch.operators import review as RQ
from telewatch.plans.anomaly_queries import EVENT, EPISODE, fault_episodes, fault_events, scores
from telewatch.plans.catalog import cte, query
from telewatch.sources.tables import materialise

STATION = "S000001"

cte("features_raw", "SELECT station_id, start_hour, end_hour, " + ", ".join(
    [f"cast(list_contains(string_split(affected_sensor_groups, '|'), '{g}') AS double) AS sg_{g}" for g in C.KNOWN_GROUPS]
    + ["cast(list_contains(string_split(affected_sensor_groups, '|'), 'other') AS double) AS sg_other"]
    + [f"cast(dominant_detector = '{d}' AS double) AS det_{d}" for d in C.DETECTORS]
    + ["cast(n_sensor_groups AS double) AS n_sensor_groups", "cast(detector_concordance AS double) AS detector_concordance",
       "ln(1 + duration_hours) AS log_duration", "coalesce(max_abs_zscore, 0) AS max_abs_zscore", "coalesce(max_iforest_score, 0) AS max_iforest_score",
       "coalesce(min_rolling_variance, (SELECT coalesce(max(min_rolling_variance), 0) FROM episodes)) AS min_rolling_variance"]) + " FROM episodes")
SUSTAINED = 4  # hours; the log's 30 days have no episode of the default 24
# stand-in labels, so that everything behind the clustering can be checked in SQL
cte("labelled", """
SELECT *, cast((n_events + duration_hours) % 4 AS int) - 1 AS cluster_label, 1.0 / (1 + duration_hours) AS cluster_probability FROM episodes""")


def labelled(spark, folder):
    rows = fault_episodes(spark, folder).withColumns({
        "cluster_label": ((F.col("n_events") + F.col("duration_hours")) % 4).cast("int") - 1, "cluster_probability": F.lit(1.0) / (1 + F.col("duration_hours"))})
    return materialise(rows, "labelled_episodes")


FEATURE_COLUMNS = "station_id start_hour:t end_hour:t " + " ".join(f"{c}:f" for c in C.FEATURES)


@query("episode_features", FEATURE_COLUMNS, "SELECT * FROM features_raw")
def episode_features(spark, folder):
    return C.episode_features(materialise(fault_episodes(spark, folder), "episodes"))


@query("standardised_features", FEATURE_COLUMNS, "SELECT station_id, start_hour, end_hour, " + ", ".join(
    f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}" for c in C.FEATURES) + " FROM features_raw")
def standardised_features(spark, folder):
    return C.standardise(C.episode_features(materialise(fault_episodes(spark, folder), "episodes")))


@query("fault_clusters", EPISODE + " cluster_label:i cluster_probability:f")
def fault_clusters(spark, folder):
    return C.cluster_episodes(fault_episodes(spark, folder))


# --- review queue -----------------------------------------------------------------------------
cte("picked_clusters", """
SELECT *, CASE WHEN up <= 5 THEN 'representative' ELSE 'boundary' END AS role, 0 AS sec, cluster_label AS a, CASE WHEN up <= 5 THEN 0 ELSE 1 END AS b,
  '' AS c, -cluster_probability AS d FROM (
  SELECT *, count(*) OVER (PARTITION BY cluster_label) AS cluster_size,
    row_number() OVER (PARTITION BY cluster_label ORDER BY cluster_probability DESC, start_hour, station_id) AS up,
    row_number() OVER (PARTITION BY cluster_label ORDER BY cluster_probability, start_hour DESC, station_id DESC) AS down
  FROM labelled WHERE cluster_label >= 0) WHERE up <= 5 OR down <= 2""")
cte("picked_noise", f"""
SELECT *, 0 AS a, 0 AS b, '' AS c FROM (
  SELECT *, CASE WHEN duration_hours >= {SUSTAINED} THEN 'noise_sustained' ELSE 'noise_check' END AS role, CASE WHEN duration_hours >= {SUSTAINED} THEN 1 ELSE 2 END AS sec,
    CASE WHEN duration_hours >= {SUSTAINED} THEN -duration_hours ELSE coalesce(-max_abs_zscore, 1e300) END AS d, count(*) OVER () AS cluster_size,
    row_number() OVER (PARTITION BY duration_hours >= {SUSTAINED} ORDER BY max_abs_zscore DESC NULLS LAST, start_hour, station_id) AS r
  FROM labelled WHERE cluster_label = -1) WHERE sec = 1 OR r <= 20""")
cte("picked_limits", """
SELECT l.*, n.cluster_size, 'physical_limit' AS role, 3 AS sec, f.a, f.b, f.c, -cast(duration_hours AS double) AS d FROM labelled l
JOIN (SELECT cluster_label, count(*) AS cluster_size FROM labelled GROUP BY 1) n USING (cluster_label)
JOIN (SELECT cluster_label, min((-duration_hours, epoch_us(start_hour), station_id)) AS k, k[1] AS a, k[2] AS b, k[3] AS c FROM (
  SELECT * FROM labelled WHERE reasons LIKE '%physical%') l2 WHERE (station_id, start_hour) NOT IN (
    SELECT (station_id, start_hour) FROM picked_clusters UNION ALL SELECT (station_id, start_hour) FROM picked_noise) GROUP BY 1) f USING (cluster_label)
WHERE reasons LIKE '%physical%' AND (station_id, start_hour) NOT IN (
  SELECT (station_id, start_hour) FROM picked_clusters UNION ALL SELECT (station_id, start_hour) FROM picked_noise)""")
_PICK = ("cluster_label, cluster_size, role, station_id, start_hour, end_hour, duration_hours, affected_sensor_groups, n_sensor_groups, dominant_detector, "
         "detector_concordance, max_abs_zscore, max_iforest_score, min_rolling_variance, reasons, cluster_probability, sec, a, b, c, d")
cte("queue", f"""
SELECT *, row_number() OVER (ORDER BY sec, a, b, c, d, start_hour, station_id) AS review_id, '' AS label,
  dominant_detector = 'stuck' OR reasons LIKE '%stuck_variance_zero%' AS needs_5min_confirmation
FROM (SELECT {_PICK} FROM picked_clusters UNION ALL SELECT {_PICK} FROM picked_noise UNION ALL SELECT {_PICK} FROM picked_limits)""")
QUEUE = ("review_id:i cluster_label:i cluster_size:i role needs_5min_confirmation:b station_id start_hour:t end_hour:t duration_hours:i "
         "affected_sensor_groups n_sensor_groups:i dominant_detector detector_concordance:i max_abs_zscore:f max_iforest_score:f "
         "min_rolling_variance:f reasons cluster_probability:f label")


@query("review_queue", QUEUE, "SELECT * FROM queue")
def review_queue(spark, folder):
    return RQ.review_queue(labelled(spark, folder), sustained_hours=SUSTAINED)


@query("cluster_picks", "cluster_label:i role station_id start_hour:t cluster_size:i", "SELECT * FROM picked_clusters")
def cluster_picks(spark, folder):
    return RQ.cluster_picks(labelled(spark, folder), 5, 2)


@query("noise_picks", "role station_id start_hour:t duration_hours:i cluster_size:i", "SELECT * FROM picked_noise")
def noise_picks(spark, folder):
    return RQ.noise_picks(labelled(spark, folder), 20, SUSTAINED)


@query("limit_picks", "cluster_label:i role station_id start_hour:t duration_hours:i cluster_size:i", "SELECT * FROM picked_limits")
def limit_picks(spark, folder):
    clusters = labelled(spark, folder)
    chosen = RQ.cluster_picks(clusters, 5, 2).unionByName(RQ.noise_picks(clusters, 20, SUSTAINED))
    return RQ.limit_picks(clusters, chosen)


@query("station_representatives", "station_id duration_hours:i affected_sensor_groups dominant_detector cluster_probability:f", f"""
SELECT * FROM queue WHERE role = 'representative' AND cluster_label IN (SELECT cluster_label FROM labelled WHERE station_id = '{STATION}' AND cluster_label >= 0)""")
def station_representatives(spark, folder):
    clusters = labelled(spark, folder)
    return RQ.representatives_for_station(clusters, RQ.review_queue(clusters, sustained_hours=SUSTAINED), STATION)


@query("queue_by_role", "role rows:i to_confirm:i", f"""
SELECT r.role, count(q.review_id) AS rows, count(*) FILTER (q.needs_5min_confirmation) AS to_confirm
FROM (VALUES {', '.join(f"('{r}')" for r in V.REVIEW_ROLES)}) r(role) LEFT JOIN queue q USING (role) GROUP BY 1""")
def queue_by_role(spark, folder):
    return RQ.queue_by_role(review_queue(spark, folder))


@query("queue_summary", "rows:i clusters:i to_confirm:i labels_to_confirm:i", """
SELECT count(*) AS rows, count(DISTINCT cluster_label) FILTER (cluster_label >= 0) AS clusters, count(*) FILTER (needs_5min_confirmation) AS to_confirm,
  count(DISTINCT cluster_label) FILTER (needs_5min_confirmation) AS labels_to_confirm FROM queue""")
def queue_summary(spark, folder):
    return RQ.queue_summary(review_queue(spark, folder))


@query("sustained_noise", "review_id:i station_id duration_hours:i affected_sensor_groups needs_5min_confirmation:b",
       "SELECT * FROM queue WHERE role = 'noise_sustained'")
def sustained_noise(spark, folder):
    return RQ.sustained_rows(review_queue(spark, folder))


# --- diagnostics ------------------------------------------------------------------------------
RATES = ["flag_zscore", "flag_stuck", "flag_iforest", "flag_physical", "flag_physical_suspect"]


def stored_scores(spark, folder):
    return materialise(scores(spark, folder), "scores")


@query("channel_rates", "channel n_rows:i flag_rate:f " + " ".join(f"{f}:f" for f in RATES),
       "SELECT channel, count(*) AS n_rows, avg(cast(flag AS int)) AS flag_rate, " + ", ".join(f"avg(cast({f} AS int)) AS {f}" for f in RATES) + " FROM scores GROUP BY 1")
def channel_rates(spark, folder):
    return X.channel_rates(scores(spark, folder))


@query("detector_contribution", "reason share:f", " UNION ALL ".join(
    f"SELECT '{r}' AS reason, avg(cast(contains(reason, '{r}') AS int)) AS share FROM scores WHERE flag" for r in V.REASONS))
def detector_contribution(spark, folder):
    return X.detector_contribution(scores(spark, folder))


cte("source_shares", """SELECT station_id, avg(cast(baseline_source = 'network_pooled' AS int)) AS network_pooled,
  avg(cast(baseline_source = 'station' AS int)) AS station FROM scores GROUP BY 1""")
EXPECTED = ["S000000", "S000003", "MISSING"]


@query("baseline_sources", "station_id network_pooled:f station:f", "SELECT * FROM source_shares")
def baseline_sources(spark, folder):
    return X.baseline_sources(scores(spark, folder))


@query("pooled_station_check", "station_id network_pooled:f mostly_pooled:b", f"""
SELECT e.station_id, network_pooled, network_pooled > 0.5 AS mostly_pooled FROM (VALUES {', '.join(f"('{s}')" for s in EXPECTED)}) e(station_id)
LEFT JOIN source_shares USING (station_id)""")
def pooled_station_check(spark, folder):
    return X.pooled_check(X.baseline_sources(scores(spark, folder)), EXPECTED)


@query("own_baseline_check", "stations:i mostly_own:i all_own:b", f"""
SELECT count(*) AS stations, count(*) FILTER (station > 0.5) AS mostly_own, count(*) = count(*) FILTER (station > 0.5) AS all_own
FROM source_shares WHERE station_id NOT IN ({', '.join(f"'{s}'" for s in EXPECTED)})""")
def own_baseline_check(spark, folder):
    return X.own_check(X.baseline_sources(scores(spark, folder)), EXPECTED)


PROBE = ["winddir_", "windspeed_", "windgust_"]
cte("probed", f"""SELECT * FROM scores WHERE station_id = '{STATION}' AND ({' OR '.join(f"channel LIKE '{p}%'" for p in PROBE)})""")


@query("fault_probe", "flagged_rows:i flagged_hours:i", """
SELECT count(*) FILTER (flag) AS flagged_rows, count(DISTINCT hour_utc) FILTER (flag) AS flagged_hours FROM probed""")
def fault_probe(spark, folder):
    return X.probe_totals(X.probe(scores(spark, folder), STATION, PROBE))


@query("fault_probe_reasons", "reason rows:i", "SELECT reason, count(*) AS rows FROM probed WHERE flag GROUP BY 1")
def fault_probe_reasons(spark, folder):
    return X.reason_counts(X.probe(scores(spark, folder), STATION, PROBE))


@query("fault_probe_events", EVENT, f"""SELECT * FROM fault_events WHERE station_id = '{STATION}' AND ({' OR '.join(f"channel LIKE '{p}%'" for p in PROBE)})""")
def fault_probe_events(spark, folder):
    return X.probe(fault_events(spark, folder), STATION, PROBE)


@query("fault_probe_episodes", EPISODE, f"""SELECT * FROM episodes WHERE station_id = '{STATION}'
  AND list_has_any(string_split(affected_sensor_groups, '|'), ['anemometer', 'wind_vane'])""")
def fault_probe_episodes(spark, folder):
    return X.episodes_with_groups(fault_episodes(spark, folder), STATION, ["anemometer", "wind_vane"])


@query("event_totals", "events:i median_hours:f max_hours:i long_events:i flagged_hours:i events_per_flagged_hour:f", """
SELECT count(*) AS events, median(duration_hours) AS median_hours, max(duration_hours) AS max_hours, count(*) FILTER (duration_hours >= 24) AS long_events,
  (SELECT count(*) FROM scores WHERE flag) AS flagged_hours, count(*) / (SELECT count(*) FROM scores WHERE flag) AS events_per_flagged_hour FROM fault_events""")
def event_totals(spark, folder):
    table = stored_scores(spark, folder)
    return X.event_totals(E.fault_events(table), table)


for _column, _limit in [("dominant_detector", None), ("detector_concordance", None), ("channel", 8), ("station_id", 8)]:
    query(f"events_by_{_column}", f"{_column} rows:i", f"""SELECT {_column}, count(*) AS rows FROM fault_events GROUP BY 1 ORDER BY rows DESC, {_column}
      {f'LIMIT {_limit}' if _limit else ''}""")(
        lambda spark, folder, c=_column, n=_limit: X.counts_by(fault_events(spark, folder), c, n))


@query("episode_totals", "episodes:i median_hours:f max_hours:i long_episodes:i events:i reduction:f", """
SELECT count(*) AS episodes, median(duration_hours) AS median_hours, max(duration_hours) AS max_hours, count(*) FILTER (duration_hours >= 24) AS long_episodes,
  (SELECT count(*) FROM fault_events) AS events, 1 - count(*) / (SELECT count(*) FROM fault_events) AS reduction FROM episodes""")
def episode_totals(spark, folder):
    events = materialise(fault_events(spark, folder), "fault_events")
    return X.episode_totals(E.fault_episodes(events), events)


for _column, _limit in [("n_sensor_groups", None), ("affected_sensor_groups", 10)]:
    query(f"episodes_by_{_column}", f"{_column} rows:i", f"""SELECT {_column}, count(*) AS rows FROM episodes GROUP BY 1 ORDER BY rows DESC, {_column}
      {f'LIMIT {_limit}' if _limit else ''}""")(
        lambda spark, folder, c=_column, n=_limit: X.counts_by(fault_episodes(spark, folder), c, n))

cte("signatures", "SELECT cluster_label, affected_sensor_groups, count(*) AS n FROM labelled WHERE cluster_label <> -1 GROUP BY 1, 2")


@query("cluster_purity", "mean_sensor_group_purity:f", """
SELECT avg(p) AS mean_sensor_group_purity FROM (SELECT max(n) / sum(n) AS p FROM signatures GROUP BY cluster_label)""")
def cluster_purity(spark, folder):
    return X.purity(labelled(spark, folder))


@query("cluster_summary", "cluster_label:i n_episodes:i modal_affected_sensor_groups", """
SELECT cluster_label, sum(n) AS n_episodes, arg_min(affected_sensor_groups, (-n, affected_sensor_groups)) AS modal_affected_sensor_groups
FROM signatures GROUP BY 1 ORDER BY n_episodes DESC, cluster_label LIMIT 12""")
def cluster_summary(spark, folder):
    return X.cluster_summary(labelled(spark, folder))


@query("cluster_parameter_sweep", "min_cluster_size:i min_samples:i n_clusters:i noise_pct:f biggest_cluster_pct:f mean_sensor_group_purity:f implied_review_units:i")
def cluster_parameter_sweep(spark, folder):
    return X.parameter_sweep(fault_episodes(spark, folder))
