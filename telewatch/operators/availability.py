"""Outage events, windows that many stations share, and station reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import hour_bucket, right_closed, shift_hours, window_class
from telewatch.functions.quantiles import median
from telewatch.operators.intervals import interval_join, number_runs, with_all_labels


def outage_events(states: DataFrame) -> DataFrame:
    """Runs of consecutive outage hours per station; both ends are inclusive hours.

    Any gap other than one hour opens a new event, a repeated hour too.
    """
    rows = states.where((F.col("row_state") == V.TRUE_OUTAGE) & F.col("station_id").isNotNull()
                        & F.col("hour_utc").isNotNull()).select("station_id", "hour_utc")
    runs = number_runs(rows, ["station_id"], ["hour_utc"],
                       lambda prev: F.col("hour_utc") != prev("hour_utc") + F.expr("INTERVAL 1 HOUR"))
    start, hours = F.col("start_utc"), F.col("duration_hours")
    return runs.groupBy("station_id", "run_id").agg(
        F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("end_utc"),
        F.count(F.lit(1)).alias("duration_hours"),
    ).select(
        F.format_string("%s__%s__%04dh", "station_id", F.date_format(start, "yyyyMMdd'T'HH"), hours).alias("event_id"),
        "station_id", "start_utc", "end_utc", "duration_hours", F.lit(V.UNKNOWN_CLASS).alias("outage_class"))


def duration_buckets(events: DataFrame) -> DataFrame:
    bucket = right_closed("duration_hours", V.DURATION_EDGES, V.DURATION_LABELS, lowest=False)
    counts = events.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    return with_all_labels(counts, "bucket", V.DURATION_LABELS, {"events": 0})


def longest_events(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(F.desc("duration_hours"), "start_utc", "station_id").limit(n)


def events_per_station(events: DataFrame) -> DataFrame:
    return events.groupBy("station_id").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "station_id")


def stations_starting_near(events: DataFrame, window_hours: int) -> DataFrame:
    """(start_utc, station_count): distinct stations with an event that starts within +-window_hours.

    All events with one start time share the answer, so the join runs against distinct start times, which the
    calendar bounds, and never pairs events with each other. The distinct count is a two-stage aggregate over
    (start, station), so an hour in which the whole network fails is spread over all tasks.
    """
    slot = max(window_hours, 1)
    starts = events.where(F.col("start_utc").isNotNull()).select("station_id", "start_utc").distinct()
    points = starts.select("start_utc").distinct().select(
        F.col("start_utc").alias("probe"),
        shift_hours("start_utc", -window_hours).alias("_lo"), shift_hours("start_utc", window_hours).alias("_hi"))
    near = interval_join(starts, points, [], "start_utc", "_lo", "_hi", slot)
    return near.groupBy("probe").agg(F.countDistinct("station_id").alias("station_count")).withColumnRenamed(
        "probe", "start_utc")


def window_spans(events: DataFrame, min_stations: int, window_hours: int) -> DataFrame:
    """Core and padded bounds of the coordinated windows, before membership is counted.

    The ordering runs over distinct start hours of the whole network: at most one row per calendar hour.
    """
    dense = stations_starting_near(events, window_hours).where(F.col("station_count") >= min_stations).select("start_utc")
    timeline = W.orderBy("start_utc")
    opens = F.lag("start_utc").over(timeline) < shift_hours("start_utc", -window_hours)
    numbered = dense.withColumn("_open", F.coalesce(opens, F.lit(True)).cast("long")).withColumn(
        "_window", F.sum("_open").over(timeline.rowsBetween(W.unboundedPreceding, 0)))
    spans = numbered.groupBy("_window").agg(
        F.min("start_utc").alias("window_start_utc"), F.max("start_utc").alias("window_end_utc"))
    return spans.select(
        F.concat(F.lit("NW_"), F.date_format("window_start_utc", "yyyyMMdd'T'HH")).alias("window_id"),
        window_class("window_start_utc").alias("outage_class"), "window_start_utc", "window_end_utc",
        shift_hours("window_start_utc", -window_hours).alias("backfill_start_utc"),
        shift_hours("window_end_utc", window_hours).alias("backfill_end_utc"))


WINDOW_SPAN = ["window_id", "outage_class", "window_start_utc", "window_end_utc", "backfill_start_utc", "backfill_end_utc"]


def network_windows(events: DataFrame, min_stations: int = 5, window_hours: int = 1) -> DataFrame:
    """Windows in which at least `min_stations` stations went down together, with their members' durations."""
    window_hours = max(int(window_hours), 0)
    spans = window_spans(events, min_stations, window_hours)
    members = interval_join(
        events.select("station_id", "start_utc", F.coalesce("duration_hours", F.lit(0)).alias("_hours")),
        spans, [], "start_utc", "backfill_start_utc", "backfill_end_utc", max(window_hours, 1))
    # durations are whole hours, so `percentile` holds one counter per distinct hour count
    return members.groupBy(*WINDOW_SPAN).agg(
        F.countDistinct("station_id").alias("station_count"), F.count(F.lit(1)).alias("n_events"),
        median("_hours").alias("median_duration_hours"), F.max("_hours").cast("double").alias("max_duration_hours"),
        F.sum("_hours").cast("double").alias("total_duration_hours"),
    ).where(F.col("station_count") >= min_stations)


def window_members(events: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, station_id) in long form: the distinct stations of every window."""
    spans = windows.select("window_id", "backfill_start_utc", "backfill_end_utc")
    joined = interval_join(events.select("station_id", "start_utc"), spans, [], "start_utc",
                           "backfill_start_utc", "backfill_end_utc")
    return joined.select("window_id", "station_id").where(F.col("station_id").isNotNull()).distinct()


def with_station_list(windows: DataFrame, members: DataFrame) -> DataFrame:
    """Windows with a `;`-joined sorted station list for the CSV report.

    One cell then holds a whole network, so this is for the report only; queries use `window_members`.
    """
    lists = members.groupBy("window_id").agg(F.array_join(F.array_sort(F.collect_list("station_id")), ";").alias("station_ids"))
    return windows.join(lists, "window_id", "left")


def members_of_list(windows: DataFrame) -> DataFrame:
    """The long form of a saved `station_ids` list."""
    return windows.select("window_id", F.explode(F.split("station_ids", ";")).alias("station_id")).where(
        F.trim("station_id") != "")


def classify_events(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Set `outage_class` from the window whose padded span holds the start; the latest window wins, else local.

    The class depends on the start time alone. It is found once per distinct start and then joined by equality,
    which is a small table whatever the number of events.
    """
    spans = windows if "outage_class" in windows.columns else windows.withColumn("outage_class", window_class("window_start_utc"))
    spans = spans.where(F.col("outage_class").isin(V.NETWORK_CLASSES)).select(
        "window_id", "window_start_utc", "backfill_start_utc", "backfill_end_utc", F.col("outage_class").alias("_class"))
    starts = events.where(F.col("start_utc").isNotNull()).select("start_utc").distinct()
    found = interval_join(starts, spans, [], "start_utc", "backfill_start_utc", "backfill_end_utc").groupBy("start_utc").agg(
        F.max_by("_class", F.struct("window_start_utc", "window_id")).alias("_class"))
    columns = [c for c in events.columns if c != "outage_class"]
    return events.select(*columns).join(found, "start_utc", "left").select(
        *columns, F.coalesce("_class", F.lit(V.LOCAL)).alias("outage_class"))


def class_counts(events: DataFrame) -> DataFrame:
    counts = events.groupBy("outage_class").agg(F.count(F.lit(1)).alias("events"))
    return with_all_labels(counts, "outage_class", V.OUTAGE_CLASSES, {"events": 0})


def largest_windows(windows: DataFrame, n: int = 10) -> DataFrame:
    return windows.orderBy(F.desc("station_count"), "window_start_utc").limit(n)


def network_events_per_station(events: DataFrame) -> DataFrame:
    return events_per_station(events.where(F.col("outage_class").isin(V.NETWORK_CLASSES)))


def station_reliability(registry: DataFrame, audit: DataFrame, events: DataFrame, freeze: Column) -> DataFrame:
    """One row per registered station: region, uptime, outage hours, event counts and the last outage."""
    of = {c: F.count_if(F.col("outage_class") == c).alias(f"{c}_event_count") for c in V.OUTAGE_CLASSES}
    per_station = events.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("total_event_count"), *of.values(),
        median("duration_hours").alias("median_event_duration_h"),
        F.max("duration_hours").cast("double").alias("max_event_duration_h"),
        F.max("start_utc").alias("last_outage_start_utc"), F.max_by("end_utc", "start_utc").alias("_last_end"))
    facts = audit.select(
        "station_id", "status_class",
        F.when(F.col("total_rows") > 0, F.lit(100.0) * F.col("present_rows") / F.col("total_rows")).alias("uptime_pct"),
        F.col("total_rows").alias("total_active_hours"), F.col("present_rows").alias("total_present_hours"),
        F.col("true_outage_candidate_rows").alias("total_outage_hours"))
    split = F.when(F.col("longitude") < V.REGION_SPLIT_LONGITUDE, "northwest").otherwise("southeast")
    region = F.col("region") if "region" in registry.columns else split
    base = registry.select(
        "station_id", "city", region.alias("region"), "latitude", "longitude", F.col("elevation").alias("elevation_m"), "install_date")
    days = (F.unix_micros(freeze) - F.unix_micros("_last_end")) / F.lit(86_400_000_000.0)
    return base.join(facts, "station_id", "left").join(per_station, "station_id", "left").fillna(
        0, subset=["total_event_count", *[f"{c}_event_count" for c in V.OUTAGE_CLASSES]]
    ).withColumn("days_since_last_outage_at_freeze", F.when(days.isNotNull(), F.greatest(days, F.lit(0.0)))).drop(
        "_last_end").orderBy("region", F.col("uptime_pct").desc_nulls_last(), "station_id")


def downtime_by_class(reliability: DataFrame) -> DataFrame:
    """Estimated downtime hours per class: active hours x class share of the events x median duration."""
    events = F.when(F.col("total_event_count") == 0, 1).otherwise(F.col("total_event_count"))
    typical = F.coalesce("median_event_duration_h", F.lit(0.0))
    names = {"downtime_local_h": V.LOCAL, "downtime_midnight_h": V.MIDNIGHT, "downtime_other_h": V.OTHER_NETWORK}
    return reliability.withColumns({
        name: F.col("total_active_hours") * (F.col(f"{c}_event_count") / events) * typical for name, c in names.items()})


def offline_by_hour(states: DataFrame, min_active: int = 10, inactive: Sequence[str] = tuple(V.INACTIVE_STATES)) -> DataFrame:
    """Active and offline stations of every hour and their ratio, for hours with at least `min_active` active."""
    active = ~F.coalesce(F.col("row_state").isin(list(inactive)), F.lit(False))
    hours = states.where(F.col("hour_utc").isNotNull()).groupBy("hour_utc").agg(
        F.count_if(active).alias("active_count"), F.count_if(F.col("row_state") == V.TRUE_OUTAGE).alias("offline_count"))
    fraction = F.when(F.col("active_count") > 0, F.col("offline_count") / F.col("active_count"))
    return hours.where(F.col("active_count") >= min_active).withColumn("offline_fraction", fraction)
