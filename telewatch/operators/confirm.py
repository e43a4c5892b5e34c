"""Checking stuck episodes against five-minute readings.

All episodes are checked in one plan: each is cut into the hours it spans and meets the readings on (station,
hour); the column that an episode needs is picked on the joined row, so readings are never unpivoted. Everything
behind the join is grouped by episode, which its own duration bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import first_match, has_token, hour_bucket, is_true, lookup, shift_hours, tokens, whole_hours
from telewatch.functions.quantiles import median
from telewatch.operators.intervals import number_runs, with_all_labels

CHECK = ["station_id", "channel", "start_hour", "end_hour"]
RESULT = [
    "station_id", "channel", "start_hour", "end_hour", "duration_hours", "five_min_column", "n_5min_expected", "n_5min_present",
    "present_fraction", "n_distinct_values", "modal_value", "min_reading", "max_reading", "modal_fraction",
    "longest_constant_run_hours", "confirmed_stuck_5min", "status",
]
STATUSES = ["confirmed_stuck", "not_constant", "insufficient_5min_data", "unmapped_channel"]
PER_HOUR = 12
SWEEP = [0.99, 0.98, 0.97, 0.95, 0.90]


def rows_of() -> Column:
    return F.count(F.lit(1))


def round_half_even(value: Column, places: int) -> Column:
    """Scaled, rounded to the even neighbour on a tie, and scaled back: the usual rounding of numeric arrays."""
    return F.rint(value * float(10 ** places)) / float(10 ** places)


def checks(episodes: DataFrame, available: Sequence[str]) -> DataFrame:
    """Episodes with the reading column they need, their duration and the last five-minute slot they cover."""
    has_channel = "channel" in episodes.columns
    channel = F.coalesce(F.col("channel"), F.col("affected_channels")) if has_channel and "affected_channels" in episodes.columns \
        else F.col("channel" if has_channel else "affected_channels")
    given = F.col("duration_hours") if "duration_hours" in episodes.columns else F.lit(None).cast("double")
    rows = episodes.withColumns({"channel": channel, "five_min_column": lookup(channel, V.FIVE_MIN_COLUMN)})
    usable = F.coalesce(F.col("five_min_column").isin(list(available)), F.lit(False))
    span = whole_hours("start_hour", "end_hour") + 1
    hours = F.when(usable, F.coalesce(F.rint(given.cast("double")).cast("long"), span)).otherwise(F.coalesce(given.cast("long"), F.lit(0)))
    return rows.withColumns({"_usable": usable, "duration_hours": hours}).withColumn(
        "_until", F.expr("timestampadd(MINUTE, -5, start_hour)")).withColumn(
        "_until", shift_hours("_until", F.col("duration_hours")))


def window_readings(found: DataFrame, readings: DataFrame, columns: Sequence[str], precision: int) -> DataFrame:
    """One row per episode and reading inside its window, both ends included, with the rounded value."""
    slots = F.explode(F.sequence(hour_bucket("start_hour"), hour_bucket("_until")))
    wanted = found.where("_usable").where(F.col("start_hour") <= F.col("_until")).select(
        *CHECK, "five_min_column", "_until").distinct().withColumn("_slot", slots)
    data = readings.select("station_id", "expected_time_utc", *columns).withColumn("_slot", hour_bucket("expected_time_utc"))
    joined = wanted.join(data, ["station_id", "_slot"])
    value = F.coalesce(*[F.when(F.col("five_min_column") == c, F.col(c)) for c in columns], F.lit(None).cast("double"))
    inside = F.col("expected_time_utc").between(F.col("start_hour"), F.col("_until"))
    return joined.where(inside).select(*CHECK, "expected_time_utc", round_half_even(value, precision).alias("value"))


def constancy(window: DataFrame) -> DataFrame:
    """Per episode: readings present, distinct and most frequent values (the smallest of equals), extremes, longest run."""
    rows = window.repartition(*CHECK)
    counted = rows.where(F.col("value").isNotNull()).groupBy(*CHECK, "value").agg(rows_of().alias("_n"))
    values = counted.groupBy(*CHECK).agg(
        F.sum("_n").alias("n_5min_present"), rows_of().alias("n_distinct_values"), F.max("_n").alias("_top"),
        F.max_by("value", F.struct("_n", -F.col("value"))).alias("modal_value"),
        F.min("value").alias("min_reading"), F.max("value").alias("max_reading"))
    runs = number_runs(rows, CHECK, ["expected_time_utc"], lambda prev: ~F.col("value").eqNullSafe(prev("value")))
    longest = runs.where(F.col("value").isNotNull()).groupBy(*CHECK, "run_id").agg(rows_of().alias("_n")).groupBy(*CHECK).agg(
        (F.max("_n") * 5 / 60).alias("longest_constant_run_hours"))
    return values.join(longest, CHECK)


def confirm(
    episodes: DataFrame, readings: DataFrame, min_readings: int = V.MIN_FIVE_MIN_READINGS,
    threshold: float = V.CONSTANCY_THRESHOLD, precision: int = V.VALUE_PRECISION, extra: Sequence[str] = (),
) -> DataFrame:
    """Status of every episode at five-minute resolution; `extra` columns of the episodes are carried along."""
    available = [c for c in dict.fromkeys(V.FIVE_MIN_COLUMN.values()) if c in readings.columns]
    found = checks(episodes, available)
    stats = constancy(window_readings(found, readings, available, precision))
    zero = F.lit(0).cast("long")
    present, share = F.col("n_5min_present"), F.col("modal_fraction")
    few = present < min_readings
    return found.join(stats, CHECK, "left").withColumns({
        "n_5min_expected": F.col("duration_hours") * PER_HOUR, "n_5min_present": F.coalesce("n_5min_present", zero),
        "n_distinct_values": F.coalesce("n_distinct_values", zero),
        "longest_constant_run_hours": F.coalesce("longest_constant_run_hours", F.lit(0.0)),
    }).withColumns({
        "present_fraction": F.when(F.col("n_5min_expected") > 0, present / F.col("n_5min_expected")).otherwise(0.0),
        "modal_fraction": F.when(present > 0, F.col("_top") / present).otherwise(0.0),
    }).withColumns({
        "confirmed_stuck_5min": F.col("_usable") & ~few & (share >= threshold),
        "status": F.when(~F.col("_usable"), "unmapped_channel").when(few, "insufficient_5min_data")
                   .when(share >= threshold, "confirmed_stuck").otherwise("not_constant"),
    }).select(*RESULT, *extra)


def category(flat: float = V.CONSTANCY_THRESHOLD, low: float = V.LOW_VARIANCE_FLOOR, spread: float = V.RANGING_SPREAD,
             distinct: int = V.RANGING_DISTINCT) -> Column:
    """What the five-minute values look like, from the columns of a confirmation result."""
    share = F.coalesce("modal_fraction", F.lit(0.0))
    wide = F.coalesce(F.col("max_reading") - F.col("min_reading"), F.lit(0.0)) > spread
    many = F.coalesce("n_distinct_values", F.lit(0)) > distinct
    return F.when(share >= flat, "confirmed_flatline").when(share >= low, "borderline_lowvar").when(
        wide | many, "ranging_not_stuck").otherwise("ambiguous_lowmodal")


def stuck_priority(channel: str | Column) -> Column:
    return F.coalesce(lookup(channel, V.STUCK_PRIORITY), F.lit(V.NO_PRIORITY))


def dominant_channels(episodes: DataFrame, events: DataFrame, slot_hours: int = 24) -> DataFrame:
    """Set `channel` to the stuck channel that stands for an episode, and say how it was found.

    First the episode's own channel, then the best overlapping stuck event (lowest variance, longest, highest
    priority, name), then the affected channel with the highest priority. Overlaps meet on (station, slot); a pair
    that shares several slots is found several times, which the minimum does not mind.
    """
    key = ["station_id", "start_hour", "end_hour"]

    def slots(start: str, end: str) -> Column:
        return F.explode(F.sequence(hour_bucket(start, slot_hours), hour_bucket(end, slot_hours)))

    stuck = events.where(has_token("reasons", V.STUCK_REASON)).select(
        "station_id", F.col("start_hour").alias("_s"), F.col("end_hour").alias("_e"),
        F.struct(F.col("min_rolling_variance").isNull().alias("unknown"), F.col("min_rolling_variance").alias("variance"),
                 (-F.col("duration_hours")).alias("length"), stuck_priority("channel").alias("priority"), "channel").alias("_rank"),
        slots("start_hour", "end_hour").alias("_slot"))
    spans = episodes.select(*key).distinct().withColumn("_slot", slots("start_hour", "end_hour"))
    best = spans.join(stuck, ["station_id", "_slot"]).where(
        (F.col("_s") <= F.col("end_hour")) & (F.col("_e") >= F.col("start_hour"))).groupBy(*key).agg(
        F.min("_rank")["channel"].alias("_event_channel"))
    own = F.lit(None).cast("string")
    if "channel" in episodes.columns:
        own = F.when(is_true(F.col("dominant_detector") == "stuck") | has_token("reasons", V.STUCK_REASON), F.col("channel"))
    affected = tokens("affected_channels") if "affected_channels" in episodes.columns else F.array().cast("array<string>")
    first = F.array_min(F.transform(affected, lambda c, i: F.struct(
        stuck_priority(c).alias("p"), i.alias("i"), c.alias("c"))))["c"]
    given = F.col("channel") if "channel" in episodes.columns else F.lit(None).cast("string")
    rest = [c for c in episodes.columns if c not in ("channel", "channel_resolution")]
    found = F.col("_event_channel")
    return episodes.withColumn("_own", own).withColumn("_first", F.coalesce(first, given, F.lit(""))).join(best, key, "left").select(
        *rest, F.coalesce("_own", found, "_first").alias("channel"),
        F.when(F.col("_own").isNotNull(), "row_channel").when(found.isNotNull(), "stuck_event").otherwise(
            "fallback_affected_channels").alias("channel_resolution"))


def each_channel(episodes: DataFrame) -> DataFrame:
    """One row per affected channel of every episode."""
    return episodes.drop("channel").withColumn("channel", F.explode(tokens("affected_channels"))).withColumn(
        "channel_resolution", F.lit("all_channels"))


def confirm_dominant(episodes: DataFrame, events: DataFrame, readings: DataFrame, **options) -> DataFrame:
    return confirm(dominant_channels(episodes, events), readings, extra=["channel_resolution"], **options)


# --- summaries --------------------------------------------------------------------------------
def not_constant(result: DataFrame) -> DataFrame:
    return result.where(F.col("status") == "not_constant")


def status_counts(result: DataFrame) -> DataFrame:
    return with_all_labels(result.groupBy("status").agg(rows_of().alias("checks")), "status", STATUSES, {"checks": 0})


def headline(results: dict[str, DataFrame]) -> DataFrame:
    """Checks, confirmed share and status counts of each way of choosing channels."""
    parts = [r.select(F.lit(mode).alias("mode"), "status") for mode, r in results.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    confirmed = F.count_if(F.col("status") == "confirmed_stuck")
    return rows.groupBy("mode").agg(
        rows_of().alias("checks"), (confirmed / rows_of()).alias("confirmed_fraction"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def not_constant_medians(result: DataFrame) -> DataFrame:
    names = ["modal_fraction", "n_distinct_values", "longest_constant_run_hours"]
    return not_constant(result).agg(*[median(c).alias(f"median_{c}") for c in names])


def not_constant_by_channel(result: DataFrame) -> DataFrame:
    return not_constant(result).groupBy("channel").agg(rows_of().alias("checks")).orderBy(F.desc("checks"), "channel")


def shape_histogram(result: DataFrame) -> DataFrame:
    """(measure, bucket, checks) of the modal share and of the number of distinct values, where not constant."""
    m, d = F.col("modal_fraction"), F.col("n_distinct_values")
    bins = [("modal_fraction", "0.95-0.99", (m >= 0.95) & (m < 0.99)), ("modal_fraction", "0.90-0.95", (m >= 0.90) & (m < 0.95)),
            ("modal_fraction", "0.80-0.90", (m >= 0.80) & (m < 0.90)), ("modal_fraction", "<0.80", m < 0.80),
            ("n_distinct_values", "2-3", d.between(2, 3)), ("n_distinct_values", "4-10", d.between(4, 10)),
            ("n_distinct_values", ">10", d > 10)]
    counts = not_constant(result).agg(*[F.count_if(c).alias(f"_{i}") for i, (_, _, c) in enumerate(bins)])
    each = F.array(*[F.struct(F.lit(k).alias("measure"), F.lit(b).alias("bucket"), F.col(f"_{i}").alias("checks"))
                     for i, (k, b, _) in enumerate(bins)])
    return counts.select(F.explode(each).alias("b")).select("b.*")


def threshold_sweep(result: DataFrame, thresholds: Sequence[float] = tuple(SWEEP), min_readings: int = V.MIN_FIVE_MIN_READINGS) -> DataFrame:
    """How the counts move with the threshold. An unmapped check has no readings and so also counts as insufficient."""
    enough = F.col("n_5min_present") >= min_readings
    confirmed = enough & (F.col("modal_fraction") >= F.col("threshold"))
    unmapped = F.col("status") == "unmapped_channel"
    rows = result.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return rows.groupBy("threshold").agg(
        F.count_if(confirmed).alias("confirmed"), F.count_if(~(confirmed | ~enough | unmapped)).alias("not_constant"),
        F.count_if(~enough).alias("insufficient_5min_data"), F.count_if(unmapped).alias("unmapped_channel"),
        (F.count_if(confirmed) / rows_of()).alias("fraction_confirmed")).orderBy(F.desc("threshold"))


TIES = ["station_id", "channel", "start_hour", "end_hour"]


def nearly_constant(result: DataFrame, n: int = 5) -> DataFrame:
    return not_constant(result).orderBy(F.desc("modal_fraction"), "n_distinct_values", *TIES).limit(n)


def low_modal(result: DataFrame) -> DataFrame:
    return result.where(F.col("modal_fraction") < V.LOW_VARIANCE_FLOOR).withColumn("spread", F.col("max_reading") - F.col("min_reading"))


def widest_profiles(result: DataFrame, n: int = 15) -> DataFrame:
    return low_modal(result).orderBy(
        F.desc_nulls_last("spread"), F.desc("n_distinct_values"), F.desc("duration_hours"), *TIES).limit(n)


def spread_summary(result: DataFrame) -> DataFrame:
    s = F.col("spread")
    return low_modal(result).agg(
        rows_of().alias("total"), F.count_if(s > V.RANGING_SPREAD).alias("spread_gt_5"), F.count_if(s <= V.RANGING_SPREAD).alias("spread_le_5"),
        F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"),
        *[F.percentile(s, F.lit(q)).alias(name) for name, q in [("q1", 0.25), ("median", 0.5), ("q3", 0.75)]], F.max(s).alias("max"))


def known_fault_check(result: DataFrame, station_id: str, prefixes: Sequence[str]) -> DataFrame:
    """Whether all checks of a station in some channels were confirmed; null if there were none."""
    match = F.lit(False)
    for p in prefixes:
        match = match | F.col("channel").startswith(p)
    return result.where((F.col("station_id") == station_id) & match).agg(
        rows_of().alias("checks"), F.bool_and("confirmed_stuck_5min").alias("all_confirmed"))


def relabel(labels: DataFrame, dominant: DataFrame) -> DataFrame:
    """Labels with their five-minute category; a flatline that turns out to range is no longer called stuck."""
    key = ["station_id", "start_hour", "end_hour"]
    new = dominant.select(*key, category().alias("_status"), round_half_even(F.col("max_reading") - F.col("min_reading"), 2).alias("_spread"))
    rest = labels.drop("stuck_5min_status", "stuck_confirmed_5min")
    before = F.col("evidence") if "evidence" in labels.columns else F.lit("")
    moved = (F.col("label") == "stuck_flatline") & (F.col("stuck_5min_status") == "ranging_not_stuck")
    text = F.concat(
        F.lit("hourly stuck flag not supported at 5-minute resolution; sensor ranging (min-max spread "),
        F.coalesce(F.col("_spread").cast("string"), F.lit("nan")), F.lit("), reclassified as benign low-variance"))
    return rest.join(new, key, "left").withColumns({
        "stuck_5min_status": F.coalesce("_status", F.lit("")),
        "stuck_confirmed_5min": F.coalesce(F.col("_status") == "confirmed_flatline", F.lit(False)),
    }).withColumns({"evidence": F.when(moved, text).otherwise(before)}).withColumn(
        "label", F.when(moved, "outlier_benign").otherwise(F.col("label"))).drop("_status", "_spread")


def label_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Label distribution before and after."""
    rows = before.select("label", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select("label", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return rows.groupBy("label").agg(F.sum("b").alias("before"), F.sum("a").alias("after")).orderBy("label")


def to_recheck(labels: DataFrame) -> DataFrame:
    """Rows labelled as stuck, and rows that an earlier run has checked."""
    chosen = F.col("label") == "stuck_flatline"
    if "stuck_5min_status" in labels.columns:
        chosen = chosen | (F.coalesce("stuck_5min_status", F.lit("")) != "")
    return labels.where(F.coalesce(chosen, F.lit(False)))
