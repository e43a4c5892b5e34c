"""Outage investigations: concurrency, prevalence, co-occurrence, geography, cadence and recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import haversine_km, hour_bucket, hours_between, right_closed, shift_hours
from telewatch.functions.quantiles import median, pooled_quantile
from telewatch.operators.intervals import chunked_previous, covered_hours, number_runs, with_all_labels
from telewatch.sources.tables import materialise

ONLINE = [V.COMPLETE, V.PARTIAL]
PAIR_BLOCKS = 32
PAIR_BLOCK = 64  # stations whose bitmap words lie side by side
BITS = 48  # hours per bitmap word


def row_count() -> Column:
    return F.count(F.lit(1))


# --- concurrency ------------------------------------------------------------------------------
def hours_at_thresholds(per_hour: DataFrame, thresholds: Sequence[float] = tuple(V.OFFLINE_THRESHOLDS)) -> DataFrame:
    """(threshold, hours, pct): hours in which at least that fraction of the network was offline, in one pass."""
    counted = per_hour.agg(row_count().alias("_all"), *[
        F.count_if(F.col("offline_fraction") >= t).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("hours"))
                     for i, t in enumerate(thresholds)])
    return counted.select("_all", F.explode(each).alias("t")).select(
        "t.threshold", "t.hours", F.when(F.col("_all") > 0, F.lit(100.0) * F.col("t.hours") / F.col("_all")).alias("pct"))


def worst_hours(per_hour: DataFrame, n: int = 20) -> DataFrame:
    return per_hour.orderBy(F.desc("offline_fraction"), "hour_utc").limit(n)


def offline_histogram(per_hour: DataFrame, at_least: float, part: str = "hour") -> DataFrame:
    """Hours at or above a fraction by hour of day (`hour`) or by calendar month (`month`)."""
    key = F.hour("hour_utc") if part == "hour" else F.date_format("hour_utc", "yyyy-MM")
    return per_hour.where(F.col("offline_fraction") >= at_least).groupBy(key.alias("slot")).agg(row_count().alias("hours")).orderBy("slot")


def at_hour(per_hour: DataFrame, hour: str) -> DataFrame:
    return per_hour.where(F.col("hour_utc") == F.lit(hour).cast("timestamp"))


def start_hour_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("start_utc").alias("start_hour")).agg(row_count().alias("events")).orderBy("start_hour")


def midnight_prevalence(events: DataFrame) -> DataFrame:
    """Events that start at 22 or 23 UTC against the mean of the other start hours that occur."""
    late = F.col("start_hour").isin(V.MIDNIGHT_HOURS)
    return start_hour_counts(events).agg(
        F.coalesce(F.sum(F.when(late, F.col("events"))), F.lit(0)).alias("midnight_events"),
        F.avg(F.when(~late, F.col("events"))).alias("mean_other_hours"),
    ).withColumn("ratio", F.when(F.col("mean_other_hours") > 0, F.col("midnight_events") / (2 * F.col("mean_other_hours"))))


def states_of_outsiders(states: DataFrame, participants: DataFrame, hour: Column) -> DataFrame:
    """State at one hour of the stations that are not among the participants."""
    return states.where(F.col("hour_utc") == hour).select("station_id", "row_state").join(
        participants.select("station_id").distinct(), "station_id", "left_anti").orderBy("station_id")


def state_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("row_state").agg(row_count().alias("stations")).orderBy(F.desc("stations"), "row_state")


# --- pairs of stations ------------------------------------------------------------------------
def station_pairs(stations: DataFrame, keys: Sequence[str] = (), blocks: int = PAIR_BLOCKS) -> DataFrame:
    """Every unordered pair of stations once (within `keys`), with the distance between them.

    Pairs are what these reports are about. They are formed block against block: a station of block i meets
    block j under the join key (i, j), so the pairs of one large group are spread over blocks^2 / 2 keys and no
    task ever holds a whole group. Consumers aggregate the stream of pairs in place.
    """
    me = F.struct("station_id", "latitude", "longitude")
    block = F.pmod(F.xxhash64("station_id"), F.lit(blocks)).cast("int")
    here = stations.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        *keys, me.alias("s"), block.alias("i"))
    left = here.select(*keys, F.col("s").alias("l"), "i", F.explode(F.sequence("i", F.lit(blocks - 1))).alias("j"))
    right = here.select(*keys, F.col("s").alias("r"), F.explode(F.sequence(F.lit(0), "i")).alias("i2"), F.col("i").alias("j"))
    right = right.withColumnRenamed("i2", "i")
    once = (F.col("i") < F.col("j")) | (F.col("l.station_id") < F.col("r.station_id"))
    pairs = left.join(right, [*keys, "i", "j"]).where(once).select(
        *keys, F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
    return pairs.select(
        *keys, F.col("a.station_id").alias("station_a"), F.col("b.station_id").alias("station_b"),
        haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude")).alias("distance_km"))


def activity_words(states: DataFrame, inactive: Sequence[str] = tuple(V.INACTIVE_STATES)) -> DataFrame:
    """Active and offline hours of a station as bitmaps: one row per station and 48 hours instead of 48."""
    active = ~F.coalesce(F.col("row_state").isin(list(inactive)), F.lit(False))
    number = hour_bucket("hour_utc")
    bit = F.expr(f"shiftleft(1L, cast(pmod(_n, {BITS}) as int))")
    rows = states.where(active & F.col("station_id").isNotNull() & F.col("hour_utc").isNotNull()).select(
        "station_id", "row_state", number.alias("_n"))
    return rows.groupBy("station_id", F.floor(F.col("_n") / BITS).alias("word")).agg(
        F.bit_or(bit).alias("active"),
        F.coalesce(F.bit_or(F.when(F.col("row_state") == V.TRUE_OUTAGE, bit)), F.lit(0).cast("long")).alias("offline"))


def block_words(words: DataFrame, stations: DataFrame, blocks: int) -> DataFrame:
    """One row per block of stations and bitmap word: the stations of the block that say something in it, with their bits."""
    bits = F.struct("station_id", "latitude", "longitude", "active", "offline")
    placed = words.join(stations.select("station_id", "latitude", "longitude").where("latitude IS NOT NULL AND longitude IS NOT NULL"), "station_id")
    return placed.groupBy(F.pmod(F.xxhash64("station_id"), F.lit(blocks)).cast("int").alias("b"), "word").agg(F.collect_list(bits).alias("s"))


def cooccurrence(states: DataFrame, registry: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """For every pair of stations: common active hours, outage hours of each and of both, and observed / expected.

    The words of `block` stations are stored side by side. Two blocks meet in the task that their pair of numbers names, once per word, and the bits of
    all pairs of their stations are counted and added there: what crosses the network is each block once per other block, and no pair does.
    """
    words = materialise(activity_words(states), "activity_words")
    blocks = max(1, -(-words.select("station_id").distinct().count() // block))
    packed = materialise(block_words(words, registry, blocks), "block_words")
    none = F.lit(None).cast(packed.schema["s"].dataType)
    left = packed.select(F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("j"), "word", F.col("s").alias("l"), none.alias("r"))
    right = packed.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"), "word", none.alias("l"), F.col("s").alias("r"))
    tasks = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionByName(right).repartition(tasks, "i", "j").groupBy("i", "j", "word").agg(
        F.first("l", ignorenulls=True).alias("l"), F.first("r", ignorenulls=True).alias("r"))  # one row of each side
    pairs = met.select("i", "j", F.explode("l").alias("l"), "r").select("i", "j", "l", F.explode("r").alias("r"))
    pairs = pairs.where((F.col("i") < F.col("j")) | (F.col("l.station_id") < F.col("r.station_id")))
    turned = F.col("l.station_id") < F.col("r.station_id")
    pairs = pairs.select("i", "j", F.when(turned, F.col("l")).otherwise(F.col("r")).alias("a"), F.when(turned, F.col("r")).otherwise(F.col("l")).alias("b"))
    both = F.col("a.active").bitwiseAND(F.col("b.active"))

    def hours(bits: Column) -> Column:
        return F.sum(F.bit_count(bits).cast("long"))

    def place(side: str) -> list[Column]:
        return [F.first(f"{side}.{c}").alias(f"_{c}_{side}") for c in ("latitude", "longitude")]

    counts = pairs.groupBy("i", "j", F.col("a.station_id").alias("station_a"), F.col("b.station_id").alias("station_b")).agg(
        hours(both).alias("n_both_active_hours"), hours(F.col("a.offline").bitwiseAND(both)).alias("n_offline_a"),
        hours(F.col("b.offline").bitwiseAND(both)).alias("n_offline_b"),
        hours(F.col("a.offline").bitwiseAND(F.col("b.offline"))).alias("n_both_offline"), *place("a"), *place("b"))
    distance = haversine_km(F.col("_latitude_a"), F.col("_longitude_a"), F.col("_latitude_b"), F.col("_longitude_b"))
    counts = counts.select("station_a", "station_b", distance.alias("distance_km"), "n_both_active_hours", "n_offline_a", "n_offline_b", "n_both_offline")
    n, pa, pb = F.col("n_both_active_hours"), F.col("p_offline_a"), F.col("p_offline_b")
    expected = F.col("expected_both_offline_if_independent")
    return counts.where(n > 0).withColumns({
        "p_offline_a": F.col("n_offline_a") / n, "p_offline_b": F.col("n_offline_b") / n,
    }).withColumn("expected_both_offline_if_independent", pa * pb * n).withColumn(
        "cooccurrence_ratio", F.when(expected > 0, F.col("n_both_offline") / expected))


def without_window_hours(states: DataFrame, windows: DataFrame) -> DataFrame:
    """States outside the hours from the padded start to the core end of any window."""
    hours = covered_hours(windows, [], "backfill_start_utc", "window_end_utc")
    return states.join(hours, "hour_utc", "left_anti")


def without_network_events(states: DataFrame, events: DataFrame) -> DataFrame:
    """States outside the station-hours that belong to a network event."""
    hours = covered_hours(events.where(F.col("outage_class").isin(V.NETWORK_CLASSES)), ["station_id"], "start_utc", "end_utc")
    return states.join(hours, ["station_id", "hour_utc"], "left_anti")


def ratio_by_distance(pairs: DataFrame) -> DataFrame:
    """Co-occurrence ratio per distance bucket, all buckets listed."""
    bucket = right_closed("distance_km", V.DISTANCE_EDGES_KM, V.DISTANCE_LABELS, lowest=True)
    rows = pairs.where(F.col("cooccurrence_ratio").isNotNull()).select(bucket.alias("distance_bucket"), "cooccurrence_ratio")
    rows = rows.where(F.col("distance_bucket").isNotNull())
    r = F.col("cooccurrence_ratio")
    stats = rows.groupBy("distance_bucket").agg(
        row_count().alias("n_pairs"), F.avg(r).alias("mean_ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"))
    middle = pooled_quantile(rows, ["distance_bucket"], "cooccurrence_ratio", 0.5, "median_ratio")
    return with_all_labels(stats.join(middle, "distance_bucket"), "distance_bucket", V.DISTANCE_LABELS, {"n_pairs": 0})


def strongest_pairs(pairs: DataFrame, n: int = 15) -> DataFrame:
    return pairs.where(F.col("cooccurrence_ratio").isNotNull()).orderBy(
        F.desc("cooccurrence_ratio"), "station_a", "station_b").limit(n)


def close_pairs(pairs: DataFrame, km: float = 25.0) -> DataFrame:
    return pairs.where(F.col("distance_km") < km).orderBy("distance_km", "station_a", "station_b")


# --- geography of windows ---------------------------------------------------------------------
def is_midnight(start: str = "window_start_utc") -> Column:
    return F.hour(start).isin(V.MIDNIGHT_HOURS)


def window_geography(windows: DataFrame, members: DataFrame, registry: DataFrame) -> DataFrame:
    """Extent of every window: pairwise distances and coordinate ranges of the stations with coordinates."""
    placed = members.join(registry.select("station_id", "latitude", "longitude"), "station_id").where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    area = placed.groupBy("window_id").agg(
        row_count().alias("n_stations_resolved"), F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"))
    pairs = station_pairs(placed, ["window_id"])
    reach = pairs.groupBy("window_id").agg(
        F.max("distance_km").alias("max_pairwise_km"), F.min("distance_km").alias("min_pairwise_km"))
    middle = pooled_quantile(pairs, ["window_id"], "distance_km", 0.5, "median_pairwise_km")
    known = F.coalesce(F.col("n_stations_resolved") >= 2, F.lit(False))
    base = windows.select("window_id", "window_start_utc", "station_count", "outage_class")
    out = base.join(area, "window_id", "left").join(reach, "window_id", "left").join(middle, "window_id", "left")
    edges = ["lat_min", "lat_max", "lon_min", "lon_max"]
    return out.withColumns({e: F.when(known, F.col(e)) for e in edges}).withColumns({
        "n_stations_resolved": F.coalesce("n_stations_resolved", F.lit(0)),
        "lat_range": F.col("lat_max") - F.col("lat_min"), "lon_range": F.col("lon_max") - F.col("lon_min"),
        "is_midnight": is_midnight(), "status": F.when(known, "ok").otherwise("fewer_than_2_stations")})


def geography_summary(geography: DataFrame) -> DataFrame:
    d = F.col("max_pairwise_km")
    return geography.where(F.col("status") == "ok").groupBy("is_midnight").agg(
        row_count().alias("windows"), median(d).alias("median_max_km"), F.avg(d).alias("mean_max_km"),
        F.min(d).alias("min_max_km"), F.max(d).alias("max_max_km"))


def distance_histogram(geography: DataFrame) -> DataFrame:
    """Windows outside midnight by their largest pairwise distance."""
    bucket = right_closed("max_pairwise_km", V.DISTANCE_EDGES_KM, V.DISTANCE_LABELS, lowest=True)
    rows = geography.where((F.col("status") == "ok") & ~F.col("is_midnight"))
    counts = rows.groupBy(bucket.alias("distance_bucket")).agg(row_count().alias("windows"))
    return with_all_labels(counts, "distance_bucket", V.DISTANCE_LABELS, {"windows": 0})


def top_window_stations(windows: DataFrame, members: DataFrame, registry: DataFrame, n: int = 5) -> DataFrame:
    """Stations with city and coordinates of the n largest windows."""
    top = windows.orderBy(F.desc("station_count"), "window_start_utc").limit(n).select(
        "window_id", "window_start_utc", "station_count")
    return top.join(members, "window_id").join(
        registry.select("station_id", "city", "latitude", "longitude"), "station_id").orderBy(
        F.desc("station_count"), "window_start_utc", "city", "station_id")


def top_window_extent(details: DataFrame) -> DataFrame:
    return details.groupBy("window_id", "station_count").agg(
        F.countDistinct("city").alias("cities"), F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"))


def top_window_cities(details: DataFrame) -> DataFrame:
    return details.groupBy("window_id", "city").agg(row_count().alias("stations"))


def window_start_hours(windows: DataFrame) -> DataFrame:
    return windows.groupBy(F.hour("window_start_utc").alias("start_hour")).agg(row_count().alias("windows")).orderBy("start_hour")


def windows_outside_midnight(windows: DataFrame) -> DataFrame:
    return windows.where(~is_midnight()).orderBy("window_start_utc")


# --- cadence of midnight windows --------------------------------------------------------------
def iso_week(ts: str) -> Column:
    week = F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), week)


def midnight_cadence(windows: DataFrame) -> DataFrame:
    """Midnight windows with calendar position and the gap to the one before (window-sized data, one ordering)."""
    start = F.col("window_start_utc")
    gap = hours_between(F.lag(start).over(W.orderBy("window_start_utc")), start)
    return windows.where(is_midnight()).select("window_id", "window_start_utc", "station_count").withColumns({
        "day_of_week": F.date_format(start, "EEEE"), "day_of_month": F.dayofmonth(start),
        "year_month": F.date_format(start, "yyyy-MM"), "iso_week": iso_week("window_start_utc"),
        "gap_hours": gap}).withColumn("gap_days", F.col("gap_hours") / 24)


def weekday_histogram(cadence: DataFrame) -> DataFrame:
    return with_all_labels(cadence.groupBy("day_of_week").agg(row_count().alias("windows")), "day_of_week", V.WEEKDAYS, {"windows": 0})


def calendar_histogram(cadence: DataFrame, part: str) -> DataFrame:
    return cadence.groupBy(F.col(part).cast("string").alias("slot")).agg(row_count().alias("windows")).orderBy("slot")


def gap_statistics(cadence: DataFrame) -> DataFrame:
    g = F.col("gap_days")
    return cadence.where(g.isNotNull()).agg(
        row_count().alias("gaps"), median(g).alias("median_days"), F.avg(g).alias("mean_days"), F.min(g).alias("min_days"), F.max(g).alias("max_days"))


def gap_histogram(cadence: DataFrame) -> DataFrame:
    bucket = right_closed("gap_days", V.GAP_DAY_EDGES, V.GAP_DAY_LABELS, lowest=True)
    counts = cadence.where(F.col("gap_days").isNotNull()).groupBy(bucket.alias("gap_bucket")).agg(row_count().alias("gaps"))
    return with_all_labels(counts, "gap_bucket", V.GAP_DAY_LABELS, {"gaps": 0})


# --- recovery ---------------------------------------------------------------------------------
def station_recoveries(windows: DataFrame, members: DataFrame, states: DataFrame) -> DataFrame:
    """Per (window, station): first outage hour from the padded start on, first online hour after it, duration.

    A forward as-of lookup. Probes and hours of one station are ordered together from late to early, so each probe
    sees the nearest later outage in a running frame; there is no range join. Hours per station are bounded by the
    calendar and probes by the windows.
    """
    late_first = W.partitionBy("station_id").orderBy(F.desc("_t"), "_probe")
    rows = states.where(F.col("hour_utc").isNotNull()).select(
        "station_id", F.col("hour_utc").alias("_t"), F.lit(False).alias("_probe"), F.lit(None).cast("string").alias("window_id"),
        (F.col("row_state") == V.TRUE_OUTAGE).alias("_out"), F.col("row_state").isin(ONLINE).alias("_on"))
    probes = members.join(windows.select("window_id", "backfill_start_utc"), "window_id").select(
        "station_id", F.col("backfill_start_utc").alias("_t"), F.lit(True).alias("_probe"), "window_id",
        F.lit(False).alias("_out"), F.lit(False).alias("_on"))
    later = late_first.rowsBetween(W.unboundedPreceding, -1)
    marked = rows.unionByName(probes).withColumn(
        "_next_on", F.last(F.when(F.col("_on"), F.col("_t")), ignorenulls=True).over(later))
    outage = F.when(F.col("_out"), F.struct(F.col("_t").alias("start"), F.col("_next_on").alias("back")))
    found = marked.withColumn("_hit", F.last(outage, ignorenulls=True).over(late_first.rowsBetween(W.unboundedPreceding, 0)))
    return found.where(F.col("_probe") & F.col("_hit").isNotNull()).select(
        "window_id", "station_id", F.col("_hit.start").alias("outage_start_utc"), F.col("_hit.back").alias("recovery_utc"),
    ).withColumn("duration_hours", hours_between("outage_start_utc", "recovery_utc"))


def window_durations(windows: DataFrame, members: DataFrame, states: DataFrame) -> DataFrame:
    """Recovery of every window over its stations; `no_outages_found` where none was in outage."""
    d, start, back = F.col("duration_hours"), F.col("outage_start_utc"), F.col("recovery_utc")
    per_window = station_recoveries(windows, members, states).groupBy("window_id").agg(
        F.count(d).alias("n_with_duration"), (row_count() - F.count(d)).alias("n_never_recovered"),
        F.min(start).alias("earliest_outage_start_utc"), F.max(start).alias("latest_outage_start_utc"),
        F.min(d).alias("min_duration_hours"), median(d).alias("median_duration_hours"),
        F.max(d).alias("max_duration_hours"), F.avg(d).alias("mean_duration_hours"),
        F.min(back).alias("earliest_recovery_utc"), F.max(back).alias("latest_recovery_utc"))
    sizes = members.groupBy("window_id").agg(row_count().alias("n_stations_in_window"))
    base = windows.select("window_id", "window_start_utc", "station_count", "outage_class")
    return base.join(sizes, "window_id", "left").join(per_window, "window_id", "left").withColumns({
        "start_spread_hours": hours_between("earliest_outage_start_utc", "latest_outage_start_utc"),
        "recovery_spread_hours": hours_between("earliest_recovery_utc", "latest_recovery_utc"),
        "status": F.when(F.col("n_with_duration").isNull(), "no_outages_found").otherwise("ok")})


def duration_summary(durations: DataFrame) -> DataFrame:
    m = F.col("median_duration_hours")
    return durations.where(F.col("status") == "ok").groupBy(is_midnight().alias("is_midnight")).agg(
        row_count().alias("windows"), median(m).alias("median_of_medians"), F.min(m).alias("min_median"), F.max(m).alias("max_median"),
        F.sum("n_never_recovered").alias("never_recovered"))


def window_recovery(windows: DataFrame, targets: DataFrame, obs: DataFrame) -> DataFrame:
    """Minute-level drop and recovery of each window: the last observation of each target station before it and the first after it, however
    far away.

    Window bounds are whole hours, so an observation only matters through the first and last one of its station-hour. That reduces the
    log before the exchange. Bounds and hours of a station are then put in one order, in which a bound looks back and ahead.
    """
    hour, ts = F.date_trunc("hour", "obs_time_utc"), F.col("obs_time_utc")
    hourly = obs.where(F.col("station_id").isNotNull() & ts.isNotNull()).groupBy("station_id", hour.alias("_hour")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.min(F.when(ts > hour, ts)).alias("_inside"))
    spans = targets.select("window_id", "station_id").distinct().join(
        windows.select("window_id", "window_start_utc", "window_end_utc"), "window_id")
    # Within an hour: a window that starts, the hour's observations, a window that ends, observations past the full hour.
    none = F.lit(None).cast("timestamp")
    marks = F.explode(F.array(F.struct(F.col("_hour").alias("t"), F.lit(1).alias("place"), F.col("_last").alias("before"), F.col("_first").alias("after")),
                              F.struct(F.col("_hour").alias("t"), F.lit(3).alias("place"), none.alias("before"), F.col("_inside").alias("after"))))
    bounds = F.explode(F.array(F.struct(F.col("window_start_utc").alias("t"), F.lit(0).alias("place")),
                               F.struct(F.col("window_end_utc").alias("t"), F.lit(2).alias("place"))))
    rows = hourly.select("station_id", marks.alias("m")).select("station_id", "m.*").unionByName(
        spans.select("window_id", "station_id", bounds.alias("m")).select("window_id", "station_id", "m.*"), allowMissingColumns=True)
    order = W.partitionBy("station_id").orderBy("t", "place")
    looked = rows.withColumns({
        "_drop": F.last("before", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)),
        "_back": F.first("after", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)),
        "_seen": F.max("before").over(W.partitionBy("station_id"))})
    per_station = looked.where(F.col("window_id").isNotNull() & F.col("_seen").isNotNull()).groupBy("window_id", "station_id").agg(
        F.max(F.when(F.col("place") == 0, F.col("_drop"))).alias("drop"), F.min(F.when(F.col("place") == 2, F.col("_back"))).alias("back"))

    def middle(c: str) -> Column:
        return median(F.unix_micros(c).cast("double"))

    per_window = per_station.groupBy("window_id").agg(
        F.count("drop").alias("n_with_last_before"), F.count("back").alias("n_with_first_after"),
        F.min("drop").alias("drop_min_utc"), F.max("drop").alias("drop_max_utc"), middle("drop").alias("_drop"),
        F.min("back").alias("recovery_min_utc"), F.max("back").alias("recovery_max_utc"), middle("back").alias("_back"))
    sizes = targets.groupBy("window_id").agg(F.countDistinct("station_id").alias("stations_targeted"))
    base = windows.select("window_id", "window_start_utc", "window_end_utc", "station_count", "outage_class")

    def spread(a: str, b: str) -> Column:
        return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1_000_000.0)

    status = (F.when(F.col("stations_targeted").isNull(), "missing_observations")
              .when(F.col("n_with_last_before").isNull(), "empty_observations").otherwise("ok"))
    return base.join(sizes, "window_id", "left").join(per_window, "window_id", "left").withColumns({
        "drop_spread_seconds": spread("drop_min_utc", "drop_max_utc"),
        "recovery_spread_seconds": spread("recovery_min_utc", "recovery_max_utc"),
        "drop_median_utc": F.timestamp_micros(F.col("_drop").cast("long")),
        "recovery_median_utc": F.timestamp_micros(F.col("_back").cast("long")),
        "outage_duration_minutes": (F.col("_back") - F.col("_drop")) / F.lit(60_000_000.0),
        "status": status,
    }).withColumn("drop_sync_class", drop_sync_class("drop_spread_seconds")).drop("_drop", "_back")


def drop_sync_class(spread: str) -> Column:
    s = F.col(spread)
    return F.when(s.isNull(), "unknown").when(s < V.TIGHT_SYNC_SECONDS, "tight").otherwise("loose")


def recovery_summary(recovery: DataFrame) -> DataFrame:
    """Drop synchronisation and outage duration by time of day and synchronisation class."""
    s, m = F.col("drop_spread_seconds"), F.col("outage_duration_minutes")
    return recovery.where(F.col("status") == "ok").groupBy(is_midnight().alias("is_midnight"), "drop_sync_class").agg(
        row_count().alias("windows"), median(s).alias("median_spread"), F.avg(s).alias("mean_spread"), F.min(s).alias("min_spread"),
        F.max(s).alias("max_spread"), median(m).alias("median_minutes"), F.avg(m).alias("mean_minutes"),
        F.min(m).alias("min_minutes"), F.max(m).alias("max_minutes"), F.count_if(m > 120).alias("over_120_minutes"),
        F.count(m).alias("with_duration"),
        F.count_if(F.col("n_with_first_after") < F.col("stations_targeted")).alias("recovery_missing"))


# --- silence and cadence of observations ------------------------------------------------------
def network_counts(states: DataFrame, start: str, end: str, inactive: Sequence[str] = tuple(V.INACTIVE_STATES)) -> DataFrame:
    """Active, online and offline stations of every hour in [start, end]; the range reaches the scan as a filter."""
    active = ~F.coalesce(F.col("row_state").isin(list(inactive)), F.lit(False))
    inside = F.col("hour_utc").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return states.where(inside).groupBy("hour_utc").agg(
        F.count_if(active).alias("active_count"), F.count_if(F.col("row_state").isin(ONLINE)).alias("online_count"),
        F.count_if(F.col("row_state") == V.TRUE_OUTAGE).alias("offline_count"))


def silence_statistics(counts: DataFrame, thresholds: Sequence[int] = (10, 15, 20)) -> DataFrame:
    """Online stations over all hours and over the midnight hours. `counts` has one row per calendar hour."""
    scope = F.explode(F.when(F.hour("hour_utc").isin(V.MIDNIGHT_HOURS), F.array(F.lit("all"), F.lit("midnight")))
                      .otherwise(F.array(F.lit("all"))))
    on = F.col("online_count")
    return counts.select(scope.alias("scope"), on.cast("double").alias("online_count")).groupBy("scope").agg(
        row_count().alias("hours"), F.avg(on).alias("mean"), F.stddev_samp(on).alias("std"), F.min(on).alias("min"),
        *[F.percentile(on, F.lit(q)).alias(name) for name, q in [("q1", 0.25), ("median", 0.5), ("q3", 0.75)]],
        F.max(on).alias("max"), *[F.count_if(on >= t).alias(f"hours_with_{t}") for t in thresholds])


def weekly_online(counts: DataFrame) -> DataFrame:
    return counts.groupBy(iso_week("hour_utc").alias("iso_week")).agg(
        F.avg("online_count").alias("mean_online"), F.min("online_count").alias("min_online"),
        F.avg("offline_count").alias("mean_offline")).orderBy("iso_week")


def observation_cadence(obs: DataFrame, chunk_hours: int = 24) -> DataFrame:
    """Gaps between successive observations per station, for stations of any size.

    The order is found inside (station, day) and stitched across days; the exact median uses the bracketing
    quantile, so no task holds all observations of one station.
    """
    rows = obs.where(F.col("station_id").isNotNull() & F.col("obs_time_utc").isNotNull()).select("station_id", "obs_time_utc")
    gaps = chunked_previous(rows, ["station_id"], "obs_time_utc", chunk_hours, "previous_utc").withColumn(
        "gap_min", (F.unix_micros("obs_time_utc") - F.unix_micros("previous_utc")) / F.lit(60_000_000.0))
    gaps = materialise(gaps.select("station_id", "obs_time_utc", "gap_min"), "gaps")  # statistics, sketch and bracket read it
    stats = gaps.groupBy("station_id").agg(
        row_count().alias("n_obs"), F.min("gap_min").alias("min_gap_min"), F.max("gap_min").alias("max_gap_min"),
        F.min("obs_time_utc").alias("first"), F.max("obs_time_utc").alias("last"))
    middle = pooled_quantile(gaps, ["station_id"], "gap_min", 0.5, "median_gap_min", few_keys=False)
    return stats.join(middle, "station_id", "left")


def longest_run(hours: DataFrame, holds: Column) -> DataFrame:
    """Per station the longest stretch of successive rows where `holds`; the first of equal ones. No row if never."""
    rows = hours.select("station_id", "hour_utc", F.coalesce(holds, F.lit(False)).alias("_holds"))
    runs = number_runs(rows, ["station_id"], ["hour_utc"], lambda prev: F.col("_holds") != prev("_holds"))
    each = runs.where("_holds").groupBy("station_id", "run_id").agg(
        F.min("hour_utc").alias("start"), F.max("hour_utc").alias("end"), row_count().alias("rows"))
    best = F.max_by(F.struct("start", "end", "rows"), F.struct("rows", -F.unix_micros("start")))
    return each.groupBy("station_id").agg(best.alias("b")).select(
        "station_id", F.col("b.start").alias("start_utc"), F.col("b.end").alias("end_utc"), F.col("b.rows").alias("run_rows"))


def context_of_runs(hours: DataFrame, runs: DataFrame, padding_hours: int = 24) -> DataFrame:
    """Rows of a station from `padding_hours` before its run to as many after it (one run per station)."""
    t = F.col("hour_utc")
    return hours.join(runs.select("station_id", "start_utc", "end_utc"), "station_id").where(
        t.between(shift_hours("start_utc", -padding_hours), shift_hours("end_utc", padding_hours)))
