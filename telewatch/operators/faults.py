"""Fault events per channel, and episodes that join events of one station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import first_match, is_true, joined, sensor_group, shift_hours, tokens, whole_hours
from telewatch.operators.intervals import number_runs
from telewatch.sources.tables import materialise

DETECTOR_FLAG = {
    "physical": lambda: is_true("flag_physical") | is_true("flag_physical_suspect"),
    "stuck": lambda: is_true("flag_stuck"), "iforest": lambda: is_true("flag_iforest"), "zscore": lambda: is_true("flag_zscore"),
}


def winner(counts: dict[str, Column]) -> Column:
    """Detector with the highest count; the order of the priority list decides ties."""
    top = F.greatest(*counts.values())
    return first_match([(counts[d] == top, d) for d in V.DETECTOR_PRIORITY])


def union_of_tokens(c: str) -> Column:
    """Sorted union of the bar-joined tokens of a group; token sets are a small fixed vocabulary."""
    return joined(F.flatten(F.collect_set(tokens(c))))


def fault_events(scores: DataFrame, max_gap_hours: int = 0) -> DataFrame:
    """Runs of flagged hours per station and channel. The duration counts flagged hours, not the span."""
    rows = scores.where(is_true("flag"))
    runs = number_runs(rows, ["station_id", "channel"], ["hour_utc"],
                       lambda prev: F.col("hour_utc") > shift_hours(prev("hour_utc"), max_gap_hours + 1))
    hits = {d: F.count_if(flag()).alias(f"_{d}") for d, flag in DETECTOR_FLAG.items()}
    found = {d: F.col(f"_{d}") for d in DETECTOR_FLAG}
    return runs.groupBy("station_id", "channel", "run_id").agg(
        F.min("hour_utc").alias("start_hour"), F.max("hour_utc").alias("end_hour"), F.count(F.lit(1)).alias("duration_hours"),
        *hits.values(), F.max(F.abs("zscore")).alias("max_abs_zscore"), F.max("iforest_score").alias("max_iforest_score"),
        F.min("rolling_variance").alias("min_rolling_variance"), union_of_tokens("reason").alias("reasons"),
    ).select(
        "station_id", "channel", "start_hour", "end_hour", "duration_hours", winner(found).alias("dominant_detector"),
        sum((c > 0).cast("int") for c in found.values()).alias("detector_concordance"),
        "max_abs_zscore", "max_iforest_score", "min_rolling_variance", "reasons")


def _next_opener(tolerance: int) -> Column:
    """The sequence number of the event that opens the next episode of the station, were this event an opener.

    That is the first later event that starts after all ends from this one on, or else the first beyond the tolerance. The events
    that start within it are at most the channels times the hours of the tolerance.
    """
    start, end = F.unix_micros("start_hour"), F.unix_micros("end_hour")
    near = W.partitionBy("station_id").orderBy(start).rangeBetween(0, tolerance)
    later = F.filter(F.array_sort(F.collect_list(F.struct("_seq", start.alias("s"), end.alias("e"))).over(near)), lambda x: x["_seq"] > F.col("_seq"))
    begin = F.struct(end.alias("reach"), F.lit(None).cast("int").alias("found"))

    def further(so_far: Column, x: Column) -> Column:
        return F.struct(F.greatest(so_far["reach"], x["e"]).alias("reach"),
                        F.coalesce(so_far["found"], F.when(x["s"] > so_far["reach"], x["_seq"])).alias("found"))

    last = F.greatest(F.col("_seq"), F.coalesce(F.array_max(F.transform(later, lambda x: x["_seq"])), F.col("_seq")))
    return F.coalesce(F.aggregate(later, begin, further)["found"], last + 1)


def _reached(steps: DataFrame) -> DataFrame:
    """(station_id, _seq) of the rows that pointers lead to from the marked ones, by pointer doubling.

    `steps` has station_id, _seq, _jump (null where there is no next row) and _marked. In each round every marked row marks the row that
    it points to, and every pointer is replaced by the pointer of that row: a chain of n rows takes log2(n) rounds.
    """
    while steps.where("_marked AND _jump IS NOT NULL").limit(1).count():
        hit = steps.where("_marked AND _jump IS NOT NULL").select("station_id", F.col("_jump").alias("_seq"), F.lit(True).alias("_hit")).distinct()
        onward = steps.select("station_id", F.col("_seq").alias("_jump"), F.col("_jump").alias("_onward"))
        steps = materialise(
            steps.join(hit, ["station_id", "_seq"], "left").join(onward, ["station_id", "_jump"], "left").select(
                "station_id", "_seq", F.col("_onward").alias("_jump"), (F.col("_marked") | F.coalesce("_hit", F.lit(False))).alias("_marked")), "episode_pointers")
    return steps.where("_marked").select("station_id", "_seq")


def assign_episodes(events: DataFrame, tolerance_hours: int = V.ONSET_TOLERANCE_HOURS) -> DataFrame:
    """Add `anchor`, the sequence number of the episode's first event within its station.

    Events in start order join the open episode while they start within the tolerance of its first event and not
    after its running end. Where an event starts after every earlier end, or later than its predecessor by more than the
    tolerance, an episode opens in any case; these sure openers cut a station into islands. Which further event opens an episode depends on the
    opener before it alone, so every event points to the opener that would follow it, and the pointers are followed from the sure ones.
    Islands without a second opener, nearly all, need no round of that.
    """
    tolerance = tolerance_hours * 3_600_000_000
    station = W.partitionBy("station_id").orderBy("start_hour", "channel")
    reach = F.max("end_hour").over(station.rowsBetween(W.unboundedPreceding, -1))
    late = F.unix_micros("start_hour") - F.unix_micros(F.lag("start_hour").over(station)) > tolerance
    rows = events.withColumns({"_seq": F.row_number().over(station), "_sure": F.coalesce((F.col("start_hour") > reach) | late, F.lit(True))})
    rows = rows.withColumn("_after", F.min(F.when(F.col("_sure"), F.col("_seq"))).over(station.rowsBetween(1, W.unboundedFollowing)))
    rows = rows.withColumn("_next", _next_opener(tolerance))
    upto = F.max("_seq").over(W.partitionBy("station_id"))
    inside = F.col("_next") < F.coalesce("_after", upto + 1)  # the next island's first event opens anyway
    placed = materialise(rows.withColumn("_jump", F.when(inside, F.col("_next"))).drop("_next", "_after"), "placed_events")
    root = F.last(F.when(F.col("_sure"), F.col("_seq")), ignorenulls=True).over(W.partitionBy("station_id").orderBy("_seq").rowsBetween(W.unboundedPreceding, 0))
    chained = placed.select("station_id", "_seq", "_jump", F.col("_sure").alias("_marked"), root.alias("_root"))
    open_ = F.max(F.col("_marked") & F.col("_jump").isNotNull()).over(W.partitionBy("station_id", "_root"))
    steps = materialise(chained.withColumn("_open", open_).where("_open").drop("_open", "_root"), "episode_pointers")
    openers = placed.where("_sure").select("station_id", "_seq").unionByName(_reached(steps)).distinct().withColumn("_anchor", F.col("_seq"))
    running = W.partitionBy("station_id").orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    return placed.join(openers, ["station_id", "_seq"], "left").withColumn("anchor", F.max("_anchor").over(running)).drop("_sure", "_seq", "_jump", "_anchor")


EPISODE_COLUMNS = [
    "station_id", "start_hour", "end_hour", "duration_hours", "n_events", "n_channels", "affected_channels",
    "n_sensor_groups", "affected_sensor_groups", "dominant_detector", "detector_concordance",
    "max_abs_zscore", "max_iforest_score", "min_rolling_variance", "reasons",
]


def fault_episodes(events: DataFrame, tolerance_hours: int = V.ONSET_TOLERANCE_HOURS) -> DataFrame:
    """Episodes with their channels, sensor groups, majority detector and extremes."""
    placed = assign_episodes(events, tolerance_hours).withColumn("_group", sensor_group("channel"))
    votes = {d: F.count_if(F.col("dominant_detector") == d).alias(f"_{d}") for d in V.DETECTOR_PRIORITY}
    rows = placed.groupBy("station_id", "anchor").agg(
        F.min("start_hour").alias("start_hour"), F.max("end_hour").alias("end_hour"), F.count(F.lit(1)).alias("n_events"),
        F.collect_set("channel").alias("_channels"), F.collect_set("_group").alias("_groups"), *votes.values(),
        *[f(c).alias(c) for f, c in [(F.max, "max_abs_zscore"), (F.max, "max_iforest_score"), (F.min, "min_rolling_variance")]],
        union_of_tokens("reasons").alias("reasons"))
    present = {d: [t for t, owner in V.REASON_DETECTOR.items() if owner == d] for d in V.DETECTOR_PRIORITY}
    seen = sum(F.arrays_overlap(tokens("reasons"), F.array(*map(F.lit, ts))).cast("int") for ts in present.values())
    return rows.withColumns({
        "duration_hours": whole_hours("start_hour", "end_hour") + 1,
        "n_channels": F.size("_channels").cast("long"), "affected_channels": joined("_channels"),
        "n_sensor_groups": F.size("_groups").cast("long"), "affected_sensor_groups": joined("_groups"),
        "dominant_detector": winner({d: F.col(f"_{d}") for d in V.DETECTOR_PRIORITY}),
        "detector_concordance": seen}).select(*EPISODE_COLUMNS)
