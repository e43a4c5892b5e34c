"""Summaries of scores, events, episodes and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import beside, tokens
from telewatch.functions.quantiles import median
from telewatch.operators.clustering import label_sweep, numbered_points
from telewatch.sources.tables import materialise

FLAGS = ["flag_zscore", "flag_stuck", "flag_iforest", "flag_physical", "flag_physical_suspect"]
SWEEP = [(size, samples) for size in (10, 15, 20, 30, 50) for samples in (1, 5, 10) if samples <= size]
LONG_HOURS = 24


def rows_of() -> Column:
    return F.count(F.lit(1))


def share(condition: Column | str) -> Column:
    c = F.col(condition) if isinstance(condition, str) else condition
    return F.avg(c.cast("int"))


def channel_rates(scores: DataFrame) -> DataFrame:
    return scores.groupBy("channel").agg(
        rows_of().alias("n_rows"), share("flag").alias("flag_rate"), *[share(f).alias(f) for f in FLAGS]
    ).orderBy(F.desc("flag_rate"), "channel")


def detector_contribution(scores: DataFrame) -> DataFrame:
    """(reason, share): how often each reason occurs among flagged rows."""
    one = scores.where("flag").agg(*[share(F.contains("reason", F.lit(r))).alias(r) for r in V.REASONS])
    return one.unpivot([], V.REASONS, "reason", "share")


def baseline_sources(scores: DataFrame) -> DataFrame:
    """Per station the share of rows scored against the network and against the station itself."""
    return scores.groupBy("station_id").agg(*[
        share(F.col("baseline_source") == s).alias(s) for s in ("network_pooled", "station")]).orderBy("station_id")


def pooled_check(sources: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected stations with whether they are mostly pooled; an unknown one has nulls."""
    wanted = sources.sparkSession.createDataFrame([(s,) for s in expected], "station_id string")
    return wanted.join(sources, "station_id", "left").select(
        "station_id", "network_pooled", (F.col("network_pooled") > 0.5).alias("mostly_pooled"))


def own_check(sources: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Whether all other stations are mostly scored against themselves."""
    others = sources.where(~F.col("station_id").isin(list(expected)))
    return others.agg(rows_of().alias("stations"), F.count_if(F.col("station") > 0.5).alias("mostly_own")).withColumn(
        "all_own", F.col("stations") == F.col("mostly_own"))


def probe(scores: DataFrame, station_id: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows of one station in the channels with one of the prefixes."""
    match = F.lit(False)
    for p in prefixes:
        match = match | F.col("channel").startswith(p)
    return scores.where((F.col("station_id") == station_id) & match)


def probe_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("flag").alias("flagged_rows"), F.countDistinct(F.when(F.col("flag"), F.col("hour_utc"))).alias("flagged_hours"))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.where("flag").groupBy("reason").agg(rows_of().alias("rows")).orderBy("reason")


def episodes_with_groups(episodes: DataFrame, station_id: str, groups: Sequence[str]) -> DataFrame:
    """Episodes of a station that touch one of the sensor groups."""
    return episodes.where((F.col("station_id") == station_id) & F.arrays_overlap(
        tokens("affected_sensor_groups"), F.array(*map(F.lit, groups))))


def event_totals(events: DataFrame, scores: DataFrame) -> DataFrame:
    d = F.col("duration_hours")
    flagged = scores.agg(F.count_if("flag").alias("flagged_hours"))
    found = events.agg(rows_of().alias("events"), median(d).alias("median_hours"), F.max(d).alias("max_hours"),
                       F.count_if(d >= LONG_HOURS).alias("long_events"))
    return beside(found, flagged).withColumn(
        "events_per_flagged_hour", F.when(F.col("flagged_hours") > 0, F.col("events") / F.col("flagged_hours")).otherwise(0.0))


def counts_by(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first."""
    out = rows.groupBy(column).agg(rows_of().alias("rows")).orderBy(F.desc("rows"), column)
    return out.limit(limit) if limit else out


def episode_totals(episodes: DataFrame, events: DataFrame) -> DataFrame:
    d = F.col("duration_hours")
    before = events.agg(rows_of().alias("events"))
    found = episodes.agg(rows_of().alias("episodes"), median(d).alias("median_hours"), F.max(d).alias("max_hours"),
                         F.count_if(d >= LONG_HOURS).alias("long_episodes"))
    return beside(found, before).withColumn(
        "reduction", F.when(F.col("events") > 0, 1.0 - F.col("episodes") / F.col("events")).otherwise(0.0))


def signature_counts(clusters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return clusters.where(F.col("cluster_label") != -1).groupBy(*keys, "cluster_label", "affected_sensor_groups").agg(rows_of().alias("_n"))


def purity(clusters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the clusters of the share of their most frequent group signature."""
    each = signature_counts(clusters, keys).groupBy(*keys, "cluster_label").agg((F.max("_n") / F.sum("_n")).alias("_p"))
    return each.groupBy(*keys).agg(F.avg("_p").alias("mean_sensor_group_purity"))


def cluster_summary(clusters: DataFrame, limit: int = 12) -> DataFrame:
    """Largest clusters with their most frequent group signature; equal counts go to the first in the alphabet."""
    counted = signature_counts(clusters)
    best = counted.groupBy("cluster_label").agg(
        F.sum("_n").alias("n_episodes"), F.min(F.struct(-F.col("_n"), "affected_sensor_groups")).alias("_best"))
    return best.select("cluster_label", "n_episodes", F.col("_best.affected_sensor_groups").alias("modal_affected_sensor_groups")).orderBy(
        F.desc("n_episodes"), "cluster_label").limit(limit)


def parameter_sweep(episodes: DataFrame, settings: Sequence[tuple[int, int]] = tuple(SWEEP), max_episodes: int | None = None) -> DataFrame:
    """One row per clustering setting: clusters, noise, largest cluster, purity and the review effort they imply."""
    points, count = numbered_points(episodes, max_episodes)
    keys = ["min_cluster_size", "min_samples"]
    labelled = materialise(label_sweep(points, count, settings).join(points.select("id", "affected_sensor_groups"), "id"), "labelled")
    per_label = labelled.groupBy(*keys, "cluster_label").agg(rows_of().alias("_n"))
    real = F.col("cluster_label") != -1
    totals = per_label.groupBy(*keys).agg(
        F.count_if(real).alias("n_clusters"), F.sum("_n").alias("_all"),
        F.coalesce(F.sum(F.when(~real, F.col("_n"))), F.lit(0)).alias("_noise"), F.coalesce(F.max(F.when(real, F.col("_n"))), F.lit(0)).alias("_top"))
    return totals.join(purity(labelled, keys), keys, "left").select(
        *keys, "n_clusters", (F.col("_noise") / F.col("_all")).alias("noise_pct"), (F.col("_top") / F.col("_all")).alias("biggest_cluster_pct"),
        "mean_sensor_group_purity", (F.col("n_clusters") * 7 + F.ceil(F.col("_noise") * 0.02)).alias("implied_review_units")).orderBy(*keys)
