"""The ranked review queue built from clustered episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import beside, has_token, is_true, tokens
from telewatch.operators.intervals import with_all_labels
from telewatch.sources.tables import materialise

QUEUE_COLUMNS = [
    "review_id", "cluster_label", "cluster_size", "role", "needs_5min_confirmation", "station_id", "start_hour", "end_hour",
    "duration_hours", "affected_sensor_groups", "n_sensor_groups", "dominant_detector", "detector_concordance",
    "max_abs_zscore", "max_iforest_score", "min_rolling_variance", "reasons", "cluster_probability", "label",
]
LAST = 1.7976931348623157e308  # sorts nulls behind every value


def needs_confirmation() -> Column:
    return is_true(F.col("dominant_detector") == "stuck") | has_token("reasons", V.STUCK_REASON)


def touches_limits() -> Column:
    return F.arrays_overlap(tokens("reasons"), F.array(F.lit(V.HARD_REASON), F.lit(V.SUSPECT_REASON)))


def number_rows(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Consecutive numbers in a total order without sorting everything in one task.

    Rows are range-partitioned and stored with their partition number; a count per partition gives the offsets.
    """
    part = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    stored = materialise(part, "numbered")
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per shuffle partition
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return stored.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + inside).drop("_part", "_offset")


def cluster_picks(clusters: DataFrame, representatives: int, boundary: int) -> DataFrame:
    """Per cluster its strongest members, and the weakest of the others.

    Both picks are top-k windows, which Spark cuts down before the shuffle.
    """
    members = clusters.where(F.col("cluster_label") >= 0)
    by = W.partitionBy("cluster_label")
    start = F.col("start_hour")
    strongest = by.orderBy(F.desc("cluster_probability"), start, "station_id")
    weakest = by.orderBy("cluster_probability", F.desc("start_hour"), F.desc("station_id"))
    sizes = members.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("cluster_size"))
    top = members.withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= representatives).withColumn(
        "role", F.lit("representative"))
    # a member among the weakest is no representative when enough others stand before it
    low = members.withColumn("_r", F.row_number().over(weakest)).where(F.col("_r") <= boundary).join(
        sizes, "cluster_label").where(F.col("_r") <= F.col("cluster_size") - representatives).drop("cluster_size").withColumn(
        "role", F.lit("boundary"))
    picks = top.unionByName(low).drop("_r").join(sizes, "cluster_label")
    return picks.withColumns({
        "_section": F.lit(0), "_a": F.col("cluster_label").cast("long"),
        "_b": F.when(F.col("role") == "representative", 0).otherwise(1).cast("long"), "_c": F.lit(""),
        "_d": -F.col("cluster_probability")})


def noise_picks(clusters: DataFrame, sample: int, sustained_hours: int) -> DataFrame:
    """All long noise episodes, longest first, and the `sample` others with the highest scores."""
    noise = clusters.where(F.col("cluster_label") == -1)
    size = noise.agg(F.count(F.lit(1)).alias("cluster_size"))
    long = F.coalesce(F.col("duration_hours") >= sustained_hours, F.lit(False))
    sustained = noise.where(long).withColumns({
        "role": F.lit("noise_sustained"), "_section": F.lit(1), "_d": -F.col("duration_hours").cast("double")})
    check = noise.where(~long).orderBy(F.desc_nulls_last("max_abs_zscore"), "start_hour", "station_id").limit(sample).withColumns({
        "role": F.lit("noise_check"), "_section": F.lit(2), "_d": F.coalesce(-F.col("max_abs_zscore"), F.lit(LAST))})
    zero = F.lit(0).cast("long")
    return beside(sustained.unionByName(check), size).withColumns({"_a": zero, "_b": zero, "_c": F.lit("")})


def limit_picks(clusters: DataFrame, selected: DataFrame) -> DataFrame:
    """Episodes that broke a physical limit and are not in the queue yet, cluster by cluster."""
    sizes = clusters.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("cluster_size"))
    rest = clusters.where(touches_limits()).join(selected.select("station_id", "start_hour").distinct(), ["station_id", "start_hour"], "left_anti")
    longest = -F.col("duration_hours").cast("long")
    first = rest.groupBy("cluster_label").agg(F.min(F.struct(
        longest.alias("d"), F.unix_micros("start_hour").alias("s"), F.col("station_id").alias("i"))).alias("_first"))
    return rest.join(sizes, "cluster_label").join(first, "cluster_label").withColumns({
        "role": F.lit("physical_limit"), "_section": F.lit(3), "_a": F.col("_first.d"), "_b": F.col("_first.s"), "_c": F.col("_first.i"),
        "_d": -F.col("duration_hours").cast("double")}).drop("_first")


def review_queue(
    clusters: DataFrame, representatives: int = 5, boundary: int = 2, noise_sample: int = 20,
    sustained_hours: int = V.SUSTAINED_NOISE_HOURS,
) -> DataFrame:
    """Queue in reviewing order: clusters, long noise, checked noise, and the remaining limit breaches."""
    picked = materialise(
        cluster_picks(clusters, representatives, boundary).unionByName(noise_picks(clusters, noise_sample, sustained_hours)), "picked")
    rows = picked.unionByName(limit_picks(clusters, picked)).withColumns({
        "needs_5min_confirmation": needs_confirmation(), "label": F.lit(""), "_e": F.unix_micros("start_hour")})
    order = ["_section", "_a", "_b", "_c", "_d", "_e", "station_id"]
    return number_rows(rows, order, "review_id").select(*QUEUE_COLUMNS)


def representatives_for_station(clusters: DataFrame, queue: DataFrame, station_id: str) -> DataFrame:
    """Representatives of the clusters that a station is part of."""
    labels = clusters.where((F.col("station_id") == station_id) & (F.col("cluster_label") >= 0)).select("cluster_label").distinct()
    return queue.where(F.col("role") == "representative").join(labels, "cluster_label", "left_semi").select(
        "station_id", "duration_hours", "affected_sensor_groups", "dominant_detector", "cluster_probability")


def queue_by_role(queue: DataFrame) -> DataFrame:
    counts = queue.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.count_if("needs_5min_confirmation").alias("to_confirm"))
    return with_all_labels(counts, "role", V.REVIEW_ROLES, {"rows": 0, "to_confirm": 0})


def queue_summary(queue: DataFrame) -> DataFrame:
    wanted = F.col("needs_5min_confirmation")
    return queue.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.when(F.col("cluster_label") >= 0, F.col("cluster_label"))).alias("clusters"),
        F.count_if(wanted).alias("to_confirm"),
        F.countDistinct(F.when(wanted, F.col("cluster_label"))).alias("labels_to_confirm"))


def sustained_rows(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("role") == "noise_sustained").select(
        "review_id", "station_id", "duration_hours", "affected_sensor_groups", "needs_5min_confirmation")
