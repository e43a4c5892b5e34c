"""Row states of station-hours, and the audit and registry tables that count them.

A station-hour table holds a (station, hour) once, so the rows of one station are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.functions.columns import any_null, first_match, offset_text, require_columns, status_class
from telewatch.operators.intervals import number_runs

FLAGS = [
    "flag_missing_station_id", "flag_missing_timestamp", "flag_station_never_active", "flag_data_absent",
    "flag_before_first_present", "flag_after_last_present", "flag_warmup", "flag_online_partial_missing",
    "flag_online_complete", "flag_true_outage_candidate",
]


def coerce(df: DataFrame, timestamps: Sequence[str] = ("hour_utc",), numbers: Sequence[str] = ("data_present",)) -> DataFrame:
    """Text that is no timestamp or number becomes null instead of failing the job."""
    typed = dict(df.dtypes)
    out = {c: F.col(c).try_cast("timestamp") for c in timestamps if typed[c] != "timestamp"}
    out |= {c: F.col(c).try_cast("double") for c in numbers if typed[c] == "string"}
    return df.withColumns(out) if out else df


def present_bounds(df: DataFrame) -> DataFrame:
    """First and last present hour per station, from rows with station and time."""
    here = (F.col("data_present") == 1) & F.col("station_id").isNotNull() & F.col("hour_utc").isNotNull()
    return df.where(here).groupBy("station_id").agg(
        F.min("hour_utc").alias("first_present_timestamp"), F.max("hour_utc").alias("last_present_timestamp"))


def classify(df: DataFrame, measurements: Sequence[str] = tuple(V.MEASUREMENTS), warmup_days: int = V.WARMUP_DAYS) -> DataFrame:
    """Add presence bounds, ten flags and `row_state`; a row that fits no state keeps a null one."""
    require_columns(df, ["station_id", "hour_utc", "data_present", *measurements], "df")
    df = coerce(df)
    # the bounds are one small row per station: a pruned scan, and a join the optimiser may broadcast
    rows = df.join(present_bounds(df), "station_id", "left")
    hour, first, last = F.col("hour_utc"), F.col("first_present_timestamp"), F.col("last_present_timestamp")

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    valid = F.col("station_id").isNotNull() & hour.isNotNull()
    present, absent = sure(F.col("data_present") == 1), sure(F.col("data_present") == 0)
    active, incomplete = first.isNotNull(), any_null(measurements)
    flags = dict(zip(FLAGS, [
        F.col("station_id").isNull(),
        hour.isNull(),
        F.col("station_id").isNotNull() & ~active,
        absent,
        valid & sure(hour < first),
        valid & sure(hour > last),
        valid & present & sure((hour >= first) & (hour < first + F.expr(f"INTERVAL {int(warmup_days)} DAY"))),
        present & incomplete,
        present & ~incomplete,
        valid & absent & sure((hour >= first) & (hour <= last)),
    ]))
    f = F.col
    state = first_match([
        (f(FLAGS[0]) | f(FLAGS[1]), V.INVALID),
        (f("flag_station_never_active"), V.NEVER_ACTIVE),
        (f("flag_before_first_present"), V.BEFORE_FIRST),
        (f("flag_after_last_present") & f("flag_data_absent"), V.TERMINAL_PADDED),
        (f("flag_warmup"), V.WARMUP),
        (f("flag_true_outage_candidate"), V.TRUE_OUTAGE),
        (f("flag_online_partial_missing"), V.PARTIAL),
        (f("flag_online_complete"), V.COMPLETE),
    ])
    return rows.withColumns(flags).withColumn("row_state", state)


def state_counts(states: DataFrame) -> DataFrame:
    """Station x row state, all states as columns, 0 where a state does not occur."""
    counted = [F.count_if(F.col("row_state") == s).alias(s) for s in V.ROW_STATES]
    return states.where(F.col("station_id").isNotNull()).groupBy("station_id").agg(*counted)


def enrich_registry(states: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry with present rate, padded rows and status class; earlier enrichment is replaced."""
    counts = state_counts(states)
    total = sum(F.col(s) for s in V.ROW_STATES)
    here = sum(F.col(s) for s in V.PRESENT_STATES)
    metrics = counts.select(
        "station_id", F.when(total > 0, here / total).alias("present_rate"),
        F.col(V.TERMINAL_PADDED).alias("terminal_padded_rows"))
    base = registry.drop("present_rate", "terminal_padded_rows", "status_class")
    return base.join(metrics, "station_id", "left").fillna(
        {"present_rate": 0.0, "terminal_padded_rows": 0}
    ).withColumn("status_class", status_class("present_rate", "terminal_padded_rows"))


def status_counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("status_class").agg(F.count(F.lit(1)).alias("stations")).orderBy("status_class")


def by_present_rate(enriched: DataFrame) -> DataFrame:
    return enriched.orderBy("present_rate", "station_id")


def by_install_date(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.col("install_date").try_cast("date").asc_nulls_last(), "station_id")


AUDIT_COUNTS = {
    "warmup_rows": V.WARMUP, "terminal_padded_absence_rows": V.TERMINAL_PADDED,
    "true_outage_candidate_rows": V.TRUE_OUTAGE, "online_partial_missing_rows": V.PARTIAL,
    "online_complete_rows": V.COMPLETE,
}


def audit_summary(states: DataFrame, registry: DataFrame, as_text: bool = False) -> DataFrame:
    """Per registered station: totals, presence, bounds and state counts, in one conditional aggregate.

    A station that never reported has null bounds. `as_text` renders the timestamps for a CSV report.
    """
    times = ["first_timestamp_utc", "last_timestamp_utc", "first_present_timestamp", "last_present_timestamp"]
    per_station = states.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("data_present") == 1).alias("present_rows"),
        F.min("hour_utc").alias(times[0]), F.max("hour_utc").alias(times[1]),
        F.min(times[2]).alias(times[2]), F.max(times[3]).alias(times[3]),
        *[F.count_if(F.col("row_state") == s).alias(name) for name, s in AUDIT_COUNTS.items()])
    per_station = per_station.withColumns({
        "absent_rows": F.col("total_rows") - F.col("present_rows"),
        "present_rate": F.when(F.col("total_rows") > 0, F.col("present_rows") / F.col("total_rows")).otherwise(0.0)})
    if as_text:
        per_station = per_station.withColumns({t: offset_text(t) for t in times})
    meta = ["station_id", "station_name", "city", "latitude", "longitude", "elevation", "status_class"]
    return registry.select(*meta).join(per_station, "station_id", "left").select(
        *meta, "total_rows", "present_rows", "absent_rows", "present_rate", *times, *AUDIT_COUNTS)


def missingness(states: DataFrame, measurements: Sequence[str] = tuple(V.MEASUREMENTS)) -> DataFrame:
    """Missing share per measurement, overall and among present rows. One scan for all measurements."""
    here = F.col("data_present") == 1
    gone = [F.count_if(F.col(m).isNull()).alias(f"all_{m}") for m in measurements]
    gone_here = [F.count_if(here & F.col(m).isNull()).alias(f"here_{m}") for m in measurements]
    one = states.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(here).alias("_here"), *gone, *gone_here)
    each = F.array(*[
        F.struct(F.lit(m).alias("variable"), F.col(f"all_{m}").alias("n"), F.col(f"here_{m}").alias("h"))
        for m in measurements])
    return one.select("total_rows", "_here", F.explode(each).alias("m")).select(
        "m.variable", "total_rows", F.col("m.n").alias("missing_count"),
        F.when(F.col("total_rows") > 0, F.col("m.n") / F.col("total_rows")).alias("missing_pct"),
        (F.col("m.h") / F.greatest(F.col("_here"), F.lit(1))).alias("missing_pct_when_data_present"))


def station_missingness(states: DataFrame, registry: DataFrame, measurements: Sequence[str] = tuple(V.MEASUREMENTS)) -> DataFrame:
    """Station x measurement: missing share among present rows, 0 without any; best classes last."""
    shares = [F.avg(F.col(m).isNull().cast("int")).alias(m) for m in measurements]
    per_station = states.where(F.col("data_present") == 1).groupBy("station_id").agg(*shares)
    rank = first_match([(F.col("status_class") == c, i) for i, c in enumerate(V.STATUS_CLASSES)])
    return registry.select("station_id", "status_class").join(per_station, "station_id", "left").fillna(
        0.0, subset=list(measurements)).orderBy(rank.asc_nulls_last(), "station_id")


def timeline_segments(states: DataFrame) -> DataFrame:
    """Per station, stretches of consecutive hours in the same band; the end is the first hour after."""
    band = F.coalesce(
        *[F.when(F.col("row_state").isin(s), F.lit(b)) for b, s in V.TIMELINE_BANDS.items()], F.lit("padded"))
    rows = states.where(F.col("station_id").isNotNull() & F.col("hour_utc").isNotNull()).select(
        "station_id", "hour_utc", band.alias("band"))
    runs = number_runs(
        rows, ["station_id"], ["hour_utc"],
        lambda prev: (F.col("band") != prev("band"))
        | (F.col("hour_utc") != prev("hour_utc") + F.expr("INTERVAL 1 HOUR")), "segment_id")
    return runs.groupBy("station_id", "segment_id").agg(
        F.min("band").alias("band"), F.min("hour_utc").alias("start_utc"),
        (F.max("hour_utc") + F.expr("INTERVAL 1 HOUR")).alias("end_utc"))
