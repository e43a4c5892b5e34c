"""Column expressions: every function takes and returns Spark columns, so all of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.functions import vocab as V


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> None:
    """Fail at plan time, before any job starts, when `df` lacks one of `columns`."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{name} is missing required columns: {absent}")


def seconds(ts: str | Column) -> Column:
    return F.unix_micros(col(ts)) / F.lit(1_000_000.0)


def beside(df: DataFrame, *globals_: DataFrame) -> DataFrame:
    """`df` with the columns of global aggregates, each of which has exactly one row, read as scalar subqueries."""
    for one in globals_:
        value = one.select(F.struct(*one.columns).alias("row")).scalar()
        df = df.withColumns({c: value[c] for c in one.columns})
    return df


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts))


HOUR_MICROS = 3_600_000_000


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Exact number of hours from start to end as a double."""
    return (micros(end) - micros(start)) / F.lit(float(HOUR_MICROS))


def whole_hours(start: str | Column, end: str | Column) -> Column:
    return F.floor(hours_between(start, end)).cast("long")


def shift_hours(ts: str | Column, hours: int | float | Column) -> Column:
    """`ts` moved by a number of hours that may be a column."""
    amount = F.lit(hours) if not isinstance(hours, Column) else hours
    return F.timestamp_micros(micros(ts) + (amount * F.lit(HOUR_MICROS)).cast("long"))


def floor_time(ts: str | Column, step_seconds: int) -> Column:
    """Start of the cadence bin that holds `ts`."""
    step = step_seconds * 1_000_000
    return F.timestamp_micros(micros(ts) - F.pmod(micros(ts), F.lit(step)))


def hour_bucket(ts: str | Column, hours: int = 1) -> Column:
    """Number of the `hours`-long slot since the epoch, the equi-join key for interval joins."""
    return F.floor(micros(ts) / F.lit(float(hours * HOUR_MICROS))).cast("long")


def first_match(cases: Sequence[tuple[Column, object]]) -> Column:
    """Value of the first true condition, null when none holds."""
    head, *rest = cases
    out = F.when(head[0], F.lit(head[1]))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out


def interval_labels(edges: Sequence[float]) -> list[str]:
    return [f"({lo}, {hi}]" for lo, hi in zip(edges[:-1], edges[1:])]


def right_closed(value: str | Column, edges: Sequence[float], labels: Sequence[str], lowest: bool) -> Column:
    """Label of the right-closed bucket; with more labels than gaps the last bucket is open-ended.

    `lowest` also puts the first edge itself into the first bucket. Values outside are null.
    """
    v = col(value)
    uppers = list(edges[1:]) + [None] * (len(labels) - len(edges) + 1)
    floor = v >= edges[0] if lowest else v > edges[0]
    cases = [(floor & (v <= hi) if hi is not None else v > edges[-1], lab) for hi, lab in zip(uppers, labels)]
    return first_match(cases)


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def is_true(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(False))


def tokens(c: str | Column) -> Column:
    """Non-empty tokens of a bar-joined list."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), "\\|"), lambda t: t != "")


def joined(c: str | Column, separator: str = "|") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(col(c))), separator)


def has_token(c: str | Column, token: str) -> Column:
    return F.array_contains(tokens(c), token)


def sensor_group(channel: str | Column) -> Column:
    """Sensor group by the longest matching prefix, `other` without a match."""
    prefixes = sorted(V.SENSOR_GROUPS, key=len, reverse=True)
    cases = [(col(channel).startswith(p), V.SENSOR_GROUPS[p]) for p in prefixes]
    return F.coalesce(first_match(cases), F.lit("other"))


def lookup(key: str | Column, table: dict) -> Column:
    """Value of a fixed table, null for an unknown key."""
    return first_match([(col(key) == k, v) for k, v in table.items()])


def status_class(present_rate: str | Column, padded_rows: str | Column) -> Column:
    rate, padded = col(present_rate), col(padded_rows)
    return F.coalesce(
        first_match([
            ((rate < 0.55) | (padded >= 168), "outage_dominated"),
            (rate < 0.70, "weak"),
            (rate < 0.85, "usable"),
            (padded > 0, "reliable_but_terminal_gap"),
        ]),
        F.lit("reliable_reference_candidate"),
    )


def window_class(start: str | Column) -> Column:
    """Class of a network window by the UTC hour at which it starts."""
    return F.when(F.hour(col(start)).isin(V.MIDNIGHT_HOURS), V.MIDNIGHT).otherwise(V.OTHER_NETWORK)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * V.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def iso_utc(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def offset_text(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ssxx")


def is_blank(c: str | Column) -> Column:
    """Null, or text that only says that nothing is there."""
    text = F.lower(F.trim(col(c).cast("string")))
    return text.isNull() | text.isin(V.EMPTY_TEXT)


def limit_breach(value: Column, channel: Column, limits: dict) -> Column:
    """True where `value` is outside the fixed limits of its channel; unknown channels and nulls are false."""
    def outside(rule):
        low, high, high_abs, _ = rule
        tests = [value < low] if low is not None else []
        tests += [value > high] if high is not None else []
        tests += [F.abs(value) > high_abs] if high_abs is not None else []
        return reduce(lambda a, b: a | b, tests)

    cases = [F.when(channel == name, outside(rule)) for name, rule in limits.items()]
    return F.coalesce(*cases, F.lit(False))


def limit_kind(channel: str | Column) -> Column:
    return F.coalesce(lookup(channel, {k: rule[3] for k, rule in V.HARD_LIMITS.items()}), F.lit("physical"))
