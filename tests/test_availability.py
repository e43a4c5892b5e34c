import datetime as dt
import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from telewatch.functions import vocab as V
from telewatch.operators import availability as A
from telewatch.operators import grid as G
from telewatch.operators import investigate as Q
from telewatch.operators import states as R

MEASURES = ["temp_avg_c", "uv_high"]
HOURS = "station_id string, hour_utc timestamp, data_present int, temp_avg_c double, uv_high double"


def hours(spark, present):
    """present: station -> string of p (present), q (present with a null), a (absent), n (null presence), per hour"""
    flag = {"p": 1, "q": 1, "a": 0, "n": None}
    return spark.createDataFrame([
        (s, at(i), flag[c], 1.0 if c == "p" else None, 2.0 if c in "pq" else None)
        for s, text in present.items() for i, c in enumerate(text)], HOURS)


def states_of(df, station):
    return [r.row_state for r in df.where(F.col("station_id") == station).orderBy("hour_utc").collect()]


def test_row_states(spark):
    df = R.classify(hours(spark, {"A": "aapaq" + "p" + "aa", "NEVER": "aaa"}), MEASURES, warmup_days=0)
    assert states_of(df, "A") == [V.BEFORE_FIRST] * 2 + [V.COMPLETE, V.TRUE_OUTAGE, V.PARTIAL, V.COMPLETE] + [V.TERMINAL_PADDED] * 2
    assert states_of(df, "NEVER") == [V.NEVER_ACTIVE] * 3
    warm = R.classify(hours(spark, {"A": "p" * 30}), MEASURES, warmup_days=1)
    assert states_of(warm, "A") == [V.WARMUP] * 24 + [V.COMPLETE] * 6
    odd = spark.createDataFrame([(None, at(0), 1, 1.0, 1.0), ("A", None, 1, 1.0, 1.0), ("A", at(0), 1, 1.0, 1.0), ("A", at(2), None, None, None),
                                 ("A", at(4), 1, 1.0, 1.0)], HOURS)
    got = {(r.station_id, r.hour_utc): r.row_state for r in R.classify(odd, MEASURES, warmup_days=0).collect()}
    assert got[(None, at(0))] == V.INVALID and got[("A", None)] == V.INVALID and got[("A", at(2))] is None


def test_missing_columns_fail_before_any_job(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        R.classify(spark.createDataFrame([("A",)], "station_id string"), MEASURES)


def test_text_input_is_coerced(spark):
    text = spark.createDataFrame([("A", "2025-06-01 00:00:00", "1", 1.0, 1.0), ("A", "junk", "x", 1.0, 1.0)],
                                 "station_id string, hour_utc string, data_present string, temp_avg_c double, uv_high double")
    assert sorted(r.row_state for r in R.classify(text, MEASURES).collect()) == sorted([V.WARMUP, V.INVALID])


def test_registry_audit_missingness_and_timeline(spark):
    states = R.classify(hours(spark, {"A": "ppqapa", "NEVER": "aa"}), MEASURES, warmup_days=0)
    registry = spark.createDataFrame([("A", "a", "c", 1.0, 2.0, 3.0, "old"), ("NEVER", "n", "c", 1.0, 2.0, 3.0, "old"), ("NONE", "z", "c", 1.0, 2.0, 3.0, "old")],
                                     "station_id string, station_name string, city string, latitude double, longitude double, elevation double, status_class string")
    enriched = R.enrich_registry(states, registry)
    got = {r.station_id: (round(r.present_rate, 4), r.terminal_padded_rows, r.status_class) for r in enriched.collect()}
    assert got == {"A": (0.6667, 1, "weak"), "NEVER": (0.0, 0, "outage_dominated"), "NONE": (0.0, 0, "outage_dominated")}
    audit = {r.station_id: r for r in R.audit_summary(states, enriched, as_text=True).collect()}
    assert (audit["A"].total_rows, audit["A"].present_rows, audit["A"].true_outage_candidate_rows) == (6, 4, 1)
    assert audit["A"].first_present_timestamp == "2025-06-01 00:00:00+0000" and audit["NEVER"].first_present_timestamp is None
    miss = {r.variable: (r.missing_count, r.missing_pct_when_data_present) for r in R.missingness(states, MEASURES).collect()}
    assert miss == {"temp_avg_c": (5, 0.25), "uv_high": (4, 0.0)}
    matrix = R.station_missingness(states, enriched, MEASURES).collect()
    assert [(r.station_id, r.temp_avg_c) for r in matrix] == [("NEVER", 0.0), ("NONE", 0.0), ("A", 0.25)]
    bands = R.timeline_segments(states).where("station_id = 'A'").orderBy("start_utc").collect()
    assert [(r.band, r.start_utc, r.end_utc) for r in bands] == [
        ("online", at(0), at(3)), ("outage", at(3), at(4)), ("online", at(4), at(5)), ("padded", at(5), at(6))]


def test_events_keep_every_outage_hour_and_split_on_repeated_hours(spark):
    rng = random.Random(5)
    present = {f"S{i}": "p" + "".join(rng.choice("ppaa") for _ in range(150)) + "p" for i in range(6)}
    states = R.classify(hours(spark, present), MEASURES)
    events = A.outage_events(states).collect()
    assert sum(e.duration_hours for e in events) == states.where(F.col("row_state") == V.TRUE_OUTAGE).count()
    for e in events:
        assert (e.end_utc - e.start_utc).total_seconds() / 3600 + 1 == e.duration_hours
        assert e.event_id == f"{e.station_id}__{e.start_utc:%Y%m%dT%H}__{e.duration_hours:04d}h"
    assert len(events) == sum(len([run for run in text[1:-1].replace("p", " ").split()]) for text in present.values())
    twice = spark.createDataFrame([("A", at(0)), ("A", at(0)), ("A", at(1))], "station_id string, hour_utc timestamp").withColumn(
        "row_state", F.lit(V.TRUE_OUTAGE))
    assert sorted(r.duration_hours for r in A.outage_events(twice).collect()) == [1, 2]


EVENTS = "event_id string, station_id string, start_utc timestamp, end_utc timestamp, duration_hours long, outage_class string"


def events_at(spark, starts):
    return spark.createDataFrame([(f"e{i}", s, at(h), at(h + 1), 2, "unknown") for i, (s, h) in enumerate(starts)], EVENTS)


def slow_windows(starts, least, w):
    near = {h: len({s for s, g in starts if abs(g - h) <= w}) for _, h in starts}
    dense = sorted({h for h in near if near[h] >= least})
    spans = []
    for h in dense:
        if spans and h - spans[-1][1] <= w:
            spans[-1][1] = h
        else:
            spans.append([h, h])
    return [(at(a), at(b), len({s for s, g in starts if a - w <= g <= b + w})) for a, b in spans]


@pytest.mark.parametrize("w", [0, 1, 3])
def test_network_windows_against_a_slow_model(spark, w):
    rng = random.Random(w)
    starts = list({(f"S{rng.randrange(9)}", rng.randrange(80)) for _ in range(90)})
    events = events_at(spark, starts)
    windows = A.network_windows(events, 3, w)
    got = [(r.window_start_utc, r.window_end_utc, r.station_count) for r in windows.orderBy("window_start_utc").collect()]
    assert got == slow_windows(starts, 3, w)
    classified = A.classify_events(events, windows).collect()
    spans = windows.collect()
    for e in classified:
        inside = [x for x in spans if x.backfill_start_utc <= e.start_utc <= x.backfill_end_utc]
        assert e.outage_class == (max(inside, key=lambda x: x.window_start_utc).outage_class if inside else "local")
    listed = A.with_station_list(windows, A.window_members(events, windows))
    assert all(len(r.station_ids.split(";")) == r.station_count for r in listed.collect())
    assert A.members_of_list(listed).count() == A.window_members(events, windows).count()


def test_event_reports(spark):
    events = events_at(spark, [("A", 0), ("A", 9), ("B", 4)])
    assert [(r.bucket, r.events) for r in A.duration_buckets(events).collect()] == [("short", 3), ("medium", 0), ("long", 0), ("very_long", 0)]
    assert [(r.station_id, r.events) for r in A.events_per_station(events).collect()] == [("A", 2), ("B", 1)]
    assert [r.start_utc for r in A.longest_events(events, 2).collect()] == [at(0), at(4)]
    local = events.withColumn("outage_class", F.lit("local"))
    assert [(r.outage_class, r.events) for r in A.class_counts(local).collect()] == [("local", 3), ("network_midnight", 0), ("network_other", 0)]


def test_latest_observation_and_grids(spark):
    obs = spark.createDataFrame(
        [("A", at(0.01), 1, 1.0), ("A", at(0.02), 2, 2.0), ("A", at(0.02), 3, 3.0), ("A", at(2), 4, 4.0), (None, at(0), 5, 5.0)],
        "station_id string, obs_time_utc timestamp, seq int, v double")
    binned = G.latest_per_bin(obs, 3600, tiebreak=["seq"])
    assert sorted((r.expected_time_utc, r.n_observations_in_bin, r.v) for r in binned.collect()) == [(at(0), 3, 3.0), (at(2), 1, 4.0)]
    reg = spark.createDataFrame([("A", dt.date(2025, 6, 1), 1.0, 2.0, 3.0), ("LATE", dt.date(2026, 1, 1), 1.0, 2.0, 3.0)],
                                "station_id string, start_date date, latitude double, longitude double, elevation_m double")
    full = G.complete_utc(obs, reg, 3600, tiebreak=["seq"])
    assert full.count() == 24 and full.where("data_present = 1").count() == 2
    assert full.where("data_present = 0 and (v is not null or n_observations_in_bin <> 0)").count() == 0
    assert G.gap_summary(full).first().asDict() == {"total_rows": 24, "present_rows": 2, "explicit_missing_rows": 22}
    assert G.end_date(obs, "2025-07-01").first().end_date == dt.date(2025, 7, 1)
    asked = obs.withColumn("requested_date", F.lit("2025-06-05"))
    assert G.end_date(asked).first().end_date == dt.date(2025, 6, 5)
    with pytest.raises(Exception, match="Could not infer"):
        G.end_date(obs.where("false")).collect()


def test_local_days_start_at_local_midnight_and_widen(spark):
    obs = spark.createDataFrame([("A", dt.datetime(2025, 10, 6, 20, 1), None, None, None)],
                                "station_id string, obs_time_utc timestamp, timezone string, latitude double, longitude double")
    reg = spark.createDataFrame([("A", dt.date(2025, 10, 7), 1.0, 2.0, 3.0)],
                                "station_id string, start_date date, latitude double, longitude double, elevation_m double")
    full = G.complete_local(obs, reg, 300, explicit_end="2025-10-07")
    span = full.agg(F.min("expected_time_utc").alias("a"), F.max("expected_time_utc").alias("b")).first()
    assert span.a == dt.datetime(2025, 10, 6, 20, 0) and span.b == dt.datetime(2025, 10, 7, 21, 55)
    first = full.orderBy("expected_time_utc").first()
    assert (first.data_present, first.latitude, first.timezone, first.elevation_m) == (1, 1.0, "Africa/Tripoli", 3.0)
    assert full.where("data_present = 0").first().longitude == 2.0
    assert G.render_times(full).orderBy("expected_time_utc").first().expected_time_utc == "2025-10-06T20:00:00Z"


def test_pairs_and_cooccurrence_against_a_slow_model(spark):
    rng = random.Random(2)
    text = {f"S{i}": "p" + "".join(rng.choice("pa") for _ in range(120)) + "p" + "a" * (i * 3) for i in range(5)}
    states = R.classify(hours(spark, text), MEASURES, warmup_days=0)
    reg = spark.createDataFrame([(s, 10.0 + i, 20.0) for i, s in enumerate(text)], "station_id string, latitude double, longitude double")
    pairs = Q.cooccurrence(states, reg, block=2)
    shown = pairs._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning") == 1 and "Join" not in shown  # blocks are dealt out once, and pairs never
    rows = pairs.collect()
    assert len(rows) == 10 and len({(r.station_a, r.station_b) for r in rows}) == 10
    st = {s: states_of(states, s) for s in text}
    for r in rows:
        a, b = st[r.station_a], st[r.station_b]
        both = [(x, y) for x, y in zip(a, b) if V.TERMINAL_PADDED not in (x, y)]
        out = V.TRUE_OUTAGE
        assert (r.n_both_active_hours, r.n_offline_a, r.n_offline_b, r.n_both_offline) == (
            len(both), sum(x == out for x, _ in both), sum(y == out for _, y in both), sum(x == y == out for x, y in both))


def test_observation_gaps_across_chunks(spark):
    times = sorted({random.Random(1).randrange(0, 72 * 60) for _ in range(1)} | {i * 17 for i in range(200)})
    obs = spark.createDataFrame([("A", at(m / 60)) for m in times], "station_id string, obs_time_utc timestamp")
    row = Q.observation_cadence(obs, chunk_hours=6).first()
    gaps = sorted(b - a for a, b in zip(times, times[1:]))
    assert (row.n_obs, row.min_gap_min, row.max_gap_min) == (len(times), gaps[0], gaps[-1])
    assert row.median_gap_min == pytest.approx((gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2)


def test_longest_run_prefers_the_first_and_has_context(spark):
    df = hours(spark, {"A": "apppaappp" + "a" * 30, "B": "aaaa"})
    run = Q.longest_run(df, F.col("data_present") == 1)
    assert [(r.station_id, r.start_utc, r.end_utc, r.run_rows) for r in run.collect()] == [("A", at(1), at(3), 3)]
    assert Q.context_of_runs(df, run, 2).count() == 6


def test_window_recovery_looks_any_distance_back_and_ahead(spark):
    t = lambda h: dt.datetime(2025, 6, 10) + dt.timedelta(hours=h)
    windows = spark.createDataFrame([(1, t(0), t(3), 2, "network_midnight"), (2, t(100), t(101), 1, "network_other")],
                                    "window_id long, window_start_utc timestamp, window_end_utc timestamp, station_count long, outage_class string")
    targets = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C"), (2, "A")], "window_id long, station_id string")
    obs = spark.createDataFrame([("A", t(-60.5)), ("A", t(-70)), ("A", t(3)), ("A", t(3.25)), ("A", t(3.75)), ("B", t(-1.25)), ("B", t(63.5)), ("B", t(1))],
                                "station_id string, obs_time_utc timestamp")
    got = {r.window_id: r for r in Q.window_recovery(windows, targets, obs).collect()}
    one, two = got[1], got[2]
    assert (one.drop_min_utc, one.drop_max_utc, one.recovery_min_utc, one.recovery_max_utc) == (t(-60.5), t(-1.25), t(3.25), t(63.5))
    assert (one.n_with_last_before, one.n_with_first_after, one.status, one.drop_sync_class) == (2, 2, "ok", "loose")
    assert (two.n_with_last_before, two.n_with_first_after, two.drop_min_utc, two.recovery_min_utc) == (1, 0, t(3.75), None)
