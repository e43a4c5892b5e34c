import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from telewatch.operators import faults as E

SCORES = ("station_id string, hour_utc timestamp, channel string, zscore double, rolling_variance double, iforest_score double, flag_zscore boolean, "
          "flag_stuck boolean, flag_iforest boolean, flag_physical boolean, flag_physical_suspect boolean, flag boolean, reason string")
TOKENS = {"z": "mad_high", "s": "stuck_variance_zero", "i": "iforest_outlier", "p": "physical_limit_breach", "u": "physical_suspect_breach"}


def scores(spark, cells):
    """cells: station -> [(hour, letters of the detectors that fired)], all in one channel"""
    return spark.createDataFrame([
        (s, at(h), "temp_avg_c", -float(h), 0.5, 0.6, *[x in d for x in "zsipu"], bool(d), "|".join(TOKENS[x] for x in "zsipu" if x in d))
        for s, row in cells.items() for h, d in row], SCORES)


def test_runs_of_flagged_hours(spark):
    df = scores(spark, {"EVENT": [(h, "z") for h in range(5)], "SPLIT": [(0, "z"), (1, "z"), (2, "z"), (3, ""), (4, "z"), (5, "z")],
                        "GAP": [(0, "z"), (1, "z"), (3, "z"), (4, "z")]})
    got = {}
    for r in E.fault_events(df).orderBy("start_hour").collect():
        got.setdefault(r.station_id, []).append((r.start_hour, r.duration_hours))
    assert got == {"EVENT": [(at(0), 5)], "SPLIT": [(at(0), 3), (at(4), 2)], "GAP": [(at(0), 2), (at(3), 2)]}
    joined = {r.station_id: r.duration_hours for r in E.fault_events(df, max_gap_hours=1).collect()}
    assert joined == {"EVENT": 5, "SPLIT": 5, "GAP": 4}  # the duration counts flagged hours


def test_dominant_detector_and_reasons(spark):
    df = scores(spark, {"A": [(0, "s"), (1, "s"), (2, "s"), (3, "s"), (4, "z")], "B": [(0, "pi")], "C": [(0, "iu")], "D": [(0, "z"), (1, "zi"), (2, "z")]})
    got = {r.station_id: r for r in E.fault_events(df).collect()}
    assert {s: (r.dominant_detector, r.detector_concordance) for s, r in got.items()} == {
        "A": ("stuck", 2), "B": ("physical", 2), "C": ("physical", 2), "D": ("zscore", 2)}
    assert got["D"].reasons == "iforest_outlier|mad_high" and got["D"].max_abs_zscore == 2.0


EVENTS = ("station_id string, channel string, start_hour timestamp, end_hour timestamp, duration_hours long, dominant_detector string, "
          "detector_concordance int, max_abs_zscore double, max_iforest_score double, min_rolling_variance double, reasons string")


def events(spark, rows):
    return spark.createDataFrame([(s, c, at(a), at(a + n - 1), n, d, 1, z, 0.5, v, r) for s, c, a, n, d, z, v, r in rows], EVENTS)


def test_episode_rows(spark):
    df = events(spark, [
        ("WIND", "winddir_sin", 0, 50, "stuck", 1.0, 0.1, "stuck_variance_zero"), ("WIND", "windspeed_avg_kmh", 0, 49, "stuck", 2.0, None, "mad_high"),
        ("WIND", "windgust_avg_kmh", 0, 51, "zscore", 6.0, 0.3, "iforest_outlier|mad_high"),
        ("OFFSET", "temp_avg_c", 0, 500, "stuck", 1.0, 0.0, "mad_high"), ("OFFSET", "uv_high", 200, 20, "stuck", 1.0, 0.0, "mad_high"),
        ("APART", "temp_avg_c", 0, 1, "zscore", 1.0, 0.0, "mad_high"), ("APART", "uv_high", 5, 1, "zscore", 1.0, 0.0, "mad_high")])
    rows = E.fault_episodes(df).collect()
    assert {s: sum(r.station_id == s for r in rows) for s in ("WIND", "OFFSET", "APART")} == {"WIND": 1, "OFFSET": 2, "APART": 2}
    wind = next(r for r in rows if r.station_id == "WIND")
    assert (wind.duration_hours, wind.n_events, wind.n_channels, wind.n_sensor_groups) == (51, 3, 3, 2)
    assert wind.affected_sensor_groups == "anemometer|wind_vane" and wind.dominant_detector == "stuck"
    assert wind.reasons == "iforest_outlier|mad_high|stuck_variance_zero" and wind.detector_concordance == 3
    assert (wind.max_abs_zscore, wind.min_rolling_variance) == (6.0, 0.1)


def slow_episodes(rows, tolerance):
    """Repeatedly take the first unassigned event and gather what starts near it and overlaps."""
    left, out = sorted(rows), []
    while left:
        first = left[0]
        end, mine, rest = first[1], [first], []
        for r in left[1:]:
            if r[0] - first[0] <= tolerance and r[0] <= end:
                mine.append(r)
                end = max(end, r[1])
            else:
                rest.append(r)
        out.append((first[0], end, len(mine)))
        left = rest
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_episodes_against_a_slow_model(spark, seed):
    rng = random.Random(seed)
    raw = {f"S{k}": [(rng.randrange(60), rng.choice([1, 1, 2, 4, 9, 30]), f"c{i:02d}") for i in range(40)] for k in range(8)}
    df = events(spark, [(s, c, a, n, "stuck", 1.0, 0.0, "mad_high") for s, rows in raw.items() for a, n, c in rows])
    got = {}
    for r in E.fault_episodes(df).collect():
        got.setdefault(r.station_id, []).append((r.start_hour, r.end_hour, r.n_events))
    for s, rows in raw.items():
        want = slow_episodes([(a, a + n - 1, c) for a, n, c in rows], 6)
        assert sorted(got[s]) == [(at(a), at(b), n) for a, b, n in want]
    assert E.fault_episodes(df.where(F.lit(False))).count() == 0


def test_long_chains_of_episodes_take_few_rounds(spark):
    """All events overlap, so nothing but the tolerance ends an episode, and 300 openers hang on one another."""
    rows = [("S", f"c{h % 3}", h, 5000 - h, "stuck", 1.0, 0.0, "mad_high") for h in range(2100)]
    placed = E.assign_episodes(events(spark, rows))
    openers = sorted(r.anchor for r in placed.select("anchor").distinct().collect())
    assert openers == list(range(1, 2101, 7))  # an event an hour, six hours of tolerance
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "collect_list" not in text
