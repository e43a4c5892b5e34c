import numpy as np
import pytest
from pyspark.sql import functions as F

from telewatch.functions import columns as C
from telewatch.functions import vocab as V
from telewatch.functions.quantiles import pooled_quantile, pooled_quantiles


def values(df, name):
    return [r[name] for r in df.collect()]


def test_vocabulary_is_consistent():
    assert len(V.CANONICAL_COLUMNS) == 41 and len(V.MEASUREMENTS) == 29 and len(V.METADATA_COLUMNS) == 12
    assert len(V.RAW_COLUMNS) == 38 and len(V.GAP_FILLED_COLUMNS) == 42
    assert len(V.OBSERVATION_RENAMES) == 37 and len(V.REFERENCE_HOURLY_RENAMES) == 22 and len(V.REFERENCE_DAILY_RENAMES) == 7
    assert len(V.HARD_LIMITS) == 20 and len(V.SUSPECT_LIMITS) == 11


def test_sensor_group_takes_the_longest_prefix(spark):
    names = ["temp_avg_c", "winddir_sin", "windspeed_low_kmh", "uv_high", "solar_radiation_high_wm2", "wind", "unknown"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert values(df.select(C.sensor_group("c").alias("g")), "g") == [
        "thermo_hygrometer", "wind_vane", "anemometer", "light_uv", "light_uv", "other", "other"]


def test_status_class_first_match_wins(spark):
    rows = [(0.54, 0), (0.9, 168), (0.69, 0), (0.84, 5), (0.85, 1), (0.85, 0)]
    df = spark.createDataFrame(rows, "r double, p long").select(C.status_class("r", "p").alias("s"))
    assert values(df, "s") == ["outage_dominated", "outage_dominated", "weak", "usable", "reliable_but_terminal_gap",
                               "reliable_reference_candidate"]


def test_right_closed_buckets(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 3.0, 3.5, 168.0, 169.0]], "v double")
    open_ended = df.select(C.right_closed("v", V.DURATION_EDGES, V.DURATION_LABELS, lowest=False).alias("b"))
    assert values(open_ended, "b") == [None, "short", "medium", "long", "very_long"]
    far = spark.createDataFrame([(0.0,), (25.0,), (2000.0,), (2001.0,)], "v double")
    closed = far.select(C.right_closed("v", V.DISTANCE_EDGES_KM, V.DISTANCE_LABELS, lowest=True).alias("b"))
    assert values(closed, "b") == ["0-25km", "0-25km", ">500km", None]


def test_haversine_and_time_helpers(spark):
    one = spark.sql("select timestamp'2025-06-01 10:17:00' t")
    row = one.select(
        C.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
        C.floor_time("t", 300).cast("string").alias("floor"), C.iso_utc("t").alias("iso"), C.offset_text("t").alias("offset"),
        C.window_class(F.expr("timestamp'2025-06-01 23:00:00'")).alias("late")).first()
    assert row.half == pytest.approx(np.pi * 6371.0)
    assert (row.floor, row.iso, row.offset, row.late) == (
        "2025-06-01 10:15:00", "2025-06-01T10:17:00Z", "2025-06-01 10:17:00+0000", "network_midnight")


def test_a_pooled_quantile_of_a_large_key(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.exponential(20, 30000), 3), "flat": np.repeat(5.0, 200), "spike": np.concatenate([np.zeros(900), rng.normal(size=100)])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "k string, v double").repartition(4)
    got = {r.k: r.q for r in pooled_quantile(df, ["k"], "v", 0.997, "q").collect()}
    assert all(got[k] == pytest.approx(np.percentile(xs, 99.7), rel=1e-12, abs=1e-12) for k, xs in groups.items())


@pytest.mark.parametrize("q,few_keys", [(0.0, True), (0.25, False), (0.9, True), (0.997, False), (1.0, True)])
def test_pooled_quantiles_are_exact(spark, q, few_keys):
    rng = np.random.default_rng(8)
    groups = {"normal": rng.normal(size=3001), "skewed": 10.0 ** rng.uniform(-300, 300, 1500), "ties": rng.integers(0, 4, 2000).astype(float), "same": np.full(500, 7.0),
              "wide": np.array([-1.7e308, 0.0, 1.0, 1.7e308]), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "half": np.r_[np.zeros(1000), np.ones(1000)],
              "none": np.zeros(0)}
    rows = [(k, float(x), float(-x)) for k, xs in groups.items() for x in xs] + [("none", None, None), ("normal", float("nan"), None)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(3)
    got = {r.k: (r.a, r.b) for r in pooled_quantiles(df, ["k"], {"a": (F.col("v"), q), "b": (F.col("w"), 0.5)}, few_keys, grid=8, accuracy=40, bound=20).collect()}
    assert got.keys() == groups.keys() - {"none"}

    def exact(xs, q):
        xs, at = sorted(xs.tolist()), q * (len(xs) - 1)
        low, high = xs[int(np.floor(at))], xs[int(np.ceil(at))]
        return low + (high - low) * (at - np.floor(at))

    assert got == {k: (exact(xs, q), exact(-xs, 0.5)) for k, xs in groups.items() if len(xs)}


def test_infinite_values_are_ordered(spark):
    inf = float("inf")
    df = spark.createDataFrame([("k", x) for x in [-inf] * 3 + [1.0, 2.0, 3.0, 4.0, 5.0] + [inf] * 2], "k string, v double")
    got = pooled_quantiles(df, ["k"], {"a": (F.col("v"), 0.0), "m": (F.col("v"), 4 / 9), "z": (F.col("v"), 1.0)}, grid=4, bound=1).first()
    assert (got.a, got.m, got.z) == (-inf, 2.0, inf)


def test_no_key_is_ordered_in_one_task(spark):
    df = spark.range(200_000).select(F.lit("k").alias("k"), F.randn(5).alias("v")).repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = pooled_quantile(df, ["k"], "v", 0.5, "q")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in text and "collect" not in text and before == spark.conf.get("spark.sql.shuffle.partitions")
    assert out.first().q == df.select(F.percentile("v", F.lit(0.5))).first()[0]


def test_a_smooth_column_needs_no_sketch(spark, monkeypatch):
    df = spark.range(50_000).select(F.lit("k").alias("k"), F.randn(7).alias("v"))
    monkeypatch.setattr(F, "percentile_approx", None)  # counted in one pass
    assert pooled_quantile(df, ["k"], "v", 0.9, "q").first().q == df.select(F.percentile("v", F.lit(0.9))).first()[0]


def test_quantile_rounds_count_by_range_not_by_key(spark, monkeypatch):
    from telewatch.functions import quantiles as Q
    plans, store = [], Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df, name))
    df = spark.range(500).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    got = {r.k: r.q for r in Q.pooled_quantiles(df, ["k"], {"q": (F.col("v"), 0.5)}, bound=20).collect()}
    assert got == {"0": 249.0, "1": 250.0}
    assert len(plans) > 1 and all("Generate" not in p for p in plans)  # one quantile needs no explode
    assert any("Aggregate [_r#" in p for p in plans[1:])
