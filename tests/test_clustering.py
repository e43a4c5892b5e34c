import inspect
import math

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from telewatch.operators import clustering as C
from telewatch.operators import diagnostics as X
from telewatch.operators import review as R
from telewatch.operators import spanning as S

EPISODES = ("station_id string, start_hour timestamp, end_hour timestamp, duration_hours long, n_events long, n_channels long, affected_channels string, "
            "n_sensor_groups long, affected_sensor_groups string, dominant_detector string, detector_concordance int, max_abs_zscore double, "
            "max_iforest_score double, min_rolling_variance double, reasons string")


def episode(i, station="A", hours=2, groups="anemometer", detector="zscore", z=5.0, variance=0.1, reasons="mad_high"):
    return (station, at(i * 100), at(i * 100 + hours - 1), hours, 1, 1, "windspeed_avg_kmh", groups.count("|") + 1, groups, detector, 1, z, 0.6, variance, reasons)


def test_features(spark):
    rows = [episode(0, hours=72, groups="anemometer|wind_vane", detector="stuck"), episode(1, groups="new", z=None, variance=None), episode(2, variance=0.9)]
    got = {r.start_hour: r for r in C.episode_features(spark.createDataFrame(rows, EPISODES)).collect()}
    first, second = got[at(0)], got[at(100)]
    assert (first.sg_anemometer, first.sg_wind_vane, first.sg_barometer, first.det_stuck, first.sg_other) == (1, 1, 0, 1, 0)
    assert first.log_duration == pytest.approx(math.log(73))
    assert (second.sg_other, second.max_abs_zscore, second.min_rolling_variance) == (1, 0, 0.9)
    none = C.episode_features(spark.createDataFrame([episode(0, variance=None)], EPISODES)).first()
    assert none.min_rolling_variance == 0.0
    assert len(C.FEATURES) == 17
    scaled = C.standardise(C.episode_features(spark.createDataFrame(rows, EPISODES)))
    stats = scaled.agg(F.avg("log_duration").alias("m"), F.stddev_pop("log_duration").alias("s"), F.max("sg_barometer").alias("c")).first()
    assert stats.m == pytest.approx(0, abs=1e-12) and stats.s == pytest.approx(1) and stats.c == 0.0


def labels(spark, matrix, size, samples, block=5):
    points = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id long, vector array<double>")
    edges = C.spanning_edges(points, len(matrix), samples, block=block).toPandas()
    out = C.hierarchy_labels(edges, size).sort_values("id")
    return edges, out["cluster_label"].to_numpy(), out["cluster_probability"].to_numpy()


def test_three_groups_and_a_far_point(spark):
    rng = np.random.default_rng(4)
    blobs = np.concatenate([rng.normal(c, 0.1, size=(8, 2)) for c in ((0, 0), (10, 0), (0, 10))])
    _, found, strength = labels(spark, blobs, 5, 3)
    assert sorted(set(found)) == [0, 1, 2] and all(len(set(found[i:i + 8])) == 1 for i in (0, 8, 16))
    assert strength.min() > 0 and strength.max() == 1.0
    lone = np.concatenate([rng.normal(0, 0.1, size=(8, 2)), rng.normal(8, 0.1, size=(8, 2)), [[100.0, 100.0]]])
    _, found, strength = labels(spark, lone, 5, 3)
    assert found[-1] == -1 and strength[-1] == 0.0 and set(found[:16]) == {0, 1}
    again = labels(spark, lone, 5, 3)[1]
    assert list(again) == list(found)


@pytest.mark.parametrize("samples", [1, 4])
def test_spanning_tree_has_the_least_weight(spark, samples):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(33, 3)), 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, samples - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, total = {0}, 0.0
    while len(inside) < len(x):
        w, j = min((reach[i, j], j) for i in inside for j in range(len(x)) if j not in inside)
        inside.add(j)
        total += w
    edges = labels(spark, x, 5, samples, block=7)[0]
    tree = C._forest(edges)
    assert len(tree) == len(x) - 1 and tree["w"].sum() == pytest.approx(total)


def test_cluster_episodes_and_sweep(spark):
    rng = np.random.default_rng(2)
    kinds = [("anemometer", "stuck"), ("barometer", "zscore"), ("rain_gauge", "physical")]
    rows = [episode(i, station=f"S{i % 4}", groups=kinds[i % 3][0], detector=kinds[i % 3][1], z=5 + float(rng.normal(0, .05)), hours=2 + i % 2)
            for i in range(45)]
    df = spark.createDataFrame(rows, EPISODES)
    out = C.cluster_episodes(df, 8, 3)
    assert out.columns == [*df.columns, "cluster_label", "cluster_probability"] and out.count() == 45
    assert X.purity(out).first().mean_sensor_group_purity == 1.0
    sweep = {(r.min_cluster_size, r.min_samples): r for r in X.parameter_sweep(df, [(8, 3), (8, 1), (20, 3)]).collect()}
    assert set(sweep) == {(8, 3), (8, 1), (20, 3)}
    chosen = out.where("cluster_label >= 0").select("cluster_label").distinct().count()
    assert sweep[(8, 3)].n_clusters == chosen and sweep[(20, 3)].n_clusters <= 2
    assert len(X.SWEEP) == 15
    assert C.cluster_episodes(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="max_episodes"):
        C.cluster_episodes(df, max_episodes=10)


# --- review queue -----------------------------------------------------------------------------
CLUSTERS = EPISODES + ", cluster_label int, cluster_probability double"


def test_representatives_and_boundary(spark):
    probs = [.91, .88, .77, .65, .51, .42, .35, .24, .12, .03]
    rows = [(*episode(i), 2, p) for i, p in enumerate(probs)] + [(*episode(50 + i), 5, .5) for i in range(3)]
    picks = R.cluster_picks(spark.createDataFrame(rows, CLUSTERS), 5, 2).collect()
    two = {role: sorted((r.cluster_probability for r in picks if r.cluster_label == 2 and r.role == role), reverse=True) for role in ("representative", "boundary")}
    assert two == {"representative": probs[:5], "boundary": [.12, .03]}
    assert sum(r.cluster_label == 5 and r.role == "representative" for r in picks) == 3
    assert not any(r.cluster_label == 5 and r.role == "boundary" for r in picks)
    assert {r.cluster_size for r in picks if r.cluster_label == 2} == {10}


def test_queue_order_and_roles(spark):
    noise = [(*episode(i, z=100.0 - i), -1, 0.0) for i in range(30)]
    noise += [(*episode(40 + i, hours=h), -1, 0.0) for i, h in enumerate([48, 72, 24])]
    cluster = [(*episode(60 + i, reasons="physical_suspect_breach|mad_high" if i == 5 else "stuck_variance_zero"), 3, 1 - i / 10) for i in range(8)]
    df = spark.createDataFrame(noise + cluster, CLUSTERS)
    queue = R.review_queue(df)
    rows = queue.orderBy("review_id").collect()
    assert queue.columns == R.QUEUE_COLUMNS and [r.review_id for r in rows] == list(range(1, len(rows) + 1))
    roles = [r.role for r in rows]
    assert roles == ["representative"] * 5 + ["boundary"] * 2 + ["noise_sustained"] * 3 + ["noise_check"] * 20 + ["physical_limit"]
    assert [r.duration_hours for r in rows if r.role == "noise_sustained"] == [72, 48, 24]
    assert [r.max_abs_zscore for r in rows if r.role == "noise_check"] == [100.0 - i for i in range(20)]
    last = rows[-1]
    assert (last.start_hour, last.cluster_size, last.needs_5min_confirmation, last.label) == (at(6500), 8, False, "")
    assert len({(r.station_id, r.start_hour) for r in rows}) == len(rows)
    assert all(r.needs_5min_confirmation for r in rows[:7])
    counts = {r.role: (r.rows, r.to_confirm) for r in R.queue_by_role(queue).collect()}
    assert counts["representative"] == (5, 5) and counts["noise_check"] == (20, 0)
    assert R.representatives_for_station(df, queue, "A").count() == 5
    only_clusters = R.review_queue(df.where("cluster_label = 3"))
    assert R.queue_by_role(only_clusters).where("role = 'noise_check'").first().rows == 0


def test_one_pass_over_pairs_gives_the_trees_of_all_samples(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(17, 3))
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    pairs = C._block_pairs(C._blocks(points, 5, core=False), 4)
    assert sorted((r.i, r.j, r.ids[0], r.ids_of[0]) for r in pairs.collect()) == [(i, j, 5 * i, 5 * j) for i in range(4) for j in range(i, 4)]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()  # no table of blocks goes through the driver
    both = C.spanning_trees(points, 17, [1, 4], block=5).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for ms in (1, 4):
        core = np.sort(d, axis=1)[:, ms - 1]
        _, _, least = C._prim(np.maximum(np.maximum(d, core[:, None]), core))
        assert C._forest(both[both["min_samples"] == ms])["w"].sum() == pytest.approx(least.sum())


@pytest.mark.parametrize("cell", [3, 16])
def test_search_by_boxes_gives_the_trees_of_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "PART", 40)
    monkeypatch.setattr(S, "FEW", 2)
    rng = np.random.default_rng(cell)
    x = np.concatenate([np.round(rng.normal(c, 0.4, size=(40, 3)), 1) for c in (0, 5, (0, 9, 0))] + [[[60.0, -60, 0]], rng.normal(0, 30, size=(9, 3))])
    x = x[rng.permutation(np.append(np.arange(len(x)), [0, 0, 0, 1, 129]))]  # copies too, fewer and more than the samples
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    both = S.trees(points, [1, 4], cell).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for ms in (1, 4):
        core = np.sort(d, axis=1)[:, ms - 1]
        reach = np.maximum(np.maximum(d, core[:, None]), core)
        tree = both[both["min_samples"] == ms]
        assert len(tree) == len(C._forest(tree)) == len(x) - 1 and tree["w"].to_numpy() == pytest.approx(reach[tree["a"], tree["b"]])
        assert np.sort(tree["w"]) == pytest.approx(np.sort(C._prim(reach)[2]))


def test_more_episodes_than_all_pairs_can_take(spark, monkeypatch):
    rng = np.random.default_rng(3)
    kinds = [("anemometer", "stuck"), ("barometer", "zscore"), ("rain_gauge", "physical")]
    rows = [episode(i, station=f"S{i % 4}", groups=kinds[i % 3][0], detector=kinds[i % 3][1], z=5 + float(rng.normal(0, .05)), hours=2 + i % 2)
            for i in range(60)]
    df = spark.createDataFrame(rows, EPISODES)
    of = lambda out: {r.start_hour: (r.cluster_label, round(r.cluster_probability, 9)) for r in out.collect()}
    pairs = of(C.cluster_episodes(df, 8, 3))
    assert inspect.signature(C.cluster_episodes).parameters["max_episodes"].default is None  # 200,000 of them were refused
    assert inspect.signature(X.parameter_sweep).parameters["max_episodes"].default is None
    taken, whole = [], S.trees
    monkeypatch.setattr(C, "PAIRED", 0)
    monkeypatch.setattr(C, "searched_trees", lambda points, samples: taken.append(list(samples)) or whole(points, samples, 7))
    found = of(C.cluster_episodes(df, 8, 3))
    assert taken == [[3]] and set(found) == set(pairs)
    names = {(found[t][0], pairs[t][0]) for t in pairs}
    assert len(names) == len({a for a, _ in names}) == len({b for _, b in names}) >= 3  # the same clusters by other numbers
    assert all(found[t][1] == pairs[t][1] for t in pairs)
    assert len(X.parameter_sweep(df, [(8, 3), (8, 1)]).collect()) == 2 and taken[-1] == [1, 3]


def test_a_single_vector(spark):
    points = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, vector array<double>")
    tree = S.trees(points, [1, 5]).toPandas()
    assert sorted(zip(tree["min_samples"], tree["a"], tree["b"], tree["w"])) == [(ms, 0, i, 0.0) for ms in (1, 5) for i in range(1, 5)]
