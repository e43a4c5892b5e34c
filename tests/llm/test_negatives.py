"""Hard negatives against a plain search, and Strassen's products against direct ones."""

import math

import numpy as np
import pytest

from telewatch.llm import negatives as N

VEC = "vec_id long, embedding array<float>, label int"


def plain(rows, every):
    q = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
         if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in q:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for i, (label, a) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v)), j, b) for j, b, v in q if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            near = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("m,k,n,leaf", [(1, 1, 1, 1), (7, 5, 3, 1), (65, 64, 130, 8), (33, 70, 129, 16), (2, 0, 3, 4)])
def test_strassen_equals_the_product(m, k, n, leaf):
    rng = np.random.default_rng(m)
    a, b = rng.integers(-2 ** 40, 2 ** 40, (m, k)), rng.integers(-2 ** 40, 2 ** 40, (k, n))  # sums wrap alike
    assert (N.strassen(a, b, leaf) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(-3, 3, (4, 60)), rng.permutation(60)
    scores[3] = N.NONE
    kept = []
    for parts in ([slice(0, 60)], [slice(40, 60), slice(0, 3), slice(3, 40)]):
        h = N.Heaps(4, 5)
        for p in parts:
            h.merge(scores[:, p], ids[p])
        kept.append([c.tolist() for c in h.rows()])
    want = [sorted(zip(-s, ids.tolist()))[:5] if s[0] != N.NONE else [] for s in scores]
    assert kept[0] == kept[1] == [[o for o, w in enumerate(want) for _ in w], [-s for w in want for s, _ in w], [i for w in want for _, i in w]]


def test_mining_equals_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE_BYTES", 700)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=9), 1)], int(rng.integers(0, 3)) if i % 3 else 0) for i in range(400)]
    rows += [(400 + k, list(rows[1][1]), k % 4) for k in range(30)]  # ties
    rows += [(1, [0.5] * 9, 1), (100, [0.1] * 9, 0), (600, [], 1), (601, [1.0], 0), (602, [2.0] * 14, 1), (700, None, 1), (800, [1.0, None], 1), (900, [1.0], None),
             (1000, [float("nan")], 1), (1100, [float("inf")], 1), (None, [1.0], 1), (1200, [0.0] * 9, 77)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VEC + ", anchors string").repartition(5)
    got = N.mine(df, anchor="vec_id % 20 = 0", anchor_tile=7)
    assert sorted(map(tuple, got.collect())) == plain(rows, 20)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([(100, [1.0], 1), (200, [1.0], 2)], VEC)
    assert N.mine(df).count() == 0 and N.mine(df.limit(0)).count() == 0
