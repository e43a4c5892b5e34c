"""The rule ledger against a direct computation; the classifier on planted texts and on the labelled rows it never saw."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from telewatch.llm import common, quality, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "x x x x x x", "é ß\x0bü\x0c語 #*$ |<>&%", "l1\nl1\n\n  \nl2\n l1\nl1", "a b c d a b c e b c d",
         "\x1c a\x85b", "w " * 300, " ".join(f"w{i}" for i in range(9000)), "A B!! C\r\nA B!! C", "𝒳 𝒴 𝒵 𝒳 𝒴 𝒵"]


def direct(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in t), len(lines) - len(set(lines)),
            len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}), len(lines), sum("A" <= c <= "Z" for c in t), len(set(w)))


def test_measures(documents):
    docs = documents(TEXTS).withColumnRenamed("lang", "_w").withColumnRenamed("source", "n_words")
    got = {r.doc_id: tuple(r)[1:] for r in rules.measure(docs).collect()}
    assert got == {i: direct(t) for i, t in enumerate(TEXTS)}


def test_colliding_hashes_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(rules, "PLACE_BITS", 62)  # two bits of hash
    texts = [t for t in TEXTS if t is None or len(t) < 5000]
    got = {r.doc_id: tuple(r)[1:] for r in rules.measure(documents(texts)).collect()}
    assert got == {i: direct(t) for i, t in enumerate(texts)}


def test_policies_and_ablations(documents):
    texts = [" ".join(f"w{i}" for i in range(60)), "few", "w " * 100, " ".join(f"W{i}" for i in range(60)).replace("W", "WXYZ"), None] * 2
    filled = rules.ledger(rules.measure(documents(texts)))
    rows = filled.collect()
    bits = [r.fail_bits for r in rows]
    for version in rules.POLICIES:
        mask = rules.mask_of(version)
        kept = filled.filter(rules.passes(version)).count()
        assert kept == sum(b & mask == 0 for b in bits)
        for r in rules.ablations(filled, version).collect():
            bit = rules.BIT[r.rule]
            assert r.n_failed == sum(b & bit != 0 for b in bits)
            assert r.n_failed_alone == sum(b & mask == bit for b in bits)
            assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)
    assert rules.verdicts(documents([]), "v1").collect() == []


def test_long_texts_of_few_words_fail_like_shorter_ones(documents):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, k, n)) for n, k in ((4999, 100), (5000, 100), (9000, 100), (9000, 9000), (40000, 4000))]
    rows = sorted(rules.verdicts(documents(texts), "v2").collect())
    few = rules.BIT["few_distinct_words"]
    assert [r.fail_bits for r in rows] == [few, few, few, 0, 0] and [r.kept for r in rows] == [False, False, False, True, True]


def test_ledger_runs_no_python(documents):
    text = rules.measure(documents(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


GOOD = ["the river runs to the sea and the town lies by it", "a small house stood near the old road", "they walked home in the evening light"]
BAD = ["BUY!! NOW!! CHEAP!!", "$$$ ### %%% win $$$", "click click click click"]


def planted(n, seed):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        texts.append(" ".join(rng.choice(GOOD if good else BAD, 6)))
        labels.append(int(good))
    return texts, labels


def test_classifier_on_planted_texts(spark, documents):
    texts, truth = planted(600, 1)
    docs = documents(texts + [None, ""]).withColumnRenamed("lang", "score")
    rows = [(i, y if i % 3 else None, 0) for i, y in enumerate(truth)] + [(None, 1, 0), (5, 7, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, quality.in_fold())
    assert 0.55 < model.prior < 0.85
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == y for i, y in enumerate(truth)) > 0.97 * len(truth)
    assert got[600].score == got[601].score
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(5), quality.fit(docs.repartition(5), labels, quality.in_fold())).collect()}
    assert again == {i: r.score for i, r in got.items()}
    kept = {r.doc_id for r in quality.good(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_the_prior_takes_all_unlabelled_rows(spark, documents):
    """The prior and the places of all rows against loops over every row."""
    texts, _ = planted(200, 5)
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.BINS + quality.SHARES), 0.1, np.zeros(1), np.ones(1), 0.5)
    z = model.margins(quality.features(pa.array(texts)))
    sp = np.sort(z[:31])
    counts = quality._places(documents(texts).repartition(4), model, sp, "text")
    assert counts.tolist() == [sum(1 for x in z if sum(y <= x for y in sp) == k) for k in range(len(sp) + 1)]
    bounds = []
    for i, s in enumerate(sp):
        tail_p, tail_u = (len(sp) - i) / len(sp), sum(x >= s for x in z) / len(z)
        bounds.append(((tail_u + np.sqrt(np.log(40) / (2 * len(z))) + np.sqrt(np.log(40) / (2 * len(sp)))) / tail_p, i, tail_u / tail_p))
    assert quality.estimate_prior(sp, counts) == pytest.approx(min(max(min(bounds)[2], 0.05), 0.98))


def test_scores_equal_plain_sums(spark, documents):
    """A whole fit, again by plain Adam steps over the same rows, gives the same scores."""
    texts, truth = planted(90, 6)
    docs = documents(texts)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(truth)], "doc_id long, quality int, toxic int")
    fold = {r.doc_id for r in docs.filter(quality.in_fold()).collect()}
    x = quality.features(pa.array(texts)).astype(float)
    free = [i for i in range(90) if i not in fold]
    p, u = x[[i for i in free if truth[i]]], x[free]
    mean, scale = u.mean(0), u.std(0) + 0.02
    p, u = ((a - mean) / scale / np.sqrt(x.shape[1]) for a in (p, u))
    w, b, m, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    sigmoid, prior = lambda a: 1 / (1 + np.exp(-a)), 0.6
    for t in range(1, quality.ROUNDS + 1):
        sp, su = sigmoid(p @ w + b), sigmoid(u @ w + b)
        negative = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()
        down = np.r_[u.T @ su, su.sum()] / len(u) - prior * np.r_[p.T @ sp, sp.sum()] / len(p)
        grad = prior * np.r_[p.T @ (sp - 1), (sp - 1).sum()] / len(p) + down if negative >= 0 else -down
        grad[:-1] += quality.DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step = quality.STEP * (1 - t / (quality.ROUNDS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    want = sigmoid((x - mean) / scale / np.sqrt(x.shape[1]) @ w + b)
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, quality.in_fold(), prior=prior)).collect()}
    assert all(got[i] == pytest.approx(want[i], abs=2e-6) for i in range(90))


def test_held_out_labels_are_not_read(spark, documents):
    texts, truth = planted(300, 2)
    docs = documents(texts)
    fold = {r.doc_id for r in docs.filter(quality.in_fold()).collect()}
    one, other = ([(i, (1 - y if i in fold and flip else y), 0) for i, y in enumerate(truth)] for flip in (False, True))
    a, b = (quality.fit(docs, spark.createDataFrame(r, "doc_id long, quality int, toxic int"), quality.in_fold()) for r in (one, other))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_classifier_without_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(documents([]), labels, quality.in_fold())
    assert quality.score(documents([]), model).collect() == []
    assert [r.score for r in quality.score(documents(["a", None]), quality.fit(documents(["a"]), labels, quality.in_fold())).collect()] == [0.5, 0.5]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_held_out_quality(spark):
    common.prepare(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.fit(docs, labels, quality.in_fold())).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.95
