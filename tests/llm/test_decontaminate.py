"""Decontamination against brute force over all windows of the items' sizes, at the alignments of shared shingles."""

import re
from collections import Counter

import numpy as np
import pytest

from telewatch.llm import decontaminate as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def grams(w):
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def held(text, item):
    """The best similarity of any window of the item's size."""
    d, i = words(text), words(item)
    if not d or not i:
        return 0
    best, b = 0, grams(i)
    for s in range(max(1, len(d) - len(i) + 1)):
        a = grams(d[s:s + len(i)])
        best = max(best, sum((a & b).values()) / sum((a | b).values()))
    return best


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(0, 500))
    items = [" ".join(word() for _ in range(n)) for n in (14, 20, 20, 33, 59)] + ["one two three", "", None, "lone", "la la la la la la la la la"]
    texts = [None, "", "one two", "One\nTWO  three", "la " * 30, "la " * 9, "zz one two three yy qq rr", "one two three one two three", "zz one two yy three qq rr", "a LONE word in a text", "lone", "x lone"]
    for i in range(40):
        body = [word() for _ in range(60)]
        w = words(items[i % 5])
        for _ in range(i % 4):
            w[int(rng.integers(0, len(w)))] = word()
        w = w[i % 3:] if i % 7 == 0 else w
        texts.append(" ".join(body[:30] + w + body[30:]) if i % 5 else " ".join(w).upper())
    texts += [" ".join(word() for _ in range(80)) for _ in range(10)] + [items[0], items[0]]
    return texts, items


def test_equals_brute_force(spark, documents, case):
    texts, items = case
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, row string")
    docs = documents(texts).withColumnRenamed("lang", "_row").withColumnRenamed("source", "item_id").repartition(3)
    got = {(r.doc_id, r.item_id): r.similarity for r in D.report(docs, bench).collect()}
    want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(items) if (s := held(t, item)) >= 0.8}
    assert {k: round(v, 6) for k, v in want.items()} == got and len(want) > 15
    left = D.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_blocks_of_the_benchmark_change_nothing(spark, documents, case, monkeypatch):
    texts, items = case
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(map(tuple, D.report(documents(texts), bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 40)
    assert sorted(map(tuple, D.report(documents(texts), bench).collect())) == whole


def test_fingerprints_within_the_radius_share_a_block(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        a = int(rng.integers(0, 2 ** 63))
        b = a
        for k in rng.choice(63, D.RADIUS, replace=False):
            b ^= 1 << int(k)
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    a = D._blocks(df.withColumnRenamed("a", "fp"), 0, "i")
    b = D._blocks(df.withColumnRenamed("b", "fp"), D.ERRORS, "i")
    assert a.join(b, ["i", "block", "value"]).select("i").distinct().count() == 40


def test_null_ids_and_no_rows(spark, documents, case):
    _, items = case
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(None, items[0]), (None, "clean words here"), (3, None)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in D.report(docs, bench).collect()] == [(None, 0, 1.0)]
    assert sorted(str(r.text) for r in D.clean(docs, bench).collect()) == ["None", "clean words here"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.report(docs, none).collect() == [] and D.clean(docs, none).count() == 3 and D.report(documents([]), bench).collect() == []


def test_plan_has_no_python(spark, documents, case):
    bench = spark.createDataFrame(list(enumerate(case[1])), "item_id long, text string")
    plan = D.report(documents(case[0]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
