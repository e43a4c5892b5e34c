"""Near-duplicates against brute force over all pairs."""

import itertools
import re

import numpy as np
import pytest

from telewatch.llm import graph, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(t, size):
    w = WORD.findall(lower(t))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts, size, percent):
    """Component (smallest index) of every text."""
    sets, label = [shingles(t, size) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i] and sets[j]:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 4000))
    texts = [None, "", "  \n", "one", "One", "two words", "two  WORDS", "É", "é", "a b c d e f"]
    for _ in range(8):
        base = [word() for _ in range(int(rng.integers(20, 150)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(0, len(copy)))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy))
    chain = [word() for _ in range(100)]  # each link holds, the ends are far apart
    for k in range(20):
        texts.append(" ".join(chain))
        chain[5 * k] = word()
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize("size, percent, block", [(3, 85, 512), (5, 80, 4)])
def test_equals_brute_force(documents, monkeypatch, size, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    texts = corpus(size)
    docs = documents(texts).withColumnRenamed("lang", "key").withColumnRenamed("source", "rep").repartition(3)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, size, percent).collect()}
    label, n = brute(texts, size, percent)
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    left = neardup.without_copies(docs, size, percent)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(label))


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.SYMBOLS, neardup.GUARANTEED, replace=False)] ^= np.uint16(1)
    assert (neardup.keys(a) == neardup.keys(b)).any(1).all()


def test_null_and_repeated_ids_and_no_rows(spark, documents):
    rows = [(None, "x y z"), (None, "x y z"), (4, "x y z"), (4, "x y z"), (2, "X y z"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [("2", "2", True), ("4", "2", False), ("4", "2", False), ("7", "7", True), ("7", "7", True), ("None", "None", True), ("None", "None", True)]
    assert sorted(str(r.doc_id) for r in neardup.without_copies(docs).collect()) == ["2", "7", "None", "None"]
    assert neardup.near_duplicates(documents([])).collect() == [] and neardup.without_copies(documents([])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_clashing_names_and_null_ids_survive(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 7), (2, text, 8), (3, "quite another text with words of its own here", 9), (3, "quite another text with words of its own here", 9)]
    rows += [(None, f"row {i} without an id has words like these" if i else None, i) for i in range(20)] + [(None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _repeated int")
    left = neardup.without_copies(docs)
    assert left.columns == docs.columns
    got = sorted(map(str, map(tuple, left.collect())))
    assert got == sorted(map(str, [rows[0], rows[2], *rows[4:]]))


def test_chance_meetings_form_no_group(documents, monkeypatch):
    words = [[f"w{i}x{j}" for j in range(40)] for i in range(41)]
    texts = [" ".join(words[i] + words[i + 1]) for i in range(40)] + [" ".join(words[0] + words[1][:-1]), " ".join(words[40])]  # a chain of like texts
    grouped, whole = [], neardup._linked_in_groups
    monkeypatch.setattr(neardup, "_linked_in_groups", lambda members, *rest: grouped.append(members.count()) or whole(members, *rest))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(texts), size=3, percent=85).collect()}
    assert grouped == [0]  # the whole chain was one group, whose work is its square
    assert got == {**{i: i for i in range(42)}, 40: 0}


def test_unlike_texts_of_a_large_bucket_form_no_group(documents, monkeypatch):
    line = [f"line{j}" for j in range(60)]
    texts = [" ".join(line + [f"own{i}x{j}" for j in range(150)]) for i in range(120)]  # unlike but for a common line
    copy = texts[0].split()
    texts += [" ".join(copy[:k] + copy[k + 1:]) for k in range(100, 112)]
    grouped, whole, shared = [], neardup._linked_in_groups, []
    near = neardup._near_in_buckets
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "_near_in_buckets", lambda members, *rest: shared.append(members.select("rep").distinct().count()) or near(members, *rest))
    monkeypatch.setattr(neardup, "_linked_in_groups", lambda members, *rest: grouped.append(members.count()) or whole(members, *rest))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(texts)).collect()}
    assert shared[0] > 20 and grouped == [0]  # all of them were one group, compared shingle by shingle
    assert got == {i: 0 if i >= 120 else i for i in range(132)}


def test_classes_near_another_component():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (9, neardup.SYMBOLS)).astype(np.uint16)
    sig[[1, 2, 5]] = sig[0]
    sig[1, :30], sig[2, :41] = 7, 8  # 30 and 41 symbols from the first; 41 from each other
    sig[6] = sig[5]
    row = lambda i, block, component: {"block": block, "rep": i, "component": component, "sig": sig[i].tobytes()}
    one = [row(i, 0, c) for i, c in enumerate([0, 1, 2, 3, 4])]
    two = [row(5, 1, 1), row(6, 1, 6), row(7, 1, 4), row(8, 1, 3)]
    assert neardup._block_near(one, 40) == ([0, 1], [0, 1], [0, 0])
    assert sorted(zip(*neardup._block_near(one + two, 40))) == [(0, 0, 0), (1, 1, 0), (5, 1, 0), (6, 6, 0)]
    assert neardup._block_near(two[2:], 40) == ([], [], [])
    assert neardup._far(85) == neardup._far(80) == neardup.FAR and neardup._far(50) > 55
