"""Repeated strings against brute force over all places."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from telewatch.llm import suffixes as S


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        parts = [rng.integers(1, 3, int(rng.integers(1, 60))) for _ in range(int(rng.integers(1, 6)))]
        parts.append(parts[0])
        symbols = np.concatenate(parts).astype(np.uint16)
        n, lengths = len(symbols), np.array([len(p) for p in parts])
        first = np.cumsum(lengths) - lengths
        end = np.repeat(first + lengths, lengths)
        order = S.suffix_array(symbols, end)
        suffix = lambda i: (tuple(symbols[i:end[i]].tolist()), i)
        assert order.tolist() == sorted(range(n), key=suffix)
        got = S.common_prefixes(symbols, end, order, first, lengths)
        for a, b in zip(order, order[1:]):
            x, y = suffix(a)[0], suffix(b)[0]
            assert got[b] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def brute(texts):
    data, n = [(t or "").encode() for t in texts], S.LENGTH
    seen = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                gone[i:i + n] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if d else 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((len(d), int(gone[:-1].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    rand = lambda n: "".join(rng.choice(list("abcdefé \n\0"), n))
    passage, other = rand(420), rand(230)
    texts = [None, "", "short", "x" * 199, "y" * 200, "y" * 200, "z" * 900, rand(5000)]
    for k in range(40):
        cut = int(rng.integers(0, 60))
        texts.append(rand(int(rng.integers(0, 300))) + passage[cut:len(passage) - int(rng.integers(0, 60))] + rand(int(rng.integers(0, 100))))
    texts += [rand(100) + other + rand(100) for _ in range(2)] + [rand(50) + other[:199] + rand(60), other + other, "ab" * 300 + rand(50) + "ab" * 120]
    base = rand(2500)
    for _ in range(6):
        changed = list(base)
        for i in rng.integers(0, len(base), 5):
            changed[i] = "Q"
        texts.append("".join(changed))
    return [*texts, texts[-1]]


@pytest.mark.parametrize("hot", [4000, 5])
def test_equals_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)  # with 5, most anchors are dealt over several shards and merged
    texts = corpus(hot)
    docs = documents(texts).withColumnRenamed("lang", "name").withColumnRenamed("source", "anchor").repartition(3)
    got = {r.doc_id: tuple(r)[1:5] for r in S.removal(docs, with_text=True).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] > 0 for w in want) > 40


def test_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    data[6000:7000] = data[1000:2000]
    offsets = np.array([0, 300, 9000])
    monkeypatch.setattr(S, "PLACE", np.uint64((1 << 11) - 1))
    parts = [np.concatenate(x) for x in zip(*S._in_parts(data, offsets))]
    strings = sum((parts[2] - parts[1] + 1).tolist())
    assert strings == (300 - 199) + (8700 - 199)


def test_repeated_rows_null_ids_and_no_rows(spark, documents):
    rows = [(None, "q" * 50 + "r" * 200), (3, "r" * 200), (3, "r" * 200), (7, None)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in S.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("3", 200, 200, 1), ("3", 200, 200, 1), ("7", 0, 0, 0), ("None", 250, 200, 1)]
    assert S.removal(documents([])).collect() == []
