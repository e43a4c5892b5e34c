"""The language model against counts in dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from telewatch.llm import common, lm
from telewatch.llm.eliasfano import EliasFano, encode

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(0)
    for universe, n in ((1, 1), (2 ** 64, 1), (2 ** 64, 3000), (10, 10), (5000, 5000), (2 ** 40, 70_000), (10 ** 6, 3), (2 ** 33, 0)):
        values = np.unique(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True)) if n < universe else np.arange(n, dtype=np.uint64)
        e = EliasFano(encode(values, universe))
        asked = np.concatenate([values, rng.integers(0, universe - 1, 2000, dtype=np.uint64, endpoint=True)])
        at = np.searchsorted(values, asked)
        want = np.where((at < len(values)) & (values[np.minimum(at, len(values) - 1)] == asked), at, -1) if len(values) else np.full(len(asked), -1)
        assert (e.find(asked) == want).all()


def test_crowded_buckets_are_halved():
    class Counted:
        def __init__(self, a):
            self.a, self.n = a, 0

        def __getitem__(self, at):
            self.n += 1
            return self.a[at]

    values = np.concatenate([np.arange(3000, dtype=np.uint64) * np.uint64(3), (np.uint64(1) << np.uint64(36)) + np.arange(50, dtype=np.uint64)])
    e = EliasFano(encode(values, 1 << 40))  # two buckets hold all values, as a frequent context does
    e.packed = Counted(e.packed)
    asked = np.concatenate([values, values + np.uint64(1), np.array([9000, (1 << 40) - 1], np.uint64)])
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    assert (e.find(asked) == np.where(values[at] == asked, at, -1)).all()
    assert e.packed.n < 100  # one look a value made 6,000


def toks(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + ["</s>"]


def direct(texts, fold, order):
    train = [toks(t) for t, held in zip(texts, fold) if not held]
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        s = ["</s>", *t]
        for k in range(1, order + 1):
            for i in range(1 if k < 3 else k - 1, len(s)):
                if k == 1:
                    grams[1][(s[i],)] += 1
                elif i - k + 1 >= 0:
                    grams[k][tuple(s[i - k + 1:i + 1])] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    out = []
    for t in texts:
        s, base, total = ["</s>", *toks(t)], 0.0, 0.0
        for i in range(1, len(s)):
            p = (grams[1][(s[i],)] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                c = tuple(s[i - k + 1:i]) if i - k + 1 >= 0 else None
                if c and grams[k - 1][c]:
                    p = (grams[k][c + (s[i],)] + lm.MU * p) / (grams[k - 1][c] + lm.MU)
            total += math.log10(p)
        out.append((len(s) - 1, sum(grams[1][(x,)] > 0 for x in s[1:]), n, base, total))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores(documents, order, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_ROWS", 64)
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 300)
    rng = np.random.default_rng(order)
    texts = [None, "", "\n", "the The THE", "é \x1c"] + [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(1, 60))) % 80) for _ in range(60)]
    docs = documents(texts).withColumnRenamed("lang", "score").repartition(3)
    fold = {r.doc_id: r.h for r in docs.select("doc_id", (common.fold_of("doc_id", 5) == 1).alias("h")).collect()}
    model, stored = lm.train(docs, common.fold_of("doc_id", 5) == 1, order)
    got = {r.doc_id: r for r in lm.score(stored, model).collect()}
    want = direct(texts, [fold[i] for i in range(len(texts))], order)
    assert sum(fold.values()) > 5
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i], n, known, total)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base))
        assert score - n / lm.STEPS - 1e-9 <= r.score <= score + 1e-9  # codes round down by at most a step
    end = int(model.words.find(np.array([lm.END]))[0])
    firsts = {toks(t)[0] for i, t in enumerate(texts) if not fold[i]}
    assert model.grams[0].followers(end) == len(firsts)


def test_no_rows(spark, documents):
    model, stored = lm.train(documents([]), common.fold_of("doc_id", 5) == 1)
    assert lm.score(stored, model).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    model, stored = lm.train(docs, common.fold_of("doc_id", 5) == 1)
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in lm.score(stored, model).collect()] == [(None, 3, 3, 6)] * 2
    held = lm.train(documents(["a b"], 0), common.fold_of("doc_id", 1) == 0)
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(held[1], held[0]).collect()] == [(0, 0, 0.0, 0.0)]


def test_the_query_counts_three_words(spark, tmp_path):
    from telewatch.llm import queries
    rows = [(i, "a c d f" if i % 2 else "x c y f") for i in range(200)]  # what follows c depends on the word before it
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.QUERIES["op8_language_model"](spark, str(tmp_path)).collect()}
    fold = {r.doc_id: r.held for r in docs.select("doc_id", (common.fold_of("doc_id", 5) == 1).alias("held")).collect()}
    for (i, _), want in zip(rows, direct([t for _, t in rows], [fold[i] for i, _ in rows], 3)):
        assert want[-1] - want[0] / lm.STEPS - 1e-9 <= got[i] <= want[-1] + 1e-9
