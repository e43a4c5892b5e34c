"""A quality classifier from positive and unlabelled texts.

Trusted positives and unlabelled texts give a linear model on hashed byte pairs and a few shares of a text. It minimises the non-negative
unbiased risk  prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])  with the logistic loss, so its scores estimate the
probability of a positive. The class prior is estimated from the same two samples (`estimate_prior`).

The model is fitted on bounded samples, `FIT_ROWS` of each kind, that a hash of the id chooses among all rows; only their features reach
the driver (about 2 KB a row). Scoring is a map over whole texts.

Defined cases: null texts are empty; an empty text has zero features and gets the score of the model's bias; with no positives or
no unlabelled rows every score is 0.5; repeated rows of a table count as often as they occur; labels other than 0 and 1 are ignored; further
columns are ignored by `score` and kept by `good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.llm import common as C

FIT_ROWS = 6000  # rows of each sample that the model is fitted on
BINS = 512
ROUNDS, STEP, DECAY = 300, 1.0, 1e-4

_CLASS = np.zeros(256, np.uint8)  # 0: lower-case letters and all else
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#*$%&|<>@^~_=+\\/", "\"'()[]{}-"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 9
SHARES = 10 + 5


def features(column: pa.Array) -> np.ndarray:
    """One row per text: square roots of byte pair shares, shares of character classes, and shape of words and lines."""
    data, offsets = C.text_bytes(column)
    n, sizes = len(column), np.diff(offsets)
    pairs, classes = np.zeros((n, BINS), np.float32), np.zeros((n, 10), np.float32)
    for i in range(n):  # a text at a time: histograms of its own bytes
        own = data[offsets[i]:offsets[i + 1]]
        if len(own):
            classes[i] = np.bincount(_CLASS[own], minlength=10)
            code = own[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + own[1:].astype(np.uint32) * np.uint32(0x85EBCA77)
            pairs[i] = np.bincount(code >> np.uint32(23), minlength=BINS)
    size = np.maximum(sizes, 1)[:, None]
    starts, ends, owner = C.word_spans(data, offsets)
    words = np.bincount(owner, minlength=n)
    hashes = C.word_hashes(data, starts, ends)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    some = np.maximum(words, 1)
    shape = np.stack([np.log1p(words) / 10, distinct / some, distinct / np.sqrt(some) / 30, np.bincount(owner[again], minlength=n) / some,
                      np.bincount(owner, ends - starts, minlength=n) / some / 20], 1)
    return np.concatenate([np.sqrt(pairs / size), np.sqrt(classes / size), shape], 1).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.round(((x.astype(np.float64) - self.mean) / self.scale) @ self.weights + self.bias, 9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x.astype(np.float64) - self.mean) / self.scale) @ self.weights + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)  # beyond this, the size of a batch shows


def _fit(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk. Where the negative part falls below zero, the step climbs back instead."""
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    p1, u1 = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    for t in range(1, ROUNDS + 1):
        zp, zu = np.clip(p1 @ w, -30, 30), np.clip(u1 @ w, -30, 30)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        grad_negative = u1.T @ su / len(u1) - prior * (p1.T @ sp) / len(p1)
        grad = prior * (p1.T @ (sp - 1)) / len(p1) + grad_negative if negative >= 0 else -grad_negative
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = w - STEP * (1 - t / (ROUNDS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(sp: np.ndarray, counts: np.ndarray) -> float:
    """The share of positives among the unlabelled: where a classifier of P against U is surest, nearly all unlabelled rows are positives, so
    the ratio of the two tails bounds the share from above; the least such bound, with a margin for small tails, is the estimate.

    `sp` are sorted scores of positives that the classifier was not fitted on; `counts[i]` says how many unlabelled rows have a score that i of them do not exceed.
    """
    total = int(counts.sum())
    if not len(sp) or not total:
        return 0.5
    tail_p = 1 - np.arange(len(sp)) / len(sp)
    tail_u = np.cumsum(counts[::-1])[::-1][1:] / total
    margin = np.sqrt(np.log(40) / (2 * total)) + np.sqrt(np.log(40) / (2 * len(sp)))
    best = np.argmin((tail_u + margin) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def _places(docs: DataFrame, model: Model, sp: np.ndarray, text: str) -> np.ndarray:
    """How many rows of `docs`, all of them, score as high as 0, 1, ... of the positives: one count per place leaves a task."""
    def run(batches):
        counts = np.zeros(len(sp) + 1, np.int64)
        for batch in batches:
            counts += np.bincount(np.searchsorted(sp, model.margins(features(batch.column(0))), "right"), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int64()), "n": pa.array(counts[at], pa.int64())})

    found = docs.select(F.col(text).cast("string")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # a row per place at most
    out = np.zeros(len(sp) + 1, np.int64)
    for r in found:
        out[r.place] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, held_out, prior: float | None = None, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on rows for which `held_out` (a condition on `key`) is false: positives of `labels`, and unlabelled documents."""
    free = ~held_out
    first = F.xxhash64(F.col(key), F.lit(17))
    positives = labels.filter(free & (F.col("quality") == 1)).select(key).distinct()
    # At most `rows` ids each, so these tables have a fixed bound.
    p_ids = positives.orderBy(first, key).limit(rows)
    u_ids = docs.select(key).filter(free & F.col(key).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(29)), key).limit(rows)

    def vectors(ids: DataFrame) -> np.ndarray:
        chosen = docs.select(F.col(key), F.col(text).cast("string")).join(F.broadcast(ids.distinct()), key, "left_semi")
        # An id that many rows share would let the sample grow: one text per id.
        chosen = chosen.groupBy(key).agg(F.min(text).alias("text"))
        found = C.map_batches(chosen, lambda b: {"key": b.column(0), "x": pa.array([r.tobytes() for r in features(b.column(1))], pa.binary())}, "key long, x binary")
        got = sorted((k, bytes(x)) for k, x in found.toLocalIterator())  # order of arrival must not change the model
        return np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(-1, BINS + SHARES).astype(np.float64)

    p, u = vectors(p_ids), vectors(u_ids)
    none = np.zeros(BINS + SHARES)
    if not len(p) or not len(u):
        return Model(none, 0.0, none, none + 1, 0.5)
    mean, scale = u.mean(0), u.std(0) + 0.02
    p, u = (p - mean) / scale / np.sqrt(p.shape[1]), (u - mean) / scale / np.sqrt(p.shape[1])
    shrink = np.sqrt(p.shape[1])
    if prior is None:  # fitted on half of the positives, placed by the other half and all unlabelled rows
        w, b = _fit(p[::2], u[::2], 0.5)
        halves = Model(w / shrink, b, mean, scale, 0.5)
        sp = np.sort(np.round(p[1::2] @ w + b, 9))
        prior = estimate_prior(sp, _places(docs.filter(free & F.col(key).isNotNull()), halves, sp, text))
    w, b = _fit(p, u, prior)
    return Model(w / shrink, b, mean, scale, prior)


def in_fold(key: str = "doc_id"):
    return C.fold_of(key, 3) == 1


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), in_fold(key).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        s = model.scores(features(batch.column(2)))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return C.map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a score of `least` or more, with all their columns."""
    at = docs.columns.index(text)
    return C.map_batches(docs, lambda b: b.filter(pa.array(model.scores(features(b.column(at))) >= least)), docs.schema)
