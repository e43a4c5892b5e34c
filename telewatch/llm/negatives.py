"""Hard negatives: integer inner products of tiles by Strassen's recursion, and heaps that merge.

Every component x becomes floor(256 * x) and a score is an inner product of whole numbers, so it is exact, and ties are ties. Anchors'
`POSITIVES` best other rows of the same label are their positives; for each of these the `NEGATIVES` best rows of another label whose score
lies between `low` per cent of the positive's and the positive's are its hard negatives. Higher scores come first, then smaller ids.

Method. Anchors and candidates are packed into tiles of int64, and a tile of anchors is multiplied with a tile of candidates by Strassen's
seven products, each dimension padded with zeros to an even number, down to `LEAF`; all additions are exact (modulo 2 ** 64, as the ring
has it). The best of a tile are kept per anchor in a heap of fixed size; heaps merge in any order, within a task as tiles pass and over tasks
by rank. A first pass finds the positives; a second one fills a heap per positive's window, as a window is known only then.

Scale. Each pair of a row and an anchor is scored, twice, in tiles: the work is their product, by definition of the task. A tile of candidates
(`TILE_BYTES`) is packed where it lies, and sent once for each tile of anchors; a tile of anchors is sent to each of the salts that the
candidates are dealt over. So every task has a share whatever the labels or ids, a third of all rows with one label included, and
holds two tiles and one set of heaps. Only heaps leave a task.

Defined cases. Rows with a null id, label or vector, or with a null or non-finite component take no part. An empty vector scores 0; vectors
of different lengths are as if continued with zeros. Rows with equal ids are rows of their own as candidates, but no row is a candidate of
an anchor with its own id; of anchors with one id that of the least label and vector counts. Scores beyond 63 bits wrap. Empty tables,
an anchor without a positive and a positive without a negative give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telewatch.sources.tables import materialise

POSITIVES, NEGATIVES = 5, 5
LEAF = 32
ANCHOR_TILE, TILE_BYTES = 512, 1 << 20
NONE = np.iinfo(np.int64).min  # below every score that counts


def _padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if a.shape == (rows, columns):
        return a
    out = np.zeros((rows, columns), np.int64)
    out[:a.shape[0], :a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by seven products of halves; odd dimensions are padded with zeros."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = _padded(a, m + m % 2, k + k % 2), _padded(b, k + k % 2, n + n % 2)
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j], out[:i, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :j], out[i:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best `size` (score, id) of each of `n` owners; NONE where there are fewer."""

    def __init__(self, n: int, size: int):
        self.scores, self.ids = np.full((n, size), NONE), np.full((n, size), NONE)

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in scores (a row per owner, NONE for what does not count) of the columns' ids."""
        n, size = self.scores.shape
        least = self.scores[:, -1]  # what a new one has to reach
        if scores.shape[1] > size:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - size, axis=1)[:, -size])
        owner, at = np.nonzero((scores >= least[:, None]) & (scores != NONE))
        if not len(owner):
            return
        old = self.scores != NONE
        owner, new = np.concatenate((np.nonzero(old)[0], owner)), np.concatenate((self.scores[old], scores[owner, at]))
        ids = np.concatenate((self.ids[old], ids[at]))
        order = np.lexsort((ids, ~new, owner))  # ~x falls as x rises, and has no overflow
        owner, new, ids = owner[order], new[order], ids[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < size
        self.scores[:], self.ids[:] = NONE, NONE
        self.scores[owner[keep], rank[keep]], self.ids[owner[keep], rank[keep]] = new[keep], ids[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, score and id of all that is kept."""
        owner, at = np.nonzero(self.scores != NONE)
        return owner, self.scores[owner, at], self.ids[owner, at]


def _matrix(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _pack(vectors: list[list[int]]) -> bytes:
    out = np.zeros((len(vectors), max(1, max(map(len, vectors)))), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out.tobytes()


TILE = pa.schema([("salt", pa.int64()), ("c_ids", pa.binary()), ("c_labels", pa.binary()), ("c_tile", pa.binary())])


def _tiles(salts: int):
    """Candidates of a task packed into tiles; tiles are dealt over the salts in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, ids, labels, vectors, size = TaskContext.get().partitionId(), [], [], [], 0

        def tile() -> pa.RecordBatch:
            row = {"salt": salt % salts, "c_ids": np.array(ids, np.int64).tobytes(), "c_labels": np.array(labels, np.int64).tobytes(), "c_tile": _pack(vectors)}
            return pa.RecordBatch.from_pylist([row], schema=TILE)

        for batch in batches:
            for r in batch.to_pylist():
                if vectors and size + 8 * len(r["q"]) > TILE_BYTES:
                    yield tile()
                    salt, ids, labels, vectors, size = salt + 1, [], [], [], 0
                ids.append(r["vec_id"])
                labels.append(r["label"])
                vectors.append(r["q"])
                size += 8 * max(1, len(r["q"]))
        if vectors:
            yield tile()

    return run


def _anchor_tiles(anchors: DataFrame, count: int, salts: int, more: list[str]) -> DataFrame:
    """Anchors in `count` tiles, each sent to all salts. Ids are distinct, so a hash of them deals evenly."""
    row = F.struct(F.col("vec_id").alias("id"), "label", "q", *more)
    tiles = anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("tile")).agg(F.collect_list(row).alias("anchors"))
    return tiles.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


def _pass(anchors: DataFrame, candidates: DataFrame, count: int, salts: int, more: list[str], fn, schema: str) -> DataFrame:
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _anchor_tiles(anchors, count, salts, more).repartition(tasks, "tile", "salt")
    right = candidates.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return left.join(right.repartition(tasks, "tile", "salt"), ["tile", "salt"]).mapInArrow(fn, schema)


def _scored(batches: Iterator[pa.RecordBatch]):
    """(tile number, its anchors, their ids, labels and matrix, ids, labels and scores of the candidates) of each pair of tiles."""
    tile, held = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in ("tile", "c_ids", "c_labels", "c_tile")}
            if row["tile"].as_py() != tile:
                tile, anchors = row["tile"].as_py(), batch.column("anchors")[k].as_py()
                a = np.frombuffer(_pack([x["q"] for x in anchors]), np.int64).reshape(len(anchors), -1)
                held = anchors, np.array([x["id"] for x in anchors], np.int64), np.array([x["label"] for x in anchors], np.int64), a
            anchors, a_ids, a_labels, a = held
            ids, labels = (np.frombuffer(row[c].as_py(), np.int64) for c in ("c_ids", "c_labels"))
            c = _matrix(row["c_tile"].as_py(), len(ids))
            width = max(a.shape[1], c.shape[1])
            scores = strassen(_padded(a, len(a), width), np.ascontiguousarray(_padded(c, len(c), width).T))
            yield tile, anchors, a_ids, a_labels, ids, labels, scores


def _positives(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, heaps, own = None, None, None

        def out() -> pa.RecordBatch:
            owner, scores, ids = heaps.rows()
            return pa.RecordBatch.from_pydict({"vec_id": own[owner], "positive_id": ids, "positive_score": scores})

        for number, anchors, a_ids, a_labels, ids, labels, scores in _scored(batches):
            if number != tile:
                if heaps is not None:
                    yield out()
                tile, heaps, own = number, Heaps(len(a_ids), size), a_ids
            counts = (a_labels[:, None] == labels) & (a_ids[:, None] != ids)
            heaps.merge(np.where(counts, scores, NONE), ids)
        if heaps is not None:
            yield out()

    return run


def _negatives(size: int, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, heaps, windows = None, None, None

        def out() -> pa.RecordBatch:
            owner, scores, ids = heaps.rows()
            return pa.RecordBatch.from_pydict({
                "anchor_id": windows[0][owner], "place": windows[1][owner], "positive_id": windows[2][owner], "positive_score": windows[3][owner],
                "negative_id": ids, "negative_score": scores})

        for number, anchors, a_ids, a_labels, ids, labels, scores in _scored(batches):
            if number != tile:
                if heaps is not None:
                    yield out()
                rows = [(k, x["id"], p["place"], p["positive_id"], p["positive_score"]) for k, x in enumerate(anchors) for p in x["positives"]]
                at, *windows = (np.array(c, np.int64) for c in zip(*rows))
                floor = np.array([-(-low * s // 100) for *_, s in rows], np.int64)  # the least whole score in the window
                tile, heaps = number, Heaps(len(at), size)
            other = a_labels[:, None] != labels
            for first in range(0, len(at), ANCHOR_TILE):  # windows in lots, so that no matrix is larger than the scores
                lot = slice(first, first + ANCHOR_TILE)
                s = scores[at[lot]]
                part = Heaps(0, size)
                part.scores, part.ids = heaps.scores[lot], heaps.ids[lot]  # views: merging fills the whole
                part.merge(np.where(other[at[lot]] & (s <= windows[3][lot][:, None]) & (s >= floor[lot][:, None]), s, NONE), ids)
        if heaps is not None:
            yield out()

    return run


def _best(df: DataFrame, keys: list[str], score: str, other: str, size: int) -> DataFrame:
    """Merge the heaps of all tasks: the first `size` per key, with their rank."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), other)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, label and q, the vector in whole numbers, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("q"))


def mine(df: DataFrame, anchor=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, anchor_tile: int = ANCHOR_TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `vec_id, embedding, label` rows.

    `anchor` is a condition on vec_id, by default that it is divisible by 100.
    """
    spark = df.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = usable(df)
    chosen = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor)
    anchors = materialise(chosen.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q"), "anchors")
    count = max(1, -(-anchors.count() // anchor_tile))
    candidates = materialise(rows.mapInArrow(_tiles(salts), "salt long, c_ids binary, c_labels binary, c_tile binary"), "candidate_tiles")
    found = _pass(anchors, candidates, count, salts, [], _positives(positives), "vec_id long, positive_id long, positive_score long")
    best = _best(found, ["vec_id"], "positive_score", "positive_id", positives)
    # at most `positives` rows an anchor
    per_anchor = best.groupBy("vec_id").agg(F.collect_list(F.struct(F.col("rank").cast("long").alias("place"), "positive_id", "positive_score")).alias("positives"))
    ready = materialise(anchors.join(per_anchor, "vec_id"), "anchors_with_positives")
    schema = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = _pass(ready, candidates, count, salts, ["positives"], _negatives(negatives, low), schema)
    return _best(hard, ["anchor_id", "place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 5"""
